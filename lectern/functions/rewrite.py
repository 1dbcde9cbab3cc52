"""Regex rewriting inside Catalyst: edit only between, or only at, the matches of a pattern.

For a pattern that never matches the empty string, ``split(t, p)`` and
``regexp_extract_all(t, p)`` interleave to exactly ``t``.  Mapping one of the two arrays before
interleaving gives a rewrite that a plain ``regexp_replace`` can't express, with no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans of Markdown that no text rewrite may touch.
PROTECTED = (
    r"(?ms)\A---\r?\n.*?\r?\n---(?=\r?\n|\z)"
    r"|^(`{3,}|~{3,})[^\r\n]*\r?\n.*?^\1[^\r\n]*(?:\r?\n|\z)"
    r"|(?<!\\)\$\$.*?(?<!\\)\$\$"
    r"|(`+)[^\r\n]*?\2"
    r"|!?\[\[[^\]\r\n]+\]\]"
    r"|!?\[[^\]\r\n]*\]\([^)\r\n]*\)"
    r"|(?<![\\$])\$(?!\$)(?:\\.|[^$\r\n])+?(?<!\\)\$(?!\$)"
)


def _interleave(gaps: Column, seps: Column) -> Column:
    return F.array_join(F.zip_with(gaps, seps, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")


def between(text: Column, pattern: str, edit: Callable[[Column], Column]) -> Column:
    """``edit`` applied to every stretch between matches of ``pattern``."""
    return let(text, lambda t: _interleave(F.transform(F.split(t, pattern, -1), edit), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))


def at_matches(text: Column, pattern: str, edit: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` replaced by ``edit`` of it."""
    return let(text, lambda t: _interleave(F.split(t, pattern, -1), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), edit)))


def unprotected(text: Column, edit: Callable[[Column], Column]) -> Column:
    return between(text, PROTECTED, edit)


def gaps(text: Column, pattern: str = PROTECTED) -> Column:
    """The stretches of text between matches."""
    return F.split(text, pattern, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
