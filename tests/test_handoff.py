"""Freezing, staged validation, assignments, configuration, guarded writes and tolerant caches."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import handoff, units
from lectern.sources import readers, sinks

NOTE = """---
title: "On things"
aliases: [things]
bilingual_layout: english_blockquote_chinese_body
---
# On things

## Abstract

We study $x$ things.

- one item

## References

[1] Doe, J. and Roe, R. A study of odd things. Journal of Tests, 2000. ^ref-1

[2] https://example.org/data, 2001. ^ref-2
"""


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def finished(spark, before, zh="译 $x$"):
    body = handoff.frozen_units(before)
    done = body.where("requires_translation").select("doc_id", "unit_id", F.lit(zh).alias("zh"))
    titles = spark.createDataFrame([(0, 1, "怪事研究")], "doc_id long, number int, zh string")
    return units.merge_notes(before, done, titles).select("doc_id", "text"), handoff.freeze(before), body


def test_prepared_notes_are_ready_or_say_why(spark):
    bad = NOTE.replace("# On things", "# On things\n\n<table><tr><td>a</td></tr></table>\n\n![x](https://x.org/a.png)", 1)
    empty = "---\ntitle: t\naliases: [t]\n---\n# T\n"
    rows = {r.doc_id: r for r in handoff.validate_prepared(frame(spark, NOTE, bad, empty, None)).collect()}
    assert rows[0].ok and rows[0].ready_for_translation and rows[0].provenance_verified is None
    assert (rows[0].translation_units, rows[0].model_units_total, rows[0].reference_blocks, rows[0].reference_title_units) == (2, 2, 2, 2)
    assert not rows[1].ready_for_translation and (rows[1].html_tables, rows[1].remote_images) == (1, 1)
    assert not rows[2].ok and rows[2].errors == ["no_units"] and rows[2].translation_units == 0
    assert not rows[3].ready_for_translation
    planned = {r.doc_id: r for r in handoff.validate_prepared(frame(spark, bad), remote_allowed=True).collect()}[0]
    assert (planned.remote_images, planned.planned_remote_images) == (0, 1) and "remote_image" not in planned.warnings


def test_final_notes_agree_with_what_was_frozen(spark):
    text, frozen, body = finished(spark, frame(spark, NOTE))
    [fine] = handoff.validate_final(text, frozen, body).collect()
    assert fine.errors == [] and fine.ok and fine.provenance_verified and not fine.ready_for_translation
    assert (fine.reference_title_units, fine.model_units_total, fine.placeholders) == (2, 3, 0)
    edit = lambda old, new: text.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    wrong = {
        ("odd things.", "even things."): {"references_changed"},
        ("《怪事研究》", ""): {"reference_titles_differ"},
        ("译 $x$", "{{ZH:u00001}}"): {"translations_missing", "placeholders_left"},
        ("> - one item", "> - two items"): {"quotes_missing_or_reordered"},
        ("english_blockquote", "other"): {"layout_not_declared"},
        ("2001. ^ref-2", "2001.《数据》 ^ref-2"): {"titleless_reference_translated"},
    }
    for (old, new), rules in wrong.items():
        [row] = handoff.validate_final(edit(old, new), frozen, body).collect()
        assert rules <= set(row.errors), (old, row.errors)


def test_a_note_without_a_packet_is_unverified(spark):
    text, frozen, body = finished(spark, frame(spark, NOTE))
    none = frozen.where("doc_id < 0")
    [strict] = handoff.validate_final(text, none, body).collect()
    [audit] = handoff.validate_final(text, none, body, strict=False).collect()
    assert strict.errors == ["provenance_unverified"] and audit.ok and "provenance_unverified" in audit.warnings and not audit.provenance_verified
    states = spark.createDataFrame([(0, "x", "y")], "doc_id long, bilingual_layout string, source_sha256 string")
    [state] = handoff.validate_final(text, frozen, body, states).collect()
    assert {"state_layout", "state_references"} <= set(state.errors)


def test_empty_tables_have_no_reports(spark):
    none = frame(spark, "x").where("doc_id < 0")
    assert handoff.validate_prepared(none).count() == 0 and handoff.freeze(none).count() == 0


def test_leading_math_comes_back_only_where_it_is_plain(spark):
    cases = [
        (r"$\alpha$-cuts", "α-割集", r"$\alpha$割集"),
        (r"$H_2$ storage", "H<sub>2</sub> 储存", "$H_2$储存"),
        (r"$\alpha$ and $\alpha$", "α 和", "α 和"),
        (r"On $\alpha$", "α 论", "α 论"),
        (r"$\beta$ of", "α 的", "α 的"),
        (r"$\alpha$ of", "阿尔法 α", "阿尔法 α"),
        (r"$\alpha$ of", r"$\alpha$ 的", r"$\alpha$ 的"),
        ("plain", "α 的", "α 的"),
        ("plain", None, None),
    ]
    rows = spark.createDataFrame(cases, "s string, t string, want string")
    assert [r for r in rows.select("want", handoff.restore_leading_math(F.col("s"), F.col("t")).alias("got")).collect() if r.want != r.got] == []


def test_resource_roots_stay_below_the_vault():
    assert handoff.resource_roots("assets/./x", ("more", "_resources", "/v/in"), vault="/v") == ("assets/x", "_resources", "_附件", "more", "in")
    for primary, configured in (("/abs", ()), (".", ()), ("../up", ()), ("ok", ("../up",)), ("ok", ("a/..",)), ("ok", ("/elsewhere",))):
        with pytest.raises(ValueError):
            handoff.resource_roots(primary, configured, vault="/v")


def test_assignments_name_packet_and_translator(spark):
    who = handoff.identity("Be true.", "m", "high", ("c1", "t1"))
    assert who["translator_fingerprint"] != handoff.identity("Be true.", "m", "high", ("c1", "t2"))["translator_fingerprint"]
    packets = spark.createDataFrame([(3, "{}", 7)], "doc_id long, packet string, unit_count long")
    made = json.loads(handoff.assignments(packets, who, F.lit("in"), F.lit("out")).first().assignment)
    assert made["unit_count"] == 7 and made["packet_sha256"] == hashlib.sha256(b"{}").hexdigest() and made["requested_runtime"] == {"model": "m", "reasoning_effort": "high", "quality_tier": "publication"}


def test_config_drift(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, text string")
    have = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, text string")
    assert sorted(tuple(r) for r in handoff.config_drift(want, have).collect()) == [("b", "differs"), ("c", "missing")]


def test_writes_are_guarded_and_backed_up(spark, tmp_path):
    root, note = f"file://{tmp_path}", "---\ntitle: x\n---\n# A title\n"
    (tmp_path / "a.md").write_text("old")
    (tmp_path / "b.md").write_text("changed meanwhile")
    base = hashlib.sha256(b"old").hexdigest()
    rows = spark.createDataFrame([("a.md", note, base, True), ("b.md", note, base, True), ("c.md", note, None, True), ("d.md", note, None, None)], "path string, text string, base_sha256 string, ready boolean")
    status = {r.path: r.status for r in sinks.write_notes(rows, root, write=True, backup="1").collect()}
    assert status == {"a.md": "written", "b.md": "conflict", "c.md": "written", "d.md": "invalid"}
    assert (tmp_path / "a.md.bak-1").read_text() == "old" and (tmp_path / "b.md").read_text() == "changed meanwhile" and not (tmp_path / "d.md").exists()
    # A second try of the same write finds its own bytes.
    assert {r.path: r.status for r in sinks.write_notes(rows, root, write=True, backup="1").collect()}["a.md"] == "unchanged"


def test_caches_of_another_version_are_empty(spark, tmp_path):
    path = tmp_path / "c.json"
    read = lambda: [tuple(r) for r in readers.read_cache(spark, f"file://{path}", "struct<n:int>", 2).selectExpr("key", "value.n").collect()]
    assert read() == []
    for text, rows in (("{", []), ('{"schema_version": 1, "entries": {"a": {"n": 1}}}', []), ('{"schema_version": 2, "entries": []}', []), ('{"schema_version": 2, "entries": {"a": {"n": 1}}}', [("a", 1)])):
        path.write_text(text)
        assert read() == rows, text


def test_index_round_trip_by_version(spark, tmp_path):
    path, rows = f"file://{tmp_path}/index", spark.createDataFrame([("a.md", 1)], "path string, size long")
    assert readers.read_index(spark, path, "path string, size long", 1).count() == 0
    sinks.write_index(rows, path, 1)
    assert [tuple(r) for r in readers.read_index(spark, path, "path string, size long", 1).collect()] == [("a.md", 1)]
    assert readers.read_index(spark, path, "path string, size long", 2).count() == 0


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    spark.range(100).coalesce(1).write.parquet(path)
    rows = readers.spread(spark.read.parquet(path), "id")
    cores = spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() == (cores if cores > 2 else 1) and rows.count() == 100
