"""Removal of repeated word windows with one FM-index per shard.

Candidate windows come from ``anchors``.  A shard's records are indexed once: suffixes sorted to
the window's depth, their Burrows-Wheeler transform in a wavelet matrix (bit-packed, with
sampled ranks), and no text kept.  The shard's documents are then streamed through it: backward
search from every window's end gives the matching statistic (how many words back the longest
match reaches) and its suffix interval; intervals at the threshold are reported, and the least
document of an interval tells whether the window occurs in an earlier document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.anchors import LAST, Unit, covered, keyed, repeats


class WaveletMatrix:
    """Ranks over a sequence of small integers: one packed bit vector per bit of the alphabet."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self._words, self._ranks, self._zeros = [], [], []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ranks = np.zeros(len(words) + 1, dtype=np.uint32)
            np.cumsum(np.bitwise_count(words), out=ranks[1:])
            self._words.append(words)
            self._ranks.append(ranks)
            self._zeros.append(n - int(ranks[-1]))
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        symbols = np.arange(sigma, dtype=np.int64)
        self._start = np.zeros(sigma, dtype=np.int64)
        self._start = self._descend(symbols, np.zeros(sigma, dtype=np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for depth in range(self.levels):
            word = i >> 6
            ones = self._ranks[depth][word] + np.bitwise_count(self._words[depth][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            ones = ones.astype(np.int64)
            i = np.where((c >> (self.levels - 1 - depth)) & 1, self._zeros[depth] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[j] occurs before position i[j]."""
        return self._descend(c, i) - self._start[c]


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols; symbols are 0 .. sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        rank, reach, n = text.astype(np.int64), 1, len(text)
        while reach < depth + 1:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: max(0, n - reach)] = rank[reach:] + 1
            rank = np.unique(rank * (n + sigma + 2) + ahead, return_inverse=True)[1]
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        self._first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self._bwt = WaveletMatrix(text[self.order - 1].astype(np.int64), sigma)
        self.size = n

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern from those of the pattern."""
        both = self._bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self._first[c] + both[: len(c)], self._first[c] + both[len(c) :]

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the stream at ``ends``: match length (at most ``most``) and interval."""
        length = np.zeros(len(ends), dtype=np.int64)
        lo, hi = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        live = np.arange(len(ends))
        for step in range(most):
            a, b = self.extend(stream[ends[live] - 1 - step], lo[live], hi[live])
            found = a < b
            live = live[found]
            lo[live], hi[live] = a[found], b[found]
            length[live] = step + 1
        return length, lo, hi


#: Windows searched at once.
_BLOCK = 1 << 17


def _solver(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lo, n = table.column("lo").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64)
        doc, tag = table.column("doc").to_numpy(), table.column("tag").to_numpy()
        # Stage 1: the index over all records, each closed by symbol 0; words are told apart by their bytes.
        bodies, symbols = [body.as_py().split() for body in table.column("body")], {}
        words = np.array([symbols.setdefault(w, len(symbols) + 1) for body in bodies for w in body], dtype=np.int64)
        firsts = np.cumsum([0, *map(len, bodies)])
        record = np.repeat(np.arange(len(n)), np.diff(firsts))
        text = np.zeros(len(words) + len(n), dtype=np.int64)
        text[np.arange(len(words)) + record] = words
        base = firsts[:-1] + np.arange(len(n))
        owner = np.repeat(np.arange(len(n)), np.diff(firsts) + 1)
        index = FMIndex(text, len(symbols) + 1, length)
        docs_by_suffix = doc[owner[index.order]]
        del index.order
        # Stage 2: stream the records' windows.
        of = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        window_end = base[of] + inside + length
        repeat = np.zeros(len(of), dtype=bool)
        for a in range(0, len(of), _BLOCK):
            w = slice(a, a + _BLOCK)
            reach, left, right = index.matching(text, window_end[w], length)
            hit = np.flatnonzero(reach >= length)
            at, back = np.unique(left[hit], return_inverse=True)
            stop = np.zeros(len(at), dtype=np.int64)
            stop[back] = right[hit]
            if len(at):
                bounds = np.stack([at, stop], axis=1).reshape(-1)
                least = np.minimum.reduceat(np.append(docs_by_suffix, LAST), bounds)[::2]
                repeat[a + hit] = least[back] < doc[of[w]][hit]
        w = np.flatnonzero(repeat)
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1] + 1) | (of[w[1:]] != of[w[:-1]])
        first = w[new]
        count = np.diff(np.append(np.flatnonzero(new), len(w)))
        return pa.table({"doc": doc[of[first]], "tag": tag[of[first]], "lo": (lo[of[first]] + inside[first]).astype(np.int32), "n": count.astype(np.int32)})

    return run


def _remover(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, starts, ends, kept = [], [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                words = text.as_py().split()
                gone = covered(spans.values.to_numpy(), length, len(words)) if spans.is_valid else np.zeros(len(words), dtype=bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                n_words.append(len(words))
                starts.append(edge[::2].tolist())
                ends.append(edge[1::2].tolist())
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
                names=["doc", "tag", "n_words", "starts", "ends", "kept"],
            )

    return run


def remove_repeated_words(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, n_words, starts, ends, kept): per row the removed word runs and the words left.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of ``length`` words of
    its document covers it whose words also start a window in a document with a smaller doc_id;
    windows are judged on the input.  Null text has no words.  Null doc_ids come after all others
    and are one document; rows sharing a doc_id never remove each other's words.  Other columns
    are ignored; an empty table gives an empty result.
    """
    unit = Unit(words=True, length=length, k=max(1, length // 3), within=False)
    joined = repeats(keyed(docs, id_col, text_col), unit, _solver(length))
    return joined.select("doc", "tag", "text", "spans").mapInArrow(_remover(length), "doc long, tag long, n_words long, starts array<int>, ends array<int>, kept binary")


def report(removed: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeated_words``."""
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return removed.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
