"""Benchmark decontamination: BM25 with block-max pruning, then an overlap check.

The test items are indexed, the training passages are the queries.  Passages overlap so that any
stretch as long as the longest item lies in one whole.  An impact is a term's BM25 weight in an
item, over the item's own total, so a passage with all of an item's terms scores 1.  Items stand
in blocks of similar items; per term and block the index keeps the greatest impact.  For a passage
the block maxima of its terms are summed: a block whose sum stays below the threshold can hold no
hit and is skipped whole (the WAND pivot test, taken for all blocks at once); in the others the
postings are scored exactly.  All pairs at or above the threshold are verified: enough of the
item's question and of its answer must be covered by word trigrams that the passage has too.

The index is sent with the tasks, in parts of items whose text is under ``PART`` bytes each; a
larger benchmark makes more passes.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.scratch import prepare

PART = 4 << 20
SHARD, BLOCK = 512, 8
K1, B = 1.2, 0.75
#: Score that retrieves a pair; shares of question and answer words that confirm it.
THRESHOLD, OVERLAP = 0.5, 0.6
#: Items of ``LEAST_WORDS`` or fewer than ``GRAMMED`` words must stand in the passage as they are.
GRAM, LEAST_WORDS, GRAMMED = 3, 2, 5
#: Scripts without spaces between words: each of their characters is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased runs of letters, digits and non-ASCII bytes, and of unspaced scripts' characters; index of each text's first."""
    plain = tk.lower_ascii(buf)
    word = ((plain >= 97) & (plain <= 122)) | ((plain >= 48) & (plain <= 57)) | (plain >= 128)
    plain[~word] = 32
    starts, ends, firsts = tk.word_spans(plain, offsets)
    cuts = _unspaced_edges(plain)
    if len(cuts):
        cuts = np.setdiff1d(cuts[plain[cuts] != 32], starts)
        starts, ends = np.union1d(starts, cuts), np.union1d(ends, cuts)
        firsts = np.searchsorted(starts, offsets)
    return tk.word_hashes(plain, starts, ends), firsts


def _unspaced_edges(plain: np.ndarray) -> np.ndarray:
    """Where characters of unspaced scripts begin and end, within the buffer."""
    out = []
    for lead, least, most, size in ((0x0F, 0xE0, 0xF0, 3), (0x07, 0xF0, 0xF8, 4)):
        at = np.flatnonzero((plain >= least) & (plain < most))
        at = at[at + size <= len(plain)]
        code = (plain[at] & lead).astype(np.int64)
        for i in range(1, size):
            code = (code << 6) | (plain[at + i] & 0x3F)
        at = at[np.any([(code >= a) & (code <= b) for a, b in UNSPACED], axis=0)]
        out += [at, at + size]
    cuts = np.unique(np.concatenate(out))
    return cuts[cuts < len(plain)]


def _terms(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return terms_of(raw, np.array([0, len(raw)]))[0]


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    #: Words of the question; the answer is the rest.
    cut: int

    def overlaps(self, passage: np.ndarray) -> tuple[float, float]:
        """Shares of question and answer words that trigrams of the passage cover; of a short item, whether it stands there whole."""
        n = len(self.words)
        if n < GRAMMED:
            found = np.ones(max(0, len(passage) - n + 1), dtype=bool)
            for i in range(n):
                found &= passage[i : i + len(found)] == self.words[i]
            return (1.0, 1.0) if found.any() else (0.0, 0.0)
        have = set(zip(*(passage[i : len(passage) - GRAM + 1 + i].tolist() for i in range(GRAM)), strict=True))
        covered = np.zeros(len(self.words), dtype=bool)
        for i, gram in enumerate(zip(*(self.words[j : len(self.words) - GRAM + 1 + j].tolist() for j in range(GRAM)), strict=True)):
            if gram in have:
                covered[i : i + GRAM] = True
        return float(covered[: self.cut].mean()), float(covered[self.cut :].mean())


def parse_item(item_id: int, text: str | None) -> Item | None:
    """The last sentence is the answer (at least three words, at most half); None if under two words."""
    words = _terms(text or "")
    n = len(words)
    if n < LEAST_WORDS:
        return None
    sentences = [s for s in re.split(r"(?<=[.?!])\s+|(?<=[。？！])", text.strip()) if len(_terms(s))]
    last = len(_terms(sentences[-1])) if len(sentences) > 1 else n // 3
    return Item(item_id, words, n - min(max(last, GRAM), max(1, n // 2)))


class Shard:
    """Impacts of up to ``SHARD`` items, and their maxima per block."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, idf: np.ndarray, average: float):
        held = np.unique(np.concatenate([i.words for i in items]))
        self.terms = held
        weight = idf[np.searchsorted(vocabulary, held)]
        tf = np.zeros((len(held), len(items)), dtype=np.float32)
        for j, item in enumerate(items):
            np.add.at(tf[:, j], np.searchsorted(held, item.words), 1)
        size = tf.sum(axis=0)
        impact = weight[:, None] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
        impact = np.where(tf > 0, impact / np.where(tf > 0, impact, 0).sum(axis=0), 0)
        # Items that share their heaviest terms stand together, so that block maxima stay tight.
        order = np.lexsort((impact.argmax(axis=0), (impact * np.arange(len(held))[:, None]).sum(axis=0)))
        self.items = [items[i] for i in order]
        self.impact = impact[:, order].astype(np.float32)
        blocks = -(-len(items) // BLOCK)
        padded = np.zeros((len(held), blocks * BLOCK), dtype=np.float32)
        padded[:, : len(items)] = self.impact
        self.most = padded.reshape(len(held), blocks, BLOCK).max(axis=2)


@dataclass
class Totals:
    """What scores need to know of all items, so that they don't depend on how these are split."""

    count: int
    vocabulary: np.ndarray
    df: np.ndarray
    words: int
    longest: int

    @classmethod
    def of(cls, items: list[Item]) -> Totals:
        vocabulary, df = np.unique(np.concatenate([np.unique(i.words) for i in items]), return_counts=True)
        return cls(len(items), vocabulary, df, sum(len(i.words) for i in items), max(len(i.words) for i in items))

    def plus(self, other: Totals) -> Totals:
        vocabulary, at = np.unique(np.concatenate([self.vocabulary, other.vocabulary]), return_inverse=True)
        df = np.bincount(at, np.concatenate([self.df, other.df])).astype(np.int64)
        return Totals(self.count + other.count, vocabulary, df, self.words + other.words, max(self.longest, other.longest))


class Index:
    def __init__(self, items: list[Item], totals: Totals | None = None):
        totals = totals or Totals.of(items)
        idf = np.log(1 + (totals.count - totals.df + 0.5) / (totals.df + 0.5))
        average = totals.words / totals.count
        items = sorted(items, key=lambda i: (i.words.min(), i.item_id))
        self.shards = [Shard(items[i : i + SHARD], totals.vocabulary, idf, average) for i in range(0, len(items), SHARD)]
        #: Half a passage: at least the longest item.
        self.half = max(32, totals.longest)

    def hits(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, Item, float, int, int]]:
        """(text, item, score, from, to) of every passage and item at or above the threshold."""
        halves = np.maximum(-(-np.diff(firsts) // self.half), 1)
        base = np.cumsum(halves) - halves
        text_of_half = np.repeat(np.arange(len(halves)), halves)
        if not len(words):
            return
        text = np.repeat(np.arange(len(halves)), np.diff(firsts))
        half = base[text] + (np.arange(len(words)) - firsts[text]) // self.half
        has_next = np.append(text_of_half[1:] == text_of_half[:-1], False)
        for shard in self.shards:
            v = len(shard.terms)
            at = np.minimum(np.searchsorted(shard.terms, words), v - 1)
            known = shard.terms[at] == words
            pairs = tk.distinct(half[known] * v + at[known])
            if not len(pairs):
                continue
            where, term = pairs // v, pairs % v
            low = np.searchsorted(where, np.arange(len(text_of_half) + 1))
            filled = np.flatnonzero(np.diff(low))
            bound = np.zeros((len(text_of_half) + 1, shard.most.shape[1]), dtype=np.float32)
            bound[filled] = np.add.reduceat(shard.most[term], low[filled], axis=0)
            bound[:-1] += np.where(has_next[:, None], bound[1:], 0)
            passage, block = np.nonzero(bound[:-1] >= THRESHOLD - 1e-4)
            for b in np.unique(block).tolist():
                for some in np.array_split(passage[block == b], -(-int((block == b).sum()) // 4096)):
                    yield from self._scored(shard, b, some, low, term, v, has_next, text_of_half, base, firsts)

    def _scored(self, shard, b, passages, low, term, v, has_next, text_of_half, base, firsts):
        end = low[passages + 1 + has_next[passages]]
        count = end - low[passages]
        own = np.repeat(np.arange(len(passages)), count)
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[passages], count)
        pairs = tk.distinct(own * v + term[entry])
        own, held = pairs // v, pairs % v
        start = np.searchsorted(own, np.arange(len(passages)))
        columns = shard.impact[:, b * BLOCK : (b + 1) * BLOCK]
        score = np.add.reduceat(columns[held], start, axis=0)
        for p, j in zip(*np.nonzero(score >= THRESHOLD), strict=True):
            h = int(passages[p])
            t = int(text_of_half[h])
            a = int(firsts[t] + (h - base[t]) * self.half)
            yield t, shard.items[b * BLOCK + int(j)], float(score[p, j]), a, min(a + 2 * self.half, int(firsts[t + 1]))


def _verified(index: Index, column: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item_id) to the best (score, question overlap, answer overlap) of the leaks in a text column."""
    raw, offsets = tk.column_bytes(column)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for first, last in tk.text_chunks(offsets, 1 << 20):
        part = offsets[first : last + 1]
        words, firsts = terms_of(raw[part[0] : part[-1]], part - part[0])
        for text, item, score, a, b in index.hits(words, firsts):
            question, answer = item.overlaps(words[a:b])
            if question >= OVERLAP and answer >= OVERLAP:
                key = (first + text, item.item_id)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, question, answer))
    return best


def _mapper(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            best = _verified(index, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[t] for t, _ in best], pa.int64()),
                    pa.array([i for _, i in best], pa.int64()),
                    *(pa.array([v[c] for v in best.values()], pa.float64()) for c in range(3)),
                ],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return run


def _drop_mapper(index: Index, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[row for row, _ in _verified(index, batch.column(text))]] = False
            yield batch.filter(pa.array(clean))

    return run


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Index]:
    """The benchmark's index in parts, each built from items of about ``PART`` bytes."""
    prepare(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    parts = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // PART + 1

    def parsed(part: int) -> list[Item]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        return [i for i in (parse_item(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))) if i]

    totals = None
    if parts > 1:
        for found in map(parsed, range(parts)):
            if found:
                totals = totals.plus(Totals.of(found)) if totals else Totals.of(found)
    for part in range(parts):
        if found := parsed(part):
            yield Index(found, totals)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): verified leaks, best passage of each.

    Whole texts are searched.  Items of two to four words must occur as they are.  Items of one
    word, or null, can't be told from chance and take no part; equal items are each reported.  Null or wordless documents never
    match; rows repeated in ``docs`` give repeated results, and rows with a null doc_id are
    reported with null.  Other columns are ignored; empty tables give an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = [texts.mapInArrow(_mapper(index), _HIT) for index in _indexes(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _HIT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without a verified leak, all columns as they are; judged row by row, without a shuffle."""
    for index in _indexes(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_drop_mapper(index, docs.columns.index(text_col)), docs.schema)
    return docs
