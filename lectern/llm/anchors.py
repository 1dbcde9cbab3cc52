"""Candidate positions for exact repeats of fixed length, without shuffling every position.

Every window of ``length`` symbols owns one anchor: the window's k-gram with the least hash
(leftmost on ties).  Equal windows own equal k-grams at equal offsets, so windows only need
comparing within an anchor key.  Runs of consecutive windows with one anchor form a record
(lo, n): windows lo .. lo+n-1.  Records travel as packed column chunks, about 30 bytes each and
one per (length - k) / 2 symbols:

* records of equal content (by a 128-bit BLAKE2b of their bytes) are decided at once: all but the
  earliest repeat it;
* a key with one content only is finished; the others are *open* and their content is fetched.

Keys that a sample of the documents shows to be frequent (a passage in ever new surroundings) are
dealt by content from the start, so no task gets all records of one.  The sample decides routes only.

A document is identified by (doc_id, crc32 of its text), so rows sharing a doc_id stay apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.scratch import materialize, prepare, shuffle_partitions

#: Stands for a null doc_id in orderings: after all others.
LAST = 2**63 - 1
_LOW32, _HIGH32 = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
_CHUNK = "bucket long, kind int, key binary, content binary, doc binary, place binary, n binary"
#: One document in ``SAMPLED`` is looked at for frequent keys; at most ``MOST_FREQUENT`` are kept.
SAMPLED, MOST_FREQUENT = 32, 20_000
_RESOLVED = "kind int, doc long, tag long, lo int, n int, key long, hot boolean"


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``length`` symbols (bytes or words), anchored by k of them."""

    words: bool
    length: int
    k: int
    #: Whether an earlier start in the same document counts as a repeat.
    within: bool
    #: Keys with more open records than this are spread by the content of each window.
    hot_key: int = 2048
    #: Longest stretch of text hashed at once, and bytes of text gathered before a chunk is sent.
    segment: int = 512 << 10
    flush: int = 4 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, tag, text) with text as bytes; null text counts as empty, null ids come last.

    ``carry`` names columns to take along in a struct ``carried``, with whether there was a text in
    ``had_text``.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    more = [F.struct(*carry).alias("carried"), F.col(text_col).isNotNull().alias("had_text")] if carry else []
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.crc32(text).alias("tag"), text.alias("text"), *more)


def records(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """lo, n and anchor key of all records in the given segments of one sequence."""
    spans = tk.Spans(symbols)
    grams = spans.windows(unit.k)
    counts = np.maximum(ends - starts - unit.length + 1, 0)
    total = int(counts.sum())
    if total == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    ranked = (grams & _HIGH32) | np.arange(len(grams), dtype=np.uint64)
    best = tk.sliding_min(ranked, unit.length - unit.k + 1) & _LOW32
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
    own = best[at].astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, total))
    lo = at[first]
    return lo, n, grams[own[first]]


def _digests(data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """(spans, 2): 128 bits of the bytes of each span."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)]), dtype=np.uint64).reshape(-1, 2)


def _frequent_mapper(unit: Unit):
    """Keys and how many records of different content have them, in a task's sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = tk.column_bytes(batch.column(1))
            for first, last in tk.text_chunks(offsets, unit.segment):
                base = offsets[first : last + 1]
                for key, content, *_ in _chunk_records(raw[base[0] : base[-1]], base - base[0], ids[first:last], unit):
                    pairs = np.unique(np.stack([key, content[:, 0]], axis=1), axis=0)
                    keys, held = np.unique(pairs[:, 0], return_counts=True)
                    several = held > 1
                    yield pa.RecordBatch.from_arrays([tk.int64(keys[several]), pa.array(held[several].astype(np.int64))], names=["key", "held"])

    return run


def _frequent(texts: DataFrame, unit: Unit) -> np.ndarray:
    """Keys with more than ``hot_key`` records, going by the sample; the most frequent if there are too many."""
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).select("doc", "text")
    held = some.mapInArrow(_frequent_mapper(unit), "key long, held long").groupBy("key").agg(F.sum("held").alias("held"))
    rows = held.where(F.col("held") * SAMPLED > unit.hot_key).orderBy(F.desc("held"), "key").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64))


def _among(key: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(key), dtype=bool)
    return frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key


def _record_mapper(unit: Unit, buckets: int, frequent: np.ndarray):
    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, content, doc, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place & _LOW32, doc, content[:, 1], content[:, 0], key))
        key, content, doc, place, n = key[order], content[order], doc[order], place[order], n[order]
        repeat = _repeats(key, content, doc, place, unit)
        route = np.where(_among(key, frequent), content[:, 0], key)
        bucket = np.where(repeat, np.arange(len(key)) % buckets, (route % np.uint64(buckets)).astype(np.int64))
        order = np.lexsort((doc, bucket, repeat))
        group = bucket + buckets * repeat
        group = group[order]
        cut = np.flatnonzero(np.diff(group)) + 1
        rows = [[], [], [], [], [], [], []]
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
            sel, kind = order[a:b], int(group[a] >= buckets)
            for row, value in zip(rows, (int(group[a] % buckets), kind, b"" if kind else key[sel].tobytes(), b"" if kind else content[sel].tobytes(), doc[sel].tobytes(), place[sel].tobytes(), n[sel].astype(np.uint16).tobytes()), strict=True):
                row.append(value)
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["bucket", "kind", "key", "content", "doc", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = tk.column_bytes(batch.column(1))
            for first, last in tk.text_chunks(offsets, unit.segment):
                base = offsets[first : last + 1]
                for part in _chunk_records(raw[base[0] : base[-1]], base - base[0], ids[first:last], unit):
                    parts.append(part)
                held += int(base[-1] - base[0])
                if held >= unit.flush:
                    yield from flush(parts)
                    parts, held = [], 0
        yield from flush(parts)

    return run


def _chunk_records(buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, unit: Unit) -> Iterator[tuple[np.ndarray, ...]]:
    tags = np.array([zlib.crc32(buf[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64)
    if unit.words:
        starts, ends, firsts = tk.word_spans(buf, offsets)
        symbols = tk.word_hashes(buf, starts, ends)
        data, starts, ends = tk.joined_words(buf, starts, ends)
    else:
        symbols, firsts = tk.BYTE_CODE[buf] if len(buf) <= 2 * unit.segment else buf, offsets
        data = buf.tobytes()
    step = unit.segment
    for a in range(0, max(1, len(symbols)), step):
        # One pass unless a single text is longer than a segment; then stretches overlap by a window.
        b = min(len(symbols), a + step + unit.length - 1) if len(symbols) > 2 * step else len(symbols)
        piece = symbols[a:b] if symbols.dtype == np.uint64 else tk.BYTE_CODE[symbols[a:b]]
        lo, n, key = records(piece, np.clip(firsts[:-1] - a, 0, len(piece)), np.clip(firsts[1:] - a, 0, len(piece)), unit)
        if len(lo):
            stop = lo + a + n - 1 + unit.length
            content = _digests(data, (starts[lo + a] if unit.words else lo + a).tolist(), (ends[stop - 1] if unit.words else stop).tolist())
            text = np.searchsorted(firsts, lo + a, side="right") - 1
            place = (tags[text] << np.uint64(32)) | (lo + a - firsts[text]).astype(np.uint64)
            yield key, content, ids[text], place, n
        if b == len(symbols):
            break


def _repeats(key: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray, unit: Unit) -> np.ndarray:
    """For records sorted by key, content, document, place: whether each repeats an earlier one whole."""
    if len(content) == 0:
        return np.zeros(0, dtype=bool)
    new = np.ones(len(content), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(content)), 0))
    later = doc > doc[first]
    if unit.within:
        later |= (doc == doc[first]) & ((place & _LOW32) > (place[first] & _LOW32))
    return later


def _resolver(unit: Unit, frequent: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("kind", "key", "content", "doc", "place", "n")}
        open_ = [i for i, kind in enumerate(cols["kind"]) if kind == 0]
        done = [i for i, kind in enumerate(cols["kind"]) if kind == 1]
        read = lambda c, which, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(cols[c][i], dtype=t) for i in which)])
        key, content = read("key", open_, np.uint64), read("content", open_, np.uint64).reshape(-1, 2)
        doc, place, n = read("doc", open_, np.int64), read("place", open_, np.uint64), read("n", open_, np.uint16)
        order = np.lexsort((place & _LOW32, doc, content[:, 1], content[:, 0], key))
        key, content, doc, place, n = key[order], content[order], doc[order], place[order], n[order]
        repeat = _repeats(key, content, doc, place, unit)
        fetch = np.zeros(0, dtype=bool)
        hot = fetch
        if len(key):
            new_key = np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            new_content = new_key.copy()
            new_content[1:] |= (content[1:] != content[:-1]).any(axis=1)
            group = np.cumsum(new_key) - 1
            several = np.bincount(group, weights=new_content)[group] > 1
            if not unit.within:
                at = np.flatnonzero(new_key)
                several &= (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at))[group]
            dealt = _among(key, frequent)
            fetch = ~repeat & (several | dealt)
            hot = dealt | (np.bincount(group, weights=fetch)[group] > unit.hot_key)
        old = (read("doc", done, np.int64), read("place", done, np.uint64), read("n", done, np.uint16))
        out_doc = np.concatenate([doc[repeat], old[0], doc[fetch]])
        out_place = np.concatenate([place[repeat], old[1], place[fetch]])
        out_n = np.concatenate([n[repeat], old[2], n[fetch]])
        runs = len(out_doc) - int(fetch.sum())
        return pa.table(
            {
                "kind": pa.array((np.arange(len(out_doc)) >= runs).astype(np.int32)),
                "doc": tk.int64(out_doc),
                "tag": tk.int64(out_place >> np.uint64(32)),
                "lo": pa.array((out_place & _LOW32).astype(np.int32)),
                "n": pa.array(out_n.astype(np.int32)),
                "key": tk.int64(np.concatenate([np.zeros(runs, np.uint64), key[fetch]])),
                "hot": pa.array(np.concatenate([np.zeros(runs, bool), hot[fetch]])),
            }
        )

    return run


def _content_mapper(unit: Unit, groups: int):
    """Cuts the content of open records out of their texts; hot keys go window by window.

    Of equal windows of hot keys in a batch only the earliest is sent with its content; those
    certainly after it are decided here and go without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, windows = {c: [] for c in ("g", "doc", "tag", "lo", "n", "body")}, {}
            held = 0
            for doc, tag, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, tag, text = doc.as_py(), tag.as_py(), text.as_py()
                flat = wanted.values.flatten()
                lo, n, key, hot = (x.to_numpy(zero_copy_only=False) for x in flat)
                words = text.split() if unit.words else None
                cut = (lambda a, b, w=words: b" ".join(w[a:b])) if unit.words else (lambda a, b, t=text: t[a:b])
                for a, m, k, h in zip(lo.tolist(), n.tolist(), key.tolist(), hot.tolist(), strict=True):
                    for x, count in [(a + i, 1) for i in range(m)] if h else [(a, m)]:
                        body = cut(x, x + count - 1 + unit.length)
                        where, held = k, held + len(body) + 40
                        if h:
                            where = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")
                            body = _earliest(rows, windows, body, doc, x, unit)
                        for c, value in zip(rows, (where % groups if body else x % groups, doc, tag, x, count, body), strict=True):
                            rows[c].append(value)
                if held > unit.flush:
                    yield _body_batch(rows)
                    rows, windows, held = {c: [] for c in rows}, {}, 0
            yield _body_batch(rows)

    return run


def _earliest(rows: dict, windows: dict, body: bytes, doc: int, lo: int, unit: Unit) -> bytes | None:
    """The window's bytes, or None if an equal one before it is already in ``rows``; takes them from one after it."""
    at = windows.setdefault(body, len(rows["doc"]))
    if at == len(rows["doc"]):
        return body
    place = (rows["doc"][at], rows["lo"][at]) if unit.within else rows["doc"][at]
    own = (doc, lo) if unit.within else doc
    if own > place:
        return None
    if own < place:
        rows["body"][at] = None
        windows[body] = len(rows["doc"])
    return body


def _body_batch(rows: dict) -> pa.RecordBatch:
    types = {"g": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "lo": pa.int32(), "n": pa.int32(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in rows.items()], names=list(rows))


def _passing_decided(shard_solver):
    """The solver for records with content; those without are repeats already."""

    def run(table: pa.Table) -> pa.Table:
        given = table.column("body").is_valid()
        decided = table.filter(pc.invert(given)).select(["doc", "tag", "lo", "n"])
        table = table.filter(given)
        return pa.concat_tables([shard_solver(table), decided]) if table.num_rows else decided

    return run


def size_hint(df: DataFrame) -> int:
    """Bytes that the plan's statistics give for its scans; used only to choose partition counts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def repeats(texts: DataFrame, unit: Unit, shard_solver) -> DataFrame:
    """``texts`` (of ``keyed``) with spans array<long>: the starts << 32 | counts of all repeating windows, or null.

    ``shard_solver(table) -> table`` gets the open records of one shard (doc, tag, lo, n, body)
    and returns the runs (doc, tag, lo, n) of their windows that repeat an earlier one.
    """
    spark = texts.sparkSession
    prepare(spark)
    frequent = _frequent(texts, unit)
    buckets = min(1 << 20, max(2 * shuffle_partitions(spark), size_hint(texts) >> 23))
    chunks = texts.select("doc", "text").mapInArrow(_record_mapper(unit, buckets, frequent), _CHUNK)
    resolved = materialize(chunks.groupBy("bucket").applyInArrow(_resolver(unit, frequent), _RESOLVED), "anchors")
    open_ = resolved.where("kind = 1")
    groups = max(2 * shuffle_partitions(spark), open_.count() // 20_000)
    wanted = open_.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n", "key", "hot")).alias("wanted"))
    # All columns of texts go through both joins, so that one shuffle of the texts serves both.
    rest = [c for c in texts.columns if c not in ("doc", "tag", "text")]
    bodies = texts.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted", *rest).mapInArrow(_content_mapper(unit, groups), "g long, doc long, tag long, lo int, n int, body binary")
    solved = bodies.groupBy("g").applyInArrow(_passing_decided(shard_solver), "doc long, tag long, lo int, n int")
    runs = resolved.where("kind = 0").select("doc", "tag", "lo", "n").unionByName(solved)
    place = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    return texts.join(runs.groupBy("doc", "tag").agg(F.collect_list(place).alias("spans")), ["doc", "tag"], "left")


def covered(spans: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window of the packed runs."""
    steps = np.zeros(size + 1, dtype=np.int64)
    lo, n = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(steps, lo, 1)
    np.add.at(steps, np.minimum(lo + n - 1 + length, size), -1)
    return np.cumsum(steps[:-1]) > 0
