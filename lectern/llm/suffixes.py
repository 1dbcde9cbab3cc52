"""Removal of repeated byte strings by sorting suffixes (deep-shallow).

Candidate windows come from ``anchors``.  In each shard the windows' suffixes are sorted to a
depth of ``length`` bytes: multikey quicksort on eight-byte characters down to ``SHALLOW`` bytes,
then a blind trie for each group whose prefix is still common.  Suffixes with equal windows end
side by side; all but the earliest of them repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.anchors import Unit, covered, keyed, repeats

SHALLOW = 32
_SMALL = 24


class BlindTrie:
    """Patricia trie over the first ``length`` bytes of suffixes; descends by branching bytes alone
    and compares text once per insertion.  Each leaf holds the suffixes whose prefixes are equal."""

    def __init__(self, data: bytes, length: int):
        self._data, self._length, self._root = data, length, None

    def insert(self, at: int) -> None:
        s = self._data[at : at + self._length]
        if self._root is None:
            self._root = [s, [at]]
            return
        node = self._root
        while len(node) == 3:
            child = node[1].get(s[node[0]])
            if child is None:
                node = node[2]
                break
            node = child
        while len(node) == 3:
            node = node[2]
        other = node[0]
        if other == s:
            node[1].append(at)
            return
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = self._length - 1 - (differ.bit_length() - 1) // 8
        above, step, node = None, 0, self._root
        while len(node) == 3 and node[0] < depth:
            above, step = node, s[node[0]]
            node = node[1][step]
        leaf = [s, [at]]
        if len(node) == 3 and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        fork = [depth, {s[depth]: leaf, other[depth]: node}, leaf]
        if above is None:
            self._root = fork
        else:
            above[1][step] = fork

    def groups(self) -> Iterator[list[int]]:
        """The leaves' suffixes, in order of their text."""
        stack = [self._root] if self._root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node[1]


def _deep(data: bytes, group: list[int], length: int) -> Iterator[np.ndarray]:
    """A group with a common shallow prefix, by a blind trie."""
    trie = BlindTrie(data, length)
    for p in group:
        trie.insert(p)
    return (np.array(g) for g in trie.groups())


def equal_groups(data: bytes, at: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Suffix positions in sorted order, grouped by equality of their first ``length`` bytes."""
    shallow = min(SHALLOW, length // 8 * 8)
    padded = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    n = len(data)
    wide = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        wide |= padded[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    stack = [(at, 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            yield group
        elif depth >= shallow:
            yield from _deep(data, group.tolist(), length)
        elif len(group) <= _SMALL:
            # A small group is finished at once down to the shallow depth.
            sorted_ = sorted((data[p : p + shallow], p) for p in group.tolist())
            first = 0
            for i in range(1, len(sorted_) + 1):
                if i == len(sorted_) or sorted_[i][0] != sorted_[first][0]:
                    if i == first + 1:
                        yield np.array([sorted_[first][1]])
                    else:
                        yield from _deep(data, [p for _, p in sorted_[first:i]], length)
                    first = i
        else:
            c = wide[group + depth]
            some = np.sort(c[:: max(1, len(c) // 101)])
            pivot = some[len(some) // 2]
            less, same = c < pivot, c == pivot
            for part, d in ((group[~less & ~same], depth), (group[same], depth + 8), (group[less], depth)):
                if len(part):
                    stack.append((part, d))


def _solver(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lo, n = table.column("lo").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64)
        doc, tag = table.column("doc").to_numpy(), table.column("tag").to_numpy()
        raw, offsets = tk.column_bytes(table.column("body"))
        record = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
        suffix, start = offsets[:-1][record] + inside, lo[record] + inside
        of = np.full(len(raw) + 1, -1, dtype=np.int64)
        of[suffix] = np.arange(len(suffix))
        repeat = np.zeros(len(suffix), dtype=bool)
        for group in equal_groups(raw.tobytes(), suffix, length):
            if len(group) > 1:
                w = of[group]
                d = doc[record[w]]
                earliest = d.min()
                repeat[w] = (d > earliest) | (start[w] > start[w][d == earliest].min())
        w = np.flatnonzero(repeat)
        if len(w):
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1] + 1) | (record[w[1:]] != record[w[:-1]])
            first = w[new]
            count = np.diff(np.append(np.flatnonzero(new), len(w)))
        else:
            first = count = np.zeros(0, dtype=np.int64)
        return pa.table({"doc": doc[record[first]], "tag": tag[record[first]], "lo": start[first].astype(np.int32), "n": count.astype(np.int32)})

    return run


def _remover(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, starts, ends = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                if not spans.is_valid:
                    kept.append(text)
                    starts.append([])
                    ends.append([])
                    continue
                gone = covered(spans.values.to_numpy(), length, len(text))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                starts.append(edge[::2].tolist())
                ends.append(edge[1::2].tolist())
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(t.as_py()) for t in batch.column(2)], pa.int64()),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array(kept, pa.binary()),
                    pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                    *batch.columns[4:],
                ],
                names=["doc", "tag", "n_bytes", "starts", "ends", "kept", "kept_text", *batch.schema.names[4:]],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, tag, n_bytes, starts, ends, kept, kept_text): per row the removed byte runs and what is left.

    kept_text leaves out the bytes of letters that were cut apart; ``carry`` names columns to
    return in a struct ``carried``, with whether there was a text in ``had_text``.

    A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a smaller
    doc_id, or earlier in the same document.  All strings are judged on the input.  Null text
    counts as empty; texts shorter than ``length`` stay whole.  A null doc_id comes after all
    others (all null ids are one document).  Repeated rows with one doc_id neither remove nor
    spare each other, since neither starts earlier.  Other columns are ignored; an empty table
    gives an empty result.
    """
    unit = Unit(words=False, length=length, k=max(1, length // 4), within=True)
    joined = repeats(keyed(docs, id_col, text_col, carry), unit, _solver(length))
    more = ["carried", "had_text"] if carry else []
    schema = "doc long, tag long, n_bytes long, starts array<int>, ends array<int>, kept binary, kept_text string"
    if carry:
        schema += ", carried " + joined.schema["carried"].dataType.simpleString() + ", had_text boolean"
    return joined.select("doc", "tag", "text", "spans", *more).mapInArrow(_remover(length), schema)


def report(removed: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeated_bytes``."""
    from lectern.llm.anchors import LAST

    return removed.select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
