"""Approximate nearest neighbours by multiprobe p-stable hashing (Euclidean distance).

Each of ``tables`` tables hashes a vector to m cells floor((a.x + b) / W) of Gaussian
projections.  A query visits its own bucket and the ``probes - 1`` buckets with the best
estimated chance of holding a near neighbour, i.e. the sets of +-1 steps with the least sum of
squared distances to the crossed cell borders.  Every row is indexed.  Rows and probes meet by
bucket hash; buckets over ``BIG`` rows are split into salted parts that every probe of the
bucket visits, so none is cut short.  Candidates of all tables are merged and reranked by exact
distance in double precision.

W is twice the root mean square distance from the mean, on a sample of ``SAMPLE`` rows.  m starts
at 0.45 log2(rows), at which recall falls as tables grow; so the true neighbours of ``JUDGED``
queries are found among all rows, and where the probes would miss more of them than the target
allows, the cheapest of fewer hashes and more probes that meets it is taken, or an exact search if
none does.  Queries whose probes meet fewer than k rows are searched exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.scratch import materialize, shuffle_partitions

SAMPLE = 4096
BIG = 20_000
#: Queries whose true neighbours decide the effort, and queries of one pass of the exact search.
JUDGED = 64
CHUNK = 2048
#: Most probes of a table, as a multiple of those asked for.
MOST = 8
_INDEXED = "key long, vec_id long, vec binary"
_PROBES = "key long, vec_id long, vec binary"


class Family:
    """The hash functions of all tables, drawn from a seed."""

    def __init__(self, dim: int, hashes: int, tables: int, width: float, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.tables, self.hashes, self.width = tables, hashes, width
        self._a = rng.normal(size=(dim, tables * hashes)) / width
        self._b = rng.uniform(0, 1, tables * hashes)
        self._salt = rng.integers(0, 2**64, (tables, hashes), dtype=np.uint64) | np.uint64(1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Cell coordinates, (rows, tables, hashes); a step of 1 crosses one cell."""
        return (x @ self._a + self._b).reshape(len(x), self.tables, self.hashes)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Bucket keys of integer cells (..., tables, hashes)."""
        spread = tk.mix(cells.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * self._salt
        return tk.mix(spread.sum(axis=-1, dtype=np.uint64))


def perturbations(inside: np.ndarray, most: int) -> list[np.ndarray]:
    """Steps (-1, 0, 1 per hash) of the ``most`` likeliest buckets, the query's own first.

    ``inside`` holds the query's positions within its cells, 0 to 1.
    """
    m = len(inside)
    cost = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    ranked = cost[order].tolist()
    out = [np.zeros(m, dtype=np.int64)]
    heap = [(ranked[0], (0,))]
    while heap and len(out) < most:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - ranked[last] + ranked[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + ranked[last + 1], (*chosen, last + 1)))
        which = order[list(chosen)]
        if len(set((which % m).tolist())) == len(which):
            step = np.zeros(m, dtype=np.int64)
            step[which % m] = np.where(which < m, -1, 1)
            out.append(step)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index_mapper(family: Family, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1), dim)
                keys = family.keys(np.floor(family.project(x))).reshape(-1)
                raw = [v.tobytes() for v in x]
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [tk.int64(keys), pa.array(np.repeat(ids, family.tables)), pa.array([r for r in raw for _ in range(family.tables)], pa.binary())], names=["key", "vec_id", "vec"]
                )

    return run


def _probe_mapper(family: Family, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for row, vec_id, where in zip(x, batch.column(0).to_pylist(), family.project(x), strict=True):
                cells = np.floor(where)
                keys = []
                for t in range(family.tables):
                    steps = np.stack(perturbations((where - cells)[t], probes))
                    near = np.repeat(cells[None], len(steps), axis=0)
                    near[:, t] += steps
                    keys.append(family.keys(near)[:, t])
                keys = np.unique(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([tk.int64(keys), pa.array(np.full(len(keys), vec_id)), pa.array([row.tobytes()] * len(keys), pa.binary())], names=["key", "vec_id", "vec"])

    return run


def _exact_mapper(asked: list[tuple[int, bytes]], k: int, dim: int, vectors: bool):
    """The k nearest of a partition's rows for every query of ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array([np.frombuffer(vec, dtype=np.float64) for _, vec in asked]).reshape(-1, dim)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64), np.empty((0, dim)))] * len(q)
        edge = np.full(len(q), np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, ids = _matrix(part.column(1), dim), part.column(0).to_numpy()
                rough = np.square(x).sum(axis=1)[:, None] - 2 * (x @ q.T)
                norm = np.square(q).sum(axis=1)
                limit = np.square(edge) - norm
                limit += 1e-9 * (1 + np.abs(limit) + norm)
                for i in np.flatnonzero(rough.min(axis=0) <= limit).tolist():
                    near = np.flatnonzero((rough[:, i] <= limit[i]) & (ids != asked[i][0]))
                    score, vec_id, vec = np.sqrt(np.square(x[near] - q[i]).sum(axis=1)), ids[near], x[near]
                    score, vec_id, vec = np.append(best[i][0], score), np.append(best[i][1], vec_id), np.concatenate([best[i][2], vec])
                    order = np.lexsort((vec_id, score))
                    _, first = np.unique(vec_id[order], return_index=True)
                    order = order[np.sort(first)[:k]]
                    best[i] = score[order], vec_id[order], vec[order]
                    if len(order) == k:
                        edge[i] = best[i][0][-1]
        for (query_id, _), (score, vec_id, vec) in zip(asked, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), query_id)), pa.array(vec_id), pa.array(score), pa.array([v.tobytes() if vectors else b"" for v in vec], pa.binary())], names=["query_id", "vec_id", "score", "vec"])

    return run


def _exact(base: DataFrame, asked: list[tuple[int, bytes]], k: int, dim: int, vectors: bool = False) -> DataFrame:
    """(query_id, vec_id, score, vec): the k nearest of all rows for each query, by a scan; vec is empty without ``vectors``."""
    found = base.select("vec_id", "vec").mapInArrow(_exact_mapper(asked, k, dim, vectors), "query_id long, vec_id long, score double, vec binary")
    ids = found.groupBy("query_id", "vec_id").agg(F.min_by(F.struct("score", "vec"), "score").alias("b")).select("query_id", "vec_id", "b.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _turns(family: Family, query: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """(others, tables): at which of a query's probes each other row is met, ``most`` if at none."""
    where = family.project(query[None])[0]
    cells = np.floor(where)
    apart = np.floor(family.project(others)) - cells
    out = np.full((len(others), family.tables), most)
    place = 3 ** np.arange(family.hashes)
    for t in range(family.tables):
        codes = (np.stack(perturbations((where - cells)[t], most)) + 1) @ place
        order = np.argsort(codes)
        near = np.flatnonzero((np.abs(apart[:, t]) <= 1).all(axis=1))
        code = (apart[near, t].astype(np.int64) + 1) @ place
        at = np.minimum(np.searchsorted(codes[order], code), len(codes) - 1)
        out[near, t] = np.where(codes[order][at] == code, order[at], most)
    return out


def effort(points: np.ndarray, judged: list[tuple[np.ndarray, np.ndarray]], n: int, tables: int, probes: int, width: float, recall: float) -> tuple[int, int] | None:
    """(hashes, probes) that find ``recall`` of the true neighbours at the least cost; None if nothing does.

    ``judged`` holds queries and the vectors of their true neighbours, ``points`` a sample of rows.
    The scheme's own m and ``probes`` are kept where they suffice; the search only goes up from there.
    """
    start, dim = max(3, round(0.45 * math.log2(max(2, n)))), points.shape[1]
    wanted = sum(len(near) for _, near in judged)

    def found(m: int, most: int) -> list[np.ndarray]:
        family = Family(dim, m, tables, width)
        return [_turns(family, q, near, most) for q, near in judged]

    enough = lambda turns, p: sum(int((x.min(axis=1) < p).sum()) for x in turns) >= recall * wanted
    if enough(found(start, probes), probes):
        return start, probes
    best: tuple[float, tuple[int, int]] | None = None
    for m in range(start, 2, -1):
        turns = found(m, probes * MOST)
        p = next((probes * 2**i for i in range(MOST.bit_length()) if enough(turns, probes * 2**i)), None)
        if p:
            family = Family(dim, m, tables, width)
            visited = np.mean([(_turns(family, q, points, p) < p).sum() for q, _ in judged]) / len(points)
            best = min(best or (math.inf, (m, p)), (visited * n + tables * p, (m, p)))
    return best[1] if best else None


def _reranker(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if index.num_rows and queries.num_rows:
            raw, offsets = tk.column_bytes(index.column("vec"))
            rows = np.frombuffer(raw.tobytes(), dtype=np.float64).reshape(len(offsets) - 1, -1)
            keys, ids = index.column("key").to_numpy(), index.column("vec_id").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, ids, rows = keys[order], ids[order], rows[order]
            norms = np.einsum("ij,ij->i", rows, rows)
            distinct, code = np.unique(ids, return_inverse=True)
            for query_id, vec, wanted in zip(queries.column("query_id").to_pylist(), queries.column("vec").to_pylist(), queries.column("keys").to_pylist(), strict=True):
                q = np.frombuffer(vec, dtype=np.float64)
                wanted = np.array(wanted, dtype=np.int64)
                lo, hi = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
                found = [np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
                if not found:
                    continue
                c = np.concatenate(found)
                c = c[ids[c] != query_id]
                rough = norms[c] - 2 * (rows[c] @ q)
                # An id stands once per table and vector; only rows clearly farther than its k nearest ids are cut before the exact distance.
                least = np.full(len(distinct), np.inf)
                np.minimum.at(least, code[c], rough)
                if len(distinct) > k:
                    edge = np.partition(least, k - 1)[k - 1]
                    if np.isfinite(edge):
                        c = c[rough <= edge + 1e-9 * (1 + abs(edge))]
                score = np.sqrt(np.square(rows[c] - q).sum(axis=1))
                best = np.lexsort((ids[c], score))
                c, score = c[best], score[best]
                _, first = np.unique(ids[c], return_index=True)
                first = np.sort(first)[:k]
                out["query_id"] += [query_id] * len(first)
                out["vec_id"] += ids[c][first].tolist()
                out["score"] += score[first].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part in searches."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, tables: int = 12, probes: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, nearest first.

    ``probes`` is the least number of buckets visited in a table; more are where ``recall``, as
    measured on a sample of the queries against all rows, asks for them.

    ``rows`` and ``queries`` have an id and an array of numbers.  A query's own id is never its
    neighbour; ties go to the smaller id.  Rows whose id or vector is null, whose vector is all
    zero or holds a null or non-finite component, or whose length isn't the most common one of
    the sample take no part on either side.  Of equal vectors only the k + 1 smallest ids can be
    among the k nearest, so only they are indexed; rows repeated under one id count once.  Other
    columns are ignored; if no row takes part the result is empty.
    """
    spark = rows.sparkSession
    base = usable(rows, id_col, vector_col)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    lengths = [len(r["vec"]) for r in sample]
    dim = max(sorted(set(lengths)), key=lengths.count, default=1)
    points = np.array([r["vec"] for r in sample if len(r["vec"]) == dim], dtype=np.float64).reshape(-1, dim)
    spread = float(np.sqrt(np.square(points - points.mean(axis=0)).sum(axis=1).mean())) if len(points) else 1.0
    n = base.count()
    width = 2 * (spread or 1.0)

    base = base.where(F.size("vec") == dim)
    asked = usable(queries, id_col, vector_col).where(F.size("vec") == dim)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    raw = lambda r: (r["vec_id"], np.array(r["vec"], dtype=np.float64).tobytes())

    some = [raw(r) for r in asked.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(JUDGED).collect()]
    truth: dict[int, list] = {}
    for r in _exact(base, some, k, dim, vectors=True).select("query_id", "vec").collect() if some else []:
        truth.setdefault(r["query_id"], []).append(np.frombuffer(r["vec"], dtype=np.float64))
    judged = [(np.frombuffer(vec, dtype=np.float64), np.array(truth[i])) for i, vec in some if i in truth]
    plan = effort(points, judged, n, tables, probes, width, recall)
    if plan is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    else:
        found = _hashed(base, asked, k, n, Family(dim, plan[0], tables, width), plan[1])
    found = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "ann")

    met = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
    short = asked.join(met, asked["vec_id"] == met["query_id"], "left").where(F.coalesce("met", F.lit(0)) < k).select("vec_id", "vec")
    short = materialize(short, "ann-short")
    passes = math.ceil(short.count() / CHUNK)
    for i in range(passes):
        rest = [raw(r) for r in short.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).collect()]
        if rest:
            found = found.unionByName(materialize(_exact(base, rest, k, dim).select("query_id", "vec_id", "score"), "ann-exact"))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _hashed(base: DataFrame, asked: DataFrame, k: int, n: int, family: Family, probes: int) -> DataFrame:
    """(query_id, vec_id, score): rows that share a visited bucket, k at least of each query's nearest if so many do."""
    spark, tables, dim = base.sparkSession, family.tables, family._a.shape[0]
    first = Window.partitionBy("vec").orderBy("vec_id")
    # Repeated rows go first: the k + 1 smallest are counted in ids, not in rows.
    kept = base.dropDuplicates(["vec_id", "vec"]).select("vec_id", "vec", F.row_number().over(first).alias("copy")).where(F.col("copy") <= k + 1).select("vec_id", "vec")

    index = kept.mapInArrow(_index_mapper(family, dim), _INDEXED)
    parts = F.ceil(F.col("n") / BIG).cast("int").alias("parts")
    big = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BIG).select("key", parts)
    groups = max(shuffle_partitions(spark), n * tables // 40_000)
    route = lambda part: F.pmod(F.xxhash64("key", part), F.lit(groups)).alias("route")
    split = F.coalesce("parts", F.lit(1))
    placed = index.join(big, "key", "left").select(route(F.pmod(F.xxhash64("vec_id"), split).cast("long")), "key", "vec_id", "vec")
    probing = asked.mapInArrow(_probe_mapper(family, dim, probes), _PROBES).join(big, "key", "left")
    probing = probing.select("key", F.col("vec_id").alias("query_id"), "vec", F.explode(F.sequence(F.lit(0).cast("long"), (split - 1).cast("long"))).alias("part"))
    probing = probing.select(route(F.col("part")), "query_id", "vec", "key").groupBy("route", "query_id", "vec").agg(F.collect_set("key").alias("keys"))

    found = placed.groupBy("route").cogroup(probing.groupBy("route")).applyInArrow(_reranker(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
