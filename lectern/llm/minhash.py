"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One Arrow pass per document: distinct word shingles, ``bands * rows`` minima, a hash per
   band, and the low ``BITS`` bits of every minimum packed into bit planes.
2. Documents with equal shingle sets collapse into one class (its smallest doc_id stands for it).
3. Classes that share a band bucket are candidates.  Each class is first compared with one hub,
   the class among its buckets that shares most buckets with others (the centre of a group of
   copies), and components of confirmed links are found.  A group of n copies thus costs n
   comparisons.
4. Before texts move, a candidate must pass the b-bit estimate: with m of K packed values equal,
   J = (m/K - 2^-b) / (1 - 2^-b), held against the threshold less ``SLACK``.
5. Surviving pairs are confirmed on the whole sets.
6. Classes whose buckets still hold several components are compared across components where
   their prefixes meet: of a set of n shingles, ordered from the rarest, any set similar enough
   shares one of the first n - ceil(t n) + 1.  So no link that could join two components is
   skipped, and classes with too many shingles of their own pair with nothing.

With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability 5e-8, and a
pair at 0.85 with 5e-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.components import connected_components
from lectern.llm.scratch import Tables, materialize, prepare
from lectern.llm.skew import spread_join, weigh

BANDS, ROWS, BITS = 32, 4, 2
#: Six standard deviations of the estimate at similarity 0.8 and 128 values.
SLACK = 0.28
#: Tokens that more than so many open sets have are ordered by a list sent with the tasks, of at most so many.
LEAST_FREQUENT, MOST_FREQUENT = 16, 100_000
_K = BANDS * ROWS
_PLANES = BITS * _K // 64
_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 2**32, _K, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, _K, dtype=np.uint32)
_SIGNATURE = "id long, n_shingles long, set_hash binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(_PLANES))


def _shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes per text: k consecutive words, or the whole text if it has fewer."""
    starts, ends, firsts = tk.word_spans(buf, offsets)
    words = tk.word_hashes(buf, starts, ends)
    spans = tk.Spans(words)
    runs = spans.windows(k)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(tk.distinct(runs[a : b - k + 1]))
        elif b > a:
            out.append(spans.hash(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _minima(values: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(_K, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        block = x[None, i : i + 4096] * _MUL[:, None]
        block += _ADD[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def _signature_mapper(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.column_bytes(batch.column(1))
            for first, last in tk.text_chunks(offsets, 512 << 10):
                base = offsets[first : last + 1]
                sets = _shingle_sets(tk.lower_ascii(raw[base[0] : base[-1]]), base - base[0], k)
                low = np.stack([_minima(s) for s in sets])
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                rows = tk.Spans(low.reshape(-1).astype(np.uint64))
                at = np.arange(len(sets) * BANDS, dtype=np.int64) * ROWS
                bands = tk.mix(rows.hash(at, at + ROWS) + np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), len(sets)) * np.uint64(0x9E3779B97F4A7C15))
                planes = [np.packbits(((low >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1).reshape(len(sets), -1) for b in range(BITS)]
                packed = np.concatenate(planes, axis=1).copy().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(hashes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), tk.int64(bands)),
                        *(pa.array(packed[:, i]) for i in range(_PLANES)),
                    ],
                    names=["id", "n_shingles", "set_hash", "bands", *(f"s{i}" for i in range(_PLANES))],
                )

    return run


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: set size, set fingerprint, band hashes, packed low bits of the minima."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_signature_mapper(shingle), _SIGNATURE)


def estimate(a: str, b: str) -> F.Column:
    """Collision-corrected similarity of the packed signatures held in columns a0.. and b0..."""
    per_plane = _PLANES // BITS
    differing = None
    for word in range(per_plane):
        diff = None
        for bit in range(BITS):
            x = F.col(f"{a}{bit * per_plane + word}").bitwiseXOR(F.col(f"{b}{bit * per_plane + word}"))
            diff = x if diff is None else diff.bitwiseOR(x)
        n = F.bit_count(diff)
        differing = n if differing is None else differing + n
    agree = 1.0 - differing / F.lit(float(_K))
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def _confirm_mapper(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                one, other = one.as_py() or b"", other.as_py() or b""
                if one != known[0]:
                    known = (one, _one_set(one, k))
                mine = _one_set(other, k)
                shared = len(np.intersect1d(known[1], mine, assume_unique=True))
                union = len(known[1]) + len(mine) - shared
                keep.append(shared > 0 and 100 * shared >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _one_set(text: bytes, k: int) -> np.ndarray:
    return _shingle_sets(np.frombuffer(text.lower(), dtype=np.uint8), np.array([0, len(text)]), k)[0]


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int, tables: Tables) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough.  v is the side with hot values."""
    held = tables.write(weigh(pairs, "v"), "held")
    left = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("u_text")), "u")
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("v_text")).join(held.select("v"), "v", "left_semi")
    both = spread_join(left, right, held, "v", "u")
    return both.select("u", "v", "v_text", "u_text").mapInArrow(_confirm_mapper(k, percent), "u long, v long")


def _token_mapper(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tk.column_bytes(batch.column(2))
            for first, last in tk.text_chunks(offsets, 512 << 10):
                base = offsets[first : last + 1]
                sets = _shingle_sets(tk.lower_ascii(raw[base[0] : base[-1]]), base - base[0], k)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), tk.int64(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), lists], names=["node", "component", "tokens"])

    return run


def _order_mapper(frequent: np.ndarray, percent: int):
    """A node's tokens without the frequent ones, and those frequent ones that its prefix reaches.

    ``frequent`` is in the order of all tokens, rarest first; no other token comes after one of them.
    """
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rare, last = [], [], []
            for tokens in batch.column(2):
                tokens = tokens.values.to_numpy()
                at = np.searchsorted(values, tokens)
                known = np.zeros(len(tokens), dtype=bool)
                known[at < len(values)] = values[at[at < len(values)]] == tokens[at < len(values)]
                reach = len(tokens) - -(-len(tokens) * percent // 100) + 1 - int((~known).sum())
                sizes.append(len(tokens))
                rare.append(tokens[~known])
                last.append(frequent[np.sort(by_value[at[known]])[: max(0, reach)]])
            listed = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), listed(rare), listed(last)], names=["node", "component", "n", "rare", "last"])

    return run


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, reps: DataFrame, k: int, percent: int, least: float, tables: Tables) -> DataFrame:
    """Pairs (u, v) of nodes in different components whose rarest shingles meet."""
    planes = [f"s{i}" for i in range(_PLANES)]
    whole = nodes.join(texts.withColumnRenamed("id", "node"), "node").select("node", "component", "text")
    sets = tables.write(whole.mapInArrow(_token_mapper(k), "node long, component long, tokens array<long>"), "open-sets")
    tokens = sets.select(F.explode("tokens").alias("token"))
    common = tables.write(weigh(tokens, "token").where("weight > 1"), "common")
    total = sets.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
    # A token is frequent if it has more than one in MOST_FREQUENT of all tokens, so there are no more of them.
    is_frequent = F.col("weight") > max(LEAST_FREQUENT, total // MOST_FREQUENT)
    frequent = sorted((r["weight"], r["token"]) for r in common.where(is_frequent).collect())
    parts = sets.mapInArrow(_order_mapper(np.array([t for _, t in frequent], dtype=np.int64), percent), "node long, component long, n long, rare array<long>, last array<long>")
    parts = tables.write(parts, "open-tokens")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    rare = parts.select("node", "component", "n", F.size("rare").alias("rares"), F.explode("rare").alias("token"))
    shared = rare.join(common.where(~is_frequent).withColumnRenamed("weight", "held"), "token")
    by_node = Window.partitionBy("node", "component", "n")
    own = F.col("rares") - F.count(F.lit(1)).over(by_node)
    ranked = shared.select("*", (own + F.row_number().over(by_node.orderBy("held", "token"))).alias("at"), prefix.alias("prefix")).where("at <= prefix")
    last = parts.select("node", "component", "n", F.size("rare").alias("rares"), F.posexplode("last").alias("nth", "token")).withColumn("at", F.col("rares") + F.col("nth") + 1)
    columns = ["token", "node", "component", "n", (F.col("n") - F.col("at") + 1).alias("left")]
    rows = tables.write(ranked.select(*columns).unionByName(last.select(*columns)), "prefixes")
    tables.drop(parts)
    tables.drop(sets, common)
    mixed = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("weight")).where("x <> y").select("token", "weight")
    mixed = tables.write(mixed, "mixed-tokens")
    rows = spread_join(rows, mixed.select("token"), mixed, "token", "node").join(reps.select("node", *planes), "node")
    a = rows.select(F.col("token").alias("t"), F.col("node").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("left").alias("mu"), *(F.col(p).alias(f"a{i}") for i, p in enumerate(planes)))
    b = rows.select("token", F.col("node").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("left").alias("mv"), *(F.col(p).alias(f"b{i}") for i, p in enumerate(planes)))
    # Similar sets share at least t / (1 + t) of their sizes' sum, and at their first common shingle
    # no more than what either still has from there on.
    reach = F.expr(f"{percent} * (nu + nv) <= {100 + percent} * least(mu, mv)")
    met = a.join(b, (a.t == b.token) & (a.u > b.v) & (a.cu != b.cv) & reach & (estimate("a", "b") >= least))
    return met.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's (doc_id, n_shingles, component_id, kept), as a written table.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of lower-cased
    (A-Z) word shingles.  component_id is the least doc_id reachable by links, the document's own
    included; kept says whether the document is that one.

    Null or wordless text has the empty set, links to nothing and is its own component.  Exact
    repeats of a row give one output row each, all with the same component.  Rows that share a
    doc_id are one document as far as links go.  A null doc_id takes part only through equal sets
    and never stands for a component unless all of them are null.  Other columns are ignored.
    An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    with Tables(docs.sparkSession) as tables:
        return materialize(_components(docs, shingle, percent, id_col, text_col, tables), "near-duplicates")


def _components(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, tables: Tables) -> DataFrame:
    sig = tables.write(signatures(docs, shingle, id_col, text_col), "minhash")
    classes = sig.where("n_shingles > 0").groupBy("set_hash").agg(F.min("id").alias("node")).where("node IS NOT NULL")
    classes = tables.write(classes, "classes")
    planes = [f"s{i}" for i in range(_PLANES)]
    reps = sig.join(classes, (sig.id == classes.node) & (sig.set_hash == classes.set_hash), "left_semi").dropDuplicates(["id", "set_hash"])
    reps = tables.write(reps.select(F.col("id").alias("node"), "bands", *planes), "representatives")
    slim = tables.write(sig.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hash")).alias("set_hash")), "sizes")
    tables.drop(sig)

    banded = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = tables.write(weigh(banded, "bucket").where("weight > 1"), "bucket-sizes")
    shared = tables.write(spread_join(banded, sizes.withColumnRenamed("weight", "size"), sizes, "bucket", "node"), "buckets")
    central = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    placed = tables.write(shared.select("bucket", "node").join(central, "node"), "placed")
    hubs = placed.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("hub"))
    best = spread_join(placed.select("bucket", "node"), hubs, sizes, "bucket", "node").groupBy(F.col("node").alias("u")).agg(F.min("hub").alias("hub"))
    stars = tables.write(best.select("u", F.col("hub.node").alias("v")).where("u <> v"), "hubs")
    tables.drop(placed)

    bits_u = reps.select(F.col("node").alias("u"), *(F.col(p).alias(f"a{i}") for i, p in enumerate(planes)))
    bits_v = reps.select(F.col("node").alias("v"), *(F.col(p).alias(f"b{i}") for i, p in enumerate(planes)))
    least = percent / 100 - SLACK
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    held = tables.write(weigh(stars, "v"), "held")
    stars = spread_join(stars.join(bits_u, "u"), bits_v, held, "v", "u").where(estimate("a", "b") >= least).select("u", "v")
    stars = tables.write(stars, "likely")
    stars = tables.write(_confirm(stars, texts, shingle, percent, tables).distinct(), "stars")
    first = connected_components(stars, keep=tables)

    spread = shared.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    spread = tables.write(spread, "spread")
    tables.drop(shared)
    mixed = spread.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    open_nodes = tables.write(spread_join(spread, mixed, sizes, "bucket", "node").select("node", "component").distinct(), "open")
    tables.drop(spread)
    crossing = tables.write(_prefix_pairs(open_nodes, texts, reps, shingle, percent, least, tables), "crossing")
    links = tables.write(_confirm(crossing, texts, shingle, percent, tables).distinct(), "links")
    comp = first.select(F.col("node").alias("n"), "component")
    joined = links.join(comp.withColumnRenamed("n", "u").withColumnRenamed("component", "cu"), "u", "left").join(comp.withColumnRenamed("n", "v").withColumnRenamed("component", "cv"), "v", "left")
    second = connected_components(joined.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), keep=tables)

    node = classes.join(first, "node", "left").select("set_hash", F.coalesce("component", "node").alias("mid"))
    final = node.join(second.withColumnRenamed("node", "mid").withColumnRenamed("component", "top"), "mid", "left").select("set_hash", F.coalesce("top", "mid").alias("component_id"))
    members = tables.write(weigh(slim.where("set_hash IS NOT NULL"), "set_hash"), "members")
    out = spread_join(slim, final, members, "set_hash", "id", "left")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
