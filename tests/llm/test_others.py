"""Language ID, search, archives, mixing, token counts, decontamination, chat, pipeline."""

import base64
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import ann, chat, decontaminate, langid, mixing, pipeline, queries, tokens, warc
from tests.compare import duck, same
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql_twin(name, spark, sf):
    same(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name])


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# --- language ID ---


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_of_odd_texts(spark, sf):
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = docs_of(spark, [(1, None, None, None, 0), (2, "", None, None, 0), (3, "12 %", "en", None, 0), (None, "Ω", None, None, 0), (5, "the and of " * 40000, None, None, 0)])
    out = {r.doc_id: r for r in langid.predict(rows, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(out[i].score == 0 and out[i].rejected for i in (1, 2, 3))
    assert out[5].lang_pred == "en" and out[None].lang_pred in model.languages
    empty = langid.train(rows.where("false"))
    assert {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(rows, empty).collect()} == {(1, "und", True), (2, "und", True), (3, "und", True), (None, "und", False), (5, "und", False)}
    assert [r.doc_id for r in langid.keep_known(rows, model).where("doc_id = 5 OR doc_id = 1").collect()] == [5]


def test_predictions_equal_a_plain_nearest_centroid(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").orderBy("doc_id").limit(25).collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for (doc, _), cosines in zip(rows, brute.nearest_centroids([t for _, t in rows], model, langid.DIM), strict=True):
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[doc][0] == model.languages[model.owner[best]] and abs(got[doc][1] - cosines[best]) < 1e-4


def test_letters_are_those_of_the_category(spark, sf):
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = ["²", "½ ① Ⅷ", "a", "ª", "文", "_1"]
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    assert [out[i] == "und" for i in range(6)] == [True, True, False, False, False, True]


def test_short_clean_texts_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    first = docs.where("lang IS NOT NULL AND length(text) > 60").select("doc_id", F.substring_index("text", " ", 3).alias("text"), "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    out = langid.predict(first, model)
    assert out.where("rejected").count() <= 0.03 * out.count()
    junk = docs_of(spark, [(1, "ｗ＃Ωжф ЖЩЪ ѩѪѫ ⴀⴁⴂ " * 30, None, None, 0)])
    assert langid.predict(junk, model).first().rejected


# --- nearest neighbours ---


def exact(ids, vectors, query, k=10):
    d = np.sqrt(np.square(vectors - vectors[ids == query][0]).sum(axis=1))
    d[ids == query] = np.inf
    return [(int(i), float(x)) for i, x in sorted(zip(ids, d, strict=True), key=lambda p: (p[1], p[0]))[:k]]


def test_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    local = rows.toPandas()
    ids, vectors = local.vec_id.to_numpy(), np.stack(local.embedding.to_numpy()).astype(float)
    got = defaultdict(list)
    for r in queries.op5_multiprobe_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0].tolist():
        want = exact(ids, vectors, q)
        hits += len({v for v, _ in want} & {v for v, _ in got[q]})
        truth = dict(exact(ids, vectors, q, len(ids)))
        assert all(abs(truth[v] - s) < 1e-12 for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hits / (10 * len(got)) >= 0.9


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [0.9, 0.1]), (None, [1.0, 0.0]), (100, [2.0, 0.0]), (8, [0.9, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))
    out = ann.nearest(frame, frame.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(frame.where("false"), frame).count() == 0


def test_big_buckets_are_split_not_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "BIG", 5)
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 4)) * 0.01 + 1
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(frame, frame.where("vec_id % 100 = 0")).collect()}
    want = {(q, v) for q in (0, 100, 200) for v, _ in exact(np.arange(300), points, q)}
    assert len(got & want) >= 27


def test_repeated_rows_do_not_push_out_neighbours(spark):
    rows = [(1, [1.0, 1.0])] * 11 + [(i, [1.0, 1.0]) for i in range(2, 11)] + [(0, [1.0, 1.1])] + [(i, [5.0, 5.0 + i]) for i in range(11, 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(frame, frame.where("vec_id = 0")).orderBy("rank").collect()] == list(range(1, 11))
    twice = frame.where("vec_id < 11 AND vec_id > 0").distinct()
    out = ann.nearest(twice.union(twice), twice.where("vec_id = 5"), k=4).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 2, 3, 4]


def test_rough_cut_counts_ids_not_rows():
    near = [(1, [0.001 * i, 0.0]) for i in range(500)] + [(i, [1.0, float(i)]) for i in range(2, 6)]
    index = pa.table({"key": [7] * len(near), "vec_id": [i for i, _ in near], "vec": [np.array(v).tobytes() for _, v in near]})
    asked = pa.table({"query_id": [9], "vec": [np.zeros(2).tobytes()], "keys": [[7]]})
    assert ann._reranker(3)(index, asked)["vec_id"].to_pylist() == [1, 2, 3]


def test_recall_holds_where_the_fixed_effort_would_miss(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2000, 16)) * np.where(np.arange(2000) % 20 == 0, 10, 1)[:, None]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(frame, frame.where("vec_id % 20 = 0")).collect()}
    want = {(q, v) for q in range(0, 2000, 20) for v, _ in exact(np.arange(2000), points, q)}
    assert len(got) == 1000 and len(got & want) >= 900


def test_queries_that_meet_too_few_rows_are_searched_exactly(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(300, 4))
    points[0], points[100] = 500, -800
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in ann.nearest(frame, frame.where("vec_id IN (0, 100)")).orderBy("query_id", "rank").collect()]
    assert got == [(q, v) for q in (0, 100) for v, _ in exact(np.arange(300), points, q)]


def test_effort_reaches_the_target_at_the_actual_size():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(1000, 32)) / 32**0.5
    steps = rng.normal(size=(40, 10, 32))
    near = points[:40, None] + steps / np.linalg.norm(steps, axis=2, keepdims=True) * 1.2
    judged = list(zip(points[:40], near, strict=True))
    share = lambda m, p: np.mean([(ann._turns(ann.Family(32, m, 12, 2.0), q, x, p).min(axis=1) < p).mean() for q, x in judged])
    assert share(11, 32) < 0.5
    assert share(*ann.effort(points, judged, 30_000_000, 12, 32, 2.0, 0.95)) >= 0.95
    assert ann.effort(points, judged, 500, 12, 32, 2.0, 0.95) == (4, 32)
    assert ann.effort(points, [(points[0], points[:1] + 50)], 500, 12, 32, 2.0, 0.95) is None


def test_perturbations_come_in_order_of_distance():
    inside = np.array([0.1, 0.6, 0.45])
    steps = ann.perturbations(inside, 12)
    cost = [sum((f if s < 0 else 1 - f) ** 2 for f, s in zip(inside, x, strict=True) if s) for x in steps]
    assert cost == sorted(cost) and len({tuple(s) for s in steps}) == 12 and not steps[0].any()


# --- archives ---


def test_archives_round_trip(spark, sf):
    odd = [(3, "http://a b/\n", "<p>é"), (1, None, "<p>é"), (4, "u", None), (5, "u", ""), (2, "", "x" * 100000), (None, "u", "<p>é"), (None, "v", "zz"), (1, None, "<p>é"), (9, "u", "a\r\n\r\nb")]
    table = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for rows in (odd, table, []):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
        index, folder = warc.write_archives(frame)
        out = warc.read_records(index, folder).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == brute.warc(rows)
        texts = defaultdict(set)
        for page, _, html in rows:
            texts[page].add((html or "").encode())
        assert all(bytes(r.payload) in texts[r.page_id] for r in out if r.record_type == "response")


def test_selected_ranges_are_merged(spark, sf, monkeypatch):
    index, folder = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"))
    monkeypatch.setattr(warc, "READ", 1 << 16)
    size = index.agg(F.sum("length")).first()[0]
    assert warc.read_records(index, folder).rdd.getNumPartitions() == max(-(-size // (1 << 16)), min(4, -(-size // (1 << 12))))
    assert {r.page_id for r in warc.read_records(index, folder, F.col("page_id") < 7).collect()} == set(range(7))
    assert warc.coalesce([(0, 5), (5, 5), (100, 1)], gap=10) == [[(0, 5), (5, 5)], [(100, 1)]]
    raw, digest = warc.encode_record(1, "u", b"abc", None, False)
    assert warc.decode_record(raw)["payload_digest"] == digest
    with pytest.raises(ValueError, match="WARC"):
        warc.decode_record(b"".join([__import__("gzip").compress(b"junk")]))


# --- mixing ---


def test_targets_and_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs_of(spark, [(10**6, None, "en", None, 0), (10**6 + 1, "a b c", "en", None, 0), (10**6 + 1, "a b c", "en", None, 0), (None, "x y", "en", "src0", 0), (10**6 + 2, "", None, "zz", 0)])
    both = docs.unionByName(odd)
    out = mixing.mix(both).join(both.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = brute.water_fill(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(both).groupBy("doc_id").agg(F.sum("taken").alias("t"))
    assert again.exceptAll(mixing.mix(both).groupBy("doc_id").agg(F.sum("taken").alias("t"))).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0


# --- token counts ---


def test_ledger_equals_a_recount_and_is_idempotent(spark, sf):
    count = tokens.byte_bpe(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", "byte_bpe_50k").counter()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        label = labels.get(r.doc_id)
        if label and label.toxic == 1:
            continue
        text = re.sub("  +", " ", r.text.strip(" "))
        for version, n in (("words-1", len(text.encode().split())), ("byte_bpe_50k", count(text.encode()))):
            cell = want["low-quality" if label and label.quality == 0 else r.source, r.lang, version]
            cell[0] += 1
            cell[1] += len(text)
            cell[2] += n
    got = {(r.source, r.lang, r.version): [r.docs, r.n_chars, r.tokens] for r in queries.op8_token_counts(spark, sf).collect()}
    assert got == dict(want)


def test_ledger_of_odd_changes(spark):
    ledger = tokens.Ledger(spark, (tokens.Tokenizer(tokens.WORDS),))
    change = lambda *rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, op string").withColumn("tokens", F.lit(9))
    assert ledger.commit("a", change((1, "s", "en", "a b", "upsert"), (1, "s", "en", "a b c", "upsert"), (2, None, None, None, "upsert"), (None, "s", "en", "x", "upsert"), (7, "s", "en", None, "delete")))
    assert not ledger.commit("a", change((1, "s", "en", "zzz", "upsert")))
    assert ledger.commit("b", change((1, "s", "en", "a b c d", "upsert"), (2, None, None, None, "delete"), (9, "s", None, None, "move"), (None, "t", None, None, "move")))
    assert ledger.commit("c", change().where("false"))
    assert {(r.source, r.lang, r.docs, r.tokens) for r in ledger.totals().collect()} == {("s", "en", 1, 4), ("t", "en", 1, 1)}
    assert {(r.doc_id, r.tokens) for r in ledger.balances().collect()} == {(1, 4), (None, 1)}
    with pytest.raises(ValueError, match="folder"):
        ledger.commit("x/y", change().where("false"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lectern.llm import scratch

    no_folder = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: no_folder)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


# --- decontamination ---


def test_leaks_equal_a_plain_search(spark, sf):
    norm = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", t.lower()).split()
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    grams = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in items.items()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = norm(r.text)
        have = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        want |= {(r.doc_id, i) for i, g in grams.items() if len(g & have) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()}
    assert got == want and want


@pytest.mark.parametrize("part", [1 << 22, 2000])
def test_leaks_and_scores_equal_a_plain_bm25(spark, sf, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART", part)
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split()

    def item(text):
        own = words(text)
        last = [words(x) for x in re.split(r"(?<=[.?!])\s+", text.strip()) if words(x)]
        answer = min(max(len(last[-1]) if len(last) > 1 else len(own) // 3, 3), max(1, len(own) // 2))
        return own, len(own) - answer

    want = brute.bm25_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 32, decontaminate.K1, decontaminate.B, decontaminate.THRESHOLD, decontaminate.OVERLAP, words, item)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == set(want) and want
    assert all(abs(got[pair] - want[pair]) < 1e-4 for pair in want)


def test_leaks_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 2)
    question = "What is the capital city of the small far country of Ruritania? It is surely Strelsau on the river."
    bench = spark.createDataFrame([(1, question), (2, None), (3, "the"), (4, question), (5, "other words of no use at all in here, I think. Yes they are so.")], "item_id long, text string")
    rows = [(1, "Some text. " * 300 + question.upper().replace(" ", "\n") + " more text" * 300, "en", None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (None, question, None, None, 0), (5, "What is the capital city of the small far country of Ruritania?", None, None, 0), (6, "x " * 100000, None, None, 0)]
    docs = docs_of(spark, rows)
    out = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (1, 4), (None, 1), (None, 4)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3, 5, 6]
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_leaks_of_short_and_unspaced_items(spark):
    chinese, thai = "卢里塔尼亚王国的首都叫什么名字？它当然是河边的斯特雷尔绍。", "เมืองหลวงของรูริทาเนียคือสเตรลเซา"
    bench = spark.createDataFrame([(1, chinese), (2, "Capital of Ruritania"), (3, thai), (4, "卢里")], "item_id long, text string")
    texts = ["前文很长。" * 50 + chinese + "后文也很长。" * 50, "the CAPITAL\nof Ruritania, again", "Ruritania capital of", "x" + thai, "卢里塔尼亚王国在哪里", "前文很长。" * 50]
    docs = docs_of(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (0, 4), (1, 2), (3, 3), (4, 4)}


def test_scores_do_not_depend_on_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(15, 40)))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [(i, " ".join(t.split()[1:]), None, None, 0) for i, t in items])
    once = {(r.doc_id, r.item_id, round(r.score, 5)) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "PART", 1000)
    assert once and {(r.doc_id, r.item_id, round(r.score, 5)) for r in decontaminate.contaminated(docs, bench).collect()} == once


def test_block_bounds_are_never_below_scores():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 400, (40, 30)).astype(np.uint64)
    index = decontaminate.Index([decontaminate.Item(i, w, 20) for i, w in enumerate(words)])
    for shard in index.shards:
        blocks = np.repeat(shard.most, decontaminate.BLOCK, axis=1)[:, : shard.impact.shape[1]]
        assert (blocks >= shard.impact).all() and np.allclose(shard.impact.sum(axis=0), 1, atol=1e-5)


# --- chat ---


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (5, 0, "user", ""), (6, 5, None, "<|im_end|>"), (None, 0, "user", "z"), (7, 0, "user", "z"), (8, 0, "user", "a"), (8, None, "assistant", "c"), (9, 0, "user", "q"), (9, 0, "user", "q"), (10, 0, "a<|im_end|>\nb", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    out = {r.conv_id: (r.n_turns, r.rendered) for r in chat.maximal_conversations(frame).collect()}
    assert set(out) == {2, 4, 5, 6, 7, 8, 9, 10}
    assert out[2] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert out[10][1] == "<|im_start|>a<| im_end |> b\nr<|im_end|>\n"
    assert out[6][1] == "<|im_start|>\n<| im_end |><|im_end|>\n" and out[9][0] == 2
    assert chat.maximal_conversations(frame.where("false")).count() == 0


# --- pipeline ---


def test_pipeline_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = stages["minhash_near_dedup"](spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute.near_duplicates(rows.items(), 5, 80).items() if c == d}
    cut = {r.doc_id: r for r in stages["suffix_array_dedup"](spark, docs, sf).collect()}
    assert set(cut) == set(rows) and all(r.n_chars == len(r.text) for r in cut.values())
    gone = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, sf).collect()} == set(rows) - gone
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) > 150 and {r.doc_id for r in out} <= set(rows)


def test_stages_take_odd_documents(spark, sf):
    odd = [(1, None, None, None, None), (None, "the and of they", None, None, 3), (None, "the and of they are", "en", "s", 3), (2, "", "en", "s", 0), (3, "the words of a text " * 20, None, "s", 9), (3, "the words of a text " * 20, None, "s", 9)]
    docs = docs_of(spark, odd).withColumns({"rejected": F.lit(True), "component_id": F.lit(5), "_null": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.where("text LIKE 'the and%'").count() == 2, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    assert pipeline.mixed(spark, docs, sf).count() == 6


def test_warc_digest_is_base32():
    assert warc.encode_record(1, "u", b"", None, False)[1] == base64.b32encode(__import__("hashlib").sha1(b"").digest()).decode()
