"""Near-duplicate, suffix-array and FM-index removal against brute force, with hostile rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import anchors, components, fmindex, minhash, suffixes
from lectern.llm import textkit as tk
from tests.llm import brute

DOCS = "doc_id long, text string, tag string, node long, kept boolean"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", 1, True) for d, t in rows], DOCS)


def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_the_table(spark, sf, shingle, percent):
    docs, rows = documents(spark, sf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle, percent).collect()}
    assert got == brute.near_duplicates(rows, shingle, percent)


def test_near_duplicates_of_copies_around_a_centre(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, f"alone {i} b c d e f") for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)


@pytest.mark.parametrize("frequent", [2, 16])
def test_near_duplicates_among_texts_with_a_common_passage(spark, monkeypatch, frequent):
    monkeypatch.setattr(minhash, "LEAST_FREQUENT", frequent)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 60))]
        rows.append((3 * i, " ".join([*own, *passage])))
        for copy in (1, 2):
            if rng.random() < 0.3:
                changed = [w if rng.random() < 0.97 else f"z{rng.randrange(10**6)}" for w in [*own, *passage]]
                rows.append((3 * i + copy, " ".join(changed)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One two"), (8, "one\tTWO"), (7, "one"), (6, "É a b"), (2, "é a b"), (9, "One two"), (None, "one two"), (1, "x " * 30000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()), key=repr)
    assert got == sorted([(5, 0, 5, True), (4, 0, 4, True), (3, 0, 3, True), (9, 1, 8, False), (8, 1, 8, True), (7, 1, 7, True), (6, 1, 6, True), (2, 1, 2, True), (9, 1, 8, False), (None, 1, 8, False), (1, 1, 1, True)], key=repr)
    assert minhash.near_duplicates(frame(spark, []), 3, 85).count() == 0


def test_packed_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a = np.concatenate([shared, rng.integers(0, 2**63, 100, dtype=np.uint64)])
    b = np.concatenate([shared, rng.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = minhash._minima(a), minhash._minima(b)
    agree = np.mean((x & 3) == (y & 3))
    assert abs((agree - 0.25) / 0.75 - 900 / 1100) < minhash.SLACK / 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 120)}, 200: 100}


def hostile(rng, alphabet, join):
    base = [rng.choice(alphabet) for _ in range(400)]
    return [(5, join(base)), (3, join(base[100:250])), (3, join(base[100:250])), (7, None), (8, ""), (9, join(alphabet[:1] * 300)), (2, join(alphabet[:1] * 120)), (None, join(base[:140])), (None, join(base[50:200])), (11, join(alphabet[:2] * 120 + base[200:320])), (12, join([*base[:200], "Q", *base[201:]])), (13, join(base[:99])), (14, join(base[:100])), (20, join(base * 3))]


def removed_bytes(spark, rows):
    out = suffixes.report(suffixes.remove_repeated_bytes(frame(spark, rows))).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr)


def removed_words(spark, rows):
    out = fmindex.report(fmindex.remove_repeated_words(frame(spark, rows))).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=repr)


@pytest.mark.parametrize("limits", [{}, {"hot_key": 2, "segment": 300, "flush": 1000}])
def test_repeated_bytes_of_hostile_rows(spark, monkeypatch, limits):
    monkeypatch.setattr(suffixes, "Unit", lambda **k: anchors.Unit(**k, **limits))
    rows = hostile(random.Random(1), list("abcdé \n"), "".join)
    assert removed_bytes(spark, rows) == brute.repeated_bytes(rows, 100)
    assert removed_bytes(spark, []) == []


@pytest.mark.parametrize("limits", [{}, {"hot_key": 2, "segment": 50, "flush": 500}])
def test_repeated_words_of_hostile_rows(spark, monkeypatch, limits):
    monkeypatch.setattr(fmindex, "Unit", lambda **k: anchors.Unit(**k, **limits))
    rows = hostile(random.Random(2), ["a", "b", "cé", "D", "e"], " ".join)
    assert removed_words(spark, rows) == brute.repeated_words(rows, 13)
    assert removed_words(spark, []) == []


def test_repeated_bytes_of_the_table(spark, sf):
    docs, rows = documents(spark, sf)
    out = suffixes.report(suffixes.remove_repeated_bytes(docs)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr) == brute.repeated_bytes(rows, 100)


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("letters", [8, 64, 1024, 4096])
def test_words_that_defeat_a_power_of_two_modulus_stay_apart(spark, letters):
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, thue_morse(letters, 0)), (2, thue_morse(letters, 1)), (3, thue_morse(letters, 0) + " " + tail), (4, thue_morse(letters, 1) + " " + tail), (5, "a\0" * 3), (6, "a\0" * 3 + "\0")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)
    assert removed_words(spark, rows) == brute.repeated_words(rows, 13)
    assert removed_bytes(spark, rows) == brute.repeated_bytes(rows, 100)


def test_word_sequences_that_defeat_a_power_of_two_modulus_stay_apart(spark):
    rows = [(i, " ".join(thue_morse(2048, i % 2))) for i in range(4)]
    assert removed_words(spark, rows) == brute.repeated_words(rows, 13)


@pytest.mark.parametrize("words", [True, False])
def test_frequent_keys_are_dealt_by_content(spark, monkeypatch, words):
    monkeypatch.setattr(anchors, "SAMPLED", 2)
    for module in (suffixes, fmindex):
        monkeypatch.setattr(module, "Unit", lambda **k: anchors.Unit(**k, hot_key=10))
    rng = random.Random(7)
    line = " ".join(f"licence{i}" for i in range(16))
    rows = [(i, " ".join([*(f"w{rng.randrange(9**9)}" for _ in range(20)), line, *(f"w{rng.randrange(9**9)}" for _ in range(20))])) for i in range(120)]
    if words:
        assert removed_words(spark, rows) == brute.repeated_words(rows, 13)
    else:
        assert len(anchors._frequent(anchors.keyed(frame(spark, rows), "doc_id", "text"), anchors.Unit(words=False, length=100, k=25, within=True, hot_key=10))) > 0
        assert removed_bytes(spark, rows) == brute.repeated_bytes(rows, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20).filter(lambda w: not set(w) & set(b" \t\n\v\f\r")), max_size=30))
def test_word_values_are_those_of_the_bytes(words):
    buf = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts, ends, _ = tk.word_spans(buf, np.array([0, len(buf)]))
    values = tk.word_hashes(buf, starts, ends).tolist()
    assert len(values) == len(words) and len(set(zip(words, values, strict=True))) == len(set(words)) == len(set(values))
    data, a, b = tk.joined_words(buf, starts, ends)
    assert [data[x:y] for x, y in zip(a, b, strict=True)] == words


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 60))
def test_sorted_groups_match_plain_sorting(data, length):
    at = np.arange(max(0, len(data) - length + 1))
    groups = [sorted(g.tolist()) for g in suffixes.equal_groups(data, at, length)] if len(at) else []
    plain = {}
    for p in at.tolist():
        plain.setdefault(data[p : p + length], []).append(p)
    assert groups == [plain[k] for k in sorted(plain)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.integers(1, 5), min_size=1, max_size=6))
def test_fm_index_counts_patterns(text, pattern):
    index = fmindex.FMIndex(np.array([*text, 0]), 6, 6)
    stream = np.array(pattern)
    length, lo, hi = index.matching(stream, np.array([len(pattern)]), len(pattern))
    count = sum(text[i : i + len(pattern)] == pattern for i in range(len(text)))
    assert (hi[0] - lo[0] if length[0] == len(pattern) else 0) == count
    best = max(k for k in range(len(pattern) + 1) if k == 0 or any(text[i : i + k] == pattern[-k:] for i in range(len(text))))
    assert length[0] == best
