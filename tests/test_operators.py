"""Operators on hand-made notes: protected regions, idempotence, errors, workflow rules."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.operators import assets, citations, cleaning, figures, knowledge, lines, units, validators, workflow
from lectern.sources import readers, sinks
from lectern.streaming import notes as streaming


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def text_of(frame):
    return [r.text for r in frame.orderBy("doc_id").collect()]


REFS = "\n## References\n\n[1] Doe, J. One. 2001.\n\n[2] Roe, R. Two. 2002.\n\n[3] Lee, B. Three. 2003.\n"


def test_citations_link_only_plain_body(spark):
    body = "---\nx: [1]\n---\nA [1, 2], [1]–[3] and [7]. `[1]` $a_[1]$ [t](u[1]) ![1] \\[1\\] (see Doe et al., 2001; Roe & Lee, 2002)\n"
    out = text_of(citations.link_citations(notes(spark, body + REFS)))[0]
    assert out.startswith("---\nx: [1]\n---\nA [[#^ref-1|¹]]<sup>,</sup>[[#^ref-2|²]]<sup>,</sup>[[#^ref-1|¹]]<sup>,</sup>[[#^ref-2|²]]<sup>,</sup>[[#^ref-3|³]] and [7]. `[1]` $a_[1]$ [t](u[1]) ![1] \\[1\\] [[#^ref-1|¹]]<sup>,</sup>[[#^ref-2|²]]\n")
    assert out.endswith(REFS)
    assert text_of(citations.link_citations(notes(spark, out)))[0] == out


def test_null_and_empty_notes_pass(spark):
    frame = notes(spark, None, "", "x")
    assert text_of(citations.link_citations(frame)) == [None, "", "x"]
    assert lines.lines(frame).count() == 2
    assert units.translation_units(frame).count() == 1
    assert validators.readiness(frame).count() == 3
    assert text_of(figures.link_figures(frame)) == [None, "", "x"]


def test_footnotes_move_and_conflicts_stay(spark):
    free = "Text[^1] and[^2].\n\n[^1]: J. Doe, A study. Journal of X, 2001.\n[^2]: plain\n"
    taken = free + REFS
    rows = citations.footnotes_to_references(notes(spark, free, taken)).orderBy("doc_id").collect()
    assert rows[0].text == "Text[[#^ref-1|¹]] and[^2].\n\n[^2]: plain\n\n## References\n\n[1] J. Doe, A study. Journal of X, 2001. ^ref-1\n"
    assert rows[1].conflicts == [1] and rows[1].text == taken


def test_structure_references_numbers_and_is_idempotent(spark):
    frame = notes(spark, "a\n\n# References\n\nDoe, J. One,\n\n2001.\n\nRoe, R. Two.\n\n# B\n")
    once = frame.withColumn("text", citations.structure_references(F.col("text")))
    assert text_of(once)[0] == "a\n\n# References\n\n[1] Doe, J. One, 2001. ^ref-1\n\n[2] Roe, R. Two. ^ref-2\n\n# B\n"
    assert text_of(once.withColumn("text", citations.structure_references(F.col("text")))) == text_of(once)


def test_named_citations_report_missing_keys(spark):
    entries = spark.createDataFrame([("k1", "E1")], "key string, entry string")
    out, missing = citations.resolve_named(notes(spark, "a \\[k1\\]" + REFS, "b \\[k2\\]"), entries)
    assert text_of(out)[0].startswith("a [[#^ref-4|⁴]]") and text_of(out)[0].endswith("[4] E1 ^ref-4\n")
    assert [(r.doc_id, r.key) for r in missing.collect()] == [(1, "k2")]


def test_figures_link_lists_and_keep_ranges(spark):
    note = "![a](p/1.png)\n\nFigure 1: x\n\n![[2.png]]\n图 2（a）y\n\nSee Figs. 1 and 2, Figures 1–2, Fig. 9 and `Figure 1`.\n| Figure 1 |\n"
    out = text_of(figures.link_figures(notes(spark, note)))[0]
    assert "See Figs. [1](p/1.png) and [[2.png|2]], Figures 1–2, Fig. 9 and `Figure 1`.\n| Figure 1 |" in out
    assert text_of(figures.link_figures(notes(spark, out)))[0] == out


def test_captions_are_idempotent(spark):
    frame = notes(spark, "Figure 2: 1,000 1{,}000 of 5 % 5\\% and 3 3 mm\nNot 3 3 a caption")
    once = frame.withColumn("text", cleaning.normalize_captions(F.col("text")))
    assert text_of(once) == ["Figure 2: $1{,}000$ of $5\\%$ and $3$ mm\nNot 3 3 a caption"]
    assert text_of(once.withColumn("text", cleaning.normalize_captions(F.col("text")))) == text_of(once)


def test_captions_follow_every_rule(spark):
    rules = [
        ("10 mm 10\\\\,\\\\mathrm{mm}", r"$10\,\mathrm{mm}$"),
        ("1,000 1{,}000", "$1{,}000$"),
        ("1000 1{,}000", "$1{,}000$"),
        ("5 % 5\\\\%", r"$5\%$"),
        ("≈ 5 {\\\\approx} 5\\\\%", r"${\approx} 5\%$"),
        ("α = 0.5 \\\\alpha=0.5", r"$\alpha=0.5$"),
        ("R 2 R^{2}=2", "$R^{2}=2$"),
        ("π 0 \\\\pi\\_{0}", r"$\pi_{0}$"),
        ("k = 5 k=5", "$k=5$"),
        ("t 1 t\\_{1} – 4 t_{4}", "$t_{1}$–$t_{4}$"),
        ("t 1 , … t=1,\\\\ldots,9", r"$t=1,\ldots,9$"),
        ("at 5 mm", r"at $5\,\mathrm{mm}$"),
        ("about 5%.", r"about $5\%$."),
    ]
    frame = notes(spark, *(f"Figure 1: {raw} end $a\\\\b$" for raw, _ in rules))
    rows = frame.select("doc_id", cleaning.caption_report(F.col("text")).alias("r")).orderBy("doc_id").select("r.*").collect()
    assert [r.text for r in rows] == [f"Figure 1: {tex} end $a\\\\b$" for _, tex in rules]
    assert [(r.captions, r.fixed, r.residual) for r in rows] == [(1, 1, [])] * 13


def test_captions_report_what_stays(spark):
    text = "# T\r\n> 图 2：x \\\\alpha y  \r\nFig. 3: 5%, 6 mm; 为5 mm\nnot \\\\alpha\n"
    r = notes(spark, text, None).select("doc_id", cleaning.caption_report(F.col("text")).alias("r")).orderBy("doc_id").select("r.*").collect()
    assert r[0].text == "# T\r\n> 图 2：x \\\\alpha y  \r\nFig. 3: $5\\%$, $6\\,\\mathrm{mm}$; 为5 mm\nnot \\\\alpha\n"
    assert (r[0].captions, r[0].fixed, [tuple(x) for x in r[0].residual]) == (2, 2, [(2, "> 图 2：x \\\\alpha y")])
    assert r[1].text is None


def test_tables_get_every_flag(spark):
    row = lambda cell: f"<table><tr><td>a</td><td>b</td></tr><tr>{cell}<td>2</td></tr></table>"
    cases = [
        (row("<td>$x$</td>"), ["contains_inline_math"], "convert"),
        (row("<td>\\(x\\)</td>"), ["contains_latex_paren_delimiters"], "convert"),
        (row("<td>$$x$$</td>"), ["contains_display_math_delimiter"], "convert"),
        (row("<td>\\begin {cases} x</td>"), ["contains_cases_formula"], "convert"),
        (row("<td>x &#124; y</td>"), ["contains_pipe_character"], "convert"),
        ("<table></table>", ["no_cells_detected", "no_rows_detected", "too_few_rows"], "review"),
        (row("<td><code>x</code></td>"), ["code_like_tag:code"], "review"),
        (row("<td><script>x</script></td>"), ["code_like_tag:script"], "review"),
        (row("<td><style>x</style></td>"), ["code_like_tag:style"], "review"),
        (row("<td><section>x</section></td>"), ["block_tag:section"], "review"),
        (row("<td><img src='a'></td>"), ["image_in_cell"], "review"),
        (row(""), ["inconsistent_column_count"], "review"),
        ("<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td></tr></table>", ["inconsistent_column_count", "rowspan"], "review"),
        ("<table><tr><td colspan='2'>a</td></tr><tr><td>1</td><td>2</td></tr></table>", ["colspan"], "convert"),
        (row("<td>1</td>"), [], "convert"),
    ]
    out = cleaning.classify_tables(cleaning.html_tables(notes(spark, *(x for x, _, _ in cases)))).orderBy("doc_id").collect()
    assert [(r.flags, r.status) for r in out] == [(flags, status) for _, flags, status in cases]
    assert [r.reasons for r in out] == [[x for x in flags if not x.startswith("contains_")] for _, flags, _ in cases]


def test_noise_keeps_code_and_anchors(spark):
    note = "[Menu](/m)\n# T\n[body](/keep)\n```\n[Home](/)\n```\n<script>\nx\n</script>\n[1](#s '‣ a')"
    row = cleaning.filter_web_noise(notes(spark, note)).first()
    assert row.text == "# T\n[body](/keep)\n```\n[Home](/)\n```" and [r.reason for r in row.removed] == ["known_navigation_label"] + ["html_site_chrome"] * 3 + ["captured_section_navigation"]


def test_output_contract_and_cache_rules(spark):
    u = spark.createDataFrame([("u1", "Text $a$", True), ("u2", "ID", False), ("u3", "More", True)], "unit_id string, english string, requires_translation boolean")
    r = spark.createDataFrame([("u1", "文"), ("u2", "id"), ("u9", "文")], "unit_id string, zh string")
    found = {(x.unit_id, x.error) for x in units.output_errors(u, r).collect()}
    assert found == {("u1", "token_count"), ("u2", "not_verbatim"), ("u3", "missing_unit"), ("u9", "unknown_unit")}
    assert units.import_status(u, r).first().status == "partial"
    cache = spark.createDataFrame([("k", "a", True, "low", 1), ("k", "b", True, "high", 2), ("j", "c", False, "high", 3)], "cache_key string, zh string, runtime_verified boolean, quality_tier string, seq long")
    assert [tuple(x) for x in units.eligible_cache(cache, "medium").collect()] == [("k", "b")]


def test_restore_needs_each_placeholder_once(spark):
    u = spark.createDataFrame([("u00001", "a $x$ b $x$")], "unit_id string, english string")
    p = units.protect(u)
    assert p.first().transport == "a {{PT:u00001:001}} b {{PT:u00001:002}}"
    assert units.restore(p).first().restored == "a $x$ b $x$"
    assert not units.restore(p.withColumn("transport", F.lit("{{PT:u00001:001}}"))).first().intact


def test_concepts_once_per_section_longest_first(spark):
    vault = spark.createDataFrame([("v/Flow.md", "# Flow"), ("v/Flow Matching.md", "# Flow Matching"), ("v/AI.md", "---\naliases: [人工智能]\n---\n# AI x"), ("v/GAN.md", "# GAN")], "path string, text string")
    candidates = knowledge.concept_candidates(knowledge.note_surfaces(vault))
    cases = {
        # Of a stretch only a surface's first mention counts, and that of Flow lies within a longer one.
        "论flow matching and Flow; 人工智能": "论[[Flow Matching|flow matching]] and Flow; [[AI|人工智能]]",
        "overflow 流 flow的 flow\n再 Flow": "overflow 流 [[Flow|flow]]的 flow\n再 Flow",
        "只 `Flow` https://x.org/Flow $Flow$ [Flow](x)": "只 `Flow` https://x.org/Flow $Flow$ [Flow](x)",
        "流 Flow\n## S\n流 Flow": "流 [[Flow]]\n## S\n流 [[Flow]]",
        "Flow without it": "Flow without it",
        "已 [[a/Flow#b|x]] y\n又 Flow": "已 [[a/Flow#b|x]] y\n又 Flow",
        "小 gan 大 GAN": "小 gan 大 [[GAN]]",
        "> 引 Flow\n| 表 Flow |": "> 引 Flow\n| 表 Flow |",
        "İ流 Flow": "İ流 [[Flow]]",
        "": "",
        None: None,
    }
    rows = knowledge.link_concepts(notes(spark, *cases), candidates).orderBy("doc_id").collect()
    assert [r.text for r in rows] == list(cases.values())
    [latin] = knowledge.link_concepts(notes(spark, "Flow without it"), candidates, chinese_only=False).collect()
    assert latin.text == "[[Flow]] without it" and latin.linked == 1


def test_concepts_of_a_dictionary_too_large_to_send(spark, monkeypatch):
    names = [("Flow", "F"), ("Flow Matching", "M"), ("flow", "f"), ("GAN", "G"), ("人工智能", "AI"), ("工_", "U"), ("C++", "C"), ("2k run", "K"), ("2", "T"), ("Σ流", "S"), ("STANDARD 12", "P"), ("STANDARD 120", "Q"), ("trail ", "R"), ("absent", "A")]
    candidates = spark.createDataFrame([(s, t, "stem", True) for s, t in names], "surface string, target string, provenance string, auto_write boolean")
    texts = ["论flow matching, Flow; 人工智能", "论 Flow\n## S\n流 FLOW matching", "小 gan 大 GAN", "工__ 与 c++ 与 2\u212a run", "又 2\u212a", "İ σ流 standard 120 trail x", "standard 12 与 standard  12", "Flow", "> 引 Flow", "", None]
    for chinese_only in (True, False):
        monkeypatch.setattr(knowledge, "DICTIONARY_ROWS", len(names))
        sent = knowledge.link_concepts(notes(spark, *texts), candidates, chinese_only).orderBy("doc_id").collect()
        monkeypatch.setattr(knowledge, "DICTIONARY_ROWS", len(names) - 1)
        joined = knowledge.link_concepts(notes(spark, *texts), candidates, chinese_only).orderBy("doc_id").collect()
        assert joined == sent
    texts = ["论[[M|flow matching]], Flow; [[AI|人工智能]]", "论 [[F|Flow]]\n## S\n流 [[M|FLOW matching]]", "小 gan 大 [[G|GAN]]", "[[U|工_]]_ 与 [[C|c++]] 与 [[T|2]]\u212a run"]
    assert [r.text for r in joined[:4]] == texts and joined[-1].text is None


def test_surfaces_come_from_headings_but_generic_ones_do_not_count(spark):
    vault = spark.createDataFrame([("v/X y.md", "# A [[b|long]] *name* (one, two)\n### Third（三号）\n#### Fourth"), ("v/None.md", None)], "path string, text string")
    found = {(r.surface, r.provenance) for r in knowledge.note_surfaces(vault).where("path = 'v/X y.md'").collect()}
    assert found == {("X y", "stem"), ("A long name (one, two)", "heading"), ("one, two", "heading"), ("one", "heading"), ("two", "heading"), ("Third（三号）", "heading"), ("三号", "heading")}
    words = {"Robots": True, "ab": True, "RL": False, "MDP": False, "12.5-3": True, "方差": False, "状态": True, "流形": True, "流形学": False, "a b": False, "Banned": True, " ": True}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", knowledge.generic_surface(F.col("w"), ("banned",)).alias("g"))
    assert {r.w: r.g for r in rows.collect()} == words


def test_line_edits_need_the_exact_line(spark):
    frame = notes(spark, "a\nb", "a\nb")
    sha = F.sha2(F.lit("a\nb").cast("binary"), 256)
    edits = spark.createDataFrame([(0, 2, "list", "b", "c"), (1, 2, "list", "x", "c")], "doc_id long, line long, type string, before string, after string").withColumn("source_sha256", sha)
    rows = validators.apply_line_edits(frame, edits).orderBy("doc_id").collect()
    assert [(r.text, r.errors) for r in rows] == [("a\nc", []), ("a\nb", ["before_differs"])]


def test_failure_order(spark):
    runs = [(True, 1, False, "websocket", 1, 1), (False, 1, False, "Unexpected EOF", 1, 1), (False, 2, False, None, 1, 1), (False, 0, False, "websocket", 1, 1), (False, 0, True, "", 1, 1), (False, 0, True, "", 0, 9), (False, 0, True, "", 0, 0)]
    rows = spark.createDataFrame(runs, "late boolean, code int, fine boolean, log string, c int, u int")
    out = [tuple(r.f) for r in rows.select(workflow.classify_failure(*(F.col(c) for c in rows.columns)).alias("f")).collect()]
    assert [(f, again) for _, f, again in out] == [("timeout", True), ("network_transport", True), ("worker_process", True), ("runtime_mismatch", False), ("output_contract", True), ("unit_validation", True), ("unknown", True)]
    assert [s for s, _, _ in out] == ["worker_process"] * 3 + ["runtime_attestation"] + ["output_validation"] * 3


def test_readers_and_sinks_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/vault"
    good = "---\ntitle: x\n---\n# A title\n"
    rows = spark.createDataFrame([("a.md", good), ("sub/b.md", good), ("bad.md", "no"), ("../out.md", good)], "path string, text string")
    (tmp_path / "vault").mkdir()
    assert {r.status for r in sinks.write_notes(rows, root).collect()} == {"would_write", "invalid"}
    assert sorted(r.status for r in sinks.write_notes(rows, root, write=True).collect()) == ["invalid", "invalid", "written", "written"]
    assert sorted(r.status for r in sinks.write_notes(rows, root, write=True).collect()) == ["invalid", "invalid", "unchanged", "unchanged"]
    assert sorted(r.text for r in readers.read_notes(spark, root).collect()) == [good, good]


def test_jsonl_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n')
    good, bad = readers.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 2


def test_bibliography_snapshot(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "z.sqlite")
    for table, schema in readers.BIBLIOGRAPHY.items():
        con.execute(f"CREATE TABLE {table} ({schema.replace(' string', ' TEXT').replace(' long', ' INTEGER').replace(' int', ' INTEGER')})")
    con.execute("INSERT INTO items VALUES (1, 'K')")
    con.commit()
    tables = readers.read_bibliography(spark, str(tmp_path / "z.sqlite"))
    assert tables["items"].collect()[0].key == "K" and tables["deletedItems"].count() == 0


def test_layout_tree_is_flattened(spark):
    rows = spark.createDataFrame([(1, '[[{"type": "a"}], [{"type": "b", "blocks": [{"type": "c"}]}]]'), (2, '[{"type": "d", "children": [{"type": "e", "lines": [{"type": "f"}]}]}]')], "doc_id long, json string")
    kinds = readers.flatten_layout(rows).select("doc_id", "page", F.try_variant_get("node", "$.type", "string").alias("t")).where("t IS NOT NULL").collect()
    assert {(r.doc_id, r.page, r.t) for r in kinds} >= {(2, 0, "d"), (2, 0, "e"), (2, 0, "f")}


def test_layout_tree_is_walked_to_its_end(spark):
    deep = '{"type": "x12"}'
    for i in range(11, -1, -1):
        deep = f'{{"type": "x{i}", "blocks": [{deep}]}}'
    odd = '[[{"type": "a"}], [{"type": "b", "content": {"type": "c", "lines": [[{"type": "d"}], [[{"type": "e"}]]]}}]]'
    rows = spark.createDataFrame([(1, f"[{deep}]"), (2, odd), (3, '{"type": "r", "spans": "text"}'), (4, None)], "doc_id long, json string")
    got = {(r.doc_id, r.page, r.t) for r in readers.flatten_layout(rows).select("doc_id", "page", F.try_variant_get("node", "$.type", "string").alias("t")).collect()}
    assert got == {(1, 0, f"x{i}") for i in range(13)} | {(2, 0, "a"), (2, 1, "b"), (2, 1, "c"), (2, 1, "d"), (2, 1, "e"), (3, None, "r")}


def test_stream_matches_batch(spark, tmp_path):
    frame = notes(spark, "![[a]](b.png)", "x")
    frame.write.parquet(f"{tmp_path}/in")
    fix = lambda d: d.withColumn("text", cleaning.repair_mixed_images(F.col("text")))
    q = streaming.transform_stream(streaming.note_stream(spark, f"{tmp_path}/in"), fix, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["![a](b.png)", "x"]


def test_reference_titles(spark):
    cases = {
        "Ann De Sample, Bo Jay, and Cy Brown. Bridges for testing titles. (arXiv:2106.01), Dec 2021. URL https://e.org/x.": ("Bridges for testing titles", "deterministic"),
        'Sample Robotics, Ann Day, Bo "Jim" Jay, and Cy Green. Model T1: A Model for Tests, March 2025a. URL https://e.org/y.': ("Model T1: A Model for Tests", "deterministic"),
        "Ann B. C. Day. torchthing, 2018. URL https://e.org/torchthing.": (None, "none"),
        "Robot arms of note. https://e.org": (None, "worker"),
        "Day, A. (2020) A study of tests. Journal of Tests, 3.": ("A study of tests", "deterministic"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "e string").select("e", units.infer_title(F.col("e")).alias("t")).collect()
    assert {r.e: (r.t.title, r.t.mode) for r in rows} == cases


def test_paths_and_titles(spark):
    rows = spark.createDataFrame([("a/b/c.png", "a/d"), ("x.png", ""), ("a/x.png", "a"), ("../y", "a/b")], "p string, d string")
    out = [tuple(r) for r in rows.select(assets.relative_path(F.col("p"), F.col("d")), assets.is_within(F.col("p"))).collect()]
    assert out == [("../b/c.png", True), ("x.png", True), ("x.png", True), ("../../../y", False)]
    entries = spark.createDataFrame([(1, 2, "Doe, J. (2020) A study of tests. Journal of Tests. 《研究》")], "doc_id long, number int, entry string")
    row = units.reference_title_units(entries).first()
    assert (row.unit_id, row.existing_zh, row.status) == (None, "研究", "reused")


def test_fetch_keeps_failures_as_rows(spark):
    def fetcher(source):
        if "bad" in source:
            raise OSError("no route")
        return b"image"

    rows = spark.createDataFrame([("data:image/png;base64,YWJj",), ("data:,a%20b",), ("https://e.org/bad",), ("https://e.org/x",), ("https://e.org/x",)], "source string")
    out = {r.source: (r.status, None if r.content is None else bytes(r.content), r.error) for r in assets.fetch(rows, fetcher).collect()}
    assert out == {"data:image/png;base64,YWJj": ("downloaded", b"abc", None), "data:,a%20b": ("downloaded", b"a b", None), "https://e.org/bad": ("failed", None, "no route"), "https://e.org/x": ("downloaded", b"image", None)}


def test_image_groups_become_one_crop(spark):
    note = "![a](p/1.png)\n\n![b](p/2.png)\nFig. 3: x\n![c](c.png)\nFigure 4: y\n"
    groups = assets.image_groups(notes(spark, note))
    assert [(r.figure, r.images) for r in groups.collect()] == [("3", ["p/1.png", "p/2.png"])]
    crops = spark.createDataFrame([(0, "3", "crops/3.png")], "doc_id long, figure string, target string")
    assert text_of(assets.replace_image_groups(notes(spark, note), crops)) == ["![Figure 3](crops/3.png)\n\nFig. 3: x\n![c](c.png)\nFigure 4: y\n"]


def test_alignments_keep_manual_entries(spark):
    images = spark.createDataFrame([("n.md", "a.png", True), ("n.md", "b.png", False)], "note string, image string, float_candidate boolean")
    keys = {r.image: r.cache_key for r in assets.sync_alignments(images, spark.createDataFrame([], "note string, cache_key string, position string, width string, height string, wrap boolean")).collect()}
    cache = spark.createDataFrame([("n.md", keys["a.png"], "left", "10", "", True)], "note string, cache_key string, position string, width string, height string, wrap boolean")
    out = {r.image: (r.status, r.position, r.width, r.wrap) for r in assets.sync_alignments(images, cache).collect()}
    assert out == {"a.png": ("preserved_existing", "left", "10", True), "b.png": ("added", "center", "", False)}
    over = {r.image: (r.status, r.position, r.width) for r in assets.sync_alignments(images, cache, overwrite=True).collect()}
    assert over["a.png"] == ("overwritten", "center", "10")
    assert tuple(assets.alignment_counts(assets.sync_alignments(images, cache)).first()) == ("n.md", 1, 0, 1, 1)


def chain(spark, *texts):
    """Footnotes, then the reference section's structure, then links."""
    step = citations.footnotes_to_references(notes(spark, *texts)).select("doc_id", "text")
    return text_of(citations.link_citations(step.withColumn("text", citations.structure_references(F.col("text")))))


def test_quoted_originals_stay_quotes_without_an_id(spark):
    text = "Claim[^1].\n\n## References\n\n## Annex\n\nMore[^2].\n\n> [^1]: J. Doe (2001) On tests. Journal of X, pp. 1–2.\n\n[^1]: J. Doe (2001) 论测试。X 期刊。\n\n> [^2]: R. Roe (2002) On proofs. Journal of Y.\n\n[^2]: R. Roe (2002) 论证明。Y 期刊。\n"
    out = chain(spark, text)[0]
    section = "## References\n\n> [1] J. Doe (2001) On tests. Journal of X, pp. 1–2.\n\n[1] J. Doe (2001) 论测试。X 期刊。 ^ref-1\n\n> [2] R. Roe (2002) On proofs. Journal of Y.\n\n[2] R. Roe (2002) 论证明。Y 期刊。 ^ref-2\n\n## Annex\n"
    assert out.startswith("Claim[[#^ref-1|¹]].\n\n" + section) and "More[[#^ref-2|²]]." in out
    assert chain(spark, out) == [out]
    assert [(r.number, r.entry) for r in citations.reference_entries(notes(spark, out)).collect()] == [(1, "J. Doe (2001) 论测试。X 期刊。"), (2, "R. Roe (2002) 论证明。Y 期刊。")]
    assert not {r.rule for r in validators.validate_references(notes(spark, out)).collect()}


def test_labels_defined_twice_are_conflicts(spark):
    text = "A[^1].\n\n[^1]: J. Doe (2001) One. Journal.\n\n[^1]: J. Doe (2001) Other. Journal.\n"
    row = citations.footnotes_to_references(notes(spark, text)).first()
    assert row.conflicts == [1] and row.text == text


def test_footnotes_mixed_and_contiguous(spark):
    mixed = "Known[^1], see[^2] and[^3].\n\n[^1]: J. Doe (2001) One. Journal of X.\n\n[^2]: A remark of the editor, no more.\n\n[^3]: R. Roe (2002) Two. Proceedings.\n"
    weak = mixed.replace("A remark of the editor, no more.", "Manual, https://example.org/m.")
    one, all_ = chain(spark, mixed, weak)
    assert "see[^2]" in one and "[^2]: A remark" in one and "[[#^ref-3|³]]" in one
    assert "[^" not in all_ and "[2] Manual, https://example.org/m. ^ref-2" in all_
    rules = lambda t: {r.rule for r in validators.validate_references(notes(spark, t)).collect()}
    assert "bibliographic_footnotes_left" in rules(mixed) and "bibliographic_footnotes_left" not in rules("A[^1].\n\n[^1]: A remark.\n")
    assert "footnotes_of_entries" in rules("A[^1].\n\n## References\n\n[1] J. Doe (2001) One. ^ref-1\n")


def test_complete_entries_absorb_nothing(spark):
    text = "A [5], [6].\n\n## References\n\n[5] Ann Long and Bea\n\nShort. A title. 2001.\n\nreview. Journal of Z, 2001.\n\n[6] C. Doe. Next\nline. 2002.\n"
    out = chain(spark, text)[0]
    assert out.endswith("[5] Ann Long and Bea Short. A title. 2001. ^ref-5\n\nreview. Journal of Z, 2001.\n\n[6] C. Doe. Next line. 2002. ^ref-6\n")
    assert chain(spark, out) == [out]


def test_people_pass_through_where_they_are_listed(spark):
    text = "# T\n\nAnn Lee, Bob van Dyk\n\n## Contributors\n\nAlma Ray<sup>1</sup>, Ivo Kern<sup>2</sup>\n\nKai Ott  Lea Um [kai@x.org](mailto:kai@x.org)\n\n王小明、李雷\n\nOpen Robotics Laboratory\n\nAlma Ray wrote this.\n\n## Methods\n\nAnn Lee, Bob van Dyk\n"
    got = [(r.english, r.reason) for r in units.translation_units(notes(spark, text)).orderBy("unit_order").collect()]
    people = {"Alma Ray<sup>1</sup>, Ivo Kern<sup>2</sup>", "Kai Ott  Lea Um [kai@x.org](mailto:kai@x.org)"}
    assert got[0] == ("Ann Lee, Bob van Dyk", "contributors") and got[-1] == ("Ann Lee, Bob van Dyk", None)
    assert {e for e, r in got[1:] if r == "contributors"} == people
    assert {e for e, r in got if r is None} == {"王小明、李雷", "Open Robotics Laboratory", "Alma Ray wrote this.", "Ann Lee, Bob van Dyk"}


def test_code_lines_pass_through(spark):
    code = ["⬇", "class Job:", "def run(self, a, keep\\_b)", "while n\\_a < self.n\\_b:", "self.node\\_set.run(", "to\\_list=self.out\\_ch,", ")", "if *$G$ is done* then", "return $A$, $B$;", "end if", "$T_{x}\\leftarrow$ Plan ($S$);", "a ← b", "os.path.join(a);", "break"]
    prose = ["1 $D\\leftarrow$ $E$; // a map", "(a) A usual job.", "If it is stable, then it ends.", "For the large one, all is well.", "Return to the start of the text, reader.", "x"]
    got = {r.english: r.reason for r in units.translation_units(notes(spark, "# T\n\n## M\n\n" + "\n\n".join(code + prose) + "\n")).collect()}
    assert [c for c in code if got[c] != "code"] == [] and {got[p] for p in prose if p not in ("Return to the start of the text, reader.",)} == {None}


def test_small_set_operators(spark):
    u = spark.createDataFrame([(1, "u1", "A", True, "h1", "paragraph"), (1, "u2", "B", True, "h2", "paragraph"), (1, "u3", "ID", False, "h3", "passthrough")], "doc_id long, unit_id string, english string, requires_translation boolean, source_sha256 string, kind string")
    r = spark.createDataFrame([("u1", "甲"), ("u2", "no"), ("u3", "ID")], "unit_id string, zh string")
    assert {(x.unit_id, x.zh) for x in units.valid_units(u, r).collect()} == {("u1", "甲"), ("u3", "ID")}
    empty = spark.createDataFrame([], "cache_key string, zh string, unit_kind string, runtime_verified boolean, quality_tier string, seq long")
    kept, cache = units.import_valid(u, r, empty, F.lit(1).cast("long"), "high")
    assert kept.count() == 2 and [(x.zh, x.unit_kind) for x in units.cache_in_order(cache).collect()] == [("甲", "paragraph")]
    assert units.import_valid(u, r, empty, F.lit(1).cast("long"), "high", most_invalid=1)[0].count() == 0
    assert [tuple(x) for x in units.shared_ids(u.select("doc_id", "unit_id").where("unit_id <> 'u2'"), u).collect()] == [(1, 1, 1)]
    a, b = (spark.createDataFrame(x, "doc_id long, number int") for x in ([(1, 1), (1, 2), (2, 1)], [(1, 2), (2, 1), (2, 1)]))
    assert sorted(tuple(x) for x in units.same_numbers(a, b).collect()) == [(1, 1, 0, False), (2, 0, 0, True)]
    assert units.status_schema(7)["properties"]["translated_units"]["const"] == 7


def test_paper_notes_give_no_concepts(spark):
    rows = [("论文/a.md", "x"), ("论文/b 概念.md", "x"), ("c/提示词 1.md", "x"), ("B.md", "---\ntags: [Paper]\n---\n"), ("d.md", "---\ntags: [paper, concept]\n---\n"), ("a.md", "x"), ("e.md", None)]
    vault = spark.createDataFrame(rows, "path string, text string")
    assert [r.path for r in knowledge.concept_notes(vault, "e.md").collect()] == ["a.md", "d.md", "论文/b 概念.md"]


def test_review_occurrences_count_without_overlap(spark):
    asked = spark.createDataFrame([("aa", "A", "heading", False), ("XY", "B", "heading", False), ("word", "C", "stem", True)], "surface string, target string, provenance string, auto_write boolean")
    out = knowledge.review_occurrences(notes(spark, "aaaaa Aa xy XYXY word", None, ""), asked).collect()
    assert {(r.doc_id, r.surface, r.n) for r in out} == {(0, "aa", 3), (0, "XY", 2)}


def test_tables_are_counted_by_status(spark):
    good, bad = "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "<table></table>"
    out = [tuple(r) for r in cleaning.table_triage(notes(spark, good + bad + "</table>", "x")).orderBy("doc_id").collect()]
    assert out == [(0, 2, 1, 1, 1), (1, 0, 0, 0, 0)]


def test_merged_notes_keep_all_that_is_no_unit(spark):
    text = "---\nt: x\n---\n# T\n\nOne\ntwo $a$.\n\n$$\na\n$$\n- item\n![f](f.png)\n\n| a |\n\n> kept\n\nICRA2024\n\n## References\n\n[1] Doe. One. ^ref-1\n\n[2] Roe. Two 《二》 ^ref-2\n"
    frame = notes(spark, text)
    results = spark.createDataFrame([(0, "u00001", "一 $a$。"), (0, "u00002", "项")], "doc_id long, unit_id string, zh string")
    titles = spark.createDataFrame([(0, 1, "一"), (0, 2, "两")], "doc_id long, number int, zh string")
    row = units.merge_notes(frame, results, titles).first()
    assert row.text == text.replace("One\ntwo $a$.", "> One\n> two $a$.\n\n一 $a$。").replace("- item", "> - item\n\n- 项").replace("ICRA2024", "> ICRA2024\n\nICRA2024").replace("[1] Doe. One. ^ref-1", "[1] Doe. One.《一》 ^ref-1")
    assert row.complete
    open_ = units.merge_notes(frame, results.where("unit_id = 'u00001'")).first()
    assert not open_.complete and "> - item\n\n- {{ZH:u00002}}" in open_.text


def test_csl_files_and_doubled_keys(spark, tmp_path):
    item = '{"id": "%s", "title": "On <i>tests</i>", "container-title": "J", "author": [{"family": "Doe", "given": "J."}, {"literal": "Team"}], "issued": {"date-parts": [[2001, 3]]}, "DOI": "10.1/x"}'
    (tmp_path / "a.json").write_text("[" + item % "k1" + "," + item % "k2" + "]")
    rows = readers.read_csl(spark, str(tmp_path / "a.json")).select("key", citations.format_csl(F.col("item")).alias("entry")).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [(k, "Doe, J.; Team. On tests. J. 2001. https://doi.org/10.1/x") for k in ("k1", "k2")]
    for bad in ("[" + item % "k1" + "," + item % "k1" + "]", "no json"):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError, match="keys|list"):
            readers.read_csl(spark, str(tmp_path / "b.json"))


def test_downloads_stop_at_their_limit(tmp_path):
    (tmp_path / "x.png").write_bytes(b"a" * 100_000)
    address = (tmp_path / "x.png").as_uri()
    assert len(assets.http_get(address)) == 100_000
    with pytest.raises(ValueError, match="larger"):
        assets.http_get(address, most=70_000)


def test_bilingual_notes_get_their_english_back(spark):
    pair = lambda n: f"> English {n}.\n> more {n}\n\n中文 {n}。"
    three, layout = "\n\n".join(map(pair, "abc")), "---\nbilingual_layout: english_blockquote_chinese_body\n---\n"
    cases = {
        three: "\n\n".join(f"English {n}.\nmore {n}\n\n" for n in "abc"),
        # Two pairs are too few, unless the note declares the layout; headings and images are no translation.
        pair("a") + "\n\n" + pair("b"): pair("a") + "\n\n" + pair("b"),
        layout + pair("a"): layout + "English a.\nmore a\n\n",
        layout + "> q\n\n# 中": layout + "> q\n\n# 中",
        layout + "> q\n\n \n\n中\n文\n\nend": layout + "q\n\n \n\n\n\nend",
        layout + "> q\nplain\n\n中": layout + "> q\nplain\n\n中",
        layout + ">\n\n中": layout + ">\n\n中",
        "": "",
        None: None,
    }
    out = notes(spark, *cases).withColumn("text", cleaning.collapse_bilingual(F.col("text")))
    assert text_of(out) == list(cases.values())
    assert [tuple(r)[1:] for r in cleaning.bilingual_pairs(notes(spark, layout + pair("a"), "x", None)).collect()] == [("English a.\nmore a", "中文 a。")]


def test_cards_get_their_frontmatter(spark):
    fields = 'translation_workflow: "controlled-worker-pending"\ntranslation_status: "pending"\ntranslation_skill: "sk"\n'
    lay = 'bilingual_layout: "english_blockquote_chinese_body"\n'
    card = lambda front: f"---\n{front}---\n# T $1\n"
    cases = {
        "\ufeff\n# A \"b\"\nx": f'---\ntitle: "A \'b\'"\naliases:\n  - "A \'b\'"\ntags:\n  - paper\ncssclasses:\n  - wide\n{fields}{lay}---\n\n# A "b"\nx',
        "x": f'---\ntitle: "Fall"\naliases:\n  - "Fall"\ntags:\n  - paper\ncssclasses:\n  - wide\n{fields}{lay}---\n\n# Fall\n\nx',
        card("aliases: []\ncssclasses: [a, b]\n"): card(f'title: "T $1"\naliases:\n  - "T $1"\ncssclasses: [a, b, wide]\n{fields}{lay}'),
        card("title: k\naliases:\n  - z\ncssclasses: one\ntranslation_status: done\n"): card('title: k\naliases:\n  - z\ncssclasses:\n  - one\n  - wide\ntranslation_status: "pending"\ntranslation_workflow: "controlled-worker-pending"\ntranslation_skill: "sk"\n' + lay),
        card("title: k\naliases: null\ncssclasses:\n  - wide\n"): card(f'title: k\naliases:\n  - "T $1"\ncssclasses:\n  - wide\n{fields}{lay}'),
        card("title: k\naliases: w\ncssclasses:\n  - a\n"): card(f"title: k\naliases: w\ncssclasses:\n  - wide\n  - a\n{fields}{lay}"),
        None: None,
    }
    made = lambda **how: notes(spark, *cases).withColumn("text", cleaning.card_frontmatter(F.col("text"), F.lit("Fall"), "sk", "wide", **how))
    assert text_of(made()) == list(cases.values())
    plain = text_of(made(bilingual=False))
    assert all('translation_status: "not-requested"' in x and "bilingual_layout" not in x for x in plain if x)
    # A second pass changes nothing.
    assert text_of(made().withColumn("text", cleaning.card_frontmatter(F.col("text"), F.lit("Fall"), "sk", "wide"))) == list(cases.values())


def test_images_must_be_there_and_be_images(spark):
    text = "![a](../_resources/a.png) ![b](<../_resources/b.png>) ![c](../_resources/c.png) ![d](/d.png) ![e](e.png) ![f](https://x/f.png) ![g](../../_resources/a.png) ![w](../_resources/w.webp)"
    rows = spark.createDataFrame([(0, "n/a.md", text), (1, "b.md", "![a](_resources/a.png)"), (2, "c.md", None)], "doc_id long, path string, text string")
    png, webp = bytes.fromhex("89504E470D0A1A0A00"), b"RIFF1234WEBPVP8 "
    files = spark.createDataFrame([("_resources/a.png", png), ("_resources/b.png", b"text"), ("_resources/w.webp", webp)], "path string, content binary")
    found = {(r.doc_id, r.source): r.problem for r in validators.image_problems(rows, files).collect()}
    assert found == {(0, "../_resources/b.png"): "undecodable", (0, "../_resources/c.png"): "missing", (0, "/d.png"): "absolute", (0, "e.png"): "outside", (0, "https://x/f.png"): "outside", (0, "../../_resources/a.png"): "outside"}
    assert (0, "https://x/f.png") not in {(r.doc_id, r.source) for r in validators.image_problems(rows, files, remote_allowed=True).collect()}


def test_cache_of_another_runtime_is_no_hit_when_strict(spark):
    rows = [("k", "一", True, "high", 1, "m1", "High"), ("k", "二", True, "high", 2, "m2", "low"), ("j", "三", False, "high", 3, "m1", "high")]
    cache = spark.createDataFrame(rows, "cache_key string, zh string, runtime_verified boolean, quality_tier string, seq long, actual_model string, actual_reasoning_effort string")
    assert [tuple(r) for r in units.eligible_cache(cache).collect()] == [("k", "二")]
    assert [tuple(r) for r in units.eligible_cache(cache, "low", "m1", "high").collect()] == [("k", "一")]
