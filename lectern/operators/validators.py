"""Validators: each yields findings (doc_id, severity, rule, detail); readiness sums them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rewrite import PROTECTED, count, find_all, gaps, let
from lectern.operators import citations, figures
from lectern.operators import lines as ln

MAIN_SECTIONS = ("abstract", "introduction", "methods", "results", "discussion", "conclusion")


#: A check: severity, rule, condition and detail, both given the note's measures.
Check = tuple[str, str, Column, Column | None]


def _findings(notes: DataFrame, *validators) -> DataFrame:
    """Findings of the validators, each a pair (measures of a text, checks of the measures): one pass over a note for all."""
    names = [f"m{i}" for i in range(len(validators))]
    measured = notes.select("doc_id", *(measure(F.col("text")).alias(n) for n, (measure, _) in zip(names, validators, strict=True)))
    row = lambda s, r, c, d: F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), (F.lit("") if d is None else F.coalesce(d.cast("string"), F.lit(""))).alias("detail")))
    rows = [row(*check) for n, (_, checks) in zip(names, validators, strict=True) for check in checks(lambda f, n=n: F.col(f"{n}.{f}"))]
    return measured.select("doc_id", F.inline(F.filter(F.array(*rows), lambda f: f.isNotNull())))


def headings(notes: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title) of headings outside code, tables and frontmatter."""
    rows = ln.lines(notes).where(F.col("region").isin(ln.PROSE, ln.REFERENCES) & F.col("line").rlike(r"^#{1,6}\s+\S"))
    return rows.select("doc_id", "line_no", F.length(F.regexp_extract("line", r"^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"))


def _heading_measures(text: Column) -> Column:
    shown = ln.with_regions(F.split(text, "\n", -1), lambda x, c: F.when(c.isin(ln.PROSE, ln.REFERENCES) & x.rlike(r"^#{1,6}\s+\S"), x))
    level = lambda x: F.length(F.regexp_extract(x, r"^(#+)", 1))
    title = lambda x: F.lower(F.trim(F.regexp_replace(x, r"^#{1,6}\s+", "")))
    n = lambda rows, f: F.size(F.filter(rows, f))
    return let(
        F.filter(shown, lambda x: x.isNotNull()),
        lambda rows: F.struct(n(rows, lambda x: level(x) == 1).alias("h1"), n(rows, lambda x: (title(x) == "abstract") & (level(x) != 2)).alias("abstract"), n(rows, lambda x: title(x).isin(*MAIN_SECTIONS) & (level(x) == 1)).alias("main")),
    )


HEADINGS = (_heading_measures, lambda m: [("error", "one_h1", m("h1") != 1, m("h1")), ("error", "abstract_h2", m("abstract") > 0, m("abstract")), ("error", "section_h1", m("main") > 0, m("main"))])


def _frontmatter_measures(text: Column) -> Column:
    return F.struct(
        text.rlike(tx.FRONTMATTER).alias("has"),
        text.rlike(r"\A\s+---").alias("late"),
        tx.frontmatter_value(text, "title").isNull().alias("untitled"),
        (F.size(tx.yaml_list(text, "aliases")) == 0).alias("unaliased"),
        tx.frontmatter(text).rlike(r"(?m):[ \t]*\"[A-Za-z]:\\").alias("windows"),
    )


FRONTMATTER = (
    _frontmatter_measures,
    lambda m: [
        ("error", "frontmatter_missing", ~m("has") & ~m("late"), None),
        ("error", "frontmatter_not_first", ~m("has") & m("late"), None),
        ("error", "title_missing", m("has") & m("untitled"), None),
        ("warning", "aliases_missing", m("has") & m("unaliased"), None),
        ("warning", "windows_path", m("windows"), None),
    ],
)


def _reference_measures(text: Column) -> Column:
    def measure(p: Column) -> Column:
        body = F.concat(p["before"], p["after"])
        numbers = tx.reference_numbers(p["section"])
        cited = F.transform(find_all(body, r"\[\[#\^ref-(\d{1,9})\|", 1), lambda n: n.cast("int"))
        notes = F.transform(find_all(body, r"\[\^(\d{1,9})\]", 1), lambda n: n.cast("int"))
        counted = lambda plain: F.struct(
            count(plain, citations.NAMED).alias("named"),
            F.size(F.array_except(cited, numbers)).alias("dangling"),
            F.size(F.array_intersect(notes, numbers)).alias("footnotes"),
            F.size(F.filter(find_all(body, r"(?m)^(?:>[ \t]*)?\[\^\d{1,9}\]:[ \t]*(.*)$", 1), tx.looks_bibliographic)).alias("bibliographic"),
            F.size(numbers).alias("entries"),
            F.size(F.array_distinct(numbers)).alias("distinct"),
            count(p["section"], r"(?m)\^ref-\d+[ \t]*$").alias("blocks"),
            count(plain, citations.NUMBER_LIST).alias("raw"),
            count(plain, citations.AUTHOR_YEAR).alias("years"),
            count(body, r"\]\]\s*,\s*\[\[#\^ref-").alias("commas"),
        )
        return let(F.array_join(gaps(body), " "), counted)

    return let(tx.split_references(text), measure)


REFERENCES = (
    _reference_measures,
    lambda m: [
        ("error", "named_keys_left", m("named") > 0, m("named")),
        ("error", "dangling_links", m("dangling") > 0, m("dangling")),
        ("error", "block_ids_missing", m("entries") != m("blocks"), m("entries")),
        ("error", "raw_numbers_left", m("raw") > 0, m("raw")),
        ("error", "bibliographic_footnotes_left", m("bibliographic") > 0, m("bibliographic")),
        ("error", "footnotes_of_entries", m("footnotes") > 0, m("footnotes")),
        ("warning", "author_years_left", m("years") > 0, m("years")),
        ("warning", "baseline_commas", m("commas") > 0, m("commas")),
        ("warning", "duplicate_numbers", m("entries") != m("distinct"), m("entries")),
    ],
)


def _text_measures(text: Column) -> Column:
    return let(
        F.array_join(gaps(text, PROTECTED), " "),
        lambda prose: F.struct(
            count(text, r"\$\$").alias("display"),
            count(text, r"(?m)^[ \t]*```").alias("fences"),
            tx.mojibake_score(text).alias("mojibake"),
            text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]").alias("control"),
            text.rlike(r"(?i)(?:/tmp/|\\temp\\|/images/)").alias("temporary"),
            prose.rlike(r"</?(?:table|tr|td|div|span|nav)\b").alias("html"),
            prose.contains("\\(").alias("tex"),
            (count(F.regexp_replace(text, r"\$\$|\\\$", ""), r"\$") % 2 == 1).alias("dollars"),
        ),
    )


WHOLE_TEXT = (
    _text_measures,
    lambda m: [
        ("error", "odd_display_math", m("display") % 2 == 1, m("display")),
        ("error", "odd_fences", m("fences") % 2 == 1, m("fences")),
        ("error", "mojibake", m("mojibake") > 0, m("mojibake")),
        ("error", "control_characters", m("control"), None),
        ("error", "temporary_path", m("temporary"), None),
        ("warning", "html_tags", m("html"), None),
        ("warning", "tex_parentheses", m("tex"), None),
        ("warning", "odd_dollars", m("dollars"), None),
    ],
)


def images(roots: tuple[str, ...] = ("_resources", "_附件", "images")):
    absolute = r"^(?:/|[A-Za-z]:[\\/]|file:)"
    inside = "^(?:https?:|data:|" + "|".join(f"{r}/" for r in roots) + ")"

    def measure(text: Column) -> Column:
        n = lambda targets, f: F.size(F.filter(targets, f))
        return let(
            find_all(text, r"!\[[^\]]*\]\(([^)\r\n]+)\)", 1),
            lambda found: F.struct(n(found, lambda t: t.rlike(absolute)).alias("absolute"), n(found, lambda t: ~t.rlike(absolute) & ~t.rlike(inside)).alias("outside"), n(found, lambda t: t.rlike("^https?:")).alias("remote")),
        )

    return measure, lambda m: [("error", "absolute_image", m("absolute") > 0, m("absolute")), ("warning", "image_outside_roots", m("outside") > 0, m("outside")), ("warning", "remote_image", m("remote") > 0, m("remote"))]


def workflow_record(least: int = 10):
    def measure(text: Column) -> Column:
        bilingual = (count(text, r"(?m)^> ") >= least) & (F.size(F.filter(F.split(text, "\n"), lambda x: tx.has_cjk(x) & ~x.startswith(">"))) >= least)
        return F.struct((bilingual & tx.frontmatter_value(text, "translation_skill").isNull()).alias("lost"))

    return measure, lambda m: [("error", "provenance_missing", m("lost"), None)]


#: How files of image formats begin, in hexadecimal.
SIGNATURES = ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A", "52494646........57454250", "0000....66747970(?:61766966|61766973|68656963|6D696631)")


def image_problems(notes: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("_resources", "_附件"), remote_allowed: bool = False) -> DataFrame:
    """(doc_id, source, problem) of images of notes (doc_id, path, text) that don't hold.

    ``files`` has the vault's files (path, content), of which the first bytes are read.  Problems,
    the first that fits: absolute, outside (of the resource folders, seen from the note's folder),
    missing, undecodable (not one known image format; SVG isn't one, as for an image decoder).
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    sources = F.array_distinct(F.transform(find_all(F.col("text"), r"!\[[^\]]*\]\(([^)\r\n]+)\)", 1), lambda s: F.regexp_replace(s, r"^[<>]+|[<>]+$", "")))
    asked = notes.select("doc_id", folder.alias("folder"), F.explode(sources).alias("source"))
    remote = F.col("source").rlike(r"(?i)^(?:https?:|data:|#)")
    if remote_allowed:
        asked = asked.where(~remote)
    step = lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), s), -1) != ".."), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p))
    walked = F.aggregate(F.filter(F.split(F.concat_ws("/", "folder", "source"), "/"), lambda p: ~p.isin("", ".")), F.array().cast("array<string>"), step)
    asked = asked.withColumn("resolved", F.array_join(walked, "/"))
    held = files.select(F.col("path").alias("resolved"), F.hex(F.substring("content", 1, 16)).alias("head"), F.lit(True).alias("there")).dropDuplicates(["resolved"])
    inside = F.exists(F.array(*(F.lit(f"{r}/") for r in roots)), lambda r: F.col("resolved").startswith(r))
    problem = (
        F.when(F.col("source").rlike(r"^(?:[A-Za-z]:[\\/]|/)"), "absolute")
        .when(remote | ~inside, "outside")
        .when(F.col("there").isNull(), "missing")
        .when(~F.coalesce(F.col("head"), F.lit("")).rlike(f"^(?:{'|'.join(SIGNATURES)})"), "undecodable")
    )
    return asked.join(held, "resolved", "left").select("doc_id", "source", problem.alias("problem")).where("problem IS NOT NULL")


def validate_headings(notes: DataFrame) -> DataFrame:
    return _findings(notes, HEADINGS)


def validate_frontmatter(notes: DataFrame) -> DataFrame:
    return _findings(notes, FRONTMATTER)


def validate_references(notes: DataFrame) -> DataFrame:
    return _findings(notes, REFERENCES)


def validate_text(notes: DataFrame) -> DataFrame:
    return _findings(notes, WHOLE_TEXT)


def validate_images(notes: DataFrame, roots: tuple[str, ...] = ("_resources", "_附件", "images")) -> DataFrame:
    return _findings(notes, images(roots))


def validate_workflow_record(notes: DataFrame, least: int = 10) -> DataFrame:
    return _findings(notes, workflow_record(least))


def citation_placement(notes: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_links, position): lines whose citations pile up at the end.

    At least three links in the trailing cluster, all past 55 % of the line, unless the previous
    content line starts its own before 85 %.
    """
    link = r"\[\[#\^ref-\d+\|[^\]]+\]\]"
    rows = ln.lines(notes).where((F.col("region") == ln.PROSE) & (F.trim("line") != "") & ~F.col("line").rlike(r"^#{1,6}\s"))
    placed = rows.select("doc_id", "line_no", "line", F.regexp_count("line", F.lit(link)).cast("long").alias("n_links"), (F.when(F.col("line").rlike(link), F.length(F.regexp_extract("line", rf"^(.*?){link}", 1))) / F.length("line")).alias("position"))
    before = F.lag("position").over(Window.partitionBy("doc_id").orderBy("line_no"))
    flagged = placed.withColumn("before", before)
    cluster = F.col("line").rlike(rf"(?:{link}(?:<sup>,</sup>|[\s,])*){{3,}}[.。]?\s*$")
    return flagged.where(cluster & (F.col("n_links") >= 3) & (F.col("position") > 0.55) & ~F.coalesce(F.col("before") < 0.85, F.lit(False))).select("doc_id", "line_no", "n_links", F.round("position", 3).alias("position"))


def bilingual_layout(units: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, n_units, n_found, n_translated): quotes found in order, with Chinese before the next.

    One cursor walks each note; a quote counts if it stands at or after the previous one.
    """
    per = units.where("requires_translation").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_order", tx.blockquote(F.col("english")).alias("quote")))).alias("quotes"))
    joined = notes.join(per, "doc_id")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("chinese"), F.lit(False).alias("open"))

    def walk(s: Column, q: Column) -> Column:
        where = F.call_function("locate", q["quote"], F.col("text"), s["at"])
        hit = where > 0
        between = F.substring(F.col("text"), s["at"], F.when(hit, where - s["at"]).otherwise(0))
        return F.struct(
            F.when(hit, where + F.length(q["quote"])).otherwise(s["at"]).alias("at"),
            (s["found"] + hit.cast("long")).alias("found"),
            (s["chinese"] + (hit & s["open"] & tx.has_cjk(between)).cast("long")).alias("chinese"),
            (s["open"] | hit).alias("open"),
        )

    final = F.aggregate("quotes", start, walk)
    last = F.col("f.open") & tx.has_cjk(F.substring(F.col("text"), F.col("f.at"), F.lit(2**31 - 1)))
    return joined.select("doc_id", "text", F.size("quotes").cast("long").alias("n_units"), final.alias("f")).select("doc_id", "n_units", F.col("f.found").alias("n_found"), (F.col("f.chinese") + last.cast("long")).alias("n_translated"))


def note_findings(notes: DataFrame) -> DataFrame:
    """All single-note validators' findings, from one pass over each note."""
    return _findings(notes, HEADINGS, FRONTMATTER, REFERENCES, WHOLE_TEXT, images(), workflow_record())


def readiness(notes: DataFrame) -> DataFrame:
    """(doc_id, n_errors, n_warnings, ready)."""
    per = note_findings(notes).groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    joined = notes.select("doc_id").join(per, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("e", F.lit(0)).cast("long").alias("n_errors"), F.coalesce("w", F.lit(0)).cast("long").alias("n_warnings"), (F.coalesce("e", F.lit(0)) == 0).alias("ready"))


def document_metrics(notes: DataFrame) -> DataFrame:
    """(doc_id, n_quotes, n_chinese, n_formulas, n_display, n_images, n_citations, n_blocks, sha256)."""
    text = F.col("text")
    rows = F.split("text", "\n", -1)
    return notes.select(
        "doc_id",
        count(text, r"(?m)^>").alias("n_quotes"),
        F.size(F.filter(rows, lambda x: tx.has_cjk(x) & ~x.startswith(">"))).cast("long").alias("n_chinese"),
        F.aggregate(gaps(text, r"\$\$"), F.lit(0).cast("long"), lambda n, g: n + F.regexp_count(g, F.lit(r"\$[^$\n]+\$"))).alias("n_formulas"),
        count(text, r"\$\$").alias("n_display"),
        count(text, r"!\[").alias("n_images"),
        count(text, r"\[\[#\^ref-").alias("n_citations"),
        count(text, r"(?m)\^ref-\d+[ \t]*$").alias("n_blocks"),
        tx.sha256_text(text).alias("sha256"),
    )


def apply_line_edits(notes: DataFrame, edits: DataFrame, allowed: tuple[str, ...] = ("whitespace", "heading", "list", "punctuation")) -> DataFrame:
    """(doc_id, text, errors): edits (doc_id, line, type, before, after, source_sha256) applied if all of a note's hold.

    An edit must name an allowed type, a line once, the exact line before, and the hash of the text.
    """
    per = edits.groupBy("doc_id").agg(F.collect_list(F.struct("line", "type", "before", "after", "source_sha256")).alias("_edits"))
    joined = notes.join(per, "doc_id", "left").withColumn("_rows", F.split("text", "\n", -1))
    checks = {
        "stale_hash": let(tx.sha256_text(F.col("text")), lambda h: F.exists("_edits", lambda e: e["source_sha256"] != h)),
        "unknown_type": F.exists("_edits", lambda e: ~e["type"].isin(*allowed)),
        "duplicate_line": F.size(F.array_distinct(F.transform("_edits", lambda e: e["line"]))) < F.size("_edits"),
        "before_differs": F.exists("_edits", lambda e: ~F.try_element_at("_rows", e["line"].cast("int")).eqNullSafe(e["before"])),
        "line_break": F.exists("_edits", lambda e: e["after"].contains("\n")),
    }
    errors = F.coalesce(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda e: e.isNotNull()), F.array().cast("array<string>"))
    table = F.map_from_entries(F.transform("_edits", lambda e: F.struct(e["line"].cast("int"), e["after"])))
    edited = let(table, lambda t: ln.join_lines(F.transform("_rows", lambda x, i: F.coalesce(F.try_element_at(t, i + 1), x))))
    fine = lambda e: F.when(F.col("_edits").isNotNull() & (F.size(e) == 0), edited).otherwise(F.col("text"))
    out = let(errors, lambda e: F.struct(e.alias("errors"), fine(e).alias("text")))
    return joined.select("doc_id", out.alias("r")).select("doc_id", "r.text", "r.errors")


def broken_figure_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    rows = ln.lines(notes)
    shown = r"(?<!!)\[((?:Figure|Fig\.?|图)[^\]\n]*)\]\(([^)\n]+)\)"
    links = rows.where(F.col("region") == ln.PROSE).select("doc_id", "line_no", F.explode(find_all(F.col("line"), shown)).alias("m")).select("doc_id", "line_no", F.regexp_extract("m", shown, 1).alias("display"), F.regexp_extract("m", shown, 2).alias("target"))
    return figures.broken_links(links, figures.figure_targets(notes), files)
