"""All queries of the engine's own operators, by name, and their SQL twins.

Notes come from the Markdown view of ``documents``; every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import python_udfs as py
from lectern.functions import text as tx
from lectern.operators import assets
from lectern.operators import citations as ci
from lectern.operators import cleaning as cl
from lectern.operators import figures as fi
from lectern.operators import handoff as ho
from lectern.operators import knowledge as kn
from lectern.operators import lines as ln
from lectern.operators import units as un
from lectern.operators import validators as va
from lectern.operators import workflow as wf
from lectern.plans import oracles as sql
from lectern.sources.markdown_view import markdown_view as notes
from lectern.sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under ``name`` with its SQL twin."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


#: The tables of whole texts, by the column that deals small files out.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, _TEXTS[name]) if name in _TEXTS else rows


def sha(column: str = "text", name: str = "sha256"):
    return tx.sha256_text(F.col(column)).alias(name)


# --- lines, regions, headings, cleaning -----------------------------------------------------


@query("lines_exploded", sql.LINES)
def lines_exploded(spark, d):
    return ln.lines(notes(spark, d)).select("doc_id", "line_no", "line")


@query("region_flags_by_line", sql.REGIONS)
def region_flags_by_line(spark, d):
    return ln.lines(notes(spark, d)).select("doc_id", "line_no", "region")


@query("section_of_line", sql.SECTIONS)
def section_of_line(spark, d):
    return ln.sections(ln.lines(notes(spark, d))).select("doc_id", "line_no", "section")


@query("heading_levels_normalized", sql.HEADINGS)
def heading_levels_normalized(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(cl.normalize_headings(F.col("text"))).alias("sha256"))


@query("mixed_images_repaired", sql.MIXED_IMAGES)
def mixed_images_repaired(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(cl.repair_mixed_images(F.col("text"))).alias("sha256"))


@query("web_noise_removed", sql.NOISE_MD)
def web_noise_removed(spark, d):
    out = cl.filter_web_noise(notes(spark, d))
    n = lambda r: F.size(F.filter("removed", lambda x: x["reason"] == r)).cast("long")
    return out.select("doc_id", sha(), F.size("removed").cast("long").alias("n_removed"), n("html_site_chrome").alias("n_chrome"), n("known_navigation_label").alias("n_labels"), n("pre_title_navigation").alias("n_pre_title"))


@query("page_noise_removed", sql.NOISE_PAGES)
def page_noise_removed(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))
    return cl.filter_web_noise(pages).select(F.col("doc_id").alias("page_id"), F.size("removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"))


@query("mojibake_score", sql.MOJIBAKE)
def mojibake_score(spark, d):
    return notes(spark, d).select("doc_id", tx.mojibake_score(F.col("text")).alias("score"))


@query("mojibake_repaired", sql.MOJIBAKE_REPAIRED)
def mojibake_repaired(spark, d):
    fixed = notes(spark, d).withColumn("fixed", py.repair_mojibake("text"))
    return fixed.select("doc_id", tx.mojibake_score(F.col("fixed")).alias("residual"), (F.col("fixed") != F.col("text")).alias("changed"), sha("fixed"))


@query("caption_math_normalized", sql.CAPTIONS)
def caption_math_normalized(spark, d):
    report = notes(spark, d).select("doc_id", cl.caption_report(F.col("text")).alias("r"))
    return report.select("doc_id", sha("r.text"), "r.captions", "r.fixed", F.size("r.residual").cast("long").alias("residual"))


@query("frontmatter_fields", sql.FRONTMATTER)
def frontmatter_fields(spark, d):
    text = F.col("text")
    return notes(spark, d).select("doc_id", tx.frontmatter_value(text, "title").alias("title"), F.array_join(tx.yaml_list(text, "aliases"), ";").alias("aliases"), F.array_join(tx.yaml_list(text, "tags"), ";").alias("tags"))


@query("frontmatter_ensured", sql.FRONTMATTER_ENSURED)
def frontmatter_ensured(spark, d):
    text = F.col("text")
    return notes(spark, d).select("doc_id", tx.sha256_text(cl.ensure_frontmatter(text, tx.title(text, F.lit("Untitled")), {"status": "clean"})).alias("sha256"))


@query("bilingual_pairs", sql.BILINGUAL)
def bilingual_pairs(spark, d):
    return cl.bilingual_pairs(notes(spark, d)).select("doc_id", "english", "chinese")


@query("bilingual_pairs_collapsed", sql.BILINGUAL_COLLAPSED)
def bilingual_pairs_collapsed(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(cl.collapse_bilingual(F.col("text"))).alias("sha256"))


@query("html_tables_extracted", sql.TABLES)
def html_tables_extracted(spark, d):
    return cl.html_tables(notes(spark, d))


@query("html_tables_classified", sql.TABLES_CLASSIFIED)
def html_tables_classified(spark, d):
    return cl.classify_tables(cl.html_tables(notes(spark, d))).select("doc_id", "table_no", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_columns").cast("long").alias("n_columns"), F.array_join("flags", ",").alias("flags"), "status")


@query("html_tables_to_markdown", sql.TABLES_MD)
def html_tables_to_markdown(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(py.tables_to_markdown("text")).alias("sha256"))


@query("unmatched_table_tags", sql.UNMATCHED)
def unmatched_table_tags(spark, d):
    return notes(spark, d).select("doc_id", cl.unmatched_table_tags(F.col("text")).alias("n"))


# --- citations ------------------------------------------------------------------------------


@query("footnote_definitions", sql.FOOTNOTES)
def footnote_definitions(spark, d):
    return ci.footnote_definitions(ln.lines(ci.with_footnotes(notes(spark, d)))).select("doc_id", "label", "content", "quoted")


@query("citation_footnotes_classified", sql.FOOTNOTES_CLASSIFIED)
def citation_footnotes_classified(spark, d):
    return ci.classify_footnotes(ci.footnote_definitions(ln.lines(ci.with_footnotes(notes(spark, d)))))


@query("footnotes_to_references", sql.FOOTNOTES_MOVED)
def footnotes_to_references(spark, d):
    # Every other note's footnotes have numbers of their own, and one of them is called.
    text = F.col("text")
    for old, new in (("[^1]:", "[^11]:"), ("[^3]:", "[^13]:"), ("- item two", "- item two[^11]")):
        text = F.replace(text, F.lit(old), F.lit(new))
    renumbered = notes(spark, d).withColumn("text", F.when(F.col("doc_id") % 10 == 2, text).otherwise(F.col("text")))
    out = ci.footnotes_to_references(renumbered)
    return out.select("doc_id", F.array_join(F.transform("conflicts", lambda c: c.cast("string")), ",").alias("conflicts"), sha())


@query("reference_entries", sql.REFERENCES)
def reference_entries(spark, d):
    return ci.reference_entries(notes(spark, d))


@query("references_structured", sql.REFERENCES_STRUCTURED)
def references_structured(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(ci.structure_references(F.col("text"))).alias("sha256"))


@query("citations_linked", sql.CITATIONS)
def citations_linked(spark, d):
    return ci.citation_counts(notes(spark, d))


@query("citations_linked_text", sql.CITATIONS_TEXT)
def citations_linked_text(spark, d):
    return ci.link_citations(notes(spark, d)).select("doc_id", sha())


@query("author_year_keys", sql.AUTHOR_YEARS)
def author_year_keys(spark, d):
    return ci.author_keys(ci.reference_entries(notes(spark, d)))


@query("named_citation_keys_ranked", sql.NAMED)
def named_citation_keys_ranked(spark, d):
    return ci.named_keys(notes(spark, d))


@query("named_citations_resolved", sql.NAMED_RESOLVED)
def named_citations_resolved(spark, d):
    entries = spark.createDataFrame([("doe2001", "Doe. One. 2001"), ("roe2002", "Roe. Two. 2002")], "key string, entry string")
    out, _ = ci.resolve_named(notes(spark, d), entries)
    return out.select("doc_id", sha())


@query("dangling_citations", sql.DANGLING)
def dangling_citations(spark, d):
    return ci.dangling_citations(notes(spark, d))


@query("subject_labels_unescaped", sql.SUBJECTS)
def subject_labels_unescaped(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(ci.unescape_subjects(F.col("text"))).alias("sha256"))


@query("table_pipes_escaped", sql.PIPES)
def table_pipes_escaped(spark, d):
    return ci.escape_table_pipes(notes(spark, d)).select("doc_id", sha())


@query("citations_normalized", sql.NORMALIZED)
def citations_normalized(spark, d):
    entries = spark.createDataFrame([("doe2001", "Doe. One. 2001"), ("roe2002", "Roe. Two. 2002")], "key string, entry string")
    return ci.normalize_citations(notes(spark, d), entries).select("doc_id", sha())


# --- figures --------------------------------------------------------------------------------


@query("figure_targets", sql.FIGURES)
def figure_targets(spark, d):
    repaired = notes(spark, d).withColumn("text", cl.repair_mixed_images(F.col("text")))
    return fi.figure_targets(repaired).select("doc_id", "figure_id", "target", "status")


@query("figure_mentions_linked", sql.MENTIONS)
def figure_mentions_linked(spark, d):
    repaired = notes(spark, d).withColumn("text", cl.repair_mixed_images(F.col("text")))
    return fi.mentions(ln.lines(repaired), fi.figure_targets(repaired)).groupBy("doc_id", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("figures_linked_text", sql.FIGURES_TEXT)
def figures_linked_text(spark, d):
    repaired = notes(spark, d).withColumn("text", cl.repair_mixed_images(F.col("text")))
    return fi.link_figures(repaired).select("doc_id", sha())


@query("orphan_fragment_links", sql.ORPHANS)
def orphan_fragment_links(spark, d):
    return fi.orphan_fragments(notes(spark, d))


@query("orphan_fragments_stripped", sql.ORPHANS_STRIPPED)
def orphan_fragments_stripped(spark, d):
    return notes(spark, d).select("doc_id", tx.sha256_text(fi.strip_orphan_fragments(F.col("text"))).alias("sha256"))


@query("broken_figure_links", sql.BROKEN)
def broken_figure_links(spark, d):
    linked = notes(spark, d).withColumn("text", F.concat("text", F.expr("chr(10) || '## Tail' || chr(10) || chr(10) || 'See [Figure 1](images/f' || CAST(doc_id % 9 AS STRING) || '.png), [Figure 7](/abs.png) and [Figure 1](missing.png).' || chr(10)")))
    files = linked.select(F.expr("'images/f' || CAST(doc_id % 9 AS STRING) || '.png'").alias("path")).distinct()
    return va.broken_figure_links(linked, files).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- units, packets, cache ------------------------------------------------------------------


@query("translation_units", sql.UNITS)
def translation_units(spark, d):
    return un.translation_units(notes(spark, d)).select("doc_id", "unit_id", "kind", "source_sha256")


@query("passthrough_units", sql.PASSTHROUGH)
def passthrough_units(spark, d):
    return un.translation_units(notes(spark, d)).where("NOT requires_translation").select("doc_id", "unit_id", "english", "reason")


@query("packet_summary", sql.PACKETS)
def packet_summary(spark, d):
    return un.packet_summary(un.translation_units(notes(spark, d)))


@query("protected_token_roundtrip", sql.ROUNDTRIP)
def protected_token_roundtrip(spark, d):
    rows = un.restore(un.protect(un.translation_units(notes(spark, d))))
    return rows.groupBy("doc_id").agg(F.bool_and(F.col("restored") == F.col("english")).alias("same"), F.bool_and("intact").alias("intact"))


@query("reference_title_inference")
def reference_title_inference(spark, d):
    rows = ci.reference_entries(notes(spark, d)).withColumn("t", un.infer_title(F.col("entry")))
    return rows.select("doc_id", "number", F.col("t.title").alias("title"), F.col("t.mode").alias("mode"))


def _document_units(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("unit_id"), "doc_id", F.col("text").alias("english"), tx.sha256_text(F.col("text")).alias("source_sha256"), F.lit("paragraph").alias("kind"), F.lit(True).alias("requires_translation"))


def _label_cache(spark, d) -> DataFrame:
    """The labelled documents' texts as cache rows: toxic ones unverified, quality as tier."""
    rows = _document_units(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rows.select(un.cache_key(F.col("source_sha256"), F.col("kind")).alias("cache_key"), F.concat(F.lit("译"), "unit_id").alias("zh"), F.col("kind").alias("unit_kind"), (F.coalesce("toxic", F.lit(0)) == 0).alias("runtime_verified"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("quality_tier"), F.col("doc_id").alias("seq"))


@query("pending_vs_cached", sql.PENDING)
def pending_vs_cached(spark, d):
    cached, pending = un.split_by_cache(_document_units(spark, d), un.eligible_cache(_label_cache(spark, d), "medium"))
    return cached.select("doc_id", F.lit("cached").alias("state")).unionByName(pending.select("doc_id", F.lit("pending").alias("state")))


@query("cache_upsert_latest", sql.UPSERT)
def cache_upsert_latest(spark, d):
    rows = _label_cache(spark, d)
    return un.append_cache(rows.where("seq % 2 = 0 AND runtime_verified"), rows.where("seq % 2 = 1")).select("cache_key", "zh")


def _results(spark, d) -> DataFrame:
    """Worker results made of the labels: toxic ones empty, poor ones without CJK, some unknown or twice."""
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("unit_id"), F.when(F.col("toxic") == 1, "").when(F.col("quality") == 0, "no").otherwise("译文").alias("zh"), "doc_id")
    twice = rows.where("doc_id % 10 = 3")
    unknown = rows.where("doc_id % 10 = 4").withColumn("unit_id", F.concat(F.lit("x"), "unit_id"))
    return rows.unionByName(twice).unionByName(unknown).select("unit_id", "zh")


@query("output_contract_errors", sql.CONTRACT)
def output_contract_errors(spark, d):
    units = _document_units(spark, d).withColumn("english", F.regexp_replace("english", r"[$*_\[\]`]", ""))
    return un.output_errors(units, _results(spark, d)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("combined_output_union", sql.COMBINED)
def combined_output_union(spark, d):
    cached = _document_units(spark, d).select("unit_id", F.lit("旧").alias("zh"))
    return un.combine_outputs(cached, _results(spark, d).distinct())


@query("import_status", sql.IMPORT)
def import_status(spark, d):
    units = _document_units(spark, d).withColumn("english", F.regexp_replace("english", r"[$*_\[\]`]", ""))
    return un.import_status(units, _results(spark, d))


@query("merged_notes", sql.MERGED)
def merged_notes(spark, d):
    units = un.translation_units(notes(spark, d))
    done = units.where("requires_translation").select("doc_id", "unit_id", F.concat(F.lit("译文 "), "unit_id").alias("zh"))
    return un.merge_notes(notes(spark, d), done).select("doc_id", "complete", sha())


# --- concepts, bibliography, layout, assets -------------------------------------------------


def _vault(spark, d) -> DataFrame:
    """One concept note per part, named as the part is, with its brand as an alias."""
    part = spread(table(spark, d, "part"), "p_partkey")
    return part.select(F.expr("'concepts/' || p_name || '.md'").alias("path"), F.expr("'---' || chr(10) || 'aliases: [' || p_brand || ', ' || p_type || ' ' || CAST(p_partkey AS STRING) || ']' || chr(10) || '---' || chr(10) || '# ' || p_name || ' (size ' || CAST(p_size AS STRING) || ')' || chr(10)").alias("text"))


@query("concept_candidates", sql.CONCEPTS)
def concept_candidates(spark, d):
    return kn.concept_candidates(kn.note_surfaces(_vault(spark, d)))


@query("concept_links")
def concept_links(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    rows = notes(spark, d).join(part, F.col("doc_id") + 1 == F.col("p_partkey"), "left")
    text = F.concat("text", F.coalesce(F.concat(F.lit("\n## Concepts\n\n论 "), "p_name", F.lit("与 "), "p_name", F.lit(".\n")), F.lit("")))
    return kn.link_concepts(rows.select("doc_id", text.alias("text")), kn.concept_candidates(kn.note_surfaces(_vault(spark, d)))).select("doc_id", "linked")


def _bibliography(spark, d):
    """items, itemData, itemDataValues, fields, deletedItems and itemAttachments made of the part star."""
    part = table(spark, d, "part")
    items = part.select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"))
    data = part.select(F.col("p_partkey").alias("itemID"), F.lit(1).alias("fieldID"), F.col("p_partkey").alias("valueID")).unionByName(part.select(F.col("p_partkey").alias("itemID"), F.lit(2).alias("fieldID"), (-F.col("p_partkey")).alias("valueID")))
    values = part.select(F.col("p_partkey").alias("valueID"), F.col("p_name").alias("value")).unionByName(part.select((-F.col("p_partkey")).alias("valueID"), F.col("p_brand").alias("value")))
    fields = spark.createDataFrame([(1, "title"), (2, "publisher")], "fieldID int, fieldName string")
    deleted = part.where("p_size % 10 = 0").select(F.col("p_partkey").alias("itemID"))
    attachments = table(spark, d, "lineitem").select(F.col("l_partkey").alias("itemID"), F.col("l_suppkey").alias("parentItemID"), F.when(F.col("l_returnflag") == "R", "application/pdf").alias("contentType"), F.concat(F.lit("storage:"), "l_returnflag", F.when(F.col("l_linestatus") == "O", ".pdf").otherwise(".txt")).alias("path")).distinct()
    return items, data, values, fields, deleted, attachments


@query("bibliography_exact_title", sql.EXACT_TITLE)
def bibliography_exact_title(spark, d):
    items, data, values, fields, deleted, _ = _bibliography(spark, d)
    wanted = table(spark, d, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("wanted")).distinct()
    return kn.exact_title(kn._titles(items, data, values, fields, deleted), wanted)


@query("bibliography_candidates_top3", sql.TOP3)
def bibliography_candidates_top3(spark, d):
    items, data, values, fields, deleted, _ = _bibliography(spark, d)
    wanted = spark.createDataFrame([("Red Widget",), ("widget",), ("Ring of nothing",), ("gear",), ("no such title",)], "wanted string")
    return kn.title_candidates(kn._titles(items, data, values, fields, deleted), wanted).select("wanted", "key", "title", F.col("rank").cast("long").alias("rank"))


@query("attachments_for_item", sql.ATTACHMENTS)
def attachments_for_item(spark, d):
    items, _, _, _, deleted, attachments = _bibliography(spark, d)
    rows = kn.pdf_attachments(items, attachments, deleted)
    return rows.groupBy("parentItemID").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.min(kn.attachment_path(F.col("path"), "/data")).alias("first_path"))


@query("vault_source_resolution", sql.RESOLUTION)
def vault_source_resolution(spark, d):
    docs = table(spark, d, "documents")
    held = docs.select((F.col("doc_id") % 3).cast("int").alias("priority"), F.concat(F.lit("v/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("T "), (F.col("doc_id") % 500).cast("string")).alias("title"))
    wanted = docs.select(F.concat(F.lit("t  "), F.col("doc_id").cast("string")).alias("wanted"))
    return kn.resolve_in_directories(wanted, held)


@query("layout_float_recommendation", sql.LAYOUT)
def layout_float_recommendation(spark, d):
    return kn.float_recommendations(_boxes(spark, d)).drop("image_path").select("doc_id", "page", "width_fraction", "recommendation", "confidence")


def _boxes(spark, d) -> DataFrame:
    """A page per order: its first line is an image, the others are text blocks."""
    x0, y0 = F.expr("CAST((l_partkey % 5) * 100 AS DOUBLE)"), F.expr("CAST((l_suppkey % 7) * 40 AS DOUBLE)")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.when(F.col("l_linenumber") == 1, "image").otherwise("text").alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 120 + F.col("l_quantity") * 4).alias("x1"), (y0 + 30 + F.col("l_quantity")).alias("y1"), F.lit("i.png").alias("image_path"), F.lit("").alias("text"))
    return rows


@query("content_bounds", sql.BOUNDS)
def content_bounds(spark, d):
    return kn.content_bounds(_boxes(spark, d))


@query("asset_plan", sql.ASSETS)
def asset_plan(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.expr("'![logo](' || url || ') ![Figure 1](https://x.org/' || CAST(page_id % 20 AS STRING) || '.png)'").alias("text"))
    cache = spark.range(5).select(F.sha2(F.expr("'https://x.org/' || CAST(id AS STRING) || '.png'").cast("binary"), 256).alias("source_sha256"), F.expr("'a' || CAST(id AS STRING) || '.png'").alias("target_name"))
    return kn.asset_plan(kn.image_references(pages), cache).groupBy("status", "critical").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n_references").alias("n_references"))


@query("image_hashes")
def image_hashes(spark, d):
    return notes(spark, d).select("doc_id", py.image_hash(F.concat("path", F.lit(":/images/f.png"))).alias("hash"))


# --- validators and workflow ----------------------------------------------------------------


@query("document_metrics", sql.METRICS)
def document_metrics(spark, d):
    return va.document_metrics(notes(spark, d))


@query("note_findings", sql.FINDINGS)
def note_findings(spark, d):
    return va.note_findings(notes(spark, d)).select("doc_id", "severity", "rule")


@query("readiness", sql.READINESS)
def readiness(spark, d):
    return va.readiness(notes(spark, d))


@query("citation_placement", sql.PLACEMENT)
def citation_placement(spark, d):
    stacked = notes(spark, d).withColumn("text", F.concat("text", F.expr("chr(10) || CASE WHEN doc_id % 3 = 1 THEN '## More' || chr(10) || chr(10) || repeat('A claim that many works make, ', 5) || '[[#^ref-1|¹]]<sup>,</sup>[[#^ref-2|²]]<sup>,</sup>[[#^ref-3|³]].' ELSE '' END")))
    return va.citation_placement(stacked).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_links").alias("n_links"))


@query("bilingual_layout", sql.BILINGUAL_LAYOUT)
def bilingual_layout(spark, d):
    units = un.translation_units(notes(spark, d))
    done = units.where("requires_translation").select("doc_id", "unit_id", F.concat(F.lit("译文 "), "unit_id").alias("zh"))
    return va.bilingual_layout(units, un.merge(units, done).select("doc_id", "text"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("workflow_id"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 2 == 0, "started").otherwise("finished").alias("status"), "value")


@query("stage_durations", sql.DURATIONS)
def stage_durations(spark, d):
    return wf.stage_durations(_events(spark, d)).select("workflow_id", "stage", "duration_ms")


@query("workflow_state", sql.STATE)
def workflow_state(spark, d):
    return wf.current_state(_events(spark, d)).select("workflow_id", "stage", "status", "n_events")


@query("attempts_numbered", sql.ATTEMPTS)
def attempts_numbered(spark, d):
    return wf.number_attempts(_events(spark, d)).select("event_id", "attempt", "gap_ms")


@query("failures_classified", sql.FAILURES)
def failures_classified(spark, d):
    log = F.expr("CASE event_id % 4 WHEN 0 THEN 'Connection reset by peer' WHEN 1 THEN 'an unexpected EOF' ELSE 'odd' END")
    n = lambda m: F.col("event_id") % m
    rows = table(spark, d, "events").select(wf.classify_failure(n(6) == 0, F.when(n(5) == 0, 1).otherwise(0), n(7) != 0, log, n(3), n(2)).alias("f"))
    return rows.groupBy("f.stage", "f.failure", "f.retryable").agg(F.count(F.lit(1)).alias("n"))


@query("prepared_validation", sql.PREPARED)
def prepared_validation(spark, d):
    repaired = notes(spark, d).withColumn("text", cl.repair_mixed_images(F.col("text")))
    return ho.validate_prepared(repaired).select("doc_id", "ok", "ready_for_translation", *ho.COUNTERS)


@query("final_validation")
def final_validation(spark, d):
    before = notes(spark, d)
    body = ho.frozen_units(before)
    done = body.where("requires_translation AND unit_order % 7 <> 3").select("doc_id", "unit_id", F.concat(F.lit("译文 "), "unit_id").alias("zh"))
    titles = ci.reference_entries(before).where("number < 3").select("doc_id", "number", F.lit("题").alias("zh"))
    merged = un.merge_notes(before, done, titles).select("doc_id", "text")
    return ho.validate_final(merged, ho.freeze(before), body).select("doc_id", "ok", "placeholders", F.array_join("errors", ",").alias("errors"))


@query("assignment_manifests", sql.ASSIGNMENTS)
def assignment_manifests(spark, d):
    packets = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("packet"), F.col("n_chars").alias("unit_count"))
    path = lambda kind: F.concat(F.lit(f"/w/{kind}/"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    return ho.assignments(packets, ho.identity("Translate.", "m1", "high", ("c1", "t1")), path("in"), path("out"))


@query("leading_math_restored", sql.LEADING_MATH)
def leading_math_restored(spark, d):
    source = F.expr("'$' || chr(92) || 'alpha_{' || CAST(doc_id % 3 AS STRING) || '}$ of ' || source")
    shown = F.expr("CASE doc_id % 4 WHEN 0 THEN 'α' WHEN 1 THEN '<sub>1</sub> ' WHEN 2 THEN 'beta ' ELSE '' END || '的研究 α'")
    return table(spark, d, "documents").select("doc_id", ho.restore_leading_math(source, shown).alias("title"))


@query("config_drift", sql.DRIFT)
def config_drift(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("text"))
    found = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("path"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_name END").alias("text"))
    return ho.config_drift(rows, found)


@query("incremental_index", sql.INCREMENTAL)
def incremental_index(spark, d):
    docs = table(spark, d, "documents")
    listing = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    index = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 4 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    fresh, stale = wf.changed_since(listing, index)
    return fresh.select("path", F.lit("reused").alias("state")).unionByName(stale.select("path", F.lit("read").alias("state")))


@query("backup_retention", sql.RETENTION)
def backup_retention(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderstatus").alias("label"), F.col("o_orderdate").alias("mtime"), F.col("o_orderkey").cast("string").alias("file"))
    return wf.retention(files).select("name", "label", "file")


@query("frozen_artifact_errors", sql.FROZEN)
def frozen_artifact_errors(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id"), F.col("c_mktsegment").alias("artifact"), F.col("c_name").alias("sha256"))
    now = rows.where("workflow_id % 5 <> 0").withColumn("sha256", F.when(F.col("workflow_id") % 5 == 1, "x").otherwise(F.col("sha256")))
    return wf.frozen_errors(rows, now)


@query("line_edits_applied", sql.EDITS)
def line_edits_applied(spark, d):
    rows = notes(spark, d)
    lines = ln.lines(rows).where(F.col("line") == "- item one")
    edits = lines.join(rows.select("doc_id", tx.sha256_text(F.col("text")).alias("source_sha256")), "doc_id").select("doc_id", F.col("line_no").alias("line"), F.when(F.col("doc_id") % 5 == 0, "rename").otherwise("list").alias("type"), F.when(F.col("doc_id") % 7 == 0, "- other").otherwise("- item one").alias("before"), F.lit("* item one").alias("after"), "source_sha256")
    out = va.apply_line_edits(rows, edits)
    return out.select("doc_id", F.array_join("errors", ",").alias("errors"), sha())


@query("migration_totals", sql.MIGRATION)
def migration_totals(spark, d):
    before = notes(spark, d)
    return wf.migration_totals(before, before.select("doc_id", cl.repair_mixed_images(F.col("text")).alias("text")))


@query("chunk_counts_by_source", sql.BY_SOURCE)
def chunk_counts_by_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    units = un.translation_units(notes(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(units, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_units"))


@query("slugs_and_titles", sql.SLUGS)
def slugs_and_titles(spark, d):
    title = tx.title(F.col("text"), F.lit(""))
    return notes(spark, d).select("doc_id", tx.slugify(title).alias("slug"), tx.clean_title(F.concat(title, F.lit(": a/b?"))).alias("clean"))


@query("table_triage", sql.TRIAGE)
def table_triage(spark, d):
    return cl.table_triage(notes(spark, d))


@query("concept_notes", sql.CONCEPT_NOTES)
def concept_notes(spark, d):
    return kn.concept_notes(notes(spark, d), "notes/3.md").select("path", sha())


@query("reference_number_sets", sql.NUMBER_SETS)
def reference_number_sets(spark, d):
    rows = notes(spark, d).withColumn("p", tx.split_references(F.col("text")))
    entries = rows.select("doc_id", F.explode(tx.reference_numbers(F.col("p.section"))).alias("number"))
    linked = rows.select("doc_id", F.explode(F.regexp_extract_all(F.concat("p.before", "p.after"), F.lit(r"\^ref-(\d{1,9})\|"), F.lit(1))).alias("number"))
    return un.same_numbers(entries, linked.withColumn("number", F.col("number").cast("int")))


@query("valid_partial_units", sql.VALID_UNITS)
def valid_partial_units(spark, d):
    units = _document_units(spark, d).withColumn("english", F.regexp_replace("english", r"[$*_\[\]`]", ""))
    return un.valid_units(units, _results(spark, d))


@query("review_occurrences", sql.REVIEW)
def review_occurrences(spark, d):
    asked = spark.createDataFrame([("references", "R", "heading", False), ("ICRA2024", "I", "heading", False), ("Paper 1", "P", "heading", False), ("see", "S", "stem", True)], "surface string, target string, provenance string, auto_write boolean")
    return kn.review_occurrences(notes(spark, d), asked).select("doc_id", "surface", "n")


# --- reference titles, assets, paths --------------------------------------------------------


@query("reference_title_units", sql.TITLE_UNITS)
def reference_title_units(spark, d):
    entries = ci.reference_entries(notes(spark, d))
    marked = entries.withColumn("entry", F.when(F.col("number") == 3, F.concat("entry", F.lit(" 《记》"))).otherwise(F.col("entry")))
    return un.reference_title_units(marked).groupBy("number", "status").agg(F.count(F.lit(1)).alias("n"), F.count("unit_id").alias("n_units"), F.max("existing_zh").alias("zh"))


@query("transport_metrics", sql.TRANSPORT)
def transport_metrics(spark, d):
    return un.transport_metrics(un.translation_units(notes(spark, d)))


@query("figure_links_stripped", sql.STRIPPED)
def figure_links_stripped(spark, d):
    linked = notes(spark, d).withColumn("text", F.concat("text", F.lit("[Figure 1](a.png) [[b.png|图 2]] [other](c) ![Figure 3](d.png)")))
    return linked.select("doc_id", tx.sha256_text(tx.strip_figure_links(F.col("text"))).alias("sha256"))


@query("image_groups", sql.GROUPS)
def image_groups(spark, d):
    return assets.image_groups(notes(spark, d)).select("doc_id", "figure", F.array_join("images", ",").alias("images"))


@query("image_groups_replaced", sql.GROUPS_REPLACED)
def image_groups_replaced(spark, d):
    rows = notes(spark, d)
    crops = assets.image_groups(rows).select("doc_id", "figure", F.lit("crop.png").alias("target"))
    return assets.replace_image_groups(rows, crops).select("doc_id", sha())


@query("crop_plan", sql.CROPS)
def crop_plan(spark, d):
    items = table(spark, d, "lineitem").where("l_linenumber <= 2")
    boxes = _boxes(spark, d).drop("image_path", "kind", "text")
    numbered = items.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p/"), F.col("l_linenumber").cast("string"), F.lit(".png")).alias("image"), F.lit(0).alias("page"), F.expr("CAST((l_partkey % 5) * 100 AS DOUBLE)").alias("x0"), F.expr("CAST((l_suppkey % 7) * 40 AS DOUBLE)").alias("y0"), F.expr("CAST((l_partkey % 5) * 100 AS DOUBLE) + 120").alias("x1"), F.expr("CAST((l_suppkey % 7) * 40 AS DOUBLE) + 30").alias("y1"), F.lit(True).alias("normalized"))
    groups = boxes.select("doc_id").distinct().select("doc_id", F.lit("1").alias("figure"), F.array(F.lit("1.png"), F.lit("x/2.png")).alias("images"))
    pages = boxes.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(500.0).alias("width"), F.lit(800.0).alias("height"))
    return assets.crop_plan(groups, numbered, pages).select("doc_id", "x0", "y0", "x1", "y1", "status")


@query("asset_summary", sql.ASSET_SUMMARY)
def asset_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source_url_sha256"), F.expr("CASE event_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'hit' ELSE 'deferred' END").alias("status"), (F.col("event_id") % 100).alias("download_ms"))
    return assets.asset_summary(rows)


@query("alignment_sync", sql.ALIGNMENT)
def alignment_sync(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("note"), F.lit("i.png").alias("image"), (F.col("doc_id") % 3 == 0).alias("float_candidate"), "doc_id")
    cache = docs.where("doc_id % 2 = 0").select("note", py.image_hash(F.concat("note", F.lit(":/i.png"))).alias("cache_key"), F.lit("left").alias("position"), F.lit("10").alias("width"), F.lit("").alias("height"), F.lit(True).alias("wrap"))
    return assets.sync_alignments(docs.drop("doc_id"), cache).select("note", "status", "position", "width", "wrap", "float_candidate")


@query("reusable_packages", sql.PACKAGES)
def reusable_packages(spark, d):
    orders = table(spark, d, "orders")
    manifests = orders.select(F.col("o_custkey").cast("string").alias("item_key"), F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("source_file_sha256"), F.col("o_orderpriority").alias("parse_options_fingerprint"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_key"), F.lit("F").alias("pdf_sha256"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").alias("fingerprint"))
    return assets.reusable_packages(wanted, manifests)


@query("relative_paths", sql.PATHS)
def relative_paths(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr("'_resources/' || lang || '/' || CAST(doc_id AS STRING) || '.png'").alias("path"), F.expr("'notes/' || source").alias("folder"))
    return rows.select("doc_id", assets.relative_path(F.col("path"), F.col("folder")).alias("relative"), assets.is_within(F.concat(F.lit("../"), "path")).alias("within"), tx.task_name(F.concat(F.lit("/v/"), "folder", F.lit("/workflow")), F.lit(2)).alias("task"))
