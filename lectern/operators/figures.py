"""Figures: targets by caption adjacency, mentions, links, orphan anchors, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rewrite import at_matches, between, find_all, let
from lectern.operators import lines as ln

_GAP = r"[\s   ~˜]*"
IMAGE_LINE = r"^\s*(?:!\[[^\]]*\]\(([^)\r\n]+)\)|!\[\[([^\]|\r\n]+)(?:\|[^\]\r\n]+)?\]\])\s*$"
CAPTION = rf"(?i)^\s*(?:>\s*)?(?:\*\*|__)?(?:Figure|Fig\.?|图){_GAP}([A-Za-z]?\d+)\s*(?:[:：.]|\([A-Za-z0-9]+\)|（[A-Za-z0-9]+）)"
RANGE = rf"(?i)(?:\b(?:Figures?|Figs?\.?)|图){_GAP}[A-Za-z]?\d+\s*[–—-]\s*[A-Za-z]?\d+"
PLURAL = rf"(?i)\b(?:Figures|Figs\.?){_GAP}[A-Za-z]?\d+(?:\s*(?:,\s*(?:and\s+)?|\s+and\s+|&\s*)[A-Za-z]?\d+)+"
SINGLE = rf"(?i)(?:\b(?:Figure|Fig\.?)|图){_GAP}[A-Za-z]?\d+(?:\s*(?:\([A-Za-z0-9]+\)|（[A-Za-z0-9]+）))?"
INLINE = r"!?\[\[[^\]\r\n]+\]\]|!?\[[^\]\r\n]*\]\([^)]+\)|`+[^`\r\n]*`+|(?<!\$)\$[^$\r\n]+\$(?!\$)|https?://[^\s<>()]+|%%.*?%%"
ANCHOR_LINK = r"\[\[#(fig-[^\]|\n]+)(?:\|([^\]\n]+))?\]\]"


#: Image lines with blank lines between, and the line that follows them.
IMAGE_RUN = r"(?m)(?:^[ \t]*(?:!\[[^\]]*\]\([^)\r\n]+\)|!\[\[[^\]|\r\n]+(?:\|[^\]\r\n]+)?\]\])[ \t\r]*\n(?:[ \t\r]*\n)*)+[^\n]*"


def figure_candidates(notes: DataFrame) -> DataFrame:
    """(doc_id, figure_id, style, target, n_images, run_no): images that a caption follows across blank lines.

    The runs are found in each text as it stands, so nothing is exploded but what is a run.
    """
    runs = notes.select("doc_id", F.posexplode(find_all(F.col("text"), IMAGE_RUN)).alias("run_no", "run"))
    raw = F.regexp_extract(F.element_at(F.split("run", "\n"), -1), CAPTION, 1)
    images = F.filter(F.split("run", "\n"), lambda x: x.rlike(IMAGE_LINE))
    named = runs.select("doc_id", "run_no", raw.alias("raw"), images.alias("images")).where("raw <> ''")
    last = F.element_at("images", -1)
    wiki = F.regexp_extract(last, IMAGE_LINE, 2)
    return named.select("doc_id", tx.canonical_figure_id(F.col("raw")).alias("figure_id"), F.when(wiki != "", "wiki").otherwise("markdown").alias("style"), F.trim(F.when(wiki != "", wiki).otherwise(F.regexp_extract(last, IMAGE_LINE, 1))).alias("target"), F.size("images").alias("n_images"), "run_no")


def figure_targets(notes: DataFrame) -> DataFrame:
    """(doc_id, figure_id, style, target, status): unique targets, or why a figure has none."""
    found = figure_candidates(notes).groupBy("doc_id", "figure_id").agg(F.max("n_images").alias("most"), F.count_distinct("style", "target").alias("n"), F.min(F.struct("run_no", "style", "target")).alias("first"))
    status = F.when(F.col("most") > 1, "multi_asset").when(F.col("n") > 1, "multiple_distinct_targets").otherwise("unique")
    unique = status == "unique"
    return found.select("doc_id", "figure_id", F.when(unique, F.col("first.style")).alias("style"), F.when(unique, F.col("first.target")).alias("target"), status.alias("status"))


def _eligible(line: Column, code: Column) -> Column:
    return (code == ln.PROSE) & ~line.rlike(r"^\s*(?:#{1,6}\s|\|)") & ~line.rlike(IMAGE_LINE) & ~line.rlike(CAPTION)


def _link(display: Column, entry: Column) -> Column:
    encoded = F.replace(F.url_encode(F.try_url_decode(F.replace(entry["target"], F.lit("+"), F.lit("%2B")))), F.lit("+"), F.lit("%20"))
    plain = F.replace(F.replace(F.replace(encoded, F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":")), F.lit("%40"), F.lit("@"))
    return F.when(entry["style"] == "wiki", F.concat(F.lit("[["), entry["target"], F.lit("|"), display, F.lit("]]"))).otherwise(F.concat(F.lit("["), display, F.lit("]("), plain, F.lit(")")))


def mentions(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, line_no, figure_id, display, kind, status): every mention in eligible prose.

    kind is range, plural or single; status is ``range`` (kept as it is), ``linked``,
    ``ambiguous_target`` or ``missing_target``.
    """
    # Most lines name no figure; a plain search for the words spares them the rest.
    eligible = rows.where(F.col("line").rlike(r"(?i)\bfig|图")).where(_eligible(F.col("line"), F.col("region")))
    pick = lambda found, kind: F.transform(found, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("display")))

    def found(bare: Column) -> Column:
        rest = F.regexp_replace(bare, RANGE, "\0")
        return F.concat(
            pick(find_all(bare, RANGE), "range"),
            pick(F.flatten(F.transform(find_all(rest, PLURAL), lambda p: find_all(p, r"[A-Za-z]?\d+"))), "plural"),
            pick(find_all(F.regexp_replace(rest, PLURAL, "\0"), SINGLE), "single"),
        )

    items = let(F.array_join(F.split("line", INLINE, -1), "\0"), found)
    flat = eligible.select("doc_id", "line_no", F.inline(items))
    number = tx.canonical_figure_id(F.regexp_extract("display", r"([A-Za-z]?\d+)", 1))
    named = flat.withColumn("figure_id", F.when(F.col("kind") != "range", number))
    joined = named.join(targets.select("doc_id", "figure_id", F.col("status").alias("found")), ["doc_id", "figure_id"], "left")
    status = F.when(F.col("kind") == "range", "range").when(F.col("found") == "unique", "linked").when(F.col("found").isNotNull(), "ambiguous_target").otherwise("missing_target")
    return joined.select("doc_id", "line_no", "figure_id", tx.normalize_figure_display(F.col("display")).alias("display"), "kind", status.alias("status"))


def link_figures(notes: DataFrame) -> DataFrame:
    """(doc_id, text): mentions of uniquely targeted figures as links; ranges and protected text stay."""
    unique = figure_targets(notes).where("status = 'unique'")
    per_doc = unique.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("figure_id", F.struct("style", "target")))).alias("_targets"))
    joined = notes.join(per_doc, "doc_id", "left")
    entry = lambda raw: F.try_element_at("_targets", tx.canonical_figure_id(raw))

    def single(m: Column) -> Column:
        shown = tx.normalize_figure_display(m)
        target = entry(F.regexp_extract(m, r"([A-Za-z]?\d+)", 1))
        return F.when(target.isNull(), shown).otherwise(_link(shown, target))

    plural = lambda m: F.concat(F.regexp_extract(m, r"(?i)^(Figures|Figs\.?)", 1), F.lit(" "), at_matches(F.regexp_replace(m, rf"(?i)^(?:Figures|Figs\.?){_GAP}", ""), r"[A-Za-z]?\d+", lambda d: F.coalesce(_link(d, entry(d)), d)))
    edit = lambda g: between(g, f"{RANGE}|{PLURAL}", lambda s: at_matches(s, SINGLE, single))
    lists = lambda g: between(g, RANGE, lambda s: at_matches(s, PLURAL, plural))
    done = lambda x: between(between(x, INLINE, lists), INLINE, edit)
    named = r"(?i)\bfig|图"
    out = ln.with_regions(F.split("text", "\n", -1), lambda x, c: F.when(x.rlike(named) & _eligible(x, c), done(x)).otherwise(x))
    return joined.select("doc_id", ln.join_lines(out).alias("text"))


def anchors(text: Column) -> Column:
    """Ids that figure fragments can point to: HTML ids and names, and block ids."""
    return F.array_distinct(F.concat(find_all(text, r"(?i)\b(?:id|name)=[\"'](fig-[^\"']+)[\"']", 1), find_all(text, r"(?m)\^(fig-[A-Za-z0-9_-]+)\s*$", 1)))


def strip_orphan_fragments(text: Column) -> Column:
    """Links to absent figure anchors become their shown text."""
    have = anchors(text)
    shown = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, ANCHOR_LINK, 2), F.lit("")), F.regexp_extract(m, ANCHOR_LINK, 1))
    return at_matches(text, ANCHOR_LINK, lambda m: F.when(F.array_contains(have, F.regexp_extract(m, ANCHOR_LINK, 1)), m).otherwise(shown(m)))


def orphan_fragments(notes: DataFrame) -> DataFrame:
    """(doc_id, anchor): linked figure anchors that the note lacks."""
    wanted = notes.select("doc_id", F.explode(F.array_except(F.array_distinct(find_all(F.col("text"), ANCHOR_LINK, 1)), anchors(F.col("text")))).alias("anchor"))
    return wanted


def broken_links(links: DataFrame, targets: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, line_no, target, reason) of figure links (doc_id, line_no, display, target) that don't hold.

    ``files`` lists the vault's relative paths.  Reasons: absolute_or_external, outside_vault,
    missing_attachment, not_image, ambiguous_target, wrong_figure.
    """
    clean = tx.clean_link_target(F.col("target"))
    figure = tx.canonical_figure_id(F.regexp_extract("display", r"([A-Za-z]?\d+)", 1))
    asked = links.withColumns({"path": clean, "figure_id": figure})
    joined = asked.join(targets.select("doc_id", "figure_id", F.col("target").alias("right"), "status"), ["doc_id", "figure_id"], "left").join(files.select(F.col("path"), F.lit(True).alias("there")).distinct(), "path", "left")
    reason = (
        F.when(F.col("path").rlike(r"^(?:/|[A-Za-z]:|[a-z]+://)"), "absolute_or_external")
        .when(F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)"), "outside_vault")
        .when(F.col("there").isNull(), "missing_attachment")
        .when(~F.lower("path").rlike(r"\.(?:avif|bmp|gif|jpe?g|png|svg|webp)$"), "not_image")
        .when(F.col("status") != "unique", "ambiguous_target")
        .when(F.coalesce(tx.clean_link_target(F.col("right")), F.lit("")) != F.col("path"), "wrong_figure")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "line_no", "target", "reason")
