"""The hand-over of notes to translators and back: freezing, assignments, validation by stage."""

from __future__ import annotations

import hashlib
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rewrite import count, gaps, let
from lectern.operators import citations as ci
from lectern.operators import cleaning, figures, units, validators
from lectern.operators import lines as ln

#: Fixed value: the layout that a finished note declares.
LAYOUT = "english_blockquote_chinese_body"
#: The counters of a validation report.
COUNTERS = (
    "citation_residual", "caption_math_artifact_residual", "remote_images", "planned_remote_images", "html_tables", "mojibake", "invalid_image_paths", "frontmatter_errors",
    "translation_units", "body_translation_units", "reference_title_units", "reference_title_fallback_units", "passthrough_units", "layout_units_total", "model_units_total",
    "reference_blocks", "placeholders", "protected_token_errors", "figure_targets", "figure_mentions", "figure_links_written", "unmatched_figure_mentions",
    "ambiguous_figure_targets", "broken_figure_links",
)
#: Counters that must be zero before a note goes to translators.
BLOCKING = ("citation_residual", "remote_images", "html_tables", "mojibake", "invalid_image_paths", "frontmatter_errors", "protected_token_errors")
#: What stands where a translation is still missing.
PLACEHOLDER, TITLE_PLACEHOLDER = r"\{\{ZH:u\d{5}\}\}", r"\{\{REFZH:r\d{5}\}\}"
#: Greek letters that a leading formula may be rendered as.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "eta": "η", "theta": "θ", "kappa": "κ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "psi": "ψ", "omega": "ω"}
_BLOCK = r"^\s*\[(\d{1,9})\]\s+(.+?)\s+\^ref-\1\s*$"
_FIGURE_LINK = r"(?i)(?<!!)\[(?:Figure|Fig\.?|图)[^\]\n]*\]\([^)\n]+\)|(?<!!)\[\[[^\]|\n]+\|(?:Figure|Fig\.?|图)[^\]\n]*\]\]"


# --- measures -------------------------------------------------------------------------------


def _text_measures(text: Column) -> Column:
    def measure(p: Column) -> Column:
        section = p["section"]
        rows = F.split(section, "\n")
        entry = lambda x: F.struct(F.regexp_extract(x, _BLOCK, 1).cast("int").alias("number"), tx.split_title_suffix(F.regexp_extract(x, _BLOCK, 2))["zh"].alias("zh"))
        return F.struct(
            F.regexp_count(F.array_join(gaps(F.concat(p["before"], p["after"])), " "), F.lit(ci.NAMED)).cast("long").alias("named"),
            F.size(cleaning.caption_report(text)["residual"]).cast("long").alias("captions"),
            count(text, r"(?i)!\[[^\]]*\]\(<?https?:").alias("remote"),
            count(text, r"!\[[^\]]*\]\(").alias("images"),
            count(text, r"(?i)<table\b").alias("tables"),
            tx.mojibake_score(text).alias("mojibake"),
            count(text, PLACEHOLDER).alias("placeholders"),
            count(text, TITLE_PLACEHOLDER).alias("title_placeholders"),
            count(section, f"{PLACEHOLDER}|{TITLE_PLACEHOLDER}").alias("section_placeholders"),
            count(section, r"(?m)^\s*>.*\[\d+\]").alias("quoted_entries"),
            F.transform(F.filter(rows, lambda x: x.rlike(_BLOCK)), entry).alias("entries"),
            tx.sha256_text(tx.canonical_references(section)).alias("source_sha256"),
            count(text, _FIGURE_LINK).alias("figure_links"),
            tx.frontmatter_value(text, "bilingual_layout").alias("layout"),
            tx.yaml_list(text, "cssclasses").alias("classes"),
        )

    return let(tx.split_references(text), measure)


def frozen_units(notes: DataFrame) -> DataFrame:
    """(doc_id, unit_order, unit_id, english, requires_translation, lost): units as quoted, list marks included.

    ``lost`` counts protected tokens of a unit's lines that its text to translate lacks.
    """
    cut = units._numbered(units.segments(notes).where("is_unit"))
    lost = F.size(F.filter(F.flatten(F.map_values(units.protected_tokens(F.col("raw")))), lambda t: ~F.col("english").contains(t)))
    return cut.select("doc_id", "unit_order", "unit_id", F.concat("bullet", "english").alias("english"), F.col("reason").isNull().alias("requires_translation"), lost.cast("long").alias("lost"))


def freeze(notes: DataFrame) -> DataFrame:
    """(doc_id, body, passthrough, model, lost, titles, fallback, pending, skipped, expected, blocks, source_sha256): what a finished note must still agree with.

    ``expected`` and ``skipped`` are the numbers of references that get a translated title and that
    have none to translate; ``blocks`` counts entries with a block id.
    """
    cut = frozen_units(notes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("body"), F.count_if(~F.col("requires_translation")).alias("passthrough"), F.count_if("requires_translation").alias("model"), F.sum("lost").alias("lost"))
    titles = units.reference_title_units(ci.reference_entries(notes))
    numbers = lambda skipped: F.sort_array(F.collect_set(F.when((F.col("status") == "skipped") == F.lit(skipped), F.col("number"))))
    told = titles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("titles"), F.count_if(F.col("mode") == "worker").alias("fallback"), F.count_if(F.col("status") == "pending").alias("pending"), numbers(True).alias("skipped"), numbers(False).alias("expected"))
    measured = notes.select("doc_id", _text_measures(F.col("text")).alias("m")).select("doc_id", F.size("m.entries").cast("long").alias("blocks"), "m.source_sha256")
    joined = measured.join(cut, "doc_id", "left").join(told, "doc_id", "left")
    zero = {n: F.coalesce(n, F.lit(0)).cast("long") for n in ("body", "passthrough", "model", "lost", "titles", "fallback", "pending")}
    none = {n: F.coalesce(n, F.array().cast("array<int>")) for n in ("skipped", "expected")}
    return joined.withColumns(zero | none)


def _per_note(notes: DataFrame, files: DataFrame | None) -> DataFrame:
    """Notes' measures ``m``, findings and figure counts, a row each."""
    found = validators.note_findings(notes)
    named = lambda s: F.sort_array(F.collect_set(F.when(F.col("severity") == s, F.col("rule"))))
    front = F.col("rule").isin("frontmatter_missing", "frontmatter_not_first", "title_missing", "windows_path")
    paths = F.when(F.col("rule").isin("absolute_image", "image_outside_roots"), F.col("detail").cast("long"))
    findings = found.groupBy("doc_id").agg(named("error").alias("f_errors"), named("warning").alias("f_warnings"), F.count_if(front).alias("frontmatter_errors"), F.sum(paths).alias("invalid_image_paths"))
    labels = ci.classify_footnotes(ci.footnote_definitions(ln.lines(ci.with_footnotes(notes)))).where("is_citation").groupBy("doc_id").agg(F.count(F.lit(1)).alias("footnotes"))
    targets = figures.figure_targets(notes)
    held = targets.groupBy("doc_id").agg(F.count_if(F.col("status") == "unique").alias("figure_targets"), F.count_if(F.col("status") != "unique").alias("ambiguous_figure_targets"))
    named_figures = figures.mentions(ln.lines(notes), targets).groupBy("doc_id").agg(
        F.count_if(F.col("kind") != "range").alias("plain_mentions"), F.count_if(F.col("status") == "linked").alias("linkable"), F.count_if(F.col("status") == "missing_target").alias("unmatched_figure_mentions")
    )
    out = notes.select("doc_id", _text_measures(F.col("text")).alias("m"))
    joined = [findings, labels, held, named_figures]
    if files is not None:
        joined.append(validators.broken_figure_links(notes, files).groupBy("doc_id").agg(F.count(F.lit(1)).alias("broken_figure_links")))
    for rows in joined:
        out = out.join(rows, "doc_id", "left")
    return out if files is not None else out.withColumn("broken_figure_links", F.lit(0).cast("long"))


def _counts(remote_allowed: bool, prepared: bool) -> dict[str, Column]:
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    remote = F.col("m.remote")
    # Titles become units when a note is frozen, so a prepared one has none yet.
    known = F.lit(not prepared) & F.col("blocks").isNotNull()
    made = {
        "citation_residual": n("footnotes") + F.col("m.named"),
        "caption_math_artifact_residual": F.col("m.captions"),
        "remote_images": zero if remote_allowed else remote,
        "planned_remote_images": remote if remote_allowed else zero,
        "html_tables": F.col("m.tables"),
        "mojibake": F.col("m.mojibake"),
        "translation_units": n("body"),
        "body_translation_units": n("body"),
        "reference_title_units": F.when(known, n("titles")).otherwise(F.size("m.entries")).cast("long"),
        "reference_title_fallback_units": F.when(known, n("fallback")).otherwise(zero),
        "passthrough_units": n("passthrough"),
        "layout_units_total": n("body"),
        "model_units_total": n("model") + F.when(known, n("pending")).otherwise(zero),
        "reference_blocks": F.size("m.entries").cast("long"),
        "placeholders": F.col("m.placeholders") + F.col("m.title_placeholders"),
        "protected_token_errors": n("lost"),
        "figure_mentions": n("plain_mentions") + F.col("m.figure_links"),
        "figure_links_written": F.col("m.figure_links"),
    }
    return {c: made[c] if c in made else n(c) for c in COUNTERS}


def _report(rows: DataFrame, remote_allowed: bool, checks: list[tuple[str, str, Column]], prepared: bool) -> DataFrame:
    # A remote image is no complaint where its download is planned.
    found = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    told = lambda s, own: F.array_distinct(F.concat(found(F.col(own)), F.filter(F.array(*(F.when(c, F.lit(r)) for kind, r, c in checks if kind == s)), lambda r: r.isNotNull())))
    skip = F.array(F.lit("remote_image")) if remote_allowed else F.array().cast("array<string>")
    counted = rows.withColumns(_counts(remote_allowed, prepared)).withColumns({"errors": told("error", "f_errors"), "warnings": F.array_except(told("warning", "f_warnings"), skip)})
    ok = F.size("errors") == 0
    ready = ok & (F.col("translation_units") > 0) if prepared else F.lit(False)
    for name in BLOCKING if prepared else ():
        ready = ready & (F.col(name) == 0)
    verified = F.lit(None).cast("boolean") if prepared else F.col("blocks").isNotNull()
    return counted.select("doc_id", ok.alias("ok"), verified.alias("provenance_verified"), ready.alias("ready_for_translation"), *COUNTERS, "errors", "warnings")


def _class_check(image_class: str | None) -> list[tuple[str, str, Column]]:
    return [] if image_class is None else [("warning", "image_class_missing", (F.col("m.images") > 0) & ~F.array_contains("m.classes", image_class))]


def validate_prepared(notes: DataFrame, files: DataFrame | None = None, remote_allowed: bool = False, image_class: str | None = None) -> DataFrame:
    """(doc_id, ok, provenance_verified, ready_for_translation, 24 counters, errors, warnings) of notes before translation.

    A note is ready if nothing is an error, it has units and all counters of ``BLOCKING`` are 0.
    ``files`` (path) are the vault's files, against which figure links are tested.
    """
    rows = _per_note(notes, files).join(freeze(notes), "doc_id", "left")
    checks = [("error", "no_units", F.coalesce("body", F.lit(0)) == 0), ("error", "tokens_lost", F.coalesce("lost", F.lit(0)) > 0), *_class_check(image_class)]
    return _report(rows, remote_allowed, checks, prepared=True)


def validate_final(notes: DataFrame, frozen: DataFrame, body: DataFrame, states: DataFrame | None = None, strict: bool = True, files: DataFrame | None = None, remote_allowed: bool = False, image_class: str | None = None) -> DataFrame:
    """The same report of translated notes, against what ``freeze`` and ``frozen_units`` gave of the prepared ones.

    Without a frozen row a note's provenance is unverified: an error if ``strict`` (the end of a
    run), else a warning (an audit).  ``states`` (doc_id, bilingual_layout, source_sha256) are the
    run's own records.
    """
    plain = notes.withColumn("text", tx.strip_figure_links(F.col("text")))
    quoted = body.withColumn("english", tx.strip_figure_links(F.col("english")))
    layout = validators.bilingual_layout(quoted, plain)
    rows = _per_note(notes, files).join(frozen, "doc_id", "left").join(layout, "doc_id", "left")
    if states is not None:
        rows = rows.join(states.select("doc_id", F.col("bilingual_layout").alias("state_layout"), F.col("source_sha256").alias("state_sha256")), "doc_id", "left")
    known = F.col("blocks").isNotNull()
    entries = F.col("m.entries")
    skipped = lambda e: F.array_contains("skipped", e["number"])
    shown = F.transform(F.filter(entries, lambda e: e["zh"].isNotNull() & ~skipped(e)), lambda e: e["number"])
    same = (F.size(F.array_except(shown, F.col("expected"))) == 0) & (F.size(F.array_except(F.col("expected"), shown)) == 0)
    checks = [
        ("error", "layout_not_declared", ~F.col("m.layout").eqNullSafe(F.lit(LAYOUT))),
        ("error" if strict else "warning", "provenance_unverified", ~known),
        ("error", "quotes_missing_or_reordered", F.col("n_found") < F.col("n_units")),
        ("error", "translations_missing", F.col("n_translated") < F.col("n_found")),
        ("error", "references_changed", known & (F.col("m.source_sha256") != F.col("source_sha256"))),
        ("error", "reference_blocks_changed", known & (F.size(entries) != F.col("blocks"))),
        ("error", "references_quoted", known & (F.col("m.quoted_entries") > 0)),
        ("error", "titleless_reference_translated", known & F.exists(entries, lambda e: e["zh"].isNotNull() & skipped(e))),
        ("error", "title_without_chinese", known & F.exists(entries, lambda e: ~e["zh"].rlike(tx.CJK) & ~skipped(e))),
        ("error", "reference_titles_differ", known & ~same),
        ("error", "placeholders_in_references", known & (F.col("m.section_placeholders") > 0)),
        ("error", "placeholders_left", F.col("m.placeholders") > 0),
        ("error", "title_placeholders_left", F.col("m.title_placeholders") > 0),
        ("warning", "figures_unlinked", F.coalesce("linkable", F.lit(0)) > 0),
        ("error", "figure_links_broken", F.coalesce("broken_figure_links", F.lit(0)) > 0),
        ("warning", "figures_unmatched", F.coalesce("unmatched_figure_mentions", F.lit(0)) > 0),
        ("warning", "figures_ambiguous", F.coalesce("ambiguous_figure_targets", F.lit(0)) > 0),
        *_class_check(image_class),
    ]
    if states is not None:
        checks += [("error", "state_layout", F.col("state_layout") != LAYOUT), ("error", "state_references", known & (F.col("state_sha256") != F.col("m.source_sha256")))]
    return _report(rows, remote_allowed, checks, prepared=False)


# --- identity, assignments, configuration ---------------------------------------------------


def identity(prompt: str, model: str, effort: str, versions: tuple[str, ...], agent: str = "translation-worker", tier: str = "publication") -> dict[str, str]:
    """Who translates: the prompt's hash, and one over everything that may change a translation."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    prompt_sha256 = digest(prompt)
    return {"agent": agent, "model": model, "reasoning_effort": effort, "quality_tier": tier, "prompt_sha256": prompt_sha256, "translator_fingerprint": digest("\0".join((model, effort, prompt_sha256, *versions))), "constraints_version": versions[0]}


def assignments(packets: DataFrame, who: dict[str, str], packet_path: Column, output_path: Column) -> DataFrame:
    """(doc_id, assignment): the manifest of each packet (doc_id, packet, unit_count) as JSON."""
    runtime = F.struct(*(F.lit(who[k]).alias(k) for k in ("model", "reasoning_effort", "quality_tier")))
    told = (F.lit(who[k]).alias(k) for k in ("prompt_sha256", "translator_fingerprint", "constraints_version"))
    row = F.struct(F.lit(3).alias("schema_version"), packet_path.alias("packet_path"), output_path.alias("output_path"), F.col("unit_count"), tx.sha256_text(F.col("packet")).alias("packet_sha256"), *told, runtime.alias("requested_runtime"))
    return packets.select("doc_id", F.to_json(row).alias("assignment"))


def config_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): configuration files (path, text) that are missing or aren't what is rendered now."""
    both = expected.select("path", F.col("text").alias("want")).join(found.select("path", F.col("text").alias("have"), F.lit(True).alias("there")), "path", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("want").eqNullSafe(F.col("have")), "differs")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def resource_roots(primary: str, configured: tuple[str, ...] = (), defaults: tuple[str, ...] = ("_resources", "_附件"), vault: str = "") -> tuple[str, ...]:
    """The vault's resource folders, each once, the primary first: relative to it, inside it, and not the vault itself."""

    def inside(root: str, absolute: bool) -> str:
        path = root.replace("\\", "/")
        if path.startswith("/") and not (absolute and vault):
            raise ValueError(f"resource folder must be relative to the vault: {root}")
        path = posixpath.normpath(posixpath.relpath(path, vault) if path.startswith("/") else path)
        if path == "." or path.split("/")[0] == "..":
            raise ValueError(f"resource folder is not below the vault: {root}")
        return path

    return tuple(dict.fromkeys([inside(primary, False), *(inside(r, True) for r in (*defaults, *configured))]))


def restore_leading_math(source: Column, translated: Column) -> Column:
    """A translated title whose leading formula was rendered as text, with the formula put back.

    Only where the source title starts with its one such formula, the translation lacks it, and what
    stands before the first Chinese character shows the same Greek letter, or digits in sub- or
    superscript tags.  Anything else stays as it is.
    """
    token = F.regexp_extract(source, units.TOKEN_PATTERNS["inline_math"], 0)

    def fixed(t: Column) -> Column:
        prefix = F.regexp_extract(translated, r"\A([^一-鿿]*[^\s一-鿿][^一-鿿]*)(?=[一-鿿])", 1)
        greek = F.lit(False)
        for name, letter in GREEK.items():
            greek = greek | (t.contains("\\" + name) & prefix.contains(letter))
        scripted = prefix.rlike(r"(?i)</?su[bp]>") & t.rlike(r"\d") & prefix.rlike(r"\d")
        once = F.size(F.split(source, F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)) == 2
        fits = (t != "") & F.ltrim(source).startswith(t) & once & ~translated.contains(t) & (prefix != "") & (greek | scripted)
        return F.when(fits, F.concat(t, F.substring(translated, F.length(prefix) + 1, 2**31 - 1))).otherwise(translated)

    return let(token, fixed)
