"""Image groups and crops, alignment entries, source packages, remote assets and paths."""

from __future__ import annotations

import base64
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import python_udfs as py
from lectern.functions.rewrite import at_matches, find_all, let

#: Two or more image lines, then a numbered caption.
IMAGE_GROUP = r"(?im)(?:^[ \t]*!\[[^\]]*\]\([^)\r\n]+\)[ \t]*\n(?:[ \t]*\n)*){2,}(?=(?:>[ \t]*)?(?:Fig\.|Figure)[ \t]*\d+[ \t]*[:.])"
#: Largest data or response that is taken for an image.
MOST_BYTES = 50 << 20
_FETCHED = "source string, status string, sha256 string, content binary, error string"


def image_groups(notes: DataFrame) -> DataFrame:
    """(doc_id, figure, images array): runs of two or more images directly above a caption."""
    grouped = rf"{IMAGE_GROUP}(?:>[ \t]*)?(?:Fig\.|Figure)[ \t]*(\d+)"
    rows = notes.select("doc_id", F.explode(find_all(F.col("text"), grouped.replace("(?=(?:>[ \\t]*)?(?:Fig\\.|Figure)[ \\t]*\\d+[ \\t]*[:.])", ""))).alias("m"))
    return rows.select("doc_id", F.regexp_extract("m", r"(?i)(?:Fig\.|Figure)[ \t]*(\d+)$", 1).alias("figure"), find_all(F.col("m"), r"!\[[^\]]*\]\(([^)\r\n]+)\)", 1).alias("images"))


def crop_plan(groups: DataFrame, boxes: DataFrame, pages: DataFrame, padding: float = 4.0) -> DataFrame:
    """(doc_id, figure, page, x0, y0, x1, y1, status): the union of a group's boxes on its page, in points.

    ``boxes`` has (doc_id, image, page, x0, y0, x1, y1, normalized); ``pages`` (doc_id, page, width,
    height).  Boxes on a 1000 x 1000 canvas are scaled on both axes; where it isn't known, boxes
    that pass the page by a quarter are taken for such.  Every image must be found, on one page;
    of several boxes of a name the first counts.
    """
    base = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    asked = groups.select("doc_id", "figure", F.size("images").alias("wanted"), F.explode("images").alias("image")).withColumn("image", base(F.col("image")))
    columns = ("page", "x0", "y0", "x1", "y1", "normalized")
    first = boxes.groupBy("doc_id", base(F.col("image")).alias("image")).agg(F.min(F.struct(*columns)).alias("b")).select("doc_id", "image", *(F.col(f"b.{c}").alias(c) for c in columns))
    found = asked.join(first, ["doc_id", "image"], "left").groupBy("doc_id", "figure", "wanted").agg(
        F.count("page").alias("held"), F.count_distinct("page").alias("pages"), F.min("page").alias("page"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.bool_or("normalized").alias("normalized"),
    )
    sized = found.join(pages, ["doc_id", "page"], "left")
    canvas = F.coalesce("normalized", (F.col("x1") > F.col("width") * 1.25) | (F.col("y1") > F.col("height") * 1.25))
    at = lambda c, size: F.when(canvas, F.col(c) * F.col(size) / 1000).otherwise(F.col(c))
    low = lambda c, size: F.greatest(F.lit(0.0), at(c, size) - padding)
    high = lambda c, size: F.least(F.col(size), at(c, size) + padding)
    status = F.when(F.col("held") < F.col("wanted"), "missing_image").when(F.col("pages") > 1, "several_pages").otherwise("crop")
    return sized.select("doc_id", "figure", "page", low("x0", "width").alias("x0"), low("y0", "height").alias("y0"), high("x1", "width").alias("x1"), high("y1", "height").alias("y1"), status.alias("status"))


def replace_image_groups(notes: DataFrame, crops: DataFrame) -> DataFrame:
    """(doc_id, text) with each group whose figure has a crop (doc_id, figure, target) as one image."""
    table = crops.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct(F.col("figure").cast("string"), "target"))).alias("_crops"))
    whole = IMAGE_GROUP.replace("(?=", "(").replace(r"\d+[ \t]*[:.])", r"\d+)")
    number = lambda m: F.regexp_extract(m, r"(?i)(?:Fig\.|Figure)[ \t]*(\d+)$", 1)
    caption = lambda m: F.regexp_extract(m, r"(?i)((?:>[ \t]*)?(?:Fig\.|Figure)[ \t]*\d+)$", 1)
    edit = lambda m: F.coalesce(F.concat(F.lit("![Figure "), number(m), F.lit("]("), F.try_element_at("_crops", number(m)), F.lit(")\n\n"), caption(m)), m)
    joined = notes.join(table, "doc_id", "left")
    return joined.select("doc_id", at_matches(F.col("text"), whole, edit).alias("text"))


def sync_alignments(images: DataFrame, cache: DataFrame, overwrite: bool = False) -> DataFrame:
    """(note, image, cache_key, status, position, width, height, wrap) of images (note, image, float_candidate).

    ``cache`` has (note, cache_key, position, width, height, wrap).  Entries that exist are kept,
    or overwritten but for their size; new ones are centred.  A recommendation to float is
    reported as ``float_candidate``, never applied.
    """
    keyed = images.withColumn("cache_key", py.image_hash(F.concat_ws(":", "note", F.concat(F.lit("/"), "image"))))
    joined = keyed.join(cache.withColumn("_there", F.lit(True)), ["note", "cache_key"], "left")
    kept = F.col("_there").isNotNull() & F.lit(not overwrite)
    status = F.when(kept, "preserved_existing").when(F.col("_there").isNotNull(), "overwritten").otherwise("added")
    fresh = {"position": F.lit("center"), "wrap": F.lit(False), "width": F.coalesce("width", F.lit("")), "height": F.coalesce("height", F.lit(""))}
    return joined.select("note", "image", "cache_key", status.alias("status"), "float_candidate", *(F.when(kept, F.col(c)).otherwise(v).alias(c) for c, v in fresh.items()))


def alignment_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("note").agg(*(F.count_if(F.col("status") == s).alias(n) for n, s in (("added", "added"), ("overwritten", "overwritten"), ("preserved", "preserved_existing"))), F.count_if("float_candidate").alias("float_candidates"))


def reusable_packages(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """(item_key, path): the last path whose manifest has the PDF's hash and, if asked, the parse fingerprint.

    ``wanted`` has (item_key, pdf_sha256, fingerprint or null); ``manifests`` (item_key, path,
    source_file_sha256, parse_options_fingerprint).
    """
    both = wanted.join(manifests, "item_key").where("source_file_sha256 = pdf_sha256 AND (fingerprint IS NULL OR fingerprint = parse_options_fingerprint)")
    return both.groupBy("item_key").agg(F.max("path").alias("path"))


def asset_summary(assets: DataFrame) -> DataFrame:
    """One row (n_assets, n_sources, n_downloaded, n_hits, n_failed, download_ms) of rows (source_url_sha256, status, download_ms).

    References to one URL share a download, so its time counts once.
    """
    per = assets.groupBy("source_url_sha256").agg(F.max("download_ms").alias("ms"), F.bool_or(F.col("status") == "downloaded").alias("got"), F.bool_or(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_assets"), F.count(F.lit(1)).alias("n_sources"), F.count_if("got").alias("n_downloaded"), F.count_if(~F.col("got") & ~F.col("failed")).alias("n_hits"), F.count_if("failed").alias("n_failed"), F.coalesce(F.sum("ms"), F.lit(0)).alias("download_ms"))


def decode_data_uri(uri: str) -> bytes:
    head, _, data = uri.partition(",")
    return base64.b64decode(data, validate=True) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(data)


def http_get(url: str, most: int = MOST_BYTES, seconds: float = 30) -> bytes:
    """A response's body, read in pieces and given up beyond ``most`` bytes or without an answer in ``seconds``."""
    with urllib.request.urlopen(url, timeout=seconds) as answer:
        parts, held = [], 0
        while piece := answer.read(1 << 16):
            held += len(piece)
            if held > most:
                raise ValueError(f"larger than {most >> 20} MiB")
            parts.append(piece)
    return b"".join(parts)


def fetch(sources: DataFrame, fetcher: Callable[[str], bytes] = http_get) -> DataFrame:
    """(source, status, sha256, content, error) of distinct sources: data URIs decoded, others by ``fetcher``.

    One failing source is a row with its error, not a failed job; over 50 MiB is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for source in batch["source"]:
                try:
                    content = decode_data_uri(source) if source.startswith("data:") else fetcher(source)
                    if len(content) > MOST_BYTES:
                        raise ValueError("larger than 50 MiB")
                    row = (source, "downloaded", hashlib.sha256(content).hexdigest(), content, None)
                except Exception as e:
                    row = (source, "failed", None, None, str(e)[:200])
                yield pd.DataFrame([row], columns=["source", "status", "sha256", "content", "error"])

    return sources.select("source").distinct().mapInPandas(run, _FETCHED)


def relative_path(path: Column, directory: Column) -> Column:
    """POSIX path from ``directory`` to ``path``, both relative to one root."""

    def walk(parts: Column) -> Column:
        a, b = parts["a"], parts["b"]
        differs = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | F.get(b, i).isNull())
        same = F.coalesce(F.array_min(differs), F.lit(0))
        return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - same), F.slice(a, same + 1, F.size(a))), "/")

    split = lambda c: F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    return let(F.struct(split(path).alias("a"), split(directory).alias("b")), walk)


def is_within(path: Column) -> Column:
    """Whether a relative path stays below its root at every step."""
    depth = F.aggregate(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda s, p: let(s["now"] + F.when(p == "..", -1).otherwise(1), lambda n: F.struct(n.alias("now"), F.least(s["least"], n).alias("least"))))
    return ~path.rlike(r"^(?:/|[A-Za-z]:|[a-z]+://)") & (depth["least"] >= 0)


def sources_fingerprint(sources: DataFrame) -> DataFrame:
    """(note, fingerprint): a hash over the ordered (path, sha256) list of a note's layout sources."""
    line = F.concat_ws("\0", "path", "sha256")
    return sources.groupBy("note").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


def latest_attempt(attempts: DataFrame) -> DataFrame:
    order = Window.partitionBy("workflow_id").orderBy(F.col("attempt").desc())
    return attempts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
