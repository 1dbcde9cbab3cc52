"""Language identification by nearest centroid over TF-IDF vectors of hashed byte n-grams.

Training takes at most ``per_language`` labelled documents of each language (those with the
least hash of their id), counts their 1- to 3-grams in ``DIM`` hash cells, weighs cells by
log(1 + tf) * idf and normalises.  Each language gets up to ``clusters`` centroids by spherical
k-means.  A text's language is that of the centroid with the greatest cosine.  A text farther
from every centroid than nearly all training texts of that language and of about its length is
flagged as rejected; what is near enough for a short text is learned from the beginnings of the
training texts.
Predictions read the whole text; the model (a few hundred kB, whatever the corpus) travels in
the task closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.scratch import prepare

DIM = 4096
UNKNOWN = "und"
#: Rejection: cosine below ``STRICT`` times the low quantile of the language's own training texts.
STRICT, QUANTILE = 0.5, 0.01
#: Bound on the training sample over all languages (16 KB each on the driver).
MOST_SAMPLED = 10_000
#: Rejection is learned for texts of up to so many bytes, and for longer ones.
LENGTHS = (8, 16, 32, 64, 128, 256, 512)
#: Letters are the characters of Unicode category L, as Java's \\p{L} in training.
_LETTER = regex.compile(r"\p{L}")


def _counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams per text; ASCII digits and signs count as one blank."""
    n, texts = len(buf), len(offsets) - 1
    out = np.zeros(texts * DIM, dtype=np.float32)
    if n:
        plain = tk.lower_ascii(buf)
        plain[(plain < 97) | ((plain > 122) & (plain < 128))] = 32
        row = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets)) * DIM
        last = np.repeat(offsets[1:], np.diff(offsets))
        gram = np.zeros(n, dtype=np.uint32)
        for k in (1, 2, 3):
            if n < k:
                break
            gram = gram[: n - k + 1] * np.uint32(257) + plain[k - 1 :]
            cell = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            inside = np.arange(n - k + 1) + k <= last[: n - k + 1]
            out += np.bincount((row[: n - k + 1] + cell)[inside], minlength=len(out))
    return out.reshape(texts, DIM)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    #: Language of each centroid, and the least cosine that language accepts, by band of ``LENGTHS``.
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine and rejection per row, given the texts' bytes."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return self.owner[best], score, score < self.least[self.owner[best], np.searchsorted(LENGTHS, sizes)]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(5))
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _count_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tk.column_bytes(batch.column(1))
        for first, last in tk.text_chunks(offsets, 1 << 20):
            base = offsets[first : last + 1]
            counts = _counts(raw[base[0] : base[-1]], base - base[0])
            heads = [_head(raw[a : min(b, a + LENGTHS[-1] + 1)].tobytes(), b - a) for a, b in zip(base[:-1], base[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([c.astype(np.float32).tobytes() for c in counts], pa.binary()), pa.array(heads, pa.binary())], names=["lang", "counts", "head"])


def _head(start: bytes, size: int) -> bytes:
    """The text itself, or its beginning up to the last blank, if there is one."""
    return start if size <= LENGTHS[-1] else start[: LENGTHS[-1]].rsplit(b" ", 1)[0]


def _beginnings(heads: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of texts, of up to ``most`` bytes and whole words, one after another."""
    cut = [(h[: most + 1].rsplit(b" ", 1)[0] if len(h) > most else h)[:most] for h in heads]
    return np.frombuffer(b"".join(cut), dtype=np.uint8), np.cumsum([0, *map(len, cut)])


def train(labelled: DataFrame, per_language: int = 300, clusters: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most ``per_language`` texts of each language that have a letter.

    Null languages, null texts and texts without a letter teach nothing.  With so many languages
    that the sample would pass ``MOST_SAMPLED`` texts, each language gets an equal share of these.
    """
    prepare(labelled.sparkSession)
    spoken = labelled.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().count()
    if spoken > MOST_SAMPLED:
        raise ValueError(f"more than {MOST_SAMPLED} languages")
    per_language = min(per_language, MOST_SAMPLED // max(1, spoken))
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    # The rank's limit is applied before each shuffle: first in 64 parts of a language, then in all of it.
    draw = F.xxhash64(id_col)
    part = Window.partitionBy(lang_col, F.pmod(draw, F.lit(64))).orderBy(draw, id_col)
    whole = Window.partitionBy(lang_col).orderBy(draw, id_col)
    ids = usable.select(lang_col, id_col).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= per_language)
    ids = ids.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= per_language)
    # The sample's ids are few (per_language for each language, checked), so the texts stay where they are.
    picked = ids.select(id_col, lang_col).distinct().collect()
    sample = labelled.sparkSession.createDataFrame(picked, ids.select(id_col, lang_col).schema)
    chosen = usable.join(F.broadcast(sample), [id_col, lang_col], "left_semi")
    rows = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_count_mapper, "lang string, counts binary, head binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["counts"], r["head"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), np.zeros((0, len(LENGTHS) + 1)))
    counts = np.stack([np.frombuffer(r["counts"], dtype=np.float32) for r in rows])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(languages, idf, np.zeros((0, DIM)), np.zeros(0, np.int64), np.zeros(0))
    x = model.vectors(counts)
    label = np.array([languages.index(r["lang"]) for r in rows])
    groups = [_kmeans(x[label == i], clusters) for i in range(len(languages))]
    model.centroids = np.concatenate(groups).astype(np.float32)
    model.owner = np.repeat(np.arange(len(languages)), [len(g) for g in groups])
    near = lambda y, g: STRICT * np.quantile((y @ g.T).max(axis=1), QUANTILE)
    heads = [r["head"] for r in rows]
    short = [model.vectors(_counts(*_beginnings(heads, most))) for most in (2, *LENGTHS[:-1])]
    model.least = np.array([[*(near(y[label == i], g) for y in short), near(x[label == i], g)] for i, g in enumerate(groups)])
    # A longer text is never let off more easily than a shorter one.
    model.least = np.maximum.accumulate(model.least, axis=1)
    return model


def _answers(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and rejections of a column of texts."""
    raw, offsets = tk.column_bytes(column)
    names: list[str] = []
    scores, rejections = [np.zeros(0)], [np.zeros(0, dtype=bool)]
    for first, last in tk.text_chunks(offsets, 1 << 20):
        base = offsets[first : last + 1]
        buf, base = raw[base[0] : base[-1]], base - base[0]
        texts = [_LETTER.search(buf[a:b].tobytes().decode("utf-8", "replace")) is not None for a, b in zip(base[:-1], base[1:], strict=True)]
        lettered = np.array(texts)
        known = lettered & bool(model.languages)
        lang, score, rejected = np.zeros(len(known), int), np.zeros(len(known)), np.zeros(len(known), bool)
        for a in range(0, len(known), 256):
            part = slice(a, a + 256)
            if model.languages:
                off = base[a : min(a + 256, len(known)) + 1]
                lang[part], score[part], rejected[part] = model.predict(_counts(buf[off[0] : off[-1]], off - off[0]), np.diff(off))
        names += [model.languages[i] if ok else UNKNOWN for i, ok in zip(lang.tolist(), known.tolist(), strict=True)]
        scores.append(np.where(known, score, 0.0))
        rejections.append(rejected | ~lettered)
    return names, np.concatenate(scores), np.concatenate(rejections)


def _predict_mapper(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = _answers(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def _keep_mapper(model: Model, text: int, lang: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, rejected = _answers(model, batch.column(text))
            columns = list(batch.columns)
            columns[lang] = pc.coalesce(columns[lang], pa.array([None if n == UNKNOWN else n for n in names], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(~rejected))

    return run


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language isn't rejected, all columns as they are but a null language filled in."""
    return docs.mapInArrow(_keep_mapper(model, docs.columns.index(text_col), docs.columns.index(lang_col)), docs.schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, from its text alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.  If nothing was
    learned every text is ``und`` with score 0, and those with a letter aren't rejected.  Equal texts get equal answers, whatever their ids; other columns are
    ignored; an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_predict_mapper(model), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
