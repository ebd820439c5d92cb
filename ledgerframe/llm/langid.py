"""Language identification: nearest of several clustered centroids per language, with rejection.

A text becomes a normalised TF-IDF vector of hashed letter n-grams (1 to 4 bytes of the
lower-cased text, words set off by one blank). Each language has ``CLUSTERS`` centroids, from
spherical k-means over a bounded sample of its labelled texts; a text gets the language of the
centroid of the largest cosine. It is rejected when that cosine is below ``REJECT`` of the
smallest usual cosine in the sample (its 0.1 % quantile), or when it holds no letter.

Document frequencies cover every labelled training text; only the k-means fit uses a sample:
at most about ``SAMPLE_TEXTS`` texts in all and ``SAMPLE_PER_LANGUAGE`` of one language, chosen by
a hash of the id.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected; so
is every text when nothing is labelled. Ties between centroids go to the language that sorts
first. One row per row; only doc_id and text are read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import _buffers, slices, text_or_empty, unused

BINS = 1 << 13
GRAMS = 4
CLUSTERS = 4
ROUNDS = 8
SAMPLE_TEXTS = 8000
SAMPLE_PER_LANGUAGE = 1000
REJECT = 0.5
SLICE_TEXTS = 64

_KEEP = np.zeros(256, bool)
_KEEP[ord("a") : ord("z") + 1] = True
_KEEP[128:] = True


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, one row per (lower-cased) text."""
    raw, offsets = _buffers(column)
    data, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    letters = np.where(_KEEP[data], data, np.uint8(32))
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (owner[1:] != owner[:-1])
    letters, owner = letters[keep].astype(np.uint32), owner[keep]
    out = np.zeros(n * BINS, np.float32)
    code = letters.copy()
    for g in range(1, GRAMS + 1):
        if g > 1:
            code = (code[:-1] << np.uint32(8)) | letters[g - 1 :]
        if not len(code):
            break
        same = owner[: len(code)] == owner[g - 1 :]
        bins = ((code * np.uint32(2654435761) + np.uint32(g * 40503)) >> np.uint32(32 - 13)).astype(np.int64)
        out += np.bincount(owner[: len(code)][same] * BINS + bins[same], minlength=n * BINS).astype(np.float32)
    return out.reshape(n, BINS)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    language_of: np.ndarray
    threshold: float


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.lower(text_or_empty()).alias("text"))


def _small(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for part in slices(batches, text=text):
        for at in range(0, part.num_rows, SLICE_TEXTS):
            yield part.slice(at, SLICE_TEXTS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bin, over all of ``docs``; and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(BINS, np.int64), 0
        for part in _small(batches):
            total += (gram_counts(part.column(0)) > 0).sum(axis=0)
            texts += part.num_rows
        yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS + 1), "df": np.append(total, texts)})

    rows = _texts(docs).mapInArrow(count, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(BINS + 1, np.int64)
    for r in rows:
        out[r["bin"]] = r["df"]
    return out[:BINS], int(out[BINS])


def _clusters(x: np.ndarray) -> np.ndarray:
    """Unit centroids by spherical k-means, started from texts far from one another."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[picked[0]]
    while len(picked) < min(CLUSTERS, len(x)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    centroids = x[picked].copy()
    for _ in range(ROUNDS):
        at = np.argmax(x @ centroids.T, axis=1)
        for k in range(len(centroids)):
            if (at == k).any():
                mean = x[at == k].mean(axis=0)
                centroids[k] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centroids


def _shares(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """A small table (lang, share) to be broadcast; one row a language."""
    return F.broadcast(df.sparkSession.createDataFrame(list(values.items()), "lang string, share double"))


def _vectors(sample: DataFrame) -> DataFrame:
    """lang, h (a hash of the text) and the gram counts of each text: at most ``BINS`` of 6 bytes, however long the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            counts = gram_counts(part.column(2))
            held = [np.flatnonzero(row) for row in counts]
            bins = pa.array([h.astype(np.uint16).tobytes() for h in held], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bins, pa.array([row[h].tobytes() for row, h in zip(counts, held)], pa.binary())], ["lang", "h", "bins", "counts"])

    lower = F.lower(F.col("text"))
    return sample.select("lang", F.xxhash64(lower).alias("h"), lower.alias("text")).mapInArrow(run, "lang string, h long, bins binary, counts binary")


def fit(labelled: DataFrame) -> Model | None:
    """A model from the rows of ``labelled`` (doc_id, text, lang) whose lang and text are usable."""
    usable = labelled.filter(F.col("lang").isNotNull() & text_or_empty().rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS // len(languages)))
    df, texts = document_frequencies(usable)
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(4)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = _shares(usable, {k: min(1.0, each / sizes[k]) for k in languages})
    sample = usable.join(share, "lang").withColumn("slot", slot)
    # A tiny language that the hash left out entirely gives the text of its smallest slot.
    least = usable.withColumn("slot", slot).groupBy("lang").agg(F.min("slot").alias("least"))
    sample = sample.join(F.broadcast(least), "lang").filter((F.col("slot") < F.col("share")) | (F.col("slot") == F.col("least")))
    rows = sorted(_vectors(sample).collect(), key=lambda r: (r["lang"], r["h"], bytes(r["bins"])))
    centroids, owners, cosines = [], [], []
    for k, lang in enumerate(languages):
        mine = [r for r in rows if r["lang"] == lang]
        x = np.zeros((len(mine), BINS), np.float32)
        for row, r in zip(x, mine):
            row[np.frombuffer(r["bins"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
        x = weigh(x, idf)
        c = _clusters(x)
        centroids.append(c)
        owners += [k] * len(c)
        cosines.append((x @ c.T).max(axis=1))
    usual = float(np.quantile(np.concatenate(cosines), 0.001))
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(owners), REJECT * usual)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected for every row of ``docs``."""
    return annotated(docs.select("doc_id", "text"), model).drop("text")


def annotated(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected, their names after ``prefix``; they replace columns of those names."""
    made = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*made)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    lower, has_letter = unused(docs, "lower", "lettered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in _small(batches, lower):
            n = part.num_rows
            lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            lettered = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
            if m is not None and lettered.any():
                cosine = weigh(gram_counts(part.column(1)), m.idf) @ m.centroids.T
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(n), best].astype(np.float64), 0.0, 1.0)
                lang = np.where(lettered, np.array(m.languages, object)[m.language_of[best]], lang)
                score = np.where(lettered, top, 0.0)
                rejected = ~lettered | (top < m.threshold)
            found = [pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *found], [*names, *made])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(has_letter)
    schema = StructType([*docs.schema.fields, *(StructField(c, t) for c, t in zip(made, (StringType(), DoubleType(), BooleanType())))])
    return docs.select(lettered, F.lower(text_or_empty()).alias(lower), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
