"""Toxicity by classifier chains over hashed words.

Categories are predicted in a fixed order by linear (logistic) models; each model after the first
also sees the probabilities of the categories before it. When it is trained, those probabilities
are out-of-fold predictions (``FOLDS`` folds by a hash of the id), so that it learns from what the
earlier models give on texts they have not seen; at prediction time the earlier models' own
probabilities go in.

A text's features are its distinct words (runs of letters of the lower-cased text), word
beginnings of ``PREFIXES`` bytes and runs of signs, hashed into ``BINS`` bins and weighted by the inverse document
frequency. Frequencies, and the choice of the bins that tell the two values of a category apart
(in ``LEAST_TEXTS`` texts at least, by a chi-square of ``SIGNIFICANT``), cover all labelled texts. A model
that predicts a fold chooses its bins from the sampled texts of the other folds alone, so that neither
its weights nor its features have seen the fold's labels.
The models are fitted on a bounded sample: about ``SAMPLE`` labelled texts of each value of each
category at most, chosen by a hash of the id. The threshold is the probability one half.

Defined results: a null or word-less text has no feature but the constant; without any label of a
category its probability is 0. Labels of ids that occur on several rows are combined by their
largest value; null labels are no labels. Extra columns are not read. One row per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, slices, span_hash, text_or_empty, without_others

BINS = 1 << 18
FOLDS = 3
SAMPLE = 2500
LEAST_TEXTS = 3
PREFIXES = (4, 5, 6)
#: Chi-square from which a bin counts as a feature of a category.
SIGNIFICANT = 20.0
STEPS = 150

#: Bytes that belong to words: letters of the lower-cased text; all others separate.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)
#: Bytes of signs; letters, digits and spaces separate them.
_SIGNS = np.full(256, 32, np.uint8)
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _SIGNS[_c] = _c


def word_bins(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature bins of each (lower-cased) text, and where each text's begin."""
    w = Words(column, _LETTERS)
    n, owner = len(w.first) - 1, w.owner()
    values = w.data.astype(np.uint64) + np.uint64(1)
    key = [owner * BINS + _bin(w.hashes())]
    for k in PREFIXES:
        long = w.end - w.start >= k
        key.append(owner[long] * BINS + _bin(span_hash(values, w.start[long], w.start[long] + k, 1)))
    signs = Words(column, _SIGNS)
    key.append(signs.owner() * BINS + _bin(signs.hashes()))
    key = np.unique(np.concatenate(key))
    return (key % BINS).astype(np.int32), np.searchsorted(key // BINS, np.arange(n + 1))


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray  # weights of the earlier categories' probabilities
    constant: float


@dataclass
class Chain:
    categories: list[str]
    idf: np.ndarray
    models: list[Linear | None] = field(default_factory=list)

    def probabilities(self, bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row per text, one column per category, each model fed by those before it."""
        out = np.zeros((len(starts) - 1, len(self.categories)))
        for c, m in enumerate(self.models):
            if m is not None:
                out[:, c] = _sigmoid(_sums(m.weights[bins], starts) + out[:, :c] @ m.extra + m.constant)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _fit(bins, starts, idf, extra, y) -> Linear:
    """Logistic regression by Adagrad over all texts at once, with a light ridge; both values weigh the same."""
    n = len(y)
    used = idf[bins] > 0
    starts, bins = np.concatenate([[0], np.cumsum(used)])[starts], bins[used]
    owner = np.repeat(np.arange(n), np.diff(starts))
    value = idf[bins]
    used, at = np.unique(bins, return_inverse=True)
    w, e, b = np.zeros(len(used)), np.zeros(extra.shape[1]), 0.0
    gw, ge, gb = np.full(len(used), 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    for _ in range(STEPS):
        z = _sums(w[at] * value, starts) + extra @ e + b
        d = (_sigmoid(z) - y) * weight
        dw = np.bincount(at, value * d[owner], minlength=len(used)) + 1e-6 * w
        de, db = extra.T @ d, d.sum()
        gw += dw * dw
        ge += de * de
        gb += db * db
        w -= 0.2 * dw / np.sqrt(gw)
        e -= 0.2 * de / np.sqrt(ge)
        b -= 0.2 * db / np.sqrt(gb)
    full = np.zeros(BINS, np.float32)
    full[used] = w * idf[used]
    return Linear(full, e, float(b))


def _rows(bins, starts, keep) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(starts)
    take = np.repeat(keep, sizes)
    return bins[take], np.concatenate([[0], np.cumsum(sizes[keep])])


def _chi_square(given: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Chi-square of each bin against a category; the last entries count all texts."""
    n, y = given[-1], ones[-1]
    a, x = ones[:-1], given[:-1]
    spread = x * (n - x) * y * (n - y)
    return np.where(spread > 0, n * (a * n - x * y) ** 2 / np.maximum(spread, 1.0), 0.0)


def _telling(counts: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
    """``weight`` of the bins that tell the values of some category apart, 0 for all others."""
    told = np.zeros(len(weight), bool)
    for given, ones in counts:
        told |= _chi_square(given, ones) >= SIGNIFICANT
    return np.where(told, weight, 0).astype(np.float32)


def _counted(bins, starts, y, keep) -> tuple[np.ndarray, np.ndarray]:
    """How many of the kept texts with a value of ``y`` hold each bin, and how many of value 1; last, all of those."""
    out = []
    for which in (keep & ~np.isnan(y), keep & (y == 1)):
        held, _ = _rows(bins, starts, which)
        out.append(np.append(np.bincount(held, minlength=BINS), which.sum()).astype(np.float64))
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> Chain:
    """A chain from labelled texts; ``categories`` maps each category, in order, to a 0/1 SQL expression over labels."""
    names = list(categories)
    known = labels.groupBy(F.col("doc_id").alias("__id")).agg(*[F.max(F.expr(e).cast("int")).alias(c) for c, e in categories.items()]).filter("__id is not null")
    known = cut(known, "toxicity-labels")
    texts = docs.select(F.col("doc_id"), F.lower(text_or_empty()).alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))

    def with_texts(some: DataFrame) -> DataFrame:
        """``some`` with their texts; most texts without a label never reach the shuffle."""
        held = without_others(texts, some.select(F.xxhash64(F.col("__id").cast("string")).alias("h"))).drop("h")
        return held.join(some, F.col("doc_id") == F.col("__id"))

    labelled = with_texts(known).drop("doc_id")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of counts: all texts, then for each category those given and those of value 1
        total = np.zeros((1 + 2 * len(names), BINS + 1), np.int64)
        for part in slices(batches):
            bins, starts = word_bins(part.column(0))
            bins, starts = np.append(bins, np.full(part.num_rows, BINS, np.int32)), starts
            owner = np.append(np.repeat(np.arange(part.num_rows), np.diff(starts)), np.arange(part.num_rows))
            total[0] += np.bincount(bins, minlength=BINS + 1)
            for k in range(len(names)):
                y = part.column(1 + k).to_numpy(zero_copy_only=False).astype(np.float64)[owner]
                total[1 + 2 * k] += np.bincount(bins[~np.isnan(y)], minlength=BINS + 1)
                total[2 + 2 * k] += np.bincount(bins[y == 1], minlength=BINS + 1)
        held = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bin": held} | {f"c{k}": total[k][held] for k in range(len(total))})

    # At most BINS + 1 rows come back, however large the input.
    columns = [f"c{k}" for k in range(1 + 2 * len(names))]
    counted = labelled.select("text", *names).mapInArrow(frequencies, "bin long, " + ", ".join(f"{c} long" for c in columns))
    rows = counted.groupBy("bin").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    counts = np.zeros((len(columns), BINS + 1))
    counts[:, rows["bin"].to_numpy(np.int64)] = rows[columns].to_numpy(np.float64).T
    df, n = counts[0, :BINS], counts[0, BINS]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    usual = df >= LEAST_TEXTS
    weight = np.where(usual, idf / max(1.0, float(idf.max())), 0).astype(np.float32)
    idf = _telling([(counts[1 + 2 * k], counts[2 + 2 * k]) for k in range(len(names))], weight)
    chain = Chain(names, idf)

    cells = {(c, v): known.filter(F.col(c) == v).count() for c in names for v in (0, 1)}
    slot = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    wanted = F.lit(False)
    for (c, v), size in cells.items():
        if size:
            wanted = wanted | ((F.col(c) == v) & (slot < min(1.0, SAMPLE / size)))
    sample = known.withColumn("id", F.col("__id").cast("string")).filter(wanted)
    sample = with_texts(sample.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bins, starts = word_bins(part.column(0))
            kept = [x[weight[x] > 0].tobytes() for x in (bins[a:b] for a, b in zip(starts, starts[1:]))]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(kept, pa.binary())], [*part.schema.names[1:], "bins"])

    schema = f"id string, {', '.join(f'{c} int' for c in names)}, fold int, bins binary"
    got = sample.select("text", "id", *names, "fold").mapInArrow(hashed, schema).toPandas().sort_values(["id", "bins"], kind="stable")
    each = [np.frombuffer(x, np.int32) for x in got["bins"]]
    bins = np.concatenate(each) if each else np.zeros(0, np.int32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    fold = got["fold"].to_numpy()
    earlier = np.zeros((len(got), 0))
    for c in names:
        y = got[c].to_numpy(np.float64, na_value=np.nan)
        given = ~np.isnan(y)
        if not given.any():
            chain.models.append(None)
            earlier = np.column_stack([earlier, np.zeros(len(got))])
            continue
        chain.models.append(_fit(*_rows(bins, starts, given), idf, earlier[given], y[given]))
        if c != names[-1]:
            held = np.zeros(len(got))
            for k in range(FOLDS):
                inside, out = given & (fold != k), fold == k
                if inside.any() and out.any():
                    seen = _telling([_counted(bins, starts, got[n].to_numpy(np.float64, na_value=np.nan), fold != k) for n in names], weight)
                    m = _fit(*_rows(bins, starts, inside), seen, earlier[inside], y[inside])
                    b, s = _rows(bins, starts, out)
                    held[out] = _sigmoid(_sums(m.weights[b], s) + earlier[out] @ m.extra + m.constant)
            earlier = np.column_stack([earlier, held])
    return chain


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> of every row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = shared.value.probabilities(*word_bins(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])]], ["doc_id", *names])

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} double" for c in names)
    return docs.select("doc_id", F.lower(text_or_empty()).alias("text")).mapInArrow(run, schema)
