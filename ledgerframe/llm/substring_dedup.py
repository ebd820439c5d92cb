"""Substring deduplication: remove passages that an earlier document holds, word for word.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window whose
word sequence also starts in a document of smaller id goes. Windows are judged on the input.

Pass 1 counts windows in a count-min sketch. Its key of a window is the smallest hash among the
``SEED``-word runs inside it: equal windows have equal keys, and neighbouring windows mostly share
one, so that a text has about one key per 13 words and a key's count is never below the count of
any of its windows. Each partition sends what it adds to the counters (saturating at two), blocks
of counters are merged by position, and a bitmap of the counters that reach two comes back. Pass 2
looks up every key; only windows estimated as repeated are grouped exactly, by a 128-bit hash
of their words, and each group's smallest id decides. None is lost: an estimate is never too low.

Keys are dealt into ranges of their hash of about ``RANGE_KEYS`` keys. Each has a sketch of its own,
with the same number of counters a key, that the range's keys are looked up in: the share of
unrepeated windows let through is the same at every size. Each document's keys that are estimated
as repeated then go back to its text. A range is written and read once; one job follows another.

Documents that repeat a whole earlier document are settled by a hash of the whole before that.

Defined results: a null text has no words. Ids compare as numbers, a null id as larger than all
others. Rows that repeat an id and text are judged alike, rows of one id never remove from one
another. Texts shorter than a window are left alone. Columns besides doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SKETCH, Words, as_long, block_width, cut, cut_all, discard, emit_positions, is_set, keyed, mix, next_pow2, repeated_positions, slices, span_hash, without_others

WINDOW = 50
SEED = 25
ROWS = 2
#: Counters per key in each row of a sketch, and keys of one sketch (a bitmap of 32 MB a row at most).
COUNTERS_PER_KEY = 8
RANGE_KEYS = 1 << 25


class Windows:
    """Windows of a slice of texts: first word, text, and sketch key of each."""

    def __init__(self, column: pa.Array, window: int = WINDOW, seed: int = SEED):
        self.words = Words(column)
        self.hashes = self.words.hashes()
        self.window = window
        n, first = len(self.hashes), self.words.first
        stop = np.repeat(first[1:], self.words.counts())  # end of each word's text
        self.at = np.flatnonzero(np.arange(n) + window <= stop)
        self.text = self.words.owner()[self.at]
        seeds = np.arange(max(0, n - seed + 1))
        value = span_hash(self.hashes, seeds, seeds + seed, 0)
        width = window - seed + 1
        step, low = 1, value
        while step * 2 <= width:  # minimum over ``step`` neighbours, doubled
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            step *= 2
        self.key = np.minimum(low[self.at], low[self.at + width - step]) if len(self.at) else np.zeros(0, np.uint64)

    def hash128(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[which]
        return span_hash(self.hashes, at, at + self.window, 1), span_hash(self.hashes, at, at + self.window, 2)


def counters(key: np.ndarray, size: int) -> np.ndarray:
    """Position of each key in each of the sketch's rows, laid end to end."""
    with np.errstate(over="ignore"):
        rows = [mix(key + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(size - 1) for r in range(ROWS)]
    return np.stack([x + np.uint64(r * size) for r, x in enumerate(rows)], axis=1)


def _summaries(docs: DataFrame, window: int) -> DataFrame:
    """One row per document: id, th, n_words, hash of all words, digest of all words, sketch keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Windows(part.column(2), window, window // 2)
            first = w.words.first
            h1, h2 = (span_hash(w.hashes, first[:-1], first[1:], r) for r in (1, 2))
            cuts = np.searchsorted(w.text, np.arange(part.num_rows + 1))
            keys = [np.unique(w.key[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
            shas = [sha256(b" ".join(t.encode().split())).digest() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(w.words.counts().astype(np.int64)), pa.array(as_long(h1)), pa.array(as_long(h2)), pa.array(shas, pa.binary()), pa.array(keys, pa.binary())],
                ["id", "th", "n_words", "h1", "h2", "sha", "keys"],
            )

    return keyed(docs).mapInArrow(run, "id long, th long, n_words long, h1 long, h2 long, sha binary, keys binary")


def _flat(keys: pa.Array) -> np.ndarray:
    """All keys of a column that holds a list, the bytes of several, or one in each row."""
    if pa.types.is_binary(keys.type):
        return np.frombuffer(b"".join(keys.to_pylist()), np.uint64)
    return (keys.flatten() if pa.types.is_list(keys.type) else keys).to_numpy(zero_copy_only=False).view(np.uint64)


def _sketch(firsts: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bitmap of the counters that reach two over the keys of ``firsts``, about n; and the counters per row."""
    size = max(1 << 15, next_pow2(COUNTERS_PER_KEY * n + 1))
    bits = ROWS * size
    width = block_width(bits, ROWS * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _flat(batch.column(0))
            if len(key):
                yield emit_positions(counters(key, size).ravel(), width)

    return repeated_positions(firsts.select("keys").mapInArrow(run, SKETCH), bits, width), size


def _estimate(bitmap: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """Whether each key's estimated count is two or more."""
    return is_set(bitmap, counters(key, size)).all(axis=1) if len(key) else np.zeros(0, bool)


def _dealt(own: DataFrame, ranges: int) -> DataFrame:
    """id, th, key, and the range of its hash, of every key; the rows of a range lie together."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _flat(batch.column(2))
            each = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in batch.column(2).to_pylist()]))
            part = ((mix(~key) >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(as_long(key)), pa.array(part)], ["id", "th", "keys", "part"])

    rows = own.select("id", "th", "keys").mapInArrow(deal, "id long, th long, keys long, part long")
    return cut(rows.repartition("part", F.pmod("th", F.lit(16))), "substring-dealt", "part")


def _repeated_keys(dealt: DataFrame, ranges: int, n: int) -> Iterator[DataFrame]:
    """The rows of ``dealt`` whose key is estimated as repeated, range by range."""
    for r in range(ranges):
        mine = dealt.filter(F.col("part") == r).drop("part")
        bitmap, size = _sketch(mine, -(-n // ranges))
        shared = dealt.sparkSession.sparkContext.broadcast(bitmap)

        def test(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_estimate(shared.value, size, _flat(batch.column(2))), pa.bool_()))

        yield mine.mapInArrow(test, mine.schema)
        shared.unpersist()


def removals(docs: DataFrame, window: int = WINDOW, keep: str = "sha", range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row per document: id, th, n_words, n_removed, kept_sha (of the words that stay).

    With ``keep="text"`` rows that lose words also carry those that stay, in ``kept``.
    """
    every = cut(_summaries(docs, window), "substring-documents")
    copies = every.filter(F.col("n_words") >= window).groupBy("h1", "h2", "n_words").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copies = cut(copies.filter("first < last").drop("last"), "substring-copies")
    judged = every.join(copies, ["h1", "h2", "n_words"], "left")
    judged = cut(judged.select("id", "th", "n_words", "sha", "keys", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy")), "substring-judged")
    own = judged.filter("not copy")
    touched = _partial(_candidates(docs, own, range_keys), window, keep)
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    out = judged.join(touched, ["id", "th"], "left").select(
        "id",
        "th",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce(F.col("removed"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce(F.col("kept_sha"), F.col("sha"))).alias("kept_sha"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep == "text" else []),
    )
    return out


def _candidates(docs: DataFrame, own: DataFrame, range_keys: int) -> DataFrame:
    """id, th, text of the documents with keys estimated as repeated, and these keys."""
    n = int(own.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0)) / 8).first()[0])
    ranges = max(1, -(-n // range_keys))
    dealt = _dealt(own, ranges)
    found = cut_all(_repeated_keys(dealt, ranges, n), "substring-repeated")
    discard(dealt)
    hits = cut(found.groupBy("id", "th").agg(F.collect_set("keys").alias("keys")), "substring-hits")
    rows = without_others(keyed(docs), hits.select("th"), "th")
    texts = cut(rows.join(hits, ["id", "th"]).select("id", "th", "text", "keys"), "substring-candidates")
    discard(found, hits)
    return texts


def _partial(texts: DataFrame, window: int, keep: str) -> DataFrame:
    """Documents that lose words to another's window: id, th, removed, kept_sha (and kept)."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Windows(part.column(2), window, window // 2)
            which = np.flatnonzero(np.isin(w.key, _flat(part.column(3))))  # a key repeated for one text is so for all
            if not len(which):
                continue
            a, b = w.hash128(which)
            text, at = w.text[which], (w.at[which] - w.words.first[w.text[which]]).astype(np.int32)
            by = np.lexsort((at, b, a, text))  # a window repeated within one text is one row
            text, a, b, at = text[by], a[by], b[by], at[by]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(text))
            raw = at.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text[starts])), part.column(1).take(pa.array(text[starts])), pa.array(as_long(a[starts])), pa.array(as_long(b[starts])), pa.array([raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())],
                ["id", "th", "a", "b", "at"],
            )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept = [], [], []
            for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.frombuffer(b"".join(places), np.int32))
                step[at] += 1
                np.subtract.at(step, at + window, 1)
                gone = np.cumsum(step[:-1]) > 0
                rest = b" ".join(x for x, g in zip(words, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                shas.append(sha256(rest).digest())
                kept.append(rest.decode())
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.binary())]
            names = ["id", "th", "removed", "kept_sha"]
            if keep == "text":
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    found = texts.mapInArrow(occurrences, "id long, th long, a long, b long, at binary")
    firsts = found.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    firsts = cut(firsts, "substring-firsts")  # both sides of the next join are plain exchanges: hot windows can be split
    hits = found.join(firsts, ["a", "b"]).filter("id > first").groupBy("id", "th").agg(F.collect_list("at").alias("places"))
    stripped = texts.join(hits, ["id", "th"]).select("id", "th", "text", "places")
    schema = "id long, th long, removed long, kept_sha binary" + (", kept string" if keep == "text" else "")
    return stripped.mapInArrow(strip, schema).dropDuplicates(["id", "th"])
