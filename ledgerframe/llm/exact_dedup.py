"""Exact deduplication: a two-pass Bloom filter, then exact grouping of possibly repeated hashes.

Pass 1 sets k bits per fingerprint in a filter that tells "set once" from "set again": each
partition sends the positions it set (and those it set twice), blocks of the filter are merged by
position, and the bits set at least twice come back as one bitmap. Pass 2 tests each fingerprint;
only those with all k bits set twice are shuffled and grouped exactly, all others are unique for
certain and pass straight through.

Fingerprints are dealt into ranges of their hash of about ``RANGE_ROWS`` rows, each with a filter of its
own and the same number of bits a row: the filter never fills up, so that the share of unique rows
let through (about 0.24 %) is the same at every size, and the bitmap that is broadcast stays below
128 MB. Each further range costs one more scan of the stored fingerprints' hashes, not of the texts.

Defined results: a null text counts as empty, and all empty (or all-white) texts are equal. Among
equal texts the row with most code points stays, then the smallest doc_id (null ids last), then
one arbitrary row among rows that agree in both. Columns besides doc_id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SKETCH, SPACES, block_width, cut, cut_all, discard, emit_positions, is_set, keep_rows, next_pow2, repeated_positions, row_id, text_or_empty

BITS_PER_ROW = 16
HASHES = 4
RANGE_ROWS = 1 << 26


def normalised(column):
    """The text without any space character; a null is empty."""
    return F.translate(column, SPACES, "")


def fingerprints(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id"),
        F.xxhash64(text).alias("th"),
        F.unhex(F.sha2(normalised(text), 256)).alias("sha"),
        F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("rid"),
    )


def _positions(sha: pa.Array, bits: int) -> np.ndarray:
    """k positions of each fingerprint, as rows, by double hashing of its first 16 bytes."""
    raw = np.frombuffer(b"".join(x[:16] for x in sha.to_pylist()), np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        steps = np.arange(HASHES, dtype=np.uint64)
        return (raw[:, :1] + steps * (raw[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def _repeated_bits(fp: DataFrame, n: int, bits: int) -> np.ndarray:
    """Bitmap of the positions that at least two rows set."""
    width = block_width(bits, HASHES * n)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield emit_positions(_positions(batch.column(0), bits).ravel(), width)

    return repeated_positions(fp.select("sha").mapInArrow(sketch, SKETCH), bits, width)


def flag_possible_repeats(fp: DataFrame, range_rows: int = RANGE_ROWS) -> Iterator[DataFrame]:
    """The rows of ``fp`` with ``maybe``, range by range: false only where no other row has the same fingerprint."""
    n = fp.count()
    ranges = max(1, -(-n // range_rows))
    rows = -(-n // ranges)
    bits = max(1 << 16, next_pow2(BITS_PER_ROW * rows))
    for r in range(ranges):
        mine = fp if ranges == 1 else fp.filter(F.pmod(F.xxhash64("sha"), F.lit(ranges)) == r)
        shared = fp.sparkSession.sparkContext.broadcast(_repeated_bits(mine, rows, bits))

        def test(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bitmap = shared.value
            for batch in batches:
                pos = _positions(batch.column(batch.schema.get_field_index("sha")), bits).astype(np.int64)
                hit = is_set(bitmap, pos).all(axis=1)
                yield batch.append_column("maybe", pa.array(hit))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fp.schema.fields)
        yield mine.mapInArrow(test, schema + ", maybe boolean")
        shared.unpersist()


def exact_duplicates(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, sha (binary), th."""
    fp = cut(fingerprints(docs), "dedup-fingerprints")
    tested = cut_all(flag_possible_repeats(fp, range_rows), "dedup-tested")
    discard(fp)
    possible = tested.filter("maybe").drop("maybe")
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    groups = possible.groupBy("sha").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    # Stored, so that both sides of the join are plain exchanges and a hot group can be split.
    groups = cut(groups, "dedup-groups")
    grouped = possible.join(groups, "sha").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "sha", "th"
    )
    single = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "th")
    return single.unionByName(grouped)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with the columns of ``docs``."""
    return keep_rows(docs, exact_duplicates(docs).select(row_id(docs).alias("id"), "th", "kept"))
