"""Helpers shared by the operators: shared-folder tables, word splitting and rolling hashes.

A *word* everywhere is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Characters that separate words (fixed by the contracts).
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = (1 << 19) - 1

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is configured, a local session gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone at exit; the folder is scratch space
        pass


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends there.

    With ``by``, its last column, rows of one value lie in a folder of their own.

    Survives lost executors, and later passes prune columns of the stored table instead of
    recomputing. The table is removed by ``discard``, at the latest when the driver exits.
    """
    return cut_all([df], name, by)


def cut_all(parts: Iterable[DataFrame], name: str, by: str | None = None) -> DataFrame:
    """The union of ``parts``, written one after the other into one table as ``cut`` does."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        if path is None:
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            atexit.register(_remove, spark, path)
        out = df.write.option("compression", "zstd").mode("append")
        (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that no plan still to be run reads."""
    for t in tables:
        if getattr(t, "scratch", None):
            _remove(t.sparkSession, t.scratch)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def next_pow2(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


# ---------------------------------------------------------------- filters over all partitions

BLOCK_POSITIONS = 1 << 20
SKETCH = "block long, positions binary"
MERGED = "block long, packed boolean, bits binary"


def block_width(bits: int, entries: int) -> int:
    """Positions per block, so that merging one block sees about ``BLOCK_POSITIONS`` entries."""
    return max(1, bits // next_pow2(max(1, max(bits, entries) // BLOCK_POSITIONS)))


def emit_positions(pos: np.ndarray, width: int) -> pa.RecordBatch:
    """What one partition adds to a filter: its positions by block, one entry per time it sets one, two at most."""
    pos, times = np.unique(pos, return_counts=True)
    pos = np.repeat(pos, np.minimum(times, 2)).astype(np.uint64)
    ids, at = np.unique(pos // np.uint64(width), return_index=True)
    within = (pos % np.uint64(width)).astype(np.uint32)
    return pa.RecordBatch.from_pydict(
        {"block": ids.astype(np.int64), "positions": [x.tobytes() for x in np.split(within, at[1:])][: len(ids)]},
        pa.schema([("block", pa.int64()), ("positions", pa.binary())]),
    )


def repeated_positions(sketches: DataFrame, bits: int, width: int, times_set: int = 2) -> np.ndarray:
    """Bitmap (``bits`` / 8 bytes, all that the driver receives) of the positions that all partitions together set at least so often."""

    def merge(key, pdf):
        pos, times = np.unique(np.frombuffer(b"".join(pdf["positions"]), np.uint32), return_counts=True)
        pos = pos[times >= times_set]
        packed = 32 * len(pos) > width  # whichever is shorter: the bits, or where they are
        if packed:
            held = np.zeros(width, bool)
            held[pos] = True
        return pd.DataFrame({"block": [key[0]], "packed": [packed], "bits": [np.packbits(held, bitorder="little").tobytes() if packed else pos.tobytes()]})

    bitmap = np.zeros(max(1, bits // 8), np.uint8)
    for row in sketches.groupBy("block").applyInPandas(merge, MERGED).toLocalIterator():
        at = row["block"] * width
        if row["packed"] and width % 8 == 0:
            bitmap[at // 8 : (at + width) // 8] = np.frombuffer(row["bits"], np.uint8)
        else:
            held = np.frombuffer(row["bits"], np.uint8 if row["packed"] else np.uint32)
            pos = (np.flatnonzero(np.unpackbits(held, bitorder="little")) if row["packed"] else held).astype(np.int64) + at
            np.bitwise_or.at(bitmap, pos >> 3, (1 << (pos & 7)).astype(np.uint8))
    return bitmap


def is_set(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    pos = pos.astype(np.int64)
    return ((bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).astype(bool)


#: Bits of a bitmap that is broadcast to leave out rows before a shuffle (32 MB at most).
MAX_FILTER_BITS = 1 << 28


def without_others(rows: DataFrame, wanted: DataFrame, column: str = "h") -> DataFrame:
    """``rows`` whose ``column`` (a long hash) may be one of ``wanted``'s: none of those is lost, some others stay.

    Saves shuffling rows that a join with ``wanted`` would drop; the join still decides. With more
    wanted rows than half the bits such a bitmap tells little, and all rows go to the join.
    """
    n = wanted.count()
    if n > MAX_FILTER_BITS // 2:
        return rows
    bits = min(MAX_FILTER_BITS, max(1 << 16, next_pow2(16 * n)))
    width = block_width(bits, n)

    def mark(batches):
        for batch in batches:
            if batch.num_rows:
                yield emit_positions(batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1), width)

    shared = rows.sparkSession.sparkContext.broadcast(repeated_positions(wanted.select(column).mapInArrow(mark, SKETCH), bits, width, 1))

    def test(batches):
        for batch in batches:
            h = batch.column(batch.schema.get_field_index(column)).to_numpy().view(np.uint64)
            hit = is_set(shared.value, h & np.uint64(bits - 1))
            if hit.any():
                yield batch.filter(pa.array(hit))

    return rows.mapInArrow(test, rows.schema)


# ---------------------------------------------------------------- bytes and words


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Re-slice batches so that each carries about ``limit`` bytes of text (one text at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = _buffers(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


class Words:
    """Words of a slice of texts: byte data, start, end, index of text, first word of each text."""

    def __init__(self, column: pa.Array, letters: np.ndarray | None = None):
        """``letters`` maps each byte to the one it counts as, for instance signs to blanks."""
        raw, offsets = _buffers(column)
        data = raw[offsets[0] : offsets[-1]]
        data = data if letters is None else letters[data]
        self.offsets = offsets - offsets[0]
        self.data = data
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~_IS_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True  # a text's end is its successor's start
        self.start = np.flatnonzero(word[1:-1] & (~word[:-2] | begins[:-1]))
        self.end = np.flatnonzero(word[1:-1] & (~word[2:] | begins[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, 0)


#: Odd multipliers of published 64-bit mixers (golden ratio, and two of wyhash's).
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Longest table of powers that a worker process keeps (8 MB for each of two tables).
KEPT_POWERS = 1 << 20


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a multiplier, and of its inverse."""
    up, down = _POWERS.get(which, (np.ones(1, np.uint64),) * 2)
    if len(up) < n:
        size = next_pow2(max(n, 1 << 16))
        base = _ODD[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        if size <= KEPT_POWERS:
            _POWERS[which] = (up, down)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result (fixed values: those of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, independent of where the span lies."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(which, len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[(which + 1) % 3])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- rows by id and text

LARGEST = (1 << 63) - 1


def row_id(docs: DataFrame, name: str = "doc_id"):
    """The id as a number; a null id counts as larger than all others. Ids must be whole numbers."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{name} must be a whole number, not {kind.simpleString()}")
    return F.coalesce(F.col(name).cast("long"), F.lit(LARGEST))


def keyed(docs: DataFrame) -> DataFrame:
    """id, th (a hash that tells the texts of one id apart), text (a null is empty)."""
    text = text_or_empty()
    return docs.select(row_id(docs).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (id, th, kept; one row per row) keeps, with their columns.

    Rows that repeat an id and text are one document listed again: one of them stays.
    """
    i, t, k_i, k_t, rows = unused(docs, "i", "t", "k_i", "k_t", "rows")
    keys = decided.groupBy(F.col("id").alias(k_i), F.col("th").alias(k_t)).agg(F.max("kept").alias("kept"), F.count("*").alias(rows))
    keys = cut(keys.filter("kept").drop("kept"), "kept-rows")
    marked = docs.withColumns({i: row_id(docs), t: F.xxhash64(text_or_empty())})

    def match(some: DataFrame) -> DataFrame:
        return marked.join(some, (marked[i] == some[k_i]) & (marked[t] == some[k_t]), "left_semi")

    repeated = keys.filter(F.col(rows) > 1)
    if repeated.isEmpty():
        return match(keys).drop(i, t)
    return match(keys.filter(F.col(rows) == 1)).unionByName(match(repeated).dropDuplicates([i, t])).drop(i, t)
