"""Set-oriented appends: classify many batches at once, then assign versions and positions.

The order of decisions per batch: an empty batch does nothing; a batch that repeats any event the
stream already holds is a duplicate as a whole and writes nothing; then the guard; then all of
the batch is written. Events repeated inside one new batch are all stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import ANY, EMPTY_STREAM, NO_STREAM, STREAM_EXISTS
from .replay import replay


def guard(expected: Column, last: Column) -> Column:
    """Whether a stream at version ``last`` (-1: it does not exist) is what an append expects.

    0 asks for an empty stream, as -1 does: an exact version 0 can't be expected.
    """
    return (
        F.when(expected == ANY, F.lit(True))
        .when(expected.isin(NO_STREAM, EMPTY_STREAM), last == -1)
        .when(expected == STREAM_EXISTS, last >= 0)
        .otherwise(expected == last)
    )


def _batches(requests: DataFrame, log: DataFrame) -> DataFrame:
    """One row per batch: size, ids and repeats (whether its stream holds any of its events).

    Only the requests' own keys are looked up in the log, which is neither sorted nor made distinct.
    """
    keys = requests.filter("event_id is not null").select("stream_id", "event_id").distinct()
    known = log.select("stream_id", "event_id").join(keys, ["stream_id", "event_id"], "left_semi").distinct().withColumn("known", F.lit(True))
    marked = requests.join(known, ["stream_id", "event_id"], "left")
    return marked.groupBy("batch_id", "stream_id", "expected_version").agg(F.count("event_id").alias("size"), F.collect_set("event_id").alias("ids"), F.coalesce(F.max("known"), F.lit(False)).alias("repeats"))


def classify(requests: DataFrame, heads: DataFrame, log: DataFrame) -> DataFrame:
    """One row per batch: batch_id, stream_id, outcome, next_expected_version, last_global_position, deduplicated, actual_version.

    ``requests``: batch_id, stream_id, expected_version, seq, event_id (null in an empty batch's one
    row); one batch per stream at most (``settle`` deals with more). ``heads``: stream_id,
    current_version, head_position. A write's last position is null until it is assigned.
    """
    batches = _batches(requests, log)
    b = batches.join(heads.select("stream_id", "current_version", "head_position"), "stream_id", "left").fillna({"current_version": -1, "head_position": 0})
    outcome = (
        F.when(F.col("size") == 0, "noop")
        .when(F.col("repeats"), "duplicate")
        .when(guard(F.col("expected_version"), F.col("current_version")), "appended")
        .otherwise("conflict")
    )
    b = b.withColumn("outcome", outcome)
    written = F.col("outcome") == "appended"
    return b.select(
        "batch_id",
        "stream_id",
        "outcome",
        F.when(written, F.col("current_version") + F.col("size")).when(F.col("outcome") != "conflict", F.col("current_version")).alias("next_expected_version"),
        F.when(~written & (F.col("outcome") != "conflict"), F.col("head_position")).alias("last_global_position"),
        (F.col("outcome") == "duplicate").alias("deduplicated"),
        F.col("current_version").alias("actual_version"),
    )


SETTLED = "outcome string, next_expected_version long, last_global_position long, deduplicated boolean, actual_version long"


def settle(requests: DataFrame, heads: DataFrame, log: DataFrame) -> DataFrame:
    """``classify`` for any number of batches per stream, in the order of their ids: each sees what those before it leave.

    One pass over sorted partitions; the state of a stream is its version and the event ids that it
    would gain. A duplicate of what only these requests write has no position yet.
    """
    batches = _batches(requests, log).join(heads.select("stream_id", "current_version", "head_position"), "stream_id", "left").fillna({"current_version": -1, "head_position": 0})

    def step(state, r):
        version, position, gained = state or (r["current_version"], r["head_position"], set())
        expected, ids, after = r["expected_version"], r["ids"], version
        if not r["size"]:
            outcome = "noop"
        elif r["repeats"] or not gained.isdisjoint(ids):
            outcome = "duplicate"
        elif {ANY: True, NO_STREAM: version == -1, EMPTY_STREAM: version == -1, STREAM_EXISTS: version >= 0}.get(expected, expected == version):
            outcome, after, position = "appended", version + r["size"], None
            gained.update(ids)
        else:
            outcome = "conflict"
        held = outcome != "conflict"
        out = {"outcome": outcome, "next_expected_version": after if held else None, "last_global_position": position if held else None, "deduplicated": outcome == "duplicate", "actual_version": version}
        return (after, position, gained), out

    return replay(batches, ["stream_id"], ["batch_id"], step, SETTLED).select("batch_id", "stream_id", "outcome", "next_expected_version", "last_global_position", "deduplicated", "actual_version")


def assign(requests: DataFrame, results: DataFrame, base: int) -> DataFrame:
    """The accepted requests with version and global position, positions following ``base`` without a global sort in one task.

    Rows are range-partitioned by (batch, seq), counted per partition, and numbered within their
    partition from its offset; the offsets are one number per partition.
    """
    accepted = requests.join(results.filter("outcome = 'appended'").select("batch_id", "stream_id", "actual_version"), ["batch_id", "stream_id"])
    in_batch = Window.partitionBy("batch_id", "stream_id").orderBy("seq")
    first_tenant = F.first("tenant_id").over(in_batch) if "tenant_id" in requests.columns else F.lit(None).cast("string")
    versioned = accepted.withColumn("version", (F.col("actual_version") + F.row_number().over(in_batch)).cast("long")).withColumn("tenant_id", first_tenant)
    return number(versioned, ["batch_id", "stream_id", "seq"], base).withColumnRenamed("number", "global_position").drop("actual_version", "expected_version", "batch_id", "seq")


def number(df: DataFrame, order: list[str], base: int) -> DataFrame:
    """``df`` with ``number``: base + 1, base + 2, ... in the order of ``order``.

    Dealt rows are written to the checkpoint folder before they are counted, so that a lost executor
    can't bring back other partitions than those that were. Where no folder is set, a local session
    needs none (it ends with its only executor) and a cluster is refused.
    """
    context = df.sparkSession.sparkContext
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    folder = context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    ranged = ranged.checkpoint() if folder else ranged.cache()
    counts = ranged.groupBy("__part").count().orderBy("__part").collect()  # one row per partition
    start, offsets = base, []
    for r in counts:
        offsets += [F.lit(r["__part"]), F.lit(start)]
        start += r["count"]
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    offset = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(base)
    return ranged.withColumn("number", (offset + within).cast("long")).drop("__part")


def deduplicated(log: DataFrame) -> DataFrame:
    """The first delivery of each (stream, event): partial aggregation instead of a sort."""
    rest = [c for c in log.columns if c not in ("stream_id", "event_id", "global_position")]
    first = F.min(F.struct("global_position", *rest)).alias("first")
    return log.groupBy("stream_id", "event_id").agg(first).select("stream_id", "event_id", "first.*")
