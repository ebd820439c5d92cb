"""Left folds of streams into states, snapshots, and folds that start from a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(log: DataFrame, zero: Column, merge: Callable[[Column, Column], Column], columns: list[str], order: str = "version", key: str = "stream_id") -> DataFrame:
    """stream (``key``), version, state: every stream folded in version order, on the JVM.

    ``merge(state, event)`` must be total: an event type it does not know leaves the state as it
    is, and still advances the version. One stream's events are gathered in one row; streams longer
    than memory allows start from a snapshot (``fold_tail``) or use a commutative fold.
    """
    events = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return log.groupBy(key).agg(events.alias("events")).select(
        key, (F.size("events") - 1).cast("long").alias("version"), F.aggregate("events", zero, merge).alias("state")
    )


def counter_step(event_type: Column) -> Column:
    """+1 for a click, -1 for a view, 0 for anything else."""
    return F.when(event_type == "click", 1).when(event_type == "view", -1).otherwise(0).cast("long")


def counters(log: DataFrame) -> DataFrame:
    """stream_id, version, counter, ignored, last_type, last_position: a commutative fold, so one partial aggregation."""
    last = F.max(F.struct("global_position", "event_type"))
    version = F.max("version") if "version" in log.columns else F.count("*") - 1  # of a whole log: no holes
    return (
        log.groupBy("stream_id")
        .agg(
            F.sum(counter_step(F.col("event_type"))).alias("counter"),
            F.sum(F.when(~F.col("event_type").isin("click", "view"), 1).otherwise(0).cast("long")).alias("ignored"),
            last.alias("last"),
            version.alias("version"),
        )
        .select("stream_id", "version", "counter", "ignored", F.col("last.event_type").alias("last_type"), F.col("last.global_position").alias("last_position"))
    )


def running_counter(log: DataFrame) -> DataFrame:
    """The counter after every event."""
    w = Window.partitionBy("stream_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("counter", F.sum(counter_step(F.col("event_type"))).over(w))


ORDER_STATE = "struct<placed:boolean,cancelled:boolean,lines:bigint,quantity:double>"


def order_step(state: Column, event: Column) -> Column:
    """Placed once, lines only while open, cancelled at the end; unknown events change nothing."""
    kind = event["event_type"]
    open_ = state["placed"] & ~state["cancelled"]
    adds = (kind == "OrderLineAdded") & open_
    return F.struct(
        (state["placed"] | (kind == "OrderPlaced")).alias("placed"),
        (state["cancelled"] | ((kind == "OrderCancelled") & state["placed"])).alias("cancelled"),
        (state["lines"] + F.when(adds, 1).otherwise(0)).cast("bigint").alias("lines"),
        (state["quantity"] + F.when(adds, F.coalesce(event["quantity"], F.lit(0.0))).otherwise(F.lit(0.0))).alias("quantity"),
    )


def order_states(log: DataFrame) -> DataFrame:
    zero = F.struct(F.lit(False).alias("placed"), F.lit(False).alias("cancelled"), F.lit(0).cast("bigint").alias("lines"), F.lit(0.0).alias("quantity")).cast(ORDER_STATE)
    return fold(log, zero, order_step, ["event_type", "quantity"]).select("stream_id", "version", "state.*")


def order_sums(log: DataFrame, key: str = "stream_id") -> DataFrame:
    """What ``order_states`` gives where each stream is placed first and cancelled last, as one partial aggregation.

    Between those two ends an order's steps commute: lines are counted and their quantities summed, with
    no stream gathered in one row and nothing sorted.
    """
    kind = F.col("event_type")
    adds = kind == "OrderLineAdded"
    return log.groupBy(key).agg(
        (F.count("*") - 1).alias("version"),
        F.max(kind == "OrderPlaced").alias("placed"),
        F.max(kind == "OrderCancelled").alias("cancelled"),
        F.sum(adds.cast("bigint")).alias("lines"),
        F.sum(F.when(adds, F.coalesce("quantity", F.lit(0.0))).otherwise(F.lit(0.0))).alias("quantity"),
    )


# ---------------------------------------------------------------- snapshots


def captured(states: DataFrame) -> DataFrame:
    """Snapshots (stream_id, version, schema_version, state) of folded states (stream_id, version and state columns), as JSON."""
    rest = [c for c in states.columns if c not in ("stream_id", "version", "schema_version")]
    schema_version = F.col("schema_version") if "schema_version" in states.columns else F.lit(1)
    return states.select("stream_id", "version", schema_version.alias("schema_version"), F.to_json(F.struct(*rest)).alias("state"))


def restored(fresh: DataFrame, snapshots: DataFrame, ddl: str) -> DataFrame:
    """``fresh`` (stream_id, version) with version and state columns (``ddl``) of its snapshot; without one it stays as it is.

    Only a stream nothing was applied to (version -1) can be restored; another raises.
    """
    s = snapshots.select("stream_id", F.col("version").alias("at"), F.from_json("state", ddl).alias("state"))
    joined = fresh.join(s, "stream_id", "left")
    wrong = F.raise_error(F.concat(F.lit("restored over version "), F.col("version").cast("string"), F.lit(" of "), F.col("stream_id"))).cast("long")
    version = F.when(F.col("at").isNull(), F.col("version")).when(F.col("version") == -1, F.col("at")).otherwise(wrong)
    return joined.select("stream_id", version.alias("version"), "state.*")


def deleted_snapshots(snapshots: DataFrame, streams: DataFrame) -> DataFrame:
    """``snapshots`` without those of some streams (stream_id); deleting what is not there changes nothing."""
    return snapshots.join(streams.select("stream_id").distinct(), "stream_id", "left_anti")


def snapshots_every(log: DataFrame, n: int, schema_version: int = 1) -> DataFrame:
    """A snapshot (stream_id, version, schema_version, state) at every n-th event: the every-N policy."""
    return running_counter(log).filter((F.col("version") + 1) % n == 0).select("stream_id", "version", F.lit(schema_version).alias("schema_version"), F.col("counter").alias("state"))


def latest(snapshots: DataFrame) -> DataFrame:
    """One snapshot per stream, of the greatest version: what keeps the store forward only."""
    top = F.max_by(F.struct("version", "schema_version", "state"), "version").alias("s")
    return snapshots.groupBy("stream_id").agg(top).select("stream_id", "s.*")


def usable(snapshots: DataFrame, schema_version: int) -> DataFrame:
    """Snapshots of exactly this schema version; older and newer ones are left for a full fold."""
    return snapshots.filter(F.col("schema_version") == schema_version)


def save_snapshots(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """``stored`` after saving ``offered``: a stream's snapshot only ever gives way to one of a greater version."""
    both = stored.withColumn("new", F.lit(0)).unionByName(offered.withColumn("new", F.lit(1)))
    rest = [c for c in stored.columns if c != "stream_id"]
    top = F.max_by(F.struct(*rest), F.struct(F.col("version"), -F.col("new"))).alias("s")
    return both.groupBy("stream_id").agg(top).select("stream_id", "s.*")


def fold_tail(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """stream_id, version, counter, replayed: each counter from its snapshot and only the events after it.

    The join is on the key of the aggregation that follows, so both share one shuffle of the log.
    """
    s = snapshots.select("stream_id", F.col("version").alias("at"), F.col("state").alias("start"))
    joined = log.join(s, "stream_id", "left")
    after = F.col("version") > F.coalesce(F.col("at"), F.lit(-1))
    return joined.groupBy("stream_id").agg(
        F.max("version").alias("version"),
        (F.coalesce(F.max("start"), F.lit(0).cast("long")) + F.sum(F.when(after, counter_step(F.col("event_type"))).otherwise(0).cast("long"))).alias("counter"),
        F.sum(F.when(after, 1).otherwise(0).cast("long")).alias("replayed"),
    )
