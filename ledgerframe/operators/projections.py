"""Projections over the log: dispatch, watermarks, batches, retries, dead letters, gaps and lag."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ErrorPolicy:
    skip: bool = True  # False: pause before the poisoned event
    max_retries: int = 3


@dataclass(frozen=True)
class Projection:
    name: str
    types: frozenset[str]
    policy: ErrorPolicy = field(default_factory=ErrorPolicy)


class Projections:
    """Registered projections; registering a name again changes nothing."""

    def __init__(self) -> None:
        self.by_name: dict[str, Projection] = {}

    def register(self, name: str, types: Iterable[str], policy: ErrorPolicy | None = None, hierarchy: dict[str, Iterable[str]] | None = None) -> Projection:
        if name not in self.by_name:
            self.by_name[name] = Projection(name, frozenset(expand(types, hierarchy or {})), policy or ErrorPolicy())
        return self.by_name[name]


def expand(types: Iterable[str], hierarchy: dict[str, Iterable[str]]) -> set[str]:
    """Event types that a subscription reaches: those named and all below them."""
    found, todo = set(), list(types)
    while todo:
        t = todo.pop()
        if t not in found:
            found.add(t)
            todo += hierarchy.get(t, ())
    return found


def dispatch(log: DataFrame, projections: Iterable[Projection]) -> DataFrame:
    """The events each projection applies, one row per (projection, event), filtered before any decoding."""
    projections = list(projections)
    wanted = sorted({t for p in projections for t in p.types})
    names = F.array_compact(F.array(*[F.when(F.col("event_type").isin(sorted(p.types)), F.lit(p.name)) for p in projections]))
    return log.filter(F.col("event_type").isin(wanted)).withColumn("projection", F.explode(names))


def above_watermark(events: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Events (projection, global_position) not yet applied, a position delivered again counting once."""
    w = watermarks.select("projection", F.col("position").alias("watermark"))
    fresh = events.join(w, "projection", "left").filter(F.col("global_position") > F.coalesce("watermark", F.lit(0))).drop("watermark")
    return fresh.dropDuplicates(["projection", "global_position"])


def drain_schedule(events: DataFrame, batch_size: int, width: int = 1_000_000) -> DataFrame:
    """projection, batch, events, first_position, checkpoint: the batches that draining to the mark takes.

    Events are numbered inside ranges of ``width`` positions, from the count of the ranges before (one row
    per projection and range): no task sorts the whole history of one projection.
    """
    e = events.select("projection", "global_position", F.floor(F.col("global_position") / F.lit(width)).alias("range"))
    ranges = Window.partitionBy("projection").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = e.groupBy("projection", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ranges), F.lit(0))).drop("n")
    inside = Window.partitionBy("projection", "range").orderBy("global_position")
    numbered = e.withColumn("nth", F.row_number().over(inside) - 1).join(before, ["projection", "range"])
    batch = F.floor((F.col("before") + F.col("nth")) / F.lit(batch_size)).cast("long")
    return numbered.withColumn("batch", batch).groupBy("projection", "batch").agg(
        F.count("*").alias("events"), F.min("global_position").alias("first_position"), F.max("global_position").alias("checkpoint")
    )


def catch_up(schedule: DataFrame, high_water_mark: Column, batch_size: int, threshold: int) -> DataFrame:
    """Whether each batch leaves a projection catching up: a full batch, and more positions pending than the threshold."""
    pending = high_water_mark - F.col("checkpoint")
    return schedule.withColumn("pending", pending).withColumn("catch_up", (F.col("events") == batch_size) & (pending > threshold))


def lag(events: DataFrame, projections: DataFrame, high_water_mark: DataFrame) -> DataFrame:
    """projection, checkpoint, high_water_mark, lag: the checkpoint is the last matching event's position.

    A selective projection thus keeps a lag when the tail of the log does not concern it.
    ``high_water_mark`` is one row.
    """
    done = events.groupBy("projection").agg(F.max("global_position").alias("checkpoint"))
    joined = projections.join(done, "projection", "left").join(F.broadcast(high_water_mark))
    return joined.select("projection", F.coalesce("checkpoint", F.lit(0).cast("long")).alias("checkpoint"), "high_water_mark", (F.col("high_water_mark") - F.coalesce("checkpoint", F.lit(0))).alias("lag"))


def dead_letters(events: DataFrame, poisoned: Column, policy: ErrorPolicy, error: Column) -> DataFrame:
    """projection, global_position, attempts, error of the events that fail, under the policy.

    A deterministic failure fails at every retry. When pausing, only the first one is reached.
    """
    bad = events.filter(poisoned)
    if not policy.skip:
        first = bad.groupBy("projection").agg(F.min("global_position").alias("global_position"))
        bad = bad.join(first, ["projection", "global_position"], "left_semi")
    return bad.select("projection", "global_position", F.lit(1 + policy.max_retries).alias("attempts"), F.left(error, F.lit(4096)).alias("error"))


def applied(events: DataFrame, poisoned: Column, policy: ErrorPolicy) -> DataFrame:
    """projection, applied, checkpoint: skipping moves past poison, pausing stops right before it."""
    e = events.select("projection", "global_position", F.coalesce(poisoned, F.lit(False)).alias("bad"))
    if not policy.skip:  # a pause is one position per projection, found by a partial aggregation
        stops = e.filter("bad").groupBy("projection").agg(F.min("global_position").alias("stop"))
        e = e.join(stops, "projection", "left").filter(F.col("stop").isNull() | (F.col("global_position") < F.col("stop")))
    return e.groupBy("projection").agg(F.sum(F.when(F.col("bad"), 0).otherwise(1)).cast("long").alias("applied"), F.max("global_position").alias("checkpoint"))


def newest(letters: DataFrame, capacity: int = 1024) -> DataFrame:
    """The ring of the newest dead letters."""
    return letters.orderBy(F.col("global_position").desc(), "projection").limit(capacity)


def gaps(log: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Missing positions as intervals (after, upto], over positions 1 to the last.

    Positions are dealt into ranges of ``width``; neighbours are compared inside a range, and the
    ends of ranges against the range before (one row each, a million positions a row: the one window
    without a partition), so that no task holds the whole log.
    """
    p = log.select("global_position").withColumn("range", F.floor(F.col("global_position") / F.lit(width)))
    inside = Window.partitionBy("range").orderBy("global_position")
    within = p.withColumn("after", F.lag("global_position").over(inside)).filter("after is not null")
    ends = p.groupBy("range").agg(F.min("global_position").alias("global_position"), F.max("global_position").alias("last"))
    across = ends.withColumn("after", F.coalesce(F.lag("last").over(Window.orderBy("range")), F.lit(0).cast("long")))
    both = within.select("after", "global_position").unionByName(across.select("after", "global_position"))
    return both.filter("global_position - after > 1").select("after", (F.col("global_position") - 1).alias("upto"), (F.col("global_position") - F.col("after") - 1).alias("missing"))


def gap_verdict(checkpoint: Column, mark: Column, exists_above: Column, waited: Column, timeout: Column) -> Column:
    """no_gap, wait or skip for an empty batch below the mark; what is above the checkpoint is a tail, not a hole."""
    return F.when(checkpoint >= mark, "no_gap").when(exists_above, "no_gap").when(F.coalesce(waited, F.lit(0)) >= timeout, "skip").otherwise("wait")


def skip_gaps(ticks: DataFrame, timeout: Column) -> DataFrame:
    """What each tick over an empty batch does: verdict, the checkpoint after it, and the interval (gap_from, gap_upto] it gave up.

    ``ticks``: checkpoint, mark, above, waited. Only a permanent gap moves the checkpoint, to the mark.
    """
    t = ticks.withColumn("verdict", gap_verdict(F.col("checkpoint"), F.col("mark"), F.col("above"), F.col("waited"), timeout))
    skips = F.col("verdict") == "skip"
    return t.withColumns({"gap_from": F.when(skips, F.col("checkpoint")), "gap_upto": F.when(skips, F.col("mark")), "checkpoint": F.when(skips, F.col("mark")).otherwise(F.col("checkpoint"))})
