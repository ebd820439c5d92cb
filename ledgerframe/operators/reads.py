"""Bounded reads of one stream, of all streams and of the whole log.

Bounds are plain comparisons on the log's columns. They reach the Parquet scan where those are stored (as in
``EventLog``); logs derived from other tables take the bounds themselves and put them on the stored columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(df: DataFrame, column: str, forwards: bool) -> DataFrame:
    return df.orderBy(F.col(column) if forwards else F.col(column).desc())


def read_stream(log: DataFrame, stream_id: str, from_version: int = 0, to_version: int | None = None, forwards: bool = True) -> DataFrame:
    """Events of one stream with from_version <= version <= to_version, in version order; empty for an unknown stream."""
    found = log.filter((F.col("stream_id") == stream_id) & (F.col("version") >= from_version))
    return _ordered(found if to_version is None else found.filter(F.col("version") <= to_version), "version", forwards)


def as_of(log: DataFrame, version: int | None = None, position: int | None = None, time: Column | None = None) -> DataFrame:
    """All streams as they were at a version, a position or a time, each bound included."""
    for column, bound in (("version", version), ("global_position", position), ("created_at", time)):
        if bound is not None:
            log = log.filter(F.col(column) <= bound)
    return log


def read_all(log: DataFrame, after: int = 0, upto: int | None = None, max_count: int | None = None, forwards: bool = True) -> DataFrame:
    """Events with after < position <= upto; the limit counts from the end that is read first."""
    found = log.filter(F.col("global_position") > after)
    found = _ordered(found if upto is None else found.filter(F.col("global_position") <= upto), "global_position", forwards)
    return found if max_count is None else found.limit(max_count)


def catchup_batch(log: DataFrame, after: int, max_count: int, types: Iterable[str] | None = None, visible_before: Column | None = None) -> DataFrame:
    """The next ``max_count`` matching events after a position.

    No types means all, an empty set none. ``visible_before`` is the safe high-water mark: only
    events created strictly before it are read, later ones wait for a later call.
    """
    if max_count <= 0:
        raise ValueError("max_count must be more than zero")
    found = log.filter(F.col("global_position") > after)
    if types is not None:
        wanted = list(types)
        found = found.filter(F.col("event_type").isin(wanted) if wanted else F.lit(False))
    if visible_before is not None:
        found = found.filter(F.col("created_at") < visible_before)
    return found.orderBy("global_position").limit(max_count)


def heads(log: DataFrame) -> DataFrame:
    """stream_id, version, position and type of each stream's last event (partial aggregation, one shuffle).

    A whole log without versions has them by counting: versions start at 0 and have no holes.
    """
    last = F.max(F.struct("global_position", "event_type")).alias("last")
    version = F.max("version") if "version" in log.columns else F.count("*") - 1
    return log.groupBy("stream_id").agg(last, version.alias("current_version")).select(
        "stream_id", "current_version", F.col("last.global_position").alias("head_position"), F.col("last.event_type").alias("head_type")
    )


def heads_of(streams: DataFrame, log: DataFrame) -> DataFrame:
    """Heads of the wanted streams (stream_id); an unknown one is at version -1 and position 0."""
    found = heads(log.join(streams.select("stream_id").distinct(), "stream_id", "left_semi"))
    return streams.join(found, "stream_id", "left").fillna({"current_version": -1, "head_position": 0})


def safe_high_water_mark(log: DataFrame) -> DataFrame:
    """One row: the last position, 0 for an empty log (reads that one column)."""
    return log.agg(F.coalesce(F.max("global_position"), F.lit(0).cast("long")).alias("high_water_mark"))


def exists_above(log: DataFrame, position: int) -> DataFrame:
    """One row: whether any event lies above a position, whatever its type."""
    return log.filter(F.col("global_position") > position).select("global_position").limit(1).agg((F.count("*") > 0).alias("found"))


def streams(log: DataFrame) -> DataFrame:
    """The stream registry: id, category, tenant of the first event, current version."""
    first = F.min_by("tenant_id", "global_position")
    version = F.max("version") if "version" in log.columns else F.count("*") - 1
    return log.groupBy("stream_id").agg(F.min("category").alias("category"), first.alias("tenant_id"), version.alias("current_version"))


def category(log: DataFrame, name: str) -> DataFrame:
    return log.filter(F.col("category") == name)


def tenant(log: DataFrame, name: str | None) -> DataFrame:
    """Events of one tenant; None and the empty name are the same tenant."""
    return log.filter(F.coalesce("tenant_id", F.lit("")) == (name or ""))
