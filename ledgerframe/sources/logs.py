"""Event logs read from the business tables: users, orders and conversations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def user_log(spark: SparkSession, folder: str, versions: bool = True, after: int | None = None, upto: int | None = None, user: int | None = None, types: Iterable[str] | None = None) -> DataFrame:
    """One stream per user; the event id gives the position, so that no global sort is needed.

    Without ``versions`` the log needs no shuffle at all, for reads that go by position. The bounds
    (after < position <= upto, one user, some types) are put on the stored columns and reach the scan;
    versions count a user's events from the first, so that only the bound on the user goes with them.
    """
    if versions and not (after is None and upto is None and types is None):
        raise ValueError("versions need all events of a stream")
    e = table(spark, folder, "events")
    if after is not None:
        e = e.filter(F.col("event_id") > after - 1)
    if upto is not None:
        e = e.filter(F.col("event_id") <= upto - 1)
    if user is not None:
        e = e.filter(F.col("user_id") == user)
    if types is not None:
        e = e.filter(F.col("event_type").isin(list(types)))
    log = e.select(
        (F.col("event_id") + 1).alias("global_position"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"),
        F.lit("user").alias("category"),
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        F.lit(1).alias("schema_version"),
        F.col("props").alias("payload"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.col("ts").alias("created_at"),
        "user_id",
        "value",
    )
    return with_versions(log) if versions else log


def with_versions(log: DataFrame) -> DataFrame:
    """Versions from 0 without holes, in the order of positions within each stream."""
    w = Window.partitionBy("stream_id").orderBy("global_position")
    return log.withColumn("version", (F.row_number().over(w) - 1).cast("long"))


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """One stream per order: placed, its lines, cancelled when pending; ``o_orderkey`` is its key, ``step`` and ``line`` order it."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    nothing = F.lit(None).cast("double")
    line = F.to_json(F.struct(*sorted(lines.columns)))
    placed = orders.select("o_orderkey", F.lit(0).alias("step"), F.lit("").alias("line"), F.lit("OrderPlaced").alias("event_type"), nothing.alias("quantity"))
    added = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("step"), line.alias("line"), F.lit("OrderLineAdded").alias("event_type"), F.col("l_quantity").alias("quantity"))
    cancelled = orders.filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(2).alias("step"), F.lit("").alias("line"), F.lit("OrderCancelled").alias("event_type"), nothing.alias("quantity"))
    return placed.unionByName(added).unionByName(cancelled)


def with_places(log: DataFrame) -> DataFrame:
    """An order log with stream ids, and versions in the order of its steps and lines."""
    w = Window.partitionBy("o_orderkey").orderBy("step", "line")
    return log.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("version"), "event_type", "quantity")


def conversation_log(spark: SparkSession, folder: str) -> DataFrame:
    """One stream per conversation, a turn per version."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("stream_id"), F.lit("conv").alias("category"), F.col("turn").alias("version"), F.col("role").alias("event_type"), F.col("text").alias("payload")
    )


def with_gaps(log: DataFrame, every: int = 97) -> DataFrame:
    """The log without the positions that leave 1 when divided by ``every``: holes as rolled-back writes leave them."""
    return log.filter((F.col("global_position") - 1) % every != 0)


def redelivered(log: DataFrame, every: int = 5) -> DataFrame:
    """The log and a second delivery of each ``every``-th event, at later positions, as a retry writes them."""
    again = log.filter(F.col("global_position") % every == 0).withColumn("global_position", F.col("global_position") + F.lit(1_000_000_000))
    return log.unionByName(again)
