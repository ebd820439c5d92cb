"""The transactional outbox, and the retention sweep of all side tables."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HousekeepingOptions, tenant_key

log = logging.getLogger("ledgerframe")


def from_events(events: DataFrame, message_id: Column, order: str = "global_position") -> DataFrame:
    """Outbox rows for events, in their order; id is the event's position, which keeps that order."""
    return events.select(
        F.col(order).alias("id"), message_id.alias("message_id"), "event_type", "payload", tenant_key(F.col("tenant_id")).alias("tenant_id"), "created_at", F.lit(None).cast("timestamp_ntz").alias("published_at")
    )


class Collector:
    """Messages collected while a command runs, in their order; draining hands them over and empties it."""

    def __init__(self) -> None:
        self._held: list[DataFrame | dict] = []

    def collect(self, message: DataFrame | dict) -> None:
        """One message (message_id, event_type, payload, and metadata and tenant_id if there), or a table of them with ``seq``."""
        needed = {"message_id", "event_type", "payload"}
        if missing := needed - set(message.columns if isinstance(message, DataFrame) else message):
            raise ValueError(f"a message lacks {sorted(missing)}")
        self._held.append(message)

    def drain(self, spark: SparkSession) -> DataFrame | None:
        """All messages with ``seq``, their order; None if there are none."""
        held, self._held, out = self._held, [], None
        for k, m in enumerate(held):
            df = m if isinstance(m, DataFrame) else spark.createDataFrame([tuple(m.get(c) for c in MESSAGE)], MESSAGE_DDL)
            seq = F.col("seq") if "seq" in df.columns else F.lit(0)
            df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in MESSAGE], F.struct(F.lit(k).alias("k"), seq.cast("long").alias("n")).alias("seq"))
            out = df if out is None else out.unionByName(df)
        return out


MESSAGE = ("message_id", "event_type", "payload", "metadata", "tenant_id")
MESSAGE_DDL = ", ".join(f"{c} string" for c in MESSAGE)


def normalised(messages: DataFrame, created_at: Column) -> DataFrame:
    """Messages as outbox rows without their id: no tenant is the empty one, nothing is published."""
    return messages.withColumns(
        {"tenant_id": tenant_key(F.col("tenant_id")), "created_at": created_at.cast("timestamp_ntz"), "published_at": F.lit(None).cast("timestamp_ntz")}
    )


def pending(outbox: DataFrame, batch_size: int) -> DataFrame:
    """The next unpublished rows by id."""
    return outbox.filter("published_at is null").orderBy("id").limit(batch_size)


def conflicts(outbox: DataFrame) -> DataFrame:
    """Message ids that more than one row carries: they are unique, so the batch that brings them fails."""
    return outbox.groupBy("message_id").agg(F.count("*").alias("rows")).filter("rows > 1")


def relay(outbox: DataFrame, batch_size: int, publish: Callable[[DataFrame], None], at: Column) -> DataFrame:
    """The outbox after one batch went out: published first, marked afterwards, so a crash between sends it again."""
    batch = pending(outbox, batch_size).persist()
    try:
        publish(batch)
        return mark_published(outbox, outbox.sparkSession.createDataFrame(batch.select("id").collect(), "id long"), at)
    finally:
        batch.unpersist()


def mark_published(outbox: DataFrame, published: DataFrame, at: Column) -> DataFrame:
    hit = published.select("id").distinct().withColumn("hit", F.lit(True))
    return outbox.join(hit, "id", "left").withColumn("published_at", F.when(F.col("hit") & F.col("published_at").isNull(), at).otherwise(F.col("published_at"))).drop("hit")


def expired_rows(kind: str, now: datetime | Column, options: HousekeepingOptions = HousekeepingOptions()) -> Column:
    """Which rows of a side table the sweep deletes; a retention of zero keeps them all."""
    now = F.lit(now) if isinstance(now, datetime) else now

    def older(column: str, retention) -> Column:
        return F.col(column) < now - F.lit(retention) if retention.total_seconds() > 0 else F.lit(False)

    if kind == "outbox":
        return F.coalesce(F.col("published_at").isNotNull() & older("published_at", options.outbox_retention), F.lit(False))
    if kind == "idempotency":
        return F.coalesce(F.col("expires_at") < now, F.lit(False))
    if kind == "reservations":
        return F.coalesce(~F.col("confirmed") & older("expires_at", options.reservation_retention), F.lit(False))
    if kind == "dead_letters":
        return F.coalesce(older("first_failed_at", options.dead_letter_retention), F.lit(False))
    raise ValueError(f"no such side table: {kind}")


KINDS = ("outbox", "idempotency", "reservations", "dead_letters")


def sweep(tables: dict[str, DataFrame], now, options: HousekeepingOptions = HousekeepingOptions()) -> tuple[dict[str, DataFrame], DataFrame]:
    """What survives of each table, and a report of how many rows went: one row per table (kind, purged)."""
    kept = {k: t.filter(~expired_rows(k, now, options)) for k, t in tables.items()}
    report = None
    for k, t in tables.items():
        gone = t.filter(expired_rows(k, now, options)).agg(F.count("*").alias("purged")).select(F.lit(k).alias("kind"), "purged")
        report = gone if report is None else report.unionByName(gone)
    return kept, report


class Housekeeper:
    """Sweeps at an interval while it holds the lease; a sweep that fails is logged and tried again at the next tick."""

    def __init__(self, leases, sweep: Callable[[], None], options: HousekeepingOptions = HousekeepingOptions(), sleep: Callable[[float], None] = time.sleep):
        self.leases, self.sweep, self.options, self.sleep = leases, sweep, options, sleep
        self.stopped = False

    def tick(self) -> bool:
        """One sweep; False if another housekeeper is at it or the sweep failed."""
        lease = self.leases.try_acquire("housekeeping")
        if lease is None:
            return False
        with lease:
            try:
                self.sweep()
                return True
            except Exception:
                log.exception("housekeeping failed")
                return False

    def run(self) -> None:
        """Ticks until ``stopped``; an interval of zero or less turns housekeeping off."""
        wait = self.options.interval.total_seconds()
        while wait > 0 and not self.stopped:
            self.tick()
            self.sleep(wait)
