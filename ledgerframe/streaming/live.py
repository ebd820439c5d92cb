"""Structured Streaming over the log: tail reads, projections, and keyed state with expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    """The log as an unbounded table: every file that is in the folder or arrives in it."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def withheld(stream: DataFrame, lag: str, time: str = "created_at") -> DataFrame:
    """``stream`` with a watermark ``lag`` behind its event time (a zoned timestamp, as watermarks need)."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lag)


def first_deliveries(stream: DataFrame, lag: str, time: str = "created_at") -> DataFrame:
    """One delivery of each (stream, event) within the watermark."""
    return withheld(stream, lag, time).dropDuplicatesWithinWatermark(["stream_id", "event_id"])


def project(stream: DataFrame, types: list[str] | None, apply: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = True, poll: str = "200 milliseconds") -> StreamingQuery:
    """Run ``apply(batch, batch_id)`` per micro-batch on events of the given types, sorted by position.

    ``drain`` stops at the mark reached at the start, otherwise polls. A batch that is delivered
    again after a restart has its old id: ``apply`` must be idempotent by it.
    """
    wanted = stream if types is None else stream.filter(F.col("event_type").isin(types) if types else F.lit(False))

    def ordered(batch: DataFrame, n: int) -> None:
        apply(batch.orderBy("global_position") if "global_position" in batch.columns else batch, n)

    writer = wanted.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=poll)).start()


def project_many(stream: DataFrame, projections: dict[str, tuple[list[str] | None, Callable[[DataFrame, int], None]]], checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Several projections over one read of each batch: name -> (types, apply). Those that failed are named in the error."""

    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            failed = {}
            for name, (types, apply) in projections.items():
                try:
                    apply(batch if types is None else batch.filter(F.col("event_type").isin(types)), n)
                except Exception as e:
                    failed[name] = e
            if failed:  # the batch is not committed and comes again; those that succeeded are idempotent
                raise RuntimeError(f"projections failed: {', '.join(failed)}") from next(iter(failed.values()))
        finally:
            batch.unpersist()

    return project(stream, None, run, checkpoint, drain)


def counts_by_type(stream: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """A running count and sum of values per type into a table in memory."""
    counted = stream.groupBy("event_type").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registrations(stream: DataFrame, key: str, time: str, retention_seconds: int, forget: bool = False) -> DataFrame:
    """Idempotency as a stateful stream: key, at and outcome (new, active, expired) of every request.

    State is one expiry per key. No watermark is involved, so that a late request is judged and never
    dropped. With ``forget`` a key's state goes when nobody has asked for twice its retention of processing
    time: for queries that keep running, since one that drains would wait for that.
    """
    import pandas as pd

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else None
        for batch in batches:  # chunk by chunk: a key's requests are never gathered
            out = []
            for at in batch[time].sort_values():
                ms = int(at.timestamp() * 1000)
                if expires is None or expires <= ms:
                    out.append((k[0], at, "new" if expires is None else "expired"))
                    expires = ms + 1000 * retention_seconds
                else:
                    out.append((k[0], at, "active"))
            yield pd.DataFrame(out, columns=["key", "at", "outcome"])
        if expires is not None:
            state.update((expires,))
            if forget:
                state.setTimeoutDuration(2000 * retention_seconds)

    return stream.groupBy(F.col(key)).applyInPandasWithState(step, "key string, at timestamp, outcome string", "expires long", "append", "ProcessingTimeTimeout" if forget else "NoTimeout")


def limited(spark: SparkSession, folder: str, schema: StructType, options, pattern: str | None = None) -> tuple[DataFrame, str]:
    """A tail read that takes a bounded number of files a batch, and the poll interval, as ``ProjectionOptions`` say."""
    return tail(spark, folder, schema, pattern, max(1, options.pending_threshold // options.batch_size)), f"{int(options.poll_interval.total_seconds() * 1000)} milliseconds"
