"""Aggregates over the log: load, fetch for writing, decide, save, for one stream or for many at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import reads


def save_requests(decided: DataFrame, message_id: Column) -> DataFrame:
    """Append requests for decided events (stream_id, read_version, seq, event_type, payload): one batch per stream.

    Event ids follow from the message, the stream and the event's place, so that saving again after a
    lost answer repeats them and is recognised. A stream read at version -1 is expected not to exist.
    """
    return decided.select(
        F.concat(F.lit("save/"), "stream_id").alias("batch_id"),
        "stream_id",
        F.col("read_version").alias("expected_version"),
        F.col("seq").cast("int").alias("seq"),
        ids.deterministic_event_id(message_id, F.col("stream_id"), F.col("seq").cast("int")).alias("event_id"),
        "event_type",
        F.lit(1).alias("schema_version"),
        "payload",
        F.lit(None).cast("string").alias("tenant_id"),
    )


class Aggregate:
    """One stream's state and the events raised on it; unknown events leave the state and advance the version."""

    def __init__(self, stream_id: str, zero: Any, step: Callable[[Any, str, str], Any]):
        if not stream_id:
            raise ValueError("an aggregate needs an id")
        self.stream_id, self.state, self._step = stream_id, zero, step
        self.version, self.uncommitted = -1, []

    def apply(self, event_type: str, payload: str) -> None:
        self.state = self._step(self.state, event_type, payload)
        self.version += 1

    def raise_event(self, event_type: str, payload: str) -> None:
        if event_type is None or payload is None:
            raise ValueError("no event to raise")
        self.apply(event_type, payload)
        self.uncommitted.append((event_type, payload))

    def restore(self, state: Any, version: int) -> None:
        if self.version != -1:
            raise RuntimeError(f"{self.stream_id} is at version {self.version}; only a fresh aggregate is restored")
        self.state, self.version = state, version


class Repository:
    """Aggregates of an ``EventLog``; ``snapshots`` (stream_id -> (version, schema_version, state)) shorten loads."""

    def __init__(self, log, zero: Callable[[], Any], step: Callable[[Any, str, str], Any], schema_version: int = 1, snapshots: dict | None = None):
        self.log, self.zero, self.step, self.schema_version, self.snapshots = log, zero, step, schema_version, snapshots or {}

    def fetch_for_writing(self, stream_id: str) -> tuple[Aggregate, int]:
        """The aggregate, new if its stream is empty, and the version to expect when it is saved."""
        found = Aggregate(stream_id, self.zero(), self.step)
        version, schema_version, state = self.snapshots.get(stream_id, (-1, None, None))
        if version >= 0 and schema_version == self.schema_version:
            found.restore(state, version)
        wanted = self.log.spark.createDataFrame([(stream_id,)], "stream_id string")
        tail = reads.read_stream(self.log.streams(wanted), stream_id, found.version + 1)
        for event in tail.select("event_type", "payload").toLocalIterator():  # one stream, in order, partition by partition
            found.apply(event["event_type"], event["payload"])
        return found, found.version

    def load(self, stream_id: str) -> Aggregate | None:
        """The aggregate, or None if its stream is empty and no snapshot was restored."""
        found, version = self.fetch_for_writing(stream_id)
        return None if version == -1 else found

    def save(self, aggregate: Aggregate, expected_version: int, message_id: str, created_at: Column) -> dict:
        """Append what was raised; the queue is empty afterwards even if the batch was a duplicate. A conflict raises."""
        from ..sources.event_log import CommitConflict

        spark = self.log.spark
        raised: Sequence = aggregate.uncommitted
        rows = [(aggregate.stream_id, expected_version, k, t, p) for k, (t, p) in enumerate(raised)] or [(aggregate.stream_id, expected_version, 0, None, None)]
        decided = spark.createDataFrame(rows, "stream_id string, read_version long, seq int, event_type string, payload string")
        requests = save_requests(decided, F.lit(message_id)).withColumn("event_id", F.when(F.col("event_type").isNotNull(), F.col("event_id")))
        result = self.log.append(requests, created_at).first().asDict()
        if result["outcome"] == "conflict":
            raise CommitConflict(f"{aggregate.stream_id} is at version {result['actual_version']}, not as expected")
        aggregate.uncommitted = []
        return result
