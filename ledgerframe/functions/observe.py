"""Counters that ride along with a job: no extra pass over the data, and no payload in any of them."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("ledgerframe")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds ``events`` and ``streams_seen`` (approximate) once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("events"), F.approx_count_distinct("stream_id").alias("streams_seen")), seen


def described(spark, operation: str, stream_id: str | None = None) -> None:
    """Names the jobs that follow in the UI and the event log."""
    spark.sparkContext.setJobDescription(operation if stream_id is None else f"{operation} stream={stream_id}")
    log.debug("%s", operation)


def appended(results: DataFrame) -> DataFrame:
    """Batches by outcome: appended, duplicate, conflict, noop."""
    return results.groupBy("outcome").agg(F.count("*").alias("batches"))
