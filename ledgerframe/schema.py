"""Schemas of the log and its side tables, expected-version constants, and validators."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What an append expects of its stream; 1 and more is an exact last version.
ANY, NO_STREAM, EMPTY_STREAM, STREAM_EXISTS = -2, -1, 0, -3

# Table schemas, as DDL: of metadata as it is coded, and of the stored log and outbox.
METADATA = "message_id string, correlation_id string, causation_id string, user string, tenant_id string, trace_parent string, extensions map<string,string>"
EVENT_LOG = (
    "global_position long, stream_id string, category string, version long, event_id string, event_type string, "
    "schema_version int, payload string, tenant_id string, metadata string, created_at timestamp_ntz"
)
OUTBOX = "id long, message_id string, event_type string, payload string, metadata string, tenant_id string, created_at timestamp_ntz, published_at timestamp_ntz"

MAX_USER = 128
MAX_ERROR = 4096


def valid_user(user: Column) -> Column:
    """A user reference is not null, holds no @ and has at most 128 characters."""
    return user.isNotNull() & ~user.contains("@") & (F.length(user) <= MAX_USER)


def require_user(user: str) -> str:
    if user is None or "@" in user or len(user) > MAX_USER:
        raise ValueError("not a valid user reference")  # the value itself may be personal data
    return user


def require_schema_name(name: str) -> str:
    if not re.fullmatch(r"[a-z_][a-z0-9_]{0,62}", name or ""):
        raise ValueError(f"not a valid schema name: {name!r}")
    return name


def tenant_key(tenant: Column) -> Column:
    """Side tables file a missing tenant under the empty one."""
    return F.coalesce(tenant, F.lit(""))


def category_of(stream_id: Column) -> Column:
    """What precedes the first hyphen, or the whole id."""
    return F.substring_index(stream_id, "-", 1)


@dataclass(frozen=True)
class ProjectionOptions:
    batch_size: int = 500
    pending_threshold: int = 5000
    gap_timeout: timedelta = timedelta(seconds=10)
    poll_interval: timedelta = timedelta(milliseconds=200)
    visibility_lag: timedelta = timedelta(seconds=5)
    max_retries: int = 3
    dead_letter_capacity: int = 1024


@dataclass(frozen=True)
class HousekeepingOptions:
    interval: timedelta = timedelta(minutes=5)
    outbox_retention: timedelta = timedelta(days=7)
    dead_letter_retention: timedelta = timedelta(days=30)
    reservation_retention: timedelta = timedelta(hours=1)


def validated(options):
    """The options, or one error that lists all that is wrong with them."""
    zero_allowed = {"max_retries", "visibility_lag"} | ({f.name for f in fields(options)} if isinstance(options, HousekeepingOptions) else set())
    wrong = []
    for f in fields(options):
        value = getattr(options, f.name)
        nothing = timedelta(0) if isinstance(value, timedelta) else 0
        if value < nothing or (value == nothing and f.name not in zero_allowed):
            wrong.append(f"{f.name} must be {'zero or more' if f.name in zero_allowed else 'more than zero'}, not {value}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return options


def migrations_to_run(steps: dict[int, str], done: Iterable[int]) -> list[tuple[int, str]]:
    """The steps (version -> name) that a store still lacks, in the order of their versions.

    Versions start at 1; a store that has steps unknown here was made by a later release and is refused.
    """
    done = set(done)
    if any(v < 1 for v in steps):
        raise ValueError("versions start at 1")
    if unknown := sorted(done - set(steps)):
        raise ValueError(f"the store has unknown migrations: {unknown}")
    return [(v, steps[v]) for v in sorted(steps) if v not in done]


def pending_migrations(steps: DataFrame, done: DataFrame) -> DataFrame:
    """``migrations_to_run`` for many stores at once: steps (store, version, name), done (store, version), with ``place`` in order."""
    rest = steps.join(done.select("store", "version").distinct(), ["store", "version"], "left_anti")
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("store").orderBy("version")))
