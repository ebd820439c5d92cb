"""Ordered replay of requests per key: the state machines of idempotency, reservations and checkpoints.

Requests are dealt by key, sorted by time within each partition and run through once with one
small state per key, so that memory does not grow with a key's requests, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from ..schema import tenant_key

State = dict | None


def replay(requests: DataFrame, keys: list[str], order: list[str], step: Callable[[State, dict], tuple[State, dict]], out: str) -> DataFrame:
    """``requests`` with the columns of ``out`` that ``step(state, request) -> (state, columns)`` gives each."""
    names = requests.columns
    added = [c.strip().split(" ")[0] for c in out.split(",")]
    target = StructType([*requests.schema.fields, *_parse_datatype_string(out).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = [[] for _ in added]
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                row = dict(zip(names, values))
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, None
                state, columns = step(state, row)
                for held, c in zip(found, added):
                    held.append(columns[c])
            made = [pa.array(x, t) for x, t in zip(found, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *added])

    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(out).fields]
    return requests.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def register(retention: timedelta) -> Callable:
    """Idempotency: a key is new if unseen or expired (at its expiry it is), and then held for ``retention``."""

    def step(state: State, r: dict):
        now = r["at"]
        if state is None or state["expires_at"] <= now:
            return {"expires_at": now + retention}, {"outcome": "new" if state is None else "expired", "registered": True}
        return state, {"outcome": "active", "registered": False}

    return step


IDEMPOTENCY_OUT = "outcome string, registered boolean"


def results(retention: timedelta) -> Callable:
    """Idempotency with results: ordered register, save and get of one (tenant, key).

    register: true if the key is new or has expired, which clears its result. save: for a held key,
    expired or not; without one nothing happens. get: the result, null if there is none.
    """

    def step(state: State, r: dict):
        now, done = r["at"], False
        if r["op"] == "register":
            done = state is None or state["expires_at"] <= now
            if done:
                state = {"expires_at": now + retention, "result": None}
        elif r["op"] == "save" and state is not None:
            done, state = True, {**state, "result": r["value"]}
        return state, {"done": done, "result": state["result"] if state else None}

    return step


RESULTS_OUT = "done boolean, result string"


def reservation(state: State, r: dict):
    """Reserve, confirm and release of one (tenant, scope, value).

    Free, or held unconfirmed and expired: a reserve takes it over. Confirm and release work for the
    owner of an unconfirmed hold only, even an expired one; a confirmed one is permanent.
    """
    op, owner, now = r["op"], r["owner"], r["at"]
    done = False
    if op == "reserve":
        done = state is None or (not state["confirmed"] and state["expires_at"] <= now)
        if done:
            state = {"owner": owner, "expires_at": now + timedelta(seconds=r["ttl"]), "confirmed": False}
    elif state is not None and state["owner"] == owner and not state["confirmed"]:
        done = True
        state = {"owner": owner, "expires_at": datetime.max, "confirmed": True} if op == "confirm" else None
    held = state or {"owner": None, "confirmed": None}
    return state, {"done": done, "held_by": held["owner"], "confirmed": held["confirmed"]}


RESERVATION_OUT = "done boolean, held_by string, confirmed boolean"


def checkpoint_saves(saves: DataFrame, fencing: bool = True, width: int = 1_000_000) -> DataFrame:
    """Classifies checkpoint saves (projection, seq, owner, position, and tenant_id if there): applied, fenced or backward.

    A save applies if it moves forward, or stays where it is for the same owner or where nobody owns the
    checkpoint. The stored position is thus the running maximum, and its owner the first one named at it:
    windows suffice. They run inside ranges of ``width`` sequence numbers; what earlier ranges leave is one
    row per checkpoint and range, so that no task sorts the whole history of one projection.
    """
    keys = [c for c in ("projection", "tenant_id") if c in saves.columns]
    same_key = [tenant_key(F.col(c)) if c == "tenant_id" else F.col(c) for c in keys]
    state = F.struct("position", F.col("owner").isNotNull().alias("named"), (-F.col("seq")).alias("s"), "owner")
    s = saves.withColumns({"__range": F.floor(F.col("seq") / F.lit(width)), "__key": F.struct(*same_key)})
    leaves = s.groupBy("__key", "__range").agg(F.max(state).alias("left"))
    ranges = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = leaves.withColumn("__earlier", F.max("left").over(ranges)).drop("left")
    inside = Window.partitionBy("__key", "__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__held", F.max(state).over(inside)).join(earlier, ["__key", "__range"]).withColumn("held", F.greatest("__held", "__earlier"))
    stored, holder = F.col("held.position"), F.col("held.owner")
    same = holder.isNull() | F.coalesce(F.col("owner") == holder, F.lit(False)) if fencing else F.lit(True)
    outcome = F.when(stored.isNull() | (F.col("position") > stored) | ((F.col("position") == stored) & same), "applied").when(same, "backward").otherwise("fenced")
    applied = F.col("outcome") == "applied"
    takes = applied & (stored.isNull() | (F.col("position") > stored) | holder.isNull())
    return s.withColumn("outcome", outcome).select(
        *keys, "seq", "owner", "position", "outcome", F.when(applied, F.greatest("position", stored)).otherwise(stored).alias("stored_position"), F.when(takes, F.col("owner")).otherwise(holder).alias("stored_owner")
    )


def dropped(classified: DataFrame) -> DataFrame:
    """Who lost leadership: per checkpoint and owner the first fenced save, and how many saves came after it.

    A fenced owner halts and forgets the checkpoint it has loaded; its later saves are not attempted.
    """
    keys = [c for c in ("projection", "tenant_id") if c in classified.columns]
    first = classified.filter("outcome = 'fenced'").groupBy(*keys, "owner").agg(F.min("seq").alias("halted_at"))
    first = first.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "owner")], "halted_at")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "owner")]
    both = classified.join(first, on)
    return both.groupBy(*keys, "owner", "halted_at").agg(F.sum((F.col("seq") > F.col("halted_at")).cast("long")).alias("saves_dropped"))


def stored_checkpoints(classified: DataFrame) -> DataFrame:
    """The checkpoint each projection is left with."""
    keys = [c for c in ("projection", "tenant_id") if c in classified.columns]
    last = F.max_by(F.struct("stored_position", "stored_owner"), "seq").alias("s")
    return classified.groupBy(*[tenant_key(F.col(c)).alias(c) if c == "tenant_id" else F.col(c) for c in keys]).agg(last).select(*keys, F.col("s.stored_position").alias("position"), F.col("s.stored_owner").alias("owner"))


def load_checkpoints(projections: DataFrame, stored: DataFrame) -> DataFrame:
    """``projections`` with their position, 0 for those that never saved."""
    keys = [c for c in ("projection", "tenant_id") if c in projections.columns]
    return projections.join(stored.select(*keys, "position", "owner"), keys, "left").fillna({"position": 0})


def save_results(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Idempotency entries (tenant_id, idempotency_key, result, expires_at) with saved results; a result for a missing key is dropped."""
    r = results.select("tenant_id", "idempotency_key", F.col("result").alias("saved"))
    joined = entries.join(r, ["tenant_id", "idempotency_key"], "left")
    return joined.select("tenant_id", "idempotency_key", F.coalesce("saved", "result").alias("result"), "expires_at")


def saved_result(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored result of each wanted (tenant_id, idempotency_key), null if the key is unknown or has none yet."""
    held = entries.select("tenant_id", "idempotency_key", "result")
    return wanted.withColumn("tenant_id", tenant_key(F.col("tenant_id"))).join(held, ["tenant_id", "idempotency_key"], "left")
