"""Schema evolution: upcasters keyed by (event type, version), applied until none is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UpcasterCycle(ValueError):
    """An upcaster chain that would come back to where it has been."""


@dataclass(frozen=True)
class Upcaster:
    """(type, version) -> the (type, version, payload) that ``targets`` make of the payload; none drops the event."""

    event_type: str
    version: int
    targets: tuple[tuple[str, int, Callable[[Column], Column]], ...]


class Upcasters:
    """A checked set of upcasters; the graph is examined on the driver before any job runs."""

    def __init__(self, upcasters: list[Upcaster]):
        self.by_key: dict[tuple[str, int], Upcaster] = {}
        for u in upcasters:
            key = (u.event_type, u.version)
            if key in self.by_key:
                raise ValueError(f"two upcasters for {key}")
            self.by_key[key] = u
        self._known: dict[tuple[str, int], tuple[int, int]] = {}
        self.depth = max((self._walk(k, ())[0] for k in self.by_key), default=0)
        most = (len(self.by_key) + 1) * 64
        for key in self.by_key:
            if self._walk(key, ())[1] > most:
                raise UpcasterCycle(f"{key[0]}:{key[1]} takes more than {most} steps")

    def _walk(self, key: tuple[str, int], path: tuple) -> tuple[int, int]:
        """Steps of the longest chain from ``key``, and events touched by walking all of its outputs; each key is walked once."""
        if key in path:
            raise UpcasterCycle(" -> ".join(f"{t}:{v}" for t, v in (*path, key)))
        if key not in self.by_key:
            return 0, 1
        if key not in self._known:
            below = [self._walk((t, v), (*path, key)) for t, v, _ in self.by_key[key].targets]
            self._known[key] = (1 + max((d for d, _ in below), default=0), 1 + sum(w for _, w in below))
        return self._known[key]

    def apply(self, log: DataFrame) -> DataFrame:
        """``log`` with event_type, schema_version and payload brought up to date, and ``ordinal``.

        One event may become several or none; ``ordinal`` numbers what it became, in order. Events
        without an upcaster pass through as they are.
        """
        item = "array<struct<t:string,v:int,p:string>>"
        current = F.array(F.struct(F.col("event_type").alias("t"), F.col("schema_version").cast("int").alias("v"), F.col("payload").alias("p"))).cast(item)
        for _ in range(self.depth):
            current = F.flatten(F.transform(current, self._step)).cast(item)
        known = [F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in self.by_key]
        if not known:
            return log.withColumn("ordinal", F.lit(0))
        concerned = F.struct(F.col("event_type").alias("t"), F.col("schema_version").cast("int").alias("v")).isin(known)
        rest = [c for c in log.columns if c not in ("event_type", "schema_version", "payload")]
        same = F.array(F.struct(F.col("event_type").alias("t"), F.col("schema_version").cast("int").alias("v"), F.col("payload").alias("p"))).cast(item)
        out = log.select(*rest, F.posexplode(F.when(concerned, current).otherwise(same)).alias("ordinal", "e"))
        return out.select(*rest, "ordinal", F.col("e.t").alias("event_type"), F.col("e.v").alias("schema_version"), F.col("e.p").alias("payload"))

    def _step(self, e: Column) -> Column:
        item = "array<struct<t:string,v:int,p:string>>"
        out = None
        for (t, v), u in self.by_key.items():
            made = [F.struct(F.lit(a).alias("t"), F.lit(b).alias("v"), f(e["p"]).alias("p")) for a, b, f in u.targets]
            value = F.array(*made).cast(item)
            hit = (e["t"] == t) & (e["v"] == v)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.array(e).cast(item))
