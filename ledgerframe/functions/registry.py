"""Event types by name: versions and payload schemas, and decoding of payloads with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnknownEventType(KeyError):
    pass


class EventTypes:
    """One schema per name and one name per schema owner; names compare exactly, versions start at 1."""

    def __init__(self) -> None:
        self.by_name: dict[str, tuple[int, str]] = {}
        self.by_owner: dict[object, str] = {}

    def register(self, name: str, ddl: str, version: int = 1, owner: object | None = None) -> None:
        if not name:
            raise ValueError("an event type needs a name")
        if version < 1:
            raise ValueError("versions start at 1")
        if self.by_name.get(name, (version, ddl)) != (version, ddl):
            raise ValueError(f"{name} is registered otherwise")
        if owner is not None and self.by_owner.setdefault(owner, name) != name:
            raise ValueError(f"{owner} is registered as {self.by_owner[owner]}")
        self.by_name[name] = (version, ddl)

    def version(self, name: str) -> int:
        if name not in self.by_name:
            raise UnknownEventType(name)
        return self.by_name[name][0]

    def decoded(self, log: DataFrame, name: str) -> DataFrame:
        """Events of one type with ``data``, filtered before their payload is parsed."""
        if name not in self.by_name:
            raise UnknownEventType(name)
        return log.filter(F.col("event_type") == name).withColumn("data", F.from_json("payload", self.by_name[name][1]))

    def require_known(self, log: DataFrame) -> DataFrame:
        """``log``, raising when an event of unknown type is read: what folds do (projections skip it)."""
        known = F.col("event_type").isin(sorted(self.by_name))
        return log.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce("event_type", F.lit("null"))))))


def encoded(data: Column) -> Column:
    return F.to_json(data)
