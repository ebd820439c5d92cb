"""Deterministic event ids and the three-id rule of message metadata."""

from __future__ import annotations

import contextvars
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..schema import METADATA, valid_user

#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def _fnv(texts: list[bytes], basis: int) -> np.ndarray:
    """FNV-1a of many texts at once, a byte position per step."""
    longest = max(map(len, texts), default=0)
    grid = np.zeros((len(texts), longest), np.uint64)
    size = np.array([len(t) for t in texts])
    for k, t in enumerate(texts):
        grid[k, : len(t)] = np.frombuffer(t, np.uint8)
    h = np.full(len(texts), basis, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(longest):
            h = np.where(size > k, (h ^ grid[:, k]) * np.uint64(FNV_PRIME), h)
    return h


@pandas_udf(StringType())
def deterministic_event_id(message_id: pd.Series, stream_id: pd.Series, index: pd.Series) -> pd.Series:
    """A uuid from "{message id in hex}:{stream}:{index}": equal input, equal id, so that a retry is recognised."""
    texts = [f"{m.replace('-', '')}:{s}:{i}".encode() for m, s, i in zip(message_id, stream_id, index)]
    low, high = _fnv(texts, FNV_OFFSET), _fnv(texts, FNV_PRIME)
    return pd.Series([str(uuid.UUID(bytes_le=int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little"))) for a, b in zip(low, high)])


def stamped(message_id: Column, correlation: Column | None = None, causation: Column | None = None) -> Column:
    """Message, correlation and causation id; without a context a message correlates with and causes itself."""
    return F.struct(
        message_id.alias("message_id"),
        (message_id if correlation is None else F.coalesce(correlation, message_id)).alias("correlation_id"),
        (message_id if causation is None else F.coalesce(causation, message_id)).alias("causation_id"),
    )


def metadata_json(metadata: Column) -> Column:
    """Metadata as JSON, null fields left out; the user is a plain string."""
    return F.to_json(metadata)


def metadata_of(text: Column) -> Column:
    """Metadata from JSON. Malformed text, JSON null and a user that is not a valid reference raise."""
    m = F.from_json(text, METADATA, {"mode": "FAILFAST"})
    user = F.try_parse_json(text)
    plain = F.schema_of_variant(F.try_variant_get(user, "$.user", "variant"))
    wrong = text.isNull() | m.isNull() | (m["user"].isNotNull() & (~valid_user(m["user"]) | (plain != "STRING")))
    return F.when(wrong, F.raise_error(F.lit("not valid metadata")).cast(f"struct<{METADATA.replace(' string', ':string').replace(' map', ':map')}>")).otherwise(m)


def valid_json(text: Column) -> Column:
    """Whether a payload is JSON as the store takes it; null is not."""
    return F.try_parse_json(text).isNotNull()


@dataclass(frozen=True)
class Correlation:
    correlation_id: str
    causation_id: str
    user: str | None = None
    tenant_id: str | None = None


_CURRENT: contextvars.ContextVar[Correlation | None] = contextvars.ContextVar("correlation", default=None)


def current() -> Correlation | None:
    return _CURRENT.get()


@contextmanager
def correlated(context: Correlation) -> Iterator[Correlation]:
    """The context in force inside the block; what was in force before returns after it."""
    token = _CURRENT.set(context)
    try:
        yield context
    finally:
        _CURRENT.reset(token)
