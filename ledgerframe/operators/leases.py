"""Leadership leases: one holder per (projection, tenant), ending with their holder.

A lease is a row of numbered files, each made exclusively; the last one tells who holds it and until
when. Taking, renewing and giving back are all the making of the next file, so that of two takers one
wins, and a holder that dies is succeeded once its time is up.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import SparkSession

from ..sources.files import Folder


class Lease:
    """A held lease; releasing it again does nothing, and a lease taken over meanwhile stays with its taker."""

    def __init__(self, leases: Leases, name: str, token: str):
        self._leases, self.name, self.token = leases, name, token

    def is_held(self) -> bool:
        return self._leases.holder(self.name) == self.token

    def renew(self) -> bool:
        """Extend the lease; False if it is lost."""
        return self._leases._follow(self.name, self.token, self.token)

    def release(self) -> None:
        self._leases._follow(self.name, self.token, None)

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Leases:
    def __init__(self, spark: SparkSession, folder: str, ttl: timedelta = timedelta(seconds=30), clock: Callable[[], float] = time.time):
        self.files, self.ttl, self.clock = Folder(spark, folder), ttl.total_seconds(), clock
        self.files.make()

    def _last(self, name: str) -> tuple[int, dict]:
        names = [n for n in self.files.names(name) if not n.startswith(".")]
        return (int(names[-1].split(".")[0]), self.files.load(f"{name}/{names[-1]}")) if names else (0, {"token": None, "until": 0.0})

    def _follow(self, name: str, holder: str | None, token: str | None) -> bool:
        """Make the next file if ``holder`` still holds the lease (None: if nobody does)."""
        n, last = self._last(name)
        current = last["token"] if last["until"] > self.clock() else None
        if current != holder or (holder is None and token is None):
            return False
        made = self.files.create(f"{name}/{n + 1:012d}.json", {"token": token, "until": self.clock() + self.ttl})
        if made and n > 1:
            self.files.delete(f"{name}/{n - 1:012d}.json")
        return made

    def holder(self, name: str) -> str | None:
        _, last = self._last(name)
        return last["token"] if last["until"] > self.clock() else None

    def try_acquire(self, projection: str, tenant: str | None = None) -> Lease | None:
        """A lease, or None if another holds it; no tenant and the empty tenant are the same."""
        name = "--".join(re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"%{ord(m[0]):x}", x) for x in (projection, tenant or ""))
        self.files.make(name)
        token = uuid.uuid4().hex
        return Lease(self, name, token) if self._follow(name, None, token) else None


def lease_step(ttl: timedelta) -> Callable:
    """The lease of one (projection, tenant) under ordered requests (op, owner, at), for ``replay``.

    acquire: granted if free or run out (a holder that asks again is not granted, as another is not);
    renew and release: for the holder within its time.
    """

    def step(state, r):
        now, owner = r["at"], r["owner"]
        held = state if state and state["until"] > now else None
        if r["op"] == "acquire":
            done = held is None
        else:
            done = held is not None and held["owner"] == owner
        if done:
            held = None if r["op"] == "release" else {"owner": owner, "until": now + ttl}
        return held, {"done": done, "holder": held["owner"] if held else None}

    return step


LEASE_OUT = "done boolean, holder string"
