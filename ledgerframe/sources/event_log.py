"""An append-only log in a folder: Parquet files that a commit makes visible, all or nothing.

``commits/<n>.json`` names the folders of events and outbox rows that commit n added. It appears whole
and is never overwritten, so that of two writers one wins; the other reads the heads anew, classifies
once more and otherwise reports a conflict. Readers see the folders of the commits they list at the
start; every ``LISTED``-th commit leaves a list of all before it, so that opening a log reads few files.
Events lie in folders by a hash of their stream: appends and reads of few streams read those only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import append, outbox, reads
from ..schema import EVENT_LOG, OUTBOX, category_of, migrations_to_run
from .files import Folder

BUCKETS = 64
LISTED = 100
#: What ``init`` brings a folder to, in order; each step is recorded once it is done.
STEPS = {1: "folders", 2: "outbox"}


class CommitConflict(RuntimeError):
    pass


def bucket_of(stream_id: Column) -> Column:
    return F.pmod(F.xxhash64(stream_id), F.lit(BUCKETS)).cast("int")


class EventLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Folder(spark, self.folder)

    def init(self) -> None:
        """Create the log, or bring an older one up to date; doing so again changes nothing."""
        self.files.make("migrations")
        done = [int(n.split(".")[0]) for n in self.files.names("migrations") if n.endswith(".json") and not n.startswith(".")]
        for version, name in migrations_to_run(STEPS, done):
            for folder in {"folders": ("commits", "data", "results"), "outbox": ("outbox", "published")}[name]:
                self.files.make(folder)
            self.files.create(f"migrations/{version:06d}.json", {"version": version, "name": name})

    # ---- reading

    def commits(self) -> list[dict]:
        names = [n for n in self.files.names("commits") if not n.startswith(".")]
        lists = [n for n in names if n.startswith("upto-")]
        found = self.files.load(f"commits/{lists[-1]}")["commits"] if lists else []
        after = found[-1]["n"] if found else 0
        return found + [self.files.load(f"commits/{n}") for n in names if n[0].isdigit() and int(n.split(".")[0]) > after]

    def _table(self, commits: list[dict], kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{c[kind]}" for c in commits if c.get(kind)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _events(self, commits: list[dict]) -> DataFrame:
        paths = [f"{self.folder}/data/commit={c['data']}" for c in commits if c["data"]]
        schema = f"{EVENT_LOG}, commit string, bucket int"
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.drop("commit")

    def read(self, upto_commit: int | None = None) -> DataFrame:
        """The log as of a commit (the last one by default)."""
        return self._events([c for c in self.commits() if upto_commit is None or c["n"] <= upto_commit]).drop("bucket")

    def streams(self, wanted: DataFrame, commits: list[dict] | None = None) -> DataFrame:
        """The events of the wanted streams (stream_id), from the folders that can hold them."""
        keys = wanted.select("stream_id").distinct()
        buckets = [r[0] for r in keys.select(bucket_of(F.col("stream_id"))).distinct().collect()]  # BUCKETS at most
        log = self._events(self.commits() if commits is None else commits)
        return log.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket").join(keys, "stream_id", "left_semi")

    def heads(self, wanted: DataFrame) -> DataFrame:
        return reads.heads_of(wanted, self.streams(wanted))

    # ---- writing

    def append(self, requests: DataFrame, created_at: Column) -> DataFrame:
        """Append batches (batch_id, stream_id, expected_version, seq and event columns); one result row per batch.

        Several batches of one stream are taken in the order of their ids, each seeing what those before
        it wrote; all that are accepted become visible in one commit. Conflicts are reported, not raised.
        """
        return self._commit(requests, created_at, None, refuse=False)

    def _commit(self, requests: DataFrame | None, created_at: Column, collected: DataFrame | None, refuse: bool) -> DataFrame | None:
        for attempt in (1, 2):
            commits = self.commits()
            last = commits[-1] if commits else {"n": 0, "last_position": 0, "last_outbox": 0}
            commit = {"n": last["n"] + 1, "data": None, "events": 0, "last_position": last["last_position"], "outbox": None, "last_outbox": last["last_outbox"]}
            name, results = uuid.uuid4().hex, None
            if requests is not None:
                results = self._write_events(requests, commits, created_at, name, commit, refuse)
            if collected is not None:
                self._write_outbox(collected, commits, created_at, name, commit)
            if not commit["data"] and not commit["outbox"]:
                return results
            if self.files.create(f"commits/{commit['n']:012d}.json", commit):
                if commit["n"] % LISTED == 0:
                    self.files.create(f"commits/upto-{commit['n']:012d}.json", {"commits": [*commits, commit]})
                return results
            for made in (f"data/commit={name}", f"outbox/{name}", f"results/{name}"):
                self.files.delete(made)
        raise CommitConflict(f"commit {commit['n']} was made by another writer")

    def _write_events(self, requests: DataFrame, commits: list[dict], created_at: Column, name: str, commit: dict, refuse: bool) -> DataFrame:
        held = self.streams(requests, commits)
        settled = append.settle(requests, reads.heads(held), held)
        settled.write.parquet(f"{self.folder}/results/{name}/settled")
        settled = self.spark.read.schema(settled.schema).parquet(f"{self.folder}/results/{name}/settled")
        if refuse and not settled.filter("outcome = 'conflict'").isEmpty():
            self.files.delete(f"results/{name}")
            raise CommitConflict("a guard does not hold")
        events = append.assign(requests.filter("event_id is not null"), settled, commit["last_position"])
        events = events.withColumns({"category": category_of(F.col("stream_id")), "created_at": created_at.cast("timestamp_ntz"), "bucket": bucket_of(F.col("stream_id"))})
        wanted = self.spark.createDataFrame([], EVENT_LOG).schema.fields
        columns = [F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
        # Rebalanced, so that a bucket with a large stream is written by several tasks.
        events.select(*columns, "bucket").hint("rebalance", "bucket").sortWithinPartitions("bucket", "stream_id", "version").write.partitionBy("bucket").parquet(f"{self.folder}/data/commit={name}")
        written = self._events([{"data": name}])
        commit["events"] = written.count()
        commit["last_position"] += commit["events"]
        commit["data"] = name if commit["events"] else None
        ends = written.select("stream_id", F.col("version").alias("next_expected_version"), F.col("global_position").alias("end"))
        out = settled.join(ends, ["stream_id", "next_expected_version"], "left").withColumn("last_global_position", F.coalesce("end", "last_global_position"))
        return out.select(*settled.columns)

    # ---- outbox

    def _write_outbox(self, collected: DataFrame, commits: list[dict], created_at: Column, name: str, commit: dict) -> None:
        """Number the collected messages in their order and write them; a message id is taken once."""
        before = self._table(commits, "outbox", OUTBOX)
        ids = before.select("message_id").unionByName(collected.select("message_id"))
        if not outbox.conflicts(ids).isEmpty():
            raise CommitConflict("a message is in the outbox already")
        rows = append.number(outbox.normalised(collected, created_at), ["seq"], commit["last_outbox"]).withColumnRenamed("number", "id")
        rows.select(*[f.name for f in before.schema.fields]).write.parquet(f"{self.folder}/outbox/{name}")
        count = self.spark.read.schema(OUTBOX).parquet(f"{self.folder}/outbox/{name}").count()
        commit["last_outbox"] += count
        commit["outbox"] = name if count else None

    def outbox(self) -> DataFrame:
        """The outbox rows of all commits, with when they were published, if they were."""
        rows = self._table(self.commits(), "outbox", OUTBOX).drop("published_at")
        marks = [f"{self.folder}/published/{n}" for n in self.files.names("published") if not n.startswith(".")]
        if not marks:
            return rows.withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
        done = self.spark.read.schema("id long, published_at timestamp_ntz").parquet(*marks).groupBy("id").agg(F.min("published_at").alias("published_at"))
        return rows.join(done, "id", "left")

    def mark_published(self, ids: DataFrame, at: Column) -> None:
        """Record that messages went out; rows of the outbox itself never change."""
        ids.select("id", at.cast("timestamp_ntz").alias("published_at")).write.parquet(f"{self.folder}/published/{uuid.uuid4().hex}")


class Transaction:
    """Buffers appends and outbox messages; one commit writes them all, leaving without it writes nothing.

    Appends of one stream follow one another in the order they were made. At the commit all guards are
    looked at again, against what is stored and what the appends before would leave; if one does not
    hold, nothing is written.
    """

    def __init__(self, log: EventLog):
        self.log, self.requests, self.messages, self.done = log, [], [], False

    def append(self, requests: DataFrame) -> None:
        self._open()
        place = F.concat(F.lit(f"{len(self.requests):06d}/"), F.col("batch_id"))
        self.requests.append(requests.withColumn("batch_id", place))

    def flush(self, collector: outbox.Collector) -> None:
        """Take what was collected so far into this transaction; the collector is empty afterwards."""
        self._open()
        if not isinstance(collector, outbox.Collector):
            raise TypeError(f"a Collector is needed, not a {type(collector).__name__}")
        drained = collector.drain(self.log.spark)
        if drained is not None:
            self.messages.append(drained)

    def heads(self, streams: DataFrame) -> DataFrame:
        """Heads as the transaction would leave them: stored ones advanced by the appends that would be accepted."""
        stored = self.log.heads(streams).select("stream_id", "current_version")
        if not self.requests:
            return stored
        mine = self._all().join(streams.select("stream_id").distinct(), "stream_id", "left_semi")
        held = self.log.streams(mine)
        settled = append.settle(mine, reads.heads(held), held).filter("outcome = 'appended'")
        ahead = settled.groupBy("stream_id").agg(F.max("next_expected_version").alias("ahead"))
        return stored.join(ahead, "stream_id", "left").select("stream_id", F.coalesce("ahead", "current_version").alias("current_version"))

    def commit(self, created_at: Column) -> DataFrame | None:
        """One result row per batch, or None if there was nothing to append; raises ``CommitConflict``."""
        self._open()
        self.done = True
        messages = None
        for k, m in enumerate(self.messages):
            m = m.withColumn("seq", F.struct(F.lit(k).alias("k"), F.col("seq").alias("n")))
            messages = m if messages is None else messages.unionByName(m)
        results = self.log._commit(self._all() if self.requests else None, created_at, messages, refuse=True)
        return None if results is None else results.withColumn("batch_id", F.expr("substring(batch_id, 8)"))

    def _all(self) -> DataFrame:
        out = self.requests[0]
        for r in self.requests[1:]:
            out = out.unionByName(r)
        return out

    def _open(self) -> None:
        if self.done:
            raise RuntimeError("the transaction is over")

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_) -> None:
        self.done = True
