"""The query catalogue over the business tables; ``catalogue`` pairs each with its ANSI SQL twin."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..operators import aggregates, append, folds, leases, outbox, projections, reads, replay, upcast
from ..schema import HousekeepingOptions, pending_migrations, tenant_key
from ..sources import logs
from ..sources.event_log import EventLog, Transaction
from ..sources.logs import table, user_log
from ..streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

L1 = """l AS (
  SELECT event_id + 1 AS global_position, 'user-' || user_id AS stream_id, 'user' AS category, CAST(event_id AS VARCHAR) AS event_id,
         event_type, 1 AS schema_version, props AS payload, 't' || (user_id % 4) AS tenant_id, ts AS created_at, user_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS version
  FROM events
)"""


def _fnv_sql(basis: int, text: str) -> str:
    """FNV-1a in 64 bits of an ASCII text, folded in 128-bit integers."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS HUGEINT))"
    return f"list_reduce(list_prepend(CAST({basis} AS HUGEINT), {codes}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


def _uuid_sql(low: str, high: str) -> str:
    """The id whose first eight bytes are ``low`` and last eight ``high``, each with its least byte first."""

    def part(x: str, shift: int, digits: int) -> str:
        return f"format('{{:0{digits}x}}', CAST(({x} // {1 << shift}) % {1 << (4 * digits)} AS BIGINT))"

    tail = [part(high, 8 * k, 2) for k in range(8)]
    return " || '-' || ".join([part(low, 0, 8), part(low, 32, 4), part(low, 48, 4), " || ".join(tail[:2]), " || ".join(tail[2:])])


ID_SQL = f"""k AS (SELECT *, {_fnv_sql(ids.FNV_OFFSET, 'name')} AS low, {_fnv_sql(ids.FNV_PRIME, 'name')} AS high FROM named)"""


def query(sql: str | None = None, log: bool = True):
    """Register a query under its function's name; ``log``: its SQL reads the user log as ``l``."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if log:
                text = f"WITH RECURSIVE {L1}, {text[5:]}" if text.startswith("WITH ") else f"WITH {L1} {text}"
            ORACLE[f.__name__] = text
        return f

    return take


# ---------------------------------------------------------------- reads

EVENT = ("stream_id", "version", "global_position", "event_type", "payload")


@query("SELECT stream_id, version, global_position, event_type, payload FROM l WHERE stream_id = 'user-7' AND version BETWEEN 3 AND 10")
def stream_read_forward(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_stream(user_log(spark, d, user=7), "user-7", 3, 10).select(*EVENT)


@query("""SELECT stream_id, version, global_position, event_type, row_number() OVER (ORDER BY version DESC) AS place
FROM l WHERE stream_id = 'user-7' AND version BETWEEN 3 AND 10""")
def stream_read_backward(spark: SparkSession, d: str) -> DataFrame:
    found = reads.read_stream(user_log(spark, d, user=7), "user-7", 3, 10, forwards=False)
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("version").desc())).cast("long")
    return found.select("stream_id", "version", "global_position", "event_type", place.alias("place"))


@query("SELECT stream_id, count(*) AS events, max(created_at) AS last_at FROM l WHERE version <= 20 GROUP BY stream_id")
def stream_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    past = reads.as_of(user_log(spark, d), version=20)
    return past.groupBy("stream_id").agg(F.count("*").alias("events"), F.max("created_at").alias("last_at"))


@query("SELECT global_position, stream_id, event_type, payload FROM l WHERE global_position > 100 AND global_position <= 300")
def all_read_after_upto(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_all(user_log(spark, d, versions=False, after=100, upto=300), 100, 300).select("global_position", "stream_id", "event_type", "payload")


@query("SELECT global_position, stream_id, event_type FROM l ORDER BY global_position DESC LIMIT 50")
def all_read_backward_limit(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_all(user_log(spark, d, versions=False), max_count=50, forwards=False).select("global_position", "stream_id", "event_type")


@query("""SELECT global_position, stream_id, event_type FROM l
WHERE global_position > 200 AND event_type IN ('purchase', 'signup') ORDER BY global_position LIMIT 100""")
def catchup_batch_typed(spark: SparkSession, d: str) -> DataFrame:
    return reads.catchup_batch(user_log(spark, d, versions=False, after=200, types=("purchase", "signup")), 200, 100, {"purchase", "signup"}).select("global_position", "stream_id", "event_type")


@query("SELECT CAST(0 AS BIGINT) AS events", log=False)
def catchup_batch_empty_types(spark: SparkSession, d: str) -> DataFrame:
    return reads.catchup_batch(user_log(spark, d, versions=False), 0, 100, set()).agg(F.count("*").alias("events"))


@query("""SELECT global_position, stream_id, event_type, created_at FROM l
WHERE created_at < (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY global_position LIMIT 500""")
def catchup_safe_hwm(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d, versions=False)
    newest = log.agg(F.max("created_at")).first()[0]  # what a clock would be asked for
    cut = F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    return reads.catchup_batch(log, 0, 500, visible_before=cut).select("global_position", "stream_id", "event_type", "created_at")


@query("""SELECT stream_id, max(version) AS current_version, max(global_position) AS head_position, arg_max(event_type, version) AS head_type
FROM l GROUP BY stream_id""")
def stream_heads(spark: SparkSession, d: str) -> DataFrame:
    return reads.heads(user_log(spark, d, versions=False))


@query("""WITH w AS (SELECT 'user-' || v AS stream_id FROM (VALUES (0), (3), (999999)) t(v))
SELECT w.stream_id, coalesce(max(version), -1) AS current_version, coalesce(max(global_position), 0) AS head_position
FROM w LEFT JOIN l USING (stream_id) GROUP BY w.stream_id""")
def stream_heads_wanted(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("user-0",), ("user-3",), ("user-999999",)], "stream_id string")
    return reads.heads_of(wanted, user_log(spark, d, versions=False)).select("stream_id", "current_version", "head_position")


@query("SELECT stream_id, min(category) AS category, arg_min(tenant_id, version) AS tenant_id, max(version) AS current_version FROM l GROUP BY stream_id")
def stream_registry(spark: SparkSession, d: str) -> DataFrame:
    return reads.streams(user_log(spark, d, versions=False))


@query("SELECT max(global_position) AS high_water_mark FROM l")
def safe_high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    return reads.safe_high_water_mark(user_log(spark, d, versions=False))


@query("""SELECT 'inside' AS probe, (SELECT count(*) FROM l WHERE global_position > 500) > 0 AS found
UNION ALL SELECT 'beyond', (SELECT count(*) FROM l WHERE global_position > 1000000000) > 0""")
def existence_peek(spark: SparkSession, d: str) -> DataFrame:
    probe = lambda name, at: reads.exists_above(user_log(spark, d, versions=False, after=at), at).select(F.lit(name).alias("probe"), "found")
    return probe("inside", 500).unionByName(probe("beyond", 1_000_000_000))


@query("""SELECT stream_id, event_type, count(*) AS events FROM (
  SELECT category, stream_id, event_type FROM l UNION ALL SELECT 'conv', 'conv-' || conv_id, role FROM conversations)
WHERE category = 'conv' GROUP BY stream_id, event_type""")
def category_scan(spark: SparkSession, d: str) -> DataFrame:
    users = user_log(spark, d, versions=False).select("category", "stream_id", "event_type")
    both = users.unionByName(logs.conversation_log(spark, d).select("category", "stream_id", "event_type"))
    return reads.category(both, "conv").groupBy("stream_id", "event_type").agg(F.count("*").alias("events"))


@query("""SELECT category, count(*) AS events, count(DISTINCT stream_id) AS streams FROM (
  SELECT category, stream_id FROM l
  UNION ALL SELECT 'conv', 'conv-' || conv_id FROM conversations) GROUP BY category""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    users = user_log(spark, d, versions=False).select("category", "stream_id")
    both = users.unionByName(logs.conversation_log(spark, d).select("category", "stream_id"))
    per_stream = both.groupBy("category", "stream_id").agg(F.count("*").alias("events"))
    return per_stream.groupBy("category").agg(F.sum("events").alias("events"), F.count("*").alias("streams"))


@query("SELECT stream_id, global_position, event_type, value FROM l WHERE tenant_id = 't2' AND global_position > 50")
def tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    return reads.tenant(user_log(spark, d, versions=False, after=50), "t2").select("stream_id", "global_position", "event_type", "value")


@query("SELECT CASE WHEN user_id % 3 = 0 THEN '' ELSE tenant_id END AS tenant_id, count(*) AS events FROM l GROUP BY 1")
def tenant_normalised(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d, versions=False).withColumn("tenant_id", F.when(F.col("user_id") % 3 != 0, F.col("tenant_id")))
    return log.groupBy(tenant_key(F.col("tenant_id")).alias("tenant_id")).agg(F.count("*").alias("events"))


@query("SELECT count(*) AS events, count(DISTINCT stream_id) AS streams FROM l")
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    return user_log(spark, d, versions=False).agg(F.count("*").alias("events"), F.countDistinct("stream_id").alias("streams"))


# ---------------------------------------------------------------- appends


@query("""SELECT h.stream_id, e.expected AS expected_version, h.last AS actual_version,
       CASE WHEN e.expected = -2 THEN true WHEN e.expected IN (-1, 0) THEN h.last = -1 WHEN e.expected = -3 THEN h.last >= 0 ELSE e.expected = h.last END AS accepted
FROM (SELECT stream_id, max(version) AS last FROM l GROUP BY stream_id UNION ALL SELECT 'user-none', -1) h
CROSS JOIN (SELECT CAST(v AS BIGINT) AS expected FROM (VALUES (-3), (-2), (-1), (0), (1), (5)) t(v)) e""")
def append_guard_matrix(spark: SparkSession, d: str) -> DataFrame:
    last = reads.heads(user_log(spark, d, versions=False)).select("stream_id", F.col("current_version").alias("actual_version"))
    last = last.unionByName(spark.createDataFrame([("user-none", -1)], "stream_id string, actual_version long"))
    asked = last.withColumn("expected_version", F.explode(F.array(*[F.lit(v).cast("long") for v in (-3, -2, -1, 0, 1, 5)])))
    return asked.select("stream_id", "expected_version", "actual_version", append.guard(F.col("expected_version"), F.col("actual_version")).alias("accepted"))


#: Requests over the user log's first half: batches of two events that follow the cut, some repeating a stored event.
CUT_SQL = """cut AS (SELECT max(global_position) // 2 AS half FROM l),
stored AS (SELECT l.* FROM l, cut WHERE global_position <= half),
head AS (SELECT stream_id, max(version) AS last, max(global_position) AS pos FROM stored GROUP BY stream_id),
req AS (
  SELECT 'b-' || l.stream_id AS batch_id, l.stream_id, l.version, l.event_id, l.global_position, l.user_id,
         CASE l.user_id % 4 WHEN 0 THEN -2 WHEN 1 THEN coalesce(h.last, -1) WHEN 2 THEN -3 ELSE 1 END AS expected
  FROM l LEFT JOIN head h USING (stream_id), cut
  WHERE l.version BETWEEN coalesce(h.last, -1) + CASE WHEN l.user_id % 5 = 0 THEN 0 ELSE 1 END AND coalesce(h.last, -1) + 2
),
b AS (
  SELECT r.batch_id, r.stream_id, any_value(r.expected) AS expected, count(*) AS size,
         coalesce(bool_or(s.event_id IS NOT NULL), false) AS repeats, coalesce(any_value(h.last), -1) AS last, coalesce(any_value(h.pos), 0) AS pos
  FROM req r LEFT JOIN stored s ON s.stream_id = r.stream_id AND s.event_id = r.event_id LEFT JOIN head h ON h.stream_id = r.stream_id
  GROUP BY r.batch_id, r.stream_id
),
o AS (
  SELECT *, CASE WHEN repeats THEN 'duplicate'
    WHEN CASE WHEN expected = -2 THEN true WHEN expected IN (-1, 0) THEN last = -1 WHEN expected = -3 THEN last >= 0 ELSE expected = last END THEN 'appended'
    ELSE 'conflict' END AS outcome FROM b
)"""


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = user_log(spark, d, versions=False)
    half = log.agg(F.max("global_position")).first()[0] // 2
    stored = user_log(spark, d, versions=False, upto=half)
    heads = reads.heads(stored)  # counted, without a window
    # A stream's version needs its events in order: one window, which the heads' shuffle is on, too.
    last = F.coalesce(F.max(F.when(F.col("global_position") <= half, F.col("version"))).over(Window.partitionBy("stream_id")), F.lit(-1).cast("long"))
    u = F.col("user_id")
    asked = logs.with_versions(log).withColumn("last", last)
    asked = asked.filter(F.col("version").between(F.col("last") + F.when(u % 5 == 0, 0).otherwise(1), F.col("last") + 2))
    expected = F.when(u % 4 == 0, F.lit(-2)).when(u % 4 == 1, F.col("last")).when(u % 4 == 2, F.lit(-3)).otherwise(F.lit(1))
    requests = asked.select(
        F.concat(F.lit("b-"), "stream_id").alias("batch_id"), "stream_id", expected.cast("long").alias("expected_version"), F.col("version").cast("int").alias("seq"), "event_id", "event_type", "schema_version", "payload", "tenant_id"
    )
    return requests, heads, stored


@query(f"""WITH {CUT_SQL}
SELECT batch_id, stream_id, outcome, CASE outcome WHEN 'appended' THEN last + size WHEN 'duplicate' THEN last END AS next_expected_version,
       CASE outcome WHEN 'duplicate' THEN pos END AS last_global_position, repeats AS deduplicated, last AS actual_version FROM o""")
def append_result(spark: SparkSession, d: str) -> DataFrame:
    return append.classify(*_requests(spark, d))


@query(f"WITH {CUT_SQL} SELECT batch_id, repeats AS deduplicated, pos AS head_position FROM o WHERE repeats")
def append_dedup(spark: SparkSession, d: str) -> DataFrame:
    return append.classify(*_requests(spark, d)).filter("deduplicated").select("batch_id", "deduplicated", F.col("last_global_position").alias("head_position"))


@query(f"""WITH {CUT_SQL}
SELECT r.stream_id, r.event_id, o.last + row_number() OVER (PARTITION BY r.batch_id ORDER BY r.version) AS version,
       1000 + row_number() OVER (ORDER BY r.batch_id, r.version) AS global_position
FROM req r JOIN o ON o.batch_id = r.batch_id WHERE o.outcome = 'appended'""")
def append_assign_versions(spark: SparkSession, d: str) -> DataFrame:
    requests, heads, stored = _requests(spark, d)
    return append.assign(requests, append.classify(requests, heads, stored), 1000).select("stream_id", "event_id", "version", "global_position")


@query("""WITH r AS (SELECT * FROM l UNION ALL SELECT * REPLACE (global_position + 1000000000 AS global_position) FROM l WHERE global_position % 5 = 0)
SELECT stream_id, event_id, min(global_position) AS global_position, arg_min(event_type, global_position) AS event_type FROM r GROUP BY stream_id, event_id""")
def log_dedup_event_id(spark: SparkSession, d: str) -> DataFrame:
    log = logs.redelivered(user_log(spark, d, versions=False))
    return append.deduplicated(log.select("stream_id", "event_id", "global_position", "event_type"))


# ---------------------------------------------------------------- the stored log


def _new_log(spark: SparkSession) -> EventLog:
    """An empty log in the folder that driver and executors share; the session removes it when it ends."""
    import atexit
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="ledgerframe-")
    log = EventLog(spark, f"{folder.rstrip('/')}/log-{uuid.uuid4().hex}")
    log.init()

    def remove():
        try:
            log.files.delete("")
        except Exception:  # the session is gone, and with it what would read the log
            pass

    atexit.register(remove)
    return log


def _batch(events: DataFrame, name: str, expected: int) -> DataFrame:
    return events.select(
        F.concat(F.lit(f"{name}-"), "stream_id").alias("batch_id"), "stream_id", F.lit(expected).cast("long").alias("expected_version"), F.col("version").cast("int").alias("seq"),
        "event_id", "event_type", "schema_version", "payload", "tenant_id",
    )


def _transaction(spark: SparkSession, d: str) -> Transaction:
    """Two appends of each stream, the second of which expects what the first leaves."""
    e = user_log(spark, d)
    t = Transaction(_new_log(spark))
    t.append(_batch(e.filter("version < 5"), "a", -1))
    t.append(_batch(e.filter("version between 5 and 9"), "b", 4))
    return t


@query("SELECT stream_id, CAST(least(max(version), 9) AS BIGINT) AS current_version FROM l GROUP BY stream_id UNION ALL SELECT 'user-none', -1")
def transaction_heads(spark: SparkSession, d: str) -> DataFrame:
    streams = user_log(spark, d, versions=False).select("stream_id").distinct().unionByName(spark.createDataFrame([("user-none",)], "stream_id string"))
    return _transaction(spark, d).heads(streams)


@query("""SELECT stream_id, version, row_number() OVER (ORDER BY version >= 5, stream_id, version) AS global_position, event_id, event_type, category, payload, tenant_id
FROM l WHERE version < 10""")
def transaction_commit(spark: SparkSession, d: str) -> DataFrame:
    t = _transaction(spark, d)
    t.commit(F.lit(NOW))
    return t.log.read().select("stream_id", "version", "global_position", "event_id", "event_type", "category", "payload", "tenant_id")


@query("""WITH b AS (SELECT *, version // 3 AS nth FROM l WHERE version < 9), s AS (SELECT stream_id, nth, count(*) AS size, max(version) AS last FROM b GROUP BY stream_id, nth)
SELECT nth || '-' || stream_id AS batch_id, stream_id, 'appended' AS outcome, CAST(last AS BIGINT) AS next_expected_version, nth * 3 - 1 AS actual_version FROM s WHERE nth < 2
UNION ALL SELECT nth || '-' || stream_id, stream_id, 'conflict', NULL, 5 FROM s WHERE nth = 2
UNION ALL SELECT DISTINCT '3-' || stream_id, stream_id, 'duplicate', least(5, max(version) OVER (PARTITION BY stream_id)), least(5, max(version) OVER (PARTITION BY stream_id)) FROM l""")
def append_many_batches(spark: SparkSession, d: str) -> DataFrame:
    """Four batches a stream in one commit: new, following, refused, and one that comes again."""
    e = user_log(spark, d).filter("version < 9").withColumn("nth", F.floor(F.col("version") / 3))
    again = e.filter("version < 3").withColumn("nth", F.lit(3))
    e = e.withColumn("nth", F.col("nth").cast("int")).unionByName(again)
    expected = F.when(F.col("nth") == 0, -1).when(F.col("nth") == 1, 2).when(F.col("nth") == 2, 99).otherwise(-2)
    asked = e.select(F.concat(F.col("nth").cast("string"), F.lit("-"), "stream_id").alias("batch_id"), "stream_id", expected.cast("long").alias("expected_version"), F.col("version").cast("int").alias("seq"), "event_id", "event_type", "schema_version", "payload", "tenant_id")
    return _new_log(spark).append(asked, F.lit(NOW)).select("batch_id", "stream_id", "outcome", "next_expected_version", "actual_version")


@query("""SELECT row_number() OVER (ORDER BY global_position) AS id, md5('m' || event_id) AS message_id, event_type, payload, tenant_id, global_position % 2 = 0 AS published
FROM l WHERE event_type = 'purchase'""")
def outbox_flush(spark: SparkSession, d: str) -> DataFrame:
    """Messages collected beside the events of one commit, half of which are published afterwards."""
    e = user_log(spark, d).filter("event_type = 'purchase'")
    collector, log = outbox.Collector(), _new_log(spark)
    collector.collect(e.select(_message().alias("message_id"), "event_type", "payload", "tenant_id", F.col("global_position").alias("seq")))
    with Transaction(log) as t:
        t.append(_batch(e, "a", -1))
        t.flush(collector)
        t.commit(F.lit(NOW))
    rows = log.outbox()
    out = e.select(_message().alias("message_id"), "global_position").filter("global_position % 2 = 0")
    log.mark_published(rows.join(out, "message_id", "left_semi"), F.lit(NOW))
    return log.outbox().select("id", "message_id", "event_type", "payload", "tenant_id", F.col("published_at").isNotNull().alias("published"))


@query("""SELECT * FROM (SELECT stream_id, max(version) AS read_version, CAST(count(*) AS INTEGER) AS seen FROM l GROUP BY stream_id)""")
def fetch_for_writing(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d, versions=False)
    return log.groupBy("stream_id").agg((F.count("*") - 1).alias("read_version"), F.count("*").cast("int").alias("seen"))


@query(f"""WITH h AS (SELECT stream_id, max(version) AS last FROM l GROUP BY stream_id), n AS (SELECT * FROM (VALUES (0, 'checked'), (1, 'closed')) t(seq, event_type)),
named AS (SELECT stream_id, last, seq, event_type, md5('cmd') || ':' || stream_id || ':' || seq AS name FROM h, n WHERE seq = 0 OR last % 2 = 0), {ID_SQL}
SELECT stream_id, CAST(last + 1 + seq AS BIGINT) AS version, event_type, {_uuid_sql('low', 'high')} AS event_id FROM k""")
def aggregate_save(spark: SparkSession, d: str) -> DataFrame:
    """Every stream checked, those of even version closed as well: read versions, deterministic ids, guards and versions."""
    stored = user_log(spark, d, versions=False)
    heads = reads.heads(stored)
    done = F.array(F.struct(F.lit(0).alias("seq"), F.lit("checked").alias("event_type")), F.struct(F.lit(1).alias("seq"), F.lit("closed").alias("event_type")))
    decided = heads.select("stream_id", F.col("current_version").alias("read_version"), F.inline(done)).filter("seq = 0 or read_version % 2 = 0")
    requests = aggregates.save_requests(decided.withColumn("payload", F.lit("{}")), F.md5(F.lit("cmd")))
    return append.assign(requests, append.classify(requests, heads, stored), 0).select("stream_id", "version", "event_type", "event_id")


# ---------------------------------------------------------------- folds and snapshots

STEP_SQL = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END"


@query(f"""SELECT stream_id, max(version) AS version, CAST(sum({STEP_SQL}) AS BIGINT) AS counter,
       CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END) AS BIGINT) AS ignored,
       arg_max(event_type, version) AS last_type, max(global_position) AS last_position FROM l GROUP BY stream_id""")
def fold_counter(spark: SparkSession, d: str) -> DataFrame:
    return folds.counters(user_log(spark, d, versions=False))


@query("""SELECT 'order-' || o_orderkey AS stream_id, true AS placed, o_orderstatus = 'P' AS cancelled, count(l_orderkey) AS lines,
       CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18, 2))), 0) AS DOUBLE) AS quantity,
       count(l_orderkey) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS version
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""", log=False)
def fold_order_state(spark: SparkSession, d: str) -> DataFrame:
    states = folds.order_sums(logs.order_log(spark, d), "o_orderkey")
    return states.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("stream_id"), "version", "placed", "cancelled", "lines", "quantity")


@query(f"""SELECT stream_id, max(version) AS version, CAST(sum({STEP_SQL}) AS BIGINT) AS counter FROM l, (SELECT max(event_id) // 2 AS n FROM events)
WHERE global_position <= n GROUP BY stream_id""")
def fold_as_of_position(spark: SparkSession, d: str) -> DataFrame:
    half = table(spark, d, "events").agg((F.max("event_id") / 2).cast("long")).first()[0]
    return folds.counters(user_log(spark, d, versions=False, upto=half)).select("stream_id", "version", "counter")


@query("""SELECT 'order-' || o_orderkey AS stream_id, true AS placed, true AS cancelled, count(l_orderkey) AS lines,
       CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18, 2))), 0) AS DOUBLE) AS quantity, count(l_orderkey) + 1 AS version
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""", log=False)
def fold_cancelled_orders(spark: SparkSession, d: str) -> DataFrame:
    """The general fold, in the order of versions, over the orders that end with a cancellation."""
    log = logs.order_log(spark, d).join(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", "left_semi")
    return folds.order_states(logs.with_places(log))


RUNNING_SQL = f"running AS (SELECT *, CAST(sum({STEP_SQL}) OVER (PARTITION BY stream_id ORDER BY version) AS BIGINT) AS counter FROM l)"


@query(f"WITH {RUNNING_SQL} SELECT stream_id, version, counter FROM running")
def running_state(spark: SparkSession, d: str) -> DataFrame:
    return folds.running_counter(user_log(spark, d)).select("stream_id", "version", "counter")


@query(f"""WITH {RUNNING_SQL} SELECT stream_id, max(version) AS version, 1 AS schema_version, arg_max(counter, version) AS state
FROM running WHERE (version + 1) % 10 = 0 GROUP BY stream_id""")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    return folds.latest(folds.snapshots_every(user_log(spark, d), 10))


@query(f"""SELECT stream_id, max(version) AS version, CAST(sum({STEP_SQL}) AS BIGINT) AS counter, (max(version) + 1) % 10 AS replayed FROM l GROUP BY stream_id""")
def snapshot_first_fold(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    return folds.fold_tail(log, folds.usable(folds.latest(folds.snapshots_every(log, 10)), 1))


@query(f"""SELECT stream_id, max(version) AS version, CAST(sum({STEP_SQL}) AS BIGINT) AS counter,
       CASE WHEN user_id % 2 = 1 THEN max(version) + 1 ELSE (max(version) + 1) % 10 END AS replayed FROM l GROUP BY stream_id, user_id""")
def snapshot_schema_reject(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    stale = folds.latest(folds.snapshots_every(log, 10)).withColumn("schema_version", F.when(F.substring_index("stream_id", "-", -1).cast("long") % 2 == 1, 2).otherwise(1))
    return folds.fold_tail(log, folds.usable(stale, 1))


@query(f"""WITH {RUNNING_SQL}, s AS (SELECT stream_id, version, counter FROM running WHERE (version + 1) % 10 = 0 OR version % 7 = 0)
SELECT stream_id, max(version) AS version, 1 AS schema_version, arg_max(counter, version) AS state FROM s GROUP BY stream_id""")
def snapshot_save(spark: SparkSession, d: str) -> DataFrame:
    running = folds.running_counter(user_log(spark, d)).select("stream_id", "version", F.lit(1).alias("schema_version"), F.col("counter").alias("state"))
    stored = folds.latest(running.filter("(version + 1) % 10 = 0"))
    return folds.save_snapshots(stored, running.filter("version % 7 = 0"))


@query(f"""WITH {RUNNING_SQL} SELECT stream_id, max(version) AS version, 1 AS schema_version, arg_max(counter, version) AS state
FROM running WHERE (version + 1) % 10 = 0 AND user_id % 3 <> 0 GROUP BY stream_id""")
def snapshot_delete(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    gone = user_log(spark, d, versions=False).filter("user_id % 3 = 0").select("stream_id").unionByName(spark.createDataFrame([("user-none",)], "stream_id string"))
    return folds.deleted_snapshots(folds.latest(folds.snapshots_every(log, 10)), gone)


@query(f"""SELECT stream_id, CAST(CASE WHEN user_id % 2 = 0 THEN max(version) ELSE -1 END AS BIGINT) AS version,
       CAST(CASE WHEN user_id % 2 = 0 THEN sum({STEP_SQL}) END AS BIGINT) AS counter, CASE WHEN user_id % 2 = 0 THEN arg_max(event_type, version) END AS last_type FROM l GROUP BY stream_id, user_id""")
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    """Every stream's state captured as JSON, and restored into fresh aggregates where a snapshot was kept."""
    log = user_log(spark, d, versions=False)
    states = folds.counters(log).select("stream_id", "version", "counter", "last_type")
    kept = folds.captured(states).filter(F.substring_index("stream_id", "-", -1).cast("long") % 2 == 0)
    fresh = states.select("stream_id", F.lit(-1).cast("long").alias("version"))
    return folds.restored(fresh, kept, "counter long, last_type string")


@query("SELECT 'conv-' || conv_id AS stream_id, max(turn) AS version, arg_max(role, turn) AS last_type, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_turns FROM conversations GROUP BY conv_id", log=False)
def fold_conversation(spark: SparkSession, d: str) -> DataFrame:
    log = logs.conversation_log(spark, d)
    return log.groupBy("stream_id").agg(
        F.max("version").alias("version"), F.max_by("event_type", "version").alias("last_type"), F.sum((F.col("event_type") == "user").cast("long")).alias("user_turns")
    )


# ---------------------------------------------------------------- projections

SUBSCRIPTIONS = {"sales": ("purchase",), "funnel": ("signup", "purchase"), "errors": ("error",), "engagement": ("engagement",)}
HIERARCHY = {"engagement": ("click", "view")}
P_SQL = """p AS (
  SELECT s.projection, l.* FROM l JOIN (VALUES ('sales', 'purchase'), ('funnel', 'signup'), ('funnel', 'purchase'), ('errors', 'error'),
    ('engagement', 'click'), ('engagement', 'view')) s(projection, event_type) ON s.event_type = l.event_type
)"""


def _dispatched(spark: SparkSession, d: str, log: DataFrame | None = None) -> DataFrame:
    known = projections.Projections()
    for name, types in SUBSCRIPTIONS.items():
        known.register(name, types, hierarchy=HIERARCHY)
    return projections.dispatch(user_log(spark, d, versions=False) if log is None else log, known.by_name.values())


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM l GROUP BY event_type")
def projection_type_counts(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d, versions=False)
    return log.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, event_type, count(*) AS events, count(DISTINCT stream_id) AS streams FROM l GROUP BY 1, 2")
def projection_daily(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d, versions=False)
    return log.groupBy(F.to_date("created_at").cast("string").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("stream_id").alias("streams"))


@query(f"WITH {P_SQL} SELECT projection, count(*) AS events, min(global_position) AS first_position, max(global_position) AS last_position FROM p GROUP BY projection")
def type_dispatch(spark: SparkSession, d: str) -> DataFrame:
    e = _dispatched(spark, d)
    return e.groupBy("projection").agg(F.count("*").alias("events"), F.min("global_position").alias("first_position"), F.max("global_position").alias("last_position"))


@query(f"""WITH {P_SQL}, w(projection, position) AS (VALUES ('sales', 100), ('funnel', 0), ('errors', 400))
SELECT p.projection, count(DISTINCT global_position) AS applied FROM p LEFT JOIN w USING (projection) WHERE global_position > coalesce(position, 0) GROUP BY p.projection""")
def projection_watermark_idempotent(spark: SparkSession, d: str) -> DataFrame:
    twice = user_log(spark, d, versions=False)
    twice = twice.unionByName(twice.filter("global_position % 3 = 0"))
    marks = spark.createDataFrame([("sales", 100), ("funnel", 0), ("errors", 400)], "projection string, position long")
    fresh = projections.above_watermark(_dispatched(spark, d, twice), marks)
    return fresh.groupBy("projection").agg(F.count("*").alias("applied"))


@query(f"""WITH {P_SQL} SELECT n.projection, coalesce(max(p.global_position), 0) AS checkpoint, (SELECT max(global_position) FROM l) AS high_water_mark,
       (SELECT max(global_position) FROM l) - coalesce(max(p.global_position), 0) AS lag
FROM (VALUES ('sales'), ('funnel'), ('errors'), ('engagement'), ('nothing')) n(projection) LEFT JOIN p USING (projection) GROUP BY n.projection""")
def projection_lag(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in (*SUBSCRIPTIONS, "nothing")], "projection string")
    return projections.lag(_dispatched(spark, d), names, reads.safe_high_water_mark(user_log(spark, d, versions=False)))


@query(f"""WITH {P_SQL}, b AS (SELECT *, (row_number() OVER (PARTITION BY projection ORDER BY global_position) - 1) // 500 AS batch FROM p)
SELECT projection, batch, count(*) AS events, min(global_position) AS first_position, max(global_position) AS checkpoint,
       (SELECT max(global_position) FROM l) - max(global_position) AS pending,
       count(*) = 500 AND (SELECT max(global_position) FROM l) - max(global_position) > 5000 AS catch_up
FROM b GROUP BY projection, batch""")
def drain_schedule(spark: SparkSession, d: str) -> DataFrame:
    plan = projections.drain_schedule(_dispatched(spark, d), 500)
    mark = F.broadcast(reads.safe_high_water_mark(user_log(spark, d, versions=False)))
    return projections.catch_up(plan.join(mark), F.col("high_water_mark"), 500, 5000).drop("high_water_mark")


@query("""WITH g AS (SELECT global_position AS p, coalesce(lag(global_position) OVER (ORDER BY global_position), 0) AS q FROM l WHERE (global_position - 1) % 97 <> 0)
SELECT q AS "after", p - 1 AS upto, p - q - 1 AS missing FROM g WHERE p - q > 1""")
def gap_scan(spark: SparkSession, d: str) -> DataFrame:
    return projections.gaps(logs.with_gaps(user_log(spark, d, versions=False)))


@query("""WITH t AS (SELECT (event_id * 7) % 50 AS checkpoint, (event_id * 3) % 60 AS mark, event_id % 2 = 0 AS above, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 21 END AS waited, event_id FROM events)
SELECT event_id, CASE WHEN checkpoint >= mark THEN 'no_gap' WHEN above THEN 'no_gap' WHEN coalesce(waited, 0) >= 10 THEN 'skip' ELSE 'wait' END AS verdict FROM t""")
def gap_verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    verdict = projections.gap_verdict((e * 7) % 50, (e * 3) % 60, e % 2 == 0, F.when(e % 5 != 0, e % 21), F.lit(10))
    return table(spark, d, "events").select("event_id", verdict.alias("verdict"))


@query("""WITH t AS (SELECT event_id, (event_id * 7) % 50 AS checkpoint, (event_id * 3) % 60 AS mark, event_id % 2 = 0 AS above, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 21 END AS waited FROM events),
v AS (SELECT *, NOT above AND checkpoint < mark AND coalesce(waited, 0) >= 10 AS skips FROM t)
SELECT event_id, CASE WHEN skips THEN mark ELSE checkpoint END AS checkpoint, CASE WHEN skips THEN checkpoint END AS gap_from, CASE WHEN skips THEN mark END AS gap_upto,
       CAST(sum(CASE WHEN skips THEN 1 ELSE 0 END) OVER () AS BIGINT) AS gaps_skipped FROM v""", log=False)
def gap_skip(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    ticks = table(spark, d, "events").select("event_id", ((e * 7) % 50).alias("checkpoint"), ((e * 3) % 60).alias("mark"), (e % 2 == 0).alias("above"), F.when(e % 5 != 0, e % 21).alias("waited"))
    done = projections.skip_gaps(ticks, F.lit(10))
    counter = F.broadcast(done.agg(F.count("gap_upto").alias("gaps_skipped")))  # one row
    return done.join(counter).select("event_id", "checkpoint", "gap_from", "gap_upto", "gaps_skipped")


K_SQL = "CAST(json_extract_string(payload, '$.k') AS BIGINT)"
POISON_SQL = f"{K_SQL} % 10 = 3"
ERROR_SQL = f"'ValueError: bad k ' || {K_SQL}"


def _k():
    return F.get_json_object("payload", "$.k").cast("long")


def _error():
    return F.concat(F.lit("ValueError: bad k "), _k().cast("string"))


@query(f"WITH {P_SQL} SELECT projection, global_position, 4 AS attempts, {ERROR_SQL} AS error FROM p WHERE {POISON_SQL}")
def dead_letter_skip(spark: SparkSession, d: str) -> DataFrame:
    return projections.dead_letters(_dispatched(spark, d), _k() % 10 == 3, projections.ErrorPolicy(), _error())


@query(f"""WITH {P_SQL}, f AS (SELECT projection, min(global_position) FILTER (WHERE {POISON_SQL}) AS stop FROM p GROUP BY projection)
SELECT projection, count(*) AS applied, max(global_position) AS checkpoint FROM p JOIN f USING (projection) WHERE stop IS NULL OR global_position < stop GROUP BY projection""")
def dead_letter_pause(spark: SparkSession, d: str) -> DataFrame:
    return projections.applied(_dispatched(spark, d), _k() % 10 == 3, projections.ErrorPolicy(skip=False))


@query(f"WITH {P_SQL} SELECT projection, global_position, 4 AS attempts, {ERROR_SQL} AS error FROM p WHERE {POISON_SQL} ORDER BY global_position DESC, projection LIMIT 1024")
def dead_letter_ring(spark: SparkSession, d: str) -> DataFrame:
    return projections.newest(projections.dead_letters(_dispatched(spark, d), _k() % 10 == 3, projections.ErrorPolicy(), _error()))


@query(f"WITH {P_SQL} SELECT projection, CAST(sum(CASE WHEN {POISON_SQL} THEN 0 ELSE 1 END) AS BIGINT) AS applied, max(global_position) AS checkpoint FROM p GROUP BY projection")
def projection_skip_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return projections.applied(_dispatched(spark, d), _k() % 10 == 3, projections.ErrorPolicy())


# ---------------------------------------------------------------- schema evolution


def _text(before: str, after: str):
    return lambda p: F.concat(F.lit(before), F.get_json_object(p, "$.k"), F.lit(after))


def _renamed(p):
    return F.concat(F.lit('{"key":'), F.get_json_object(p, "$.k"), F.lit("}"))


def _bucketed(p):
    key = F.get_json_object(p, "$.key")
    return F.concat(F.lit('{"key":'), key, F.lit(',"bucket":'), (key.cast("long") % 10).cast("string"), F.lit("}"))


LINEAR = [upcast.Upcaster("click", 1, (("click", 2, _renamed),)), upcast.Upcaster("click", 2, (("click", 3, _bucketed),))]
FANOUT = [upcast.Upcaster("purchase", 1, (("ordered", 1, _text('{"o":', "}")), ("paid", 1, _text('{"p":', "}")))), upcast.Upcaster("error", 1, ())]
CROSS = [upcast.Upcaster("signup", 1, (("joined", 1, _renamed),)), upcast.Upcaster("joined", 1, (("member", 2, _bucketed),))]
K = "json_extract_string(payload, '$.k')"


@query(f"""SELECT global_position, event_type, CASE WHEN event_type = 'click' THEN 3 ELSE 1 END AS schema_version,
       CASE WHEN event_type = 'click' THEN '{{"key":' || {K} || ',"bucket":' || ({K_SQL} % 10) || '}}' ELSE payload END AS payload, 0 AS ordinal FROM l""")
def upcast_linear(spark: SparkSession, d: str) -> DataFrame:
    return upcast.Upcasters(LINEAR).apply(user_log(spark, d, versions=False)).select("global_position", "event_type", "schema_version", "payload", "ordinal")


@query(f"""SELECT global_position, event_type, payload, 0 AS ordinal FROM l WHERE event_type NOT IN ('purchase', 'error')
UNION ALL SELECT global_position, 'ordered', '{{"o":' || {K} || '}}', 0 FROM l WHERE event_type = 'purchase'
UNION ALL SELECT global_position, 'paid', '{{"p":' || {K} || '}}', 1 FROM l WHERE event_type = 'purchase'""")
def upcast_fanout(spark: SparkSession, d: str) -> DataFrame:
    return upcast.Upcasters(FANOUT).apply(user_log(spark, d, versions=False)).select("global_position", "event_type", "payload", "ordinal")


@query(f"""SELECT global_position, CASE event_type WHEN 'signup' THEN 'member' ELSE event_type END AS event_type, CASE event_type WHEN 'signup' THEN 2 ELSE 1 END AS schema_version,
       CASE WHEN event_type = 'signup' THEN '{{"key":' || {K} || ',"bucket":' || ({K_SQL} % 10) || '}}' ELSE payload END AS payload FROM l""")
def upcast_cross_type(spark: SparkSession, d: str) -> DataFrame:
    return upcast.Upcasters(CROSS).apply(user_log(spark, d, versions=False)).select("global_position", "event_type", "schema_version", "payload")


@query("SELECT global_position, event_type, schema_version, payload FROM l")
def upcast_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return upcast.Upcasters([]).apply(user_log(spark, d, versions=False)).select("global_position", "event_type", "schema_version", "payload")


@query(f"SELECT global_position, {K_SQL} AS k FROM l WHERE event_type = 'purchase'")
def payload_decode(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.registry import EventTypes

    types = EventTypes()
    types.register("purchase", "k bigint")
    return types.decoded(user_log(spark, d, versions=False), "purchase").select("global_position", F.col("data.k").alias("k"))


# ---------------------------------------------------------------- metadata and ids


def _message(column: str = "event_id"):
    return F.md5(F.concat(F.lit("m"), F.col(column)))


@query("SELECT event_id, md5('m' || event_id) AS message_id, md5('m' || event_id) AS correlation_id, md5('m' || event_id) AS causation_id FROM l")
def metadata_three_ids(spark: SparkSession, d: str) -> DataFrame:
    return user_log(spark, d, versions=False).select("event_id", ids.stamped(_message()).alias("m")).select("event_id", "m.*")


@query("""SELECT event_id, md5('m' || event_id) AS message_id, md5('m' || first_value(event_id) OVER w) AS correlation_id,
       md5('m' || coalesce(lag(event_id) OVER w, event_id)) AS causation_id FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY global_position)""")
def causation_chain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("global_position")
    log = user_log(spark, d, versions=False).select("event_id", F.first("event_id").over(w).alias("root"), F.lag("event_id").over(w).alias("cause"))
    return log.select("event_id", ids.stamped(_message(), _message("root"), _message("cause")).alias("m")).select("event_id", "m.*")


@query(f"""WITH named AS (SELECT stream_id, version, md5('m' || event_id) || ':' || stream_id || ':' || version AS name FROM l), {ID_SQL}
SELECT stream_id, version, {_uuid_sql('low', 'high')} AS new_id FROM k""")
def deterministic_event_id(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    return log.select("stream_id", "version", ids.deterministic_event_id(_message(), F.col("stream_id"), F.col("version").cast("int")).alias("new_id"))


@query("""SELECT event_id, '{"message_id":"' || md5('m' || event_id) || '","correlation_id":"' || md5('m' || event_id) || '"' || CASE WHEN user_id % 3 = 0 THEN '' ELSE ',"user":"u' || user_id || '"' END || ',"tenant_id":"' || tenant_id || '"}' AS metadata,
       md5('m' || event_id) AS message_id, CASE WHEN user_id % 3 <> 0 THEN 'u' || user_id END AS user, tenant_id FROM l""")
def metadata_codec(spark: SparkSession, d: str) -> DataFrame:
    user = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    none = F.lit(None).cast("string")
    m = F.struct(_message().alias("message_id"), _message().alias("correlation_id"), none.alias("causation_id"), user.alias("user"), F.col("tenant_id"), none.alias("trace_parent"))
    coded = user_log(spark, d, versions=False).select("event_id", ids.metadata_json(m).alias("metadata"))
    back = coded.withColumn("m", ids.metadata_of(F.col("metadata")))
    return back.select("event_id", "metadata", "m.message_id", "m.user", "m.tenant_id")


@query("""SELECT global_position, json_valid(CASE WHEN global_position % 7 = 0 THEN payload[:-2] WHEN global_position % 7 = 1 THEN '' ELSE payload END) AS valid FROM l""")
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    p, at = F.col("payload"), F.col("global_position") % 7
    text = F.when(at == 0, F.left(p, F.length(p) - 1)).when(at == 1, "").otherwise(p)
    return user_log(spark, d, versions=False).select("global_position", ids.valid_json(text).alias("valid"))


@query("""SELECT n_regionkey AS store, n_nationkey AS version, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place
FROM nation WHERE n_nationkey % 4 <> 1""", log=False)
def migrations(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "nation").select(F.col("n_regionkey").alias("store"), F.col("n_nationkey").alias("version"), F.col("n_name").alias("name"))
    return pending_migrations(steps, steps.filter("version % 4 = 1")).select("store", "version", "name", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- keyed state


@query(f"""WITH r AS (SELECT tenant_id, {K_SQL} AS k, created_at AS moment, row_number() OVER (PARTITION BY tenant_id, {K_SQL} ORDER BY global_position) AS n FROM l),
s AS (
  SELECT tenant_id, k, n, moment + INTERVAL 1 DAY AS expires_at, 'new' AS outcome FROM r WHERE n = 1
  UNION ALL
  SELECT r.tenant_id, r.k, r.n, CASE WHEN s.expires_at <= r.moment THEN r.moment + INTERVAL 1 DAY ELSE s.expires_at END,
         CASE WHEN s.expires_at <= r.moment THEN 'expired' ELSE 'active' END
  FROM s JOIN r ON r.tenant_id = s.tenant_id AND r.k = s.k AND r.n = s.n + 1
)
SELECT tenant_id, k, outcome, count(*) AS requests FROM s GROUP BY tenant_id, k, outcome""")
def idempotency_register(spark: SparkSession, d: str) -> DataFrame:
    asked = user_log(spark, d, versions=False).select("tenant_id", _k().alias("k"), "global_position", F.col("created_at").alias("at"))
    done = replay.replay(asked, ["tenant_id", "k"], ["global_position"], replay.register(timedelta(days=1)), replay.IDEMPOTENCY_OUT)
    return done.groupBy("tenant_id", "k", "outcome").agg(F.count("*").alias("requests"))


@query(f"""WITH r AS (SELECT tenant_id, {K_SQL} AS k, created_at AS moment, 'r' || event_id AS value, row_number() OVER (PARTITION BY tenant_id, {K_SQL} ORDER BY global_position) AS n,
  CASE WHEN event_type IN ('view', 'click') THEN 'register' WHEN event_type = 'purchase' THEN 'save' ELSE 'get' END AS op, global_position FROM l),
s AS (
  SELECT tenant_id, k, n, global_position, op, op = 'register' AS done, CASE WHEN op = 'register' THEN moment + INTERVAL 1 DAY END AS expires_at, CAST(NULL AS VARCHAR) AS result FROM r WHERE n = 1
  UNION ALL
  SELECT r.tenant_id, r.k, r.n, r.global_position, r.op,
         CASE r.op WHEN 'register' THEN s.expires_at IS NULL OR s.expires_at <= r.moment WHEN 'save' THEN s.expires_at IS NOT NULL ELSE false END,
         CASE WHEN r.op = 'register' AND (s.expires_at IS NULL OR s.expires_at <= r.moment) THEN r.moment + INTERVAL 1 DAY ELSE s.expires_at END,
         CASE WHEN r.op = 'register' AND (s.expires_at IS NULL OR s.expires_at <= r.moment) THEN NULL WHEN r.op = 'save' AND s.expires_at IS NOT NULL THEN r.value ELSE s.result END
  FROM s JOIN r ON r.tenant_id = s.tenant_id AND r.k = s.k AND r.n = s.n + 1
) SELECT tenant_id, k, global_position, op, done, result FROM s""")
def idempotency_result(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "register").when(kind == "purchase", "save").otherwise("get")
    asked = user_log(spark, d, versions=False).select("tenant_id", _k().alias("k"), "global_position", op.alias("op"), F.concat(F.lit("r"), "event_id").alias("value"), F.col("created_at").alias("at"))
    done = replay.replay(asked, ["tenant_id", "k"], ["global_position"], replay.results(timedelta(days=1)), replay.RESULTS_OUT)
    return done.select("tenant_id", "k", "global_position", "op", "done", "result")


@query(f"""WITH r AS (SELECT {K_SQL} AS k, 'o' || (user_id % 3) AS owner, created_at AS moment, row_number() OVER (PARTITION BY {K_SQL} ORDER BY global_position) AS n,
  CASE WHEN event_type IN ('view', 'click') THEN 'acquire' WHEN event_type = 'purchase' THEN 'release' ELSE 'renew' END AS op, global_position FROM l),
s AS (
  SELECT k, n, global_position, op, owner, op = 'acquire' AS done, CASE WHEN op = 'acquire' THEN owner END AS holder, CASE WHEN op = 'acquire' THEN moment + INTERVAL 6 HOUR END AS until FROM r WHERE n = 1
  UNION ALL
  SELECT r.k, r.n, r.global_position, r.op, r.owner, x.done,
         CASE WHEN x.done THEN CASE WHEN r.op <> 'release' THEN r.owner END WHEN x.held THEN s.holder END,
         CASE WHEN x.done THEN CASE WHEN r.op <> 'release' THEN r.moment + INTERVAL 6 HOUR END WHEN x.held THEN s.until END
  FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1,
  LATERAL (SELECT coalesce(s.until > r.moment, false) AS held, CASE WHEN r.op = 'acquire' THEN NOT coalesce(s.until > r.moment, false) ELSE coalesce(s.until > r.moment AND s.holder = r.owner, false) END AS done) x
) SELECT k, global_position, op, owner, done, holder FROM s""")
def lease_schedule(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "acquire").when(kind == "purchase", "release").otherwise("renew")
    owner = F.concat(F.lit("o"), (F.col("user_id") % 3).cast("string"))
    asked = user_log(spark, d, versions=False).select(_k().alias("k"), "global_position", op.alias("op"), owner.alias("owner"), F.col("created_at").alias("at"))
    done = replay.replay(asked, ["k"], ["global_position"], leases.lease_step(timedelta(hours=6)), leases.LEASE_OUT)
    return done.select("k", "global_position", "op", "owner", "done", "holder")


@query(f"""WITH r AS (
  SELECT {K_SQL} AS k, 'u' || (user_id % 3) AS owner, created_at AS moment, row_number() OVER (PARTITION BY {K_SQL} ORDER BY global_position) AS n,
         CASE WHEN event_type IN ('view', 'click') THEN 'reserve' WHEN event_type = 'error' THEN 'release' WHEN event_type = 'purchase' AND value > 90 THEN 'confirm' ELSE 'look' END AS op
  FROM l),
s AS (
  SELECT k, n, CASE WHEN op = 'reserve' THEN owner END AS held, CASE WHEN op = 'reserve' THEN moment + INTERVAL 6 HOUR END AS expires_at,
         CASE WHEN op = 'reserve' THEN false END AS confirmed, CASE WHEN op = 'reserve' THEN 1 ELSE 0 END AS done FROM r WHERE n = 1
  UNION ALL
  SELECT r.k, r.n,
         CASE WHEN r.op = 'reserve' AND (s.held IS NULL OR (NOT s.confirmed AND s.expires_at <= r.moment)) THEN r.owner
              WHEN r.op = 'release' AND s.held = r.owner AND NOT s.confirmed THEN NULL ELSE s.held END,
         CASE WHEN r.op = 'reserve' AND (s.held IS NULL OR (NOT s.confirmed AND s.expires_at <= r.moment)) THEN r.moment + INTERVAL 6 HOUR ELSE s.expires_at END,
         CASE WHEN r.op = 'reserve' AND (s.held IS NULL OR (NOT s.confirmed AND s.expires_at <= r.moment)) THEN false
              WHEN r.op = 'release' AND s.held = r.owner AND NOT s.confirmed THEN NULL
              WHEN r.op = 'confirm' AND s.held = r.owner AND NOT s.confirmed THEN true ELSE s.confirmed END,
         CASE WHEN r.op = 'reserve' AND (s.held IS NULL OR (NOT s.confirmed AND s.expires_at <= r.moment)) THEN 1
              WHEN r.op IN ('release', 'confirm') AND s.held = r.owner AND NOT s.confirmed THEN 1 ELSE 0 END
  FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1
)
SELECT k, arg_max(coalesce(held, ''), n) AS held_by, coalesce(arg_max(coalesce(confirmed, false), n), false) AS confirmed, CAST(sum(done) AS BIGINT) AS effective FROM s GROUP BY k""")
def reservation_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "reserve").when(kind == "error", "release").when((kind == "purchase") & (F.col("value") > 90), "confirm").otherwise("look")
    owner = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    asked = user_log(spark, d, versions=False).select(_k().alias("k"), "global_position", op.alias("op"), owner.alias("owner"), F.col("created_at").alias("at"), F.lit(6 * 3600).alias("ttl"))
    done = replay.replay(asked, ["k"], ["global_position"], _reservation_or_look, replay.RESERVATION_OUT)
    last = F.max_by(F.struct(F.coalesce("held_by", F.lit("")).alias("held_by"), F.coalesce("confirmed", F.lit(False)).alias("confirmed")), "global_position").alias("s")
    return done.groupBy("k").agg(last, F.sum(F.col("done").cast("long")).alias("effective")).select("k", "s.*", "effective")


def _reservation_or_look(state, r):
    if r["op"] == "look":
        held = state or {"owner": None, "confirmed": None}
        return state, {"done": False, "held_by": held["owner"], "confirmed": held["confirmed"]}
    return replay.reservation(state, r)


def _saves(spark: SparkSession, d: str) -> DataFrame:
    e = user_log(spark, d, versions=False)
    owner = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("o"), (F.col("user_id") % 2).cast("string")))
    tenant = F.when(F.col("user_id") % 7 < 3, "").when(F.col("user_id") % 7 > 4, "t")
    position = (F.floor(F.col("global_position") / F.lit(200)) * 10 + F.col("user_id") % 3).cast("long")
    return e.select(F.concat(F.lit("p"), _k().cast("string")).alias("projection"), tenant.alias("tenant_id"), F.col("global_position").alias("seq"), owner.alias("owner"), position.alias("position"))


APPLIES = "(r.owner = s.so OR s.so IS NULL OR s.sp < r.position) AND s.sp <= r.position"
SAVES_SQL = f"""r AS (SELECT 'p' || {K_SQL} AS projection, CASE WHEN user_id % 7 < 3 THEN '' WHEN user_id % 7 > 4 THEN 't' END AS tenant_id, CASE WHEN user_id % 7 > 4 THEN 't' ELSE '' END AS tk, global_position AS seq,
  CASE WHEN user_id % 5 <> 0 THEN 'o' || (user_id % 2) END AS owner, (global_position // 200) * 10 + user_id % 3 AS position,
  row_number() OVER (PARTITION BY {K_SQL}, user_id % 7 > 4 ORDER BY global_position) AS n FROM l),
s AS (
  SELECT projection, tenant_id, tk, n, seq, owner, position, 'applied' AS outcome, position AS sp, owner AS so FROM r WHERE n = 1
  UNION ALL
  SELECT r.projection, r.tenant_id, r.tk, r.n, r.seq, r.owner, r.position,
         CASE WHEN {APPLIES} THEN 'applied' WHEN s.so IS NULL OR r.owner IS NOT DISTINCT FROM s.so THEN 'backward' ELSE 'fenced' END,
         CASE WHEN {APPLIES} THEN r.position ELSE s.sp END,
         CASE WHEN {APPLIES} THEN r.owner ELSE s.so END
  FROM s JOIN r ON r.projection = s.projection AND r.tk = s.tk AND r.n = s.n + 1
)"""


@query(f"WITH {SAVES_SQL} SELECT projection, tenant_id, seq, owner, position, outcome, sp AS stored_position, so AS stored_owner FROM s")
def checkpoint_cas(spark: SparkSession, d: str) -> DataFrame:
    return replay.checkpoint_saves(_saves(spark, d), width=300)


@query(f"WITH {SAVES_SQL} SELECT projection, tk AS tenant_id, arg_max(sp, n) AS position, arg_max({{'so': so}}, n).so AS owner FROM s GROUP BY projection, tk UNION ALL SELECT 'never', '', 0, NULL")
def checkpoint_load(spark: SparkSession, d: str) -> DataFrame:
    stored = replay.stored_checkpoints(replay.checkpoint_saves(_saves(spark, d)))
    names = stored.select("projection", "tenant_id").unionByName(spark.createDataFrame([("never", "")], "projection string, tenant_id string"))
    return replay.load_checkpoints(names, stored)


@query(f"""WITH {SAVES_SQL}, f AS (SELECT projection, tk, owner, min(seq) AS halted_at FROM s WHERE outcome = 'fenced' GROUP BY projection, tk, owner)
SELECT f.projection, f.tk AS tenant_id, f.owner, f.halted_at, CAST(sum(CASE WHEN s.seq > f.halted_at THEN 1 ELSE 0 END) AS BIGINT) AS saves_dropped
FROM f JOIN s ON s.projection = f.projection AND s.tk = f.tk AND s.owner IS NOT DISTINCT FROM f.owner GROUP BY ALL""")
def fence_drop(spark: SparkSession, d: str) -> DataFrame:
    saves = replay.checkpoint_saves(_saves(spark, d)).withColumn("tenant_id", tenant_key(F.col("tenant_id")))
    return replay.dropped(saves)


# ---------------------------------------------------------------- outbox and housekeeping

NOW = datetime(2024, 3, 1)


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    rows = outbox.from_events(user_log(spark, d, versions=False).filter("event_type = 'purchase'"), _message())
    return rows.withColumn("published_at", F.when(F.col("id") % 3 != 0, F.col("created_at") + F.expr("INTERVAL 1 HOUR")))


O_SQL = """ob AS (SELECT global_position AS id, md5('m' || event_id) AS message_id, event_type, payload, tenant_id, created_at,
  CASE WHEN global_position % 3 <> 0 THEN created_at + INTERVAL 1 HOUR END AS published_at FROM l WHERE event_type = 'purchase')"""


@query(f"WITH {O_SQL} SELECT id, message_id, event_type, payload, tenant_id, created_at FROM ob")
def outbox_from_log(spark: SparkSession, d: str) -> DataFrame:
    return _outbox(spark, d).drop("published_at")


@query(f"WITH {O_SQL} SELECT id, message_id, tenant_id FROM ob WHERE published_at IS NULL ORDER BY id LIMIT 100")
def outbox_pending(spark: SparkSession, d: str) -> DataFrame:
    return outbox.pending(_outbox(spark, d), 100).select("id", "message_id", "tenant_id")


@query("""WITH m AS (SELECT md5('m' || (CAST(event_id AS BIGINT) // 2)) AS message_id FROM l WHERE event_type = 'purchase')
SELECT message_id, count(*) AS rows FROM m GROUP BY message_id HAVING count(*) > 1""")
def outbox_conflicts(spark: SparkSession, d: str) -> DataFrame:
    purchases = user_log(spark, d, versions=False).filter("event_type = 'purchase'").withColumn("shared", F.expr("string(cast(event_id as bigint) div 2)"))
    return outbox.conflicts(outbox.from_events(purchases, _message("shared")))


@query(f"""WITH {O_SQL}, n AS (SELECT max(ts) AS now FROM events)
SELECT 'outbox' AS kind, count(*) AS purged FROM ob, n WHERE published_at < now - INTERVAL 7 DAY
UNION ALL SELECT 'idempotency', count(*) FROM l, n WHERE created_at + INTERVAL 1 DAY < now
UNION ALL SELECT 'reservations', count(*) FROM l, n WHERE event_type = 'view' AND global_position % 4 <> 0 AND created_at + INTERVAL 6 HOUR < now - INTERVAL 1 HOUR
UNION ALL SELECT 'dead_letters', count(*) FROM l, n WHERE event_type = 'error' AND created_at < now - INTERVAL 30 DAY""")
def housekeeping_report(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d, versions=False)
    now = F.lit(log.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    tables = {
        "outbox": _outbox(spark, d),
        "idempotency": log.select("tenant_id", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("expires_at")),
        "reservations": log.filter("event_type = 'view'").select((F.col("created_at") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"), (F.col("global_position") % 4 == 0).alias("confirmed")),
        "dead_letters": log.filter("event_type = 'error'").select(F.col("created_at").alias("first_failed_at")),
    }
    return outbox.sweep(tables, now, HousekeepingOptions())[1]


# ---------------------------------------------------------------- streaming


@query("SELECT event_type, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY event_type", log=False)
def streaming_type_counts(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    held = spark.conf.get("spark.checkpoint.dir", None)
    if held is None:
        import tempfile

        held = tempfile.mkdtemp(prefix="ledgerframe-stream-")
    name = f"counts_{uuid.uuid4().hex}"
    stream = live.tail(spark, d, table(spark, d, "events").schema, "events.parquet")
    live.counts_by_type(stream, f"{held}/{name}", name).awaitTermination()
    return spark.table(name)
