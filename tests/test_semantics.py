import uuid
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerframe.functions import ids
from ledgerframe.functions.registry import EventTypes, UnknownEventType
from ledgerframe.operators import folds, outbox, projections, replay, upcast
from ledgerframe.schema import HousekeepingOptions, ProjectionOptions, require_schema_name, require_user, validated
from ledgerframe.spec import Spec, SpecFailure
from ledgerframe.streaming import live


def test_fold_ignores_unknown_events_and_advances_the_version(spark):
    log = spark.createDataFrame([("s", 0, "OrderPlaced", None), ("s", 1, "Mystery", None), ("s", 2, "OrderLineAdded", 2.0), ("s", 3, "OrderCancelled", None), ("s", 4, "OrderLineAdded", 9.0)], "stream_id string, version long, event_type string, quantity double")
    row = folds.order_states(log).first()
    assert (row["version"], row["placed"], row["cancelled"], row["lines"], row["quantity"]) == (4, True, True, 1, 2.0)


def test_snapshots_only_move_forward_and_match_their_schema(spark):
    schema = "stream_id string, version long, schema_version int, state long"
    stored = spark.createDataFrame([("s", 5, 1, 50)], schema)
    offered = spark.createDataFrame([("s", 5, 1, 99), ("s", 4, 1, 4), ("t", 1, 2, 7)], schema)
    got = {r["stream_id"]: (r["version"], r["state"]) for r in folds.save_snapshots(stored, offered).collect()}
    assert got == {"s": (5, 50), "t": (1, 7)}
    assert folds.usable(offered, 1).count() == 2


def moments(*seconds):
    return [datetime(2024, 1, 1) + timedelta(seconds=s) for s in seconds]


def test_idempotency_expires_at_its_expiry(spark):
    rows = [("k", n, t) for n, t in enumerate(moments(0, 5, 9, 10, 12))] + [("z", 9, moments(1)[0])]
    asked = spark.createDataFrame(rows, "k string, n int, at timestamp_ntz")
    done = replay.replay(asked, ["k"], ["n"], replay.register(timedelta(seconds=10)), replay.IDEMPOTENCY_OUT)
    assert [r["outcome"] for r in done.filter("k = 'k'").orderBy("n").collect()] == ["new", "active", "active", "expired", "active"]


def test_reservation_takeover_confirm_and_release(spark):
    ops = [("reserve", "a", 0), ("reserve", "b", 5), ("confirm", "b", 6), ("reserve", "b", 10), ("release", "a", 11), ("confirm", "b", 12), ("release", "b", 13), ("reserve", "a", 99)]
    rows = [(1, n, op, o, moments(t)[0], 10) for n, (op, o, t) in enumerate(ops)]
    asked = spark.createDataFrame(rows, "k int, n int, op string, owner string, at timestamp_ntz, ttl int")
    done = replay.replay(asked, ["k"], ["n"], replay.reservation, replay.RESERVATION_OUT).orderBy("n").collect()
    assert [r["done"] for r in done] == [True, False, False, True, False, True, False, False]
    assert (done[-1]["held_by"], done[-1]["confirmed"]) == ("b", True)


def test_checkpoint_fencing(spark):
    rows = [("p", 1, "a", 5), ("p", 2, "b", 5), ("p", 3, "a", 5), ("p", 4, "a", 4), ("p", 5, "b", 4), ("p", 6, "b", 6), ("p", 7, "a", 6)]
    saves = spark.createDataFrame(rows, "projection string, seq long, owner string, position long")
    assert [r["outcome"] for r in replay.checkpoint_saves(saves).orderBy("seq").collect()] == ["applied", "fenced", "applied", "backward", "fenced", "applied", "fenced"]
    assert [r["outcome"] for r in replay.checkpoint_saves(saves, fencing=False).orderBy("seq").collect()] == ["applied"] * 3 + ["backward"] * 2 + ["applied"] * 2
    for width in (2, 3):  # ranges change nothing
        assert replay.checkpoint_saves(saves, width=width).orderBy("seq").collect() == replay.checkpoint_saves(saves).orderBy("seq").collect()
    unowned = spark.createDataFrame([("p", 1, None, 5), ("p", 2, None, 5), ("p", 3, "a", 4), ("p", 4, "a", 5), ("p", 5, None, 5), ("p", 6, "b", 5)], "projection string, seq long, owner string, position long")
    assert [(r["outcome"], r["stored_owner"]) for r in replay.checkpoint_saves(unowned, width=2).orderBy("seq").collect()] == [("applied", None), ("applied", None), ("backward", None), ("applied", "a"), ("fenced", "a"), ("fenced", "a")]
    last = replay.stored_checkpoints(replay.checkpoint_saves(saves)).first()
    assert (last["position"], last["owner"]) == (6, "b")


def test_saved_results_need_their_key(spark):
    at = moments(0)[0]
    entries = spark.createDataFrame([("", "a", None, at)], "tenant_id string, idempotency_key string, result binary, expires_at timestamp_ntz")
    results = spark.createDataFrame([("", "a", b"1"), ("", "b", b"2")], "tenant_id string, idempotency_key string, result binary")
    assert [(r["idempotency_key"], bytes(r["result"])) for r in replay.save_results(entries, results).collect()] == [("a", b"1")]


def one(name):
    return lambda p: F.concat(p, F.lit(name))


def test_upcasters_are_checked_and_fan_out(spark):
    with pytest.raises(ValueError):
        upcast.Upcasters([upcast.Upcaster("a", 1, ()), upcast.Upcaster("a", 1, ())])
    with pytest.raises(upcast.UpcasterCycle):
        upcast.Upcasters([upcast.Upcaster("a", 1, (("b", 1, one("x")),)), upcast.Upcaster("b", 1, (("a", 1, one("y")),))])
    chain = upcast.Upcasters([upcast.Upcaster("h", 1, (("f0", 1, one("0")), ("f1", 1, one("1")))), upcast.Upcaster("f0", 1, (("g", 2, one("g")),)), upcast.Upcaster("gone", 1, ())])
    log = spark.createDataFrame([(1, "h", 1, "p"), (2, "gone", 1, "p"), (3, "h", 2, "q"), (4, None, 1, "n")], "global_position long, event_type string, schema_version int, payload string")
    got = [(r["global_position"], r["ordinal"], r["event_type"], r["schema_version"], r["payload"]) for r in chain.apply(log).orderBy("global_position", "ordinal").collect()]
    assert got == [(1, 0, "g", 2, "p0g"), (1, 1, "f1", 1, "p1"), (3, 0, "h", 2, "q"), (4, 0, None, 1, "n")]


@given(st.integers(1, 6))
@settings(deadline=None, max_examples=6)
def test_linear_chain_depth(n):
    chain = upcast.Upcasters([upcast.Upcaster(f"T{k}", k + 1, ((f"T{k + 1}", k + 2, one("")),)) for k in range(n)])
    assert chain.depth == n


def test_gaps_across_ranges(spark):
    log = spark.createDataFrame([(p,) for p in (2, 3, 6, 9, 10, 21)], "global_position long")
    want = [(0, 1), (3, 5), (6, 8), (10, 20)]
    for width in (4, 1000):
        assert sorted((r["after"], r["upto"]) for r in projections.gaps(log, width).collect()) == want


@given(st.integers(0, 100), st.integers(0, 100), st.booleans(), st.one_of(st.none(), st.integers(0, 30)))
@settings(deadline=None, max_examples=15)
def test_gap_verdict(spark, checkpoint, mark, above, waited):
    got = spark.range(1).select(projections.gap_verdict(F.lit(checkpoint), F.lit(mark), F.lit(above), F.lit(waited).cast("int"), F.lit(10))).first()[0]
    assert got == ("no_gap" if checkpoint >= mark or above else "skip" if (waited or 0) >= 10 else "wait")


def test_housekeeping_keeps_what_retention_zero_covers(spark):
    at = moments(0)[0]
    tables = {"outbox": spark.createDataFrame([(at,), (None,)], "published_at timestamp_ntz"), "dead_letters": spark.createDataFrame([(at,)], "first_failed_at timestamp_ntz")}
    now = F.lit(at + timedelta(days=31)).cast("timestamp_ntz")
    kept, report = outbox.sweep(tables, now)
    assert {r["kind"]: r["purged"] for r in report.collect()} == {"outbox": 1, "dead_letters": 1}
    assert kept["outbox"].count() == 1
    off = outbox.sweep(tables, now, HousekeepingOptions(outbox_retention=timedelta(0), dead_letter_retention=timedelta(0)))[1]
    assert {r["purged"] for r in off.collect()} == {0}


def test_deterministic_ids_match_a_plain_model(spark):
    def fnv(data, h):
        for b in data:
            h = ((h ^ b) * 1099511628211) % (1 << 64)
        return h

    rows = [(uuid.UUID(int=k).hex, f"s-{k}é", k) for k in range(5)]
    df = spark.createDataFrame(rows, "m string, s string, i int").select("m", "s", "i", ids.deterministic_event_id("m", "s", "i").alias("id"))
    for r in df.collect():
        data = f"{r['m']}:{r['s']}:{r['i']}".encode()
        raw = fnv(data, 14695981039346656037).to_bytes(8, "little") + fnv(data, 1099511628211).to_bytes(8, "little")
        assert r["id"] == str(uuid.UUID(bytes_le=raw))


def test_correlation_scopes_nest():
    a, b = ids.Correlation("a", "a"), ids.Correlation("b", "b")
    with ids.correlated(a):
        with ids.correlated(b):
            assert ids.current() is b
        assert ids.current() is a
    assert ids.current() is None


def test_registry(spark):
    types = EventTypes()
    types.register("a", "k int")
    types.register("a", "k int")
    for wrong in (lambda: types.register("a", "k string"), lambda: types.register("b", "k int", 0), lambda: types.register("", "k int")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(UnknownEventType):
        types.version("A")
    log = spark.createDataFrame([("a", '{"k": 3}'), ("b", "{}")], "event_type string, payload string")
    assert types.decoded(log, "a").first()["data"]["k"] == 3
    with pytest.raises(Exception, match="unknown event type b"):
        types.require_known(log).collect()


def test_validators_report_everything():
    assert validated(ProjectionOptions()) == ProjectionOptions()
    with pytest.raises(ValueError, match="batch_size.*pending_threshold"):
        validated(ProjectionOptions(batch_size=0, pending_threshold=-1))
    for wrong in ("a@b", "x" * 129, None):
        with pytest.raises(ValueError) as e:
            require_user(wrong)
        assert "a@b" not in str(e.value)
    assert require_schema_name("_ok1") == "_ok1"
    for wrong in ("", "1a", "A", "a" * 64, "a-b"):
        with pytest.raises(ValueError):
            require_schema_name(wrong)


def test_spec():
    spec = lambda: Spec(lambda events: sum(events))
    spec().given(1, 2).when(lambda s: [s]).then(3)
    spec().given().when(lambda s: None).then_nothing()
    spec().when(lambda s: 1 / s).then_raises(ArithmeticError)
    for bad in (lambda: spec().when(lambda s: [1]).then(2), lambda: spec().when(lambda s: [1]).then(1, 2), lambda: spec().when(lambda s: [1]).then_raises(ValueError)):
        with pytest.raises(SpecFailure):
            bad()


def test_projection_drains_and_resumes(spark, tmp_path):
    schema = "global_position long, stream_id string, event_id string, event_type string, created_at timestamp"
    source, marks = str(tmp_path / "log"), str(tmp_path / "marks")
    seen = []

    def write(*rows):
        spark.createDataFrame([(p, "s", e, t, moments(p)[0]) for p, e, t in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = live.tail(spark, source, spark.read.parquet(source).schema)
        live.project(stream, ["x"], lambda df, n: seen.extend(r["global_position"] for r in df.orderBy("global_position").collect()), marks).awaitTermination()

    write((1, "a", "x"), (2, "b", "y"), (3, "c", "x"))
    drain()
    assert seen == [1, 3]
    write((4, "d", "x"))
    drain()
    assert seen == [1, 3, 4]


def test_streamed_dedup_and_registration(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "stream_id string, event_id string, created_at timestamp"
    rows = [("s", "a", moments(0)[0]), ("s", "a", moments(1)[0]), ("s", "b", moments(20)[0]), ("t", "a", moments(3)[0])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = live.tail(spark, source, spark.read.parquet(source).schema)
    q = live.first_deliveries(stream, "1 hour").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 3
    kept = live.registrations(live.withheld(stream, "1 hour"), "stream_id", "created_at", 10)
    q = kept.writeStream.format("memory").queryName("registered").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["key"], r["outcome"]) for r in spark.table("registered").orderBy("key", "at").collect()]
    assert got == [("s", "new"), ("s", "active"), ("s", "expired"), ("t", "new")]


def test_one_lease_per_projection_and_tenant(spark, tmp_path):
    from ledgerframe.operators.leases import Leases

    now = [0.0]
    leases = Leases(spark, str(tmp_path / "leases"), timedelta(seconds=10), lambda: now[0])
    first = leases.try_acquire("p")
    assert first.is_held() and leases.try_acquire("p", "") is None
    other = leases.try_acquire("p", "t/1")
    assert other is not None
    first.release()
    first.release()
    again = leases.try_acquire("p")
    assert again.is_held() and not first.is_held()
    first.release()
    assert again.is_held()
    now[0] = 9.0
    assert again.renew() and other.renew()
    now[0] = 18.0
    assert again.is_held() and leases.try_acquire("p") is None
    now[0] = 30.0  # its holder died
    after = leases.try_acquire("p")
    assert after.is_held() and not again.is_held() and not again.renew()


def test_housekeeper_is_single_and_survives_failures(spark, tmp_path):
    from ledgerframe.operators.leases import Leases

    leases, ran = Leases(spark, str(tmp_path / "leases")), []

    def sweep():
        ran.append(leases.try_acquire("housekeeping"))  # another one finds it taken
        if len(ran) == 1:
            raise RuntimeError("no disk")
        keeper.stopped = len(ran) == 3

    keeper = outbox.Housekeeper(leases, sweep, sleep=lambda s: None)
    keeper.run()
    assert ran == [None] * 3
    off = outbox.Housekeeper(leases, sweep, HousekeepingOptions(interval=timedelta(0)))
    off.run()
    assert len(ran) == 3


def test_collector_hands_over_in_order_and_is_empty_then(spark):
    c = outbox.Collector()
    assert c.drain(spark) is None
    c.collect({"message_id": "b", "event_type": "t", "payload": "{}"})
    c.collect(spark.createDataFrame([("c", "t", "{}", 2), ("a", "t", "{}", 1)], "message_id string, event_type string, payload string, seq int"))
    with pytest.raises(ValueError):
        c.collect({"message_id": "x"})
    assert [r["message_id"] for r in c.drain(spark).orderBy("seq").collect()] == ["b", "a", "c"]
    assert c.drain(spark) is None


def test_metadata_is_checked_when_it_is_read(spark):
    read = lambda text: spark.createDataFrame([(text,)], "m string").select(ids.metadata_of(F.col("m")).alias("m")).first()["m"]
    assert read('{"message_id": "a", "user": "u1", "extensions": {"k": "v"}}').extensions == {"k": "v"}
    for wrong in ("{", "null", '{"user": 7}', '{"user": "a@b"}', '{"user": {"value": "u"}}', None):
        with pytest.raises(Exception):  # noqa: B017
            read(wrong)


def test_restore_needs_a_fresh_aggregate(spark):
    snapshots = folds.captured(spark.createDataFrame([("s", 4, 9)], "stream_id string, version long, counter long"))
    fresh = spark.createDataFrame([("s", -1), ("t", -1)], "stream_id string, version long")
    assert {tuple(r) for r in folds.restored(fresh, snapshots, "counter long").collect()} == {("s", 4, 9), ("t", -1, None)}
    with pytest.raises(Exception, match="restored over version 2"):
        folds.restored(fresh.withColumn("version", F.lit(2).cast("long")), snapshots, "counter long").collect()


def test_migrations_run_once_in_order():
    from ledgerframe.schema import migrations_to_run

    steps = {3: "c", 1: "a", 2: "b"}
    assert migrations_to_run(steps, []) == [(1, "a"), (2, "b"), (3, "c")]
    assert migrations_to_run(steps, [1, 2]) == [(3, "c")]
    with pytest.raises(ValueError):
        migrations_to_run(steps, [4])
    with pytest.raises(ValueError):
        migrations_to_run({0: "x"}, [])


def test_diamonds_of_upcasters_are_walked_once_and_bounded():
    def layers(n):
        return [upcast.Upcaster(f"L{k}", 1, ((f"L{k + 1}", 1, one("a")), (f"L{k + 1}", 1, one("b")))) for k in range(n)]

    assert upcast.Upcasters(layers(4)).depth == 4
    with pytest.raises(upcast.UpcasterCycle, match="steps"):
        upcast.Upcasters(layers(60))


def test_a_fold_of_many_events_never_throws(spark):
    log = spark.range(100_000).select(F.lit("s").alias("stream_id"), F.col("id").alias("version"), F.when(F.col("id") % 3 == 0, "OrderLineAdded").otherwise("x").alias("event_type"), F.lit(1.0).alias("quantity"))
    assert folds.order_states(log).first()["version"] == 99_999


def test_relay_marks_what_it_published(spark):
    rows = [(k, f"m{k}", "t", "{}", "", moments(k)[0], moments(9)[0] if k == 1 else None) for k in range(4)]
    box = spark.createDataFrame(rows, "id long, message_id string, event_type string, payload string, tenant_id string, created_at timestamp_ntz, published_at timestamp_ntz")
    sent = []
    after = outbox.relay(box, 2, lambda b: sent.extend(r["id"] for r in b.collect()), F.lit(moments(20)[0]).cast("timestamp_ntz"))
    assert sent == [0, 2]
    assert [r["id"] for r in after.filter("published_at is null").collect()] == [3]


def test_counters_ride_along(spark):
    from ledgerframe.functions import observe

    df, seen = observe.counted(spark.createDataFrame([("a",), ("a",), ("b",)], "stream_id string"), "reads")
    df.collect()
    assert seen.get == {"events": 3, "streams_seen": 2}


def test_projections_share_one_read(spark, tmp_path):
    source = str(tmp_path / "log")
    spark.createDataFrame([(1, "x"), (2, "y")], "global_position long, event_type string").coalesce(1).write.parquet(source)
    got = {}
    stream = live.tail(spark, source, spark.read.parquet(source).schema)
    live.project_many(stream, {n: (t, lambda b, _, n=n: got.update({n: b.count()})) for n, t in (("all", None), ("xs", ["x"]))}, str(tmp_path / "c")).awaitTermination()
    assert got == {"all": 2, "xs": 1}
