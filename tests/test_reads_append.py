import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import append, reads
from ledgerframe.schema import ANY, EMPTY_STREAM, NO_STREAM, STREAM_EXISTS
from ledgerframe.sources.event_log import CommitConflict, EventLog, Transaction

LOG = "stream_id string, version long, global_position long, event_id string, event_type string, created_at timestamp_ntz, tenant_id string, category string"


@pytest.fixture(scope="module")
def log(spark):
    from datetime import datetime

    rows = [("a", 0, 1, "e1", "x"), ("b", 0, 2, "e2", "y"), ("a", 1, 4, "e3", "x"), ("a", 2, 7, "e4", "z"), ("b", 1, 9, "e5", "x")]
    return spark.createDataFrame([(*r, datetime(2024, 1, 1, 0, 0, r[2]), None, "c") for r in rows], LOG)


def positions(df):
    return [r["global_position"] for r in df.collect()]


def test_stream_bounds_are_inclusive(log):
    assert positions(reads.read_stream(log, "a", 1, 2)) == [4, 7]
    assert positions(reads.read_stream(log, "a", forwards=False)) == [7, 4, 1]
    assert positions(reads.read_stream(log, "nobody")) == []


def test_all_read_excludes_its_start_and_includes_its_end(log):
    assert positions(reads.read_all(log, 2, 7)) == [4, 7]
    assert positions(reads.read_all(log, max_count=2, forwards=False)) == [9, 7]


def test_catchup_limits_after_the_filter(log):
    assert positions(reads.catchup_batch(log, 1, 2, {"x"})) == [4, 9]
    assert positions(reads.catchup_batch(log, 0, 5, set())) == []
    with pytest.raises(ValueError):
        reads.catchup_batch(log, 0, 0)


def test_visibility_cut_is_strict(log):
    from datetime import datetime

    at = F.lit(datetime(2024, 1, 1, 0, 0, 7)).cast("timestamp_ntz")
    assert positions(reads.catchup_batch(log, 0, 9, visible_before=at)) == [1, 2, 4]


def test_heads_of_unknown_streams(spark, log):
    asked = spark.createDataFrame([("a",), ("nobody",)], "stream_id string")
    got = {r["stream_id"]: (r["current_version"], r["head_position"]) for r in reads.heads_of(asked, log).collect()}
    assert got == {"a": (2, 7), "nobody": (-1, 0)}


@pytest.mark.parametrize(
    ("expected", "missing", "at0", "at2"),
    [(ANY, True, True, True), (NO_STREAM, True, False, False), (EMPTY_STREAM, True, False, False), (STREAM_EXISTS, False, True, True), (2, False, False, True), (1, False, False, False)],
)
def test_guard_matrix(spark, expected, missing, at0, at2):
    row = spark.range(1).select(*[append.guard(F.lit(expected), F.lit(v)).alias(f"v{k}") for k, v in enumerate((-1, 0, 2))]).first()
    assert tuple(row) == (missing, at0, at2)


REQUEST = "batch_id string, stream_id string, expected_version long, seq int, event_id string, event_type string, schema_version int, payload string, tenant_id string"


def request(spark, *batches):
    rows = []
    for batch, stream, expected, events in batches:
        rows += [(batch, stream, expected, k, e, "t", 1, "{}", None) for k, e in enumerate(events)] or [(batch, stream, expected, 0, None, None, None, None, None)]
    return spark.createDataFrame(rows, REQUEST)


def outcomes(df):
    return {r["batch_id"]: (r["outcome"], r["next_expected_version"], r["last_global_position"]) for r in df.collect()}


@pytest.fixture
def stored(spark, tmp_path):
    found = EventLog(spark, str(tmp_path / "log"))
    found.init()
    found.init()
    return found


def now():
    return F.lit("2024-01-01 00:00:00")


def test_append_decides_in_order(spark, stored):
    assert outcomes(stored.append(request(spark, ("1", "s", NO_STREAM, ["a", "b"])), now())) == {"1": ("appended", 1, 2)}
    # a replay is a duplicate before its guard is looked at, even if only one event overlaps
    assert outcomes(stored.append(request(spark, ("2", "s", NO_STREAM, ["b", "c"])), now())) == {"2": ("duplicate", 1, 2)}
    assert outcomes(stored.append(request(spark, ("3", "s", NO_STREAM, ["c"])), now())) == {"3": ("conflict", None, None)}
    assert outcomes(stored.append(request(spark, ("4", "s", 5, [])), now())) == {"4": ("noop", 1, 2)}
    # neither consumed a position
    assert outcomes(stored.append(request(spark, ("5", "s", 1, ["c"])), now())) == {"5": ("appended", 2, 3)}
    got = [(r["version"], r["global_position"], r["event_id"]) for r in stored.read().orderBy("global_position").collect()]
    assert got == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")]
    assert stored.read(1).count() == 2


def test_batches_of_one_stream_follow_one_another(spark, stored):
    got = outcomes(stored.append(request(spark, ("1", "s", NO_STREAM, ["a"]), ("2", "s", STREAM_EXISTS, ["b", "b2"]), ("3", "s", NO_STREAM, ["c"])), now()))
    assert got["1"][0] == "appended" and got["2"] == ("appended", 2, 3) and got["3"][0] == "conflict"


def test_events_repeated_inside_a_new_batch_are_stored(spark, stored):
    assert outcomes(stored.append(request(spark, ("1", "s", ANY, ["a", "a"])), now()))["1"][:2] == ("appended", 1)


def test_transaction_commits_once_or_not_at_all(spark, stored):
    asked = spark.createDataFrame([("s",)], "stream_id string")
    with Transaction(stored) as t:
        t.append(request(spark, ("1", "s", NO_STREAM, ["a", "b"])))
        assert t.heads(asked).first()["current_version"] == 1
    assert stored.read().count() == 0
    with pytest.raises(RuntimeError):
        t.commit(now())
    with Transaction(stored) as t:
        t.append(request(spark, ("1", "s", NO_STREAM, ["a"]), ("2", "r", NO_STREAM, ["a"])))
        t.commit(now())
    assert stored.read().count() == 2
    with Transaction(stored) as t, pytest.raises(CommitConflict):
        t.append(request(spark, ("3", "s", NO_STREAM, ["z"])))
        t.commit(now())


def test_transaction_takes_several_appends_of_a_stream(spark, stored):
    asked = spark.createDataFrame([("s",)], "stream_id string")
    with Transaction(stored) as t:
        t.append(request(spark, ("z", "s", NO_STREAM, ["a", "b"])))
        t.append(request(spark, ("a", "s", 1, ["c"])))
        assert t.heads(asked).first()["current_version"] == 2
        assert outcomes(t.commit(now())) == {"z": ("appended", 1, 2), "a": ("appended", 2, 3)}
    assert len(stored.commits()) == 1
    with Transaction(stored) as t, pytest.raises(CommitConflict):  # the second does not hold, so the first is not written
        t.append(request(spark, ("1", "s", 2, ["d"])))
        t.append(request(spark, ("2", "s", 2, ["e"])))
        t.commit(now())
    assert stored.read().count() == 3 and len(stored.commits()) == 1


def test_outbox_rows_and_events_are_one_commit(spark, stored):
    from ledgerframe.operators.outbox import Collector

    c = Collector()
    c.collect({"message_id": "m1", "event_type": "t", "payload": "{}"})
    with Transaction(stored) as t, pytest.raises(CommitConflict):
        t.append(request(spark, ("1", "s", 7, ["a"])))
        t.flush(c)
        t.commit(now())
    assert stored.outbox().count() == 0 and stored.commits() == []
    for k in (1, 2):  # the same message a second time is refused
        c.collect({"message_id": "m1", "event_type": "t", "payload": "{}"})
        with Transaction(stored) as t:
            t.append(request(spark, (str(k), "s", ANY, [f"e{k}"])))
            t.flush(c)
            if k == 1:
                t.commit(now())
            else:
                with pytest.raises(CommitConflict):
                    t.commit(now())
    assert [(r["id"], r["tenant_id"], r["published_at"]) for r in stored.outbox().collect()] == [(1, "", None)]
    stored.mark_published(stored.outbox(), now())
    assert stored.outbox().first()["published_at"] is not None and stored.read().count() == 1
    with Transaction(stored) as t, pytest.raises(TypeError):
        t.flush("no collector")


def test_a_writer_that_dies_leaves_no_commit(spark, stored, tmp_path):
    stored.append(request(spark, ("1", "s", NO_STREAM, ["a"])), now())
    (tmp_path / "log" / "commits" / ".half.draft").write_text('{"n": 2')
    assert stored.read().count() == 1
    assert not stored.files.create("commits/000000000001.json", {"n": 1})  # never overwritten
    assert stored.commits()[0]["events"] == 1
    stored.append(request(spark, ("2", "s", ANY, ["b"])), now())
    assert stored.read().count() == 2


def test_commit_lists_shorten_opening(spark, stored):
    for n in range(1, 4):
        stored.files.create(f"commits/{n:012d}.json", {"n": n, "data": None, "outbox": None, "events": 0, "last_position": 0, "last_outbox": 0})
    stored.files.create("commits/upto-000000000002.json", {"commits": stored.commits()[:2]})
    stored.files.delete("commits/000000000001.json")  # what a list holds is not read again
    assert [c["n"] for c in stored.commits()] == [1, 2, 3]


def test_repository(spark, stored):
    from ledgerframe.operators.aggregates import Repository

    books = Repository(stored, lambda: 0, lambda state, kind, payload: state + (kind == "up"))
    assert books.load("c-1") is None
    a, read = books.fetch_for_writing("c-1")
    assert read == -1
    for kind in ("up", "up", "odd"):
        a.raise_event(kind, "{}")
    assert books.save(a, read, "m1", now())["outcome"] == "appended" and a.uncommitted == []
    b, read = books.fetch_for_writing("c-1")
    assert (b.state, b.version, read) == (2, 2, 2)
    for kind in ("up", "up", "odd"):
        a.raise_event(kind, "{}")
    assert books.save(a, 2, "m1", now())["deduplicated"] and a.uncommitted == []  # the answer was lost, the ids are the same
    b.raise_event("up", "{}")
    with pytest.raises(CommitConflict):
        books.save(b, 1, "m2", now())
    assert books.save(b, 2, "m2", now())["next_expected_version"] == 3
    assert books.save(b, 3, "m3", now())["outcome"] == "noop"
    warm = Repository(stored, lambda: 0, books.step, snapshots={"c-1": (2, 1, 100), "c-2": (5, 9, 1)})
    assert warm.load("c-1").state == 101 and warm.load("c-2") is None
    with pytest.raises(RuntimeError):
        b.restore(0, 5)


def test_random_appends_follow_a_plain_model(spark, stored):
    r = random.Random(3)
    model, position = {}, 0
    for n in range(6):
        batches, want = [], {}
        for s in r.sample(["s0", "s1", "s2"], 2):
            events = [r.choice("abcdef") + str(r.randint(0, 2)) for _ in range(r.randint(0, 3))]
            batches.append((f"{n}{s}", s, r.choice([-2, -1, 0, -3, 1, 5]), events))
        for b, s, expected, events in sorted(batches):
            held = model.setdefault(s, [])
            last = len(held) - 1
            ok = {-2: True, -1: last < 0, 0: last < 0, -3: last >= 0}.get(expected, last == expected)
            if not events:
                want[b] = "noop"
            elif set(events) & set(held):
                want[b] = "duplicate"
            elif ok:
                want[b] = "appended"
                held += events
                position += len(events)
            else:
                want[b] = "conflict"
        assert {k: v[0] for k, v in outcomes(stored.append(request(spark, *batches), now())).items()} == want
    got = {}
    for row in stored.read().orderBy("stream_id", "version").collect():
        got.setdefault(row["stream_id"], []).append(row["event_id"])
    assert got == {s: e for s, e in model.items() if e}
    assert sorted(x["global_position"] for x in stored.read().collect()) == list(range(1, position + 1))
