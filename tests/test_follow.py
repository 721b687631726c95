"""The live follower with a clock of events: order, repeats, gaps, heartbeats, ends, restarts."""

from datetime import datetime, timedelta

import pytest

from provark.streaming import events as ev
from provark.streaming import follow as fw

BEGIN = datetime(2024, 1, 1)


def event(run, seq, second, t="log"):
    return run, seq, None if second is None else BEGIN + timedelta(seconds=second), t, "{}"


@pytest.fixture
def followed(spark, tmp_path):
    def run(parts, after=None):
        for part in parts:
            spark.createDataFrame(part, ev.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            given = spark.createDataFrame(after, "run_id string, seq long") if after else None
            fw.drain_to(fw.follow(ev.read_events(spark, f"{tmp_path}/in", 1), "60 seconds", 60_000, given), f"{tmp_path}/out", f"{tmp_path}/state")
        rows = spark.read.schema(fw.FOLLOWED).parquet(f"{tmp_path}/out").collect()
        return sorted((r.run_id, r.kind, r.seq, r.until, None if r.ts is None else (r.ts - BEGIN).total_seconds()) for r in rows if r.run_id != "clock")

    return run


def clock(second):
    return [event("clock", 1, second)]


def test_order_repeats_gaps_and_heartbeats(followed):
    found = followed([
        [event("a", 1, 0), event("a", 2, 5), event("b", 1, 0), event("a", 2, 5), event(None, 1, 1), event("a", None, 1), event("a", 9, None)],
        [event("a", 4, 12), event("b", 2, 30)],
        [event("a", 3, 10), event("b", 4, 40)],
        clock(700),
    ])
    assert [r for r in found if r[0] == "a"] == [("a", "event", n, n, s) for n, s in ((1, 0), (2, 5), (3, 10), (4, 12))] + [("a", "heartbeat", 4, 4, 27)]
    assert [r for r in found if r[0] == "b"] == [
        ("b", "event", 1, 1, 0), ("b", "event", 2, 2, 30), ("b", "event", 4, 4, 40), ("b", "gap", 3, 3, None),
        ("b", "heartbeat", 1, 1, 15), ("b", "heartbeat", 2, 2, 45), ("b", "heartbeat", 4, 4, 55),
    ]


def test_a_run_ends_once_and_leaves_no_state(followed):
    found = followed([
        [event("a", 1, 0), event("a", 2, 3, "done"), event("a", 3, 4)],
        [event("a", 1, 0), event("a", 2, 3, "done"), event("a", 4, 5)],
        clock(1000),
        [event("a", 1, 0), *clock(1001)],
    ])
    assert found == [("a", "end", 2, 2, 3), ("a", "event", 1, 1, 0), ("a", "event", 2, 2, 3)]


def test_replay_goes_on_behind_what_a_follower_has(followed):
    found = followed([[event("a", n, n) for n in range(1, 6)] + [event("b", 1, 1)]], after=[("a", 3), ("a", 2)])
    assert found == [("a", "event", 4, 4, 4), ("a", "event", 5, 5, 5), ("b", "event", 1, 1, 1)]


def test_stream_dedup_keeps_no_rows_in_the_driver(spark, tmp_path):
    """the deduplicated stream goes to the shared folder; a memory sink would leave a table of the session."""
    from provark.plans.source_queries import stream_dedup

    before = {t.name for t in spark.catalog.listTables()}
    rows = stream_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert rows and all(r.events == r.last == r.different for r in rows)
