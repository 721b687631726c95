"""A live follower of run events: replay and tail in one stream, each event once and in order, with heartbeats and ends.

State a run: the highest sequence number given, events that came before their turn, and when it was last heard. Event-time
timers give a silent run a heartbeat, and give a missing number up after a while, so that a gap is seen and told of instead
of holding the run for good. Rows older than the watermark are left out by Spark before they get here."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FOLLOWED = "run_id string, kind string, seq long, until long, ts timestamp, t string, payload string"
_STATE = "given long, heard long, beaten boolean, ended boolean, waits long, early array<struct<seq: long, at: long, t: string, payload: string>>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Follower(StatefulProcessor):
    """kind `event`: the next event of a run; `heartbeat`: nothing came within `silence` of event time behind seq; `gap`:
    numbers seq to until did not come within `patience` of what came behind them; `end`: a terminal event was given.

    A number is given once: repeats, and numbers that a gap has passed, are left out. After its end a run keeps a few
    bytes until the watermark has passed `late` more, so that repeats do not begin it anew; then its state is gone."""

    def __init__(self, terminal: tuple[str, ...], silence_ms: int, patience_ms: int, late_ms: int):
        self.terminal, self.silence, self.patience, self.late = terminal, silence_ms, patience_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _load(self) -> dict[str, Any]:
        found = self.state.get()
        if found is None:
            return {"given": 0, "heard": None, "beaten": False, "ended": False, "waits": None, "early": {}}
        given, heard, beaten, ended, waits, early = found
        return {"given": given, "heard": heard, "beaten": beaten, "ended": ended, "waits": waits, "early": {e[0]: tuple(e) for e in early}}

    def _save(self, s: dict[str, Any]) -> None:
        self.state.update((s["given"], s["heard"], s["beaten"], s["ended"], s["waits"], [s["early"][k] for k in sorted(s["early"])]))

    def _row(self, key: Any, kind: str, seq: int, until: int, at: int | None, t: str | None = None, payload: str | None = None) -> Row:
        from datetime import datetime, timedelta, timezone

        ts = None if at is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at)
        return Row(run_id=key[0], kind=kind, seq=seq, until=until, ts=ts, t=t, payload=payload)

    def _beat(self, key: Any, s: dict[str, Any]) -> Row:
        s["beaten"] = True
        return self._row(key, "heartbeat", s["given"], s["given"], s["heard"] + self.silence * 1000)

    def _give(self, key: Any, s: dict[str, Any]) -> Iterator[Row]:
        """What is next in line, and what the silence before it or the end of the run says."""
        while not s["ended"] and s["given"] + 1 in s["early"]:
            seq, at, t, payload = s["early"].pop(s["given"] + 1)
            if s["heard"] is not None and not s["beaten"] and at - s["heard"] > self.silence * 1000:
                yield self._beat(key, s)
            s.update(given=seq, heard=at, beaten=False)
            yield self._row(key, "event", seq, seq, at, t, payload)
            if t in self.terminal:
                s.update(ended=True, early={})
                yield self._row(key, "end", seq, seq, at)

    def _timers(self, s: dict[str, Any]) -> None:
        """One timer for what is due first: silence, patience with a gap, or the end of a dead run's memory."""
        if s["ended"]:
            due = s["heard"] // 1000 + self.late
        else:
            silence = s["heard"] // 1000 + self.silence if s["heard"] is not None and not s["beaten"] else None
            gap = min(e[1] for e in s["early"].values()) // 1000 + self.patience if s["early"] else None
            due = min((x for x in (silence, gap) if x is not None), default=None)
        if due != s["waits"]:
            if s["waits"] is not None:
                self.handle.deleteTimer(s["waits"])
            if due is not None:
                self.handle.registerTimer(due)
            s["waits"] = due

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._save({"given": initialState[1], "heard": None, "beaten": False, "ended": False, "waits": None, "early": {}})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = self._load()
        if not s["ended"]:
            for r in rows:
                if r["seq"] > s["given"]:
                    s["early"].setdefault(r["seq"], (r["seq"], r["at"], r["t"], r["payload"]))
            yield from self._give(key, s)
            self._timers(s)
            self._save(s)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """All that is due by the watermark, in turn: a gap given up may bring events whose own silence is over too."""
        s, now = self._load(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        s["waits"] = None
        if s["ended"]:
            self.state.clear()
            return
        while not s["ended"]:
            if s["heard"] is not None and not s["beaten"] and s["heard"] // 1000 + self.silence <= now:
                yield self._beat(key, s)
            elif s["early"] and min(e[1] for e in s["early"].values()) // 1000 + self.patience <= now:
                first = min(s["early"])
                yield self._row(key, "gap", s["given"] + 1, first - 1, None)
                s["given"] = first - 1
                yield from self._give(key, s)
            else:
                break
        self._timers(s)
        self._save(s)

    def close(self) -> None:
        pass


def follow(events: DataFrame, late: str = "10 minutes", late_ms: int = 600_000, after: DataFrame | None = None, terminal: tuple[str, ...] = ("done",), silence_ms: int = 15_000, patience_ms: int = 60_000) -> DataFrame:
    """The stream of EVENT rows as FOLLOWED rows. `after` (run_id, seq): a follower that has these already gets what is
    behind them. Rows without a run, number or time are left out. A run's rows are one key: its early events are state."""
    own = events.dropna(subset=["run_id", "seq", "ts"]).withWatermark("ts", late)
    rows = own.select("run_id", "seq", "ts", F.unix_micros("ts").alias("at"), "t", "payload").groupBy("run_id")
    begun = after.groupBy("run_id").agg(F.max("seq").alias("seq")).groupBy("run_id") if after is not None else None
    return rows.transformWithState(Follower(terminal, silence_ms, patience_ms, late_ms), FOLLOWED, "Append", "EventTime", begun)


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """State of this kind needs the RocksDB store; the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends to a table in the shared folder all that there is by now, exactly once by checkpoint, and ends."""
    with rocks(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
