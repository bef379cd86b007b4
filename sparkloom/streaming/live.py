"""Debounced synchronisation with its state in Spark's state store: pending files, a timer, failures and their waits.

Each repository's changes are held until none has come for the debounce time, and are then given out together. While what was given out is being
applied, further changes wait; its outcome comes back as another input of the same state, and then what waits is due at once, or, after
a failure, when the wait is over, together with what failed. State and timers live in the query's checkpoint: a restarted query goes on with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

DEBOUNCE_MS, INTERVAL_MS, MOST_MS = 250, 5_000, 300_000
INPUT = "repo string, kind string, paths array<string>"
FLUSH = "repo string, paths array<string>, failures int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def wait_ms(failures: int, interval_ms: int = INTERVAL_MS, most_ms: int = MOST_MS) -> int:
    """The wait after so many failures in a row: doubling from an interval, up to a bound."""
    return min(interval_ms * 2 ** min(failures - 1, 40), most_ms) if failures > 0 else 0


class Debounce(StatefulProcessor):
    """State of one repository: ``pending`` paths, and failures in a row, the end of their wait, when the timer is due, and since when paths are out."""

    def __init__(self, debounce_ms: int = DEBOUNCE_MS, interval_ms: int = INTERVAL_MS, most_ms: int = MOST_MS):
        self.debounce, self.interval, self.most = debounce_ms, interval_ms, most_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "n long")
        self.status = handle.getValueState("status", "failures int, until long, due long, out boolean")

    def _status(self) -> list:
        found = self.status.get()
        return list(found) if found is not None else [0, 0, 0, False]

    def _schedule(self, status: list, due: int) -> None:
        """One timer for each repository: the last one set counts."""
        if status[2]:
            self.handle.deleteTimer(status[2])
        status[2] = due
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, status, changed, back = timerValues.getCurrentProcessingTimeInMs(), self._status(), False, False
        for table in rows:
            for kind, paths in zip(table["kind"], table["paths"], strict=True):
                paths = [] if paths is None else [p for p in paths if p]
                if kind != "ok":
                    for path in paths:
                        self.pending.updateValue((path,), (1,))
                if kind == "event":
                    changed |= bool(paths)
                else:
                    back, status[3] = True, False
                    status[0] = status[0] + 1 if kind == "failed" else 0
                    status[1] = now + wait_ms(status[0], self.interval, self.most)
        if not status[3] and self.pending.exists():
            if changed or back:
                # a timer lies in the future; after an outcome what waited is due at once
                self._schedule(status, max(now + (self.debounce if changed else 1), status[1]))
        self.status.update(tuple(status))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status = self._status()
        if status[3] or expiredTimerInfo.getExpiryTimeInMs() != status[2]:  # an older timer
            return
        status[2] = 0
        paths = sorted(k[0] for k in self.pending.keys())
        if paths:
            self.pending.clear()
            status[3] = True
            yield pd.DataFrame({"repo": [key[0]], "paths": [paths], "failures": [status[0]]})
        self.status.update(tuple(status))


def debounced(inputs: DataFrame, **waits: int) -> DataFrame:
    """``repo, paths, failures``: what is due, from a stream of events and outcomes (``repo, kind, paths``; kinds ``event``, ``ok`` and ``failed``)."""
    return inputs.groupBy("repo").transformWithStateInPandas(Debounce(**waits), FLUSH, "Update", "ProcessingTime")


def events_of(changes: DataFrame, ignore: list[str] | None = None, include: Callable[[str], Column] | None = None) -> DataFrame:
    """Changes ``repo, path`` as events; the engine's own files, and what ``include`` (of the path's column) refuses, leave no trace."""
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    rows = changes.select("repo", path.alias("path")).where("repo is not null and path is not null and path <> ''")
    rows = rows.where(~F.col("path").isin(ignore)) if ignore else rows
    rows = rows if include is None else rows.where(include("path"))
    return rows.select("repo", F.lit("event").alias("kind"), F.array("path").alias("paths"))


def watch_live(events: DataFrame, apply: Callable[[str, DataFrame, int], None], checkpoint: str, every: str = "200 milliseconds", log: Callable[[str], None] = print, **waits: int) -> StreamingQuery:
    """Run ``apply(repo, changed paths, batch)`` on what is due, and take an exception as a failure of that repository alone.

    Outcomes are files beside the checkpoint, which the query reads as its second input. A batch that is run again
    after a crash applies its paths again: ``apply`` overwrites, never appends.
    """
    spark = events.sparkSession
    outcomes = f"{checkpoint.rstrip('/')}-outcomes"
    none = spark.createDataFrame([], INPUT)
    none.write.mode("append").json(outcomes)
    back = spark.readStream.schema(INPUT).json(outcomes)

    def batch(due: DataFrame, number: int) -> None:
        done = []
        for row in due.collect():  # a row for each repository that is due
            try:
                apply(row.repo, spark.createDataFrame([(p,) for p in row.paths], "path string"), number)
                done.append((row.repo, "ok", []))
            except Exception as error:  # noqa: BLE001  any failure of a sync is an outcome
                wait = wait_ms(row.failures + 1, waits.get("interval_ms", INTERVAL_MS), waits.get("most_ms", MOST_MS))
                log(f"[{row.repo}] sync error (attempt {row.failures + 1}, backoff {round(wait / 1000)}s): {error}")
                done.append((row.repo, "failed", list(row.paths)))
        if done:
            spark.createDataFrame(done, INPUT).coalesce(1).write.mode("append").json(outcomes)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that timers need; a query keeps what it starts with
    try:
        due = debounced(events.unionByName(back), **waits)
        return due.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        spark.conf.set(_PROVIDER, before)
