"""Continuous synchronisation: change events debounced per repository, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE, DELAY = "250 milliseconds", "10 seconds"


def debounced(events: DataFrame, gap: str = DEBOUNCE, delay: str | None = DELAY, ignore: str | None = None) -> DataFrame:
    """``repo, start, end, paths, n``: sessions of events ``repo, ts, path`` that a pause of ``gap`` ends.

    It serves batches and streams; on a stream a session is given once the watermark has passed it.
    ``ignore`` leaves out the engine's own state file.
    """
    own = events if ignore is None else events.where(F.col("path") != ignore)
    timed = own.withColumn("ts", F.col("ts").cast("timestamp"))
    if own.isStreaming and delay:
        timed = timed.withWatermark("ts", delay)
    sessions = timed.groupBy("repo", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))
    return sessions.select("repo", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def windowed_counts(events: DataFrame, width: str, delay: str = DELAY, key: str = "event_type") -> DataFrame:
    """``start, key, n`` of tumbling windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Run ``apply(changed, batch_id)`` on each batch's distinct ``repo, path``.

    One batch runs at a time, and a batch counts as done only after ``apply`` returns, so a failure
    repeats it: ``apply`` overwrites by batch, never appends.
    """

    def batch(df: DataFrame, number: int) -> None:
        apply(df.select("repo", "path").distinct(), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class Backoff:
    """Waits of a repository after failures: doubling from a base, reset by a success."""

    def __init__(self, base_ms: int = 5_000, most_ms: int = 300_000):
        self.base, self.most = base_ms, most_ms
        self.failures: dict[str, int] = {}

    def failed(self, repo: str) -> int:
        n = self.failures[repo] = self.failures.get(repo, 0) + 1
        return min(self.base * 2 ** min(n - 1, 40), self.most)

    def succeeded(self, repo: str) -> None:
        self.failures.pop(repo, None)
