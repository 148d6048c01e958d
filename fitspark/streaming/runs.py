"""Progress of runs from their entries: a stream with state and timers, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fitspark.cluster import ship

#: started and last are milliseconds.
CLOSED = "run_id string, started long, last long, status string, n_calls long, tokens long, n_errors long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _entries(entries: DataFrame) -> DataFrame:
    """run_id, seq, ts, ms, tokens, failed, ends; rows without a run, a number or a time are left out."""
    rows = entries.select(F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.col("error").isNotNull().alias("failed"), F.coalesce("ends", F.lit(False)).alias("ends"))
    return rows.where("run_id is not null and seq is not null and ts is not null").withColumn("ms", F.unix_millis("ts"))


class RunProgress(StatefulProcessor):
    """Folds the entries of a run in the order of their time, once the watermark has passed them.

    Entries wait in a map, so their order of arrival does not matter, and a repeated one is
    there once. A timer for each waiting time folds it; a timer at the last entry's time
    plus the gap closes a run that has stalled. A closed run keeps no state.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long, ms long", "tokens long, failed boolean, ends boolean")
        self.run = handle.getValueState("run", "started long, last long, n_calls long, tokens long, n_errors long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.seq, r.ms), (r.tokens, r.failed, r.ends))
            self.handle.registerTimer(r.ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that the watermark has passed, also beyond this timer: one that is registered here fires with the next batch only.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = sorted((k[1], k[0], v) for k, v in self.waiting.iterator() if k[1] <= now)
        run = tuple(self.run.get()) if self.run.exists() else None
        out = []

        def close(status: str) -> None:
            out.append(Row(run_id=key[0], started=run[0], last=run[1], status=status, n_calls=run[2], tokens=run[3], n_errors=run[4]))

        for ms, seq, (tokens, failed, ends) in due:
            self.waiting.removeKey((seq, ms))
            if run and ms - run[1] >= self.gap:
                close("stalled")
                run = None
            run = (run[0] if run else ms, ms, (run[2] if run else 0) + 1, (run[3] if run else 0) + tokens, (run[4] if run else 0) + int(failed))
            if ends:
                close("done")
                run = None
        if run and run[1] + self.gap <= now:
            close("stalled")
            run = None
        if run:
            self.run.update(run)
            self.handle.registerTimer(run[1] + self.gap)
        elif self.run.exists():
            self.run.clear()
        return iter(out)

    def close(self) -> None:
        pass


def closed_runs(entries: DataFrame, *, gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """Runs that have ended, from entries (run_id, seq, ts, tokens, error, ends): run_id, started, last, status, n_calls, tokens, n_errors.

    A run ends with an entry that says so (done), or when nothing came for the gap
    (stalled); entries after that begin a run of the same name anew. Entries of equal
    run, seq and time count once; of equal time they go by seq. Null tokens count as
    0. Of a stream, runs appear when the watermark has passed their end, and entries later
    than `late` are dropped; it needs the RocksDB state store, which is set here. Of a
    table, all runs are closed.
    """
    rows = _entries(entries)
    gap = int(gap_seconds * 1000)
    if entries.isStreaming:
        spark = entries.sparkSession
        ship(spark)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        return rows.withWatermark("ts", late).groupBy("run_id").transformWithState(RunProgress(gap), CLOSED, "Append", "EventTime")
    once = rows.dropDuplicates(["run_id", "seq", "ms"])
    w = W.partitionBy("run_id").orderBy("ms", "seq")
    begins: Column = F.coalesce((F.col("ms") - F.lag("ms").over(w) >= gap) | F.lag("ends").over(w), F.lit(True))
    parts = once.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(w))
    whole = parts.groupBy("run_id", "part").agg(F.min("ms").alias("started"), F.max("ms").alias("last"), F.max("ends").alias("ended"), F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"), F.count_if("failed").alias("n_errors"))
    return whole.select("run_id", "started", "last", F.when(F.col("ended"), "done").otherwise("stalled").alias("status"), "n_calls", "tokens", "n_errors")
