"""The job stream: states, stalls, logs and replay, on batch tables and with Structured Streaming.

The same transition rules serve both. Events are (job, ts, kind): queued, started, progress, succeeded, failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STALL_SECONDS = 900
LOG_LINES = 50
RANK = {"queued": 0, "started": 1, "progress": 1, "succeeded": 2, "failed": 2}


def job_states(events: DataFrame) -> DataFrame:
    """job, status, since: the state after all events; the first terminal verdict wins over what comes later. M01, M02."""
    terminal = F.col("kind").isin("succeeded", "failed")
    end = F.min(F.when(terminal, F.struct("ts", "kind")))
    started = F.min(F.when(F.col("kind").isin("started", "progress"), F.col("ts")))
    by = events.groupBy("job").agg(end.alias("end"), started.alias("started"), F.min("ts").alias("queued"))
    status = F.coalesce(F.col("end.kind"), F.when(F.col("started").isNotNull(), "running").otherwise("queued"))
    return by.select("job", status.alias("status"), F.coalesce("end.ts", "started", "queued").alias("since"))


def stalled(events: DataFrame, now, seconds: int = STALL_SECONDS) -> DataFrame:
    """job, silent (seconds since its last event) of running jobs that stalled at time now. M02, C33."""
    states = job_states(events).where("status = 'running'").select("job")
    last = events.groupBy("job").agg(F.max("ts").alias("last"))
    silent = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")
    return states.join(last, "job").withColumn("silent", silent).where(F.col("silent") > seconds).select("job", "silent")


def reaped(events: DataFrame, now, seconds: int) -> DataFrame:
    """Terminal jobs older than their time to live. M03."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("since")
    return job_states(events).where(F.col("status").isin("succeeded", "failed") & (age > seconds)).select("job")


def changes(events: DataFrame) -> DataFrame:
    """The events that change a job's kind: what a watcher is sent. M04."""
    before = F.lag("kind").over(Window.partitionBy("job").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where(~F.col("kind").eqNullSafe(F.col("before"))).drop("before")


def log_tail(events: DataFrame, lines: int = LOG_LINES) -> DataFrame:
    """job, log: the last lines in order. Each task keeps `lines` rows a job by rank before anything is collected. M05."""
    last = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id")))
    kept = events.withColumn("k", last).where(F.col("k") <= lines)
    return kept.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind"))), lambda x: x["kind"]), ",").alias("log"))


def backlog(events: DataFrame, limit: int) -> DataFrame:
    """pending, accepts: queued jobs against the limit of the queue. M06, A17."""
    n = job_states(events).where("status = 'queued'").agg(F.count(F.lit(1)).alias("pending"))
    return n.withColumn("accepts", F.col("pending") < limit)


# --- Structured Streaming ------------------------------------------------------------------------------------
def stream_unique(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events without replays of an event_id inside the watermark. M08."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_windows(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling event-time window and kind; late rows beyond the watermark are dropped. M09."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by session of each job. M09."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "job").agg(F.count(F.lit(1)).alias("n"))


def stream_job_states(events: DataFrame, stall_ms: int = STALL_SECONDS * 1000) -> DataFrame:
    """job, status whenever it changes, as a keyed stateful stream with an event-time timer for stalls. M01-M04."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, rank = state.get if state.exists else ("", -1)
        if state.hasTimedOut:
            state.update(("failed", 2))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 10 * stall_ms)
            if rank < 2:
                yield pd.DataFrame({"job": [key[0]], "status": ["failed"]})
            return
        seen = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for kind in seen["kind"]:
            new = "running" if kind in ("started", "progress") else kind
            if rank < 2 and RANK.get(kind, -1) >= max(rank, 0) and new != status:
                status, rank = new, RANK[kind]
                out.append(status)
        state.update((status, rank))
        last = int(seen["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + stall_ms)
        if out:
            yield pd.DataFrame({"job": [key[0]] * len(out), "status": out})

    return events.groupBy("job").applyInPandasWithState(step, "job long, status string", "status string, rank int", "update", "EventTimeTimeout")
