"""The events table as a job stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.corpus import read
from ..streaming import jobs as J
from . import query

#: ev: events in SQL as (event_id, job, ts, kind).
BASE = "ev AS (SELECT event_id, event_id % 997 AS job, ts, CASE WHEN event_id % 997 >= 600 THEN 'queued' ELSE CASE event_id % 13 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' WHEN 3 THEN 'queued' WHEN 4 THEN 'started' ELSE 'progress' END END AS kind FROM events)"
STATES = """, st AS (SELECT job, coalesce(arg_min(kind, ts) FILTER (kind IN ('succeeded', 'failed')), CASE WHEN min(ts) FILTER (kind IN ('started', 'progress')) IS NOT NULL THEN 'running' ELSE 'queued' END) AS status,
  coalesce(min(ts) FILTER (kind IN ('succeeded', 'failed')), min(ts) FILTER (kind IN ('started', 'progress')), min(ts)) AS since FROM ev GROUP BY job)"""


def job_events(spark, sf_dir):
    """All events as jobs' events, kinds by number; jobs from 600 on are only ever queued."""
    k, job = F.col("event_id") % 13, F.col("event_id") % 997
    kind = F.when(job >= 600, "queued").when(k == 0, "succeeded").when(k == 1, "failed").when(k.isin(2, 3), "queued").when(k == 4, "started").otherwise("progress")
    return read(spark, sf_dir, "events").select("event_id", job.alias("job"), "ts", kind.alias("kind"))


@query("job_states", f"WITH {BASE}{STATES} SELECT job, status, since FROM st")
def job_states(spark, sf_dir):
    """The state of every job."""
    return J.job_states(job_events(spark, sf_dir))


@query("stalled_jobs", f"WITH {BASE}{STATES} SELECT job, floor(epoch((SELECT max(ts) FROM events)))::BIGINT - floor(epoch(max(ev.ts)))::BIGINT AS silent FROM ev JOIN st USING (job) WHERE status = 'running' GROUP BY job HAVING silent > 900")
def stalled_jobs(spark, sf_dir):
    """Running jobs that have been silent for a quarter of an hour at the end of the table."""
    now = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return J.stalled(job_events(spark, sf_dir), now)


@query("reaped_jobs", f"WITH {BASE}{STATES} SELECT job FROM st WHERE status IN ('succeeded', 'failed') AND floor(epoch((SELECT max(ts) FROM events)))::BIGINT - floor(epoch(since))::BIGINT > 86400")
def reaped_jobs(spark, sf_dir):
    """M03."""
    now = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return J.reaped(job_events(spark, sf_dir), now, 86400)


@query("job_changes", f"WITH {BASE} SELECT event_id, job, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY job ORDER BY ts, event_id) AS before FROM ev) WHERE kind IS DISTINCT FROM before")
def job_changes(spark, sf_dir):
    """M04."""
    return J.changes(job_events(spark, sf_dir)).select("event_id", "job", "kind")


@query("job_logs", f"WITH {BASE} SELECT job, string_agg(kind, ',' ORDER BY ts, event_id) AS log FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k <= 50 GROUP BY job")
def job_logs(spark, sf_dir):
    """The last fifty lines of each job."""
    return J.log_tail(job_events(spark, sf_dir))


@query("job_backlog", f"WITH {BASE}{STATES} SELECT count(*) AS pending, count(*) < 50 AS accepts FROM st WHERE status = 'queued'")
def job_backlog(spark, sf_dir):
    """M06, A17."""
    return J.backlog(job_events(spark, sf_dir), 50)


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """M09 (an extension): tumbling windows."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("event_sessions", "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS is_new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    """M09 (an extension): sessions with a gap of half an hour."""
    e = read(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")
