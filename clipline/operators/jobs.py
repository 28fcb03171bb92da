"""Job state from append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.constants import OPEN_STATUSES, STAGES, STALE_AFTER_S, STATUS_CHANGES
from clipline.operators.ordered import nearest_rank, ordered

JOB = ["job_id"]
_FIELDS = ["type", "status", "input_path", "progress", "result", "error"]


def job_snapshot(events: DataFrame) -> DataFrame:
    """Current state per job: the last value written of every field; deleted jobs are gone.

    ``events`` has ``job_id, ts, seq, kind`` and any of the job fields; a null
    field leaves the older value.  A ``delete`` forgets everything before it;
    ``heartbeat`` events set ``heartbeat_at``.
    """
    at = F.struct("ts", "seq")
    gone = events.filter("kind = 'delete'").groupBy("job_id").agg(F.max(at).alias("_gone"))
    live = events.join(gone, JOB, "left").filter(F.col("_gone").isNull() | (at > F.col("_gone")))
    fields = [f for f in _FIELDS if f in events.columns]
    return live.groupBy("job_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
        F.min("ts").alias("created_at"), F.max(F.when(F.col("kind") != "heartbeat", F.col("ts"))).alias("updated_at"),
        F.max(F.when(F.col("kind") == "heartbeat", F.col("ts"))).alias("heartbeat_at"))


def list_jobs(jobs: DataFrame, *, status: str | None = None, job_type: str | None = None, limit: int = 50,
              offset: int = 0) -> DataFrame:
    """A page of jobs, newest first (then by id)."""
    rows = jobs
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if job_type is not None:
        rows = rows.filter(F.col("type") == job_type)
    return rows.orderBy(F.desc("updated_at"), "job_id").offset(offset).limit(limit)


def _age(since: Column, now: Column) -> Column:
    return F.unix_micros(now) / F.lit(1e6) - F.unix_micros(since) / F.lit(1e6)


def _open(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*OPEN_STATUSES))


def stale_jobs(jobs: DataFrame, now: Column | None = None, after_s: float = STALE_AFTER_S) -> DataFrame:
    """Open jobs without a heartbeat or with one older than 90 s; the age counts from the last update."""
    now = F.current_timestamp() if now is None else now
    quiet = F.col("heartbeat_at").isNull() | (_age(F.col("heartbeat_at"), now) > after_s)
    return _open(jobs).filter(quiet).withColumn("stale_age_seconds", _age(F.col("updated_at"), now))


def active_jobs(jobs: DataFrame, now: Column | None = None, after_s: float = STALE_AFTER_S) -> DataFrame:
    """Open jobs with a heartbeat of the last 90 s."""
    now = F.current_timestamp() if now is None else now
    return _open(jobs).filter(_age(F.col("heartbeat_at"), now) <= after_s)


def fail_open_jobs(jobs: DataFrame, now: Column | None = None, message: str = "Server restarted") -> DataFrame:
    """Events that fail every open job; their number is the number of jobs failed."""
    now = F.current_timestamp() if now is None else now
    return _open(jobs).select("job_id", now.alias("ts"), F.lit(0).alias("seq"), F.lit("status").alias("kind"),
                              F.lit("failed").alias("status"), F.lit(message).alias("error"))


def count_by_status(jobs: DataFrame, *, with_total: bool = False) -> DataFrame:
    """Jobs per status; ``with_total`` adds a row with a null status."""
    grouped = jobs.rollup("status") if with_total else jobs.groupBy("status")
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def expire_jobs(jobs: DataFrame, hours: float, now: Column | None = None) -> DataFrame:
    """Delete events for jobs not updated within ``hours``."""
    now = F.current_timestamp() if now is None else now
    old = jobs.filter(_age(F.col("updated_at"), now) > hours * 3600)
    return old.select("job_id", now.alias("ts"), F.lit(0).alias("seq"), F.lit("delete").alias("kind"))


def checkpoints(events: DataFrame) -> DataFrame:
    """Completed stages of a job in the order they were first completed, and the last time."""
    firsts = events.groupBy("job_id", "stage").agg(F.min("ts").alias("_t"), F.max("ts").alias("_last"))
    # One entry per stage of a fixed list, so the array is short.
    return firsts.groupBy("job_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_t", "stage"))), lambda s: s["stage"]).alias("completed_stages"),
        F.max("_last").alias("last_checkpoint_at"))


def pending_work(videos: DataFrame, done: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """(video, stage) pairs still to do: every stage of every video without the completed ones."""
    todo = videos.select("video_id", F.posexplode(F.array(*[F.lit(s) for s in stages or STAGES])).alias("stage_idx", "stage"))
    return todo.join(done.select("video_id", "stage"), ["video_id", "stage"], "left_anti")


def job_metrics(jobs: DataFrame) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of the elapsed time, number of jobs and of failures: one row."""
    counts = jobs.agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    ranks = nearest_rank(jobs, [], "elapsed_ms", {"p50": 50.0, "p95": 95.0, "p99": 99.0})
    one = F.lit(1).alias("_one")
    # Both sides are single rows.
    return counts.select("*", one).join(F.broadcast(ranks.select("*", one)), "_one", "left").drop("_one")


def recovery_report(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """Stale jobs per namespace and what happens to them: exports fail, analyses can resume."""
    stale = stale_jobs(jobs, now)
    action = F.when(F.col("namespace") == "export", "fail").otherwise("resume")
    return stale.groupBy("namespace", "status", action.alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.max("stale_age_seconds").alias("oldest_s"))


def estimate_eta(duration_s: Column, keyframes: Column, *, speech: Column | bool = True, detector: Column | bool = False,
                 service: Column | bool = False) -> Column:
    """Estimated analysis seconds: linear in length and number of key frames."""
    def flag(value: Column | bool) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast("int")

    # Seconds per media second and per key frame.
    return (duration_s * 0.3 + duration_s * 0.8 * flag(speech) + keyframes * 0.15 + keyframes * 0.08 * flag(detector)
            + keyframes * 0.3 * flag(service) + duration_s * 0.1)


def illegal_transitions(events: DataFrame, kind: str) -> DataFrame:
    """Consecutive statuses of a job that the state machine of its kind does not allow."""
    allowed = events.sparkSession.createDataFrame(STATUS_CHANGES[kind], "_from string, status string")
    rows = events.withColumn("_us", F.unix_micros("ts"))
    near = ordered(rows, JOB, ["_us", "seq"], lag={"_from": F.col("status")}).filter(F.col("_from").isNotNull())
    wrong = near.join(F.broadcast(allowed), ["_from", "status"], "left_anti")
    return wrong.select("job_id", "ts", "seq", F.col("_from").alias("from_status"), F.col("status").alias("to_status"))
