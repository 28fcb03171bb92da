"""Queries over live events: the event table is written as JSON files and read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.plans import adapters as A
from clipline.plans.oracle import with_tables
from clipline.session import scratch
from clipline.streaming import events as E
from clipline.streaming import live as L


def _stream(spark, d, **columns):
    """Every event as a job and video event, read back as a stream."""
    e = A.table(spark, d, "events").withColumn("k", F.from_json("props", "k INT")["k"].cast("long"))
    kind = F.when((F.col("event_type") == "error") & (F.col("k") < 5), "error").when(
        (F.col("event_type") == "signup") & (F.col("k") < 3), "done").otherwise("progress")
    rows = e.select(
        F.col("user_id").alias("job_id"), F.col("user_id").alias("video_id"),
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("module_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("value") / 80 - 0.1).alias("progress"),
        F.lit(None).cast("double").alias("t_s"), F.lit(None).cast("double").alias("end_s"), F.col("event_type").alias("payload"))
    path = scratch(spark, "events")
    E.write_events(rows, path)
    return E.read_events(spark, path, **columns)


def x01(spark, d):
    return E.run_append(L.dedupe_events(_stream(spark, d), "60 days").select("video_id", "module_id"), "dedupe")


def x02(spark, d):
    out = E.run_append(L.throttle(_stream(spark, d), 36000.0), "throttle", idle_batches=False)
    return out.select("job_id", F.unix_micros("ts").alias("us"), F.round("progress", 6).alias("progress"))


def x03(spark, d):
    out = E.run_append(L.expire_heartbeats(_stream(spark, d), 43200.0, delay="0 seconds"), "expire")
    return out.select("job_id", F.unix_micros("last_beat").alias("last_us"))


def x04(spark, d):
    out = L.latest_of_batches(E.run_batches(L.latest_progress(_stream(spark, d, files_per_trigger=10)), "latest", "update"))
    return out.select("job_id", F.round("progress", 6).alias("progress"), F.unix_micros("ts").alias("us"))


def x05(spark, d):
    out = E.run_append(L.until_terminal(_stream(spark, d)), "terminal", idle_batches=False)
    return out.select("video_id", "seq", "kind")


def x06(spark, d):
    e = A.table(spark, d, "orders")
    history = e.select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("seq"), F.lit("segment").alias("kind"))
    out = L.replay(history, _stream(spark, d))
    return out.select("video_id", F.col("origin").cast("long").alias("origin"), "seq", "kind")


def _media_stream(spark, d):
    """Media events with media time (counted from the second day of the epoch) as event time."""
    e = A.media_events(spark, d)
    kind = (F.when(F.col("event_type") == "view", "highlight").when(F.col("event_type") == "click", "transition")
            .otherwise("effect"))
    rows = e.select(
        F.col("video_id").alias("job_id"), "video_id", F.lit("").alias("module_id"),
        F.timestamp_micros((F.col("t_s") * 1e6).cast("long") + 86_400_000_000).alias("ts"), F.col("us").alias("seq"), kind.alias("kind"),
        F.lit(None).cast("double").alias("progress"), "t_s", (F.col("t_s") + F.col("value") / 20).alias("end_s"),
        F.col("event_type").alias("payload"))
    path = scratch(spark, "media")
    E.write_events(rows, path)
    return E.read_events(spark, path)


def x07(spark, d):
    points = _media_stream(spark, d).filter("payload = 'click'").select("video_id", "ts")
    out = E.run_append(L.live_windows(points, delay="5 seconds"), "windows")
    return out.select("video_id", (F.unix_millis("window_start") - 86_400_000).alias("start_ms"), "cuts")


def x08(spark, d):
    number = F.pmod(F.floor("t_s"), F.lit(7))
    rows = _media_stream(spark, d).select(
        "video_id", "ts", F.col("t_s").alias("start_s"), "end_s", F.col("kind").alias("structure_type"),
        F.concat(F.lit("s"), (number % 3).cast("string")).alias("sub_type"), (number / 10).alias("confidence"),
        F.array(F.concat(F.lit("e"), number.cast("string")), F.col("payload")).alias("evidence"))
    out = E.run_append(L.live_merge(rows, delay="0 seconds"), "merge")
    return out.select("video_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "structure_type",
                      "sub_type", "confidence", F.array_join("evidence", "|").alias("evidence"))


def s11(spark, d):
    """Every event written as a file line and read back as a stream, counted per video and kind."""
    found = E.run_append(_stream(spark, d, files_per_trigger=50).select("video_id", "kind", "ts", "seq"), "written")
    return found.groupBy("video_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("last_us"), F.sum("seq").alias("seqs"))


QUERIES = {
    "s11_write_events": s11, "x01_dedupe_events": x01, "x02_throttle": x02, "x03_expire_heartbeats": x03, "x04_latest_progress": x04,
    "x05_until_terminal": x05, "x06_replay": x06, "x07_live_windows": x07, "x08_live_merge": x08,
}

_KIND = """CASE WHEN event_type = 'error' AND k < 5 THEN 'error' WHEN event_type = 'signup' AND k < 3 THEN 'done'
    ELSE 'progress' END"""
_E = f"""SELECT user_id, event_id, epoch_us(ts) AS us, value, event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""

ORACLE = {
    "s11_write_events": f"""SELECT user_id AS video_id, kind, count(*) AS n, max(us) AS last_us,
        CAST(sum(event_id) AS BIGINT) AS seqs FROM (SELECT *, {_KIND} AS kind FROM ({_E})) GROUP BY ALL""",
    "x01_dedupe_events": """SELECT DISTINCT user_id AS video_id, 'm' || json_extract_string(props, '$.k') AS module_id
        FROM events""",
    "x02_throttle": f"""WITH RECURSIVE e AS ({_E}), walk AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id
        UNION ALL SELECT w.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = w.user_id AND e.us >= w.us + 36000000000)
        FROM walk w WHERE w.us IS NOT NULL)
        SELECT w.user_id AS job_id, w.us, round(least(greatest(e.value / 80 - 0.1, 0.0), 1.0), 6) AS progress
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.us = w.us""",
    "x03_expire_heartbeats": f"""SELECT user_id AS job_id, us AS last_us FROM (SELECT *, lead(us) OVER (PARTITION BY user_id
        ORDER BY us) AS nx, max(us) OVER () AS mx FROM ({_E}))
        WHERE nx - us > 43200000000 OR (nx IS NULL AND us + 43200000000 <= mx)""",
    "x04_latest_progress": f"""SELECT user_id AS job_id, round(arg_max(value, us) / 80 - 0.1, 6) AS progress, max(us) AS us
        FROM ({_E}) GROUP BY user_id""",
    "x05_until_terminal": f"""SELECT user_id AS video_id, event_id AS seq, kind FROM (SELECT *, min(CASE WHEN kind <>
        'progress' THEN us END) OVER (PARTITION BY user_id) AS stop FROM (SELECT *, {_KIND} AS kind FROM ({_E})))
        WHERE stop IS NULL OR us <= stop""",
    "x06_replay": f"""SELECT o_custkey AS video_id, 0::BIGINT AS origin, o_orderkey AS seq, 'segment' AS kind FROM orders
        UNION ALL SELECT user_id, 1, event_id, {_KIND} FROM ({_E})
        UNION ALL SELECT o_custkey, 2, count(*), 'done' FROM orders
          WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey""",
    "x07_live_windows": with_tables("ev", """SELECT video_id, start_ms, count(*) AS cuts FROM (
        SELECT video_id, unnest([b * 500, b * 500 - 500]) AS start_ms FROM (
          SELECT video_id, CAST(floor(trunc(t_s * 1e6) / 500000) AS BIGINT) AS b FROM ev WHERE event_type = 'click'))
        WHERE start_ms + 1000 <= (SELECT CAST(floor(trunc(max(t_s) * 1e6) / 1000) AS BIGINT) - 5000 FROM ev
          WHERE event_type = 'click') GROUP BY video_id, start_ms"""),
    "x08_live_merge": with_tables("ev", """SELECT video_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
          structure_type, sub_type, confidence, evidence FROM (
        SELECT video_id, run, min(t_s) AS start_s, arg_max(end_s, t_s) AS end_s, min(kind) AS structure_type,
          arg_min('s' || nr % 3, t_s) AS sub_type, max(nr / 10) AS confidence,
          run = max(run) OVER (PARTITION BY video_id) AS is_last FROM runs GROUP BY video_id, run) JOIN (
        SELECT video_id, run, string_agg(e, '|' ORDER BY t0, i) AS evidence FROM (
          SELECT video_id, run, e, min(t_s) AS t0, arg_min(i, t_s) AS i FROM (
            SELECT video_id, run, t_s, unnest(['e' || nr, event_type]) AS e, unnest([0, 1]) AS i FROM runs)
          GROUP BY video_id, run, e) GROUP BY video_id, run) USING (video_id, run)
        WHERE NOT is_last OR end_s + CASE structure_type WHEN 'highlight' THEN 0.8 ELSE 1.5 END
          <= (SELECT max(t_s) FROM ev)""", runs="""
          SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t_s) AS run FROM (
            SELECT *, CASE WHEN lag(kind) OVER w = kind AND abs(lag(end_s) OVER w - t_s) < CASE kind WHEN 'highlight'
              THEN 0.8 ELSE 1.5 END THEN 0 ELSE 1 END AS brk FROM (
              SELECT video_id, t_s, t_s + value / 20 AS end_s, event_type, CAST(floor(t_s) AS BIGINT) % 7 AS nr,
                CASE event_type WHEN 'view' THEN 'highlight' WHEN 'click' THEN 'transition' ELSE 'effect' END AS kind FROM ev)
            WINDOW w AS (PARTITION BY video_id ORDER BY t_s))"""),
}
