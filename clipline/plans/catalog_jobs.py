"""Queries over templates, composed scripts and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.operators import blueprint as B
from clipline.operators import jobs as J
from clipline.plans import adapters as A
from clipline.plans.oracle import with_tables
from clipline.session import store

_TEMPLATE_SQL = """CASE o_custkey % 4 WHEN 0 THEN 'product_review' WHEN 1 THEN 'talking_head' WHEN 2 THEN 'mashup'
    ELSE 'none' END"""


def _now():
    return F.lit("1998-08-03 00:00:00").cast("timestamp")


def _composed(spark, d):
    m = A.modules(spark, d)
    k = F.col("pos") + F.col("script_id")
    m = m.select(
        "*", F.when(k % 3 == 0, "无").otherwise(F.concat(F.lit(" say "), "label")).alias("voice_content"),
        F.when(k % 4 == 0, "无").otherwise("推近").alias("motion"), F.when(k % 5 == 0, "未知").otherwise("冷色调").alias("color_tone"),
        F.when(k % 2 == 0, "未知").otherwise("舒缓").alias("bgm_type"),
        F.when(k % 6 < 5, F.array("id", "label")).otherwise(F.array().cast("array<string>")).alias("content_tags"))
    return B.compose_blocks(m)


def b01(spark, d):
    return _composed(spark, d).select(
        "script_id", "order", "module_id", "structure_type", "start_time", "end_time", "content_description",
        "template_params.layout", "template_params.animation", "template_params.text")


def b02(spark, d):
    s = B.compose_summary(_composed(spark, d))
    counts = F.col("structure_summary")
    return s.select("script_id", "block_count", "total_duration", *[
        F.coalesce(counts[k], F.lit(0)).alias(f"n_{k}") for k in ("opening", "highlight", "effect")])


def b02b(spark, d):
    return B.compose_tracks(_composed(spark, d)).select("script_id", "module_type", F.col("index").cast("long").alias("track"),
                                                       "n_blocks")


def _slots(spark, d):
    """Three slots per script whose words come from part names and types."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("script_id"))
    return o.select("script_id", F.posexplode(F.array(F.lit("shape"), F.lit("metal"), F.lit("size"))).alias("slot_idx", "key"))


def _words(spark):
    return spark.createDataFrame([("shape", ["ring", "WIDGET", "bolt"]), ("metal", ["steel", "brass", "economy"]),
                                  ("size", ["SMALL", "large", "medium"])], "key string, words array<string>")


def _worded(spark, d):
    """Modules with the name and type of their part as texts."""
    m = A.modules(spark, d).withColumn("p_partkey", F.substring("label", 6, 20).cast("long"))
    p = A.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return m.join(p, "p_partkey", "left").withColumn("texts", F.array_compact(F.array("p_name", "p_type")))


def b03(spark, d):
    return B.match_scores(_slots(spark, d), _worded(spark, d), _words(spark)).select(
        "script_id", F.col("slot_idx").cast("long").alias("slot_idx"), "pos", F.col("score").cast("long").alias("score"))


def b04(spark, d):
    return B.assign_slots(B.match_scores(_slots(spark, d), _worded(spark, d), _words(spark)), 3)


def _templates(spark, d):
    c = F.col("o_custkey") % 4
    return A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("script_id"), F.when(c == 0, "product_review").when(c == 1, "talking_head")
        .when(c == 2, "mashup").otherwise("none").alias("template"))


def _blueprint(spark, d):
    words = F.array(*[F.lit(w) for w in ("开场", "产品特写", "台词金句", "转场", "购买", "plain")])
    m = store(A.modules(spark, d)).withColumn(
        "texts", F.array("label", F.get(words, ((F.col("script_id") + F.col("pos") * 5) % 6).cast("int"))))
    return B.merge_blueprint(_templates(spark, d), m)


def b05(spark, d):
    return _blueprint(spark, d)


def b05b(spark, d):
    out = B.blueprint_summary(_blueprint(spark, d))
    return out.withColumn("required_missing", F.array_join("required_missing", "|"))


def _gaps(spark, d):
    li = A.table(spark, d, "lineitem")
    kinds = F.array(*[F.lit(k) for k in ("shot_rhythm", "subtitle_style", "visual_style", "transition", "music_sync", "other")])
    rows = li.select(F.col("l_orderkey").alias("script_id"), F.get(kinds, (F.col("l_suppkey") % 6).cast("int")).alias("dimension"),
                     "l_returnflag").groupBy("script_id", "dimension").agg(F.min("l_returnflag").alias("f"))
    return B.material_gaps(rows.select(
        "script_id", "dimension", F.when(F.col("f") == "A", "mine").otherwise("").alias("label"),
        F.when(F.col("f") == "R", "matched").alias("status"), F.lit(None).cast("string").alias("reason")))


def b06(spark, d):
    return _gaps(spark, d).select("script_id", "dimension", "label", "status", "accept")


def b06b(spark, d):
    uploads = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("script_id"), F.lit("music_sync").alias("dimension"))
    return B.material_coverage(_gaps(spark, d), uploads)


def b07(spark, d):
    return B.blank_blueprint(_templates(spark, d)).withColumn("block_idx", F.col("block_idx").cast("long"))


# -- jobs -----------------------------------------------------------------

def _job_events(spark, d):
    """Status events of the orders of a customer, as the life of one job."""
    o = A.table(spark, d, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing")
              .otherwise("failed"))
    price = F.col("o_totalprice")
    kind = F.when(price < 5000, "delete").when(price > 400000, "heartbeat").otherwise("status")
    return o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                    F.col("o_orderkey").alias("seq"), kind.alias("kind"),
                    F.when(kind == "status", status).alias("status"), (price / 497003).alias("progress"))


def j01(spark, d):
    return J.job_snapshot(_job_events(spark, d)).select(
        "job_id", "status", F.round("progress", 6).alias("progress"), F.unix_seconds("updated_at").alias("updated_s"),
        F.unix_seconds("heartbeat_at").alias("heartbeat_s"))


def j02(spark, d):
    return J.list_jobs(A.jobs(spark, d), status="processing", limit=40, offset=10).select("job_id", "status", "type")


def _beating(spark, d):
    """Jobs whose last heartbeat lies up to some minutes before their check."""
    j = A.jobs(spark, d)
    back = (F.col("elapsed_ms") % 300).cast("int")
    return j.withColumn("heartbeat_at", F.when(F.col("job_id") % 7 > 0, F.timestamp_micros(
        F.unix_micros(_now()) - back.cast("long") * 1000000))).withColumn(
            "namespace", F.when(F.col("type") == "1-URGENT", "export").otherwise("analysis"))


def j03(spark, d):
    return J.stale_jobs(_beating(spark, d), _now()).select("job_id", F.round("stale_age_seconds", 3).alias("age_s"))


def j04(spark, d):
    return J.active_jobs(_beating(spark, d), _now()).select("job_id")


def j05(spark, d):
    return J.fail_open_jobs(A.jobs(spark, d), _now()).select("job_id", "status")


def j06(spark, d):
    return J.count_by_status(A.jobs(spark, d), with_total=True)


def j07(spark, d):
    return J.expire_jobs(A.jobs(spark, d), 24 * 365, _now()).select("job_id", "kind")


def _stage_events(spark, d):
    e = A.table(spark, d, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))


def j08(spark, d):
    out = J.checkpoints(_stage_events(spark, d))
    return out.select("job_id", F.array_join("completed_stages", ">").alias("stages"),
                      F.unix_micros("last_checkpoint_at").alias("last_us"))


def j09(spark, d):
    done = A.table(spark, d, "events").filter("value > 120").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage")).distinct()
    stages = ["view", "click", "error", "signup", "purchase", "extra"]
    return J.pending_work(A.videos(spark, d), done, stages).select("video_id", "stage", F.col("stage_idx").cast("long").alias("stage_idx"))


def j10(spark, d):
    return J.job_metrics(A.jobs(spark, d).withColumn("status", F.when(F.col("status") == "pending", "failed").otherwise(F.col("status"))))


def j11(spark, d):
    return J.recovery_report(_beating(spark, d), _now()).withColumn("oldest_s", F.round("oldest_s", 3))


def j12(spark, d):
    v = A.videos(spark, d)
    eta = J.estimate_eta(F.col("duration_s"), F.col("video_id") % 90, detector=F.col("video_id") % 2 == 0)
    return v.select("video_id", F.round(eta, 4).alias("eta_s"))


def j13(spark, d):
    e = _job_events(spark, d).filter("status is not null")
    return J.illegal_transitions(e, "analysis").select("job_id", "seq", "from_status", "to_status")


QUERIES = {
    "b01_compose_blocks": b01, "b02_compose_summary": b02, "b02_compose_tracks": b02b, "b03_match_scores": b03,
    "b04_assign_slots": b04, "b05_merge_blueprint": b05, "b05_blueprint_summary": b05b, "b06_material_gaps": b06,
    "b06_material_coverage": b06b, "b07_blank_blueprint": b07, "j01_job_snapshot": j01, "j02_list_jobs": j02,
    "j03_stale_jobs": j03, "j04_active_jobs": j04, "j05_fail_open_jobs": j05, "j06_count_by_status": j06,
    "j07_expire_jobs": j07, "j08_checkpoints": j08, "j09_pending_work": j09, "j10_job_metrics": j10,
    "j11_recovery_report": j11, "j12_estimate_eta": j12, "j13_illegal_transitions": j13,
}

_BLOCKS = """SELECT script_id, pos, id, type, label, start_time, duration,
      CASE type WHEN 'title' THEN 'opening' WHEN 'effect' THEN 'effect' ELSE 'highlight' END AS kind,
      concat_ws('；', CASE WHEN k % 6 < 5 THEN id || ' · ' || label END,
        CASE WHEN k % 3 <> 0 THEN '配音: say ' || label END, CASE WHEN k % 4 <> 0 THEN '运镜: 推近' END,
        CASE WHEN k % 5 <> 0 THEN '色调: 冷色调' END, CASE WHEN k % 2 <> 0 THEN '背景乐: 舒缓' END) AS parts
    FROM (SELECT *, pos + script_id AS k FROM modules)"""
_WORD_SQL = {"shape": ["ring", "widget", "bolt"], "metal": ["steel", "brass", "economy"], "size": ["small", "large", "medium"]}
_SCORES = " UNION ALL ".join(
    f"SELECT script_id, {i}::BIGINT AS slot_idx, pos, " + " + ".join(
        f"CASE WHEN contains(lower(p_name), '{w}') OR contains(lower(p_type), '{w}') THEN 1 ELSE 0 END" for w in ws)
    + " AS score FROM worded" for i, ws in enumerate(_WORD_SQL.values()))
_WORDED = "SELECT m.*, p_name, p_type FROM modules m LEFT JOIN part ON 'part ' || p_partkey = label"
_EVENTS = """SELECT o_custkey AS job_id, o_orderdate AS ts, o_orderkey AS seq, o_totalprice / 497003 AS progress,
      CASE WHEN o_totalprice < 5000 THEN 'delete' WHEN o_totalprice > 400000 THEN 'heartbeat' ELSE 'status' END AS kind,
      CASE WHEN o_totalprice >= 5000 AND o_totalprice <= 400000 THEN CASE o_orderstatus WHEN 'F' THEN 'completed'
        WHEN 'O' THEN 'processing' ELSE 'failed' END END AS status FROM orders"""
_BEATING = """SELECT *, CASE WHEN job_id % 7 > 0 THEN CAST(trunc(elapsed_ms % 300) AS BIGINT) END AS back,
      CASE WHEN type = '1-URGENT' THEN 'export' ELSE 'analysis' END AS namespace,
      epoch(TIMESTAMP '1998-08-03') - epoch(updated_at) AS age FROM jobs"""
_GAPS = """SELECT script_id, dimension, f FROM (SELECT l_orderkey AS script_id,
      ['shot_rhythm', 'subtitle_style', 'visual_style', 'transition', 'music_sync', 'other'][l_suppkey % 6 + 1] AS dimension,
      min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) WHERE dimension <> 'other'"""
_SLOT_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS template, {i}::BIGINT AS block_idx, '{n}' AS name, '{k}' AS template_key, {dur}::DOUBLE AS duration, "
    f"{need} AS required" for t in ("product_review", "talking_head", "mashup")
    for i, (n, k, dur, need) in enumerate(B.TEMPLATES[t]))



def taken(slots: int) -> dict[str, str]:
    """SQL tables t0, t1, ...: the modules that the first slots take from ``good``, each slot its best free one."""
    made = {"t": "SELECT * FROM good WHERE false"}
    for i in range(slots):
        before = list(made)[-1]
        made[f"t{i}"] = f"""SELECT * FROM {before} UNION ALL (SELECT g.* FROM good g ANTI JOIN {before} p
            ON p.script_id = g.script_id AND p.pos = g.pos WHERE g.slot_idx = {i}
            QUALIFY row_number() OVER (PARTITION BY g.script_id ORDER BY g.score DESC, g.pos) = 1)"""
    return made


_MOST = max(len(s) for s in B.TEMPLATES.values())
_BLUEPRINT = {
    "tmpl": f"SELECT o_orderkey AS script_id, {_TEMPLATE_SQL} AS template FROM orders",
    "slots": _SLOT_ROWS,
    "words": " UNION ALL ".join(f"SELECT '{k}' AS template_key, '{w.lower()}' AS word" for k, ws in B.SLOT_WORDS.items() for w in ws),
    "m": """SELECT modules.*, template, ['开场', '产品特写', '台词金句', '转场', '购买', 'plain'][(script_id + pos * 5) % 6 + 1] AS w
        FROM modules JOIN tmpl USING (script_id)""",
    "good": """SELECT m.script_id, s.block_idx AS slot_idx, m.pos, count(*) AS score FROM m JOIN slots s USING (template)
        JOIN words k USING (template_key) WHERE contains(lower(m.label), k.word) OR contains(lower(m.w), k.word) GROUP BY ALL""",
    **taken(_MOST),
    "b": f"""SELECT tm.script_id, s.block_idx::DOUBLE AS place, 0 AS p, s.name, s.template_key,
          coalesce(m.duration, s.duration) AS duration, CASE WHEN m.pos IS NULL THEN 'missing' ELSE 'matched' END AS status,
          m.id AS source_module, s.required, NULL::DOUBLE AS own
        FROM tmpl tm JOIN slots s USING (template) LEFT JOIN t{_MOST - 1} c ON c.script_id = tm.script_id AND c.slot_idx = s.block_idx
        LEFT JOIN modules m ON m.script_id = c.script_id AND m.pos = c.pos
        UNION ALL SELECT m.script_id, 1000.0 + CASE WHEN template = 'none' THEN pos ELSE start_time END, pos, label, '', duration,
          'passthrough', id, false, CASE WHEN template = 'none' THEN start_time END
        FROM m ANTI JOIN t{_MOST - 1} c ON c.script_id = m.script_id AND c.pos = m.pos WHERE duration > 0""",
    "laid": """SELECT script_id, row_number() OVER w - 1 AS block_idx, name, template_key, coalesce(own, round(coalesce(
          sum(duration) OVER (PARTITION BY script_id ORDER BY place, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2))
          AS start_time, duration, status, source_module, required FROM b WINDOW w AS (PARTITION BY script_id ORDER BY place, p)""",
}


def _clock_sql(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    return f"""CASE WHEN {x} <= 0 THEN '0:00' WHEN {s} >= 3600 THEN {s} // 3600 || ':' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0')
        ELSE CAST({s} // 60 AS VARCHAR) END || CASE WHEN {x} > 0 THEN ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') ELSE '' END"""


#: Blocks with the cells of an export, and the heads of the scripts.
EXPORT_SQL = {
    "blocks": _BLOCKS,
    "cells": f"""SELECT script_id, pos, id, type, kind, label, s, e, d, CAST(pos + 1 AS VARCHAR) AS nr,
          {_clock_sql("s")} || ' → ' || {_clock_sql("e")} AS span, CAST(floor(d + 0.5) AS BIGINT) || 's' AS secs, descr,
          CASE type WHEN 'title' THEN 'center_text' WHEN 'effect' THEN 'overlay' ELSE 'full_screen' END AS layout FROM (
        SELECT *, round(start_time, 2) AS s, round(start_time + duration, 2) AS e, round(duration, 2) AS d,
          CASE WHEN parts = '' THEN CASE type WHEN 'title' THEN '视频开场标题片段' WHEN 'effect' THEN '叠层特效或滤镜'
            ELSE '原始视频高光片段' END ELSE parts END AS descr FROM blocks)""",
    "heads": f"""SELECT *, '共 ' || n || ' 个模块，总时长 ' || {_clock_sql("total")} AS summary FROM (
        SELECT s.script_id, 'script ' || s.script_id AS title, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total FROM scripts s
        LEFT JOIN (SELECT script_id, count(*) AS n, arg_max(e, pos) AS total FROM cells GROUP BY script_id) USING (script_id))""",
}

ORACLE = {
    "b04_assign_slots": with_tables("modules", """SELECT script_id, slot_idx::INTEGER AS slot_idx, pos, score::INTEGER AS score
        FROM t2""", worded=_WORDED, sc=_SCORES, good="SELECT * FROM sc WHERE score >= 1", **taken(3)),
    "b05_merge_blueprint": with_tables("modules", "SELECT * FROM laid", **_BLUEPRINT),
    "b05_blueprint_summary": with_tables("modules", """SELECT script_id, count(*) AS block_count,
        round(sum(duration), 2) AS total_duration, count(*) FILTER (status = 'matched') AS matched,
        count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'passthrough') AS passthrough,
        coalesce(string_agg(name, '|' ORDER BY block_idx) FILTER (status = 'missing' AND required), '') AS required_missing
        FROM laid GROUP BY script_id""", **_BLUEPRINT),
    "b01_compose_blocks": with_tables("modules", """SELECT script_id, pos AS "order", id AS module_id, kind AS structure_type,
        round(start_time, 2) AS start_time, round(start_time + duration, 2) AS end_time,
        CASE WHEN parts = '' THEN CASE type WHEN 'title' THEN '视频开场标题片段' WHEN 'effect' THEN '叠层特效或滤镜'
          ELSE '原始视频高光片段' END ELSE parts END AS content_description,
        CASE type WHEN 'title' THEN 'center_text' WHEN 'effect' THEN 'overlay' ELSE 'full_screen' END AS layout,
        CASE type WHEN 'title' THEN 'fade_in' WHEN 'effect' THEN 'scale_up' END AS animation,
        CASE type WHEN 'title' THEN label END AS text FROM blocks""", blocks=_BLOCKS),
    "b02_compose_summary": with_tables("modules", """SELECT script_id, count(*) AS block_count,
        round(arg_max(start_time + duration, pos), 2) AS total_duration, count(*) FILTER (kind = 'opening') AS n_opening,
        count(*) FILTER (kind = 'highlight') AS n_highlight, count(*) FILTER (kind = 'effect') AS n_effect
        FROM blocks GROUP BY script_id""", blocks=_BLOCKS),
    "b02_compose_tracks": with_tables("modules", """SELECT script_id, type AS module_type, row_number() OVER (PARTITION BY
        script_id ORDER BY CASE type WHEN 'title' THEN 0 WHEN 'video_segment' THEN 1 ELSE 5 END) - 1 AS track,
        count(*) AS n_blocks FROM modules GROUP BY script_id, type"""),
    "b03_match_scores": with_tables("modules", "SELECT script_id, slot_idx, pos, score::BIGINT AS score FROM sc WHERE score >= 1",
                                    worded=_WORDED, sc=_SCORES),
    "b06_material_gaps": f"""SELECT script_id, dimension, CASE WHEN f = 'A' THEN 'mine' ELSE CASE dimension
        WHEN 'shot_rhythm' THEN '镜头素材' WHEN 'subtitle_style' THEN '字幕样式' WHEN 'visual_style' THEN '画面包装'
        WHEN 'transition' THEN '转场预设' ELSE 'BGM 音频' END END AS label,
        CASE WHEN f = 'R' THEN 'matched' ELSE 'missing' END AS status, CASE dimension WHEN 'shot_rhythm' THEN 'video/*,image/*'
        WHEN 'subtitle_style' THEN '.ttf,.otf,.woff,.json' WHEN 'visual_style' THEN 'image/*,.psd,.json'
        WHEN 'transition' THEN '.json,.mp4' ELSE 'audio/*' END AS accept FROM ({_GAPS})""",
    "b06_material_coverage": f"""SELECT script_id, count(*) AS total, count(*) FILTER (f = 'R' OR dimension = 'music_sync')
        AS matched, count(*) FILTER (f <> 'R') AS missing, CAST(floor(count(*) FILTER (f = 'R' OR dimension = 'music_sync')
        / count(*) * 100 + 0.5) AS BIGINT) AS coverage FROM ({_GAPS}) WHERE true GROUP BY script_id""",
    "b07_blank_blueprint": f"""SELECT o_orderkey AS script_id, s.template, block_idx, name, template_key,
        coalesce(st, 0.0) AS start_time, duration, 'missing' AS status, required
        FROM orders JOIN (SELECT *, sum(duration) OVER (PARTITION BY template ORDER BY block_idx ROWS BETWEEN UNBOUNDED
        PRECEDING AND 1 PRECEDING) AS st FROM ({_SLOT_ROWS})) s ON s.template = {_TEMPLATE_SQL}""",
    "j01_job_snapshot": f"""WITH e AS ({_EVENTS}), gone AS (SELECT job_id, max((ts, seq)) AS g FROM e WHERE kind = 'delete'
          GROUP BY job_id), live AS (SELECT e.* FROM e LEFT JOIN gone USING (job_id) WHERE g IS NULL OR (ts, seq) > g)
        SELECT job_id, arg_max(status, (ts, seq)) FILTER (status IS NOT NULL) AS status,
          round(arg_max(progress, (ts, seq)), 6) AS progress,
          CAST(epoch(max(ts) FILTER (kind <> 'heartbeat')) AS BIGINT) AS updated_s,
          CAST(epoch(max(ts) FILTER (kind = 'heartbeat')) AS BIGINT) AS heartbeat_s FROM live GROUP BY job_id""",
    "j02_list_jobs": with_tables("jobs", """SELECT job_id, status, type FROM jobs WHERE status = 'processing'
        ORDER BY updated_at DESC, job_id LIMIT 40 OFFSET 10"""),
    "j03_stale_jobs": with_tables("jobs", """SELECT job_id, round(age, 3) AS age_s FROM beating
        WHERE status IN ('pending', 'processing') AND (back IS NULL OR back > 90)""", beating=_BEATING),
    "j04_active_jobs": with_tables("jobs", """SELECT job_id FROM beating WHERE status IN ('pending', 'processing')
        AND back <= 90""", beating=_BEATING),
    "j05_fail_open_jobs": with_tables("jobs", """SELECT job_id, 'failed' AS status FROM jobs
        WHERE status IN ('pending', 'processing')"""),
    "j06_count_by_status": with_tables("jobs", "SELECT status, count(*) AS n FROM jobs GROUP BY ROLLUP (status)"),
    "j07_expire_jobs": with_tables("jobs", """SELECT job_id, 'delete' AS kind FROM jobs
        WHERE epoch(TIMESTAMP '1998-08-03') - epoch(updated_at) > 24 * 365 * 3600"""),
    "j08_checkpoints": """SELECT job_id, string_agg(stage, '>' ORDER BY f) AS stages, max(l) AS last_us FROM (
        SELECT user_id AS job_id, event_type AS stage, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events
        GROUP BY ALL) GROUP BY job_id""",
    "j09_pending_work": """SELECT video_id, stage, stage_idx FROM (SELECT DISTINCT user_id AS video_id,
          unnest(['view', 'click', 'error', 'signup', 'purchase', 'extra']) AS stage, unnest(range(0, 6)) AS stage_idx
          FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.video_id AND e.event_type = t.stage
          AND e.value > 120)""",
    "j10_job_metrics": """SELECT count(*) AS n_jobs, count(*) FILTER (o_orderstatus = 'P') AS n_failed,
        list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50,
        list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95,
        list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99 FROM orders""",
    "j11_recovery_report": with_tables("jobs", """SELECT namespace, status, CASE namespace WHEN 'export' THEN 'fail' ELSE
        'resume' END AS action, count(*) AS n, round(max(age), 3) AS oldest_s FROM beating
        WHERE status IN ('pending', 'processing') AND (back IS NULL OR back > 90) GROUP BY namespace, status""",
        beating=_BEATING),
    "j12_estimate_eta": with_tables("videos", """SELECT video_id, round(duration_s * 0.3 + duration_s * 0.8
        + video_id % 90 * 0.15 + CASE WHEN video_id % 2 = 0 THEN video_id % 90 * 0.08 ELSE 0 END + duration_s * 0.1, 4)
        AS eta_s FROM videos"""),
    "j13_illegal_transitions": f"""SELECT job_id, seq, p AS from_status, status AS to_status FROM (SELECT *,
        lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS p FROM ({_EVENTS}) WHERE status IS NOT NULL)
        WHERE p IS NOT NULL AND (p, status) NOT IN (('failed', 'processing'), ('completed', 'processing'),
        ('processing', 'completed'), ('processing', 'failed'))""",
}
