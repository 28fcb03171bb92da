"""Queries over sources and sinks: sample tables are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.operators.presets import load_presets
from clipline.plans import adapters as A
from clipline.plans.catalog_jobs import EXPORT_SQL, _composed
from clipline.plans.oracle import with_tables
from clipline.session import scratch
from clipline.sources import media, scripts, stages


def s01(spark, d):
    """Web pages as files: none is a video, so all are rejected."""
    files = A.table(spark, d, "pages").select("html")
    path = scratch(spark, "files")
    files.write.text(path)
    rows = media.media_catalog(spark, path).filter("filename not like '%crc' and filename not like '\\_%'")
    return rows.agg(F.sum("size_bytes").alias("bytes"), F.count_if(F.col("reject_reason") == "unknown container").alias("n_bad"))


def s01b(spark, d):
    """Container detection on the first bytes of page texts and made-up video headers per page."""
    p = A.table(spark, d, "pages")
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("1A45DFA3", "52494646", "000001BA", "000000186674797069736F6D", "00", "000001B3")])
    content = F.concat(F.get(heads, (F.col("page_id") % 6).cast("int")), F.encode("html", "UTF-8"))
    return p.select("page_id", F.substring(F.sha2(content, 256), 1, 16).alias("video_id"),
                    F.coalesce(media.file_format(content), F.lit("none")).alias("format"))


def s02(spark, d):
    docs = A.table(spark, d, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, ".mp4").when(F.col("doc_id") % 3 == 1, ".TXT").otherwise(".png")
    files = docs.select(F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
                        F.col("n_chars").alias("length"))
    return media.list_materials(files, [".mp4", ".png"])


def s03(spark, d):
    v = A.videos(spark, d)
    rate = F.when(F.col("video_id") % 4 == 0, "30000/1001").when(F.col("video_id") % 4 == 1, "25/1").when(
        F.col("video_id") % 4 == 2, "0/0").otherwise("fast")
    stream = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"),
                      (F.col("video_id") % 2 * 640).alias("width"), F.lit(360).alias("height"), rate.alias("r_frame_rate"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(0).cast("long").alias("width"),
                     F.lit(0).alias("height"), F.lit("0/0").alias("r_frame_rate"))
    probe = F.struct(F.struct(F.round("duration_s", 3).cast("string").alias("duration")).alias("format"),
                     F.array(sound, stream).alias("streams"))
    out = media.probe_metadata(v.select("video_id", F.to_json(probe).alias("probe")), "probe")
    return out.select("video_id", "duration_s", F.col("width").cast("long").alias("width"), F.round("fps", 4).alias("fps"), "codec")


def s04(spark, d):
    """Scripts written as JSON documents and read back."""
    from clipline.operators.script import build_scripts
    heads = build_scripts(A.scripts(spark, d).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    path = scratch(spark, "scripts")
    tracks = A.tracks(spark, d).select("script_id", "index", F.lit("t").alias("name"), F.lit("video").alias("type"))
    scripts.write_scripts(heads, A.modules(spark, d), tracks, path)
    s, m, t = scripts.read_scripts(spark, path)
    counts = m.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_modules"), F.max_by("id", "pos").alias("last_id"),
                                        F.sum("duration").alias("total"))
    n_tracks = t.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_tracks"))
    return (s.join(counts, "script_id", "left").join(n_tracks, "script_id", "left")
            .select(F.col("script_id").cast("long").alias("script_id"), "version", F.round("total_duration", 5).alias("total_duration"),
                    "n_modules", "last_id", "total", "n_tracks"))


def s05(spark, d):
    types = A.table(spark, d, "part").select((F.col("p_size") % 20).alias("k"), "p_partkey")
    names = F.array(*[F.lit(r) for r in ("commercial", "gaming", "lecture", "vlog")])
    rows = types.withColumn("video_type", F.get(names, (F.col("k") % 5).cast("int")))
    joined = rows.join(F.broadcast(load_presets(spark)), "video_type")
    return joined.groupBy("video_type").agg(F.count(F.lit(1)).alias("n"), F.max("opening_pct").alias("opening_pct"),
                                            F.max("motion_tolerance").alias("motion_tolerance"))


def s06(spark, d):
    """Cuts saved as a stage, half of the videos again with shifted times, every third again without any."""
    root = scratch(spark, "stages")
    cuts = A.boundaries(spark, d)
    stages.save_stage(cuts, root, "cuts")
    stages.save_stage(cuts.filter("video_id % 2 = 0").withColumn("t_s", F.col("t_s") + 1), root, "cuts")
    stages.save_stage(cuts.limit(0), root, "cuts", A.videos(spark, d).filter("video_id % 3 = 0"))
    assert stages.load_stage(spark, root, "missing") is None
    out = stages.load_stage(spark, root, "cuts")
    return out.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t_s"), 6).alias("first_s"))


def s07(spark, d):
    o = A.table(spark, d, "orders")
    c = A.table(spark, d, "customer").select("c_custkey")
    jobs = c.select(F.col("c_custkey").alias("id"), F.lit("pending").alias("status"), F.lit("/in").alias("video_path"),
                    F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02").alias("updated_at"))
    text = F.when(F.col("o_orderkey") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(
        F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 100 / 100.0).alias("progress"),
        F.col("o_orderpriority").alias("priority"))))
    data = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), text.alias("data_json"))
    return stages.migrate_jobs(jobs, data).select("id", "status", "progress", "result", "input_path", "updated_at")


def s08(spark, d):
    li = A.table(spark, d, "lineitem")
    p = F.col("l_partkey")
    line = F.when(p % 7 == 0, "Press q to stop").otherwise(F.concat(
        F.lit("frame=1 time=00:"), F.lpad((p % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((p % 50).cast("string"), 2, "0"),
        F.lit("."), (p % 90 + 10).cast("string"), F.lit(" bitrate= "), (p % 3000).cast("string"), F.lit(".5kbits/s speed="),
        (p % 4).cast("string"), F.lit(".25x")))
    out = media.parse_progress(li.select("l_partkey", line.alias("line")), "line")
    return out.groupBy("l_partkey").agg(F.max("time_sec").alias("time_sec"), F.max("raw_time").alias("raw_time"),
                                        F.max("bitrate_kbps").alias("bitrate_kbps"), F.max("speed").alias("speed"))


def _export(fmt):
    def query(spark, d):
        titles = A.scripts(spark, d).select("script_id", F.concat(F.lit("script "), F.col("script_id").cast("string")).alias("title"))
        return scripts.export_script(_composed(spark, d), fmt, titles)
    return query


def s10(spark, d):
    heads = A.scripts(spark, d).select("script_id", F.lit("demo").alias("title"), F.lit(1280).alias("width"), F.lit(720).alias("height"),
                                       F.lit(30).alias("fps"), F.floor("total_duration").alias("total_duration"))
    m = A.modules(spark, d).withColumn("start_time", F.floor("start_time")).withColumn("duration", F.floor("duration"))
    out = scripts.timeline_html(m, heads)
    return out.select("script_id", F.col("section").cast("long").alias("section"), "nr", "line")


QUERIES = {
    "s01_media_catalog": s01, "s01_file_format": s01b, "s02_list_materials": s02, "s03_probe_metadata": s03,
    "s04_scripts_json": s04, "s05_load_presets": s05, "s06_stage_store": s06, "s07_migrate_jobs": s07,
    "s08_parse_progress": s08, "s09_export_markdown": _export("markdown"), "s09_export_html": _export("html"),
    "s09_export_srt": _export("srt"), "s09_export_plain": _export("plain"), "s09_export_json": _export("json"),
    "s10_timeline_html": s10,
}

_SRT = "printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"

ORACLE = {
    "s01_file_format": """SELECT page_id, substr(sha256(c), 1, 16) AS video_id, CASE page_id % 6 WHEN 0 THEN 'webm/mkv'
        WHEN 1 THEN 'avi' WHEN 2 THEN 'mpeg' WHEN 3 THEN 'mp4/mov/3gp' WHEN 4 THEN 'none' ELSE 'mpeg' END AS format FROM (
        SELECT page_id, unhex(['1A45DFA3', '52494646', '000001BA', '000000186674797069736F6D', '00', '000001B3'][page_id % 6 + 1])
          || encode(html) AS c FROM pages)""",
    "s02_list_materials": """SELECT CAST(doc_id AS VARCHAR) AS material_id, doc_id || e AS filename, e AS ext,
        n_chars AS size_bytes FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '.mp4' ELSE '.png' END AS e FROM documents
        WHERE doc_id % 3 <> 1)""",
    "s03_probe_metadata": with_tables("videos", """SELECT video_id, round(duration_s, 3) AS duration_s,
        CASE WHEN video_id % 2 = 1 THEN 640 END AS width, CASE video_id % 4 WHEN 0 THEN round(30000 / 1001, 4)
        WHEN 1 THEN 25.0 END AS fps, 'h264' AS codec FROM videos"""),
    "s04_scripts_json": with_tables("modules scripts", """SELECT s.script_id, '1.0.0' AS version,
        round(total_duration, 5) AS total_duration, n_modules, last_id, total, 2::BIGINT AS n_tracks FROM scripts s LEFT JOIN (
        SELECT script_id, count(*) AS n_modules, arg_max(id, pos) AS last_id, sum(duration) AS total FROM modules
        GROUP BY script_id) m USING (script_id)"""),
    "s05_load_presets": """SELECT t AS video_type, count(*) AS n, CASE t WHEN 'commercial' THEN 0.15 WHEN 'gaming' THEN 0.05
        WHEN 'lecture' THEN 0.20 ELSE 0.12 END::DOUBLE AS opening_pct, CASE t WHEN 'commercial' THEN 0.7 WHEN 'gaming' THEN 3.0
        WHEN 'lecture' THEN 0.3 ELSE 1.0 END::DOUBLE AS motion_tolerance FROM (SELECT
        ['commercial', 'gaming', 'lecture', 'vlog'][p_size % 20 % 5 + 1] AS t FROM part) WHERE t IS NOT NULL GROUP BY t""",
    "s06_stage_store": with_tables("cuts", """SELECT video_id, count(*) AS n,
        round(min(t_s + CASE WHEN video_id % 2 = 0 THEN 1 ELSE 0 END), 6) AS first_s FROM cuts WHERE video_id % 3 <> 0 GROUP BY video_id"""),
    "s07_migrate_jobs": """SELECT c_custkey AS id, CASE WHEN k IS NULL OR k % 5 = 0 THEN 'pending' ELSE st END AS status,
        CASE WHEN k IS NULL OR k % 5 = 0 THEN 0.0 ELSE k % 100 / 100.0 END::DOUBLE AS progress,
        CASE WHEN k IS NULL OR k % 5 = 0 THEN '{}' ELSE '{"priority":"' || pr || '"}' END AS result, '/in' AS input_path,
        '2024-01-02' AS updated_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k,
        arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_orderpriority, o_orderkey) AS pr FROM orders GROUP BY o_custkey)
        ON o_custkey = c_custkey""",
    "s08_parse_progress": """SELECT l_partkey, CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 60 * 60.0::DOUBLE + l_partkey % 50
        + CAST('0.' || (l_partkey % 90 + 10) AS DOUBLE) END AS time_sec, CASE WHEN l_partkey % 7 > 0 THEN '00:' ||
        lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 50 AS VARCHAR), 2, '0') || '.'
        || (l_partkey % 90 + 10) END AS raw_time, CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 3000 + 0.5::DOUBLE END AS bitrate_kbps,
        CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 4 + 0.25::DOUBLE END AS speed FROM lineitem GROUP BY l_partkey""",
    "s09_export_markdown": with_tables("modules scripts", """SELECT script_id, i AS line_no, ['# ' || title, '',
          '| # | 类型 | 时间 | 时长 | 描述 |', '|---|------|------|------|------|'][i + 1] AS line
          FROM (SELECT *, unnest(range(0, 4)) AS i FROM heads)
        UNION ALL SELECT script_id, 4 + pos, '| ' || nr || ' | ' || label || ' | ' || span || ' | ' || secs || ' | ' || descr || ' |'
          FROM cells
        UNION ALL SELECT script_id, 4 + n + i, ['', '> ' || summary][i + 1] FROM (SELECT *, unnest(range(0, 2)) AS i FROM heads)""",
        **EXPORT_SQL),
    "s09_export_html": with_tables("modules scripts", """SELECT script_id, i AS line_no, ['<!DOCTYPE html>',
          '<html lang="zh-CN"><head><meta charset="utf-8"><title>' || title || '</title></head>', '<body><h1>' || title || '</h1>',
          '<table><thead><tr><th>#</th><th>类型</th><th>时间</th><th>时长</th><th>描述</th></tr></thead><tbody>'][i + 1] AS line
          FROM (SELECT *, unnest(range(0, 4)) AS i FROM heads)
        UNION ALL SELECT script_id, 4 + pos, '<tr><td>' || nr || '</td><td>' || label || '</td><td>' || span || '</td><td>' || secs
          || '</td><td>' || descr || '</td></tr>' FROM cells
        UNION ALL SELECT script_id, 4 + n + i, ['</tbody></table>', '<p class="summary">' || summary || '</p>', '</body></html>'][i + 1]
          FROM (SELECT *, unnest(range(0, 3)) AS i FROM heads)""", **EXPORT_SQL),
    "s09_export_plain": with_tables("modules scripts", """SELECT script_id, pos * 3 + i AS line_no,
        [nr || '. [' || kind || '] ' || label || ' (' || span || ', ' || secs || ')', '    ' || descr, ''][i + 1] AS line
        FROM (SELECT *, unnest(range(0, 3)) AS i FROM cells)""", **EXPORT_SQL),
    "s09_export_json": with_tables("modules scripts", """SELECT script_id, 0::BIGINT AS line_no, '{"version":"1.0.0","metadata":{"title":"'
          || title || '","total_duration":' || total || ',"block_count":' || n || '},"blocks":[' AS line FROM heads
        UNION ALL SELECT script_id, 1 + pos, '{"order":' || pos || ',"module_id":"' || id || '","module_type":"' || type
          || '","structure_type":"' || kind || '","start_time":' || s || ',"end_time":' || e || ',"duration":' || d || ',"label":"'
          || label || '","content_tags":[' || CASE WHEN (pos + script_id) % 6 < 5 THEN '"' || id || '","' || label || '"' ELSE '' END
          || '],"content_description":"' || descr || '","template_params":{"layout":"' || layout || '"' || CASE type
            WHEN 'title' THEN ',"animation":"fade_in","text":"' || label || '"' WHEN 'effect' THEN ',"animation":"scale_up"'
            ELSE ',"source_start":' || s || ',"source_end":' || e || ',"source_path":""' END || '}}'
          || CASE WHEN pos < n - 1 THEN ',' ELSE '' END FROM cells JOIN heads USING (script_id)
        UNION ALL SELECT script_id, 1 + n, ']}' FROM heads""", **EXPORT_SQL),
    "s09_export_srt": with_tables("modules", f"""SELECT script_id, pos * 4 + i AS line_no, CASE i WHEN 0 THEN CAST(pos + 1 AS VARCHAR)
        WHEN 1 THEN (SELECT {_SRT} FROM (SELECT CAST(floor(round(start_time, 2) * 1000 + 0.5) AS BIGINT) AS ms)) || ' --> ' ||
          (SELECT {_SRT} FROM (SELECT CAST(floor(round(start_time + duration, 2) * 1000 + 0.5) AS BIGINT) AS ms))
        WHEN 2 THEN label ELSE '' END AS line FROM (SELECT *, unnest(range(0, 4)) AS i FROM modules)"""),
    "s10_timeline_html": with_tables("modules scripts", """SELECT script_id, 3::BIGINT AS section, pos AS nr,
          '<div data-module-id="' || id || '" data-type="' || type || '" data-start="' || CAST(floor(start_time) AS DOUBLE) ||
          '" data-duration="' || CAST(floor(duration) AS DOUBLE) || '" data-track-index="' || track_index || '" data-label="' || label
          || '"></div>' AS line FROM modules
        UNION ALL SELECT DISTINCT script_id, 1, track_index, '<div class="track" data-track-index="' || track_index ||
          '" data-track-name="Track ' || track_index || '" data-track-type="video"></div>' FROM modules
        UNION ALL SELECT script_id, 0, 0, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="UTF-8"><title>demo</title></head>'
          || chr(10) || '<body><div class="canvas" style="width:1280px;height:720px" data-fps="30" data-duration="' ||
          CAST(floor(total_duration) AS BIGINT) || '">' FROM scripts
        UNION ALL SELECT script_id, 4, 0, '</div></body></html>' FROM scripts"""),
}
