"""Queries over edit scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.operators import script as S
from clipline.plans import adapters as A
from clipline.plans.oracle import with_tables
from clipline.session import store

_COLUMNS = ["script_id", "pos", "id", "type", "start_time", "duration", "track_index"]
_SQL_COLUMNS = ", ".join(_COLUMNS)


def _out(df):
    return df.select("script_id", "pos", "id", "type", F.round("start_time", 6).alias("start_time"), "duration",
                     "track_index")


def _edits(spark, d, **columns):
    """One edit request per script."""
    return A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("script_id"), *[c.alias(n) for n, c in columns.items()])


def _wanted_id():
    return F.concat(F.lit("m"), (F.col("o_custkey") % 7 + 1).cast("string"))


_ID_SQL = "'m' || (o_custkey % 7 + 1)"


def t01(spark, d):
    m = store(A.modules(spark, d)).withColumn("id", F.when(F.col("pos") % 5 == 3, "").otherwise(F.col("id")))
    return S.ensure_unique_ids(m).select("script_id", "pos", "id")


def t02(spark, d):
    built = S.build_scripts(A.scripts(spark, d))
    return built.select("script_id", "version", "title", "total_duration", "fps", "resolution.width",
                        "resolution.height", F.size("tags").cast("long").alias("n_tags"))


def t03(spark, d):
    new = _edits(spark, d, pos=F.col("o_custkey") % 6, id=F.lit("new"), type=F.lit("audio"), label=F.lit("added"),
                 start_time=F.lit(1.5), duration=F.lit(2.0), track_index=F.lit(0).cast("long"), detail=F.lit(None))
    return _out(S.add_modules(A.modules(spark, d), new))


def t04(spark, d):
    return _out(S.remove_modules(A.modules(spark, d), _edits(spark, d, module_id=_wanted_id()), compact=True))


def t05(spark, d):
    e = _edits(spark, d, module_id=_wanted_id(), new_position=F.col("o_custkey") % 4)
    return _out(S.reorder(A.modules(spark, d), e))


def t05b(spark, d):
    e = _edits(spark, d, module_id=_wanted_id(), to_track=(F.col("o_custkey") % 3).cast("long"),
               insert_index=F.col("o_custkey") % 2)
    return _out(S.move_to_track(A.modules(spark, d), e))


def t06(spark, d):
    e = _edits(spark, d, module_id=_wanted_id(), path=F.when(F.col("o_custkey") % 2 == 0, "duration").otherwise("type"),
               value=F.when(F.col("o_custkey") % 2 == 0, "9.5").otherwise("subtitle"))
    return _out(S.update_param(A.modules(spark, d), e))


def t07(spark, d):
    e = _edits(spark, d, module_id=_wanted_id(), new_id=F.lit("copy"), time_offset=F.lit(-12.0))
    return _out(S.duplicate(A.modules(spark, d), e))


def t08(spark, d):
    return _out(S.shift_all(A.modules(spark, d), -10.5))


def t09(spark, d):
    e = _edits(spark, d, module_id=_wanted_id(), offset=F.lit(-7.25))
    return _out(S.shift_after(A.modules(spark, d), e))


def t10(spark, d):
    return _out(S.compact(A.modules(spark, d)))


def _tables(spark, d):
    return A.scripts(spark, d), A.modules(spark, d), A.tracks(spark, d)


def t11(spark, d):
    s, m, t = _tables(spark, d)
    m = m.withColumn("type", F.when(F.col("detail") == "O", "content").otherwise(F.col("type"))).withColumn(
        "duration", F.col("duration") - 10)
    return S.validate_schema(s, m, t).select("script_id", "module_id", "module_index", "message", "path")


_ISSUE = ["script_id", "severity", "message", "path", "module_id", "module_index", "track_index"]


def t12(spark, d):
    return S.check_continuity(A.modules(spark, d)).select(*_ISSUE)


def t13(spark, d):
    return S.check_overlaps(A.modules(spark, d)).select(*_ISSUE)


def t14(spark, d):
    return S.check_tracks(A.modules(spark, d), A.tracks(spark, d)).select(*_ISSUE)


def t15(spark, d):
    s, m, _ = _tables(spark, d)
    return S.check_duration(s, m).select("script_id", "severity", "message", "path")


def t16(spark, d):
    return S.check_duplicate_ids(A.modules(spark, d)).select("script_id", "message", "path", "module_id",
                                                             "module_index")


def t17(spark, d):
    s, m, t = _tables(spark, d)
    issues = S.validate(s, store(m.drop("label", "detail")), t, columns=["script_id", "rule", "severity"])
    counts = issues.groupBy("script_id").agg(
        *[F.count_if(F.col("rule") == r).alias(f"n_{r}") for r in ("schema", "continuity", "overlap", "track",
                                                                   "duration", "duplicate_id")],
        F.bool_or(F.col("severity") == "error").alias("_wrong"))
    names = [c for c in counts.columns if c.startswith("n_")]
    return (s.select("script_id").join(counts.hint("merge"), "script_id", "left").fillna(0, names)
            .select("script_id", *names, (~F.coalesce("_wrong", F.lit(False))).alias("is_valid")))


def _twins(spark, d):
    """Modules whose start, duration and detail repeat in neighbours."""
    return A.modules(spark, d).withColumn("start_time", F.floor(F.col("start_time") / 60) * 1.0).withColumn(
        "duration", F.lit(1.0))


def t18(spark, d):
    m = S.merge_pairs(_twins(spark, d))
    return m.select("script_id", "pos", "id", F.array_join("merged_types", "+").alias("merged_types"))


def t19(spark, d):
    return S.by_track(A.modules(spark, d)).select("script_id", "track_index", "track_pos", "pos", "id")


def t19b(spark, d):
    s, m, _ = _tables(spark, d)
    return S.total_duration(s, m).select("script_id", F.round("total_duration", 6).alias("total_duration"))


def t20(spark, d):
    m = S.replace_text(A.modules(spark, d), r"part (\d+)1\b", "piece $1x", regex=True, module_type="title")
    return m.select("script_id", "pos", "text", "text_changed")


def t20b(spark, d):
    return S.match_count(A.modules(spark, d), "t 1", module_type="title")


def t21(spark, d):
    m = A.modules(spark, d)
    points = m.select("script_id", F.col("pos").alias("point_id"), (F.col("start_time") + 1.75).alias("at"))
    return S.snap(points, m, 2.0).select("script_id", "point_id", F.round("snapped", 6).alias("snapped"))


def _clips(spark, d):
    return A.modules(spark, d).filter("type != 'effect'")


def t22(spark, d):
    m = A.modules(spark, d)
    marks = m.filter("type = 'effect'").select(
        "script_id", "pos", "start_time", F.when(F.col("detail") == "F", "Dissolve").otherwise(F.lit("circlecrop"))
        .alias("transition_type"))
    return S.attach_transitions(_clips(spark, d), marks, reach=6.0).select("script_id", "gap_idx", "transition_type",
                                                                         "renderer")


def t23(spark, d):
    m = A.modules(spark, d)
    return S.edit_list(m, sourced=F.col("detail") == "O").select("script_id", "clip_idx", "pos", "id")


def t24(spark, d):
    clips = S.edit_list(A.modules(spark, d))
    return S.crossfade_offsets(clips, 0.5).select("script_id", "clip_idx", F.round("offset_s", 6).alias("offset_s"))


def t24b(spark, d):
    s, m, _ = _tables(spark, d)
    return S.padding(S.edit_list(m), s).select("script_id", F.round("pad_s", 6).alias("pad_s"))


def t25(spark, d):
    o = A.table(spark, d, "orders")
    up = o.select(F.col("o_orderkey").alias("script_id"),
                  F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("title"),
                  (F.col("o_custkey") % 3 * 10.0).alias("fps"), F.lit(0.0).alias("total_duration"),
                  (F.col("o_custkey") % 2 * 1280).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    an = o.select(F.col("o_orderkey").alias("script_id"), F.lit("untitled").alias("title"), F.lit(25.0).alias("fps"),
                  F.col("o_totalprice").alias("total_duration"), F.lit(640).alias("width"), F.lit(360).alias("height"))
    out = S.merge_metadata(up, an)
    return out.withColumn("width", F.col("width").cast("long")).withColumn("height", F.col("height").cast("long"))


def _slots(spark, d):
    s, m, _ = _tables(spark, d)
    removed = m.filter("detail = 'F' and type = 'effect'")
    overrides = m.select("script_id", "pos", F.when(F.col("track_index") == 1, "gap").when(
        F.col("track_index") == 2, "fallback").alias("status")).filter("status is not null")
    return S.slot_shares(m, s, overrides, removed)


def t26(spark, d):
    return _slots(spark, d)


def t26b(spark, d):
    return S.slot_coverage(_slots(spark, d))


QUERIES = {
    "t01_ensure_unique_ids": t01, "t02_build_scripts": t02, "t03_add_modules": t03, "t04_remove_modules": t04,
    "t05_reorder": t05, "t05_move_to_track": t05b, "t06_update_param": t06, "t07_duplicate": t07,
    "t08_shift_all": t08, "t09_shift_after": t09, "t10_compact": t10, "t11_validate_schema": t11,
    "t12_check_continuity": t12, "t13_check_overlaps": t13, "t14_check_tracks": t14, "t15_check_duration": t15,
    "t16_check_duplicate_ids": t16, "t17_validate": t17, "t18_merge_pairs": t18, "t19_by_track": t19,
    "t19_total_duration": t19b, "t20_replace_text": t20, "t20_match_count": t20b, "t21_snap": t21,
    "t22_attach_transitions": t22, "t23_edit_list": t23, "t24_crossfade_offsets": t24, "t24_padding": t24b,
    "t25_merge_metadata": t25, "t26_slot_shares": t26, "t26_slot_coverage": t26b,
}

_EDITS = f"SELECT o_orderkey AS script_id, {_ID_SQL} AS module_id, o_custkey AS c FROM orders"
_ANCHOR = """SELECT m.script_id, min(m.pos) AS anchor, any_value(e.c) AS c
    FROM modules m JOIN edits e ON m.script_id = e.script_id AND m.id = e.module_id GROUP BY m.script_id"""
_SIZE = "SELECT script_id, count(*) AS n FROM modules GROUP BY script_id"
_ROUNDED = "script_id, pos, id, type, round(start_time, 6) AS start_time, duration, track_index"
_INDEX = "SELECT script_id, id, max(pos) AS idx FROM modules GROUP BY script_id, id"
_CONT = """SELECT m.*, i.idx, next_start - (start_time + duration) AS delta FROM (SELECT *,
      lead(start_time) OVER w AS next_start, lead(id) OVER w AS next_id FROM modules
      WINDOW w AS (PARTITION BY script_id, track_index ORDER BY start_time, pos)) m JOIN idx i USING (script_id, id)
    WHERE abs(next_start - (start_time + duration)) > 0.01"""
_OVER = """SELECT a.script_id, a.track_index, a.id, b.id AS o_id, a.pos FROM modules a JOIN modules b
      ON a.script_id = b.script_id AND a.track_index = b.track_index AND a.pos < b.pos
      AND a.start_time < b.start_time + b.duration AND b.start_time < a.start_time + a.duration"""
_LOST = "SELECT * FROM modules WHERE track_index NOT IN (0, 1)"
_DUR = """SELECT s.script_id, s.total_duration, e.ending FROM scripts s JOIN (SELECT script_id,
      max(start_time + duration) AS ending FROM modules GROUP BY script_id) e USING (script_id)
    WHERE abs(ending - total_duration) > 0.1"""
_DUP = """SELECT m.*, f.first_pos FROM modules m JOIN (SELECT script_id, id, min(pos) AS first_pos FROM modules
      GROUP BY script_id, id) f USING (script_id, id) WHERE m.pos > f.first_pos"""
_MOVE_SQL = """CASE WHEN a.anchor IS NULL THEN m.pos WHEN m.pos = a.anchor THEN a.dest
      WHEN m.pos > a.anchor AND m.pos <= a.dest THEN m.pos - 1
      WHEN m.pos < a.anchor AND m.pos >= a.dest THEN m.pos + 1 ELSE m.pos END"""
_TWINS = """SELECT script_id, pos, id, type, floor(start_time / 60) AS s, detail AS x FROM modules"""
_CLIPS = """SELECT script_id, pos, start_time, duration FROM modules WHERE type <> 'effect'"""
_GAPS = """SELECT script_id, gap_idx, (start_time + duration + nxt) / 2 AS mid FROM (SELECT *,
      row_number() OVER w - 1 AS gap_idx, lead(start_time) OVER w AS nxt FROM clips
      WINDOW w AS (PARTITION BY script_id ORDER BY start_time, pos)) WHERE nxt IS NOT NULL"""
_EDIT_LIST = """SELECT m.*, row_number() OVER (PARTITION BY m.script_id ORDER BY start_time, pos) - 1 AS clip_idx
    FROM modules m JOIN (SELECT script_id, coalesce(min(CASE WHEN type = 'video_segment' {src} THEN track_index END), 0)
      AS p FROM modules GROUP BY script_id) t ON m.script_id = t.script_id AND m.track_index = t.p
    WHERE type IN ('video_segment', 'title', 'subtitle') AND duration > 0"""
_SLOTS = """SELECT m.script_id, m.pos, m.label, CAST(floor(m.start_time / tt * 100 + 0.5) AS BIGINT) AS start_percent,
      greatest(1, CAST(floor((m.start_time + m.duration - m.start_time) / tt * 100 + 0.5) AS BIGINT)) AS width_percent,
      CASE track_index WHEN 1 THEN 'gap' WHEN 2 THEN 'fallback' ELSE 'filled' END AS status
    FROM modules m JOIN (SELECT script_id, CASE WHEN total_duration > 0 THEN total_duration ELSE 1.0 END AS tt
      FROM scripts) s USING (script_id) WHERE NOT (detail = 'F' AND type = 'effect')"""

ORACLE = {
    "t01_ensure_unique_ids": with_tables("modules", """SELECT script_id, pos, CASE WHEN bad = 1 THEN
          'mod_' || lpad(CAST(CAST(sum(bad) OVER (PARTITION BY script_id ORDER BY pos) AS BIGINT) AS VARCHAR), 4, '0')
          ELSE id END AS id FROM (SELECT *, CASE WHEN id = '' OR pos > min(pos) OVER (PARTITION BY script_id, id)
          THEN 1 ELSE 0 END AS bad FROM blanked)""",
        blanked="SELECT script_id, pos, CASE WHEN pos % 5 = 3 THEN '' ELSE id END AS id FROM modules"),
    "t02_build_scripts": with_tables("scripts", """SELECT script_id, '1.0.0' AS version, 'Untitled Project' AS title,
        total_duration, 30.0::DOUBLE AS fps, 1920 AS width, 1080 AS height, 0::BIGINT AS n_tags FROM scripts"""),
    "t03_add_modules": with_tables("modules", """SELECT m.script_id, m.pos + CASE WHEN m.pos >= p.at_pos THEN 1
          ELSE 0 END AS pos, id, type, round(start_time, 6) AS start_time, duration, track_index
        FROM modules m LEFT JOIN placed p USING (script_id)
        UNION ALL SELECT script_id, at_pos, 'new', 'audio', 1.5, 2.0, 0 FROM placed""",
        size_=_SIZE, placed="""SELECT o_orderkey AS script_id, least(o_custkey % 6, coalesce(n, 0)) AS at_pos
        FROM orders LEFT JOIN size_ ON script_id = o_orderkey"""),
    "t04_remove_modules": with_tables("modules", """SELECT m.script_id, m.pos - CAST(gone AS BIGINT) AS pos, id, type,
          round(CASE WHEN m.track_index = r.rt AND start_time > r.rs THEN greatest(0.0, start_time - r.rd)
            ELSE start_time END, 6) AS start_time, duration, m.track_index
        FROM (SELECT *, sum(hit) OVER (PARTITION BY script_id ORDER BY pos) AS gone FROM marked) m
        LEFT JOIN removed r USING (script_id) WHERE hit = 0""", edits=_EDITS,
        marked="""SELECT m.*, CASE WHEN m.id = e.module_id THEN 1 ELSE 0 END AS hit FROM modules m
          LEFT JOIN edits e USING (script_id)""",
        removed="""SELECT script_id, arg_min(track_index, pos) AS rt, arg_min(start_time, pos) AS rs,
          arg_min(duration, pos) AS rd FROM marked WHERE hit = 1 GROUP BY script_id"""),
    "t05_reorder": with_tables("modules", f"""SELECT m.script_id, {_MOVE_SQL} AS pos, id, type,
        round(start_time, 6) AS start_time, duration, track_index FROM modules m LEFT JOIN moves a USING (script_id)""",
        edits=_EDITS, anchors=_ANCHOR, size_=_SIZE,
        moves="SELECT script_id, anchor, least(c % 4, n - 1) AS dest FROM anchors JOIN size_ USING (script_id)"),
    "t05_move_to_track": with_tables("modules", f"""SELECT m.script_id, {_MOVE_SQL} AS pos, id, type,
        round(start_time, 6) AS start_time, duration,
        CASE WHEN m.pos = a.anchor THEN a.to_track ELSE m.track_index END AS track_index
        FROM modules m LEFT JOIN moves a USING (script_id)""",
        edits=_EDITS, anchors=_ANCHOR, size_=_SIZE,
        nth="""SELECT m.script_id, m.pos, a.anchor, row_number() OVER (PARTITION BY m.script_id ORDER BY m.pos) - 1 AS rn,
          a.c FROM modules m JOIN anchors a ON m.script_id = a.script_id AND m.track_index = a.c % 3
          AND m.pos <> a.anchor""",
        moves="""SELECT a.script_id, a.anchor, a.c % 3 AS to_track,
          coalesce(t.pos - CASE WHEN t.pos > a.anchor THEN 1 ELSE 0 END, s.n - 1) AS dest FROM anchors a
          JOIN size_ s USING (script_id) LEFT JOIN nth t ON t.script_id = a.script_id AND t.rn = a.c % 2"""),
    "t06_update_param": with_tables("modules", """SELECT m.script_id, pos, id,
          CASE WHEN pos = anchor AND c % 2 = 1 THEN 'subtitle' ELSE type END AS type,
          round(start_time, 6) AS start_time,
          CASE WHEN pos = anchor AND c % 2 = 0 THEN 9.5 ELSE duration END AS duration, track_index
        FROM modules m LEFT JOIN anchors USING (script_id)""", edits=_EDITS, anchors=_ANCHOR),
    "t07_duplicate": with_tables("modules", """SELECT m.script_id, pos + CASE WHEN pos > anchor THEN 1 ELSE 0 END
          AS pos, id, type, round(start_time, 6) AS start_time, duration, track_index
        FROM modules m LEFT JOIN anchors USING (script_id)
        UNION ALL SELECT m.script_id, pos + 1, 'copy', type, round(greatest(0.0, start_time - 12.0), 6), duration,
          track_index FROM modules m JOIN anchors USING (script_id) WHERE pos = anchor""",
        edits=_EDITS, anchors=_ANCHOR),
    "t08_shift_all": with_tables("modules", """SELECT script_id, pos, id, type,
        round(greatest(0.0, start_time - 10.5), 6) AS start_time, duration, track_index FROM modules"""),
    "t09_shift_after": with_tables("modules", """SELECT m.script_id, pos, id, type,
        round(CASE WHEN pos > anchor THEN greatest(0.0, start_time - 7.25) ELSE start_time END, 6) AS start_time,
        duration, track_index FROM modules m LEFT JOIN anchors USING (script_id)""", edits=_EDITS, anchors=_ANCHOR),
    "t10_compact": with_tables("modules", """SELECT script_id, pos, id, type, round(coalesce(sum(duration) OVER (
        PARTITION BY script_id, track_index ORDER BY start_time, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        0.0), 6) AS start_time, duration, track_index FROM modules"""),
    "t11_validate_schema": with_tables("modules", """SELECT script_id, id AS module_id, pos AS module_index,
          '''content'' is not an allowed module type' AS message, 'modules.' || pos || '.type' AS path
        FROM modules WHERE detail = 'O'
        UNION ALL SELECT script_id, id, pos, 'duration is less than the minimum of 0', 'modules.' || pos || '.duration'
        FROM modules WHERE duration - 10 < 0
        UNION ALL SELECT o_orderkey, NULL, NULL, 'modules should be non-empty', 'modules' FROM orders
        WHERE o_orderkey NOT IN (SELECT script_id FROM modules)"""),
    "t12_check_continuity": with_tables("modules", """SELECT script_id,
          CASE WHEN delta < 0 THEN 'error' ELSE 'warning' END AS severity,
          'Track ' || track_index || ': ' || CASE WHEN delta < 0 THEN 'overlap of ' ELSE 'gap of ' END
            || printf('%.2f', abs(delta)) || 's between ''' || id || ''' and ''' || next_id || '''' AS message,
          'modules.' || id AS path, id AS module_id, idx AS module_index, track_index FROM cont""",
        idx=_INDEX, cont=_CONT),
    "t13_check_overlaps": with_tables("modules", """SELECT script_id, 'error' AS severity,
          'Track ' || track_index || ': overlap between ''' || id || ''' and ''' || o_id || '''' AS message,
          'modules.' || id AS path, id AS module_id, idx AS module_index, track_index
        FROM over_ JOIN idx USING (script_id, id)""", idx=_INDEX, over_=_OVER),
    "t14_check_tracks": with_tables("modules", """SELECT script_id, 'warning' AS severity,
          'Module ''' || id || ''' references undefined track ' || track_index AS message,
          'modules.' || id || '.track_index' AS path, id AS module_id, idx AS module_index, track_index
        FROM lost JOIN idx USING (script_id, id)""", idx=_INDEX, lost=_LOST),
    "t15_check_duration": with_tables("modules scripts", """SELECT script_id, 'warning' AS severity,
          'Declared total_duration (' || printf('%.1f', total_duration) || 's) differs from actual timeline end ('
          || printf('%.1f', ending) || 's)' AS message, 'metadata.total_duration' AS path FROM dur""", dur=_DUR),
    "t16_check_duplicate_ids": with_tables("modules", """SELECT script_id,
          'Duplicate module id ''' || id || ''' at indices ' || first_pos || ' and ' || pos AS message,
          'modules[' || pos || '].id' AS path, id AS module_id, pos AS module_index FROM dup""", dup=_DUP),
    "t17_validate": with_tables("modules scripts", """SELECT o_orderkey AS script_id, coalesce(e.n, 0) AS n_schema,
          coalesce(c.n, 0) AS n_continuity, coalesce(v.n, 0) AS n_overlap, coalesce(l.n, 0) AS n_track,
          coalesce(t.n, 0) AS n_duration, coalesce(p.n, 0) AS n_duplicate_id,
          e.n IS NULL AND NOT coalesce(c.bad, false) AND v.n IS NULL AND p.n IS NULL AS is_valid
        FROM orders
        LEFT JOIN (SELECT o_orderkey AS k, 1 AS n FROM orders WHERE o_orderkey NOT IN (SELECT script_id FROM modules)) e
          ON e.k = o_orderkey
        LEFT JOIN (SELECT script_id, count(*) AS n, bool_or(delta < 0) AS bad FROM cont GROUP BY script_id) c
          ON c.script_id = o_orderkey
        LEFT JOIN (SELECT script_id, count(*) AS n FROM over_ GROUP BY script_id) v ON v.script_id = o_orderkey
        LEFT JOIN (SELECT script_id, count(*) AS n FROM lost GROUP BY script_id) l ON l.script_id = o_orderkey
        LEFT JOIN (SELECT script_id, count(*) AS n FROM dur GROUP BY script_id) t ON t.script_id = o_orderkey
        LEFT JOIN (SELECT script_id, count(*) AS n FROM dup GROUP BY script_id) p ON p.script_id = o_orderkey""",
        idx=_INDEX, cont=_CONT, over_=_OVER, lost=_LOST, dur=_DUR, dup=_DUP),
    "t18_merge_pairs": with_tables("modules", """SELECT script_id, min(pos) AS pos, arg_min(id, pos) AS id,
          CASE WHEN count(*) = 2 THEN arg_min(type, pos) || '+' || arg_max(type, pos) ELSE min(type) END AS merged_types
        FROM (SELECT *, (pos - min(pos) OVER (PARTITION BY script_id, run)) // 2 AS pair FROM (
          SELECT *, sum(brk) OVER (PARTITION BY script_id ORDER BY pos) AS run FROM (
            SELECT *, CASE WHEN lag(s) OVER w = s AND lag(x) OVER w = x THEN 0 ELSE 1 END AS brk FROM twins
            WINDOW w AS (PARTITION BY script_id ORDER BY pos)))) GROUP BY script_id, run, pair""", twins=_TWINS),
    "t19_by_track": with_tables("modules", """SELECT script_id, track_index, row_number() OVER (
        PARTITION BY script_id, track_index ORDER BY start_time, pos) - 1 AS track_pos, pos, id FROM modules"""),
    "t19_total_duration": with_tables("modules", """SELECT o_orderkey AS script_id,
        round(coalesce(max(start_time + duration), 60.0), 6) AS total_duration
        FROM orders LEFT JOIN modules ON script_id = o_orderkey GROUP BY o_orderkey"""),
    "t20_replace_text": with_tables("modules", r"""SELECT script_id, pos, text, text <> label AS text_changed FROM (
        SELECT *, CASE WHEN type = 'title' THEN regexp_replace(label, 'part (\d+)1\b', 'piece \1x', 'g') ELSE label END
        AS text FROM modules)"""),
    "t20_match_count": with_tables("modules", """SELECT script_id, count(*) FILTER (type = 'title' AND
        contains(label, 't 1')) AS matches FROM modules GROUP BY script_id"""),
    "t21_snap": with_tables("modules", """SELECT p.script_id, p.point_id,
          round(coalesce(arg_min(e.edge, (e.start_time, e.pos, e.side)), any_value(p.at)), 6) AS snapped
        FROM points p LEFT JOIN edges e ON e.script_id = p.script_id AND abs(p.at - e.edge) < 2.0
          AND e.edge >= p.at - 2.0 AND e.edge <= p.at + 2.0 GROUP BY p.script_id, p.point_id""",
        points="SELECT script_id, pos AS point_id, start_time + 1.75 AS at FROM modules",
        edges="""SELECT script_id, start_time, pos, 0 AS side, start_time + duration AS edge FROM modules
          UNION ALL SELECT script_id, start_time, pos, 1, start_time FROM modules"""),
    "t22_attach_transitions": with_tables("modules", """SELECT script_id, gap_idx, arg_max(tt, pos) AS transition_type,
          CASE arg_max(tt, pos) WHEN 'Dissolve' THEN 'fade' ELSE 'circleclamp' END AS renderer
        FROM (SELECT m.script_id, m.pos, min(g.gap_idx) AS gap_idx,
            CASE WHEN min(m.detail) = 'F' THEN 'Dissolve' ELSE 'circlecrop' END AS tt
          FROM modules m JOIN gaps g ON g.script_id = m.script_id AND abs(m.start_time - g.mid) < 6.0
          WHERE m.type = 'effect' GROUP BY m.script_id, m.pos) GROUP BY script_id, gap_idx""", clips=_CLIPS, gaps=_GAPS),
    "t23_edit_list": with_tables("modules", "SELECT script_id, clip_idx, pos, id FROM el",
                                 el=_EDIT_LIST.format(src="AND detail = 'O'")),
    "t24_crossfade_offsets": with_tables("modules", """SELECT script_id, clip_idx, round(off, 6) AS offset_s FROM (
        SELECT *, sum(duration - 0.5) OVER (PARTITION BY script_id ORDER BY clip_idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM el) WHERE clip_idx > 0""",
        el=_EDIT_LIST.format(src="")),
    "t24_padding": with_tables("modules scripts", """SELECT script_id, round(CASE WHEN got > 0 AND
        total_duration > got + 0.5 THEN total_duration - got ELSE 0.0 END, 6) AS pad_s
        FROM scripts JOIN (SELECT script_id, sum(duration) AS got FROM el GROUP BY script_id) USING (script_id)""",
        el=_EDIT_LIST.format(src="")),
    "t25_merge_metadata": """SELECT o_orderkey AS script_id,
        CASE WHEN o_orderstatus = 'F' THEN 'untitled' ELSE o_orderpriority END AS title,
        CASE WHEN o_custkey % 3 = 0 THEN 25.0 ELSE o_custkey % 3 * 10.0 END::DOUBLE AS fps,
        o_totalprice AS total_duration, CASE WHEN o_custkey % 2 = 0 THEN 640 ELSE 1280 END::BIGINT AS width,
        360::BIGINT AS height FROM orders""",
    "t26_slot_shares": with_tables("modules scripts", "SELECT * FROM slots", slots=_SLOTS),
    "t26_slot_coverage": with_tables("modules scripts", """SELECT script_id, count(*) FILTER (status = 'filled')
        AS filled, count(*) FILTER (status <> 'filled') AS gaps, count(*) AS slots,
        CAST(floor(count(*) FILTER (status = 'filled') / count(*) * 100 + 0.5) AS BIGINT) AS coverage_percent
        FROM sl GROUP BY script_id""", sl=_SLOTS),
}
