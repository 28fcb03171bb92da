"""Queries over sliding windows and narrative segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipline.operators import windows as W
from clipline.plans import adapters as A
from clipline.plans.oracle import with_tables
from clipline.session import cut, store


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding_windows(A.videos(spark, d))


def signals_of(spark: SparkSession, d: str, frames: DataFrame | None = None) -> DataFrame:
    """All signals of the sliding windows, from one stored table of numbered events."""
    e = cut(A.numbered_events(spark, d))
    return W.window_signals(
        videos=A.videos(spark, d), curve=e.select("video_id", "idx", "t_s", "value"),
        cuts=A.times_of(e, "click"), texts=A.texts_of(e), silence=A.spans_of(e, "error", 20.0),
        speech=A.spans_of(e, "view", 10.0), frames=frames)


def best_windows(spark: SparkSession, d: str) -> DataFrame:
    """Best segment type of every window that has one."""
    return W.best_type(W.score_windows(signals_of(spark, d), least=0.5), threshold=None)


def narrative_segments(spark: SparkSession, d: str) -> DataFrame:
    """Windows, their signals, type scores and merged segments: the whole inference.

    The scored windows are stored once before they are merged, since the merge
    reads them more than once.
    """
    return W.merge_adjacent(cut(best_windows(spark, d)))


def _flat(segments: DataFrame) -> DataFrame:
    return segments.withColumn("evidence", F.array_join("evidence", "|"))


def w01(spark, d):
    return _windows(spark, d).select("video_id", "win", "start_s", "end_s")


def w02(spark, d):
    z = W.zones(_windows(spark, d))
    return z.select("video_id", "win", "is_opening_zone", "is_closing_zone")


def w03(spark, d):
    c = W.points_in_windows(A.boundaries(spark, d), _windows(spark, d), videos=A.videos(spark, d))
    return c.select("video_id", "win", "cuts", _r("cut_rate"))


def w04(spark, d):
    p = W.peak_ratio(store(A.curve(spark, d)), _windows(spark, d), A.videos(spark, d))
    return p.select("video_id", "win", _r("peak_ratio"))


_WORDS = {"has_one": ["K1"], "has_nine": ["k9", "nine"], "has_none": ["missing"]}


def w05(spark, d):
    f = W.keyword_flags(A.texts(spark, d), _windows(spark, d), _WORDS, A.videos(spark, d))
    return f.select("video_id", "win", *_WORDS)


def w06(spark, d):
    f = W.fading_flag(store(A.curve(spark, d)), _windows(spark, d), A.videos(spark, d))
    return f.select("video_id", "win", "is_fading")


def w07(spark, d):
    e = W.edge_in_span(A.silence(spark, d), _windows(spark, d), videos=A.videos(spark, d))
    return e.select("video_id", "win", "silence_edge")


def w08(spark, d):
    o = W.overlap_seconds(A.speech(spark, d), _windows(spark, d), videos=A.videos(spark, d))
    return o.select("video_id", "win", _r("speech_s"))


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame features played from events: every event is a frame."""
    e = A.media_events(spark, d)
    kind = F.col("event_type")
    return e.select(
        "video_id", "t_s", "us", (F.col("k") % 3).alias("face_count"), (F.col("k") / 1000.0).alias("face_area_ratio"),
        (F.col("value") / 10.0).alias("optical_flow"), (F.col("value") * 2).alias("saturation_mean"),
        (F.col("k") / 500.0).alias("edge_density"), (F.col("value") / 20.0).alias("gray_entropy"),
        (F.col("value") + 5).alias("brightness_mean"), (F.col("k") / 100.0).alias("histogram_distance"),
        F.when(kind == "view", 1).otherwise(0).alias("person_count"),
        F.when(kind == "error", 1).otherwise(0).alias("vehicle_count"),
        F.when(kind == "signup", 1).otherwise(0).alias("animal_count"), F.lit(1).alias("object_count"))


EVENT_FRAMES_SQL = """SELECT video_id, t_s, us, k % 3 AS face_count, k / 1000.0 AS face_area_ratio,
    value / 10.0 AS optical_flow, value * 2 AS saturation_mean, k / 500.0 AS edge_density,
    value / 20.0 AS gray_entropy, value + 5 AS brightness_mean, k / 100.0 AS histogram_distance,
    CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS person_count,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS vehicle_count,
    CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS animal_count, 1 AS object_count FROM ev"""


def w09(spark, d):
    frames = event_frames(spark, d).withColumn("idx", F.lit(0))
    f = W.window_features(frames, _windows(spark, d), videos=A.videos(spark, d))
    return f.select("video_id", "win", "has_face", _r("avg_flow"), _r("avg_edge_density"), _r("min_brightness"),
                    _r("max_hist_dist"), "persons", "vehicles", "animals", "objects")


def w11(spark, d):
    return _flat(best_windows(spark, d)).select("video_id", "win", "start_s", "end_s", "structure_type", "sub_type", "confidence",
                              "evidence")


def w10(spark, d):
    signals = signals_of(spark, d, event_frames(spark, d))
    scored = W.score_windows(signals, least=float("-inf"))  # those that have a candidate
    one = scored.select("video_id", "win", F.explode("candidates").alias("c"))
    return one.select("video_id", "win", F.col("c.type").alias("structure_type"),
                      F.round("c.conf", 4).alias("confidence"), F.array_join("c.evidence", "|").alias("evidence"))


def w12(spark, d):
    return _flat(narrative_segments(spark, d))


def w14(spark, d):
    from clipline.operators.presets import with_preset
    types = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.when(F.col("p_size") % 3 == 0, "gaming").when(F.col("p_size") % 3 == 1, "lecture")
        .otherwise(F.col("p_brand")).alias("video_type"))
    return with_preset(types).select("video_id", "opening_pct", "closing_pct", "energy_mult", "motion_tolerance")


def w15(spark, d):
    e = A.media_events(spark, d)
    num = F.col("k").cast("string")
    raw = e.select("video_id", F.when(F.col("event_type") == "view", num)
                   .when(F.col("event_type") == "click", F.concat(F.lit('{"timestamp": '), num, F.lit("}")))
                   .when(F.col("event_type") == "error", F.concat(F.lit('{"start": '), num, F.lit(".5}")))
                   .otherwise(F.lit("{}")).alias("boundary"))
    out = W.normalise_boundaries(raw)
    return out.groupBy("video_id", "t_s").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "w01_sliding_windows": w01, "w02_zones": w02, "w03_points_in_windows": w03, "w04_peak_ratio": w04,
    "w05_keyword_flags": w05, "w06_fading_flag": w06, "w07_edge_in_span": w07, "w08_overlap_seconds": w08,
    "w09_window_features": w09, "w10_score_windows": w10, "w11_best_type": w11, "w12_merge_adjacent": w12,
    "w14_with_preset": w14, "w15_normalise_boundaries": w15,
}

_SLICES = """SELECT w.video_id, w.win, w.start_s, w.duration_s, t.n, t.mean_value,
      greatest(0, least(CAST(trunc(w.start_s / w.duration_s * t.n) AS BIGINT), t.n - 1)) AS i_from,
      greatest(greatest(0, least(CAST(trunc(w.start_s / w.duration_s * t.n) AS BIGINT), t.n - 1)) + 1,
               least(CAST(trunc(w.end_s / w.duration_s * t.n) AS BIGINT), t.n)) AS i_to
    FROM windows w JOIN totals t USING (video_id)"""
_PEAKS = """SELECT s.video_id, s.win,
      CASE WHEN max(s.mean_value) > 0 THEN max(c.value) / max(s.mean_value) ELSE 1.0 END AS peak_ratio
    FROM slices s JOIN curve c ON c.video_id = s.video_id AND c.idx >= s.i_from AND c.idx < s.i_to
    GROUP BY s.video_id, s.win"""
_CUTS = """SELECT w.video_id, w.win, count(c.t_s) AS cuts FROM windows w LEFT JOIN cuts c
    ON c.video_id = w.video_id AND c.t_s >= w.start_s AND c.t_s <= w.end_s GROUP BY w.video_id, w.win"""
_EDGES = """SELECT w.video_id, w.win, coalesce(bool_or(s.start_s IS NOT NULL), false) AS silence_edge
    FROM windows w LEFT JOIN silence s ON s.video_id = w.video_id
      AND ((w.start_s >= s.start_s AND w.start_s <= s.end_s) OR (w.end_s >= s.start_s AND w.end_s <= s.end_s))
    GROUP BY w.video_id, w.win"""
_SPEECH = """SELECT w.video_id, w.win,
      coalesce(sum(CASE WHEN s.start_s IS NOT NULL
        THEN least(s.end_s, w.end_s) - greatest(s.start_s, w.start_s) END), 0.0) AS speech_s
    FROM windows w LEFT JOIN speech s ON s.video_id = w.video_id
      AND greatest(s.start_s, w.start_s) < least(s.end_s, w.end_s) GROUP BY w.video_id, w.win"""
_FADE = """SELECT *, greatest(s0 + 2, least(least(raw0 + CAST(trunc(n * 0.05) AS BIGINT), n), n)) AS e0 FROM (
    SELECT w.video_id, w.win, w.start_s, w.duration_s, t.n,
      CAST(trunc(w.start_s / w.duration_s * t.n) AS BIGINT) AS raw0,
      greatest(0, least(CAST(trunc(w.start_s / w.duration_s * t.n) AS BIGINT), t.n - 2)) AS s0
    FROM windows w JOIN totals t USING (video_id))"""
_FADING = """SELECT f.video_id, f.win, CASE WHEN f.start_s < f.duration_s * 0.8 THEN false
      WHEN f.n < 4 THEN f.start_s > f.duration_s * 0.9
      WHEN (a.value + b.value) / 2 > 0 THEN (c.value + e.value) / 2 < (a.value + b.value) / 2 * 0.7
      ELSE true END AS is_fading
    FROM fade f
    LEFT JOIN curve a ON a.video_id = f.video_id AND a.idx = f.s0
    LEFT JOIN curve b ON b.video_id = f.video_id AND b.idx = f.s0 + 1
    LEFT JOIN curve c ON c.video_id = f.video_id AND c.idx = f.e0 - 2
    LEFT JOIN curve e ON e.video_id = f.video_id AND e.idx = f.e0 - 1"""
_FEATURES = """SELECT w.video_id, w.win, coalesce(sum(f.face_count), 0) > 0 AS has_face,
      coalesce(avg(f.face_area_ratio), 0.0) AS avg_face_ratio, coalesce(avg(f.optical_flow), 0.0) AS avg_flow,
      coalesce(avg(f.optical_flow), 99.0) AS avg_flow_or_high,
      coalesce(avg(f.saturation_mean), 0.0) AS avg_saturation,
      coalesce(avg(f.edge_density), 0.0) AS avg_edge_density,
      coalesce(min(f.brightness_mean), 255.0) AS min_brightness,
      coalesce(max(f.histogram_distance), 0.0) AS max_hist_dist,
      CAST(coalesce(sum(f.person_count), 0) AS BIGINT) AS persons,
      CAST(coalesce(sum(f.vehicle_count), 0) AS BIGINT) AS vehicles,
      CAST(coalesce(sum(f.animal_count), 0) AS BIGINT) AS animals,
      CAST(coalesce(sum(f.object_count), 0) AS BIGINT) AS objects
    FROM windows w LEFT JOIN frames_ f ON f.video_id = w.video_id AND f.t_s >= w.start_s AND f.t_s <= w.end_s
    GROUP BY w.video_id, w.win"""
_NO_FEATURES = """SELECT video_id, win, false AS has_face, 0.0 AS avg_face_ratio, 0.0 AS avg_flow,
      99.0 AS avg_flow_or_high, 0.0 AS avg_saturation, 0.0 AS avg_edge_density, 255.0 AS min_brightness,
      0.0 AS max_hist_dist, 0 AS persons, 0 AS vehicles, 0 AS animals FROM windows"""
# The vlog preset: opening .12, closing .12, energy 1.5, cut 1.0, text .6, audio .9, objects .8.
# No sample text holds one of the opening, highlight, closing or transition words.
_SCORES = """SELECT s.*,
      CASE WHEN start_s < duration_s * 0.12 AND start_s < 5.0 THEN
        least(CASE WHEN g2 THEN 0.04 ELSE 0 END + least(CASE WHEN b2 THEN 0.04 ELSE 0 END
          + least(CASE WHEN talk THEN 0.06 ELSE 0 END + 0.80, 0.95), 0.95), 0.95) END AS c_opening,
      CASE WHEN hl > 0.3 THEN least(hl, 0.95) END AS c_highlight,
      CASE WHEN tr > 0.35 THEN least(tr, 0.90) END AS c_transition,
      CASE WHEN len < 3.0 AND (peak_ratio > 2.0 OR rate > 3) THEN
        least(least(CASE WHEN avg_saturation > 150 THEN 0.08 ELSE 0 END
          + least(CASE WHEN avg_flow > 25.0 THEN 0.10 ELSE 0 END + (0.65 + least(peak_ratio * 0.05, 0.15)),
                  CASE WHEN avg_flow > 25.0 THEN 0.90 ELSE 9 END),
          CASE WHEN avg_saturation > 150 THEN 0.90 ELSE 9 END), 0.90) END AS c_effect,
      CASE WHEN start_s > duration_s * (1.0 - 0.12) THEN
        least(CASE WHEN fo THEN 0.05 ELSE 0 END + least(CASE WHEN is_fading THEN 0.05 ELSE 0 END + 0.80, 0.95), 0.95)
        END AS c_closing,
      concat_ws('|', 'position_first_10pct', CASE WHEN talk THEN 'visual_talking_head' END,
        CASE WHEN b2 THEN 'visual_complex_scene' END,
        CASE WHEN g2 AND has_face THEN 'yolo_talking_head' WHEN g2 THEN 'yolo_crowd_intro' END) AS e_opening,
      concat_ws('|', CASE WHEN h1 THEN printf('energy_peak_%.1fx', peak_ratio) END,
        CASE WHEN h2 THEN printf('cut_rate_%.1f/s', rate) END, CASE WHEN h3 THEN 'high_speech_density' END,
        CASE WHEN h4 THEN 'visual_high_motion' END, CASE WHEN h5 THEN 'visual_vivid_motion' END,
        CASE WHEN h6 THEN 'visual_face_highlight' END, CASE WHEN persons >= 3 THEN 'yolo_crowd_activity' END,
        CASE WHEN vehicles >= 1 THEN 'yolo_vehicle_action' END,
        CASE WHEN animals >= 1 THEN 'yolo_animal_presence' END) AS e_highlight,
      concat_ws('|', CASE WHEN rate > 0.5 THEN printf('scene_switch_%.1f/s', rate) END,
        CASE WHEN silence_edge THEN 'silence_gap' END, CASE WHEN max_hist_dist > 0.5 THEN 'visual_color_shift' END,
        CASE WHEN min_brightness < 20 THEN 'visual_dark_transition' END) AS e_transition,
      concat_ws('|', printf('short_segment_%.1fs', len), CASE WHEN avg_flow > 25.0 THEN 'visual_intense_motion' END,
        CASE WHEN avg_saturation > 150 THEN 'visual_high_saturation' END) AS e_effect,
      concat_ws('|', 'position_last_15pct', CASE WHEN is_fading THEN 'energy_fading' END,
        CASE WHEN fo THEN 'visual_fade_out' END) AS e_closing
    FROM (SELECT q.*,
        CASE WHEN h1 THEN 0.35 ELSE 0 END + CASE WHEN h2 THEN 0.20 ELSE 0 END
        + CASE WHEN h3 THEN 0.10::DOUBLE * 0.9::DOUBLE ELSE 0 END + CASE WHEN h4 THEN 0.15 ELSE 0 END
        + CASE WHEN h5 THEN 0.10 ELSE 0 END + CASE WHEN h6 THEN 0.05 ELSE 0 END
        + CASE WHEN persons >= 3 THEN 0.08::DOUBLE * 0.8::DOUBLE ELSE 0 END
        + CASE WHEN vehicles >= 1 THEN 0.05::DOUBLE * 0.8::DOUBLE ELSE 0 END
        + CASE WHEN animals >= 1 THEN 0.03::DOUBLE * 0.8::DOUBLE ELSE 0 END AS hl,
        CASE WHEN rate > 0.5 THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN silence_edge THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN max_hist_dist > 0.5 THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN min_brightness < 20 THEN 0.10::DOUBLE ELSE 0 END AS tr
      FROM (SELECT p.*, peak_ratio > 1.8::DOUBLE * 1.5::DOUBLE AS h1, rate > 2 AS h2,
          speech_s / greatest(len, 0.1) > 0.7 AS h3, avg_flow > 15.0 AS h4,
          avg_saturation > 100 AND avg_flow > 8.0 AS h5, has_face AND avg_face_ratio > 0.12 AS h6,
          has_face AND avg_face_ratio > 0.08 AS talk, avg_edge_density > 0.15 AND NOT has_face AS b2,
          persons >= 2 AS g2, min_brightness < 25 AND avg_flow_or_high < 3.0 AS fo
        FROM (SELECT w.video_id, w.win, w.start_s, w.end_s, w.duration_s, w.end_s - w.start_s AS len,
            CASE WHEN w.end_s - w.start_s > 0 THEN c.cuts / (w.end_s - w.start_s) ELSE 0.0 END AS rate,
            coalesce(p.peak_ratio, 1.0) AS peak_ratio, e.silence_edge, s.speech_s,
            coalesce(f.is_fading, false) AS is_fading, x.* EXCLUDE (video_id, win)
          FROM windows w JOIN wcuts c USING (video_id, win) LEFT JOIN peaks p USING (video_id, win)
          JOIN edges e USING (video_id, win) JOIN wspeech s USING (video_id, win)
          LEFT JOIN fading f USING (video_id, win) JOIN features x USING (video_id, win)) p) q) s"""
_LONG = " UNION ALL ".join(
    f"SELECT video_id, win, start_s, end_s, {i} AS rk, '{t}' AS structure_type, c_{t} AS conf, e_{t} AS evidence "
    f"FROM scores WHERE c_{t} IS NOT NULL"
    for i, t in enumerate(["opening", "highlight", "transition", "effect", "closing"]))
_BEST = """SELECT *, CASE structure_type
      WHEN 'opening' THEN '环境铺垫'
      WHEN 'highlight' THEN CASE
        WHEN motion AND energy AND det THEN '动作高燃' WHEN speech AND NOT motion THEN '台词金句'
        WHEN energy AND NOT motion THEN '情绪峰值' WHEN motion THEN '动作高燃' ELSE '视觉爆发' END
      WHEN 'transition' THEN '硬切' WHEN 'effect' THEN '闪切插入'
      ELSE CASE WHEN contains(evidence, 'energy_fading') THEN '音乐淡出' ELSE '同步淡出' END END AS sub_type
    FROM (SELECT video_id, win, start_s, end_s, structure_type, round(conf, 2) AS confidence, evidence,
        contains(evidence, 'cut_rate_') AS motion, contains(evidence, 'energy_peak_') AS energy,
        contains(evidence, 'high_speech') AS speech, contains(evidence, 'yolo_') AS det
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id, win ORDER BY conf DESC, rk) AS rn FROM long_)
      WHERE rn = 1 AND conf >= 0.5)"""
_SIGNALS = dict(slices=_SLICES, peaks=_PEAKS, wcuts=_CUTS, edges=_EDGES, wspeech=_SPEECH, fade=_FADE, fading=_FADING)
_TABLES = "windows totals cuts silence speech curve"

ORACLE = {
    "w01_sliding_windows": with_tables("windows", "SELECT video_id, win, start_s, end_s FROM windows"),
    "w02_zones": with_tables("windows", """SELECT video_id, win, start_s < duration_s * 0.12 AS is_opening_zone,
        start_s > duration_s * (1.0 - 0.12) AS is_closing_zone FROM windows"""),
    "w03_points_in_windows": with_tables("windows cuts", """SELECT w.video_id, w.win, c.cuts,
        round(CASE WHEN w.end_s - w.start_s > 0 THEN c.cuts / (w.end_s - w.start_s) ELSE 0.0 END, 6) AS cut_rate
        FROM windows w JOIN wcuts c USING (video_id, win)""", wcuts=_CUTS),
    "w04_peak_ratio": with_tables("windows totals", """SELECT w.video_id, w.win,
        round(coalesce(p.peak_ratio, 1.0), 6) AS peak_ratio
        FROM windows w LEFT JOIN peaks p USING (video_id, win)""", slices=_SLICES, peaks=_PEAKS),
    "w05_keyword_flags": with_tables("windows texts", """SELECT w.video_id, w.win,
        coalesce(bool_or(contains(lower(t.text), 'k1')), false) AS has_one,
        coalesce(bool_or(contains(lower(t.text), 'k9') OR contains(lower(t.text), 'nine')), false) AS has_nine,
        coalesce(bool_or(contains(lower(t.text), 'missing')), false) AS has_none
        FROM windows w LEFT JOIN texts t ON t.video_id = w.video_id AND t.t_s >= w.start_s AND t.t_s <= w.end_s
        GROUP BY w.video_id, w.win"""),
    "w06_fading_flag": with_tables("windows totals", "SELECT * FROM fading", fade=_FADE, fading=_FADING),
    "w07_edge_in_span": with_tables("windows silence", "SELECT * FROM edges", edges=_EDGES),
    "w08_overlap_seconds": with_tables("windows speech", """SELECT video_id, win, round(speech_s, 6) AS speech_s
        FROM wspeech""", wspeech=_SPEECH),
    "w09_window_features": with_tables("windows", """SELECT video_id, win, has_face, round(avg_flow, 6) AS avg_flow,
        round(avg_edge_density, 6) AS avg_edge_density, round(min_brightness, 6) AS min_brightness,
        round(max_hist_dist, 6) AS max_hist_dist, persons, vehicles, animals, objects FROM features""",
        frames_=EVENT_FRAMES_SQL, features=_FEATURES),
    "w10_score_windows": with_tables(_TABLES, """SELECT video_id, win, structure_type,
        round(conf, 4) AS confidence, evidence FROM long_""", **_SIGNALS, frames_=EVENT_FRAMES_SQL,
        features=_FEATURES, scores=_SCORES, long_=_LONG),
    "w11_best_type": with_tables(_TABLES, """SELECT video_id, win, start_s, end_s, structure_type, sub_type,
        confidence, evidence FROM best""", **_SIGNALS, features=_NO_FEATURES, scores=_SCORES, long_=_LONG, best=_BEST),
    "w12_merge_adjacent": with_tables(_TABLES, """SELECT m.video_id,
          m.island - 1 AS seg_idx, m.start_s, m.end_s, m.structure_type, m.sub_type, m.confidence, u.evidence
        FROM merged m JOIN evs u USING (video_id, island)""", **_SIGNALS, features=_NO_FEATURES, scores=_SCORES,
        long_=_LONG, best=_BEST,
        flagged="""SELECT *, CASE WHEN p_type = structure_type
              AND abs(p_end - start_s) < CASE p_type WHEN 'highlight' THEN 0.8 ELSE 1.5 END THEN 0 ELSE 1 END AS brk
            FROM (SELECT *, lag(structure_type) OVER w AS p_type, lag(end_s) OVER w AS p_end FROM best
              WINDOW w AS (PARTITION BY video_id ORDER BY win))""",
        runs="""SELECT *, CAST(sum(brk) OVER (PARTITION BY video_id ORDER BY win) AS BIGINT) AS island
            FROM flagged""",
        merged="""SELECT video_id, island, arg_min(start_s, win) AS start_s, arg_max(end_s, win) AS end_s,
              min(structure_type) AS structure_type, arg_min(sub_type, win) AS sub_type,
              max(confidence) AS confidence FROM runs GROUP BY video_id, island""",
        firsts="""SELECT video_id, island, ev, min(win * 100 + i) AS seen_at FROM (
              SELECT video_id, island, win, unnest(string_split(evidence, '|')) AS ev,
                generate_subscripts(string_split(evidence, '|'), 1) AS i FROM runs) GROUP BY video_id, island, ev""",
        evs="SELECT video_id, island, string_agg(ev, '|' ORDER BY seen_at) AS evidence FROM firsts GROUP BY video_id, island"),
    "w14_with_preset": """SELECT p_partkey AS video_id,
        CASE p_size % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.20 ELSE 0.12 END::DOUBLE AS opening_pct,
        CASE p_size % 3 WHEN 0 THEN 0.10 WHEN 1 THEN 0.10 ELSE 0.12 END::DOUBLE AS closing_pct,
        CASE p_size % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 0.8 ELSE 1.5 END::DOUBLE AS energy_mult,
        CASE p_size % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 0.3 ELSE 1.0 END::DOUBLE AS motion_tolerance FROM part""",
    "w15_normalise_boundaries": with_tables("ev", """SELECT video_id, t_s, count(*) AS n FROM (
        SELECT video_id, CASE event_type WHEN 'view' THEN k::DOUBLE WHEN 'click' THEN k::DOUBLE
          WHEN 'error' THEN k + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS t_s FROM ev) GROUP BY video_id, t_s"""),
}
