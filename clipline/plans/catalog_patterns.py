"""Queries over creative patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.operators import patterns as P
from clipline.plans import adapters as A
from clipline.plans.catalog_windows import EVENT_FRAMES_SQL, event_frames
from clipline.plans.oracle import with_tables


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


def _shots(spark, d):
    return P.shots(A.boundaries(spark, d), A.videos(spark, d))


def d01(spark, d):
    return _shots(spark, d).select("video_id", "shot_idx", _r("duration"))


def d02(spark, d):
    return P.duration_hist(_shots(spark, d))


def d03(spark, d):
    return P.rhythm_pattern(_shots(spark, d))


def d04(spark, d):
    return P.rate_by_type(A.boundaries(spark, d), A.segments(spark, d))


def d05(spark, d):
    return P.curve_intensity(A.curve(spark, d).withColumn("value", F.col("value") / 97)).select(
        "video_id", "p25", "p75", "mean", "peak", "variance", "dynamic_ratio")


def ocr_frames(spark, d):
    """Frames with two text regions each, boxes as corners or as one row of four values."""
    e = A.media_events(spark, d).filter("event_type = 'purchase'")
    k = F.col("k").cast("double")
    v = F.col("value")
    corners = F.array(F.array(k, v), F.array(k + 30, v), F.array(k + 30, v + 12), F.array(k, v + 12))
    row = F.array(F.array(k, v * 5, k + 10, F.lit(8.0)))
    first = F.struct(F.concat(F.lit(" k"), F.col("k").cast("string")).alias("text"), corners.alias("bbox"))
    second = F.struct(F.when(F.col("k") % 4 == 0, "  ").otherwise(F.lit("note")).alias("text"), row.alias("bbox"))
    return e.select("video_id", F.col("us").alias("frame_index"), F.when(F.col("k") % 10 == 0, -1.0).otherwise(
        F.col("t_s")).alias("t_s"), F.array(first, second).alias("regions"))


def d06(spark, d):
    t = P.timed_texts(ocr_frames(spark, d))
    return t.select("video_id", "frame_index", F.col("seq").cast("long").alias("seq"), "text", F.round("box.x", 4).alias("x"), F.round("box.y", 4).alias("y"),
                    F.round("box.w", 4).alias("w"), F.round("box.h", 4).alias("h"))


def d07(spark, d):
    return P.position_shares(P.timed_texts(ocr_frames(spark, d)), frame_height=500.0)


def d08(spark, d):
    return P.appearance_timing(A.texts(spark, d), A.speech(spark, d))


def d09(spark, d):
    return P.avg_text_gap(A.texts(spark, d))


def d10(spark, d):
    return P.text_density(A.texts(spark, d), A.segments(spark, d))


def d11(spark, d):
    t = A.texts(spark, d).withColumn("seq", F.lit(0))
    return P.sample_texts(t, A.segments(spark, d))


def d12(spark, d):
    f = event_frames(spark, d).withColumn("brightness_std", F.col("edge_density") * 600)
    return P.color_style(f)


def d13(spark, d):
    return P.composition_pref(event_frames(spark, d))


def d14(spark, d):
    return P.object_rates(event_frames(spark, d))


def d15(spark, d):
    return P.packaging_shares(event_frames(spark, d))


def d16(spark, d):
    return P.brightness_stats(event_frames(spark, d))


def d17(spark, d):
    f = event_frames(spark, d)
    out = P.pick_frames(f.filter("video_id % 3 = 0"), f.select("video_id", "t_s", "face_count"))
    return out.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count("optical_flow").alias("with_flow"))


def d18(spark, d):
    t = P.transition_stats(A.segments(spark, d), A.videos(spark, d))
    share = F.transform(F.array_sort(F.map_entries("type_distribution")),
                        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 3).cast("string")))
    return t.select("video_id", "total_count", "density_per_second", F.array_join(share, ",").alias("shares"))


def d19(spark, d):
    return P.usage_context(A.segments(spark, d)).select("video_id", "sub_type",
                                                       F.array_join("contexts", ",").alias("contexts"))


def d20(spark, d):
    return P.cut_signals(event_frames(spark, d))


def _tempo(spark, d):
    return A.videos(spark, d).select("video_id", (F.col("video_id") % 90 + 60).cast("double").alias("bpm"))


def d21(spark, d):
    return P.beat_alignment(A.boundaries(spark, d), _tempo(spark, d))


def d22(spark, d):
    return P.energy_sections(A.curve(spark, d), A.videos(spark, d)).select("video_id", "section", "start_s", "end_s",
                                                                          "label")


def d23(spark, d):
    return P.energy_cut_corr(A.curve(spark, d), A.boundaries(spark, d), A.videos(spark, d))


def d24(spark, d):
    """All dimensions; videos without speech texts or cuts keep nulls there."""
    v, cuts, frames = A.videos(spark, d), A.boundaries(spark, d), event_frames(spark, d)
    shot_rows = P.shots(cuts, v)
    out = P.deconstruct(
        v, shot_rhythm=P.duration_hist(shot_rows).join(P.rhythm_pattern(shot_rows), "video_id"),
        subtitle_style=P.appearance_timing(A.texts(spark, d), A.speech(spark, d)),
        visual_packaging=P.composition_pref(frames).join(P.packaging_shares(frames), "video_id"),
        transition_pattern=P.transition_stats(A.segments(spark, d), v),
        music_sync=P.beat_alignment(cuts, _tempo(spark, d)))
    return out.select("video_id", F.col("shot_rhythm.shot_count").alias("shot_count"),
                      "shot_rhythm.rhythm_pattern", "subtitle_style.sync_ratio", "visual_packaging.preference",
                      "transition_pattern.total_count", "music_sync.sync_pattern")


QUERIES = {
    "d01_shots": d01, "d02_duration_hist": d02, "d03_rhythm_pattern": d03, "d04_rate_by_type": d04,
    "d05_curve_intensity": d05, "d06_timed_texts": d06, "d07_position_shares": d07, "d08_appearance_timing": d08,
    "d09_avg_text_gap": d09, "d10_text_density": d10, "d11_sample_texts": d11, "d12_color_style": d12,
    "d13_composition_pref": d13, "d14_object_rates": d14, "d15_packaging_shares": d15, "d16_brightness_stats": d16,
    "d17_pick_frames": d17, "d18_transition_stats": d18, "d19_usage_context": d19, "d20_cut_signals": d20,
    "d21_beat_alignment": d21, "d22_energy_sections": d22, "d23_energy_cut_corr": d23, "d24_deconstruct": d24,
}

_SHOTS = """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY s) - 1 AS shot_idx, duration FROM (
      SELECT video_id, coalesce(lag(t_s) OVER w, 0.0) AS s, t_s - coalesce(lag(t_s) OVER w, 0.0) AS duration FROM cuts
      WINDOW w AS (PARTITION BY video_id ORDER BY t_s)
      UNION ALL SELECT video_id, m, duration_s - m FROM videos JOIN (SELECT video_id, max(t_s) AS m FROM cuts
        GROUP BY video_id) USING (video_id)) WHERE duration > 0"""
_HIST = """SELECT video_id, count(*) AS shot_count, round(avg(duration), 2) AS avg_shot_duration,
      round(count(*) FILTER (duration < 1) / count(*), 3) AS under_1s,
      round(count(*) FILTER (duration >= 1 AND duration < 3) / count(*), 3) AS from_1s_to_3s,
      round(count(*) FILTER (duration >= 3 AND duration < 5) / count(*), 3) AS from_3s_to_5s,
      round(count(*) FILTER (duration >= 5) / count(*), 3) AS over_5s FROM shots_ GROUP BY video_id"""
_RHYTHM = """SELECT video_id, CASE
      WHEN n < 6 THEN CASE WHEN al < 1.5 THEN '快切为主' ELSE '均匀' END
      WHEN abs(a - m) / greatest((a + m) / 2, 0.01) < 0.2 AND abs(m - b) / greatest((m + b) / 2, 0.01) < 0.2 THEN '均匀'
      WHEN a < m AND b < m THEN '慢-快-慢' WHEN a > m AND b > m THEN '快-慢-快'
      WHEN al < 1.5 THEN '快切为主' ELSE '均匀' END AS rhythm_pattern FROM (
    SELECT video_id, n, avg(duration) AS al, avg(CASE WHEN shot_idx < k THEN duration END) AS a,
      avg(CASE WHEN shot_idx >= k AND shot_idx < 2 * k THEN duration END) AS m,
      avg(CASE WHEN shot_idx >= 2 * k THEN duration END) AS b FROM (
      SELECT *, count(*) OVER (PARTITION BY video_id) AS n,
        greatest(1, count(*) OVER (PARTITION BY video_id) // 3) AS k FROM shots_) GROUP BY video_id, n)"""
_RATE = """SELECT video_id, structure_type, max(round(n / greatest(end_s - start_s, 0.01), 3)) AS {name} FROM (
      SELECT s.video_id, s.seg_idx, s.structure_type, s.start_s, s.end_s, count(p.t_s) AS n FROM segments s
      LEFT JOIN {points} p ON p.video_id = s.video_id AND p.t_s >= s.start_s AND p.t_s <= s.end_s
      GROUP BY ALL) GROUP BY video_id, structure_type"""
_OCR = """SELECT video_id, us AS frame_index, 0::BIGINT AS seq, 'k' || k AS text, k::DOUBLE AS x, value AS y,
      30.0::DOUBLE AS w, (value + 12) - value AS h FROM ev WHERE event_type = 'purchase' AND k % 10 <> 0
    UNION ALL SELECT video_id, us, 1, 'note', k, value * 5, k + 10, 8.0 FROM ev
    WHERE event_type = 'purchase' AND k % 10 <> 0 AND k % 4 <> 0"""
_TIMING = """SELECT video_id,
      round(coalesce(sum(delay) / nullif(count(delay), 0), 0.0), 2) AS avg_delay_after_speech,
      round(count(*) FILTER (sync) / count(*), 3) AS sync_ratio,
      round(count(*) FILTER (leads) / count(*), 3) AS lead_ratio FROM (
    SELECT video_id, fs IS NOT NULL AS sync,
      fs IS NULL AND nx IS NOT NULL AND (en IS NULL OR nx - t_s < t_s - en) AS leads,
      CASE WHEN fs IS NOT NULL THEN greatest(t_s - fs, 0.0)
        WHEN nx IS NOT NULL AND (en IS NULL OR nx - t_s < t_s - en) THEN NULL ELSE t_s - en END AS delay FROM (
      SELECT t.video_id, t.t_s, min(CASE WHEN s.start_s <= t.t_s AND s.end_s >= t.t_s THEN s.start_s END) AS fs,
        max(CASE WHEN s.start_s <= t.t_s THEN s.end_s END) AS en, min(CASE WHEN s.start_s > t.t_s THEN s.start_s END) AS nx
      FROM texts t LEFT JOIN speech s ON s.video_id = t.video_id GROUP BY t.video_id, t.t_s)) GROUP BY video_id"""
_COMP = """SELECT video_id, CASE WHEN f > 0.4 AND a > 0.05 THEN '中心构图（人物主导）'
      WHEN e < 0.04 AND f < 0.2 THEN '简洁留白' WHEN e > 0.12 THEN '密集构图' ELSE '均衡构图' END AS preference,
      round(f, 3) AS face_frame_ratio, round(a, 4) AS avg_face_area, round(e, 4) AS avg_edge_density FROM (
    SELECT video_id, avg(CASE WHEN face_count > 0 THEN 1.0 ELSE 0.0 END) AS f, avg(face_area_ratio) AS a,
      avg(edge_density) AS e FROM frames_ GROUP BY video_id)"""
_TRANS = """SELECT v.video_id, coalesce(n, 0)::BIGINT AS total_count,
      round(coalesce(n, 0) / greatest(duration_s, 0.01), 3) AS density_per_second, shares
    FROM (SELECT DISTINCT video_id FROM segments) JOIN videos v USING (video_id) LEFT JOIN (
      SELECT video_id, sum(c) AS n, string_agg(sub_type || '=' || CAST(round(c / t, 3) AS VARCHAR), ',' ORDER BY sub_type)
        AS shares FROM (SELECT video_id, sub_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY video_id) AS t
        FROM segments WHERE structure_type IN ('transition', 'effect') GROUP BY video_id, sub_type) GROUP BY video_id)
      USING (video_id)"""
_BEAT = """SELECT video_id, bpm, round(60.0 / bpm, 3) AS beat_interval, round(r, 3) AS sync_density,
      CASE WHEN r > 0.7 THEN '强拍对齐' WHEN r > 0.3 THEN '弱对齐' ELSE '无对齐' END AS sync_pattern,
      round(m, 3) AS avg_offset_from_beat FROM (
    SELECT video_id, bpm, avg(CASE WHEN o < 0.08 THEN 1.0 ELSE 0.0 END) AS r, avg(o) AS m FROM (
      SELECT video_id, bpm, abs(t_s - round_even(t_s / (60.0 / bpm), 0) * (60.0 / bpm)) AS o FROM (
        SELECT *, CAST(video_id % 90 + 60 AS DOUBLE) AS bpm FROM cuts)) GROUP BY video_id, bpm)"""

ORACLE = {
    "d01_shots": with_tables("cuts videos", "SELECT video_id, shot_idx, round(duration, 6) AS duration FROM shots_",
                             shots_=_SHOTS),
    "d02_duration_hist": with_tables("cuts videos", _HIST, shots_=_SHOTS),
    "d03_rhythm_pattern": with_tables("cuts videos", _RHYTHM, shots_=_SHOTS),
    "d04_rate_by_type": with_tables("segments cuts", _RATE.format(name="rate", points="cuts")),
    "d05_curve_intensity": with_tables("curve", """SELECT video_id, round(quantile_cont(v, 0.25), 4) AS p25,
        round(quantile_cont(v, 0.75), 4) AS p75, round(avg(v), 4) AS mean, round(max(v), 4) AS peak,
        round(var_pop(v), 6) AS variance, round(count(*) FILTER (v > 0.1) / count(*), 3) AS dynamic_ratio
        FROM (SELECT video_id, value / 97 AS v FROM curve) GROUP BY video_id"""),
    "d06_timed_texts": with_tables("ev", """SELECT video_id, frame_index, seq, text, round(x, 4) AS x, round(y, 4) AS y,
        round(w, 4) AS w, round(h, 4) AS h FROM ocr""", ocr=_OCR),
    "d07_position_shares": with_tables("ev", """SELECT video_id, round(count(*) FILTER (c < 0.33) / count(*), 3) AS top,
        round(count(*) FILTER (c >= 0.33 AND c <= 0.67) / count(*), 3) AS center,
        round(count(*) FILTER (c > 0.67) / count(*), 3) AS bottom
        FROM (SELECT video_id, (y + h / 2) / 500.0 AS c FROM ocr) GROUP BY video_id""", ocr=_OCR),
    "d08_appearance_timing": with_tables("texts speech", _TIMING),
    "d09_avg_text_gap": with_tables("texts", """SELECT video_id, round(coalesce(avg(g) FILTER (g < 10.0), 0.0), 2)
        AS avg_text_duration FROM (SELECT video_id, lead(t_s) OVER (PARTITION BY video_id ORDER BY t_s) - t_s AS g
        FROM texts) GROUP BY video_id"""),
    "d10_text_density": with_tables("segments texts", _RATE.format(name="density", points="texts")),
    "d11_sample_texts": with_tables("segments texts", """SELECT video_id,
          row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS sample_idx, structure_type, text FROM (
        SELECT s.video_id, s.structure_type, s.seg_idx, t.text, row_number() OVER (
          PARTITION BY s.video_id, s.structure_type ORDER BY s.seg_idx, t.t_s) AS rn FROM segments s JOIN texts t
        ON t.video_id = s.video_id AND t.t_s >= s.start_s AND t.t_s <= s.end_s AND length(t.text) >= 2) WHERE rn = 1"""),
    "d12_color_style": with_tables("ev", """SELECT video_id,
          CASE WHEN s > 120 THEN '高饱和' WHEN s > 60 THEN '中饱和' WHEN s > 20 THEN '低饱和' ELSE '极低饱和/灰度' END
            AS saturation_level, round(s, 1) AS avg_saturation,
          CASE WHEN s > 90 THEN '暖色调' WHEN s > 60 THEN '中性' WHEN s > 20 THEN '冷色调' ELSE '灰度/黑白' END AS tone,
          CASE WHEN b > 60 THEN '高对比度' ELSE '标准' END AS contrast
        FROM (SELECT video_id, avg(saturation_mean) AS s, avg(edge_density * 600) AS b FROM frames_ GROUP BY video_id)""",
        frames_=EVENT_FRAMES_SQL),
    "d13_composition_pref": with_tables("ev", _COMP, frames_=EVENT_FRAMES_SQL),
    "d14_object_rates": with_tables("ev", """SELECT video_id, round(avg(person_count), 2) AS avg_person_per_frame,
        round(avg(vehicle_count), 2) AS avg_vehicle_per_frame, round(avg(animal_count), 2) AS avg_animal_per_frame
        FROM frames_ GROUP BY video_id""", frames_=EVENT_FRAMES_SQL),
    "d15_packaging_shares": with_tables("ev", """SELECT video_id, round(avg(CASE k WHEN 0 THEN 1.0 ELSE 0 END), 3)
        AS title_card_ratio, round(avg(CASE k WHEN 1 THEN 1.0 ELSE 0 END), 3) AS pure_background_ratio,
        round(avg(CASE k WHEN 2 THEN 1.0 ELSE 0 END), 3) AS packaged_frame_ratio FROM (SELECT video_id,
        CASE WHEN gray_entropy > 5 AND optical_flow < 3 THEN 0 WHEN gray_entropy < 2 AND edge_density < 0.03 THEN 1
        ELSE 2 END AS k FROM frames_) GROUP BY video_id""", frames_=EVENT_FRAMES_SQL),
    "d16_brightness_stats": with_tables("ev", """SELECT video_id, round(min(brightness_mean), 1) AS min,
        round(max(brightness_mean), 1) AS max, round(avg(brightness_mean), 1) AS avg FROM frames_ GROUP BY video_id""",
        frames_=EVENT_FRAMES_SQL),
    "d17_pick_frames": with_tables("ev", """SELECT video_id, count(*) AS n,
        CASE WHEN video_id % 3 = 0 THEN count(*) ELSE 0 END AS with_flow FROM ev GROUP BY video_id"""),
    "d18_transition_stats": with_tables("segments videos", _TRANS),
    "d19_usage_context": with_tables("segments", """SELECT video_id, sub_type, string_agg(e, ',' ORDER BY e) AS contexts
        FROM (SELECT DISTINCT video_id, sub_type, unnest(evidence) AS e FROM segments
          WHERE structure_type IN ('transition', 'effect')) GROUP BY video_id, sub_type"""),
    "d20_cut_signals": with_tables("ev", """SELECT video_id, round(avg(CASE WHEN histogram_distance > 0.3 THEN 1.0 ELSE
        0.0 END), 3) AS high_visual_change_ratio, round(avg(histogram_distance), 4) AS avg_histogram_distance,
        round(max(histogram_distance), 4) AS max_histogram_distance FROM frames_ GROUP BY video_id""",
        frames_=EVENT_FRAMES_SQL),
    "d21_beat_alignment": with_tables("cuts", _BEAT),
    "d22_energy_sections": with_tables("totals videos", """SELECT video_id, section,
          round(i / n * duration_s, 1) AS start_s, round(j / n * duration_s, 1) AS end_s,
          CASE WHEN trend > 0 THEN '能量上升' ELSE '能量下降' END AS label FROM (
        SELECT video_id, n, trend, min(idx)::DOUBLE AS i, max(idx)::DOUBLE + 1 AS j,
          row_number() OVER (PARTITION BY video_id ORDER BY min(idx)) - 1 AS section FROM (
          SELECT *, idx - row_number() OVER (PARTITION BY video_id, trend ORDER BY idx) AS run FROM (
            SELECT video_id, n, idx, CASE WHEN sl > 0.001 THEN 1 WHEN sl < -0.001 THEN -1 ELSE 0 END AS trend FROM (
              SELECT *, round(lead(sm) OVER (PARTITION BY video_id ORDER BY idx) - sm, 9) AS sl FROM smooth)
            WHERE sl IS NOT NULL AND idx >= 1)) WHERE trend <> 0 GROUP BY video_id, n, trend, run)
        JOIN videos USING (video_id) WHERE section < 10""",
        smooth="""SELECT a.video_id, a.n, a.idx, sum(b.value) / any_value(a.w) AS sm FROM (
          SELECT *, greatest(3, n // 20) AS w FROM curve JOIN totals USING (video_id) WHERE n >= 6) a
          JOIN curve b ON b.video_id = a.video_id AND b.idx >= a.idx - a.w // 2 AND b.idx <= a.idx + (a.w - 1) // 2
          GROUP BY a.video_id, a.n, a.idx"""),
    "d23_energy_cut_corr": with_tables("totals videos cuts", """SELECT video_id, round(coalesce(CASE WHEN
          sqrt(var_pop(energy) * var_pop(cuts) * 100) > 1e-10 THEN corr(energy, cuts) END, 0.0), 3) AS pearson_r FROM (
        SELECT g.video_id, g.bin, (SELECT round(avg(value), 4) FROM curve c WHERE c.video_id = g.video_id
            AND c.idx >= i0 AND c.idx < greatest(i0 + 1, i1)) AS energy,
          (SELECT count(*) FROM cuts c WHERE c.video_id = g.video_id AND c.t_s >= g.t0 AND c.t_s < g.t1) AS cuts
        FROM (SELECT *, greatest(0, least(CAST(trunc(t0 / duration_s * n) AS BIGINT), n - 1)) AS i0,
            least(CAST(trunc(t1 / duration_s * n) AS BIGINT), n) AS i1 FROM (
          SELECT video_id, duration_s, n, bin, bin * (duration_s / 10) AS t0, (bin + 1) * (duration_s / 10) AS t1 FROM (
            SELECT video_id, duration_s, n, unnest(range(0, 10)) AS bin FROM videos JOIN totals USING (video_id)
            SEMI JOIN cuts USING (video_id)))) g) GROUP BY video_id"""),
    "d24_deconstruct": with_tables("segments videos cuts texts speech", """SELECT v.video_id, h.shot_count,
        r.rhythm_pattern, t.sync_ratio, c.preference, s.total_count, b.sync_pattern FROM videos v
        LEFT JOIN hist h USING (video_id) LEFT JOIN rhythm r USING (video_id) LEFT JOIN timing t USING (video_id)
        LEFT JOIN comp c USING (video_id) LEFT JOIN trans s USING (video_id) LEFT JOIN beat b USING (video_id)""",
        shots_=_SHOTS, frames_=EVENT_FRAMES_SQL, hist=_HIST, rhythm=_RHYTHM, timing=_TIMING, comp=_COMP, trans=_TRANS,
        beat=_BEAT),
}
