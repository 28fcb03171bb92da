"""Queries over curves, sampling and audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.operators import audio as U
from clipline.operators import curves as C
from clipline.operators import windows as W
from clipline.operators.ordered import ordered
from clipline.plans import adapters as A
from clipline.plans.oracle import with_tables


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


def _clock(spark, d):
    """Videos with a frame rate of 2 and their number of frames."""
    v = A.videos(spark, d)
    return v.withColumn("fps", F.lit(2.0)).withColumn("n_frames", F.floor(F.col("duration_s") * 2).cast("long"))


def f01(spark, d):
    f = A.frames(spark, d)
    both = F.arrays_zip(C.normalize_hist(F.col("hist")).alias("a"), C.normalize_hist(F.col("hist"), "l2").alias("b"))
    bins = f.select("video_id", "idx", F.posexplode(both).alias("bin", "v"))
    return bins.select("video_id", "idx", F.col("bin").cast("long").alias("bin"), F.round("v.a", 6).alias("minmax"),
                       F.round("v.b", 6).alias("l2"))


def f02(spark, d):
    return C.diff_curve(A.frames(spark, d), 5).select("video_id", "idx", "frame_index", _r("value", 4))


def f03(spark, d):
    return C.pair_distance(A.frames(spark, d)).select("video_id", "idx", _r("histogram_distance", 4))


def f04(spark, d):
    return C.detect_cuts(A.curve(spark, d), 60.0, 4).select("video_id", "idx", _r("t_s"))


def f05(spark, d):
    return C.scenes(A.boundaries(spark, d), A.videos(spark, d)).select("video_id", "scene_idx", _r("start_s"), _r("end_s"))


def f06(spark, d):
    return C.percentile_threshold(A.curve(spark, d), 75.0)


def f07(spark, d):
    return C.adaptive_sample(A.curve(spark, d), dense=2, sparse=7)


def f08(spark, d):
    return C.boundary_frames(A.boundaries(spark, d), _clock(spark, d))


def f09(spark, d):
    curve = A.curve(spark, d).withColumn("value", F.when(F.col("video_id") % 2 == 0, 1.0).otherwise(F.col("value")))
    return C.sample_by_count(curve, A.boundaries(spark, d), _clock(spark, d), 12)


def f10(spark, d):
    out = C.sample_with_context(A.curve(spark, d), A.boundaries(spark, d), _clock(spark, d), dense=2, sparse=7)
    return out.select("video_id", "frame_index", _r("t_s"), _r("diff_value"), "is_boundary")


def _features(spark, d):
    e = A.media_events(spark, d)
    return e.groupBy("video_id", F.floor(F.col("t_s") * 2).cast("long").alias("frame_index")).agg(
        F.round(F.max("value") / 10, 6).alias("gray_entropy"), (F.min("k") / 500).alias("edge_density"))


def f11(spark, d):
    return C.content_sample(_clock(spark, d), _features(spark, d)).drop("diff_value", "is_boundary")


def f12(spark, d):
    first = C.boundary_frames(A.boundaries(spark, d), _clock(spark, d)).withColumn("source", F.lit("cut"))
    second = C.content_sample(_clock(spark, d), _features(spark, d)).select("video_id", "frame_index", "source")
    return C.merge_keyframes(first, second)


def f13(spark, d):
    return C.grid_sample(_clock(spark, d), every=7.5)


def f13b(spark, d):
    return C.grid_sample(_clock(spark, d), count=25)


def f14(spark, d):
    e = A.media_events(spark, d).withColumn("sharpness", F.col("value") * 2)
    return C.blur_gate(e).groupBy("video_id", "kept", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def f15(spark, d):
    return C.speech_gate(A.videos(spark, d), A.speech(spark, d), 0.06)


def f15b(spark, d):
    v = A.videos(spark, d)
    return C.only_speech(v, C.speech_gate(v, A.speech(spark, d), 0.06)).select("video_id")


def f16(spark, d):
    return C.curve_stats(A.curve(spark, d)).select("video_id", _r("duration_s"), "n_points", _r("rate"))


def a01(spark, d):
    samples = A.curve(spark, d).select("video_id", F.col("idx").alias("i"), F.col("value").alias("y"))
    return U.rms_curve(samples, hop=4, frame=16, rate=8).select("video_id", "idx", "t_s", _r("value"))


def a02(spark, d):
    return U.silence_spans(A.curve(spark, d), 0.2, 8.0).select("video_id", _r("start_s"), _r("end_s"))


def a03(spark, d):
    return U.loudness(A.curve(spark, d)).select("video_id", _r("volume_rms"), _r("volume_variance"),
                                                _r("energy_variation"))


def _spectrum(spark, d):
    f = A.frames(spark, d).select("video_id", F.col("idx").alias("frame"), F.posexplode("hist").alias("_b", "mag"))
    return f.select("video_id", "frame", (F.col("_b") * F.lit(60.0)).alias("freq"), "mag")


def a04(spark, d):
    return U.band_shares(_spectrum(spark, d)).select("video_id", "low_ratio", "mid_ratio", "high_ratio",
                                                     _r("spectral_centroid", 4), _r("spectral_bandwidth", 4))


def a05(spark, d):
    from clipline.functions.expressions import gauss, ramp, tri
    e = A.media_events(spark, d)
    v = F.col("value")
    return e.groupBy("video_id").agg(F.max(ramp(v, 20, 90)).alias("r"), F.round(F.avg(tri(v, 50, 25)), 6).alias("t"),
                                     F.round(F.avg(gauss(v, 50, 10)), 6).alias("g")).withColumn("r", F.round("r", 6))


def music_inputs(spark, d):
    """Audio features of a video: energy from the curve, tempo and spectrum from other columns."""
    curve = A.curve(spark, d)
    m = U.music_features(curve, A.beats(spark, d))
    extra = curve.groupBy("video_id").agg(
        (F.col("video_id") % 140 + 50).cast("double").alias("bpm"),
        (F.col("video_id") % 37 * 120 + 500).cast("double").alias("spectral_centroid"),
        ((F.col("video_id") % 11) / 12.0).alias("low_ratio"), ((F.col("video_id") % 7) / 25.0).alias("silence_ratio"))
    return m.join(extra, "video_id")


def a06(spark, d):
    return U.classify_bgm(music_inputs(spark, d))


def a07(spark, d):
    # Ten long curves instead of many short ones, so that there are lags to search.
    e = A.media_events(spark, d).select((F.col("video_id") % 10).alias("video_id"), "us", F.col("video_id").alias("user"), "value")
    curve = ordered(e, ["video_id"], ["us", "user"], number="idx")
    return U.autocorr_peak(curve).select("video_id", _r("pulse_regularity"))


def a08(spark, d):
    m = music_inputs(spark, d).withColumn("energy_mean", F.col("energy_mean") / 500)
    return U.classify_mood(m)


def a09(spark, d):
    return U.fallback_bpm(A.curve(spark, d), 50.0).select("video_id", _r("bpm"))


def a10(spark, d):
    curve = A.curve(spark, d)
    energy = curve.filter("video_id % 2 = 0")
    return U.coalesce_signals(energy, curve).groupBy("video_id", "channel").agg(F.count(F.lit(1)).alias("n"))


def a11(spark, d):
    return U.full_text(A.transcript(spark, d))


def _slices(spark, d):
    curve = A.curve(spark, d)
    spans = A.segments(spark, d).join(A.videos(spark, d), "video_id")
    bounds = W.slice_bounds(spans.select("video_id", "seg_idx", "start_s", "end_s", "duration_s"), W.curve_totals(curve))
    return W.slice_curve(curve, bounds)


def a12(spark, d):
    return _slices(spark, d).select("video_id", "seg_idx", "idx", "slice_pos")


def a13(spark, d):
    curve = A.curve(spark, d)
    whole = A.videos(spark, d).select("video_id", F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start_s"),
                                      F.col("duration_s").alias("end_s"), "duration_s")
    points = W.slice_curve(curve, W.slice_bounds(whole, W.curve_totals(curve)))
    return U.bin_slice(points).select("video_id", "bar", _r("value"))


def a14(spark, d):
    return C.display_bars(A.curve(spark, d)).select("video_id", "idx", _r("bar"))


QUERIES = {
    "f01_normalize_hist": f01, "f02_diff_curve": f02, "f03_pair_distance": f03, "f04_detect_cuts": f04,
    "f05_scenes": f05, "f06_percentile_threshold": f06, "f07_adaptive_sample": f07, "f08_boundary_frames": f08,
    "f09_sample_by_count": f09, "f10_sample_with_context": f10, "f11_content_sample": f11, "f12_merge_keyframes": f12,
    "f13_grid_sample_every": f13, "f13_grid_sample_count": f13b, "f14_blur_gate": f14, "f15_speech_gate": f15,
    "f15_only_speech": f15b, "f16_curve_stats": f16,
    "a01_rms_curve": a01, "a02_silence_spans": a02, "a03_loudness": a03, "a04_band_shares": a04,
    "a05_membership": a05, "a06_classify_bgm": a06, "a07_autocorr_peak": a07, "a08_classify_mood": a08,
    "a09_fallback_bpm": a09, "a10_coalesce_signals": a10, "a11_full_text": a11, "a12_slice_curve": a12,
    "a13_bin_slice": a13, "a14_display_bars": a14,
}

_CHI = """list_sum(list_transform(list_zip(p, hist), lambda z: CASE WHEN z[1] = 0 THEN 0.0
    ELSE (z[1] - z[2]) * (z[1] - z[2]) / z[1] END))"""
_BFRAMES = """SELECT DISTINCT c.video_id, frame_index FROM (SELECT c.video_id, v.duration_s,
      unnest(range(CAST(round_even(c.t_s * 2.0, 0) AS BIGINT) - 2, CAST(round_even(c.t_s * 2.0, 0) AS BIGINT) + 3))
        AS frame_index FROM cuts c JOIN videos v USING (video_id)) c
    WHERE frame_index >= 0 AND frame_index < CAST(floor(duration_s * 2) AS BIGINT)"""
_FEAT = """SELECT video_id, CAST(floor(t_s * 2) AS BIGINT) AS frame_index, round(max(value) / 10, 6) AS gray_entropy,
      min(k) / 500.0::DOUBLE AS edge_density FROM ev GROUP BY video_id, CAST(floor(t_s * 2) AS BIGINT)"""
_CONTENT = """SELECT g.video_id, g.frame_index, g.t_s, 'content' AS source FROM (
      SELECT video_id, duration_s, i * 5.0::DOUBLE AS t_s, CAST(trunc(i * 5.0::DOUBLE * 2.0) AS BIGINT) AS frame_index
      FROM (SELECT video_id, duration_s, unnest(range(0, CAST(ceil(duration_s / 5.0) AS BIGINT))) AS i FROM videos)) g
    JOIN feat f USING (video_id, frame_index)
    WHERE g.frame_index < CAST(trunc(duration_s * 2) AS BIGINT) AND gray_entropy > 4.5 AND edge_density < 0.08"""
_WALK = """SELECT c.video_id, c.n, t.threshold, 0::BIGINT AS at_idx FROM totals c JOIN thr t USING (video_id)
    UNION ALL
    SELECT w.video_id, w.n, w.threshold, w.at_idx + CASE WHEN greatest(coalesce(p.value, 0.0), coalesce(q.value, 0.0))
        > w.threshold THEN 2 ELSE 7 END
    FROM walk w LEFT JOIN curve p ON p.video_id = w.video_id AND p.idx = w.at_idx - 1
      LEFT JOIN curve q ON q.video_id = w.video_id AND q.idx = w.at_idx WHERE w.at_idx <= w.n"""
_THR = """SELECT video_id, list_sort(list(value))[least(CAST(floor(count(*) * 75.0 / 100.0) AS BIGINT), count(*) - 1) + 1]
      AS threshold FROM curve GROUP BY video_id"""
_MUSIC = """SELECT v.*, CAST(video_id % 140 + 50 AS DOUBLE) AS bpm, CAST(video_id % 37 * 120 + 500 AS DOUBLE) AS sc,
      (video_id % 11) / 12.0::DOUBLE AS low, (video_id % 7) / 25.0::DOUBLE AS q FROM (
    SELECT video_id, max(value) AS mx, avg(value) AS e, stddev_pop(value) / (avg(value) + 1e-10) AS cv
    FROM curve GROUP BY video_id) v"""
_RMS = """SELECT video_id, k AS idx, k * 4 / 8.0::DOUBLE AS t_s, round(sqrt(sum(value * value) / 16), 6) AS value FROM (
      SELECT video_id, unnest(range(0, n // 4 + 1)) AS k FROM totals) g
    JOIN curve c USING (video_id) WHERE c.idx >= k * 4 - 8 AND c.idx < k * 4 + 8 GROUP BY video_id, k"""


def _ramp(x, lo, hi):
    return f"least(1.0, greatest(0.0, ({x} - {lo}) / ({hi} - {lo})))"


def _tri(x, c, h):
    return f"greatest(0.0, 1.0 - abs({x} - {c}) / {h})"


def _gauss(x, c, s):
    return f"exp(-0.5 * pow(({x} - {c}) / {s}, 2))"


_MOODS = {
    "calm": f".3*(1-{_ramp('bpm',60.0,90.0)}) + .3*(1-{_ramp('e',.04,.12)}) + .25*(1-{_ramp('sc',800.0,2000.0)}) "
            f"+ .15*{_ramp('q',.02,.15)}",
    "cheerful": f".3*{_ramp('bpm',95.0,140.0)} + .25*{_ramp('sc',1800.0,4000.0)} + .3*(1-{_ramp('cv',.2,.45)}) "
                f"+ .15*(1-{_ramp('q',.05,.2)})",
    "tense": f".3*{_ramp('bpm',100.0,150.0)} + .35*{_ramp('cv',.3,.6)} + .2*{_gauss('sc',2500.0,1200.0)} "
             f"+ .15*(1-{_ramp('q',.05,.15)})",
    "melancholy": f".25*(1-{_ramp('bpm',55.0,95.0)}) + .3*(1-{_ramp('e',.03,.1)}) "
                  f"+ .25*(1-{_ramp('sc',800.0,2000.0)}) + .2*{_ramp('q',.05,.25)}",
    "neutral": f".3*{_tri('bpm',95.0,25.0)} + .3*{_gauss('e',.08,.04)} + .25*{_gauss('sc',1800.0,800.0)} "
               f"+ .15*{_tri('q',.05,.08)}",
    "energetic": f".35*{_ramp('bpm',120.0,180.0)} + .35*{_ramp('e',.12,.25)} + .15*{_gauss('sc',2500.0,1200.0)} "
                 f"+ .15*(1-{_ramp('q',.02,.1)})",
}
_MOOD_ROWS = " UNION ALL ".join(
    f"SELECT video_id, {i} AS rk, '{m}' AS mood, CAST({s} AS DOUBLE) AS score FROM inputs"
    for i, (m, s) in enumerate(_MOODS.items()))

_KINDS = {
    "激昂/紧张": f".3*{_ramp('bpm',120.0,180.0)} + .2*{_gauss('sc',2500.0,1000.0)} + .3*{_ramp('cv',.3,.6)} "
                 f"+ .2*{_gauss('low',.3,.12)}",
    "轻松/愉快": f".25*{_tri('bpm',110.0,30.0)} + .2*{_gauss('sc',2200.0,800.0)} + .3*(1-{_ramp('cv',.15,.3)}) "
                 f"+ .25*{_gauss('low',.3,.12)}",
    "舒缓/宁静": f".25*(1-{_ramp('bpm',60.0,100.0)}) + .25*(1-{_ramp('sc',800.0,2000.0)}) + .3*(1-{_ramp('cv',.05,.25)}) "
                 f"+ .2*{_ramp('low',.3,.6)}",
    "悲伤/沉郁": f".25*{_tri('bpm',75.0,20.0)} + .2*(1-{_ramp('sc',800.0,2000.0)}) + .3*(1-{_ramp('k','(-.005)',.005)}) "
                 f"+ .25*{_ramp('low',.35,.65)}",
    "电子/科技": f".25*{_ramp('bpm',110.0,170.0)} + .25*{_ramp('sc',3000.0,5000.0)} + .3*{_ramp('p',.3,.8)} "
                 f"+ .2*(1-{_ramp('low',.15,.35)})",
    "节奏/打击": f".2*{_ramp('bpm',100.0,170.0)} + .15*{_gauss('sc',2000.0,900.0)} + .25*g + .4*{_ramp('low',.4,.7)}",
}
_KIND_ROWS = " UNION ALL ".join(
    f"SELECT video_id, {i} AS rk, '{m}' AS name, CAST({q} AS DOUBLE) AS score FROM inputs"
    for i, (m, q) in enumerate(_KINDS.items()))

ORACLE = {
    "f01_normalize_hist": with_tables("frames", """SELECT video_id, idx, unnest(range(0, 64)) AS bin,
          round(unnest(list_transform(hist, lambda x: (x - list_min(hist)) / (list_max(hist) - list_min(hist)))), 6)
            AS minmax,
          round(unnest(list_transform(hist, lambda x: x / sqrt(list_sum(list_transform(hist, lambda y: y * y))))), 6) AS l2
        FROM frames"""),
    "f02_diff_curve": with_tables("frames", f"""SELECT video_id, idx // 5 - 1 AS idx, idx AS frame_index,
          round({_CHI}, 4) AS value FROM (SELECT *, lag(hist) OVER (PARTITION BY video_id ORDER BY idx) AS p
          FROM frames WHERE idx % 5 = 0) WHERE p IS NOT NULL"""),
    "f03_pair_distance": with_tables("frames", f"""SELECT video_id, idx, round(coalesce(CASE WHEN p IS NOT NULL THEN
          {_CHI} END, 0.0), 4) AS histogram_distance FROM (SELECT *, lag(hist) OVER (PARTITION BY video_id
          ORDER BY idx) AS p FROM frames)"""),
    "f04_detect_cuts": "WITH RECURSIVE " + with_tables("curve", "", strong="""SELECT video_id, idx, t_s FROM curve
          WHERE value >= 60.0 OR idx = 0""")[5:].rstrip() + """,
        walk AS (SELECT video_id, idx FROM strong WHERE idx = 0 UNION ALL
          SELECT w.video_id, (SELECT min(s.idx) FROM strong s WHERE s.video_id = w.video_id AND s.idx >= w.idx + 4)
          FROM walk w WHERE w.idx IS NOT NULL)
        SELECT w.video_id, w.idx, round(c.t_s, 6) AS t_s FROM walk w JOIN curve c USING (video_id, idx)""",
    "f05_scenes": with_tables("cuts videos", """SELECT video_id, row_number() OVER w - 1 AS scene_idx,
          round(t_s, 6) AS start_s, round(coalesce(lead(t_s) OVER w, duration_s), 6) AS end_s
        FROM (SELECT DISTINCT video_id, t_s FROM cuts) JOIN videos USING (video_id)
        WINDOW w AS (PARTITION BY video_id ORDER BY t_s)"""),
    "f06_percentile_threshold": with_tables("curve", "SELECT * FROM thr", thr=_THR),
    "f07_adaptive_sample": "WITH RECURSIVE " + with_tables("totals", "", thr=_THR)[5:].rstrip() + f""",
        walk AS ({_WALK}) SELECT video_id, at_idx AS frame_index FROM walk WHERE at_idx <= n""",
    "f08_boundary_frames": with_tables("cuts videos", "SELECT video_id, frame_index FROM bf", bf=_BFRAMES),
    "f09_sample_by_count": "WITH RECURSIVE " + with_tables(
        "totals cuts videos", "", thr=_THR, bf=_BFRAMES, shape="""SELECT video_id, count(*) + 1 AS n,
          max(v) - min(v) <= 0.05 * greatest(max(v), 1e-9) AS flat FROM (
          SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 1.0 ELSE value END AS v FROM curve) GROUP BY video_id""")[5:].rstrip()
        + f""", walk AS ({_WALK.replace("THEN 2 ELSE 7", "THEN 5 ELSE 30")})
        SELECT video_id, frame_index FROM (SELECT video_id, n, CAST(round_even(i * ((n - 1) / greatest(least(12, n) - 1, 1)), 0)
            AS BIGINT) AS frame_index FROM (SELECT *, unnest(range(0, least(12, n))) AS i FROM shape WHERE flat))
          WHERE frame_index < n
        UNION SELECT video_id, at_idx FROM walk SEMI JOIN (FROM shape WHERE NOT flat) USING (video_id) WHERE at_idx <= n
        UNION SELECT video_id, frame_index FROM bf SEMI JOIN shape USING (video_id)""",
    "f10_sample_with_context": "WITH RECURSIVE " + with_tables("totals cuts videos", "", thr=_THR, bf=_BFRAMES)[5:]
        .rstrip() + f""", walk AS ({_WALK}),
        both_ AS (SELECT video_id, at_idx AS frame_index, false AS b FROM walk WHERE at_idx <= n
          UNION ALL SELECT video_id, frame_index, true FROM bf)
        SELECT s.video_id, s.frame_index, round(s.frame_index / 2.0::DOUBLE, 6) AS t_s,
          round(coalesce(c.value, 0.0), 6) AS diff_value, s.b AS is_boundary
        FROM (SELECT video_id, frame_index, bool_or(b) AS b FROM both_ GROUP BY video_id, frame_index) s
        LEFT JOIN curve c ON c.video_id = s.video_id AND c.idx = s.frame_index""",
    "f11_content_sample": with_tables("ev videos", "SELECT * FROM content", feat=_FEAT, content=_CONTENT),
    "f12_merge_keyframes": with_tables("ev videos cuts", """SELECT video_id, frame_index, 'cut' AS source FROM bf
        UNION ALL SELECT video_id, frame_index, source FROM content ANTI JOIN bf USING (video_id, frame_index)""",
        bf=_BFRAMES, feat=_FEAT, content=_CONTENT),
    "f13_grid_sample_every": with_tables("videos", """SELECT video_id, round(t, 1) AS t_s, frame_index FROM (
        SELECT video_id, duration_s, i * 7.5::DOUBLE AS t, CAST(trunc(i * 7.5::DOUBLE * 2) AS BIGINT) AS frame_index FROM (
          SELECT *, unnest(range(0, CAST(ceil(duration_s / 7.5) AS BIGINT))) AS i FROM videos))
        WHERE frame_index < CAST(floor(duration_s * 2) AS BIGINT)"""),
    "f13_grid_sample_count": with_tables("videos", """SELECT video_id, round(i * (duration_s / 24), 1) AS t_s,
        least(CAST(trunc(i * (duration_s / 24) * 2.0) AS BIGINT), CAST(floor(duration_s * 2) AS BIGINT) - 1)
          AS frame_index FROM (SELECT *, unnest(range(0, 25)) AS i FROM videos WHERE duration_s > 0)"""),
    "f14_blur_gate": with_tables("ev", """SELECT video_id, value * 2 >= 100 AS kept,
        CASE WHEN value * 2 < 100 THEN 'blurry' END AS reject_reason, count(*) AS n FROM ev
        GROUP BY ALL"""),
    "f15_speech_gate": with_tables("videos speech", """SELECT video_id, ratio AS speech_ratio, ratio >= 0.06 AS
        has_speech FROM (SELECT v.video_id, round(coalesce(s, 0.0) / greatest(duration_s, 0.01), 4) AS ratio
        FROM videos v LEFT JOIN (SELECT video_id, sum(end_s - start_s) AS s FROM speech GROUP BY video_id)
        USING (video_id))"""),
    "f15_only_speech": with_tables("videos speech", """SELECT video_id FROM (SELECT v.video_id,
        round(coalesce(s, 0.0) / greatest(duration_s, 0.01), 4) AS ratio FROM videos v LEFT JOIN
        (SELECT video_id, sum(end_s - start_s) AS s FROM speech GROUP BY video_id) USING (video_id))
        WHERE ratio >= 0.06"""),
    "f16_curve_stats": with_tables("curve", """SELECT video_id, round(max(t_s), 6) AS duration_s, count(*) AS n_points,
        round(count(*) / nullif(max(t_s), 0), 6) AS rate FROM curve GROUP BY video_id"""),
    "a01_rms_curve": with_tables("totals", _RMS),
    "a02_silence_spans": with_tables("curve", """SELECT video_id, round(min(t_s), 6) AS start_s,
          round(max(nxt), 6) AS end_s
        FROM (SELECT *, idx - row_number() OVER (PARTITION BY video_id, quiet ORDER BY idx) AS run FROM (
          SELECT video_id, idx, t_s, coalesce(lead(t_s) OVER (PARTITION BY video_id ORDER BY idx),
              max(t_s) OVER v + max(t_s) OVER v / greatest(count(*) OVER v - 1, 1)) AS nxt,
            value < max(value) OVER v * 0.2 AS quiet FROM curve WINDOW v AS (PARTITION BY video_id)))
        WHERE quiet GROUP BY video_id, run HAVING max(nxt) - min(t_s) > 8.0"""),
    "a03_loudness": with_tables("curve", """SELECT video_id, round(20.0 * log10(avg(value) + 1e-10), 6) AS volume_rms,
        round(stddev_pop(value), 6) AS volume_variance, round(avg(abs(value - p)), 6) AS energy_variation FROM
        (SELECT *, lag(value) OVER (PARTITION BY video_id ORDER BY idx) AS p FROM curve) GROUP BY video_id"""),
    "a04_band_shares": with_tables("frames", """SELECT video_id, round(sum(lo) / sum(m), 4) AS low_ratio,
          round(sum(mi) / sum(m), 4) AS mid_ratio, round(sum(hi) / sum(m), 4) AS high_ratio,
          round(avg(fm / m), 4) AS spectral_centroid,
          round(avg(sqrt(greatest(0.0, ffm / m - (fm / m) * (fm / m)))), 4) AS spectral_bandwidth
        FROM (SELECT video_id, frame, sum(mag) AS m, sum(freq * mag) AS fm, sum(freq * freq * mag) AS ffm,
          sum(CASE WHEN freq <= 250 THEN mag ELSE 0 END) AS lo,
          sum(CASE WHEN freq > 250 AND freq <= 2000 THEN mag ELSE 0 END) AS mi,
          sum(CASE WHEN freq > 2000 THEN mag ELSE 0 END) AS hi FROM (
            SELECT video_id, idx AS frame, unnest(range(0, 64)) * 60.0::DOUBLE AS freq, unnest(hist) AS mag FROM frames)
          GROUP BY video_id, frame) GROUP BY video_id"""),
    "a05_membership": with_tables("ev", f"""SELECT video_id, round(max({_ramp('value', 20.0, 90.0)}), 6) AS r,
        round(avg({_tri('value', 50.0, 25.0)}), 6) AS t, round(avg({_gauss('value', 50.0, 10.0)}), 6) AS g
        FROM ev GROUP BY video_id"""),
    "a07_autocorr_peak": with_tables("ev", """SELECT video_id, coalesce(round(max(CASE WHEN lag >= 20 AND lag < (n + 1) // 2 - 20
          THEN c END) / (max(CASE WHEN lag = 0 THEN c END) + 1e-10), 6), 0.0) AS pulse_regularity FROM (
        SELECT a.video_id, b.idx - a.idx AS lag, max(a.n) AS n, sum(a.x * b.x) AS c FROM c a JOIN c b
          ON a.video_id = b.video_id AND b.idx >= a.idx AND b.idx < a.idx + (a.n + 1) // 2 - 20
        GROUP BY a.video_id, b.idx - a.idx) GROUP BY video_id""",
        c="""SELECT video_id, idx, count(*) OVER v AS n, (value - avg(value) OVER v) / (max(value) OVER v + 1e-10) AS x FROM (
          SELECT video_id % 10 AS video_id, value, row_number() OVER (PARTITION BY video_id % 10 ORDER BY us, video_id) - 1 AS idx
          FROM ev) WINDOW v AS (PARTITION BY video_id)"""),
    "a06_classify_bgm": with_tables("curve beats", """SELECT video_id, CASE WHEN score < 0.5 THEN '无法判定' ELSE name END AS bgm_type,
          round(score, 3) AS bgm_confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rk) AS rn
          FROM kinds) WHERE rn = 1""", raw=_MUSIC, inputs="""SELECT r.*, coalesce(slope, 0.0) AS k, CASE WHEN nb >= 4 THEN
          greatest(0.0, 1.0 - bcv) ELSE 0.0 END AS g, 0.0::DOUBLE AS p FROM raw r LEFT JOIN (SELECT video_id,
            regr_slope(value / (m + 1e-10), idx::DOUBLE) AS slope FROM (SELECT *, max(value) OVER (PARTITION BY video_id) AS m
            FROM curve) GROUP BY video_id) USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS nb,
            stddev_pop(gap) / (avg(gap) + 1e-10) AS bcv FROM (SELECT video_id, t_s - lag(t_s) OVER (PARTITION BY video_id
            ORDER BY t_s) AS gap FROM beats) GROUP BY video_id) USING (video_id)""", kinds=_KIND_ROWS),
    "a08_classify_mood": with_tables("curve", """SELECT video_id, max(CASE WHEN rn = 1 THEN mood END) AS mood,
          round(least(greatest(max(CASE WHEN rn = 1 THEN score END), 0.0), 1.0), 3) AS mood_confidence,
          max(CASE WHEN rn = 2 THEN CASE WHEN score > 0.30 THEN mood ELSE '' END END) AS mood_secondary
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rk) AS rn FROM moods)
        GROUP BY video_id""", raw=_MUSIC, inputs="SELECT * REPLACE (e / 500 AS e) FROM raw", moods=_MOOD_ROWS),
    "a09_fallback_bpm": with_tables("curve", """SELECT video_id, round(80.0 + avg(CASE WHEN value > 50.0 THEN 1.0 ELSE 0.0
        END) * 100.0, 6) AS bpm FROM curve GROUP BY video_id"""),
    "a10_coalesce_signals": with_tables("curve", """SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'rms' ELSE 'diff' END
        AS channel, count(*) AS n FROM curve GROUP BY video_id"""),
    "a11_full_text": """SELECT conv_id AS video_id, string_agg(text, '' ORDER BY turn) AS full_text
        FROM conversations GROUP BY conv_id""",
    "a12_slice_curve": with_tables("segments videos totals", """SELECT b.video_id, b.seg_idx, c.idx,
          c.idx - b.i_from AS slice_pos FROM bounds b JOIN curve c
        ON c.video_id = b.video_id AND c.idx >= b.i_from AND c.idx < b.i_to""",
        bounds="""SELECT *, greatest(i_from + 1, least(CAST(trunc(end_s / duration_s * n) AS BIGINT), n)) AS i_to FROM (
          SELECT s.video_id, s.seg_idx, s.end_s, v.duration_s, t.n,
            greatest(0, least(CAST(trunc(s.start_s / v.duration_s * t.n) AS BIGINT), t.n - 1)) AS i_from
          FROM segments s JOIN videos v USING (video_id) JOIN totals t USING (video_id))"""),
    "a13_bin_slice": with_tables("curve totals", """SELECT video_id, idx // w AS bar, round(sum(value) / w, 6) AS value
        FROM (SELECT video_id, idx, value, greatest(1, n // 20) AS w FROM curve JOIN totals USING (video_id))
        WHERE idx // w < 20 GROUP BY video_id, idx // w, w"""),
    "a14_display_bars": with_tables("curve", """SELECT video_id, idx, round(greatest(0.02,
        value / greatest(max(value) OVER (PARTITION BY video_id), 0.01)), 6) AS bar FROM curve"""),
}
