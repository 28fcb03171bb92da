"""Energy curves, spectra, music type and mood."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipline.constants import MOODS, MUSIC_TYPES, MUSIC_UNDECIDED
from clipline.functions.expressions import first_best, gauss, ramp, ranked, tri
from clipline.operators.ordered import islands, ordered, with_totals

VID = ["video_id"]


def rms_curve(samples: DataFrame, hop: int = 512, frame: int = 2048, rate: int = 16000) -> DataFrame:
    """Root mean square per hop over centred frames, zeros beyond both ends.

    A frame is made of whole half-hops: every half-hop block of samples is
    summed once and then added to the few frames it belongs to.
    """
    half = hop // 2
    if frame % hop or hop % 2:
        raise ValueError("frame must be a multiple of an even hop")
    blocks = samples.withColumn("_b", F.floor(F.col("i") / half)).groupBy("video_id", "_b").agg(
        F.sum(F.col("y") * F.col("y")).alias("_e"))
    n = samples.groupBy("video_id").agg((F.floor((F.max("i") + 1) / hop) + 1).alias("_frames"))
    # Frame k covers samples [k * hop - frame / 2, k * hop + frame / 2).
    reach = frame // 2 // half
    first = F.ceil((F.col("_b") - reach + 1) / 2)
    last = F.floor((F.col("_b") + reach) / 2)
    low = F.greatest(F.lit(0).cast("long"), first)
    spread = blocks.join(n, "video_id").withColumn("idx", F.explode(F.sequence(
        low, F.greatest(low, F.least(last, F.col("_frames") - 1)))))
    inside = (F.col("_b") >= F.col("idx") * 2 - reach) & (F.col("_b") < F.col("idx") * 2 + reach)
    sums = spread.filter(inside & (F.col("idx") < F.col("_frames"))).groupBy("video_id", "idx").agg(
        F.sum("_e").alias("_e"))
    return sums.select("video_id", "idx", (F.col("idx") * hop / F.lit(float(rate))).alias("t_s"),
                       F.sqrt(F.col("_e") / frame).alias("value"))


def silence_spans(curve: DataFrame, ratio: float = 0.05, min_gap: float = 3.0) -> DataFrame:
    """Runs below ``ratio`` of the maximum that last longer than ``min_gap`` seconds.

    A run ends at the first loud point; one still open at the end runs to
    ``end_s``, one step behind the last point.
    """
    rows = with_totals(curve, VID, _max=F.max("value"), _n=F.count(F.lit(1)), _end=F.max("t_s"))
    rows = rows.filter(F.col("_max") > 0).withColumn("_quiet", F.col("value") < F.col("_max") * ratio)
    rows = ordered(rows, VID, ["idx"], dense=True, lead={"_next": F.col("t_s")})
    step = F.col("_end") / F.greatest(F.col("_n") - 1, F.lit(1))
    rows = rows.withColumn("_to", F.coalesce("_next", F.col("_end") + step))
    runs = islands(rows, VID, ["idx"], dense=True, values={"q": F.col("_quiet")},
                   together=lambda a, b: a["q"] == b["q"])
    spans = runs.filter("_quiet").groupBy("video_id", "island").agg(
        F.min("t_s").alias("start_s"), F.max("_to").alias("end_s"))
    return spans.filter(F.col("end_s") - F.col("start_s") > min_gap).select("video_id", "start_s", "end_s")


def loudness(curve: DataFrame) -> DataFrame:
    """Mean level in dB, spread and mean absolute step of a curve."""
    near = ordered(curve, VID, ["idx"], dense=True, lag={"_prev": F.col("value")})
    v = F.col("value")
    return near.groupBy("video_id").agg(
        (F.lit(20.0) * F.log10(F.avg(v) + F.lit(1e-10))).alias("volume_rms"), F.stddev_pop(v).alias("volume_variance"),
        F.avg(F.abs(v - F.col("_prev"))).alias("energy_variation"))


def band_shares(spectrum: DataFrame) -> DataFrame:
    """Energy share below 250 Hz, up to 2 kHz and above, and mean spectral centroid and bandwidth.

    ``spectrum`` has rows (video_id, frame, freq, mag).
    """
    f, m = F.col("freq"), F.col("mag")
    frames = spectrum.groupBy("video_id", "frame").agg(
        F.sum(m).alias("_m"), F.sum(f * m).alias("_fm"), F.sum(f * f * m).alias("_ffm"),
        F.sum(F.when(f <= 250, m).otherwise(0.0)).alias("_low"),
        F.sum(F.when((f > 250) & (f <= 2000), m).otherwise(0.0)).alias("_mid"),
        F.sum(F.when(f > 2000, m).otherwise(0.0)).alias("_high"))
    centre = F.coalesce(F.try_divide(F.col("_fm"), F.col("_m")), F.lit(0.0))
    spread = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_ffm"), F.col("_m")) - centre * centre)), F.lit(0.0))
    sums = frames.withColumn("_c", centre).withColumn("_w", spread).groupBy("video_id").agg(
        F.sum("_low").alias("_low"), F.sum("_mid").alias("_mid"), F.sum("_high").alias("_high"),
        F.avg("_c").alias("spectral_centroid"), F.avg("_w").alias("spectral_bandwidth"))
    total = F.col("_low") + F.col("_mid") + F.col("_high")
    return sums.select("video_id", *[
        F.round(F.coalesce(F.try_divide(F.col(f"_{b}"), total), F.lit(0.0)), 4).alias(f"{b}_ratio")
        for b in ("low", "mid", "high")], "spectral_centroid", "spectral_bandwidth")


# -- pulse ----------------------------------------------------------------

def _peak(corr: np.ndarray, n: int) -> float:
    """Highest normalised autocorrelation between lag 20 and n // 2 - 20."""
    top = corr[: n // 2 + 1].max()
    search = corr[20: (n + 1) // 2 - 20]
    return float((search / (top + 1e-10)).max()) if len(search) else 0.0


def _fft_peak(values: np.ndarray) -> float:
    n = len(values)
    if n <= 40 or values.max() == 0:
        return 0.0
    x = values / (values.max() + 1e-10)
    x = x - x.mean()
    size = 1 << int(np.ceil(np.log2(2 * n)))
    power = np.abs(np.fft.rfft(x, size)) ** 2
    return _peak(np.fft.irfft(power, size)[:n], n)


def _fft_pass(rows: DataFrame, group: str, along: str, out: str, size: str, turned: bool) -> DataFrame:
    """Fourier transform of every ``group`` along ``along``, whose length is in column ``size``.

    ``turned`` multiplies the twiddle of the four-step split. Columns ``a`` and
    ``b``, the sides of the square of a video, go along.
    """
    key = rows.schema["video_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, a, b = int(pdf[size].iloc[0]), int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        data = np.zeros(n, dtype=np.complex128)
        data[pdf[along].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        spectrum, k = np.fft.fft(data), np.arange(n)
        g = int(pdf[group].iloc[0])
        if turned:
            spectrum = spectrum * np.exp(-2j * np.pi * ((k * g) % (a * b)) / (a * b))
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]] * n, group: np.full(n, g), out: k, "a": np.full(n, a),
                             "b": np.full(n, b), "re": spectrum.real, "im": spectrum.imag})

    return rows.groupBy("video_id", group).applyInPandas(
        run, f"video_id {key}, {group} bigint, {out} bigint, a bigint, b bigint, re double, im double")


def _long_fft(rows: DataFrame) -> DataFrame:
    """Four-step transform of length a * b: rows (video_id, a, b, idx, re, im), absent positions are 0."""
    split = rows.select("video_id", "a", "b", F.floor(F.col("idx") / F.col("b")).alias("i1"),
                        (F.col("idx") % F.col("b")).alias("i2"), "re", "im")
    first = _fft_pass(split, "i2", "i1", "k1", "a", True)
    second = _fft_pass(first, "k1", "i2", "k2", "b", False)
    return second.select("video_id", "a", "b", (F.col("k1") + F.col("a") * F.col("k2")).alias("idx"), "re", "im")


def autocorr_peak(curve: DataFrame, *, whole_below: int = 1 << 20) -> DataFrame:
    """Pulse regularity: highest autocorrelation of the centred curve away from lag 0.

    Curves shorter than ``whole_below`` points are transformed in one piece.
    A longer one is split as a square of side about sqrt(2 n), its own, and
    transformed along columns and then rows, so a task holds one side of the
    square. Either way a curve with no lag to search has regularity 0. Nothing
    runs before the result is asked for; without long curves their part of the
    plan turns out empty.
    """
    key = curve.schema["video_id"].dataType
    sizes = curve.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("value").alias("_max"), F.avg("value").alias("_mean"))
    out = T.StructType([T.StructField("video_id", key), T.StructField("pulse_regularity", T.DoubleType())])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("idx")["value"].to_numpy(dtype=float)
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "pulse_regularity": [_fft_peak(values)]})

    short = curve.select("video_id", "idx", "value").join(
        sizes.filter(F.col("_n") < whole_below).select("video_id"), VID, "left_semi")
    result = short.groupBy("video_id").applyInPandas(whole, out)

    bits = F.ceil(F.log2(2 * F.col("_n"))).cast("int")
    sides = sizes.filter(F.col("_n") >= whole_below).withColumn(
        "a", F.pow(F.lit(2), F.floor(bits / 2)).cast("long")).withColumn(
        "b", F.pow(F.lit(2), bits - F.floor(bits / 2)).cast("long"))
    long = curve.join(sides.filter(F.col("_max") != 0), "video_id")
    scale = F.col("_max") + F.lit(1e-10)
    centred = long.select("video_id", "a", "b", "idx", ((F.col("value") - F.col("_mean")) / scale).alias("re"),
                          F.lit(0.0).alias("im"))
    spectrum = _long_fft(centred)
    power = spectrum.select("video_id", "a", "b", "idx", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"),
                            F.lit(0.0).alias("im"))
    corr = _long_fft(power).join(sizes.select("video_id", "_n"), "video_id")
    half, n = F.floor(F.col("_n") / 2), F.col("_n")
    found = corr.groupBy("video_id").agg(
        F.max(F.when(F.col("idx") <= half, F.col("re"))).alias("_top"),
        F.max(F.when((F.col("idx") >= 20) & (F.col("idx") < F.floor((n + 1) / 2) - 20), F.col("re"))).alias("_side"),
        (F.max(F.col("a") * F.col("b")) * F.lit(1e-10)).alias("_tiny"))
    flat = sizes.filter((F.col("_n") >= whole_below) & (F.col("_max") == 0)).select(
        "video_id", F.lit(0.0).alias("pulse_regularity"))
    return result.unionByName(found.select(
        "video_id", F.coalesce(F.col("_side") / (F.col("_top") + F.col("_tiny")), F.lit(0.0)).alias("pulse_regularity"))).unionByName(flat)


# -- classifiers ----------------------------------------------------------

def music_features(curve: DataFrame, beats: DataFrame, *, whole_below: int = 1 << 20) -> DataFrame:
    """Variation, trend slope, beat regularity and pulse regularity per video."""
    v = F.col("value")
    scaled = with_totals(curve, VID, _max=F.max("value"))
    stats = scaled.groupBy("video_id").agg(
        F.max("_max").alias("energy_max"), F.avg(v).alias("energy_mean"), F.stddev_pop(v).alias("energy_std"),
        F.regr_slope(v / (F.col("_max") + F.lit(1e-10)), F.col("idx").cast("double")).alias("slope"))
    gaps = ordered(beats.select("video_id", "t_s").distinct(), VID, ["t_s"], lag={"_prev": F.col("t_s")})
    gap = F.col("t_s") - F.col("_prev")
    regular = gaps.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_beats"), (F.stddev_pop(gap) / (F.avg(gap) + F.lit(1e-10))).alias("_cv"))
    pulse = autocorr_peak(curve, whole_below=whole_below)
    out = stats.join(regular, VID, "left").join(pulse, VID, "left")
    return out.select(
        "video_id", "energy_max", "energy_mean",
        (F.col("energy_std") / (F.col("energy_mean") + F.lit(1e-10))).alias("cv"), F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.when(F.col("_beats") >= 4, F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_cv"))).otherwise(0.0)
        .alias("beat_regularity"), F.coalesce("pulse_regularity", F.lit(0.0)).alias("pulse_regularity"))


def _w(*parts: tuple[float, Column]) -> Column:
    total = None
    for weight, score in parts:
        term = score * F.lit(weight)
        total = term if total is None else total + term
    return total


def _not(score: Column) -> Column:
    return F.lit(1.0) - score


def classify_bgm(features: DataFrame) -> DataFrame:
    """Music type and confidence from ``bpm, spectral_centroid, low_ratio`` and ``music_features``."""
    b, c, low = F.col("bpm"), F.col("spectral_centroid"), F.col("low_ratio")
    v, k = F.col("cv"), F.col("slope")
    scores = [
        _w((.30, ramp(b, 120, 180)), (.20, gauss(c, 2500, 1000)), (.30, ramp(v, .3, .6)), (.20, gauss(low, .30, .12))),
        _w((.25, tri(b, 110, 30)), (.20, gauss(c, 2200, 800)), (.30, _not(ramp(v, .15, .30))),
           (.25, gauss(low, .30, .12))),
        _w((.25, _not(ramp(b, 60, 100))), (.25, _not(ramp(c, 800, 2000))), (.30, _not(ramp(v, .05, .25))),
           (.20, ramp(low, .30, .60))),
        _w((.25, tri(b, 75, 20)), (.20, _not(ramp(c, 800, 2000))), (.30, _not(ramp(k, -.005, .005))),
           (.25, ramp(low, .35, .65))),
        _w((.25, ramp(b, 110, 170)), (.25, ramp(c, 3000, 5000)), (.30, ramp(F.col("pulse_regularity"), .3, .8)),
           (.20, _not(ramp(low, .15, .35)))),
        _w((.20, ramp(b, 100, 170)), (.15, gauss(c, 2000, 900)), (.25, F.col("beat_regularity")),
           (.40, ramp(low, .40, .70))),
    ]
    best = first_best(list(zip(MUSIC_TYPES, scores)))
    rows = features.withColumn("_b", best)
    silent = F.coalesce(F.col("energy_max") == 0, F.lit(True))
    return rows.select(
        "video_id",
        F.when(silent | (F.col("_b.score") < 0.5), MUSIC_UNDECIDED).otherwise(F.col("_b.label")).alias("bgm_type"),
        F.when(silent, 0.0).otherwise(F.round("_b.score", 3)).alias("bgm_confidence"))


def classify_mood(features: DataFrame) -> DataFrame:
    """Mood, confidence and runner-up from ``bpm, energy_mean, cv, spectral_centroid, silence_ratio``."""
    b, e, v = F.col("bpm"), F.col("energy_mean"), F.col("cv")
    c, q = F.col("spectral_centroid"), F.col("silence_ratio")
    scores = [
        _w((.30, _not(ramp(b, 60, 90))), (.30, _not(ramp(e, .04, .12))), (.25, _not(ramp(c, 800, 2000))),
           (.15, ramp(q, .02, .15))),
        _w((.30, ramp(b, 95, 140)), (.25, ramp(c, 1800, 4000)), (.30, _not(ramp(v, .20, .45))),
           (.15, _not(ramp(q, .05, .20)))),
        _w((.30, ramp(b, 100, 150)), (.35, ramp(v, .30, .60)), (.20, gauss(c, 2500, 1200)),
           (.15, _not(ramp(q, .05, .15)))),
        _w((.25, _not(ramp(b, 55, 95))), (.30, _not(ramp(e, .03, .10))), (.25, _not(ramp(c, 800, 2000))),
           (.20, ramp(q, .05, .25))),
        _w((.30, tri(b, 95, 25)), (.30, gauss(e, .08, .04)), (.25, gauss(c, 1800, 800)), (.15, tri(q, .05, .08))),
        _w((.35, ramp(b, 120, 180)), (.35, ramp(e, .12, .25)), (.15, gauss(c, 2500, 1200)),
           (.15, _not(ramp(q, .02, .10)))),
    ]
    rows = features.withColumn("_r", ranked(list(zip(MOODS, scores))))
    first, second = F.get("_r", 0), F.get("_r", 1)
    return rows.select(
        "video_id", first["label"].alias("mood"),
        F.round(F.least(F.greatest(first["score"], F.lit(0.0)), F.lit(1.0)), 3).alias("mood_confidence"),
        F.when(second["score"] > 0.30, second["label"]).otherwise("").alias("mood_secondary"))


def fallback_bpm(curve: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Tempo guessed from the difference curve: 80 plus 100 times the share above the threshold."""
    share = F.avg(F.when(F.col("value") > threshold, 1.0).otherwise(0.0))
    return curve.groupBy("video_id").agg((F.lit(80.0) + share * 100.0).alias("bpm"))


def coalesce_signals(energy: DataFrame, diff: DataFrame) -> DataFrame:
    """The energy curve of a video, else its difference curve."""
    missing = diff.join(energy.select("video_id").distinct(), VID, "left_anti")
    return energy.withColumn("channel", F.lit("rms")).unionByName(
        missing.withColumn("channel", F.lit("diff")), allowMissingColumns=True)


def resolve_duration(videos: DataFrame) -> DataFrame:
    """Duration from audio, else from frames, else the last text time."""
    def known(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name)) if name in videos.columns else F.lit(None).cast("double")

    return videos.select("video_id", F.coalesce(
        known("audio_duration"), known("frame_duration"), known("last_text_s"), F.lit(0.0)).alias("duration_s"))


def full_text(spans: DataFrame) -> DataFrame:
    """Transcript text of a video in order, always one row per video.

    The text is one value by definition, so a video's words meet in one row;
    a day of speech is about a megabyte.
    """
    return spans.groupBy("video_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("full_text"))


def bin_slice(points: DataFrame, bars: int = 20) -> DataFrame:
    """At most 20 bars per slice; every bar, also a short last one, is divided by the bar width.

    ``points`` comes from ``windows.slice_curve``.
    """
    key = "win" if "win" in points.columns else "seg_idx"
    width = F.greatest(F.lit(1), F.floor((F.col("i_to") - F.col("i_from")) / bars))
    rows = points.withColumn("_w", width).withColumn("bar", F.floor(F.col("slice_pos") / F.col("_w")))
    return rows.filter(F.col("bar") < bars).groupBy("video_id", key, "bar").agg(
        (F.sum("value") / F.max("_w")).alias("value"))
