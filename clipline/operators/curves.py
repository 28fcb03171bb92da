"""Curves, histograms and key-frame sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipline.operators.ordered import nearest_rank, ordered, with_totals
from clipline.operators.walks import chunk_size, run_walk, sparse_walk

VID = ["video_id"]


# -- histograms -----------------------------------------------------------

def _with_values(body, **values: Column) -> Column:
    """Evaluate ``values`` once and hand them to ``body``.

    A column used inside a lambda would be evaluated again for every element.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.get(F.transform(F.array(row), body), 0)


def normalize_hist(hist: Column, mode: str = "minmax") -> Column:
    """``minmax`` scales to 0..1 (a flat histogram becomes 0), ``l2`` to length 1."""
    if mode == "minmax":
        return _with_values(
            lambda r: F.transform(r["h"], lambda x: F.coalesce(
                F.try_divide(x - r["lo"], r["hi"] - r["lo"]), F.lit(0.0))),
            h=hist, lo=F.array_min(hist), hi=F.array_max(hist))
    if mode != "l2":
        raise ValueError(f"unknown mode {mode}")
    return _with_values(
        lambda r: F.transform(r["h"], lambda x: F.coalesce(F.try_divide(x, r["norm"]), F.lit(0.0))),
        h=hist, norm=F.sqrt(F.aggregate(hist, F.lit(0.0), lambda a, x: a + x * x)))


def chi_square(before: Column, after: Column) -> Column:
    """Sum of (a - b)^2 / a over the bins whose earlier value a is not 0."""
    parts = F.zip_with(before, after, lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise((a - b) * (a - b) / a))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def diff_curve(frames: DataFrame, frame_skip: int = 5, *, hist: str = "hist") -> DataFrame:
    """Distance of every kept frame to the one kept before; keeps each ``frame_skip``-th frame.

    Output ``idx`` counts the distances; ``frame_index`` is the later frame
    and ``t_s`` its time, where the frames carry ``fps``.
    """
    kept = frames.filter(F.col("idx") % frame_skip == 0)
    near = ordered(kept, VID, ["idx"], dense=True, lag={"_prev": F.col(hist)})
    near = near.filter(F.col("_prev").isNotNull())
    time = F.col("idx") / F.col("fps") if "fps" in frames.columns else F.lit(None).cast("double")
    return near.select(
        "video_id", (F.col("idx") / frame_skip).cast("long").alias("step"), F.col("idx").alias("frame_index"),
        time.alias("t_s"), chi_square(F.col("_prev"), F.col(hist)).alias("value")).withColumn(
            "idx", F.col("step") - 1).drop("step")


def pair_distance(frames: DataFrame, *, hist: str = "hist") -> DataFrame:
    """Histogram distance of every key frame to the previous one; 0 for the first."""
    near = ordered(frames, VID, ["idx"], dense=True, lag={"_prev": F.col(hist)})
    return near.withColumn("histogram_distance", F.coalesce(chi_square(F.col("_prev"), F.col(hist)), F.lit(0.0))).drop(
        "_prev")


# -- cuts and scenes ------------------------------------------------------

def detect_cuts(curve: DataFrame, threshold: float = 27.0, min_len: int = 15, *, chunk: int | None = None) -> DataFrame:
    """Scene starts: position 0 and every score at or above the threshold, ``min_len`` after the last start.

    The curve holds one score per frame (``idx`` 0, 1, 2, ...). Only the frames
    that can start a scene take part in the walk.
    """
    starts = (F.col("value") >= threshold) | (F.col("idx") == 0)
    found = curve.filter(starts).select("video_id", F.col("idx").cast("long").alias("idx"), "t_s")
    return sparse_walk(found, min_len, chunk=chunk)


def scenes(boundaries: DataFrame, videos: DataFrame) -> DataFrame:
    """Scene table from scene starts: end is the next start, for the last one the end of the video."""
    near = ordered(boundaries.select("video_id", "t_s").distinct(), VID, ["t_s"], number="scene_idx",
                   lead={"_next": F.col("t_s")})
    rows = near.join(videos, "video_id")
    out = rows.select("video_id", "scene_idx", F.col("t_s").alias("start_s"),
                      F.coalesce("_next", "duration_s").alias("end_s"), *(["fps"] if "fps" in videos.columns else []))
    if "fps" in videos.columns:
        out = (out.withColumn("start_frame", F.rint(F.col("start_s") * F.col("fps")).cast("long"))
               .withColumn("end_frame", F.rint(F.col("end_s") * F.col("fps")).cast("long")).drop("fps"))
    return out


def curve_stats(curve: DataFrame) -> DataFrame:
    """Duration (last time) and points per second of a curve."""
    return curve.groupBy("video_id").agg(F.max("t_s").alias("duration_s"), F.count(F.lit(1)).alias("n_points")).withColumn(
        "rate", F.try_divide(F.col("n_points"), F.col("duration_s")))


# -- sampling -------------------------------------------------------------

def percentile_threshold(curve: DataFrame, percent: float = 75.0) -> DataFrame:
    """Nearest-rank percentile of a curve per video, as ``threshold``."""
    return nearest_rank(curve, VID, "value", {"threshold": percent})


def boundary_frames(boundaries: DataFrame, videos: DataFrame, margin: int = 2) -> DataFrame:
    """Distinct frames around the cuts; ``videos`` has ``fps`` and ``n_frames``."""
    rows = boundaries.join(videos.select("video_id", "fps", "n_frames"), "video_id")
    centre = F.rint(F.col("t_s") * F.col("fps")).cast("long")
    near = rows.withColumn("frame_index", F.explode(F.sequence(centre - margin, centre + margin)))
    near = near.filter((F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("n_frames")))
    return near.select("video_id", "frame_index").distinct()


def adaptive_sample(curve: DataFrame, *, percent: float = 75.0, dense: int = 5, sparse: int = 30,
                    chunk: int | None = None) -> DataFrame:
    """Frames visited by a walk that takes short steps where the curve is high.

    A curve of n points belongs to n + 1 frames.  At each visited frame the
    larger of the difference before and after it decides the step: ``dense``
    above the percentile threshold, else ``sparse``.
    """
    reach = max(dense, sparse)
    size = chunk_size(reach, chunk)
    idx, at_end = F.col("idx").cast("long"), F.col("idx") == F.col("_n") - 1
    sizes = curve.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    known = percentile_threshold(curve, percent).join(sizes, "video_id")
    points = curve.select("video_id", "idx", F.col("value").cast("double").alias("value")).join(known, "video_id")

    def place(chunk_of: Column, frame: Column, value: Column, guest: bool) -> Column:
        return F.struct(F.floor(chunk_of / size).cast("long").alias("_chunk"), frame.alias("start"),
                        value.alias("value"), F.lit(guest).alias("guest"))

    # Frame i looks at points i - 1 and i; a chunk also gets the point before it, and the last frame has no point.
    rows = points.select("video_id", "threshold", F.explode(F.array_compact(F.array(
        place(idx, idx, F.col("value"), False),
        F.when(idx % size == size - 1, place(idx + 1, idx, F.col("value"), True)),
        F.when(at_end, place(idx + 1, idx + 1, F.lit(0.0), False))))).alias("p")).select("video_id", "threshold", "p.*")
    by_frame = Window.partitionBy("video_id", "_chunk").orderBy("start")
    before = F.coalesce(F.lag("value").over(by_frame), F.lit(0.0))
    rows = rows.withColumn("step", F.when(F.greatest("value", before) > F.col("threshold"), dense).otherwise(sparse))
    rows = rows.filter("NOT guest").withColumn("_new", F.when(F.lag("step").over(by_frame) == F.col("step"), 0).otherwise(1))
    runs = rows.withColumn("_run", F.sum("_new").over(by_frame)).groupBy("video_id", "_chunk", "_run").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).alias("n"), F.max("step").cast("long").alias("step"))
    return run_walk(runs.drop("_run"), reach).withColumnRenamed("idx", "frame_index")


def sample_by_count(curve: DataFrame, boundaries: DataFrame, videos: DataFrame, target: int, *,
                    flat_tolerance: float = 0.05, margin: int = 2, **adaptive: float) -> DataFrame:
    """About ``target`` evenly spaced frames for flat curves, the adaptive walk otherwise, plus the cut frames."""
    if target <= 0:
        return boundary_frames(boundaries, videos, margin).limit(0)
    v = F.col("value")
    shape = curve.groupBy("video_id").agg(
        F.max(v).alias("_max"), F.min(v).alias("_min"), (F.count(F.lit(1)) + 1).alias("_n"))
    flat = (F.col("_max") - F.col("_min")) <= F.lit(flat_tolerance) * F.greatest("_max", F.lit(1e-9))
    level = shape.filter(flat)
    wanted = F.least(F.lit(target), F.col("_n"))
    step = (F.col("_n") - 1) / F.greatest(wanted - 1, F.lit(1))
    grid = level.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), wanted - 1))).select(
        "video_id", F.rint(F.col("_i") * step).cast("long").alias("frame_index"), "_n").filter("frame_index < _n")
    lively = curve.join(shape.filter(~flat).select("video_id"), VID, "left_semi")
    cut_frames = boundary_frames(boundaries, videos, margin).join(shape.select("video_id"), VID, "left_semi")
    return (grid.select("video_id", "frame_index").unionByName(adaptive_sample(lively, **adaptive))
            .unionByName(cut_frames).distinct())


def sample_with_context(curve: DataFrame, boundaries: DataFrame, videos: DataFrame, *, margin: int = 2,
                        **adaptive: float) -> DataFrame:
    """Key frames of the adaptive walk and the cuts, with time, curve value and a boundary flag."""
    forced = boundary_frames(boundaries, videos, margin)
    frames = adaptive_sample(curve, **adaptive).withColumn("is_boundary", F.lit(False)).unionByName(
        forced.withColumn("is_boundary", F.lit(True)))
    frames = frames.groupBy("video_id", "frame_index").agg(F.bool_or("is_boundary").alias("is_boundary"))
    values = curve.select("video_id", F.col("idx").alias("frame_index"), "value")
    return (frames.join(values, ["video_id", "frame_index"], "left").join(videos.select("video_id", "fps"), "video_id")
            .select("video_id", "frame_index", (F.col("frame_index") / F.col("fps")).alias("t_s"),
                    F.coalesce("value", F.lit(0.0)).alias("diff_value"), "is_boundary",
                    F.lit(None).cast("string").alias("source")))


def content_sample(videos: DataFrame, features: DataFrame, *, interval: float = 5.0, min_entropy: float = 4.5,
                   max_edges: float = 0.08) -> DataFrame:
    """Detailed but calm frames on a fixed time grid.

    ``videos`` has ``duration_s, fps, n_frames``; ``features`` one row per
    ``frame_index`` with ``gray_entropy`` and ``edge_density``.
    """
    d, fps = F.col("duration_s"), F.col("fps")
    last = F.ceil(d / F.lit(interval)).cast("long") - 1
    grid = videos.filter((d > 0) & (fps > 0)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    grid = grid.withColumn("t_s", F.col("_i") * F.lit(interval)).withColumn(
        "frame_index", (F.col("t_s") * fps).cast("long"))
    grid = grid.filter(F.col("frame_index") < F.least((d * fps).cast("long"), F.col("n_frames")))
    rows = grid.select("video_id", "frame_index", "t_s").join(
        features.select("video_id", "frame_index", "gray_entropy", "edge_density"), ["video_id", "frame_index"])
    return rows.filter((F.col("gray_entropy") > min_entropy) & (F.col("edge_density") < max_edges)).select(
        "video_id", "frame_index", "t_s", F.lit(0.0).alias("diff_value"), F.lit(False).alias("is_boundary"),
        F.lit("content").alias("source"))


def merge_keyframes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two channels; the first one wins on an equal frame."""
    extra = second.join(first.select("video_id", "frame_index"), ["video_id", "frame_index"], "left_anti")
    return first.unionByName(extra, allowMissingColumns=True)


def grid_sample(videos: DataFrame, *, every: float | None = None, count: int | None = None) -> DataFrame:
    """Frames every ``every`` seconds, or exactly ``count`` evenly spaced ones."""
    d, fps, n = F.col("duration_s"), F.col("fps"), F.col("n_frames")
    if (every is None) == (count is None):
        raise ValueError("give either every or count")
    if every is not None:
        slots = F.ceil(d / F.lit(float(every))).cast("long")
        rows = videos.filter(d > 0).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)))
        rows = rows.withColumn("_t", F.col("_i") * F.lit(float(every)))
        rows = rows.withColumn("frame_index", (F.col("_t") * fps).cast("long")).filter(F.col("frame_index") < n)
    else:
        if count < 2:
            return videos.limit(0).select("video_id", F.lit(0.0).alias("t_s"), F.lit(0).cast("long").alias("frame_index"))
        rows = videos.filter(d > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        rows = rows.withColumn("_t", F.col("_i") * (d / F.lit(count - 1)))
        rows = rows.withColumn("frame_index", F.least((F.col("_t") * fps).cast("long"), n - 1))
    return rows.select("video_id", F.round("_t", 1).alias("t_s"), "frame_index")


def blur_gate(frames: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Split reasons: ``kept`` is false for frames whose sharpness is below the threshold."""
    sharp = F.col("sharpness")
    reason = F.when(sharp.isNull(), "unreadable").when(sharp < threshold, "blurry")
    return frames.withColumn("reject_reason", reason).withColumn("kept", reason.isNull())


def speech_gate(videos: DataFrame, spans: DataFrame | None, threshold: float = 0.03) -> DataFrame:
    """Speech share and flag per video; without any span input the flag is true."""
    if spans is None:
        return videos.select("video_id", F.lit(1.0).alias("speech_ratio"), F.lit(True).alias("has_speech"))
    said = spans.groupBy("video_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_s"))
    rows = videos.join(said, VID, "left")
    ratio = F.round(F.coalesce("_s", F.lit(0.0)) / F.greatest("duration_s", F.lit(0.01)), 4)
    return rows.select("video_id", ratio.alias("speech_ratio"), (ratio >= threshold).alias("has_speech"))


def only_speech(videos: DataFrame, gate: DataFrame) -> DataFrame:
    """Videos that go on to transcription; videos the gate does not know pass."""
    silent = gate.filter(~F.col("has_speech")).select("video_id")
    return videos.join(silent, VID, "left_anti")


def display_bars(curve: DataFrame) -> DataFrame:
    """Values over the maximum of the curve, at least 0.02, for drawing."""
    scaled = with_totals(curve, VID, _max=F.max("value"))
    return scaled.withColumn("bar", F.greatest(F.lit(0.02), F.col("value") / F.greatest("_max", F.lit(0.01)))).drop("_max")
