"""Creative-pattern aggregates of a video: pacing, text, packaging, transitions, music."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.functions.expressions import safe_ratio, when_chain
from clipline.operators.ordered import islands, ordered, percentiles
from clipline.operators.ranges import points_in_spans
from clipline.operators.windows import curve_totals, points_in_windows
from clipline.session import cut

VID = ["video_id"]


# -- pacing ---------------------------------------------------------------

def shots(boundaries: DataFrame, videos: DataFrame) -> DataFrame:
    """Shot durations in order: up to the first cut, between cuts, after the last cut.

    Only positive lengths count; videos without cuts have no shots.
    """
    cuts = boundaries.groupBy("video_id", "t_s").agg(F.count(F.lit(1)).alias("_same"))
    near = ordered(cuts, VID, ["t_s"], lag={"_prev": F.col("t_s")}).withColumn("_prev", F.coalesce("_prev", F.lit(0.0)))
    inner = near.select("video_id", F.col("_prev").alias("start_s"), (F.col("t_s") - F.col("_prev")).alias("duration"))
    last = cuts.groupBy("video_id").agg(F.max("t_s").alias("start_s"))
    tail = videos.join(last, "video_id").select(
        "video_id", "start_s", (F.col("duration_s") - F.col("start_s")).alias("duration"))
    every = inner.unionByName(tail).filter(F.col("duration") > 0)
    return ordered(every, VID, ["start_s"], number="shot_idx")


def duration_hist(shot_rows: DataFrame) -> DataFrame:
    """Shares of shots under 1 s, 1-3 s, 3-5 s and longer, their number and mean."""
    d = F.col("duration")
    n = F.count(F.lit(1))

    def share(condition: Column) -> Column:
        return F.round(F.count_if(condition) / n, 3)

    return shot_rows.groupBy("video_id").agg(
        n.alias("shot_count"), F.round(F.avg(d), 2).alias("avg_shot_duration"),
        share(d < 1.0).alias("under_1s"), share((d >= 1.0) & (d < 3.0)).alias("from_1s_to_3s"),
        share((d >= 3.0) & (d < 5.0)).alias("from_3s_to_5s"), share(d >= 5.0).alias("over_5s"))


def rhythm_pattern(shot_rows: DataFrame) -> DataFrame:
    """Pacing label from the mean shot length of the first, second and last third."""
    sizes = shot_rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = shot_rows.join(sizes, "video_id")
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    part = F.when(F.col("shot_idx") < k, 0).when(F.col("shot_idx") < 2 * k, 1).otherwise(2)
    d = F.col("duration")
    means = rows.withColumn("_part", part).groupBy("video_id").agg(
        F.max("_n").alias("_n"), F.avg(d).alias("_all"), *[
            F.avg(F.when(F.col("_part") == i, d)).alias(f"_m{i}") for i in range(3)])
    a, m, b, all_ = F.col("_m0"), F.col("_m1"), F.col("_m2"), F.col("_all")

    def apart(x: Column, y: Column) -> Column:
        return F.abs(x - y) / F.greatest((x + y) / 2, F.lit(0.01))

    by_mean = F.when(all_ < 1.5, "快切为主").otherwise("均匀")
    label = when_chain([
        (F.col("_n") < 6, by_mean), ((apart(a, m) < 0.20) & (apart(m, b) < 0.20), "均匀"),
        ((a < m) & (b < m), "慢-快-慢"), ((a > m) & (b > m), "快-慢-快")], by_mean)
    return means.select("video_id", label.alias("rhythm_pattern"))


def rate_by_type(points: DataFrame, segments: DataFrame, name: str = "rate") -> DataFrame:
    """Highest number of points per second (ends included) among the segments of each type."""
    counted = points_in_windows(points, segments, bucket=4.0, levels=3)
    rate = F.round(safe_ratio(F.col("cuts"), F.col("end_s") - F.col("start_s"), 0.01), 3)
    return counted.groupBy("video_id", "structure_type").agg(F.max(rate).alias(name))


def curve_intensity(curve: DataFrame) -> DataFrame:
    """Quartiles, mean, peak, variance and share of values above 0.1 of a curve."""
    v = F.col("value")
    quartiles = percentiles(curve, VID, "value", {"p25": 0.25, "p75": 0.75})
    stats = curve.groupBy("video_id").agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.max(v), 4).alias("peak"),
        F.round(F.var_pop(v), 6).alias("variance"),
        F.round(F.count_if(v > 0.1) / F.count(v), 3).alias("dynamic_ratio"))
    return stats.join(quartiles, "video_id").withColumn("p25", F.round("p25", 4)).withColumn("p75", F.round("p75", 4))


# -- on-screen text -------------------------------------------------------

def timed_texts(ocr: DataFrame) -> DataFrame:
    """One row per readable text region with its box as (x, y, w, h).

    Boxes come as four corner points, or as one row of four values; rows with
    a negative time or blank text are dropped.  ``seq`` orders the regions.
    """
    rows = ocr.filter(F.col("t_s") >= 0).select(
        "video_id", "frame_index", "t_s", F.posexplode("regions").alias("seq", "_r"))
    box = F.col("_r.bbox")
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    corners = F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"),
        (F.array_max(ys) - F.array_min(ys)).alias("h"))
    flat = F.struct(*[F.get(F.get(box, 0), i).alias(n) for i, n in enumerate("xywh")])
    return rows.select(
        "video_id", "frame_index", "t_s", "seq", F.trim("_r.text").alias("text"),
        F.when(F.size(box) >= 4, corners).when((F.size(box) == 1) & (F.size(F.get(box, 0)) >= 4), flat).alias("box")
    ).filter(F.col("text") != "")


def position_shares(texts: DataFrame, *, frame_height: float = 1080.0, compat: bool = False) -> DataFrame:
    """Shares of texts in the top, centre and bottom third by the centre of their box.

    ``compat=True`` compares raw pixels with the 0-1 limits, so that nearly
    every text counts as bottom.
    """
    centre = F.col("box.y") + F.col("box.h") / 2
    centre = centre if compat else centre / F.lit(float(frame_height))
    rows = texts.filter(F.col("box").isNotNull()).withColumn("_c", centre)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return rows.groupBy("video_id").agg(
        F.round(F.count_if(F.col("_c") < 0.33) / n, 3).alias("top"),
        F.round(F.count_if((F.col("_c") >= 0.33) & (F.col("_c") <= 0.67)) / n, 3).alias("center"),
        F.round(F.count_if(F.col("_c") > 0.67) / n, 3).alias("bottom"))


def appearance_timing(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """How texts appear relative to speech: mean delay, share in sync, share ahead.

    A text inside a span is in sync, delayed by the time since the first such
    span began.  Any other text is compared with the spans in start order: the
    one that ended last before it and the next one to begin.  It leads when
    the next one is strictly nearer, else it trails the earlier one.
    """
    points = texts.select("video_id", "t_s")
    points = points.groupBy("video_id", "t_s").agg(F.count(F.lit(1)).alias("_n"))
    said = spans.select("video_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    inside = points_in_spans(points, said, VID, "t_s", "_s", "_e", bucket=4.0, levels=3)
    inside = inside.groupBy("video_id", "t_s").agg(F.min("_s").alias("_from"))

    marks = points.select("video_id", F.col("t_s").alias("_at"), F.lit(1).alias("_kind"), "_n",
                          F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_e"))
    spans_ = said.groupBy("video_id", "_s").agg(F.max("_e").alias("_e")).select(
        "video_id", F.col("_s").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_n"), "_s", "_e")
    near = ordered(marks.unionByName(spans_), VID, ["_at", "_kind"],
                   before={"_ended": ("max", F.col("_e"))}, after={"_next": ("min", F.col("_s"))})
    rows = near.filter("_kind = 1").select("video_id", F.col("_at").alias("t_s"), "_n", "_ended", "_next")
    rows = rows.join(inside, ["video_id", "t_s"], "left")
    trail, lead = F.col("t_s") - F.col("_ended"), F.col("_next") - F.col("t_s")
    sync = F.col("_from").isNotNull()
    leads = ~sync & lead.isNotNull() & (trail.isNull() | (lead < trail))
    delay = F.when(sync, F.greatest(F.col("t_s") - F.col("_from"), F.lit(0.0))).when(~leads, trail)
    n = F.col("_n")
    return rows.groupBy("video_id").agg(
        F.round(F.coalesce(F.try_divide(F.sum(delay * n), F.sum(F.when(delay.isNotNull(), n))), F.lit(0.0)), 2)
        .alias("avg_delay_after_speech"),
        F.round(F.sum(F.when(sync, n).otherwise(0)) / F.sum(n), 3).alias("sync_ratio"),
        F.round(F.sum(F.when(leads, n).otherwise(0)) / F.sum(n), 3).alias("lead_ratio"))


def avg_text_gap(texts: DataFrame, longest: float = 10.0) -> DataFrame:
    """Mean time between texts, ignoring gaps of ``longest`` seconds or more; 0 without gaps."""
    times = texts.groupBy("video_id", "t_s").agg(F.count(F.lit(1)).alias("_n"))
    near = ordered(times, VID, ["t_s"], lead={"_next": F.col("t_s")})
    gap = F.col("_next") - F.col("t_s")
    counted = F.when(gap < longest, 1).otherwise(0)
    total = F.sum(F.when(gap < longest, gap).otherwise(0.0))
    number = F.sum(F.col("_n") - 1 + counted)  # equal times are gaps of 0
    return near.groupBy("video_id").agg(
        F.round(F.coalesce(F.try_divide(total, number), F.lit(0.0)), 2).alias("avg_text_duration"))


def text_density(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Highest number of texts per second among the segments of each type."""
    return rate_by_type(texts, segments, "density")


def sample_texts(texts: DataFrame, segments: DataFrame | None, limit: int = 10) -> DataFrame:
    """First text of at least two characters per segment type, at most ten; without segments the first five.

    A type takes its text from its first segment that shows one.
    ``texts`` needs a total order (``t_s``, ``seq``).
    """
    long_enough = texts.filter(F.length("text") >= 2)
    if segments is None:
        rows = ordered(long_enough, VID, ["t_s", "seq"], number="sample_idx")
        return rows.filter(F.col("sample_idx") < 5).select("video_id", "sample_idx", "text")
    spans = segments.select("video_id", "seg_idx", "start_s", "end_s", "structure_type")
    hits = points_in_spans(long_enough, spans, VID, "t_s", "start_s", "end_s", bucket=4.0, levels=3)
    firsts = hits.groupBy("video_id", "structure_type").agg(
        F.min(F.struct("seg_idx", "t_s", "seq", "text")).alias("_f"))
    rows = firsts.select("video_id", "structure_type", F.col("_f.seg_idx").alias("seg_idx"),
                         F.col("_f.text").alias("text"))
    # At most one row per segment type, so a handful per video.
    ranked = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(
        F.struct("seg_idx", "structure_type", "text"))).alias("_all"))
    out = ranked.select("video_id", F.posexplode(F.slice("_all", 1, limit)).alias("sample_idx", "_t"))
    return out.select("video_id", F.col("sample_idx").cast("long").alias("sample_idx"),
                      F.col("_t.structure_type").alias("structure_type"), F.col("_t.text").alias("text"))


# -- packaging ------------------------------------------------------------

def pick_frames(features: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Feature rows where a video has any, else its key frames."""
    bare = keyframes.join(features.select("video_id").distinct(), VID, "left_anti")
    return features.unionByName(bare, allowMissingColumns=True)


def _mean(name: str) -> Column:
    return F.avg(F.coalesce(F.col(name), F.lit(0.0)))


def color_style(frames: DataFrame) -> DataFrame:
    means = frames.groupBy("video_id").agg(_mean("saturation_mean").alias("_s"), _mean("brightness_std").alias("_b"))
    s = F.col("_s")
    level = when_chain([(s > 120, "高饱和"), (s > 60, "中饱和"), (s > 20, "低饱和")], "极低饱和/灰度")
    tone = when_chain([(s > 90, "暖色调"), (s > 60, "中性"), (s > 20, "冷色调")], "灰度/黑白")
    return means.select(
        "video_id", level.alias("saturation_level"), F.round("_s", 1).alias("avg_saturation"), tone.alias("tone"),
        F.when(F.col("_b") > 60, "高对比度").otherwise("标准").alias("contrast"))


def composition_pref(frames: DataFrame) -> DataFrame:
    means = frames.groupBy("video_id").agg(
        F.avg(F.when(F.col("face_count") > 0, 1.0).otherwise(0.0)).alias("_f"), _mean("face_area_ratio").alias("_a"),
        _mean("edge_density").alias("_e"))
    f, a, e = F.col("_f"), F.col("_a"), F.col("_e")
    label = when_chain([
        ((f > 0.4) & (a > 0.05), "中心构图（人物主导）"), ((e < 0.04) & (f < 0.2), "简洁留白"),
        (e > 0.12, "密集构图")], "均衡构图")
    return means.select(
        "video_id", label.alias("preference"), F.round("_f", 3).alias("face_frame_ratio"),
        F.round("_a", 4).alias("avg_face_area"), F.round("_e", 4).alias("avg_edge_density"))


def object_rates(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(*[
        F.round(_mean(f"{kind}_count"), 2).alias(f"avg_{kind}_per_frame") for kind in ("person", "vehicle", "animal")])


def packaging_shares(frames: DataFrame) -> DataFrame:
    """Shares of title cards, plain backgrounds and all other frames."""
    entropy, edges, flow = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("gray_entropy", "edge_density", "optical_flow"))
    kind = when_chain([((entropy > 5.0) & (flow < 3.0), 0), ((entropy < 2.0) & (edges < 0.03), 1)], 2)
    rows = frames.select("video_id", kind.alias("_k"))
    return rows.groupBy("video_id").agg(*[
        F.round(F.count_if(F.col("_k") == i) / F.count(F.lit(1)), 3).alias(n) for i, n in enumerate(
            ("title_card_ratio", "pure_background_ratio", "packaged_frame_ratio"))])


def brightness_stats(frames: DataFrame) -> DataFrame:
    b = F.coalesce(F.col("brightness_mean"), F.lit(0.0))
    return frames.groupBy("video_id").agg(
        F.round(F.min(b), 1).alias("min"), F.round(F.max(b), 1).alias("max"), F.round(F.avg(b), 1).alias("avg"))


# -- transitions ----------------------------------------------------------

def _transitions(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("structure_type").isin("transition", "effect"))


def transition_stats(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Number, density and share per sub-type of transition and effect segments.

    Videos with segments but no transitions keep a row with a count of 0.
    """
    name = F.coalesce(F.nullif(F.col("sub_type"), F.lit("")), F.col("structure_type"))
    kinds = _transitions(segments).groupBy("video_id", name.alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    # Sub-types come from a fixed list, so the arrays stay short.
    per_video = kinds.groupBy("video_id").agg(
        F.sum("_n").alias("total_count"), F.sort_array(F.collect_list(F.struct("_name", "_n"))).alias("_all"))
    out = segments.select("video_id").distinct().join(per_video, VID, "left").join(videos, VID, "left")
    total = F.col("total_count")
    shares = F.map_from_entries(F.transform("_all", lambda s: F.struct(s["_name"], F.round(s["_n"] / total, 3))))
    return out.select(
        "video_id", F.coalesce(total, F.lit(0)).alias("total_count"),
        F.round(F.coalesce(total, F.lit(0)) / F.greatest(F.coalesce("duration_s", F.lit(1.0)), F.lit(0.01)), 3)
        .alias("density_per_second"), shares.alias("type_distribution"))


def usage_context(segments: DataFrame) -> DataFrame:
    """Sorted distinct evidence per sub-type of transition and effect segments."""
    rows = _transitions(segments).select("video_id", "sub_type", F.explode("evidence").alias("evidence"))
    return rows.groupBy("video_id", "sub_type").agg(F.sort_array(F.collect_set("evidence")).alias("contexts"))


def cut_signals(keyframes: DataFrame) -> DataFrame:
    h = F.coalesce(F.col("histogram_distance"), F.lit(0.0))
    return keyframes.groupBy("video_id").agg(
        F.round(F.avg(F.when(h > 0.3, 1.0).otherwise(0.0)), 3).alias("high_visual_change_ratio"),
        F.round(F.avg(h), 4).alias("avg_histogram_distance"), F.round(F.max(h), 4).alias("max_histogram_distance"))


# -- music ----------------------------------------------------------------

def beat_alignment(boundaries: DataFrame, audio: DataFrame) -> DataFrame:
    """Share of cuts within 0.08 s of the beat grid, mean offset and tier; ``audio`` has ``bpm``."""
    rows = boundaries.join(audio.filter(F.col("bpm") > 0).select("video_id", "bpm"), "video_id")
    interval = F.lit(60.0) / F.col("bpm")
    offset = F.abs(F.col("t_s") - F.rint(F.col("t_s") / interval) * interval)
    stats = rows.withColumn("_o", offset).groupBy("video_id").agg(
        F.max("bpm").alias("bpm"), F.avg(F.when(F.col("_o") < 0.08, 1.0).otherwise(0.0)).alias("_r"),
        F.avg("_o").alias("_m"))
    tier = when_chain([(F.col("_r") > 0.7, "强拍对齐"), (F.col("_r") > 0.3, "弱对齐")], "无对齐")
    return stats.select(
        "video_id", "bpm", F.round(F.lit(60.0) / F.col("bpm"), 3).alias("beat_interval"),
        F.round("_r", 3).alias("sync_density"), tier.alias("sync_pattern"),
        F.round("_m", 3).alias("avg_offset_from_beat"))


def smooth_curve(curve: DataFrame) -> DataFrame:
    """Centred moving average over ``max(3, n // 20)`` points, zeros beyond both ends.

    The window width differs per video, so a row frame cannot express it. A
    window is the difference of two running sums: every point sends its sum to
    the window that ends there and, with a minus, to the one that starts behind
    it; the last point to all windows that reach beyond the end.
    """
    n, idx = F.col("n_points"), F.col("idx")
    totals = curve_totals(curve).select("video_id", "n_points")
    sums = ordered(curve.select("video_id", "idx", "value"), VID, ["idx"], dense=True,
                   running={"_sum": ("sum", F.col("value"))})
    w = F.when(n >= 6, F.greatest(F.lit(3), F.floor(n / 20))).otherwise(3).cast("long")
    rows = sums.select("video_id", "idx", "_sum").join(totals, "video_id").withColumn("_w", w)
    ahead, behind = F.floor((F.col("_w") - 1) / 2).cast("long"), F.floor(F.col("_w") / 2).cast("long")
    first = F.greatest(F.lit(0).cast("long"), idx - ahead)
    ends = F.when(idx == n - 1, F.sequence(first, idx)).when(idx >= ahead, F.array(first)).otherwise(
        F.array().cast("array<bigint>"))
    starts = F.when(idx + behind + 1 < n, F.array(idx + behind + 1)).otherwise(F.array().cast("array<bigint>"))
    sent = F.concat(F.transform(ends, lambda i: F.struct(i.alias("idx"), F.lit(1.0).alias("sign"))),
                    F.transform(starts, lambda i: F.struct(i.alias("idx"), F.lit(-1.0).alias("sign"))))
    parts = rows.select("video_id", "_sum", "_w", "n_points", F.explode(sent).alias("_x"))
    return parts.groupBy("video_id", F.col("_x.idx").alias("idx")).agg(
        (F.sum(F.col("_x.sign") * F.col("_sum")) / F.max("_w")).alias("smoothed"),
        F.max("n_points").alias("n_points"))


def energy_sections(curve: DataFrame, videos: DataFrame, limit: int = 10, digits: int = 9) -> DataFrame:
    """First ten rising or falling sections of the smoothed curve (slope beyond 0.001).

    Slopes are rounded to ``digits`` decimals before they are compared, which
    keeps the result free of summation order.  The smoothed curve is stored
    once, since the ordered steps behind it read it several times.
    """
    near = ordered(cut(smooth_curve(curve).filter("n_points >= 6")), VID, ["idx"], dense=True,
                   lead={"_next": F.col("smoothed")})
    slope = F.round(F.col("_next") - F.col("smoothed"), digits)
    steps = near.filter(F.col("_next").isNotNull() & (F.col("idx") >= 1)).withColumn(
        "trend", F.when(slope > 0.001, 1).when(slope < -0.001, -1).otherwise(0))
    runs = islands(steps, VID, ["idx"], dense=True, values={"t": F.col("trend")},
                   together=lambda a, b: a["t"] == b["t"])
    found = runs.filter("trend <> 0").groupBy("video_id", "island").agg(
        F.min("idx").alias("_i"), (F.max("idx") + 1).alias("_j"), F.max("trend").alias("trend"),
        F.max("n_points").alias("_n"))
    numbered = ordered(found, VID, ["_i"], number="section").filter(F.col("section") < limit).join(videos, "video_id")
    d = F.col("duration_s")
    return numbered.filter(d > 0).select(
        "video_id", "section", F.round(F.col("_i") / F.col("_n") * d, 1).alias("start_s"),
        F.round(F.col("_j") / F.col("_n") * d, 1).alias("end_s"),
        F.when(F.col("trend") > 0, "能量上升").otherwise("能量下降").alias("label"))


def energy_cut_bins(curve: DataFrame, boundaries: DataFrame, videos: DataFrame, bins: int = 10) -> DataFrame:
    """Mean curve value (4 decimals) and number of cuts in each of ten equal parts."""
    totals = curve_totals(curve).select("video_id", "n_points")
    n, d = F.col("n_points"), F.col("duration_s")
    base = (videos.filter(d > 0).join(totals, "video_id")
            .join(boundaries.select("video_id").distinct(), VID, "left_semi"))
    width = d / F.lit(bins)
    grid = base.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn(
        "start_s", F.col("bin") * width).withColumn("end_s", (F.col("bin") + 1) * width)
    i0 = F.greatest(F.lit(0), F.least((F.col("start_s") / d * n).cast("long"), n - 1))
    i1 = F.greatest(i0 + 1, F.least((F.col("end_s") / d * n).cast("long"), n))
    grid = grid.withColumn("i0", i0).withColumn("i1", i1)
    # Each point tests the few bins around its own share of the curve.
    points = curve.select("video_id", "idx", "value").join(totals, "video_id")
    guess = F.floor(F.col("idx") / n * bins).cast("int")
    near = points.withColumn("bin", F.explode(F.sequence(guess - 1, guess + 1)))
    energy = near.join(grid.select("video_id", "bin", "i0", "i1"), ["video_id", "bin"]).filter(
        (F.col("idx") >= F.col("i0")) & (F.col("idx") < F.col("i1")))
    energy = energy.groupBy("video_id", "bin").agg(F.round(F.avg("value"), 4).alias("energy"))
    times = boundaries.select("video_id", "t_s").join(videos.filter(d > 0), "video_id")
    guess = F.floor(F.col("t_s") / width).cast("int")
    cuts = times.withColumn("bin", F.explode(F.sequence(guess - 1, guess + 1))).filter(
        (F.col("t_s") >= F.col("bin") * width) & (F.col("t_s") < (F.col("bin") + 1) * width))
    cuts = cuts.groupBy("video_id", "bin").agg(F.count(F.lit(1)).alias("cuts"))
    return (grid.select("video_id", "bin").join(energy, ["video_id", "bin"], "left")
            .join(cuts, ["video_id", "bin"], "left").fillna({"energy": 0.0, "cuts": 0}))


def energy_cut_corr(curve: DataFrame, boundaries: DataFrame, videos: DataFrame) -> DataFrame:
    """Pearson correlation of energy and cuts over ten parts; 0 when either does not vary.

    ``corr`` itself divides by zero, an error, where one of them does not vary.
    """
    bins = energy_cut_bins(curve, boundaries, videos)
    x, y = F.col("energy"), F.col("cuts").cast("double")
    stats = bins.groupBy("video_id").agg(
        F.covar_pop(x, y).alias("_c"), F.sqrt(F.var_pop(x) * F.var_pop(y)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    r = F.when(F.col("_s") * F.col("_n") > 1e-10, F.nanvl(F.try_divide("_c", "_s"), F.lit(0.0)))
    return stats.select("video_id", F.round(F.coalesce(r, F.lit(0.0)), 3).alias("pearson_r"))


# -- all dimensions -------------------------------------------------------

def deconstruct(videos: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """One row per video with every dimension as a struct; a missing one is null, never an error.

    Each dimension is a table with one row per ``video_id``.
    """
    out = videos.select("video_id")
    for name, table in dimensions.items():
        fields = [c for c in table.columns if c != "video_id"]
        out = out.join(table.select("video_id", F.struct(*fields).alias(name)), VID, "left")
    return out
