"""Sliding windows over media time and the narrative segments found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.constants import (
    CLOSING_WORDS, HIGHLIGHT_WORDS, OPENING_WORDS, TRANSITION_WORDS, UNCLASSIFIED)
from clipline.functions import rules
from clipline.functions.expressions import contains_any
from clipline.operators.ordered import islands
from clipline.operators.presets import with_preset
from clipline.operators.ranges import edges_in_spans, overlapping, points_in_spans

_WINDOWS_PER_ROW = 100_000
#: Windows of a video that meet in one task with all that touches them.
_BLOCK = 256
#: Tasks for each shuffle partition: rows become many more only behind the shuffle.
_SPREAD = 4

WORD_LISTS = {
    "opening_word": OPENING_WORDS, "highlight_word": HIGHLIGHT_WORDS, "closing_word": CLOSING_WORDS,
    "transition_word": TRANSITION_WORDS}


def sliding_windows(videos: DataFrame, size: float = 1.0, step: float = 0.5) -> DataFrame:
    """Windows ``win, start_s, end_s`` per video, with one partial window up to the end.

    Videos no longer than ``size`` have none.  A video is first split into
    blocks of windows that are spread over the cluster, then expanded.
    """
    d = F.col("duration_s")
    full, slots = _counts(d, size, step)
    blocks = (videos.filter(d > size)
              .withColumn("_full", full).withColumn("_slots", slots)
              .withColumn("_block", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / _WINDOWS_PER_ROW).cast("long")))))
    parts = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "video_id", "_block")
    first = F.col("_block") * _WINDOWS_PER_ROW
    windows = blocks.withColumn("win", F.explode(F.sequence(
        first, F.least(first + (_WINDOWS_PER_ROW - 1), F.col("_slots") - 1))))
    start, end = _edges(F.col("win"), F.col("_full"), d, size, step)
    return windows.select(*videos.columns, "win", start.alias("start_s"), end.alias("end_s"))


def _counts(d: Column, size: float, step: float) -> tuple[Column, Column]:
    """How many windows of a video are whole, and how many it has with the partial one at its end."""
    full = F.floor((d - F.lit(float(size))) / F.lit(float(step))).cast("long") + 1
    return full, full + F.when(full * F.lit(float(step)) < d, 1).otherwise(0)


def _edges(win: Column, full: Column, d: Column, size: float, step: float) -> tuple[Column, Column]:
    def tenths(x: Column) -> Column:
        """To one decimal; multiples of a half have no more."""
        return x if step % 0.5 == size % 0.5 == 0 else F.round(x, 1)
    start = win * F.lit(float(step))
    return tenths(start), F.when(win < full, tenths(start + F.lit(float(size)))).otherwise(F.round(d, 1))


def _with_edges(wins: Column, full: Column, d: Column, size: float, step: float) -> Column:
    """Window numbers with their times, worked out once for each."""
    def one(win: Column) -> Column:
        start, end = _edges(win, full, d, size, step)
        return F.struct(win.alias("win"), start.alias("win_start"), end.alias("win_end"))
    return F.transform(wins, one)


def _near(low: Column, high: Column, slots: Column, size: float, step: float) -> tuple[Column, Column]:
    """First and last of all windows that may touch ``low`` to ``high`` (media time), one or two more on each side."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((low - F.lit(float(size))) / F.lit(float(step))).cast("long") - 1)
    return first, F.least(slots - 1, F.floor(high / F.lit(float(step))).cast("long") + 1)


def _near_windows(low: Column, high: Column, slots: Column, size: float, step: float) -> Column:
    first, last = _near(low, high, slots, size, step)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def touched_windows(rows: DataFrame, videos: DataFrame, start: str, end: str, size: float = 1.0,
                    step: float = 0.5) -> DataFrame:
    """``rows`` with every sliding window (win, win_start, win_end) that ``start`` to ``end`` touches, ends included.

    Window numbers follow from the times, so only the duration of a video is
    looked up; the windows themselves are not shuffled.
    """
    d = F.col("_d")
    full, slots = _counts(d, size, step)
    known = videos.filter(F.col("duration_s") > size).select("video_id", F.col("duration_s").alias("_d")).withColumns(
        {"_full": full, "_slots": slots})
    wins = _near_windows(F.col(start), F.col(end), F.col("_slots"), size, step)
    near = rows.filter(F.col(start) <= F.col(end)).join(known, "video_id").select(
        *rows.columns, F.explode(_with_edges(wins, F.col("_full"), d, size, step)).alias("_w"))
    near = near.select(*rows.columns, "_w.win", "_w.win_start", "_w.win_end")
    return near.filter((F.col("win_start") <= F.col(end)) & (F.col("win_end") >= F.col(start)))


def zones(windows: DataFrame, presets: DataFrame | None = None, *, compat: bool = False) -> DataFrame:
    """Flags: does the window lie in the opening or closing zone of its preset?"""
    tuned = with_preset(windows, presets, compat=compat)
    d = F.col("duration_s")
    return (tuned
            .withColumn("is_opening_zone", F.col("start_s") < d * F.col("opening_pct"))
            .withColumn("is_closing_zone", F.col("start_s") > d * (F.lit(1.0) - F.col("closing_pct"))))


# -- signals per window ---------------------------------------------------

def _span_key(spans: DataFrame) -> str:
    return "win" if "win" in spans.columns else "seg_idx"


def _levels(key: str) -> int:
    """Windows are short and of one length, segments of any length."""
    return 1 if key == "win" else 3


def _beside(spans: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``spans`` with what was found for them.

    Both sides have about a row for each window, many more than the files they
    come from let Spark guess, so neither is ever broadcast.
    """
    return spans.join(found.hint("merge"), ["video_id", key], "left")


def points_in_windows(points: DataFrame, spans: DataFrame, *, bucket: float = 1.0, levels: int | None = None,
                      videos: DataFrame | None = None) -> DataFrame:
    """Number of points inside each span, both ends included, and their rate; spans without points keep 0.

    Here and below, ``videos`` says that the spans are the sliding windows of
    these videos, whose numbers are then computed instead of joined.
    """
    key = _span_key(spans)
    points = points.select("video_id", "t_s")
    if videos is not None:
        hits = touched_windows(points, videos, "t_s", "t_s")
    else:
        hits = points_in_spans(points, spans.select("video_id", key, "start_s", "end_s"),
                               ["video_id"], "t_s", "start_s", "end_s", bucket=bucket, levels=levels or _levels(key))
    counts = hits.groupBy("video_id", key).agg(F.count(F.lit(1)).alias("_n"))
    length = F.col("end_s") - F.col("start_s")
    return (_beside(spans, counts, key)
            .withColumn("cuts", F.coalesce(F.col("_n"), F.lit(0)).cast("long")).drop("_n")
            .withColumn("cut_rate", F.when(length > 0, F.col("cuts") / length).otherwise(0.0)))


def curve_totals(curve: DataFrame) -> DataFrame:
    """Points, mean and maximum of a curve per video."""
    return curve.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("value").alias("curve_mean"), F.max("value").alias("curve_max"))


def _bounds(start: Column, end: Column, d: Column, n: Column) -> tuple[Column, Column]:
    i_from = F.greatest(F.lit(0), F.least((start / d * n).cast("long"), n - 1))
    return i_from, F.greatest(i_from + 1, F.least((end / d * n).cast("long"), n))


def slice_bounds(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Index range ``[i_from, i_to)`` of the curve that belongs to each span.

    Index and time are proportional; the range always holds at least one
    point.  Spans of videos without a curve are dropped.
    """
    n, d = F.col("n_points"), F.col("duration_s")
    joined = spans.join(totals, "video_id")
    i_from, i_to = _bounds(F.col("start_s"), F.col("end_s"), d, n)
    return joined.withColumn("i_from", i_from.cast("long")).withColumn("i_to", i_to.cast("long"))


def slice_curve(curve: DataFrame, spans: DataFrame, *, bucket: float = 8.0, levels: int = 2) -> DataFrame:
    """Curve points of every span: one row per (span, point) with ``slice_pos`` from 0.

    ``spans`` carries ``i_from``/``i_to`` from ``slice_bounds``.
    """
    ranges = spans.withColumn("_last", F.col("i_to") - 1)
    points = curve.select("video_id", "idx", "value")
    hits = points_in_spans(points, ranges, ["video_id"], "idx", "i_from", "_last", bucket=bucket, levels=levels)
    return hits.drop("_last").withColumn("slice_pos", F.col("idx") - F.col("i_from"))


def _readers(start: Column, end: Column, d: Column, n: Column, reach: Column) -> tuple[Column, Column, Column]:
    """How a window reads the point ``idx`` of a curve: in its slice; among the first, and the last, two of its fading test."""
    idx = F.col("idx")
    i_from, i_to = _bounds(start, end, d, n)
    raw = (start / d * n).cast("long")
    first = F.greatest(F.lit(0), F.least(raw, n - 2)).cast("long")
    last = F.greatest(first + 2, F.least(raw + reach, n)).cast("long")
    fades = (n >= 4) & (start >= d * 0.8)
    return ((idx >= i_from) & (idx < i_to), F.when(fades & idx.between(first, first + 1), 1).otherwise(0),
            F.when(fades & idx.between(last - 2, last - 1), 1).otherwise(0))


def _curve_windows(curve: DataFrame, videos: DataFrame, size: float = 1.0, step: float = 0.5) -> DataFrame:
    """Curve points with every sliding window whose slice holds them (``in_slice``) or whose fading test reads them.

    Columns: video_id, win, value, curve_mean, n_points, in_slice, and how
    often the point is among the first and the last two of the fading test
    (``as_first``, ``as_last``). A slice is the share of the points that the
    window is of the video, so the windows of a point follow from its number.
    """
    totals = curve_totals(curve).select("video_id", "n_points", "curve_mean")
    d, n, idx = F.col("duration_s"), F.col("n_points"), F.col("idx")
    full, slots = _counts(d, size, step)
    known = videos.filter(d > size).select("video_id", "duration_s").join(totals.hint("merge"), "video_id").withColumns(
        {"_full": full, "_slots": slots, "_reach": (n * 0.05).cast("long")})

    def around(low: Column, high: Column) -> Column:
        """Windows that start or end between two places of the curve, in points."""
        return _near_windows(low * d / n, high * d / n, F.col("_slots"), size, step)
    to_end = F.when(idx >= n - 2, n + 1)
    late = (n >= 4) & (idx >= n * 0.8 - 4)
    places = F.array_distinct(F.concat(
        around(idx - 1, F.coalesce(to_end, idx + 2)),
        F.when(late, around(idx - F.col("_reach") - 3, F.coalesce(to_end, idx - F.col("_reach") + 4)))
        .otherwise(F.array().cast("array<bigint>"))))
    rows = curve.select("video_id", "idx", "value").join(known.hint("merge"), "video_id")
    rows = rows.withColumn("_w", F.explode(_with_edges(places, F.col("_full"), d, size, step)))
    in_slice, as_first, as_last = _readers(F.col("_w.win_start"), F.col("_w.win_end"), d, n, F.col("_reach"))
    rows = rows.select(
        "video_id", "_w.win", "value", "curve_mean", "n_points", in_slice.alias("in_slice"), as_first.alias("as_first"),
        as_last.alias("as_last"))
    return rows.filter("in_slice OR as_first > 0 OR as_last > 0")


def _falling() -> Column:
    """Whether the last two points of the fading test lie well below its first two; null without the test."""
    first = F.sum(F.col("value") * F.col("as_first")) / 2
    last = F.sum(F.col("value") * F.col("as_last")) / 2
    return F.when(F.sum("as_first") > 0, F.when(first > 0, last < first * 0.7).otherwise(True))


def peak_ratio(curve: DataFrame, spans: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Highest slice value over the mean of the whole curve; 1.0 without a curve or with a mean of 0."""
    key = _span_key(spans)
    if videos is not None:
        hits = _curve_windows(curve, videos).filter("in_slice")
    else:
        hits = slice_curve(curve, slice_bounds(
            spans.select("video_id", key, "start_s", "end_s", "duration_s"), curve_totals(curve)))
    peaks = hits.groupBy("video_id", key).agg(F.max("value").alias("_peak"), F.max("curve_mean").alias("_mean"))
    ratio = F.when(F.col("_mean") > 0, F.col("_peak") / F.col("_mean"))
    return (_beside(spans, peaks, key)
            .withColumn("peak_ratio", F.coalesce(ratio, F.lit(1.0))).drop("_peak", "_mean"))


def keyword_flags(texts: DataFrame, spans: DataFrame, words: dict[str, list[str]] | None = None,
                  videos: DataFrame | None = None) -> DataFrame:
    """One flag per word list: does a text shown inside the span contain one of its words?"""
    key = _span_key(spans)
    words = words or WORD_LISTS
    flagged = texts.filter(F.col("t_s") >= 0).select(
        "video_id", "t_s", *[contains_any(F.col("text"), w).alias(n) for n, w in words.items()])
    anything = F.lit(False)
    for n in words:
        anything = anything | F.col(n)
    if videos is not None:
        hits = touched_windows(flagged.filter(anything), videos, "t_s", "t_s")
    else:
        hits = points_in_spans(
            flagged.filter(anything), spans.select("video_id", key, "start_s", "end_s"),
            ["video_id"], "t_s", "start_s", "end_s", bucket=1.0, levels=_levels(key))
    found = hits.groupBy("video_id", key).agg(*[F.bool_or(n).alias(n) for n in words])
    return _beside(spans, found, key).fillna(False, list(words))


def _videos_of(windows: DataFrame) -> DataFrame:
    return windows.select("video_id", "duration_s").distinct()


def fading_flag(curve: DataFrame, windows: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Is the curve falling at a window near the end?

    Only windows in the last fifth qualify.  The mean of the last two points
    of the following 5% slice must be below 0.7 times the mean of its first
    two; with fewer than four points the last tenth of the video counts.
    """
    d = F.col("duration_s")
    videos = _videos_of(windows) if videos is None else videos
    found = _curve_windows(curve, videos).groupBy("video_id", "win").agg(
        _falling().alias("_falling"), F.max("n_points").alias("_n"))
    flag = (F.when(F.col("start_s") < d * 0.8, False)
            .when(F.coalesce(F.col("_n"), F.lit(0)) < 4, F.col("start_s") > d * 0.9)
            .otherwise(F.coalesce("_falling", F.lit(False))))
    return _beside(windows, found, "win").withColumn("is_fading", flag).drop("_n", "_falling")


def _edge_hits(spans: DataFrame, windows: DataFrame, videos: DataFrame | None) -> DataFrame:
    """Windows whose start or end lies inside one of the spans."""
    quiet = spans.select("video_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    if videos is None:
        return edges_in_spans(windows.select("video_id", "win", "start_s", "end_s"), quiet, ["video_id"],
                              ["start_s", "end_s"], "_s", "_e", bucket=4.0, levels=2)
    hits = touched_windows(quiet, videos, "_s", "_e")
    return hits.filter("win_start BETWEEN _s AND _e OR win_end BETWEEN _s AND _e")


def _overlaps(spans: DataFrame, windows: DataFrame, key: str, videos: DataFrame | None) -> DataFrame:
    """Pairs of a window and a span that overlap, with the ``seconds`` they share."""
    said = spans.select("video_id", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    if videos is None:
        pairs = overlapping(windows.select("video_id", key, F.col("start_s").alias("win_start"), F.col("end_s").alias("win_end")),
                            said, ["video_id"], ("win_start", "win_end"), ("_s", "_e"), bucket=1.0)
    else:
        pairs = touched_windows(said, videos, "_s", "_e").filter(
            F.greatest("win_start", "_s") < F.least("win_end", "_e"))
    return pairs.withColumn("seconds", F.least("win_end", "_e") - F.greatest("win_start", "_s"))


def edge_in_span(spans: DataFrame, windows: DataFrame, name: str = "silence_edge",
                 videos: DataFrame | None = None) -> DataFrame:
    """Does the start or the end of a window lie inside one of the spans?"""
    found = _edge_hits(spans, windows, videos).groupBy("video_id", "win").agg(F.lit(True).alias(name))
    return _beside(windows, found, "win").fillna(False, [name])


def overlap_seconds(spans: DataFrame, windows: DataFrame, name: str = "speech_s",
                    videos: DataFrame | None = None) -> DataFrame:
    """Seconds of the spans inside each window (positive overlaps added up)."""
    key = _span_key(windows)
    totals = _overlaps(spans, windows, key, videos).groupBy("video_id", key).agg(F.sum("seconds").alias(name))
    return _beside(windows, totals, key).fillna(0.0, [name])


def _frame_aggregates() -> dict[str, tuple[Column, object]]:
    """Aggregate and the value of windows without frames."""
    return {
        "has_face": (F.sum("face_count") > 0, False),
        "avg_face_ratio": (F.avg("face_area_ratio"), 0.0),
        "avg_flow": (F.avg("optical_flow"), 0.0),
        "avg_saturation": (F.avg("saturation_mean"), 0.0),
        "avg_edge_density": (F.avg("edge_density"), 0.0),
        "avg_entropy": (F.avg("gray_entropy"), 0.0),
        "min_brightness": (F.min("brightness_mean"), 255.0),
        "max_hist_dist": (F.max("histogram_distance"), 0.0),
        "persons": (F.sum("person_count").cast("long"), 0),
        "vehicles": (F.sum("vehicle_count").cast("long"), 0),
        "animals": (F.sum("animal_count").cast("long"), 0),
        "objects": (F.sum("object_count").cast("long"), 0),
    }


FRAME_COLUMNS = [
    "face_count", "face_area_ratio", "optical_flow", "saturation_mean", "edge_density", "gray_entropy",
    "brightness_mean", "histogram_distance", "person_count", "vehicle_count", "animal_count", "object_count"]


def window_features(frames: DataFrame, windows: DataFrame, *, compat: bool = False,
                    videos: DataFrame | None = None) -> DataFrame:
    """Frame features combined per window.

    Frames belong to a window by their time ``t_s``.  ``compat=True`` uses the
    literal index rule instead, which divides by the end of the window and so
    always takes a tail of the frames.
    """
    spans = windows.select("video_id", "win", "start_s", "end_s")
    wanted = frames.select("video_id", "idx", "t_s", *FRAME_COLUMNS)
    if compat:
        sizes = frames.groupBy("video_id").agg(
            F.count(F.lit(1)).alias("_n"), (F.max("frame_index") + 1).alias("_total"))
        total = F.when(F.col("_total") <= 1, F.col("_n")).otherwise(F.col("_total"))
        share = F.greatest(F.col("end_s"), F.lit(0.01))
        spans = spans.join(sizes, "video_id").withColumn("_total", total)
        lo = F.greatest(F.lit(0), F.least((F.col("start_s") / share * F.col("_total")).cast("long"), F.col("_n") - 1))
        hi = F.greatest(lo + 1, F.least(
            (F.col("end_s") / share * F.col("_total")).cast("long") + 1, F.col("_n")))
        spans = spans.withColumn("_lo", lo).withColumn("_hi", hi - 1)
        pairs = points_in_spans(wanted, spans, ["video_id"], "idx", "_lo", "_hi", bucket=64.0, levels=3)
    elif videos is not None:
        pairs = touched_windows(wanted, videos, "t_s", "t_s")
    else:
        pairs = points_in_spans(wanted, spans, ["video_id"], "t_s", "start_s", "end_s", bucket=1.0)
    made = _frame_aggregates()
    found = pairs.groupBy("video_id", "win").agg(*[a.alias(n) for n, (a, _) in made.items()])
    return _beside(windows, found, "win").fillna({n: v for n, (_, v) in made.items()})


# -- segments -------------------------------------------------------------

def _touched(kind: str, rows: DataFrame, start: str, end: str, *columns: str) -> DataFrame:
    """Rows of one signal that touch the windows from ``start`` to ``end``."""
    return rows.filter(F.col(start) <= F.col(end)).select(
        "video_id", F.lit(kind).alias("_kind"), F.col(start).alias("_a"), F.col(end).alias("_b"), *columns)


def _ranges(size: float, step: float) -> Column:
    """Ranges of window numbers, none twice, that a row of a signal may touch; those of a curve point as in ``_curve_windows``."""
    d, n, idx, slots = F.col("_d"), F.col("n_points"), F.col("idx"), F.col("_slots")
    reach = (n * 0.05).cast("long")

    def around(low: Column, high: Column) -> tuple[Column, Column]:
        return _near(low * d / n, high * d / n, slots, size, step)
    to_end = F.when(idx >= n - 2, n + 1)
    late = (n >= 4) & (idx >= n * 0.8 - 4)
    first, last = around(idx - 1, F.coalesce(to_end, idx + 2))
    low, high = around(idx - reach - 3, F.coalesce(to_end, idx - reach + 4))

    def pair(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    beside = [F.when(late, pair(low, F.least(high, first - 1))), F.when(late, pair(F.greatest(low, last + 1), high))]
    return F.when(F.col("_kind") == "curve", F.array(pair(first, last), *beside)).otherwise(
        F.array(pair(*_near(F.col("_a"), F.col("_b"), slots, size, step))))


def window_signals(
    windows: DataFrame | None = None,
    videos: DataFrame | None = None,
    *,
    curve: DataFrame | None = None,
    cuts: DataFrame | None = None,
    texts: DataFrame | None = None,
    silence: DataFrame | None = None,
    speech: DataFrame | None = None,
    frames: DataFrame | None = None,
) -> DataFrame:
    """All signals of the sliding windows of ``videos`` (by default those of the windows), one row each.

    Without ``windows`` these are all the sliding windows of ``videos``. Every
    signal finds its windows by arithmetic, so only its rows, with the ranges
    of windows they may touch, are shuffled, to blocks of windows; the windows
    of a block, and what each row gives to each, are made and combined there.
    Missing inputs give neutral values.
    """
    size, step = 1.0, 0.5
    videos = _videos_of(windows) if videos is None else videos
    d, n = F.col("_d"), F.col("n_points")
    full, slots = _counts(F.col("duration_s"), size, step)
    known = videos.filter(F.col("duration_s") > size).withColumns(
        {"_d": F.col("duration_s"), "_full": full, "_slots": slots})
    kind = F.lit("window").alias("_kind")
    last = F.col("_slots") - 1
    if windows is None:
        kept = list(videos.columns)
        base = known.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _BLOCK).cast("long"))))
        base = base.select(*kept, "_d", "_full", "_block", kind, (F.col("_block") * _BLOCK).alias("_lo"), last.alias("_hi"))
    else:
        kept = [c for c in windows.columns if c != "win"]
        base = windows.select(*kept, F.floor(F.col("win") / _BLOCK).cast("long").alias("_block"), kind,
                              F.col("win").cast("long").alias("_lo"), F.col("win").cast("long").alias("_hi"))

    parts: list[DataFrame] = []
    gathered: dict[str, tuple[Column, object]] = {
        c: (F.first(c, ignorenulls=True), None) for c in kept if c != "video_id"}
    gathered["_base"] = (F.bool_or("_base"), None)

    if cuts is not None:
        parts.append(_touched("cut", cuts, "t_s", "t_s"))
        gathered["cuts"] = (F.sum("cuts"), 0)
    if curve is not None:
        totals = curve_totals(curve).select("video_id", "n_points", "curve_mean")
        points = curve.select("video_id", "idx", "value").join(totals.hint("merge"), "video_id")
        parts.append(points.withColumn("_kind", F.lit("curve")))
        gathered["peak_ratio"] = (F.max("peak_ratio"), 1.0)
    if texts is not None:
        flagged = texts.filter(F.col("t_s") >= 0).select(
            "video_id", "t_s", *[contains_any(F.col("text"), w).alias(n) for n, w in WORD_LISTS.items()])
        parts.append(_touched("text", flagged.filter(" or ".join(WORD_LISTS)), "t_s", "t_s", *WORD_LISTS))
    for word in WORD_LISTS:
        gathered[word] = (F.bool_or(word), False) if texts is not None else (F.lit(False), False)
    if silence is not None:
        parts.append(_touched("silence", silence, "start_s", "end_s"))
        gathered["silence_edge"] = (F.bool_or("silence_edge"), False)
    if speech is not None:
        parts.append(_touched("speech", speech, "start_s", "end_s"))
        gathered["speech_s"] = (F.sum("speech_s"), 0.0)
    if frames is not None:
        parts.append(_touched("frame", frames, "t_s", "t_s", *FRAME_COLUMNS))
    gathered.setdefault("cuts", (F.lit(0), 0))
    gathered.setdefault("peak_ratio", (F.lit(1.0), 1.0))
    gathered.setdefault("silence_edge", (F.lit(False), False))
    gathered.setdefault("speech_s", (F.lit(0.0), 0.0))
    for name, (aggregate, missing) in _frame_aggregates().items():
        gathered[name] = (aggregate, missing) if frames is not None else (F.lit(missing), missing)
    gathered["avg_flow_or_high"] = (F.avg("optical_flow"), 99.0) if frames is not None else (F.lit(99.0), 99.0)

    rows = base
    if parts:
        stacked = parts[0]
        for part in parts[1:]:
            stacked = stacked.unionByName(part, allowMissingColumns=True)
        for name, of in (("_a", "double"), ("_b", "double"), ("idx", "long"), ("n_points", "long")):
            if name not in stacked.columns:
                stacked = stacked.withColumn(name, F.lit(None).cast(of))
        own = stacked.columns
        found = stacked.join(known.select("video_id", "_d", "_full", "_slots").hint("merge"), "video_id")
        found = found.withColumn("_r", F.explode(_ranges(size, step))).filter("_r.lo <= _r.hi")
        found = found.withColumn("_block", F.explode(F.sequence(
            F.floor(F.col("_r.lo") / _BLOCK).cast("long"), F.floor(F.col("_r.hi") / _BLOCK).cast("long"))))
        rows = base.unionByName(found.select(*own, "_d", "_full", "_block", F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi")),
                                allowMissingColumns=True)
    spread = _SPREAD * int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(spread, "video_id", "_block")
    rows = rows.withColumn("win", F.explode(F.sequence(
        F.greatest("_lo", F.col("_block") * _BLOCK), F.least(F.col("_hi"), F.col("_block") * _BLOCK + (_BLOCK - 1)))))
    made: dict[str, Column] = {"_base": F.when(F.col("_kind") == "window", True)}
    if parts:
        start, end = _edges(F.col("win"), F.col("_full"), d, size, step)
        rows = rows.withColumns({"_start": start, "_end": end})
        start, end, a, b = F.col("_start"), F.col("_end"), F.col("_a"), F.col("_b")
        rows = rows.withColumn("_touch", (start <= b) & (end >= a))
        touch = F.col("_touch")
        # A row that misses a window says nothing of it. It is not filtered out, as that would work out the times again.
        made["cuts"] = F.when((F.col("_kind") == "cut") & touch, F.lit(1).cast("long"))
        made["silence_edge"] = F.when((F.col("_kind") == "silence") & touch & (start.between(a, b) | end.between(a, b)), True)
        made["speech_s"] = F.when((F.col("_kind") == "speech") & touch & (F.greatest(start, a) < F.least(end, b)),
                                  F.least(end, b) - F.greatest(start, a))
        for name in [*(WORD_LISTS if texts is not None else []), *(FRAME_COLUMNS if frames is not None else [])]:
            made[name] = F.when(touch, F.col(name))
        if curve is not None:
            in_slice, as_first, as_last = _readers(start, end, d, n, (n * 0.05).cast("long"))
            rows = rows.withColumns({"in_slice": in_slice, "as_first": as_first, "as_last": as_last})
            made["peak_ratio"] = F.when(F.col("in_slice"), F.when(
                F.col("curve_mean") > 0, F.col("value") / F.col("curve_mean")).otherwise(1.0))
            made["n_points"] = F.when(F.col("in_slice") | (F.col("as_first") > 0) | (F.col("as_last") > 0), n)
    rows = rows.withColumns(made)
    # Blocks lie whole in their partitions, so this needs no further shuffle. Everything is worked out inside the
    # aggregation: a filter on what a projection above it makes would repeat that for each mention.
    found = {c: g if missing is None else _filled(g, missing) for c, (g, missing) in gathered.items()}
    if windows is None:
        found["start_s"], found["end_s"] = _edges(
            F.col("win"), _counts(found["duration_s"], size, step)[0], found["duration_s"], size, step)
    late = found["start_s"] >= found["duration_s"] * 0.8
    close = found["start_s"] > found["duration_s"] * 0.9
    if curve is not None:
        close = F.when(F.coalesce(F.max("n_points") >= 4, F.lit(False)), F.coalesce(_falling(), F.lit(False))).otherwise(close)
    found["is_fading"] = late & close
    combined = rows.groupBy("video_id", "_block", "win").agg(*[x.alias(c) for c, x in found.items()])
    return combined.filter("_base").drop("_base", "_block")


def _filled(value: Column, missing: object) -> Column:
    """``value``, or ``missing`` where it is null or no number."""
    if isinstance(missing, float):
        value = F.nanvl(value, F.lit(None).cast("double"))
    return F.coalesce(value, F.lit(missing))


def score_windows(signals: DataFrame, presets: DataFrame | None = None, *, compat: bool = False,
                  least: float | None = None) -> DataFrame:
    """Candidates of the five types per window, as an array of structs.

    With ``least``, windows whose best candidate stays below it, or that have
    none, are left out before any evidence is gathered.
    """
    tuned = with_preset(signals, presets, compat=compat)
    if least is not None:
        tuned = tuned.filter(rules.best_confidence() >= least)
    return tuned.withColumn("candidates", rules.window_candidates())


def best_type(scored: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """The best candidate of each window where it reaches the threshold, with its sub-type.

    ``threshold=None`` is for windows that ``score_windows`` has picked already.
    """
    picked = scored.withColumn("_best", rules.best_candidate(F.col("candidates")))
    if threshold is not None:
        picked = picked.filter(F.col("_best.conf") >= threshold)
    return picked.select(
        "video_id", "win", "start_s", "end_s", F.col("_best.type").alias("structure_type"),
        F.round("_best.conf", 2).alias("confidence"), F.col("_best.evidence").alias("evidence"),
        rules.sub_type(F.col("_best.type"), F.col("_best.evidence")).alias("sub_type"))


def merge_adjacent(segments: DataFrame, order: str = "win") -> DataFrame:
    """Join neighbouring segments of one type that lie close together.

    The gap must stay below 0.8 s for highlights and 1.5 s otherwise;
    unclassified segments are never joined.  Confidence is the highest,
    evidence the ordered union, the sub-type that of the first segment.
    """
    def together(prev: Column, cur: Column) -> Column:
        gap = F.when(prev["type"] == "highlight", 0.8).otherwise(1.5)
        return ((prev["type"] == cur["type"]) & (prev["type"] != UNCLASSIFIED)
                & (F.abs(prev["end"] - cur["start"]) < gap))

    runs = islands(
        segments, ["video_id"], [order], dense=True,
        values={"type": F.col("structure_type"), "start": F.col("start_s"), "end": F.col("end_s")},
        together=together)
    # First one row per distinct evidence of a run, then one row per run.
    shown = runs.select(
        "video_id", "island", "start_s", "end_s", "structure_type", "sub_type", "confidence",
        F.col(order).alias("_o"), F.posexplode_outer("evidence").alias("_i", "_e"))
    distinct = shown.groupBy("video_id", "island", "structure_type", "_e").agg(
        F.min(F.struct("_o", "_i")).alias("_at"), F.min(F.struct("_o", "start_s", "sub_type")).alias("_from"),
        F.max(F.struct("_o", "end_s")).alias("_to"), F.max("confidence").alias("confidence"))
    merged = distinct.groupBy("video_id", "island", "structure_type").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("confidence").alias("confidence"),
        F.sort_array(F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_at", "_e")))).alias("_all"))
    return merged.select(
        "video_id", (F.col("island") - 1).alias("seg_idx"), F.col("_from.start_s").alias("start_s"),
        F.col("_to.end_s").alias("end_s"), "structure_type", F.col("_from.sub_type").alias("sub_type"),
        "confidence", F.transform("_all", lambda s: s["_e"]).alias("evidence"))


def normalise_boundaries(raw: DataFrame, json_col: str = "boundary") -> DataFrame:
    """Cut times from JSON values that are numbers or objects with ``timestamp`` or ``start``."""
    text = F.col(json_col)
    fields = F.from_json(text, "timestamp double, start double")
    t = F.coalesce(F.expr(f"try_cast({json_col} as double)"), fields["timestamp"], fields["start"],
                   F.when(F.trim(text).startswith("{"), F.lit(0.0)))
    return raw.select("video_id", t.alias("t_s")).filter(F.col("t_s").isNotNull())

