"""Per-segment detail: tone, speech, texts, frames, motion and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipline.constants import (
    ANIMALS, FALLBACK_WORDS, GRID_ZONES, NEGATIVE_WORDS, PALETTES, POSITIVE_WORDS, VEHICLES)
from clipline.functions.expressions import fixed, when_chain
from clipline.operators.features import composition_grid
from clipline.operators.ordered import nearest_rank, ordered
from clipline.operators.ranges import points_in_spans
from clipline.operators.windows import curve_totals, slice_bounds, slice_curve

SEG = ["video_id", "seg_idx"]
NOTHING = "无"


def first_rows(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """First ``k`` rows per key.

    Spark limits every task to ``k`` rows per key before the shuffle, so a
    very large group never meets in one task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k)


def _first_list(df: DataFrame, order: list[str], value: str, k: int, name: str) -> DataFrame:
    rows = first_rows(df, SEG, order, k)
    return rows.groupBy(*SEG).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", value))),
                                              lambda s: s[value]).alias(name))


# -- energy and music -----------------------------------------------------

def energy_detail(curve: DataFrame, segments: DataFrame) -> DataFrame:
    """Tone and emotion peak of every segment from its slice of the energy curve.

    ``segments`` carries ``duration_s`` of its video.
    """
    points = slice_curve(curve, slice_bounds(segments.select(*SEG, "start_s", "end_s", "duration_s"),
                                             curve_totals(curve)), bucket=64.0)
    stats = points.groupBy(*SEG).agg(
        F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"),
        F.max(F.struct("value", (-F.col("slice_pos")).alias("at"))).alias("_peak"),
        F.max(F.col("i_to") - F.col("i_from")).alias("_len"), F.max("curve_max").alias("_max"))
    rows = segments.select(*SEG, (F.col("end_s") - F.col("start_s")).alias("_dur")).join(stats, SEG, "left")
    tone = when_chain([(F.col("_mean").isNull(), NOTHING), (F.col("_var") > 0.01, "高对比度"),
                       (F.col("_mean") > 0.05, "暖色调")], "冷色调")
    value = F.coalesce(F.when(F.col("_max") > 0, F.col("_peak.value") / F.col("_max")), F.lit(0.0))
    offset = F.coalesce(-F.col("_peak.at") / F.col("_len") * F.col("_dur"), F.lit(0.0))
    rows = rows.withColumn("color_tone", tone).withColumn("_value", value).withColumn("_offset", offset)
    tier = F.when(F.col("_value") > 0.8, "高").when(F.col("_value") > 0.5, "中").otherwise("低")
    text = F.concat(tier, F.lit(" ("), fixed(F.col("_value"), 2), F.lit(", +"), fixed(F.col("_offset"), 1), F.lit("s)"))
    return rows.select(
        *SEG, "color_tone", F.when(F.col("_value") <= 0, NOTHING).otherwise(text).alias("emotion_peak"),
        F.round("_value", 3).alias("energy_peak_value"), F.round("_offset", 2).alias("energy_peak_offset"))


def palette(tone: Column) -> Column:
    colours = {k: F.array(*[F.lit(c) for c in v]) for k, v in PALETTES.items()}
    return when_chain([(tone.contains("暖") | tone.contains("高饱和"), colours["warm"]), (tone.contains("冷"), colours["cool"]),
                       (tone.contains("高对比度"), colours["contrast"])], colours["neutral"])


def scene_tags(structure_type: Column, sub_type: Column) -> Column:
    """The sub-type as the only tag; unknown sub-types give the unknown tag, whatever the segment type."""
    known = (sub_type != "") & (sub_type != "未分类")
    return F.array(F.when(known, sub_type).otherwise(F.lit("未知")))


def bgm_tier(bpm: Column) -> Column:
    return when_chain([(bpm > 120, "激昂 / 紧张"), (bpm > 80, "明快 / 活泼"), (bpm > 50, "舒缓 / 沉静"),
                       (bpm > 0, "低沉 / 空灵")], NOTHING)


def bgm_narrative(curve: DataFrame, beats: DataFrame, audio: DataFrame) -> DataFrame:
    """Music line of videos without speech: type, tempo, energy peaks and beat density.

    ``audio`` has ``has_speech, bgm_type, bpm, duration_s``.  Peaks are values
    at or above the nearest-rank 90th percentile.
    """
    quiet = audio.filter(~F.col("has_speech"))
    points = curve.join(quiet.select("video_id"), "video_id", "left_semi")
    limits = nearest_rank(points, ["video_id"], "value", {"_limit": 90.0})
    peaks = points.join(limits, "video_id").groupBy("video_id").agg(
        F.count_if(F.col("value") >= F.col("_limit")).alias("_peaks"))
    hits = beats.groupBy("video_id").agg(F.count(F.lit(1)).alias("_beats"))
    rows = quiet.join(peaks, "video_id", "left").join(hits, "video_id", "left").fillna(0, ["_peaks", "_beats"])
    rate = F.try_divide(F.col("_beats"), F.when(F.col("duration_s") > 0, F.col("duration_s")))
    density = when_chain([(rate > 2.0, "密集"), (rate >= 1.0, "适中")], "稀疏")
    line = F.concat_ws(
        " · ", F.when((F.col("bgm_type") != "") & (F.col("bgm_type") != NOTHING), F.concat(F.lit("BGM: "), "bgm_type")),
        F.when(F.col("bpm") > 0, F.concat(F.lit("BPM "), F.rint("bpm").cast("long").cast("string"))),
        F.when(F.col("_peaks") > 0, F.concat(F.lit("能量峰 "), F.col("_peaks").cast("string"), F.lit("处"))),
        F.concat(F.lit("节拍"), density))
    return rows.select("video_id", line.alias("bgm_narrative"))


# -- words ----------------------------------------------------------------

def clean_texts(texts: DataFrame, order: list[str]) -> DataFrame:
    """Texts of a segment without noise: no single characters, symbols, short codes or repeats.

    Repeats are found without regard to case; the first one stays.
    """
    t = F.trim("text")
    rows = texts.withColumn("text", t)
    size = F.length("text")
    rows = rows.filter(
        (size >= 2) & ~F.col("text").rlike(r"(?U)^[^\w\x{4e00}-\x{9fff}]+$")
        & ~((size <= 3) & F.col("text").rlike(r"^[a-zA-Z]+$")) & ~((size <= 3) & F.col("text").rlike(r"^\p{Nd}+$")))
    firsts = rows.groupBy(*SEG, F.lower("text").alias("_k")).agg(F.min(F.struct(*order, "text")).alias("_f"))
    return firsts.select(*SEG, *[F.col(f"_f.{c}").alias(c) for c in order], F.col("_f.text").alias("text"))


def voice(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """First three lines said in a segment, joined by blanks."""
    firsts = _first_list(lines, ["seq"], "text", 3, "_v")
    return segments.select(*SEG).join(firsts, SEG, "left").select(
        *SEG, F.coalesce(F.array_join("_v", " "), F.lit(NOTHING)).alias("voice_content"))


def high_freq(segments: DataFrame, lines: DataFrame, cleaned: DataFrame, order: list[str]) -> DataFrame:
    """Up to five words of a segment: spoken tokens, else spoken lines, else shown texts, else a hash tag.

    A token is a run of two or more Chinese characters or four or more letters.
    """
    tokens = lines.select(*SEG, "seq", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"([\x{4e00}-\x{9fff}]{2,}|[a-zA-Z]{4,})"))).alias("_i", "_t"))
    spoken = _first_list(tokens, ["seq", "_i"], "_t", 5, "_tokens")
    whole = _first_list(lines, ["seq"], "text", 3, "_lines")
    shown = _first_list(cleaned, order, "text", 5, "_texts")
    tags = F.create_map(*[F.lit(x) for pair in FALLBACK_WORDS.items() for x in pair])
    rows = segments.select(*SEG, "structure_type")
    for table in (spoken, whole, shown):
        rows = rows.join(table, SEG, "left")
    other = F.array(F.coalesce(F.try_element_at(tags, F.col("structure_type")), F.lit("#未分类")))
    return rows.select(*SEG, F.coalesce("_tokens", "_lines", "_texts", other).alias("high_freq_words"))


def sentiment(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """More positive or more negative words among all the texts of a segment (each word counts once)."""
    words = [(w, 1) for w in POSITIVE_WORDS] + [(w, -1) for w in NEGATIVE_WORDS]
    found = texts.groupBy(*SEG).agg(*[
        F.bool_or(F.col("text").contains(w)).alias(f"_w{i}") for i, (w, _) in enumerate(words)])
    total = F.lit(0)
    for i, (_, sign) in enumerate(words):
        total = total + F.when(F.coalesce(F.col(f"_w{i}"), F.lit(False)), sign).otherwise(0)
    return segments.select(*SEG).join(found, SEG, "left").select(
        *SEG, when_chain([(total > 0, "正面/激昂"), (total < 0, "负面/低落")], "中性").alias("sentiment"))


def segment_texts(segments: DataFrame, texts: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    """First ten texts of a segment, plain and with rank and confidence flag."""
    def field(name: str, missing: object) -> Column:
        return F.coalesce(F.col(name), F.lit(missing)) if name in texts.columns else F.lit(missing)

    rows = first_rows(texts, SEG, order, limit).withColumn("_s", F.struct(
        "text", field("text_size_rank", "small").alias("text_size_rank"),
        field("low_confidence", False).alias("low_confidence")))
    lists = rows.groupBy(*SEG).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_s"))),
                                               lambda s: s["_s"]).alias("ocr_texts_structured"))
    return segments.select(*SEG).join(lists, SEG, "left").withColumn(
        "ocr_texts", F.transform("ocr_texts_structured", lambda s: s["text"]))


def content_tags(tags: Column, motion: Column, bgm: Column, tone: Column, sub_type: Column) -> Column:
    """Distinct tags in order: scene, motion, music, tone, sub-type; empty and unknown ones left out."""
    def unless(value: Column, *skip: str) -> Column:
        return F.when((value != "") & ~value.isin(*skip), value) if skip else F.when(value != "", value)

    extra = F.array(unless(motion, NOTHING), unless(bgm, NOTHING, "未知"), unless(tone, "未知"),
                    unless(sub_type, "未分类", NOTHING))
    return F.array_distinct(F.array_compact(F.concat(F.filter(tags, lambda t: t != ""), extra)))


# -- frames of a segment --------------------------------------------------

def frame_slices(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames of every segment by proportional index, with ``slice_pos`` from 0 and ``n_slice``.

    ``frames`` has the dense index ``idx``; ``segments`` carries ``duration_s``.
    """
    totals = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    n, d = F.col("_n"), F.col("duration_s")
    spans = segments.select(*SEG, "start_s", "end_s", "duration_s").filter(d > 0).join(totals, "video_id")
    i0 = F.greatest(F.lit(0), F.least((F.col("start_s") / d * n).cast("long"), n - 1))
    i1 = F.greatest(i0 + 1, F.least(n, (F.col("end_s") / d * n).cast("long") + 1))
    spans = spans.select(*SEG, i0.cast("long").alias("_i0"), (i1 - 1).cast("long").alias("_last"))
    pairs = points_in_spans(frames, spans, ["video_id"], "idx", "_i0", "_last", bucket=32.0, levels=2)
    return (pairs.withColumn("slice_pos", F.col("idx") - F.col("_i0"))
            .withColumn("n_slice", F.col("_last") - F.col("_i0") + 1).drop("_i0", "_last"))


def zone_means(slices: DataFrame) -> DataFrame:
    """Mean colour zone percent per segment, neutral flag and the worst detection quality."""
    zones = ("white", "warm", "cool", "neutral", "dark")
    severity = F.when(F.col("quality_flag") == "rejected", 2).when(F.col("quality_flag") == "suspicious", 1).otherwise(0)
    stats = slices.groupBy(*SEG).agg(
        *[F.round(F.avg(F.coalesce(F.col(f"{z}_pct"), F.lit(0.0))), 1).alias(f"{z}_pct") for z in zones],
        F.max(severity).alias("_q"))
    return stats.select(
        *SEG, *[f"{z}_pct" for z in zones],
        (F.col("white_pct") + F.col("neutral_pct") + F.col("dark_pct") > 50.0).alias("is_dominantly_neutral"),
        F.when(F.col("_q") == 2, "rejected").when(F.col("_q") == 1, "suspicious").otherwise("reliable")
        .alias("quality_flag"))


def frame_boxes(detections: DataFrame) -> DataFrame:
    """Per frame: mean area of the three largest boxes, mean centre x, number of boxes and class counts.

    ``detections`` has ``video_id, idx, det_id, class_name`` and a box.
    """
    key = ["video_id", "idx"]
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rows = detections.withColumn("_a", -area)
    top = first_rows(rows, key, ["_a", "det_id"], 3).groupBy(*key).agg((-F.avg("_a")).alias("top_area"))
    rest = rows.groupBy(*key).agg(
        F.avg((F.col("x1") + F.col("x2")) / 2).alias("centre_x"), F.count(F.lit(1)).alias("n_boxes"))
    return rest.join(top, key)


def segment_curves(slices: DataFrame) -> DataFrame:
    """Flow and box-area statistics of a segment and the means of its first and last three frames.

    Needs ``brightness_mean, optical_flow, top_area`` (0 without boxes).
    """
    near = ordered(slices, SEG, ["slice_pos"], dense=True, lag={"_prev": F.col("top_area")})
    change = F.when(F.abs(F.col("top_area") - F.col("_prev")) > 1e-6, F.col("top_area") - F.col("_prev"))
    light = F.round(F.col("brightness_mean") / 255.0, 4)
    stats = near.groupBy(*SEG).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.round(F.coalesce(F.avg(change), F.lit(0.0)), 2).alias("composition_changes"),
        F.round(F.avg("optical_flow"), 2).alias("flow_mean"),
        F.round(F.stddev_pop("optical_flow"), 2).alias("flow_std"), F.round(F.max("optical_flow"), 2).alias("flow_max"),
        F.avg(F.when(F.col("slice_pos") < 3, light)).alias("first_light"),
        F.avg(F.when(F.col("slice_pos") >= F.col("n_slice") - 3, light)).alias("last_light"))
    return stats


def brightness_curve(slices: DataFrame) -> DataFrame:
    """Normalised brightness of every frame of a segment, as rows in order."""
    return slices.select(*SEG, "slice_pos", F.round(F.col("brightness_mean") / 255.0, 4).alias("brightness"))


def motion_trend(curves: DataFrame) -> DataFrame:
    """Brightness, scale and movement trends; movement compares with the previous segment."""
    near = ordered(curves, ["video_id"], ["seg_idx"], dense=True,
                   lag={"_flow": F.col("flow_mean"), "_some": F.lit(True)})
    first, last = F.col("first_light"), F.col("last_light")
    steady = (F.col("n_frames") >= 3) & (first > 0.01)
    light = F.when(steady, F.round(last / first, 3)).otherwise(1.0)
    moved = (F.col("flow_mean") > 0.01) & (F.col("_flow") > 0.01)
    move = F.when(F.coalesce(moved, F.lit(False)), F.round(F.col("flow_mean") / F.col("_flow"), 3)).otherwise(1.0)
    change = F.col("composition_changes")
    return near.select(
        *SEG, when_chain([(light > 1.1, "变亮"), (light < 0.9, "变暗")], "稳定").alias("brightness_trend"),
        light.alias("brightness_ratio"),
        when_chain([(change > 0.1, "扩散"), (change < -0.1, "聚拢")], "稳定").alias("scale_trend"),
        F.round(change, 3).alias("scale_value"),
        when_chain([(F.col("_some").isNull(), "起始段"), (move > 1.5, "动效增强"), (move < 0.6, "动效减弱")], "稳定")
        .alias("movement_trend"), move.alias("movement_ratio"))


def object_transitions(slices: DataFrame, detections: DataFrame) -> DataFrame:
    """Classes that appear and disappear between neighbouring frames of a segment.

    A frame after one without any class does not count.  Classes come from the
    detector's fixed list, so a set per frame stays small.
    """
    sets = detections.filter(F.col("class_name") != "").groupBy("video_id", "idx").agg(
        F.sort_array(F.collect_set("class_name")).alias("_c"))
    rows = slices.select(*SEG, "idx", "slice_pos").join(sets, ["video_id", "idx"], "left").withColumn(
        "_c", F.coalesce("_c", F.array().cast("array<string>")))
    near = ordered(rows, SEG, ["slice_pos"], dense=True, lag={"_p": F.col("_c")})
    counts = F.size("_p") > 0
    return near.groupBy(*SEG).agg(
        F.sum(F.when(counts, F.size(F.array_except("_c", "_p"))).otherwise(0)).cast("long").alias("fade_in_count"),
        F.sum(F.when(counts, F.size(F.array_except("_p", "_c"))).otherwise(0)).cast("long").alias("fade_out_count"))


def segment_motion(slices: DataFrame, tolerance: Column | float = 1.0) -> DataFrame:
    """Motion label of a segment from half-against-half trends of boxes and brightness.

    Needs ``optical_flow, histogram_distance, brightness_mean, top_area,
    centre_x`` (0 without boxes).  Thresholds grow as the tolerance falls.
    """
    # The brightness halves leave out the middle frame of an odd number.
    half = F.greatest(F.floor(F.col("n_slice") / 2), F.lit(1))
    low = F.floor(F.col("n_slice") / 2)
    left = F.col("slice_pos") < half
    stats = slices.groupBy(*SEG).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("optical_flow").alias("_fl"), F.avg("histogram_distance").alias("_hd"),
        F.avg(F.when(F.col("slice_pos") < low, F.col("brightness_mean"))).alias("_b0"),
        F.avg(F.when(F.col("slice_pos") >= F.col("n_slice") - low, F.col("brightness_mean"))).alias("_b1"),
        F.avg(F.when(left, F.col("top_area"))).alias("_a0"), F.avg(F.when(~left, F.col("top_area"))).alias("_a1"),
        F.avg(F.when(left, F.col("centre_x"))).alias("_x0"), F.avg(F.when(~left, F.col("centre_x"))).alias("_x1"))
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    k = F.lit(1.0) / F.greatest(tol, F.lit(0.1))
    fl, hd = F.col("_fl"), F.col("_hd")
    still, slight, push, fast = (k * v for v in (3.0, 8.0, 15.0, 25.0))
    hd_still, hd_fast, hd_violent = (k * v for v in (0.2, 0.3, 0.5))
    bright = F.when(F.col("_n") >= 3, (F.col("_b1") - F.col("_b0")) / F.greatest(
        F.greatest("_b0", "_b1"), F.lit(0.001))).otherwise(0.0)
    ratio = F.coalesce(F.when((F.col("_n") >= 2) & (F.col("_a0") > 0) & (F.col("_a1") > 0), F.col("_a1") / F.col("_a0")),
                       F.lit(0.0))
    drift = F.coalesce(F.when(F.col("_n") >= 2, F.col("_x1") - F.col("_x0")), F.lit(0.0))
    rows = stats.withColumn("_bright", bright).withColumn("_ratio", ratio).withColumn("_drift", drift)
    b, r, x = F.col("_bright"), F.col("_ratio"), F.col("_drift")
    out = F.greatest(F.lit(1.0) / F.when(r != 0, r), F.lit(1.0))

    def pair(code: str, text: str | Column) -> Column:
        return F.struct(F.lit(code).alias("code"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))

    label = when_chain([
        ((F.abs(b) > 0.25) & (fl < still) & (b > 0), pair("FADE_IN", "淡入过渡")),
        ((F.abs(b) > 0.25) & (fl < still), pair("FADE_OUT", "淡出过渡")),
        ((r > 1.25) & (fl < fast), pair("ZOOM_IN", F.concat(F.lit("镜头推近（放大 ×"), fixed(r, 2), F.lit("）")))),
        ((r > 0.001) & (r < 0.75) & (fl < fast),
         pair("ZOOM_OUT", F.concat(F.lit("镜头拉远（缩小 ×"), fixed(out, 2), F.lit("）")))),
        ((F.abs(x) > 20) & (fl < fast), pair("PAN", F.when(x > 0, "画面右移").otherwise("画面左移"))),
        ((fl > still) & (fl <= slight) & (F.abs(r - 1) < 0.15), pair("SLIDE", "滑动平移")),
        ((fl > slight) & (fl <= push), pair("PUSH", "缓推镜头 / 平移跟随")),
        ((fl < still) & (hd < hd_still), pair("STILL", "静止定镜")),
        ((fl >= still) & (fl <= slight), pair("SHAKE", "轻微晃动")),
        ((fl > push) & (fl <= fast) & (hd < hd_fast), pair("PAN", "快速摇镜")),
        ((fl > fast) & (hd > hd_violent), pair("CUT", "剧烈切换")),
        (fl >= push, pair("MOVE", "画面运动")),
        (hd >= hd_still * 2, pair("CUT", "画面跳变"))], pair("STILL", "静止定镜"))
    rows = rows.withColumn("_l", label)
    return rows.select(
        *SEG, F.col("_l.text").alias("motion"), F.col("_l.code").alias("label_code"),
        F.when(r != 0, F.round(r, 3)).alias("scale_factor"),
        F.when(F.abs(x) > 2, F.round(x, 1)).alias("displacement"))


def grid_rollup(slices: DataFrame, detections: DataFrame) -> DataFrame:
    """Composition grid of a segment: zone means, most frequent zone and symmetry, diagonal flag.

    Frames without boxes do not count; ties go to the value seen first.
    ``slices`` has ``width, height, face_count``.
    """
    frame = F.concat_ws("#", F.col("video_id").cast("string"), F.col("idx").cast("string"))
    boxes = detections.withColumn("frame", frame)
    facts = slices.select("video_id", "idx", "width", "height", "face_count").distinct().withColumn("frame", frame)
    facts = facts.join(boxes.select("frame").distinct(), "frame", "left_semi")
    grid = composition_grid(boxes, facts).join(facts.select("frame", "video_id", "idx"), "frame")
    rows = slices.select(*SEG, "idx", "slice_pos").join(grid, ["video_id", "idx"])
    means = rows.groupBy(*SEG).agg(
        *[F.round(F.avg(f"zone_{z}"), 3).alias(f"zone_{z}") for z in GRID_ZONES],
        (F.avg(F.col("diagonal_presence").cast("int")) > 0.5).alias("diagonal_presence"),
        F.round(F.avg("subject_coverage"), 4).alias("subject_coverage"))
    for name in ("grid_dominant_zone", "center_symmetry"):
        means = means.join(most_frequent(rows, name), SEG)
    return means


def most_frequent(rows: DataFrame, name: str) -> DataFrame:
    """Most frequent value of a column per segment; ties go to the smallest ``slice_pos``."""
    counts = rows.groupBy(*SEG, name).agg(F.count(F.lit(1)).alias("_n"), F.min("slice_pos").alias("_at"))
    return counts.groupBy(*SEG).agg(F.min(F.struct((-F.col("_n")).alias("a"), "_at", name))[name].alias(name))


def _place(x: Column, y: Column) -> Column:
    side = when_chain([(x < 0.33, "画面左侧"), (x > 0.66, "画面右侧")], "画面中央")
    level = F.when(y < 0.33, "上方").when(y > 0.66, "下方")
    return F.concat(F.lit("（"), F.concat_ws("、", side, level), F.lit("）"))


def _place_of(members: Column, name: str) -> Column:
    return F.get(F.filter(members, lambda s: s["c"] == name), 0)["p"]


def object_phrases(slices: DataFrame, detections: DataFrame, *, compat: bool = False) -> DataFrame:
    """Phrases about the objects of a segment: persons, up to three other classes, vehicles, animals.

    Positions are means of box centres over the frame size; ``compat=True``
    compares raw pixels, which puts nearly everything bottom right.
    """
    size = slices.select(*SEG, "idx", "slice_pos", *([] if compat else ["width", "height"]))
    w, h = (F.lit(1.0), F.lit(1.0)) if compat else (F.col("width"), F.col("height"))
    rows = size.join(detections, ["video_id", "idx"])
    stats = rows.groupBy(*SEG, "class_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("x1") + F.col("x2")) / 2 / w).alias("x"),
        F.avg((F.col("y1") + F.col("y2")) / 2 / h).alias("y"), F.min(F.struct("slice_pos", "det_id")).alias("seen"))
    name = F.col("class_name")
    kind = (F.when(name == "person", 0).when(name.isin(*VEHICLES), 2).when(name.isin(*ANIMALS), 3).otherwise(1))
    stats = stats.withColumn("kind", kind).withColumn("place", _place(F.col("x"), F.col("y")))
    # At most one row per detector class, so a segment collects a short list.
    lists = stats.groupBy(*SEG).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("n")).alias("m"), "seen", "class_name", "kind", "n", "place"))).alias("_all"))
    top = F.slice("_all", 1, 10)
    people = F.filter("_all", lambda s: s["kind"] == 0)
    others = F.slice(F.filter(top, lambda s: s["kind"] == 1), 1, 3)

    def group(k: int, many: str, first_by_list: list[str] | None) -> Column:
        # Group names follow the order in which the classes were seen.
        members = F.array_sort(F.transform(
            F.filter("_all", lambda s: s["kind"] == k),
            lambda s: F.struct(s["seen"].alias("seen"), s["class_name"].alias("c"), s["n"].alias("n"), s["place"].alias("p"))))
        total = F.aggregate(members, F.lit(0).cast("long"), lambda a, s: a + s["n"])
        place = F.get(members, 0)["p"]
        if first_by_list:
            place = F.coalesce(*[_place_of(members, c) for c in first_by_list])
        names = F.array_join(F.transform(members, lambda s: s["c"]), "、")
        return F.when(total >= 3, F.concat(F.lit(many + "×"), total.cast("string"), place)).when(
            total > 0, F.concat(F.lit("含"), names, place))

    p = F.get(people, 0)
    person = (F.when(p["n"] >= 3, F.concat(F.lit("人物×"), p["n"].cast("string"), p["place"]))
              .when(p["n"] == 2, F.concat(F.lit("双人"), p["place"])).when(p["n"] == 1, F.concat(F.lit("单人"), p["place"])))
    more = F.transform(others, lambda s: F.concat(
        s["class_name"], F.when(s["n"] >= 3, F.concat(F.lit("×"), s["n"].cast("string"))).otherwise(""), s["place"]))
    phrases = F.array_compact(F.concat(F.array(person), more, F.array(
        group(2, "车辆", VEHICLES), group(3, "动物", None))))
    return lists.select(*SEG, F.slice(phrases, 1, 4).alias("objects"),
                        F.aggregate("_all", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n_objects"))


def visual_summary(slices: DataFrame, detections: DataFrame, motion: DataFrame, grid: DataFrame, *,
                   portrait_weight: float = 0.7, compat: bool = False) -> DataFrame:
    """Visual lines of a segment: composition, light, colour, objects and motion.

    ``slices`` has the frame features with ``composition_type`` and
    ``composition_confidence``; ``motion`` comes from ``segment_motion`` and
    ``grid`` from ``grid_rollup``.
    """
    stats = slices.groupBy(*SEG).agg(
        F.sum("face_count").alias("fc"), F.avg("face_area_ratio").alias("far"), F.avg("saturation_mean").alias("sat"),
        F.avg("brightness_mean").alias("bm"), F.avg("composition_confidence").alias("conf"))
    named = slices.filter((F.col("composition_type") != "unknown") & (F.col("composition_type") != ""))
    rows = stats.join(most_frequent(named, "composition_type"), SEG, "left")
    rows = rows.join(object_phrases(slices, detections, compat=compat), SEG, "left").join(motion, SEG, "left")
    rows = rows.join(grid.select(*SEG, "grid_dominant_zone", "center_symmetry", "diagonal_presence"), SEG, "left")
    w = portrait_weight
    style = "人像居中/三分法" if w > 0.7 else "广角风光/引导线" if w <= 0.3 else "默认构图"
    fc, far, n = F.col("fc"), F.col("far"), F.coalesce("n_objects", F.lit(0))
    if w > 0.7:
        guess = when_chain([((fc >= 1) & (far > 0.08), "人物特写"), (fc >= 2, "双人/群像"), (fc == 1, "单人特写")], "")
    elif w < 0.4:
        guess = when_chain([(n > 5, "复杂场景"), (n < 3, "简洁全景")], "场景/风光")
    else:
        guess = when_chain([((fc >= 1) & (far > 0.08), "人物特写"), ((fc >= 2) & (far < 0.04), "群像/全景"),
                            (n > 5, "复杂"), (n < 3, "简洁")], "")
    zone, symmetry = F.col("grid_dominant_zone"), F.col("center_symmetry")
    geometry = F.nullif(F.concat_ws(
        " · ", F.when(zone != "center", F.concat(F.lit("画面"), F.regexp_replace(zone, "_", ""))),
        F.when(F.col("diagonal_presence"), "对角线分布"),
        F.when(~symmetry.isin("空", "居中"), F.concat(F.lit("主体"), symmetry))), F.lit(""))
    known = F.concat(F.lit("构图: "), "composition_type", F.lit(f"（{style}，置信度 "), fixed(F.col("conf"), 2))
    guessed = F.when(guess != "", F.concat(F.lit("构图: "), guess, F.lit(f"（{style}")))
    base = F.coalesce(known, guessed)
    composition = F.when(base.isNotNull(), F.concat(base, F.coalesce(F.concat(F.lit(" · "), geometry), F.lit("")), F.lit("）"))
                         ).otherwise(F.concat(F.lit("构图: "), geometry))
    light = when_chain([(F.col("bm") < 25, "光照: 暗调/夜场景"), (F.col("bm") > 180, "光照: 明亮日间场景")], "光照: 正常光照")
    colour = F.when(F.col("sat") > 100, "色彩: 暖色调（高饱和）").otherwise("色彩: 冷色调（低饱和）")
    objects = when_chain([(F.size("objects") > 0, F.concat(F.lit("物体: "), F.array_join("objects", "、"))),
                          (fc >= 1, "物体: 人物")], "物体: 无显著物体")
    return rows.select(*SEG, F.array_compact(F.array(
        composition, light, colour, objects, F.concat(F.lit("动效: "), F.col("motion")))).alias("visual_elements"))
