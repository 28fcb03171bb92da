"""Frame features, detections, composition and motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.constants import ANIMALS, COLOR_ZONES, GRID_ZONES, VEHICLES
from clipline.functions.expressions import first_best, when_chain
from clipline.operators.ordered import ordered, percentiles

FRAME = ["frame"]

# Names of the composition types, in the order that decides ties.
COMPOSITION_NAMES = {
    "rule_of_thirds": "三分法构图", "center": "中心构图", "symmetry": "对称构图", "leading_line": "引导线构图",
    "diagonal": "对角线构图", "frame": "框架构图"}


# -- histograms and colour ------------------------------------------------

def hist_entropy(hist: Column) -> Column:
    """Shannon entropy in bits of a histogram of counts."""
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    # With counts c and total n: log2(n) - sum(c * log2(c)) / n.
    logs = F.aggregate(hist, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - logs / total).otherwise(0.0)


def frame_moments(bins: DataFrame) -> DataFrame:
    """Mean and spread of brightness, mean saturation and mean hue per frame.

    ``bins`` has rows (frame, h, s, v, n): how many pixels show a value.
    """
    n = F.sum("n")
    mean_v = F.sum(F.col("v") * F.col("n")) / n
    square = F.sum(F.col("v") * F.col("v") * F.col("n")) / n
    return bins.groupBy("frame").agg(
        mean_v.alias("brightness_mean"),
        F.sqrt(F.greatest(F.lit(0.0), square - mean_v * mean_v)).alias("brightness_std"),
        (F.sum(F.col("s") * F.col("n")) / n).alias("saturation_mean"),
        (F.sum(F.col("h") * F.col("n")) / n).alias("hue_mean"))


def color_zone(h: Column, s: Column, v: Column) -> Column:
    """Zone of a colour with hue 0-179 and saturation and value 0-255; the first rule decides."""
    s1, v1 = s / F.lit(255.0), v / F.lit(255.0)
    return when_chain([
        ((s1 < 0.1) & (v1 > 0.8), "white"), (v1 < 0.2, "dark"), (((h <= 15) | (h >= 165)) & (s1 > 0.15), "warm"),
        ((h >= 90) & (h <= 135) & (s1 > 0.15), "cool")], "neutral")


def color_zones(bins: DataFrame) -> DataFrame:
    """Percent per colour zone, the dominant zone (ties in zone order) and whether it is neutral."""
    n = F.col("n")
    rows = bins.withColumn("_z", color_zone(F.col("h"), F.col("s"), F.col("v")))
    counts = rows.groupBy("frame").agg(
        F.sum(n).alias("_total"), (F.sum(F.col("h") * n) / F.sum(n)).alias("avg_hue"),
        *[F.sum(F.when(F.col("_z") == z, n).otherwise(0)).alias(f"_{z}") for z in COLOR_ZONES])
    best = first_best([(z, F.col(f"_{z}")) for z in COLOR_ZONES])["label"]
    return counts.select(
        "frame", *[F.round(F.col(f"_{z}") / F.col("_total") * 100.0, 2).alias(f"{z}_pct") for z in COLOR_ZONES],
        best.alias("dominant_zone"), best.isin("white", "dark", "neutral").alias("is_neutral"), "avg_hue")


# -- detections -----------------------------------------------------------

def _group(name: Column) -> Column:
    return (F.when(name == "person", "person").when(name.isin(*VEHICLES), "vehicle")
            .when(name.isin(*ANIMALS), "animal").otherwise("other"))


def detection_counts(detections: DataFrame) -> DataFrame:
    """Persons, vehicles, animals, total and dominant class per frame.

    Ties of the dominant class go to the class seen first (``det_id`` order).
    """
    per_class = detections.groupBy("frame", "class_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("det_id").alias("_first"))
    g = _group(F.col("class_name"))
    # The lowest of (-count, first seen) is the dominant class.
    return per_class.groupBy("frame").agg(
        *[F.sum(F.when(g == k, F.col("_n")).otherwise(0)).alias(f"{k}_count") for k in ("person", "vehicle", "animal")],
        F.sum("_n").alias("object_count"),
        F.min(F.struct((-F.col("_n")).alias("a"), F.col("_first").alias("b"), F.col("class_name").alias("c")))["c"]
        .alias("dominant_class"))


def filter_detections(detections: DataFrame, faces: DataFrame, frames: DataFrame) -> DataFrame:
    """Drop tiny doubtful boxes and flag likely false positives.

    ``faces`` has rectangles (frame, fx, fy, fw, fh); ``frames`` has
    ``width, height, edge_density, hsv_var``.  Five or more boxes of a class
    on a plain frame are doubtful, and so are persons without an overlapping
    face in frames that show faces; the latter lose half their confidence.
    Class counts include the boxes that are dropped.
    """
    counts = detections.groupBy("frame", "class_name").agg(F.count(F.lit(1)).alias("_same"))
    rows = detections.join(counts, ["frame", "class_name"]).join(frames, FRAME)
    box_w, box_h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = box_w * box_h / (F.col("width") * F.col("height"))
    rows = rows.filter(~((share < 0.015) & (F.col("confidence") < 0.6)))
    plain = (F.col("edge_density") < 0.03) & (F.col("hsv_var") < 0.02)

    persons = rows.filter(F.col("class_name") == "person").select("frame", "det_id", "x1", "y1", "x2", "y2")
    pairs = persons.join(faces, FRAME)
    inter = (F.greatest(F.lit(0.0), F.least(F.col("fx") + F.col("fw"), F.col("x2")) - F.greatest("fx", "x1"))
             * F.greatest(F.lit(0.0), F.least(F.col("fy") + F.col("fh"), F.col("y2")) - F.greatest("fy", "y1")))
    smaller = F.least(F.col("fw") * F.col("fh"), F.greatest(box_w * box_h, F.lit(1.0)))
    seen = pairs.groupBy("frame", "det_id").agg(
        F.bool_or(F.coalesce(F.try_divide(inter, smaller), F.lit(0.0)) > 0.15).alias("_face"))
    rows = rows.join(seen, ["frame", "det_id"], "left")
    lonely = (F.col("class_name") == "person") & F.col("_face").isNotNull() & ~F.col("_face")
    return rows.select(
        "frame", "det_id", "class_name",
        F.when(lonely, F.round(F.col("confidence") * 0.5, 3)).otherwise(F.col("confidence")).alias("confidence"),
        "x1", "y1", "x2", "y2",
        ((plain & (F.col("_same") >= 5)) | F.coalesce(lonely, F.lit(False))).alias("likely_false_positive"))


def detection_quality(filtered: DataFrame, frames: DataFrame) -> DataFrame:
    """``rejected`` without any box left, ``suspicious`` with a doubtful one, else ``reliable``."""
    flags = filtered.groupBy("frame").agg(F.bool_or("likely_false_positive").alias("_any"))
    return frames.select("frame").join(flags, FRAME, "left").select(
        "frame", F.when(F.col("_any").isNull(), "rejected").when(F.col("_any"), "suspicious").otherwise("reliable")
        .alias("quality_flag"))


# -- composition ----------------------------------------------------------

def _two_largest(detections: DataFrame) -> DataFrame:
    """The two largest boxes per frame (ties in ``det_id`` order) and the number of boxes."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    boxes = detections.withColumn("_b", F.struct((-area).alias("a"), "det_id", "x1", "y1", "x2", "y2"))
    first = boxes.groupBy("frame").agg(F.min("_b").alias("b1"), F.count(F.lit(1)).alias("n_boxes"))
    rest = boxes.join(first.select("frame", F.col("b1.det_id").alias("_one")), FRAME).filter(
        F.col("det_id") != F.col("_one"))
    return first.join(rest.groupBy("frame").agg(F.min("_b").alias("b2")), FRAME, "left")


def composition_type(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Composition label and score of every frame; below 0.30 the type is ``unknown``.

    ``frames`` has ``width, height``, the edge densities ``left_edge,
    right_edge`` of the halves and ``strip_top, strip_bottom, strip_left,
    strip_right`` of the border strips, and ``n_lines, diagonal_lines``.
    """
    rows = frames.join(_two_largest(detections), FRAME, "left")
    c, w, h = F.col, F.col("width") * 1.0, F.col("height") * 1.0
    area = -c("b1.a")
    has = c("b1").isNotNull() & (area > 0)
    cx, cy = (c("b1.x1") + c("b1.x2")) / 2.0, (c("b1.y1") + c("b1.y2")) / 2.0
    share = area / (w * h)

    vertical = (F.abs(cx - w / 3.0) < w * 0.08) | (F.abs(cx - w / 3.0 * 2.0) < w * 0.08)
    horizontal = (F.abs(cy - h / 3.0) < h * 0.08) | (F.abs(cy - h / 3.0 * 2.0) < h * 0.08)
    thirds = when_chain([(has & vertical & horizontal, 0.90), (has & (vertical | horizontal), 0.60)], 0.0)

    off = F.sqrt((cx - w / 2.0) * (cx - w / 2.0) + (cy - h / 2.0) * (cy - h / 2.0)) / F.sqrt(w * w / 4.0 + h * h / 4.0)
    center = when_chain([(has & (off < 0.10) & share.between(0.15, 0.40), 0.85),
                         (has & (off < 0.15) & share.between(0.10, 0.50), 0.50)], 0.0)

    diff = F.abs(c("left_edge") - c("right_edge"))
    middle = ~has | ((cx > w / 3.0) & (cx < w * 2.0 / 3.0))
    symmetry = F.when((diff < 0.15) & middle, F.least(F.lit(1.0) - diff * 5.0, F.lit(0.95))).otherwise(0.0)

    ratio = F.try_divide(c("diagonal_lines") * 1.0, c("n_lines"))
    leading = F.when((c("n_lines") > 5) & (ratio > 0.20), F.least(ratio, F.lit(0.95))).otherwise(0.0)

    bx, by = (c("b2.x1") + c("b2.x2")) / 2.0, (c("b2.y1") + c("b2.y2")) / 2.0
    aligned = F.abs(F.abs(F.try_divide(by - cy, bx - cx)) - h / w) < 0.5
    box_aspect = F.coalesce(F.try_divide(c("b1.y2") - c("b1.y1"), c("b1.x2") - c("b1.x1")), F.lit(0.0))
    diagonal = when_chain([
        ((c("n_boxes") >= 2) & F.coalesce(aligned, F.lit(False)), 0.75),
        ((c("n_boxes") == 1) & has & (share > 0.3) & (F.abs(box_aspect - h / w) < 0.5), 0.50)], 0.0)

    strips = sum(F.when(c(f"strip_{s}") > 0.08, 1).otherwise(0) for s in ("top", "bottom", "left", "right"))
    base = F.when(strips >= 4, 0.80).when(strips >= 3, 0.50).otherwise(0.0)
    margin = F.floor(F.least(w, h) * 0.15)
    within = has & (cx > margin) & (cx < w - margin) & (cy > margin) & (cy < h - margin)
    border = F.when((strips >= 3) & within, F.least(base + 0.15, F.lit(0.95))).otherwise(base)

    best = first_best([("rule_of_thirds", thirds), ("center", center), ("symmetry", symmetry),
                       ("leading_line", leading), ("diagonal", diagonal), ("frame", border)])
    names = F.create_map(*[F.lit(x) for pair in COMPOSITION_NAMES.items() for x in pair])
    rows = rows.withColumn("_best", best)
    return rows.select(
        "frame", F.when(F.col("_best.score") < 0.30, "unknown").otherwise(names[F.col("_best.label")])
        .alias("composition_type"), F.round("_best.score", 3).alias("composition_confidence"))


def grid_zone(cx: Column, cy: Column) -> Column:
    """Zone of a normalised point on the 3x3 grid."""
    col = F.when(cx < 0.33, "left").when(cx > 0.67, "right").otherwise("center")
    row = F.when(cy < 0.33, "top").when(cy > 0.67, "bottom").otherwise("middle")
    return (F.when((row == "middle") & (col == "center"), "center").when(row == "middle", col)
            .when(col == "center", row).otherwise(F.concat_ws("_", row, col)))


def composition_grid(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Weighted box area on a 3x3 grid per frame; frames without boxes get the empty result.

    Persons weigh 1.5.  ``frames`` has ``width, height`` and ``face_count``.
    """
    rows = detections.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).join(
        frames.select("frame", "width", "height"), FRAME)
    weight = F.when(F.col("class_name") == "person", 1.5).otherwise(1.0)
    cx = (F.col("x1") + F.col("x2")) / 2.0 / F.col("width")
    cy = (F.col("y1") + F.col("y2")) / 2.0 / F.col("height")
    rows = rows.select(
        "frame", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * weight).alias("_a"),
        grid_zone(cx, cy).alias("_z"), (F.abs(cx - cy) < 0.12).alias("_main"),
        (F.abs(cx + cy - 1.0) < 0.12).alias("_anti"))
    sums = rows.groupBy("frame").agg(
        F.sum("_a").alias("_total"), F.sum(F.when(F.col("_main"), F.col("_a")).otherwise(0.0)).alias("_main"),
        F.sum(F.when(F.col("_anti"), F.col("_a")).otherwise(0.0)).alias("_anti"),
        *[F.sum(F.when(F.col("_z") == z, F.col("_a")).otherwise(0.0)).alias(f"_{z}") for z in GRID_ZONES])
    rows = frames.select("frame", "width", "height", "face_count").join(sums, FRAME, "left")

    def side(test) -> Column:
        zones = [z for z in GRID_ZONES if test(z)]
        total = F.col(f"_{zones[0]}")
        for z in zones[1:]:
            total = total + F.col(f"_{z}")
        return total

    total = F.col("_total")
    lean = F.greatest(side(lambda z: "left" in z), side(lambda z: "right" in z)) / total > 0.55
    tilt = F.greatest(side(lambda z: z.startswith("top")), side(lambda z: z.startswith("bottom"))) / total > 0.55
    centre = F.col("_center") / total
    symmetry = when_chain([
        (total.isNull(), "空"), (centre > 0.6, "居中"), (~(centre > 0.2), "边缘"), (F.col("face_count") > 0, "居中"),
        (lean | tilt, "偏移")], "居中")
    best = first_best([(z, F.col(f"_{z}")) for z in GRID_ZONES])
    diagonal = F.greatest("_main", "_anti") / total
    coverage = total / F.greatest(F.col("width") * F.col("height"), F.lit(1))

    def share(x: Column, digits: int = 3) -> Column:
        return F.round(F.coalesce(x, F.lit(0.0)), digits)

    return rows.select(
        "frame", F.when(total.isNull(), "空").otherwise(best["label"]).alias("grid_dominant_zone"),
        share(best["score"] / total).alias("grid_dominant_ratio"), symmetry.alias("center_symmetry"),
        share(centre).alias("center_ratio"), F.coalesce(diagonal >= 0.20, F.lit(False)).alias("diagonal_presence"),
        share(diagonal).alias("diagonal_ratio"), share(coverage, 4).alias("subject_coverage"),
        when_chain([(total.isNull(), "空"), (coverage < 0.05, "点缀"), (coverage < 0.25, "适中")], "饱满")
        .alias("subject_coverage_label"),
        *[share(F.col(f"_{z}") / total).alias(f"zone_{z}") for z in GRID_ZONES])


# -- text regions ---------------------------------------------------------

def ocr_regions(words: DataFrame) -> DataFrame:
    """Text regions from word boxes ``(frame, word, text, conf, x, y, w, h, image_height)``.

    ``conf`` is text; -1 or a bad number means 0.6.  ``region`` numbers the
    words of a frame from the largest box on.
    """
    number = F.expr("try_cast(conf as double)")
    confidence = F.when((F.col("conf") == "-1") | number.isNull(), 0.6).otherwise(number / 100.0)
    height = F.coalesce(F.try_divide(F.col("h") * 1.0, F.col("image_height")), F.lit(0.0))
    rows = words.withColumn("text", F.trim("text")).filter(F.col("text") != "")
    rows = rows.withColumn("confidence", confidence).withColumn("_area", -(F.col("w") * F.col("h")))
    rows = rows.withColumn("text_size_rank", F.when(height >= 0.20, "large").when(height >= 0.05, "medium")
                           .otherwise("small")).withColumn("low_confidence", F.col("confidence") < 0.4)
    return ordered(rows, FRAME, ["_area", "word"], number="region").drop("_area")


def ocr_timestamps(ocr: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Time of every text row by the frame number in its file name; 0 where unknown."""
    number = F.expr(r"try_cast(regexp_extract(path, 'frame_(\\d+)', 1) as bigint)")
    rows = ocr.withColumn("frame_index", number)
    times = keyframes.groupBy("video_id", "frame_index").agg(F.min("t_s").alias("_t"))
    return rows.join(times, ["video_id", "frame_index"], "left").withColumn(
        "t_s", F.coalesce("_t", F.lit(0.0))).drop("_t")


# -- motion ---------------------------------------------------------------

def motion_from_tracks(tracks: DataFrame, pairs: DataFrame, min_points: int = 30) -> DataFrame:
    """Camera motion of frame pairs from tracked points ``(pair, ax, ay, bx, by, error)``.

    ``pairs`` has ``width, height, n_points`` (points before tracking) and
    ``brightness_a, brightness_b``.  Medians give displacement, scale and
    rotation; pairs with fewer than ``min_points`` points get the neutral row.
    """
    key = ["pair"]
    centres = tracks.groupBy("pair").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("ax").alias("_ax"), F.avg("ay").alias("_ay"), F.avg("bx").alias("_bx"),
        F.avg("by").alias("_by"), F.avg("error").alias("_err"))
    rows = tracks.join(centres.filter(F.col("_n") >= min_points), "pair")
    ax, ay = F.col("ax") - F.col("_ax"), F.col("ay") - F.col("_ay")
    bx, by = F.col("bx") - F.col("_bx"), F.col("by") - F.col("_by")
    ra, rb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    tall = rows.select("pair", F.explode(F.array(
        F.struct(F.lit("dx").alias("m"), (F.col("bx") - F.col("ax")).alias("v")),
        F.struct(F.lit("dy").alias("m"), (F.col("by") - F.col("ay")).alias("v")),
        F.struct(F.lit("scale").alias("m"), F.when(ra > 1e-4, rb / ra).alias("v")),
        F.struct(F.lit("turn").alias("m"), (F.atan2(by, bx) - F.atan2(ay, ax)).alias("v")))).alias("_x"))
    tall = tall.select("pair", F.col("_x.m").alias("metric"), F.col("_x.v").alias("v"))
    medians = percentiles(tall, ["pair", "metric"], "v", {"med": 0.5}).groupBy("pair").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("med"))).alias(f"_{m}") for m in ("dx", "dy", "scale", "turn")])
    joined = pairs.join(centres, key, "left").join(medians, key, "left")
    few = F.coalesce(F.col("_n") < min_points, F.lit(True))
    degrees = F.degrees("_turn") + 180.0
    turn = degrees - F.floor(degrees / 360.0) * 360.0 - 180.0
    trust = (F.col("_n") / F.greatest("n_points", F.lit(1)) * 0.6
             + F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("_err", F.lit(1.0)) / 10.0) * 0.4)

    def value(x: Column, neutral: float, digits: int) -> Column:
        return F.when(few, neutral).otherwise(F.round(x, digits))

    return joined.select(
        "pair", value(F.col("_dx") / F.col("width"), 0.0, 5).alias("dx"),
        value(F.col("_dy") / F.col("height"), 0.0, 5).alias("dy"),
        value(F.coalesce("_scale", F.lit(1.0)), 1.0, 4).alias("scale"), value(turn, 0.0, 2).alias("rotation"),
        value(F.col("brightness_b") - F.col("brightness_a"), 0.0, 2).alias("brightness_delta"),
        value(trust, 0.0, 3).alias("confidence"))


def median3(df: DataFrame, col: str, keys: list[str], order: str, digits: int = 4) -> DataFrame:
    """Median of each value and its neighbours; keys with fewer than three rows stay as they are."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    near = ordered(df, keys, [order], dense=True, lag={"_p": F.col(col)}, lead={"_f": F.col(col)}).join(sizes, keys)
    three = F.array_sort(F.array_compact(F.array("_p", col, "_f")))
    median = F.when(F.size(three) == 3, F.get(three, 1)).otherwise((F.get(three, 0) + F.get(three, 1)) / 2)
    return near.withColumn(col, F.when(F.col("_n") >= 3, F.round(median, digits)).otherwise(F.col(col))).drop(
        "_p", "_f", "_n")


def motion_label(dx: Column, dy: Column, scale: Column, rotation: Column, brightness: Column,
                 distance: Column | None = None) -> Column:
    """Motion label; the first rule that holds decides."""
    distance = F.lit(0.0) if distance is None else distance
    x, y = F.abs(dx), F.abs(dy)
    pan = (F.when(x >= y, F.when(dx > 0, "PAN_RIGHT").otherwise("PAN_LEFT"))
           .otherwise(F.when(dy > 0, "PAN_DOWN").otherwise("PAN_UP")))
    return when_chain([
        ((distance > 0.6) & (x + y < 0.05), "CUT"),
        ((F.abs(brightness) > 30) & (F.abs(scale - 1.0) < 0.03) & (F.abs(rotation) < 1.0),
         F.when(brightness > 0, "FADE_IN").otherwise("FADE_OUT")),
        (F.abs(scale - 1.0) > 0.02, F.when(scale > 1.0, "ZOOM_IN").otherwise("ZOOM_OUT")),
        (F.abs(rotation) > 2, F.when(rotation > 0, "ROTATE_CW").otherwise("ROTATE_CCW")),
        ((x > 0.03) | (y > 0.03), pan)], "STATIC")
