"""Video type from aggregate signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.constants import DEFAULT_VIDEO_TYPE, PRESETS
from clipline.functions.expressions import ranked

VID = ["video_id"]


def video_summary(frames: DataFrame, audio: DataFrame) -> DataFrame:
    """Mean faces, flow and edges, neutral flag, music label (else mood) and tempo per video.

    The flag holds when more than half of the frames with a known colour are neutral.
    """
    def mean(name: str) -> Column:
        return F.avg(F.coalesce(F.col(name), F.lit(0.0)))

    neutral = F.avg(F.when(F.coalesce("is_neutral", F.lit(False)), 1.0).otherwise(0.0)) > 0.5
    stats = frames.groupBy("video_id").agg(
        F.round(mean("face_count"), 3).alias("face_count_avg"), F.round(mean("optical_flow"), 2).alias("optical_flow_avg"),
        F.round(mean("edge_density"), 4).alias("edge_density_avg"), neutral.alias("is_dominantly_neutral"))
    label = F.coalesce(F.nullif(F.col("bgm_type"), F.lit("")), F.nullif(F.col("mood"), F.lit("")), F.lit(""))
    return stats.join(audio.select("video_id", label.alias("bgm_type"), F.coalesce("bpm", F.lit(0.0)).alias("bpm")),
                      VID, "left").fillna({"bgm_type": "", "bpm": 0.0})


def classify_video(summary: DataFrame) -> DataFrame:
    """Three best video types with rounded scores; ties keep the order of the presets.

    Rows with no signal at all get the default type with 0.3.
    """
    inputs = ["face_count_avg", "optical_flow_avg", "edge_density_avg", "bgm_type", "bpm", "is_dominantly_neutral"]
    faces, flow, edges = (F.coalesce(F.col(c), F.lit(0.0)) for c in inputs[:3])
    music, bpm = F.coalesce(F.col("bgm_type"), F.lit("")), F.coalesce(F.col("bpm"), F.lit(0.0))
    neutral = F.coalesce(F.col("is_dominantly_neutral"), F.lit(False))

    def says(*words: str) -> Column:
        return music.contains(words[0]) | music.contains(words[1])

    loud, lively, soft, low = says("激昂", "紧张"), says("明快", "活泼"), says("舒缓", "沉静"), says("低沉", "空灵")
    # Points per type for every condition.
    rules: list[tuple[Column, dict[str, float]]] = [
        ((flow > 10) & (edges > 0.08), {"gaming": 0.35, "sports": 0.30, "anime": 0.25}),
        (faces > 0.5, {"vlog": 0.20, "lecture": 0.15, "parenting": 0.15, "beauty_fashion": 0.15}),
        (neutral, {"commercial": 0.25, "lecture": 0.20, "knowledge": 0.15}),
        (loud, {"gaming": 0.15, "sports": 0.15, "anime": 0.10}),
        (~loud & lively, {"vlog": 0.15, "travel": 0.15, "food": 0.10}),
        (~loud & ~lively & soft, {"lecture": 0.20, "travel": 0.15, "agriculture": 0.10}),
        (~loud & ~lively & ~soft & low, {"music": 0.15, "film_tv": 0.10}),
        (bpm > 120, {"gaming": 0.10, "sports": 0.10}),
        (bpm < 70, {"lecture": 0.10, "travel": 0.10}),
        ((flow < 3) & (edges < 0.04), {"lecture": 0.15, "knowledge": 0.15, "commercial": 0.10}),
    ]
    scores = []
    for label in PRESETS:
        total = F.lit(0.0)
        for condition, points in rules:
            if label in points:
                total = total + F.when(condition, F.lit(points[label])).otherwise(0.0)
        scores.append((label, total))
    nothing = F.lit(True)
    for c in inputs:
        nothing = nothing & F.col(c).isNull()
    default = F.array(F.struct(F.lit(0.3).alias("score"), F.lit(0).alias("rank"), F.lit(DEFAULT_VIDEO_TYPE).alias("label")))
    rows = summary.withColumn("_top", F.when(nothing, default).otherwise(F.slice(ranked(scores), 1, 3)))
    top = F.transform("_top", lambda s: F.struct(s["label"].alias("label"), F.round(s["score"], 4).alias("score")))
    return rows.select("video_id", F.col("_top")[0]["label"].alias("video_type"),
                       F.round(F.col("_top")[0]["score"], 4).alias("confidence"), top.alias("top3"),
                       F.when(nothing, "heuristic_fallback").otherwise("heuristic").alias("method"))


def resolve_type(videos: DataFrame, classified: DataFrame, threshold: float = 0.4) -> DataFrame:
    """The type the user gave, else a known and confident class, else the default."""
    rows = videos.join(classified.select("video_id", F.col("video_type").alias("_c"), "confidence"), VID, "left")
    given = F.when(F.col("video_type") != DEFAULT_VIDEO_TYPE, F.col("video_type"))
    found = F.when((F.col("confidence") > threshold) & F.col("_c").isin(*PRESETS), F.col("_c"))
    return rows.select("video_id", F.coalesce(given, found, F.lit(DEFAULT_VIDEO_TYPE)).alias("video_type"))
