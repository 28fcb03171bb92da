"""Tuning presets per video type (16 rows, so always safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipline.constants import DEFAULT_VIDEO_TYPE, PRESET_FIELDS, PRESETS


def load_presets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Presets from a JSON file of ``{"presets": {type: [9 numbers]}}``; embedded rows without a path."""
    if path is None:
        rows = [(name, *values) for name, values in PRESETS.items()]
        schema = "video_type string, " + ", ".join(f"{f} double" for f in PRESET_FIELDS)
        return spark.createDataFrame(rows, schema)
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json(
        "value", "presets map<string, array<double>>")["presets"]).alias("video_type", "_v"))
    return parsed.select("video_type", *[F.col("_v")[i].alias(f) for i, f in enumerate(PRESET_FIELDS)])


def with_preset(videos: DataFrame, presets: DataFrame | None = None, *, compat: bool = False) -> DataFrame:
    """Add the preset fields; videos without a known ``video_type`` get the default type.

    ``compat=True`` gives videos without a type the built-in neutral numbers
    instead, where the closing share is 0.85 (so the closing zone starts at 15%).
    """
    own = presets is not None
    presets = presets if own else load_presets(videos.sparkSession)
    if "video_type" not in videos.columns:
        videos = videos.withColumn("video_type", F.lit(None).cast("string"))
    known = presets.withColumnRenamed("video_type", "_type")
    known = known if own else F.broadcast(known)  # the built-in table is small
    joined = videos.join(known, F.col("video_type") == F.col("_type"), "left")
    neutral = dict(zip(PRESET_FIELDS, (0.10, 0.85, 1.0, 1.0, 1.0, 1.0, 1.0, 0.7, 1.0)))
    usual = dict(zip(PRESET_FIELDS, PRESETS[DEFAULT_VIDEO_TYPE]))
    fields = []
    for f in PRESET_FIELDS:
        missing = F.lit(usual[f])
        if compat:
            missing = F.when(F.col("video_type").isNull(), F.lit(neutral[f])).otherwise(missing)
        fields.append(F.coalesce(F.col(f), missing).alias(f))
    kept = [F.col(c) for c in videos.columns if c not in PRESET_FIELDS]
    return joined.select(*kept, *fields)
