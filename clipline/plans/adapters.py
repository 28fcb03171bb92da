"""Adapters from the sample tables to the canonical timeline tables.

One clock hour of ``events`` plays one second of media, so every user is a
"video" of up to 720 s; ``lineitem`` plays edit scripts and detections,
``conversations`` transcripts, ``embeddings`` frame histograms, ``orders``
scripts and jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipline.constants import SEGMENT_TYPES
from clipline.operators.ordered import ordered, with_totals

MICROS_PER_MEDIA_SECOND = 3.6e9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with media time ``t_s`` and the integer ``k`` of their properties."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_type", "value", "props")
    events = with_totals(events, ["video_id"], _first=F.min("us"))
    return events.select(
        "video_id", "us", ((F.col("us") - F.col("_first")) / F.lit(MICROS_PER_MEDIA_SECOND)).alias("t_s"),
        "event_type", "value", F.from_json("props", "k INT")["k"].alias("k"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media events with their number ``idx`` in the video: the one table that all window signals come from."""
    events = _numbered(spark, sf_dir, "event_type", "value", "props")
    return events.select("video_id", "us", "t_s", "event_type", "value", F.from_json("props", "k INT")["k"].alias("k"), "idx")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, "value").select("video_id", "idx", "t_s", "value")


def _numbered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events in time order with their number ``idx`` and media time ``t_s``, without a join.

    In this order the least time so far is the first of the video; an event without a time has no media time either way.
    """
    events = table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("video_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *columns)
    events = ordered(events, ["video_id"], ["us"], running={"_first": ("min", F.col("us"))}, number="idx")
    return events.withColumn("t_s", (F.col("us") - F.col("_first")) / F.lit(MICROS_PER_MEDIA_SECOND))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return events.groupBy("video_id").agg(
        ((F.max("us") - F.min("us")) / F.lit(MICROS_PER_MEDIA_SECOND)).alias("duration_s"))


def times_of(events: DataFrame, event_type: str) -> DataFrame:
    return events.filter(F.col("event_type") == event_type).select("video_id", "t_s")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_of(media_events(spark, sf_dir), "click")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_of(media_events(spark, sf_dir), "signup")


def spans_of(events: DataFrame, event_type: str, divisor: float) -> DataFrame:
    return (events.filter(F.col("event_type") == event_type)
            .select("video_id", F.col("t_s").alias("start_s"),
                    (F.col("t_s") + F.col("value") / F.lit(divisor)).alias("end_s"),
                    F.concat(F.lit("k"), F.col("k").cast("string")).alias("text")))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(media_events(spark, sf_dir), "view", 10.0)


def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(media_events(spark, sf_dir), "error", 20.0)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-screen texts, one row per text region."""
    return texts_of(media_events(spark, sf_dir))


def texts_of(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type") == "purchase")
            .select("video_id", "t_s", "value", F.concat(F.lit("k"), F.col("k").cast("string")).alias("text")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment per day of events (24 media seconds), with the event types as evidence."""
    e = media_events(spark, sf_dir).withColumn("seg_idx", F.floor(F.col("t_s") / 24))
    kinds = F.array(*[F.lit(t) for t in SEGMENT_TYPES])
    rows = e.groupBy("video_id", "seg_idx").agg(
        F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"), F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_set("event_type")).alias("evidence"))
    return rows.select(
        "video_id", "seg_idx", "start_s", "end_s",
        F.get(kinds, (F.col("seg_idx") % 5).cast("int")).alias("structure_type"),
        F.concat(F.lit("s"), (F.col("_n") % 3).cast("string")).alias("sub_type"), F.lit(0.8).alias("confidence"),
        "evidence")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seq"), "text",
        F.length("text").cast("long").alias("_chars"))
    timed = ordered(turns, ["video_id"], ["seq"],
                    before={"_from": ("sum", F.col("_chars"))}, running={"_to": ("sum", F.col("_chars"))})
    return timed.select(
        "video_id", "seq", (F.coalesce(F.col("_from"), F.lit(0)) / F.lit(15.0)).alias("start_s"),
        (F.col("_to") / F.lit(15.0)).alias("end_s"), "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"), "vec_id",
        F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("hist"))
    return ordered(rows, ["video_id"], ["vec_id"], number="idx").select("video_id", "idx", "vec_id", "hist")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object boxes per frame; ``det_id`` orders the boxes of a frame."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("det_id"),
        F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "N", "car")
        .otherwise("dog").alias("class_name"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        (F.col("l_quantity") * 20).alias("x1"), (F.col("l_linenumber") * F.lit(100.0)).alias("y1"),
        (F.lit(100) + F.col("l_discount") * 1000).alias("_w"), (F.lit(80) + F.col("l_tax") * 1000).alias("_h"))
    return rows.select("frame", "det_id", "class_name", "confidence", "x1", "y1",
                       (F.col("x1") + F.col("_w")).alias("x2"), (F.col("y1") + F.col("_h")).alias("y2"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-script modules: position, id, type, track, start and duration."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("script_id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("_us"), "l_linenumber",
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    # In this order the least time so far is the first of the script; a row without a time has no start either way.
    rows = ordered(rows.filter(F.col("script_id").isNotNull()), ["script_id"], ["_us", "l_linenumber", "l_partkey", "l_suppkey"],
                   running={"_first": ("min", F.col("_us"))}, number="pos")
    kind = (F.when(F.col("l_returnflag") == "A", "title").when(F.col("l_returnflag") == "N", "video_segment")
            .otherwise("effect"))
    return rows.select(
        "script_id", "pos", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("id"),
        kind.alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("label"),
        ((F.col("_us") - F.col("_first")) / F.lit(8.64e10)).alias("start_time"),
        F.col("l_quantity").cast("double").alias("duration"),
        (F.col("l_suppkey") % 3).cast("long").alias("track_index"), F.col("l_linestatus").alias("detail"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks 0 and 1 for every script."""
    scripts_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("script_id"))
    return scripts_.select("script_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("index"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("script_id"), (F.col("o_totalprice") / 1000).alias("total_duration"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing")
              .otherwise("pending"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("type"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_totalprice").alias("elapsed_ms"))
