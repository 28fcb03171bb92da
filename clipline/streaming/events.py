"""Streaming source, sinks and drivers for timeline events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipline.session import scratch

EVENT_SCHEMA = ("job_id bigint, video_id bigint, module_id string, ts timestamp, seq bigint, kind string, "
                "progress double, t_s double, end_s double, payload string")
_TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default keeps milliseconds only
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, *, files_per_trigger: int | None = None) -> DataFrame:
    """Event stream from a folder of JSON lines."""
    reader = spark.readStream.schema(schema).option("timestampFormat", _TIMESTAMPS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_events(events: DataFrame, path: str) -> None:
    """Write a batch of events as JSON lines, one folder per day; a large day is spread over several tasks."""
    events.withColumn("day", F.to_date("ts")).repartitionByRange("ts", "seq").write.mode("append").option(
        "timestampFormat", _TIMESTAMPS).partitionBy("day").json(path)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state in RocksDB, which the stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_append(stream: DataFrame, name: str, *, idle_batches: bool = True) -> DataFrame:
    """Run a stream over all available input into Parquet and read the result.

    Streams whose state expires by processing time (``live.throttle``,
    ``live.until_terminal``) ask for another batch as long as they run, so they
    end only without ``idle_batches``; those with event-time timers need them
    for what is due at the end.
    """
    spark = stream.sparkSession
    out, before = scratch(spark, name), spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(idle_batches).lower())
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
                 .option("path", out).option("checkpointLocation", scratch(spark, name + "-state")).start())
    finally:
        spark.conf.set(IDLE_BATCHES, before)  # the running query has its own copy
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, mode: str, prepare=None, first: DataFrame | None = None) -> DataFrame:
    """Run a stream with one folder per micro-batch (``batch``), safe to repeat after a failure.

    ``prepare(rows, batch_id)`` may change what a batch writes; ``first`` is
    written as batch -1 before the stream starts.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)
    if first is not None:
        first.write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = prepare(rows, batch_id) if prepare else rows
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", scratch(spark, name + "-state")).foreachBatch(write).start())
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)
