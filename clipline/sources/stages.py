"""Stage artifacts and legacy job tables."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Runs of a stage after which a save merges them.
COMPACT_AFTER = 64


def _folder(root: str, stage: str, *parts: str) -> str:
    return os.path.join(root, f"stage={stage}", *parts)


def _runs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the runs in a folder, oldest first; compaction keeps their number near COMPACT_AFTER."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))


def _write_run(artifact: DataFrame, root: str, stage: str, run: str, videos: DataFrame | None) -> None:
    rows = _folder(root, stage, "rows", f"run={run}")
    artifact.write.mode("overwrite").parquet(rows)
    covered = artifact.sparkSession.read.parquet(rows) if videos is None else videos
    covered.select("video_id").distinct().write.mode("overwrite").parquet(_folder(root, stage, "videos", f"run={run}"))


def save_stage(artifact: DataFrame, root: str, stage: str, videos: DataFrame | None = None) -> str:
    """Append the artifact of a stage as one run; the newest run of a video replaces its older ones.

    ``videos`` names the videos the run covered, so that one without rows loses
    its older rows too; without it these are the videos of the artifact. The
    rows are written first and the list of videos after them: a run that failed
    in between does not exist for readers. Saving never rewrites other videos;
    after ``COMPACT_AFTER`` runs it merges those that are there.
    """
    run = f"r{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _write_run(artifact, root, stage, run, videos)
    if len(_runs(artifact.sparkSession, _folder(root, stage, "videos"))) > COMPACT_AFTER:
        compact_stage(artifact.sparkSession, root, stage)
    return run


def _live(spark: SparkSession, root: str, stage: str) -> tuple[DataFrame, DataFrame] | None:
    """Newest rows of every video, and the videos that have a run; None without any.

    The newest runs are joined with the folders of the rows by their names, so
    folders that no video needs are not read.
    """
    try:
        covered = spark.read.parquet(_folder(root, stage, "videos"))
    except AnalysisException:
        return None
    newest = covered.groupBy("video_id").agg(F.max("run").alias("run"))
    rows = spark.read.parquet(_folder(root, stage, "rows"))
    return rows.join(newest, ["video_id", "run"], "left_semi").drop("run"), newest.select("video_id")


def load_stage(spark: SparkSession, root: str, stage: str) -> DataFrame | None:
    """Newest artifact rows of every video, or None when the stage was never saved."""
    found = _live(spark, root, stage)
    return None if found is None else found[0]


def compact_stage(spark: SparkSession, root: str, stage: str) -> None:
    """Merge all runs that are there into one and remove them; later runs stay newer.

    The merged run sorts right behind the newest of those it holds, so readers
    see the same rows before, between and after the steps. One compaction of a
    stage at a time; a load that began before the removal has to be repeated.
    """
    old = _runs(spark, _folder(root, stage, "videos"))
    if len(old) < 2:
        return
    known = spark.read.option("basePath", _folder(root, stage, "videos")).parquet(
        *[_folder(root, stage, "videos", f"run={r}") for r in old])
    newest = known.groupBy("video_id").agg(F.max("run").alias("run"))
    rows = spark.read.option("basePath", _folder(root, stage, "rows")).parquet(
        *[_folder(root, stage, "rows", f"run={r}") for r in old])
    _write_run(rows.join(newest, ["video_id", "run"], "left_semi").drop("run"), root, stage, old[-1] + "-all",
               newest.select("video_id"))
    for part in ("videos", "rows"):  # without its videos a run does not exist for readers
        for run in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(_folder(root, stage, part, f"run={run}"))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_KNOWN = ("status", "type", "input_path", "progress", "result", "error", "created_at", "updated_at")


def migrate_jobs(jobs: DataFrame, job_data: DataFrame) -> DataFrame:
    """Legacy two-table jobs to one table.

    Per job the ``job_data`` row with the highest id counts.  Its JSON fields
    override the columns of the job; unknown ones are folded into ``result``.
    Broken JSON counts as empty.
    """
    latest = job_data.groupBy("job_id").agg(F.max_by("data_json", "id").alias("_json"))
    extra = F.from_json("_json", "map<string,string>")
    rows = jobs.join(latest, jobs["id"] == latest["job_id"], "left").withColumn(
        "_x", F.coalesce(extra, F.create_map().cast("map<string,string>")))

    def field(name: str, old):
        return F.coalesce(F.try_element_at("_x", F.lit(name)), old)

    rest = F.map_filter("_x", lambda k, v: ~k.isin(*_KNOWN))
    progress = F.expr("try_cast(_x['progress'] as double)")
    return rows.select(
        jobs["id"], F.lit("analysis").alias("type"), field("status", F.coalesce(jobs["status"], F.lit("unknown"))).alias("status"),
        field("input_path", F.coalesce(jobs["video_path"], F.lit(""))).alias("input_path"),
        F.coalesce(progress, F.lit(0.0)).alias("progress"), F.to_json(rest).alias("result"),
        F.try_element_at("_x", F.lit("error")).alias("error"),
        field("created_at", jobs["created_at"].cast("string")).alias("created_at"),
        field("updated_at", jobs["updated_at"].cast("string")).alias("updated_at"))


def import_job_files(spark: SparkSession, path: str) -> DataFrame:
    """Legacy jobs from one JSON file per job; the id is the file name.  Unreadable files are skipped."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("id"),
        F.from_json("value", "map<string,string>").alias("_x"))
    files = files.filter((F.col("id") != "") & F.col("_x").isNotNull())

    def field(name: str, missing: str):
        return F.coalesce(F.try_element_at("_x", F.lit(name)), F.lit(missing)).alias(name)

    rest = F.map_filter("_x", lambda k, v: ~k.isin("id", "type", "status", "input_path", "progress", "result", "error"))
    return files.select("id", field("type", "analysis"), field("status", "unknown"), field("input_path", ""),
                        F.when(F.size(rest) > 0, F.to_json(rest)).alias("result"))
