"""Media catalogue, probe results and encoder logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipline.constants import MAX_UPLOAD_BYTES, VIDEO_EXTENSIONS

# First bytes (hex) of known containers.
_SIGNATURES = [("1A45DFA3", "webm/mkv"), ("52494646", "avi"), ("000001BA", "mpeg"), ("000001B3", "mpeg")]
_FTYP = "66747970"


def file_format(content: Column) -> Column:
    """Container by its first bytes; null when unknown or shorter than 12 bytes."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    found = F.when(F.substring(head, 9, 8) == _FTYP, "mp4/mov/3gp").otherwise(found)
    for signature, name in reversed(_SIGNATURES):
        found = F.when(head.startswith(signature), name).otherwise(found)
    return F.when(F.length(content) >= 12, found)


def _extension(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"[^/](\.[^./]*)$", 1)
    return F.when(ext == "", ".mp4").otherwise(ext)


def media_catalog(spark: SparkSession, path: str, *, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files as rows: content id, format, size and why a file is rejected (null = accepted).

    Files above the size cap are listed from metadata only; the filter on
    ``length`` keeps their content from being read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.col("length").alias("size_bytes")).withColumn("ext", _extension(F.col("path")))
    too_big = listed.filter(F.col("size_bytes") > max_bytes).select(
        "path", "size_bytes", "ext", F.lit(None).cast("string").alias("video_id"),
        F.lit(None).cast("string").alias("format"))
    read = files.filter(F.col("length") <= max_bytes).select(
        "path", F.col("length").alias("size_bytes"), _extension(F.col("path")).alias("ext"),
        F.substring(F.sha2("content", 256), 1, 16).alias("video_id"), file_format(F.col("content")).alias("format"))
    rows = read.unionByName(too_big)
    reason = (F.when(F.col("size_bytes") > max_bytes, "file too large").when(F.col("size_bytes") < 12, "file too small")
              .when(F.col("format").isNull(), "unknown container")
              .when(~F.col("ext").isin(*VIDEO_EXTENSIONS), "unsupported extension"))
    return rows.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("reject_reason", reason)


def list_materials(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Files by name, last first; ``files`` has path and length (no content is read)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("material_id"), name.alias("filename"),
        F.regexp_extract(F.lower(name), r".(\.[^.]*)$", 1).alias("ext"), F.col("length").alias("size_bytes"))
    if extensions:
        rows = rows.filter(F.col("ext").isin(*extensions))
    return rows.orderBy(F.desc("filename"))


_PROBE = ("format struct<duration:string,bit_rate:string>, streams array<struct<codec_type:string,codec_name:string,"
          "width:int,height:int,r_frame_rate:string>>")


def frame_rate(text: Column) -> Column:
    """Frames per second from ``n/d``; null when d is 0 or the text is not a fraction."""
    parts = F.split(text, "/")

    def number(i: int) -> Column:
        return F.when(F.get(parts, i).rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.get(parts, i).cast("double"))

    return F.when(F.size(parts) == 2, F.try_divide(number(0), number(1)))


def probe_metadata(df: DataFrame, json_col: str) -> DataFrame:
    """Duration, size, rate and codec of the first video stream of a probe result; 0 counts as missing."""
    rows = df.withColumn("_p", F.from_json(json_col, _PROBE))
    stream = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), 0)
    rows = rows.withColumn("_v", stream)
    duration = F.when(F.col("_p.format.duration").rlike(r"^[0-9.]+$"), F.col("_p.format.duration").cast("double"))
    return rows.withColumns({
        "duration_s": F.nullif(duration, F.lit(0.0)), "width": F.nullif(F.col("_v.width"), F.lit(0)),
        "height": F.nullif(F.col("_v.height"), F.lit(0)), "fps": frame_rate(F.coalesce("_v.r_frame_rate", F.lit("0/1"))),
        "codec": F.coalesce("_v.codec_name", F.lit(""))}).drop("_p", "_v")


def parse_progress(df: DataFrame, line_col: str) -> DataFrame:
    """Time, bitrate and speed of encoder progress lines; null where a line has no ``time=``."""
    line = F.col(line_col)
    timed = r"time=(\d+):(\d+):(\d+)\.(\d+)"

    def part(i: int) -> Column:
        return F.regexp_extract(line, timed, i)

    def number(pattern: str) -> Column:
        text = F.regexp_extract(line, pattern, 1)
        return F.when(line.contains("time=") & text.rlike(r"^\d*\.?\d+$"), text.cast("double"))

    found = part(1) != ""
    whole = F.nullif(part(1), F.lit("")).cast("int") * 3600.0 + F.nullif(part(2), F.lit("")).cast(
        "int") * 60.0 + F.nullif(part(3), F.lit("")).cast("int")
    fraction = F.concat(F.lit("0."), F.nullif(part(4), F.lit(""))).cast("double")
    raw = F.concat(F.lpad(part(1), 2, "0"), F.lit(":"), F.lpad(part(2), 2, "0"), F.lit(":"), F.lpad(part(3), 2, "0"),
                   F.lit("."), part(4))
    return df.withColumns({
        "time_sec": F.when(found, whole + fraction), "raw_time": F.when(found, raw),
        "bitrate_kbps": number(r"bitrate=\s*([\d.]+)kbits/s"), "speed": number(r"speed=\s*([\d.]+)x")})
