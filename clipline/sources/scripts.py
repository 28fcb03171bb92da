"""Script documents, text exports and timeline pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipline.session import shuffles_dropped

KEY = ["script_id"]

MODULE_SCHEMA = (
    "id string, type string, label string, start_time double, duration double, track_index bigint, "
    "source struct<type:string,path:string,start_offset:double,end_offset:double>, "
    "params struct<text_content:string,font_size:int,font_color:string,position:struct<x:double,y:double>,"
    "animation:string,volume:double,transition_type:string>, extra_params map<string,string>, detail string")
SCRIPT_SCHEMA = (
    "script_id string, version string, metadata struct<title:string,description:string,author:string,"
    "created_at:timestamp,total_duration:double,source_video_id:string,fps:double,"
    "resolution:struct<width:int,height:int>,tags:array<string>>, modules array<struct<"
    + ",".join(f.strip().replace(" ", ":", 1) for f in
               ["id string", "type string", "label string", "start_time double", "duration double", "track_index bigint",
                "source struct<type:string,path:string,start_offset:double,end_offset:double>",
                "params struct<text_content:string,font_size:int,font_color:string,position:struct<x:double,y:double>,"
                "animation:string,volume:double,transition_type:string>",
                "extra_params map<string,string>", "detail string"])
    + ">>, tracks array<struct<index:bigint,name:string,type:string,muted:boolean,locked:boolean>>")
LINE_SCHEMA = f"{SCRIPT_SCHEMA}, pos bigint, module struct<{SCRIPT_SCHEMA.split('modules array<struct<')[1].split('>>, tracks')[0]}>"


def script_documents(scripts: DataFrame, modules: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """One document per script: version, metadata, modules in order and tracks.

    The interchange form, in which a whole script is one value; scripts of any
    size are stored as lines (``script_lines``).
    """
    lists = modules.groupBy("script_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", _module(modules).alias("m")))), lambda s: s["m"])
        .alias("modules"))
    return _heads(scripts, tracks).join(lists, KEY, "left")


def _module(modules: DataFrame) -> Column:
    return F.struct(*[c for c in modules.columns if c not in ("script_id", "pos")])


def _heads(scripts: DataFrame, tracks: DataFrame | None) -> DataFrame:
    meta = [c for c in scripts.columns if c not in ("script_id", "version")]
    heads = scripts.select("script_id", "version", F.struct(*meta).alias("metadata"))
    if tracks is not None:
        columns = [c for c in tracks.columns if c != "script_id"]
        # Tracks of a script are few.
        own = tracks.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("tracks"))
        heads = heads.join(own, KEY, "left")
    return heads


def script_lines(scripts: DataFrame, modules: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """A head line (version, metadata, tracks) per script and a line (pos, module) per module, whatever the size."""
    lines = modules.select("script_id", F.col("pos").cast("long").alias("pos"), _module(modules).alias("module"))
    return _heads(scripts, tracks).unionByName(lines, allowMissingColumns=True)


def write_scripts(scripts: DataFrame, modules: DataFrame, tracks: DataFrame | None, path: str) -> None:
    """Write scripts as compressed JSON lines, see ``script_lines``."""
    with shuffles_dropped(modules.sparkSession):
        script_lines(scripts, modules, tracks).write.mode("overwrite").option("compression", "gzip").json(path)


def read_scripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scripts, modules and tracks of JSON lines or whole documents (fixed schema, nothing inferred)."""
    lines = spark.read.schema(LINE_SCHEMA).json(path)
    heads = lines.filter(F.col("module").isNull())
    listed = F.transform("modules", lambda m, i: F.struct(i.cast("long").alias("pos"), m.alias("module")))
    own = F.when(F.col("module").isNull(), listed).otherwise(F.array(F.struct("pos", "module")))
    modules = lines.select("script_id", F.explode(own).alias("_m")).select("script_id", "_m.pos", "_m.module.*")
    tracks = heads.select("script_id", F.explode("tracks").alias("_t")).select("script_id", "_t.*")
    return heads.select("script_id", "version", "metadata.*"), modules, tracks


# -- text exports ---------------------------------------------------------

def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; ``0:00`` for nothing."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    long = F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(rest))
    short = F.concat(m.cast("string"), F.lit(":"), _two(rest))
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, "0:00").when(h > 0, long).otherwise(short)


def srt_time(seconds: Column) -> Column:
    """``hh:mm:ss,mmm``, rounded to whole milliseconds."""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    s = F.floor(ms / 1000).cast("long")
    return F.concat(_two(F.floor(s / 3600).cast("long")), F.lit(":"), _two(F.floor(s % 3600 / 60).cast("long")), F.lit(":"),
                    _two(s % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def export_script(blocks: DataFrame, fmt: str, titles: DataFrame) -> DataFrame:
    """Text of every script as numbered lines (script_id, line_no, line).

    ``fmt`` is json, markdown, html, srt or plain; ``blocks`` comes from
    ``blueprint.compose_blocks`` and ``titles`` has (script_id, title).  Line
    numbers follow from the block order, so no script is gathered in one task;
    ``write_lines`` stores them in order.
    """
    stats = blocks.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("end_time", "order").alias("total"))
    heads = titles.join(stats, KEY, "left").fillna({"n": 0, "total": 0.0})
    b, span = F.col, F.concat(clock(F.col("start_time")), F.lit(" → "), clock(F.col("end_time")))
    secs = F.concat(F.floor(F.col("duration") + 0.5).cast("long").cast("string"), F.lit("s"))
    number = (F.col("order") + 1).cast("string")
    title, n, total = F.col("title"), F.col("n"), F.col("total")
    summary = F.concat(F.lit("共 "), n.cast("string"), F.lit(" 个模块，总时长 "), clock(total))
    lit = F.lit

    def cells(left: str, mid: str, right: str, *values: Column) -> Column:
        parts: list[Column] = [lit(left)]
        for i, v in enumerate(values):
            parts += [lit(mid), v] if i else [v]
        return F.concat(*parts, lit(right))

    row = (number, b("label"), span, secs, b("content_description"))
    if fmt == "markdown":
        top = [F.concat(lit("# "), title), lit(""), lit("| # | 类型 | 时间 | 时长 | 描述 |"), lit("|---|------|------|------|------|")]
        body = [cells("| ", " | ", " |", *row)]
        bottom = [lit(""), F.concat(lit("> "), summary)]
    elif fmt == "html":
        top = [lit("<!DOCTYPE html>"), F.concat(lit('<html lang="zh-CN"><head><meta charset="utf-8"><title>'), title,
                                                lit("</title></head>")),
               F.concat(lit("<body><h1>"), title, lit("</h1>")),
               lit("<table><thead><tr><th>#</th><th>类型</th><th>时间</th><th>时长</th><th>描述</th></tr></thead><tbody>")]
        body = [cells("<tr><td>", "</td><td>", "</td></tr>", *row)]
        bottom = [lit("</tbody></table>"), F.concat(lit('<p class="summary">'), summary, lit("</p>")), lit("</body></html>")]
    elif fmt == "srt":
        top, bottom = [], []
        body = [number, F.concat(srt_time(b("start_time")), lit(" --> "), srt_time(b("end_time"))), b("label"), lit("")]
    elif fmt == "plain":
        top, bottom = [], []
        body = [F.concat(number, lit(". ["), b("structure_type"), lit("] "), b("label"), lit(" ("), span, lit(", "), secs, lit(")")),
                F.concat(lit("    "), b("content_description")), lit("")]
    elif fmt == "json":
        meta = F.to_json(F.struct(title.alias("title"), total.alias("total_duration"), n.alias("block_count")))
        top = [F.concat(lit('{"version":"1.0.0","metadata":'), meta, lit(',"blocks":['))]
        fields = [c for c in blocks.columns if c != "script_id"]
        body = [F.concat(F.to_json(F.struct(*fields)), F.when(F.col("order") < n - 1, ",").otherwise(""))]
        bottom = [lit("]}")]
    else:
        raise ValueError(f"unknown format {fmt}")

    def numbered(rows: DataFrame, lines: list[Column], base: Column) -> DataFrame | None:
        if not lines:
            return None
        out = rows.select("script_id", base.alias("_b"), F.posexplode(F.array(*lines)).alias("_i", "line"))
        return out.select("script_id", (F.col("_b") + F.col("_i")).cast("long").alias("line_no"), "line")

    with_n = blocks.join(stats.select("script_id", "n"), KEY)
    parts = [numbered(heads, top, F.lit(0)), numbered(with_n, body, F.lit(len(top)) + F.col("order") * len(body)),
             numbered(heads, bottom, F.lit(len(top)) + n * len(body))]
    found = [p for p in parts if p is not None]
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Store numbered lines in order of script and line.

    Files hold ranges of scripts, so their number follows the size of the
    table, and the lines of one script are found by the statistics of the files.
    """
    spread = lines.repartitionByRange("script_id", "line_no").sortWithinPartitions("script_id", "line_no")
    spread.select("script_id", "line_no", "line").write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, script_id: object) -> DataFrame:
    """The text of one script, one row per line, in order."""
    own = spark.read.parquet(path).filter(F.col("script_id") == F.lit(script_id))
    return own.orderBy("line_no").select("line")


# The page around the timeline; $-names are filled in.
PAGE = """<!DOCTYPE html>
<html><head><meta charset="UTF-8"><title>$title</title></head>
<body><div class="canvas" style="width:${width}px;height:${height}px" data-fps="$fps" data-duration="$total_duration">
$tracks
$modules
</div></body></html>"""


def timeline_html(modules: DataFrame, scripts: DataFrame, tracks: DataFrame | None = None, template: str = PAGE) -> DataFrame:
    """Declarative timeline page as numbered lines: one ``div`` per track and per module.

    Tracks of scripts without any are derived from their modules.  ``scripts``
    has ``title, width, height, fps, total_duration``.
    """
    have = dict(modules.dtypes)
    derived = modules.select("script_id", F.coalesce("track_index", F.lit(0)).alias("index")).distinct().select(
        "script_id", "index", F.concat(F.lit("Track "), F.col("index").cast("string")).alias("name"), F.lit("video").alias("type"))
    if tracks is not None:
        derived = tracks.select("script_id", "index", "name", "type").unionByName(
            derived.join(tracks.select("script_id").distinct(), KEY, "left_anti"))

    def attr(name: str, value: Column, always: bool = False) -> Column:
        text = F.concat(F.lit(f'{name}="'), value.cast("string"), F.lit('"'))
        return text if always else F.when(F.coalesce(value, F.lit("")) != "", text)

    def inner(column: str, field: str) -> Column:
        known = have.get(column, "").startswith("struct") and f"{field}:" in have[column]
        return F.col(f"{column}.{field}") if known else F.lit(None).cast("string")

    words = inner("params", "text_content")
    attrs = F.concat_ws(
        " ", attr("data-module-id", F.col("id"), True), attr("data-type", F.col("type"), True),
        attr("data-start", F.coalesce("start_time", F.lit(0.0)), True), attr("data-duration", F.coalesce("duration", F.lit(0.0)), True),
        attr("data-track-index", F.coalesce("track_index", F.lit(0)), True), attr("data-label", F.col("label")),
        attr("data-source-path", inner("source", "path")), attr("data-text", words),
        attr("data-animation", inner("params", "animation")), attr("data-transition", inner("params", "transition_type")))
    shown = F.when(F.col("type").isin("title", "subtitle"), F.coalesce(words, F.lit(""))).otherwise("")
    module_lines = modules.select("script_id", F.lit(3).alias("section"), F.col("pos").alias("nr"), F.concat(
        F.lit("<div "), attrs, F.lit(">"), shown, F.lit("</div>")).alias("line"))
    track_lines = derived.select("script_id", F.lit(1).alias("section"), F.col("index").cast("long").alias("nr"), F.concat(
        F.lit('<div class="track" data-track-index="'), F.col("index").cast("string"), F.lit('" data-track-name="'),
        "name", F.lit('" data-track-type="'), "type", F.lit('"></div>')).alias("line"))

    before, rest = template.split("$tracks")
    between, after = rest.split("$modules")
    out = track_lines.unionByName(module_lines)
    for section, text in ((0, before), (2, between), (4, after)):
        line = F.lit(text.strip("\n"))
        for name in ("total_duration", "title", "width", "height", "fps"):
            value = F.col(name).cast("string")
            line = F.replace(F.replace(line, F.lit("${" + name + "}"), value), F.lit("$" + name), value)
        if text.strip("\n"):
            out = out.unionByName(scripts.select(
                "script_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("nr"), line.alias("line")))
    return out
