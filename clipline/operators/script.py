"""Edit scripts: repair, build, edit, validate and plan.

``modules`` holds one row per module with ``script_id`` and its list position
``pos`` (0, 1, 2, ... inside a script).  Edit requests are tables too, so one
job edits many scripts; ``edits`` has one row per script.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipline.constants import MODULE_TYPES, RENDER_TRANSITIONS, SOURCE_TYPES, TRACK_TYPES
from clipline.functions.expressions import fixed
from clipline.operators.ordered import islands, ordered
from clipline.operators.ranges import meeting, points_in_spans
from clipline.session import store

KEY = ["script_id"]
_RESOLUTION = "struct<width:int,height:int>"


def _with_edit(modules: DataFrame, edits: DataFrame, columns: Sequence[str]) -> DataFrame:
    wanted = edits.select("script_id", *[F.col(c).alias(f"_e_{c}") for c in columns], F.lit(True).alias("_edit"))
    return modules.join(wanted, KEY, "left")


def _anchors(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Position of the first module with the wanted id, per script."""
    wanted = edits.select("script_id", F.col("module_id").alias("id"))
    return modules.join(wanted, ["script_id", "id"]).groupBy("script_id").agg(F.min("pos").alias("_anchor"))


def _sizes(modules: DataFrame) -> DataFrame:
    return modules.groupBy("script_id").agg(F.count(F.lit(1)).alias("_size"))


def _shift(start: Column, by: Column) -> Column:
    return F.greatest(F.lit(0.0), start + by)


# -- build ----------------------------------------------------------------

def ensure_unique_ids(modules: DataFrame, prefix: str = "mod") -> DataFrame:
    """Blank or repeated ids become ``prefix_0001``, ``prefix_0002``, ... in list order.

    Numbers that a kept id of the same script already uses are skipped, so
    the result never repeats an id.
    """
    columns = modules.columns
    rows = modules.withColumn("_blank", F.coalesce(F.col("id") == "", F.lit(True)))
    firsts = rows.filter(~F.col("_blank")).groupBy("script_id", "id").agg(F.min("pos").alias("_first"))
    rows = rows.join(firsts.hint("merge"), ["script_id", "id"], "left")
    rows = rows.withColumn("_bad", F.coalesce(F.col("_blank") | (F.col("pos") > F.col("_first")), F.lit(True)))
    rows = ordered(rows, KEY, ["pos"], dense=True, running={"_nth": ("sum", F.col("_bad").cast("long"))})

    # The n-th free number is n plus the used numbers that have fewer than n
    # free numbers below them.
    number = F.expr(f"try_cast(regexp_extract(id, '^{prefix}_([0-9]{{4,}})$', 1) as bigint)")
    kept = firsts.filter(F.col("id").rlike(f"^{prefix}_[0-9]{{4,}}$")).withColumn("_u", number).filter(F.format_string(f"{prefix}_%04d", F.col("_u")) == F.col("id"))
    kept = store(kept.select("script_id", "_u"))
    if kept.isEmpty():
        fresh = F.format_string(f"{prefix}_%04d", F.col("_nth"))
        return rows.withColumn("id", F.when(F.col("_bad"), fresh).otherwise(F.col("id"))).select(*columns)
    rows, used = store(rows), kept.select("script_id").distinct()
    kept = ordered(kept, KEY, ["_u"], number="_j")
    marks = kept.select("script_id", (F.col("_u") - F.col("_j") - 1).alias("_at"), F.lit(1).alias("_used"),
                        F.col("_u").alias("pos"))
    asks = rows.filter("_bad").join(used, KEY, "left_semi").select("script_id", F.col("_nth").alias("_at"), F.lit(0).alias("_used"), "pos")
    skipped = ordered(marks.unionByName(asks), KEY, ["_at", "_used", "pos"],
                      running={"_skip": ("sum", F.col("_used"))})
    skipped = skipped.filter("_used = 0 and _skip > 0").select("script_id", "pos", "_skip")
    rows = rows.join(skipped, ["script_id", "pos"], "left")
    fresh = F.format_string(f"{prefix}_%04d", F.col("_nth") + F.coalesce("_skip", F.lit(0)))
    return rows.withColumn("id", F.when(F.col("_bad"), fresh).otherwise(F.col("id"))).select(*columns)


def build_scripts(scripts: DataFrame, *, version: str = "1.0.0") -> DataFrame:
    """Script rows with default metadata; modules and tracks stay their own tables.

    Known columns are kept, missing ones or nulls are filled.  ``created_at``
    defaults to the time of the query.
    """
    defaults: dict[str, tuple[str, Column]] = {
        "version": ("string", F.lit(version)),
        "title": ("string", F.lit("Untitled Project")), "description": ("string", F.lit("")),
        "author": ("string", F.lit("")), "created_at": ("timestamp", F.current_timestamp()),
        "total_duration": ("double", F.lit(0.0)), "source_video_id": ("string", F.lit("")),
        "fps": ("double", F.lit(30.0)),
        "resolution": (_RESOLUTION, F.struct(F.lit(1920).alias("width"), F.lit(1080).alias("height"))),
        "tags": ("array<string>", F.array().cast("array<string>")),
    }
    made = []
    for name, (kind, value) in defaults.items():
        given = F.col(name) if name in scripts.columns else F.lit(None)
        made.append(F.coalesce(given.cast(kind), value.cast(kind)).alias(name))
    return scripts.select("script_id", *made)


# -- edits ----------------------------------------------------------------

def add_modules(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Insert one new module per script.

    ``edits`` has the columns of a module, with ``pos`` as the wanted
    position: null or past the end appends, negative inserts first.
    """
    columns = modules.columns
    placed = (edits.join(_sizes(modules), KEY, "left")
              .withColumn("_size", F.coalesce("_size", F.lit(0)))
              .withColumn("pos", F.greatest(F.lit(0), F.least(
                  F.coalesce(F.col("pos"), F.col("_size")), F.col("_size"))).cast("long")))
    at = placed.select("script_id", F.col("pos").alias("_at"))
    moved = modules.join(at, KEY, "left").withColumn(
        "pos", F.when(F.col("pos") >= F.col("_at"), F.col("pos") + 1).otherwise(F.col("pos")))
    return moved.select(*columns).unionByName(placed.select(*columns))


def remove_modules(modules: DataFrame, edits: DataFrame, *, compact: bool = False) -> DataFrame:
    """Remove the modules with the wanted id and close the list.

    ``compact`` also moves later modules of the same track back by the
    duration of the (first) removed one, not below 0.
    """
    columns = modules.columns
    gone = edits.select("script_id", F.col("module_id").alias("id"), F.lit(1).alias("_gone"))
    marked = modules.join(gone, ["script_id", "id"], "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
    counted = ordered(marked, KEY, ["pos"], dense=True, running={"_before": ("sum", F.col("_gone"))})
    rest = counted.filter("_gone = 0").withColumn("pos", F.col("pos") - F.col("_before"))
    if compact:
        removed = marked.filter("_gone = 1").groupBy("script_id").agg(
            F.min_by(F.struct("track_index", "start_time", "duration"), "pos").alias("_r"))
        rest = rest.join(removed, KEY, "left").withColumn(
            "start_time",
            F.when((F.col("track_index") == F.col("_r.track_index")) & (F.col("start_time") > F.col("_r.start_time")),
                   _shift(F.col("start_time"), -F.col("_r.duration"))).otherwise(F.col("start_time")))
    return rest.select(*columns)


def _moved(modules: DataFrame, moves: DataFrame) -> DataFrame:
    """Move the module at ``_anchor`` to ``_to`` (positions after removal)."""
    pos, a, b = F.col("pos"), F.col("_anchor"), F.col("_to")
    new = (F.when(a.isNull(), pos).when(pos == a, b)
           .when((pos > a) & (pos <= b), pos - 1).when((pos < a) & (pos >= b), pos + 1).otherwise(pos))
    return modules.join(moves, KEY, "left").withColumn("pos", new.cast("long"))


def reorder(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Move a module to ``new_position`` of its list (clamped)."""
    moves = (_anchors(modules, edits).join(edits.select("script_id", "new_position"), KEY).join(_sizes(modules), KEY)
             .select("script_id", "_anchor",
                     F.greatest(F.lit(0), F.least("new_position", F.col("_size") - 1)).alias("_to")))
    return _moved(modules, moves).select(*modules.columns)


def move_to_track(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Move a module to ``to_track``, before the track's ``insert_index``-th other module (else to the end)."""
    anchors = _anchors(modules, edits).join(edits.select("script_id", "to_track", "insert_index"), KEY)
    others = (modules.select("script_id", "pos", "track_index").join(anchors, KEY)
              .filter((F.col("track_index") == F.col("to_track")) & (F.col("pos") != F.col("_anchor"))))
    placed = ordered(others, KEY, ["pos"], dense=True, number="_nth").filter(F.col("_nth") == F.col("insert_index"))
    target = placed.select("script_id", (F.col("pos") - F.when(F.col("pos") > F.col("_anchor"), 1).otherwise(0))
                           .alias("_before"))
    moves = (anchors.join(target, KEY, "left").join(_sizes(modules), KEY)
             .select("script_id", "_anchor", "to_track", F.coalesce("_before", F.col("_size") - 1).alias("_to")))
    moved = _moved(modules.withColumn("_old", F.col("pos")), moves)
    return moved.withColumn(
        "track_index", F.when(F.col("_old") == F.col("_anchor"), F.col("to_track"))
        .otherwise(F.col("track_index"))).select(*modules.columns)


def update_param(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Set a dotted path of the first module with the id.

    ``edits`` has ``module_id, path, value`` with the value as text.  A path
    names a column, a field of a struct column or a key of a map column.
    """
    anchors = _anchors(modules, edits).join(
        edits.select("script_id", F.col("path").alias("_path"), F.col("value").alias("_value")), KEY)
    rows = modules.join(anchors, KEY, "left").withColumn(
        "_hit", F.coalesce(F.col("pos") == F.col("_anchor"), F.lit(False)))
    out = []
    for field in modules.schema.fields:
        old, name = F.col(field.name), field.name
        if name in ("script_id", "pos"):
            out.append(old)
        elif isinstance(field.dataType, T.StructType):
            changed = old
            for inner in field.dataType.fields:
                here = F.col("_hit") & (F.col("_path") == f"{name}.{inner.name}")
                changed = changed.withField(inner.name, F.when(here, F.col("_value").cast(inner.dataType)).otherwise(
                    old[inner.name]))
            touched = F.col("_hit") & F.col("_path").startswith(f"{name}.")
            filled = F.struct(*[
                F.when(F.col("_path") == f"{name}.{i.name}", F.col("_value").cast(i.dataType)).alias(i.name)
                for i in field.dataType.fields])
            out.append(F.when(touched & old.isNull(), filled).when(touched, changed)
                       .otherwise(old).alias(name))
        elif isinstance(field.dataType, T.MapType):
            key = F.substring_index(F.col("_path"), f"{name}.", -1)
            here = F.col("_hit") & F.col("_path").startswith(f"{name}.")
            kept = F.map_filter(F.coalesce(old, F.create_map().cast(field.dataType)), lambda k, v: k != key)
            out.append(F.when(here, F.map_concat(kept, F.create_map(
                key, F.col("_value").cast(field.dataType.valueType)))).otherwise(old).alias(name))
        elif isinstance(field.dataType, T.ArrayType):
            out.append(old)
        else:
            here = F.col("_hit") & (F.col("_path") == name)
            out.append(F.when(here, F.col("_value").cast(field.dataType)).otherwise(old).alias(name))
    return rows.select(*out)


def duplicate(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Copy a module to the place right after it, ``time_offset`` later.

    ``new_id`` may be null; then the id is derived from the script, the
    position and the start time, so reruns agree.
    """
    columns = modules.columns
    wanted = _anchors(modules, edits).join(edits.select("script_id", "new_id", "time_offset"), KEY)
    made = F.concat(F.lit("mod_"), F.substring(F.sha2(F.concat_ws(
        "|", F.col("script_id").cast("string"), F.col("pos").cast("string"), F.col("start_time").cast("string")),
        256), 1, 8))
    copies = (modules.join(wanted, KEY).filter(F.col("pos") == F.col("_anchor"))
              .withColumn("id", F.coalesce("new_id", made))
              .withColumn("start_time", _shift(F.col("start_time"), F.coalesce("time_offset", F.lit(0.0))))
              .withColumn("pos", F.col("pos") + 1))
    rest = modules.join(wanted.select("script_id", "_anchor"), KEY, "left").withColumn(
        "pos", F.when(F.col("pos") > F.col("_anchor"), F.col("pos") + 1).otherwise(F.col("pos")))
    return rest.select(*columns).unionByName(copies.select(*columns))


def shift_all(modules: DataFrame, offset: float | Column) -> DataFrame:
    """Shift every start time, not below 0."""
    by = offset if isinstance(offset, Column) else F.lit(float(offset))
    return modules.withColumn("start_time", _shift(F.col("start_time"), by))


def shift_after(modules: DataFrame, edits: DataFrame) -> DataFrame:
    """Shift the modules that follow ``module_id`` in list order by ``offset``."""
    anchors = _anchors(modules, edits).join(edits.select("script_id", F.col("offset").alias("_by")), KEY)
    return modules.join(anchors, KEY, "left").withColumn(
        "start_time", F.when(F.col("pos") > F.col("_anchor"), _shift(F.col("start_time"), F.col("_by")))
        .otherwise(F.col("start_time"))).select(*modules.columns)


def compact(modules: DataFrame) -> DataFrame:
    """Lay the modules of each track end to end, in start order, from 0."""
    laid = ordered(modules.withColumn("_start", F.col("start_time")), ["script_id", "track_index"],
                   ["_start", "pos"], before={"_from": ("sum", F.col("duration"))})
    return laid.withColumn("start_time", F.coalesce("_from", F.lit(0.0))).select(*modules.columns)


# -- validation -----------------------------------------------------------

_ISSUE = ["script_id", "rule", "severity", "message", "path", "module_id", "module_index", "track_index"]


def _issues(df: DataFrame, rule: str, severity: Column | str, message: Column, path: Column,
            module_id: Column | None = None, module_index: Column | None = None,
            track_index: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "script_id", F.lit(rule).alias("rule"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        message.alias("message"), path.alias("path"),
        (none if module_id is None else module_id).cast("string").alias("module_id"),
        (none if module_index is None else module_index).cast("long").alias("module_index"),
        (none if track_index is None else track_index).cast("long").alias("track_index"))


def validate_schema(scripts: DataFrame, modules: DataFrame, tracks: DataFrame | None = None, *,
                    variant: str = "strict") -> DataFrame:
    """Schema violations as issue rows: required fields, enums, minima, version form, at least one module.

    ``variant='extended'`` also accepts the module type ``content`` that the
    analysis emits.
    """
    types = MODULE_TYPES + (["content"] if variant == "extended" else [])

    def rule_rows(df: DataFrame, checks: list[tuple[Column, Column, Column]], module: bool) -> DataFrame:
        found = F.array_compact(F.array(*[
            F.when(F.coalesce(bad, F.lit(True)), F.struct(msg.alias("m"), path.alias("p"))) for bad, msg, path in checks]))
        rows = df.withColumn("_i", F.explode(found))
        ids = (F.col("id"), F.col("pos")) if module else (None, None)
        return _issues(rows, "schema", "error", F.col("_i.m"), F.col("_i.p"), *ids)

    def field(df: DataFrame, name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    script_checks: list[tuple[Column, Column, Column]] = []
    for name in ("version", "title", "created_at", "total_duration"):
        if name in scripts.columns:
            path = name if name == "version" else "metadata"
            script_checks.append((field(scripts, name).isNull(), F.lit(f"'{name}' is a required property"), F.lit(path)))
    if "version" in scripts.columns:
        script_checks.append((F.col("version").isNotNull() & ~F.col("version").rlike(r"^\d+\.\d+\.\d+$"),
                              F.lit("version is not a semantic version"), F.lit("version")))
    for name, low in (("total_duration", 0), ("fps", 1)):
        if name in scripts.columns:
            script_checks.append((F.col(name).isNotNull() & (F.col(name) < low),
                                  F.lit(f"{name} is less than the minimum of {low}"), F.lit(f"metadata.{name}")))
    if "resolution" in scripts.columns:
        for side in ("width", "height"):
            value = F.col(f"resolution.{side}")
            script_checks.append((value.isNotNull() & (value < 1), F.lit(f"{side} is less than the minimum of 1"),
                                  F.lit(f"metadata.resolution.{side}")))
    out = rule_rows(scripts, script_checks, False) if script_checks else None
    empty = scripts.join(modules.select("script_id").distinct().hint("merge"), KEY, "left_anti")
    empty = _issues(empty, "schema", "error", F.lit("modules should be non-empty"), F.lit("modules"))
    out = empty if out is None else out.unionByName(empty)

    at = F.concat(F.lit("modules."), F.col("pos").cast("string"))
    checks: list[tuple[Column, Column, Column]] = []
    for name in ("id", "type", "start_time", "duration", "track_index"):
        checks.append((field(modules, name).isNull(), F.lit(f"'{name}' is a required property"), at))
    checks.append((F.col("type").isNotNull() & ~F.col("type").isin(*types),
                   F.concat(F.lit("'"), F.col("type"), F.lit("' is not an allowed module type")),
                   F.concat(at, F.lit(".type"))))
    for name in ("start_time", "duration", "track_index"):
        checks.append((F.col(name).isNotNull() & (F.col(name) < 0),
                       F.lit(f"{name} is less than the minimum of 0"), F.concat(at, F.lit(f".{name}"))))
    kinds = dict(modules.dtypes)
    if kinds.get("source", "").startswith("struct") and "type:" in kinds["source"]:
        checks.append((F.col("source.type").isNotNull() & ~F.col("source.type").isin(*SOURCE_TYPES),
                       F.lit("source.type is not allowed"), F.concat(at, F.lit(".source.type"))))
    if kinds.get("params", "").startswith("struct") and "volume:" in kinds["params"]:
        volume = F.col("params.volume")
        checks.append((volume.isNotNull() & ((volume < 0) | (volume > 1)), F.lit("volume is outside 0 to 1"),
                       F.concat(at, F.lit(".params.volume"))))
    out = out.unionByName(rule_rows(modules, checks, True))

    if tracks is not None and {"name", "type"} <= set(tracks.columns):
        at = F.concat(F.lit("tracks."), F.col("index").cast("string"))
        checks = [(F.col(n).isNull(), F.lit(f"'{n}' is a required property"), at) for n in ("index", "name", "type")]
        checks.append((F.col("index").isNotNull() & (F.col("index") < 0),
                       F.lit("index is less than the minimum of 0"), at))
        checks.append((F.col("type").isNotNull() & ~F.col("type").isin(*TRACK_TYPES),
                       F.lit("track type is not allowed"), F.concat(at, F.lit(".type"))))
        out = out.unionByName(rule_rows(tracks, checks, False))
    return out


def _last_index(modules: DataFrame) -> DataFrame:
    """Index that an id resolves to: its last position in the list."""
    return modules.groupBy("script_id", "id").agg(F.max("pos").alias("_index"))


def _name(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("'"), F.coalesce(column.cast("string"), F.lit("None")), F.lit("'"))


def _track(text: Column) -> Column:
    return F.concat(F.lit("Track "), F.col("track_index").cast("string"), F.lit(": "), text)


def check_continuity(modules: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Gaps (warning) and overlaps (error) between consecutive modules of a track."""
    near = ordered(modules, ["script_id", "track_index"], ["start_time", "pos"],
                   lead={"_next_start": F.col("start_time"), "_next_id": F.col("id")})
    delta = F.col("_next_start") - (F.col("start_time") + F.col("duration"))
    off = near.withColumn("_delta", delta).filter(F.abs("_delta") > tolerance)
    off = off.join(_last_index(modules).hint("merge"), ["script_id", "id"], "left")
    overlap = F.col("_delta") < 0
    detail = F.concat(
        F.when(overlap, F.lit("overlap of ")).otherwise(F.lit("gap of ")),
        fixed(F.abs(F.col("_delta")), 2), F.lit("s between "), _name("id"), F.lit(" and "), _name("_next_id"))
    return _issues(off, "continuity", F.when(overlap, "error").otherwise("warning"), _track(detail),
                   F.concat(F.lit("modules."), F.col("id")), F.col("id"), F.col("_index"), F.col("track_index"))


def check_overlaps(modules: DataFrame, *, bucket: float = 30.0, stored: bool = False) -> DataFrame:
    """Every pair of overlapping modules on a track, reported at the earlier list position.

    Modules meet in time buckets; only pairs that do overlap leave the join.
    A module without length overlaps the ones it lies strictly inside.
    ``stored`` modules are cheap to read and make fewer copies (``ranges.meeting``).
    """
    rows = modules.select("script_id", "track_index", "pos", "id", F.col("start_time").alias("s"),
                          (F.col("start_time") + F.col("duration")).alias("e"))
    other = rows.select("script_id", "track_index", *[F.col(c).alias(f"o_{c}") for c in ("pos", "id", "s", "e")])
    pairs = meeting(rows, other, ["script_id", "track_index"], ("s", "e"), ("o_s", "o_e"), bucket=bucket,
                    stored=stored).filter(
        (F.col("pos") < F.col("o_pos")) & (F.col("s") < F.col("o_e")) & (F.col("o_s") < F.col("e")))
    pairs = pairs.join(_last_index(modules).hint("merge"), ["script_id", "id"], "left")
    text = _track(F.concat(F.lit("overlap between "), _name("id"), F.lit(" and "), _name("o_id")))
    return _issues(pairs, "overlap", "error", text, F.concat(F.lit("modules."), F.col("id")), F.col("id"),
                   F.col("_index"), F.col("track_index"))


def check_tracks(modules: DataFrame, tracks: DataFrame) -> DataFrame:
    """Modules on undefined tracks; a script without any track has track 0."""
    known = tracks.filter(F.col("index").isNotNull()).select("script_id", F.col("index").cast("long").alias("track_index"))
    bare = (modules.select("script_id").distinct().join(known.select("script_id").distinct().hint("merge"), KEY, "left_anti")
            .withColumn("track_index", F.lit(0).cast("long")))
    lost = modules.filter(F.col("track_index").isNotNull()).join(
        known.unionByName(bare).hint("merge"), ["script_id", "track_index"], "left_anti")
    lost = lost.join(_last_index(modules).hint("merge"), ["script_id", "id"], "left")
    text = F.concat(F.lit("Module "), _name("id"), F.lit(" references undefined track "),
                    F.col("track_index").cast("string"))
    return _issues(lost, "track", "warning", text, F.concat(F.lit("modules."), F.col("id"), F.lit(".track_index")),
                   F.col("id"), F.col("_index"), F.col("track_index"))


def check_duration(scripts: DataFrame, modules: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Scripts whose declared duration differs from the end of the last module."""
    ends = modules.groupBy("script_id").agg(F.max(F.col("start_time") + F.col("duration")).alias("_end"))
    declared = F.coalesce(F.col("total_duration"), F.lit(0.0))
    off = scripts.join(ends.hint("merge"), KEY).filter(F.abs(F.col("_end") - declared) > tolerance)
    text = F.concat(F.lit("Declared total_duration ("), fixed(declared, 1),
                    F.lit("s) differs from actual timeline end ("), fixed(F.col("_end"), 1), F.lit("s)"))
    return _issues(off, "duration", "warning", text, F.lit("metadata.total_duration"))


def check_duplicate_ids(modules: DataFrame) -> DataFrame:
    """Modules that repeat the id of an earlier one."""
    firsts = modules.groupBy("script_id", "id").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = (modules.join(firsts.filter("_n > 1").hint("merge"), ["script_id", "id"]).filter(F.col("pos") > F.col("_first")))
    text = F.concat(F.lit("Duplicate module id "), _name("id"), F.lit(" at indices "),
                    F.col("_first").cast("string"), F.lit(" and "), F.col("pos").cast("string"))
    path = F.concat(F.lit("modules["), F.col("pos").cast("string"), F.lit("].id"))
    return _issues(again, "duplicate_id", "error", text, path, F.col("id"), F.col("pos"))


def validate(scripts: DataFrame, modules: DataFrame, tracks: DataFrame, *, variant: str = "strict",
             columns: Sequence[str] = _ISSUE) -> DataFrame:
    """All issues; scripts with schema errors get only those.

    The issues of each check (of which ``columns`` are kept) are stored when it is done, so that shuffle files of one
    check at a time are on disk.
    """
    schema = store(validate_schema(scripts, modules, tracks, variant=variant).select(*columns))
    broken = schema.select("script_id").distinct()
    m, t, s = (df.join(broken.hint("merge"), KEY, "left_anti") for df in (modules, tracks, scripts))
    m = store(m)  # the checks read it more than ten times
    out = schema
    for part in (check_continuity(m), check_overlaps(m, stored=True), check_tracks(m, t), check_duration(s, m),
                 check_duplicate_ids(m)):
        out = out.unionByName(store(part.select(*columns)))
    return out


def is_valid(scripts: DataFrame, issues: DataFrame) -> DataFrame:
    """A script is valid when no issue of severity error names it."""
    wrong = issues.groupBy("script_id").agg(F.bool_or(F.col("severity") == "error").alias("_wrong"))
    return scripts.select("script_id").join(wrong, KEY, "left").select(
        "script_id", (~F.coalesce("_wrong", F.lit(False))).alias("is_valid"))


# -- views and plans ------------------------------------------------------

def merge_pairs(modules: DataFrame) -> DataFrame:
    """Collapse neighbours with equal start, duration and detail, two at a time from the left.

    The first module of a pair stays; ``merged_types`` lists the types in it.
    """
    def together(a: Column, b: Column) -> Column:
        return (a["s"].eqNullSafe(b["s"])) & (a["d"].eqNullSafe(b["d"])) & (a["x"].eqNullSafe(b["x"]))

    runs = islands(modules, KEY, ["pos"], dense=True, together=together, values={
        "s": F.col("start_time"), "d": F.col("duration"), "x": F.col("detail")})
    starts = runs.groupBy("script_id", "island").agg(F.min("pos").alias("_from"))
    paired = runs.join(starts, ["script_id", "island"]).withColumn(
        "_pair", F.floor((F.col("pos") - F.col("_from")) / 2))
    kept = [c for c in modules.columns if c != "script_id"]
    out = paired.groupBy("script_id", "island", "_pair").agg(
        F.min(F.struct("pos", *[c for c in kept if c != "pos"])).alias("_m"), F.max(F.struct("pos", "type")).alias("_l"))
    types = F.when(F.col("_l.pos") > F.col("_m.pos"), F.array("_m.type", "_l.type")).otherwise(F.array("_m.type"))
    return out.select("script_id", *[F.col(f"_m.{c}").alias(c) for c in kept], types.alias("merged_types"))


def by_track(modules: DataFrame) -> DataFrame:
    """Modules numbered in start order inside their track."""
    rows = modules.withColumn("track_index", F.coalesce("track_index", F.lit(0)))
    return ordered(rows, ["script_id", "track_index"], ["start_time", "pos"], number="track_pos")


def total_duration(scripts: DataFrame, modules: DataFrame, default: float = 60.0) -> DataFrame:
    """End of the last module; ``default`` for scripts without modules."""
    ends = modules.groupBy("script_id").agg(F.max(F.col("start_time") + F.col("duration")).alias("_end"))
    return scripts.select("script_id").join(ends, KEY, "left").select(
        "script_id", F.coalesce("_end", F.lit(float(default))).alias("total_duration"))


def _module_text(modules: DataFrame) -> Column:
    kinds = dict(modules.dtypes)
    options = []
    if kinds.get("params", "").startswith("struct") and "text_content:" in kinds["params"]:
        options.append(F.nullif(F.col("params.text_content"), F.lit("")))
    if "label" in kinds:
        options.append(F.nullif(F.col("label"), F.lit("")))
    return F.coalesce(*options, F.lit(""))


def replace_text(modules: DataFrame, pattern: str, replacement: str, *, regex: bool = False,
                 module_type: str | None = None) -> DataFrame:
    """Replace text in modules; adds ``text`` (the new text) and ``text_changed``.

    The text of a module is its text content, else its label.  A literal
    pattern is quoted; in regex mode the replacement may use ``$1``.
    """
    text = _module_text(modules)
    quoted = pattern if regex else r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    target = replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    wanted = F.lit(True) if module_type is None else F.col("type") == module_type
    new = F.when(wanted & (text != ""), F.regexp_replace(text, F.lit(quoted), F.lit(target))).otherwise(text)
    out = modules.withColumn("text", new).withColumn("text_changed", new != text)
    if "params" in modules.columns and isinstance(modules.schema["params"].dataType, T.StructType):
        out = out.withColumn("params", F.when(F.col("text_changed"), F.col("params").withField(
            "text_content", F.col("text"))).otherwise(F.col("params")))
    return out


def match_count(modules: DataFrame, pattern: str, *, regex: bool = False, module_type: str | None = None) -> DataFrame:
    """Number of modules whose text holds the pattern, per script."""
    quoted = pattern if regex else r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    wanted = F.lit(True) if module_type is None else F.col("type") == module_type
    return modules.groupBy("script_id").agg(
        F.count_if(wanted & _module_text(modules).rlike(quoted)).alias("matches"))


def snap(points: DataFrame, modules: DataFrame, tolerance: float) -> DataFrame:
    """Snap points ``(script_id, point_id, at)`` to a module edge closer than ``tolerance``.

    The first module in start order with an edge in reach decides, its end
    before its start; other points keep their time.
    """
    tol = F.lit(float(tolerance))
    end = F.col("start_time") + F.col("duration")
    edges = modules.select("script_id", "start_time", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), end.alias("edge")),
        F.struct(F.lit(1).alias("side"), F.col("start_time").alias("edge")))).alias("_x"))
    edges = edges.select("script_id", "start_time", "pos", "_x.side", "_x.edge")
    reach = points.select("script_id", "point_id", "at", (F.col("at") - tol).alias("_lo"), (F.col("at") + tol).alias("_hi"))
    hits = points_in_spans(edges, reach, KEY, "edge", "_lo", "_hi", bucket=max(float(tolerance), 0.5))
    hits = hits.filter(F.abs(F.col("at") - F.col("edge")) < tol)
    best = hits.groupBy("script_id", "point_id").agg(
        F.min(F.struct("start_time", "pos", "side", "edge"))["edge"].alias("_edge"))
    return points.join(best, ["script_id", "point_id"], "left").withColumn(
        "snapped", F.coalesce("_edge", "at")).drop("_edge")


def _clip_gaps(clips: DataFrame) -> DataFrame:
    rows = ordered(clips, KEY, ["start_time", "pos"], number="gap_idx", lead={"_next": F.col("start_time")})
    return rows.filter(F.col("_next").isNotNull()).select(
        "script_id", "gap_idx", ((F.col("start_time") + F.col("duration") + F.col("_next")) / 2).alias("_mid"))


def attach_transitions(clips: DataFrame, transitions: DataFrame, *, reach: float = 1.0) -> DataFrame:
    """Transition per gap between neighbouring clips.

    A transition goes to the first gap whose middle lies within ``reach``;
    of several for one gap the last in list order counts.
    """
    gaps = _clip_gaps(clips).withColumn("_lo", F.col("_mid") - reach).withColumn("_hi", F.col("_mid") + reach)
    marks = transitions.select("script_id", F.col("pos").alias("_pos"), F.col("start_time").alias("_at"),
                               F.coalesce("transition_type", F.lit("fade")).alias("_type"))
    hits = points_in_spans(marks, gaps, KEY, "_at", "_lo", "_hi", bucket=2.0 * reach)
    hits = hits.filter(F.abs(F.col("_at") - F.col("_mid")) < reach)
    firsts = hits.groupBy("script_id", "_pos", "_type").agg(F.min("gap_idx").alias("gap_idx"))
    found = firsts.groupBy("script_id", "gap_idx").agg(F.max_by("_type", "_pos").alias("transition_type"))
    names = F.create_map(*[F.lit(x) for pair in RENDER_TRANSITIONS.items() for x in pair])
    return found.withColumn("renderer", F.coalesce(F.try_element_at(names, F.lower("transition_type")), F.lit("fade")))


def edit_list(modules: DataFrame, *, sourced: Column | None = None) -> DataFrame:
    """Clips of the primary track in start order, numbered from 0.

    The primary track is the smallest one with a sourced video segment, else
    track 0; video segments, titles and subtitles with a length are clips.
    """
    has_source = F.lit(True) if sourced is None else sourced
    tracks = modules.groupBy("script_id").agg(F.coalesce(F.min(F.when(
        (F.col("type") == "video_segment") & has_source, F.coalesce("track_index", F.lit(0)))), F.lit(0)).alias("_primary"))
    clips = modules.join(tracks, KEY).filter(
        (F.col("track_index") == F.col("_primary")) & F.col("type").isin("video_segment", "title", "subtitle")
        & (F.col("duration") > 0))
    return ordered(clips.drop("_primary"), KEY, ["start_time", "pos"], number="clip_idx")


def crossfade_offsets(clips: DataFrame, fade: float) -> DataFrame:
    """Start of the cross-fade into every clip but the first: earlier durations less one fade each."""
    rows = ordered(clips, KEY, ["clip_idx"], dense=True,
                   before={"offset_s": ("sum", F.col("duration") - F.lit(float(fade)))})
    return rows.filter(F.col("clip_idx") > 0)


def padding(clips: DataFrame, scripts: DataFrame) -> DataFrame:
    """Black seconds to append: missing time when the target is over half a second longer."""
    actual = clips.groupBy("script_id").agg(F.sum("duration").alias("_actual"))
    target, got = F.col("total_duration"), F.col("_actual")
    return scripts.join(actual, KEY).select(
        "script_id", F.when((got > 0) & (target > got + 0.5), target - got).otherwise(0.0).alias("pad_s"))


def merge_metadata(uploaded: DataFrame, analysed: DataFrame) -> DataFrame:
    """Upload metadata first, field by field; 0 and blank count as missing."""
    fields = {"title": "string", "fps": "double", "total_duration": "double", "width": "int", "height": "int"}
    u, a = uploaded.alias("u"), analysed.alias("a")
    joined = a.join(u, KEY, "left")
    out = []
    for name, kind in fields.items():
        blank = F.lit("") if kind == "string" else F.lit(0).cast(kind)
        out.append(F.coalesce(F.nullif(F.col(f"u.{name}"), blank), F.col(f"a.{name}")).alias(name))
    return joined.select("script_id", *out)


def slot_shares(modules: DataFrame, scripts: DataFrame, overrides: DataFrame, removed: DataFrame) -> DataFrame:
    """Start and width of every slot in percent of the script, and its status.

    ``overrides`` (script_id, pos, status) replaces the status ``filled``;
    slots in ``removed`` (script_id, pos) are left out.  Percent are rounded
    half up and the width is at least 1.
    """
    total = F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)

    def percent(x: Column) -> Column:
        return F.floor(x / total * 100 + 0.5).cast("long")

    rows = (modules.join(removed.select("script_id", "pos"), ["script_id", "pos"], "left_anti")
            .join(scripts.select("script_id", F.col("total_duration").alias("_total")), KEY, "left")
            .join(overrides.select("script_id", "pos", F.col("status").alias("_status")), ["script_id", "pos"], "left"))
    end = F.col("start_time") + F.col("duration")
    return rows.select(
        "script_id", "pos", "label", percent(F.col("start_time")).alias("start_percent"),
        F.greatest(F.lit(1).cast("long"), percent(end - F.col("start_time"))).alias("width_percent"),
        F.coalesce("_status", F.lit("filled")).alias("status"))


def slot_coverage(slots: DataFrame) -> DataFrame:
    """Filled and open slots per script and the share of filled ones in percent."""
    counts = slots.groupBy("script_id").agg(
        F.count_if(F.col("status") == "filled").alias("filled"),
        F.count_if(F.col("status").isin("gap", "fallback")).alias("gaps"), F.count(F.lit(1)).alias("slots"))
    return counts.withColumn(
        "coverage_percent", F.floor(F.col("filled") / F.col("slots") * 100 + 0.5).cast("long"))

