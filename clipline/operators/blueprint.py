"""Templates, composed scripts and material gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipline.constants import GAP_DEFAULTS, MODULE_TYPES, SLOT_WORDS, TEMPLATES, TYPE_TEMPLATES
from clipline.operators.ordered import ordered
from clipline.session import store

KEY = ["script_id"]
_SLOT = "template string, slot_idx int, name string, key string, default_dur double, required boolean"


def template_slots(spark: SparkSession) -> DataFrame:
    """Slots of the built-in templates in order (27 rows)."""
    rows = [(t, i, name, key, dur, need) for t, slots in TEMPLATES.items()
            for i, (name, key, dur, need) in enumerate(slots)]
    return spark.createDataFrame(rows, _SLOT)


def slot_words(spark: SparkSession) -> DataFrame:
    """Words per slot key, as one array per key."""
    return spark.createDataFrame(list(SLOT_WORDS.items()), "key string, words array<string>")


# -- composed scripts -----------------------------------------------------

def compose_blocks(modules: DataFrame, *, distinct_parts: bool = False) -> DataFrame:
    """Script block of every module: template, description, times and parameters.

    Needs the detail columns ``voice_content, motion, color_tone, bgm_type``
    and ``content_tags``; ``original_start``/``original_end``, ``source`` and
    ``params`` are used where present.
    """
    have = set(modules.columns)
    entries = F.create_map(*[x for k, (label, desc, kind, layout, anim) in TYPE_TEMPLATES.items() for x in (
        F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(desc).alias("description"), F.lit(kind).alias("kind"),
                           F.lit(layout).alias("layout"), F.lit(anim).cast("string").alias("animation")))])
    rows = modules.withColumn("_t", F.coalesce(F.try_element_at(entries, F.col("type")), entries["video_segment"]))

    def part(prefix: str, name: str, *skip: str) -> Column:
        value = F.trim(F.col(name)) if name == "voice_content" else F.col(name)
        return F.when((value != "") & ~value.isin(*skip), F.concat(F.lit(prefix), value))

    tags = F.when(F.size("content_tags") > 0, F.array_join(F.slice("content_tags", 1, 3), " · "))
    parts = F.array_compact(F.array(
        tags, part("配音: ", "voice_content", "无"), part("运镜: ", "motion", "无"), part("色调: ", "color_tone", "未知"),
        part("背景乐: ", "bgm_type", "无", "未知")))
    if distinct_parts:
        parts = F.array_distinct(parts)
    end = F.col("start_time") + F.col("duration")
    segment = F.col("type") == "video_segment"

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    path = F.col("source.path") if "source" in have else F.lit(None).cast("string")
    change = F.col("params.transition_type") if "params" in have else F.lit(None).cast("string")
    return rows.select(
        "script_id", F.col("pos").alias("order"), F.col("id").alias("module_id"), F.col("type").alias("module_type"),
        F.col("_t.kind").alias("structure_type"), F.round("start_time", 2).alias("start_time"),
        F.round(end, 2).alias("end_time"), F.round("duration", 2).alias("duration"),
        F.coalesce("label", F.col("_t.label")).alias("label"), "content_tags",
        F.coalesce(F.nullif(F.array_join(parts, "；"), F.lit("")), F.col("_t.description")).alias("content_description"),
        F.struct(
            F.col("_t.layout").alias("layout"), F.col("_t.animation").alias("animation"),
            F.when(F.col("type") == "title", F.col("label")).alias("text"),
            F.when(segment, F.coalesce(optional("original_start", "double"), F.col("start_time"))).alias("source_start"),
            F.when(segment, F.coalesce(optional("original_end", "double"), end)).alias("source_end"),
            F.when(segment, F.coalesce(path, F.lit(""))).alias("source_path"),
            change.alias("transition_type")).alias("template_params"))


def compose_tracks(blocks: DataFrame) -> DataFrame:
    """Tracks of a composed script: the module types that occur, numbered in fixed order."""
    present = blocks.filter(F.col("module_type").isin(*MODULE_TYPES)).groupBy("script_id", "module_type").agg(
        F.count(F.lit(1)).alias("n_blocks"))
    order = F.create_map(*[x for i, t in enumerate(MODULE_TYPES) for x in (F.lit(t), F.lit(i))])
    # At most six rows per script.
    rank = F.row_number().over(Window.partitionBy("script_id").orderBy(order[F.col("module_type")])) - 1
    return present.withColumn("index", rank)


def compose_summary(blocks: DataFrame) -> DataFrame:
    """Blocks per structure type, their number and the end of the last block in list order."""
    kinds = blocks.groupBy("script_id", "structure_type").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("order", "end_time")).alias("_last"))
    return kinds.groupBy("script_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("structure_type", "_n")))).alias("structure_summary"),
        F.sum("_n").alias("block_count"), F.max("_last")["end_time"].alias("total_duration"))


def light_modules(modules: DataFrame) -> DataFrame:
    """Modules without their detail; tags stay."""
    return modules.drop("detail", "voice_content", "motion", "color_tone", "bgm_type")


# -- matching -------------------------------------------------------------

def match_scores(slots: DataFrame, modules: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Score of every (slot, module) of a script with at least one matching word.

    ``slots`` has (script_id, slot_idx, key); ``modules`` has ``texts``, the
    array of sub-type, labels and tags.  A word counts once however many texts
    hold it.

    Every module looks at each word of the rule table once, whatever slots its
    script has; only the keys it matches then meet the slots, by script and key.
    """
    words = slot_words(slots.sparkSession) if words is None else words
    rules = words.agg(F.collect_list(F.struct("key", F.transform("words", F.lower).alias("words"))).alias("rules"))
    seen = modules.select("script_id", "pos", F.transform("texts", F.lower).alias("_t")).withColumn("_rules", rules.scalar())

    def score(rule: Column) -> Column:
        hit = F.filter(rule["words"], lambda w: F.exists("_t", lambda t: t.contains(w)))
        return F.struct(rule["key"].alias("key"), F.size(hit).alias("score"))

    found = F.filter(F.transform("_rules", score), lambda k: k["score"] >= 1)
    matched = seen.select("script_id", "pos", F.explode(found).alias("_k")).select(
        "script_id", "pos", "_k.key", "_k.score")
    return slots.select("script_id", "slot_idx", "key").join(matched.hint("merge"), ["script_id", "key"]).select(
        "script_id", "slot_idx", "pos", "score")


def assign_slots(scores: DataFrame, slots_per_script: int) -> DataFrame:
    """Greedy assignment: slots in order take the best module that is still free; ties go to the first.

    Earlier slots can use up at most ``slots_per_script - 1`` modules, so only
    that many candidates of a slot, best first, can ever matter.  The few
    candidates of a script are then walked in slot order.
    """
    rank = F.row_number().over(Window.partitionBy("script_id", "slot_idx").orderBy(F.desc("score"), "pos"))
    best = scores.withColumn("_rank", rank).filter(F.col("_rank") <= slots_per_script)
    lists = best.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct(
        "slot_idx", "_rank", "pos", "score"))).alias("_all"))
    kind = "array<struct<slot_idx:int,pos:bigint,score:int>>"

    def take(done: Column, c: Column) -> Column:
        busy = F.exists(done, lambda x: (x["slot_idx"] == c["slot_idx"]) | (x["pos"] == c["pos"]))
        entry = F.array(F.struct(c["slot_idx"].cast("int").alias("slot_idx"), c["pos"].cast("long").alias("pos"),
                                 c["score"].cast("int").alias("score")))
        return F.when(busy, done).otherwise(F.concat(done, entry))

    taken = lists.select("script_id", F.explode(F.aggregate("_all", F.array().cast(kind), take)).alias("_a"))
    return taken.select("script_id", "_a.*")


def merge_blueprint(scripts: DataFrame, modules: DataFrame, slots: DataFrame | None = None,
                    words: DataFrame | None = None) -> DataFrame:
    """Blocks of a blueprint: matched and missing slots, then the other modules, laid end to end.

    ``scripts`` has (script_id, template); ``modules`` has ``texts``.  The
    template ``none`` passes every module through at its own time.
    """
    built_in = slots is None
    slots = F.broadcast(template_slots(scripts.sparkSession)) if built_in else slots
    most = slots.groupBy("template").count().agg(F.max("count")).first()[0] or 1  # slots are a small rule table
    names = slots.select("template").union(scripts.sparkSession.range(1).select(F.lit("none").alias("template"))).distinct()
    known = scripts.join(F.broadcast(names) if built_in else names, "template", "left_semi")
    wanted = known.join(slots, "template").select(
        "script_id", "slot_idx", "name", "key", "default_dur", "required")
    chosen = store(assign_slots(match_scores(wanted, modules, words), most))
    placed = wanted.join(chosen.hint("merge"), ["script_id", "slot_idx"], "left").join(
        modules.select("script_id", "pos", "id", "start_time", "duration").hint("merge"), ["script_id", "pos"], "left")
    filled = F.col("pos").isNotNull()
    slot_blocks = placed.select(
        "script_id", F.col("slot_idx").alias("_slot"), F.coalesce("start_time", F.lit(0.0)).alias("_start"),
        F.lit(0).cast("long").alias("_pos"), "name", F.col("key").alias("template_key"),
        F.coalesce("duration", "default_dur").alias("duration"),
        F.when(filled, "matched").otherwise("missing").alias("status"), F.col("id").alias("source_module"), "required")
    rest = modules.join(chosen.select("script_id", "pos").hint("merge"), ["script_id", "pos"], "left_anti").join(
        known.select("script_id", "template").hint("merge"), KEY).filter(F.col("duration") > 0)
    passed = rest.select(
        "script_id", F.lit(999).alias("_slot"),
        F.when(F.col("template") == "none", F.col("pos").cast("double")).otherwise(F.col("start_time")).alias("_start"),
        F.col("pos").alias("_pos"), F.coalesce(F.nullif("label", F.lit("")), F.lit("片段")).alias("name"),
        F.lit("").alias("template_key"), "duration", F.lit("passthrough").alias("status"),
        F.col("id").alias("source_module"), F.lit(False).alias("required"),
        F.when(F.col("template") == "none", F.col("start_time")).alias("_own"))
    every = slot_blocks.withColumn("_own", F.lit(None).cast("double")).unionByName(passed)
    # Slots come first (0..8), other modules behind them in start order.
    every = every.withColumn("_place", F.when(F.col("_slot") < 999, F.col("_slot").cast("double")).otherwise(
        F.lit(1000.0) + F.col("_start")))
    laid = ordered(store(every), KEY, ["_place", "_pos"], number="block_idx", before={"_from": ("sum", F.col("duration"))})
    start = F.coalesce("_own", F.round(F.coalesce("_from", F.lit(0.0)), 2))
    return laid.select("script_id", "block_idx", "name", "template_key", start.alias("start_time"), "duration", "status",
                       "source_module", "required")


def blueprint_summary(blocks: DataFrame) -> DataFrame:
    """Counts per status, total duration and the names of the required slots that are missing."""
    status = F.col("status")
    # A template has at most nine slots, so the list is short.
    return blocks.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("block_count"), F.round(F.sum("duration"), 2).alias("total_duration"),
        *[F.count_if(status == s).alias(s) for s in ("matched", "missing", "passthrough")],
        F.transform(F.sort_array(F.collect_list(F.when((status == "missing") & F.col("required"), F.struct(
            "block_idx", "name")))), lambda s: s["name"]).alias("required_missing"))


def blank_blueprint(scripts: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Blueprint without modules: every slot of the template missing, laid end to end."""
    slots = template_slots(scripts.sparkSession) if slots is None else slots
    # Slot starts depend on the template only, so the few template rows are laid out first.
    earlier = Window.partitionBy("template").orderBy("slot_idx").rowsBetween(Window.unboundedPreceding, -1)
    laid = slots.withColumn("start_time", F.coalesce(F.sum("default_dur").over(earlier), F.lit(0.0)))
    rows = scripts.join(laid, "template")
    return rows.select("script_id", "template", F.col("slot_idx").alias("block_idx"), "name",
                       F.col("key").alias("template_key"), "start_time", F.col("default_dur").alias("duration"),
                       F.lit("missing").alias("status"), "required")


# -- material -------------------------------------------------------------

def material_gaps(patterns: DataFrame) -> DataFrame:
    """Material gaps of a script as rows.

    ``patterns`` has (script_id, dimension, label, status, reason), one row
    per dimension with a gap; blank fields take the defaults of the dimension.
    """
    entries = F.create_map(*[x for k, (label, reason, accept) in GAP_DEFAULTS.items() for x in (
        F.lit(k), F.struct(F.lit(label).alias("l"), F.lit(reason).alias("r"), F.lit(accept).alias("a")))])
    rows = patterns.withColumn("_d", F.try_element_at(entries, F.col("dimension"))).filter(F.col("_d").isNotNull())

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), default).alias(name)

    return rows.select("script_id", "dimension", given("label", F.col("_d.l")), given("status", F.lit("missing")),
                       given("reason", F.col("_d.r")), F.col("_d.a").alias("accept"))


def material_coverage(gaps: DataFrame, uploads: DataFrame) -> DataFrame:
    """Number of gaps, those matched (by status or an upload) and missing, and the share matched in percent."""
    up = uploads.select("script_id", "dimension").distinct().withColumn("_up", F.lit(True))
    rows = gaps.join(up, ["script_id", "dimension"], "left")
    matched = (F.col("status") == "matched") | F.coalesce("_up", F.lit(False))
    out = rows.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"),
        F.count_if(F.col("status") == "missing").alias("missing"))
    return out.withColumn("coverage", F.floor(F.col("matched") / F.col("total") * 100 + 0.5).cast("long"))
