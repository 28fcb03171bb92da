"""From narrative segments to timeline modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipline.functions.expressions import fixed, when_chain
from clipline.operators.ordered import ordered
from clipline.operators.ranges import overlapping, points_in_spans
from clipline.session import store

SEG = ["video_id", "seg_idx"]
KEY = ["script_id"]
NOTHING = "无"

# Module type, track and transition parameter per segment type.
MODULE_OF_SEGMENT = {
    "opening": ("title", 1, None), "highlight": ("video_segment", 0, None),
    "transition": ("transition", 0, "dissolve"), "effect": ("effect", 3, "fade"),
    "closing": ("video_segment", 0, "fade_out")}

# Display label per module type.
MODULE_LABELS = {"title": "开头", "video_segment": "高潮", "transition": "转场", "effect": "特效", "content": "内容",
                 "closing": "结尾"}


# -- texts of a segment ---------------------------------------------------

def texts_in_segments(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs of non-blank texts and the segments they are shown in (ends included)."""
    spans = segments.select(*SEG, "start_s", "end_s")
    shown = texts.filter((F.col("t_s") >= 0) & (F.trim("text") != ""))
    return points_in_spans(shown, spans, ["video_id"], "t_s", "start_s", "end_s", bucket=4.0, levels=3).drop(
        "start_s", "end_s")


def watermarks(texts: DataFrame, segments: DataFrame, share: float = 0.4, at_least: int = 2) -> DataFrame:
    """Texts that occur in at least ``max(2, 40%)`` of the segments of a video."""
    pairs = texts_in_segments(texts.select("video_id", "t_s", "text"), segments)
    spread = pairs.select(*SEG, F.trim("text").alias("text")).distinct().groupBy("video_id", "text").agg(
        F.count(F.lit(1)).alias("n_segments"))
    sizes = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    limit = F.greatest(F.lit(at_least), F.floor(F.greatest("_n", F.lit(1)) * share))
    return spread.join(sizes, "video_id").filter(F.col("n_segments") >= limit).select("video_id", "text", "n_segments")


def attach_lines(segments: DataFrame, transcript: DataFrame) -> DataFrame:
    """Transcript lines that overlap a segment, one row per (segment, line) in ``seq`` order."""
    said = transcript.filter(F.trim("text") != "").select(
        "video_id", "seq", F.trim("text").alias("text"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    pairs = overlapping(segments.select(*SEG, "start_s", "end_s"), said, ["video_id"], ("start_s", "end_s"),
                        ("_s", "_e"), bucket=8.0)
    return pairs.select(*SEG, "seq", "text")


def attach_texts(segments: DataFrame, texts: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Texts shown in a segment without the watermarks, one row per (segment, text)."""
    if marks is not None:
        texts = texts.join(marks.select("video_id", "text"), ["video_id", "text"], "left_anti")
    return texts_in_segments(texts, segments)


def to_modules(segments: DataFrame) -> DataFrame:
    """One module per segment: type, track and parameters by segment type, derived id."""
    entries = F.create_map(*[x for k, (t, track, p) in MODULE_OF_SEGMENT.items() for x in (
        F.lit(k), F.struct(F.lit(t).alias("t"), F.lit(track).alias("k"), F.lit(p).cast("string").alias("p")))])
    other = F.struct(F.lit("video_segment").alias("t"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("p"))
    label = F.coalesce(F.col("label") if "label" in segments.columns else F.lit(None),
                       F.concat(F.lit("片段"), (F.col("seg_idx") + 1).cast("string")))
    rows = segments.withColumn("_m", F.coalesce(F.try_element_at(entries, F.col("structure_type")), other)).withColumn(
        "label", label)
    title = F.col("structure_type") == "opening"
    ident = F.substring(F.sha2(F.concat_ws("|", F.col("video_id").cast("string"), F.col("seg_idx").cast("string"),
                                           F.col("start_s").cast("string")), 256), 1, 12)
    extra = [c for c in segments.columns if c not in (*SEG, "start_s", "end_s", "structure_type", "label")]
    return rows.select(
        F.col("video_id").alias("script_id"), F.col("seg_idx").alias("pos"), ident.alias("id"),
        F.col("_m.t").alias("type"), "label", F.col("start_s").alias("start_time"),
        F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0)).alias("duration"),
        F.col("_m.k").cast("long").alias("track_index"),
        F.struct(F.when(title, F.col("label")).alias("text_content"), F.when(title, "fade_in").alias("animation"),
                 F.col("_m.p").alias("transition_type")).alias("params"), *extra)


def dedupe_modules(modules: DataFrame, long_group: int = 1_000_000) -> DataFrame:
    """Fold an effect into the video segment with the same time and detail.

    The n-th video segment of a (start, duration, detail) takes the n-th
    effect: its parameters (a string map) go to ``extra_params``, winning over
    equal keys.  Modules with equal time stay next to each other, at the place
    of the first of them.  The modules of one time are paired after one shuffle;
    those of a time with more than ``long_group`` of them in even chunks.
    """
    time = [*KEY, "start_time", "duration"]
    rows = modules.withColumn("_d", F.to_json(F.struct(F.col("detail").alias("d"))))
    places = modules.groupBy(*time).agg(F.min("pos").alias("_place"), F.count(F.lit(1)).alias("_size"))
    long = store(places.filter(F.col("_size") > long_group))
    kept = _paired(rows.join(places.filter(F.col("_size") <= long_group).hint("merge"), time).drop("_size"), [*time, "_d"])
    if not long.isEmpty():
        kept = kept.unionByName(_paired_in_chunks(rows.join(long.hint("merge"), time).drop("_size"), [*time, "_d"]))
    kind = dict(modules.dtypes)["params"]
    old = F.coalesce("extra_params", F.create_map().cast(kind))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("_extra"), k)), F.col("_extra"))
    kept = kept.withColumn("extra_params", F.when(
        F.coalesce(F.size("_extra"), F.lit(0)) > 0, merged).otherwise(F.col("extra_params")))
    kept = ordered(store(kept.drop("_d", "_extra")), KEY, ["_place", "pos"], number="_new")
    return kept.withColumn("pos", F.col("_new")).select(*modules.columns)


def _paired(rows: DataFrame, same: list[str]) -> DataFrame:
    """``rows`` without the effects that a video segment takes, and ``_extra``, the parameters it takes."""
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*same, "type").orderBy("pos")))
    nth = Window.partitionBy(*same, "_nth")
    video, effect = F.col("type") == "video_segment", F.col("type") == "effect"
    rows = rows.withColumns({
        "_video": F.coalesce(F.max(video).over(nth), F.lit(False)),
        "_effect": F.first(F.when(effect, F.struct("params")), ignorenulls=True).over(nth)})
    kept = rows.filter(~(F.coalesce(effect, F.lit(False)) & F.col("_video")))
    return kept.withColumn("_extra", F.when(video, F.col("_effect.params"))).drop("_nth", "_video", "_effect")


def _paired_in_chunks(rows: DataFrame, same: list[str]) -> DataFrame:
    """As ``_paired``, without a whole group in one task."""
    rows = store(rows)
    paired = rows.filter(F.col("type").isin("video_segment", "effect"))
    paired = store(ordered(paired.select(*same, "type", "pos", "params"), [*same, "type"], ["pos"], number="_nth"))
    videos, effects = paired.filter("type = 'video_segment'"), paired.filter("type = 'effect'")
    matched = store(videos.select(*same, "_nth", F.col("pos").alias("_v")).join(
        effects.select(*same, "_nth", F.col("pos").alias("_e"), F.col("params").alias("_p")).hint("merge"),
        [*same, "_nth"]).select(*KEY, "_v", "_e", "_p"))
    taken = matched.select(*KEY, F.col("_v").alias("pos"), F.col("_p").alias("_extra"))
    dropped = matched.select(*KEY, F.col("_e").alias("pos"))
    return rows.join(dropped.hint("merge"), [*KEY, "pos"], "left_anti").join(taken.hint("merge"), [*KEY, "pos"], "left")


# -- overlaps and gaps ----------------------------------------------------

def trim_overlaps(modules: DataFrame, shortest: float = 0.05) -> DataFrame:
    """End every module where the next one starts; drop what is 0.05 s or shorter.  Keeps ``pos``."""
    near = ordered(modules, KEY, ["pos"], dense=True, lead={"_next": F.col("start_time")})
    end = F.col("start_time") + F.col("duration")
    cut = F.when(end > F.col("_next"), F.greatest(F.col("_next") - F.col("start_time"), F.lit(0.0))).otherwise(
        F.col("duration"))
    return near.withColumn("duration", cut).filter(F.col("duration") > shortest).select(*modules.columns)


def fill_gaps(modules: DataFrame, scripts: DataFrame, smallest: float = 0.05) -> DataFrame:
    """Content modules for uncovered time before, between and after the modules of a script.

    ``scripts`` has ``total_duration``; a script without modules becomes one
    content module.  Positions are numbered anew.
    """
    near = ordered(modules, KEY, ["pos"], dense=True, lead={"_next": F.col("start_time")})
    end = F.col("start_time") + F.col("duration")
    firsts = modules.groupBy("script_id").agg(F.min_by("start_time", "pos").alias("_start"))
    wide = near.join(scripts.select("script_id", "total_duration"), KEY, "left")
    until = F.coalesce("_next", F.when(F.col("total_duration") > 0, F.col("total_duration")))
    between = wide.withColumn("_from", end).withColumn("_to", until).filter(
        F.col("_to") - F.col("_from") > smallest).select(
            "script_id", (F.col("pos") * 2 + 2).alias("_at"), "_from", "_to")
    head = firsts.filter(F.col("_start") > smallest).select(
        "script_id", F.lit(0).cast("long").alias("_at"), F.lit(0.0).alias("_from"), F.col("_start").alias("_to"))
    empty = scripts.filter(F.col("total_duration") > 0).join(modules.select("script_id").distinct(), KEY, "left_anti")
    empty = empty.select("script_id", F.lit(0).cast("long").alias("_at"), F.lit(0.0).alias("_from"),
                         F.col("total_duration").alias("_to"))
    gaps = head.unionByName(between).unionByName(empty)
    ident = F.substring(F.sha2(F.concat_ws("|", F.col("script_id").cast("string"), F.lit("content"),
                                           F.col("_at").cast("string"), F.col("_from").cast("string")), 256), 1, 12)
    made = gaps.select(
        "script_id", "_at", ident.alias("id"), F.lit("content").alias("type"),
        F.concat(F.lit("content_"), fixed(F.col("_from"), 1), F.lit("s")).alias("label"),
        F.col("_from").alias("start_time"), (F.col("_to") - F.col("_from")).alias("duration"),
        F.lit(0).cast("long").alias("track_index"))
    every = modules.withColumn("_at", F.col("pos") * 2 + 1).drop("pos").unionByName(made, allowMissingColumns=True)
    return ordered(every, KEY, ["_at"], dense=True, number="pos").select(*modules.columns)


# -- words about a module -------------------------------------------------

def _said(name: str = "voice_content") -> Column:
    voice = F.col(name)
    return F.when((voice != "") & (voice != NOTHING), voice)


def _short(text: Column, size: int) -> Column:
    return F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "...").otherwise(""))


def _without(items: Column, *prefixes: str) -> Column:
    def keep(x: Column) -> Column:
        ok = F.lit(True)
        for p in prefixes:
            ok = ok & ~x.startswith(p)
        return ok
    return F.filter(items, keep)


def _joined(items: Column, size: int, sep: str) -> Column:
    part = F.slice(items, 1, size)
    return F.when(F.size(part) > 0, F.array_join(part, sep))


def content_description(modules: DataFrame) -> DataFrame:
    """Brief text of content modules: speech, else shown text, else a visual element, else a fixed phrase.

    Needs ``voice_content, ocr_texts, visual_elements, brief_description``.
    """
    text = F.when(F.size("ocr_texts") > 0, F.concat(F.lit("文字: "), F.substring(F.array_join("ocr_texts", " "), 1, 15)))
    visual = F.substring(F.get(_without(F.col("visual_elements"), "光照", "色彩"), 0), 1, 30)
    brief = F.coalesce(F.nullif(F.col("brief_description"), F.lit("")), _short(_said(), 20), text,
                       F.nullif(visual, F.lit("")), F.lit("环境空镜 / 常规画面"))
    return modules.withColumn("brief_description", F.when(F.col("type") == "content", brief).otherwise(
        F.col("brief_description")))


def describe_modules(modules: DataFrame) -> DataFrame:
    """Semantic label, time range and description of every module.

    Needs ``scene_tags, ocr_texts, visual_elements`` (arrays) and ``motion,
    emotion_peak, voice_content, brief_description``.
    """
    sizes = modules.groupBy("script_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = modules.join(sizes, KEY)
    labels = F.create_map(*[F.lit(x) for pair in MODULE_LABELS.items() for x in pair])
    label = when_chain([(F.col("pos") == 0, "开头"), (F.col("pos") >= F.col("_n") - 1, "结尾")],
                       F.coalesce(F.try_element_at(labels, F.col("type")), F.lit("内容")))
    end = F.col("start_time") + F.col("duration")
    moved = F.when((F.col("motion") != "") & (F.col("motion") != NOTHING), F.nullif(F.trim(F.get(F.split(
        F.get(F.split("motion", "，"), 0), "｜"), 0)), F.lit("")))
    tags = _joined(F.col("scene_tags"), 2, "，")
    shown = F.concat(F.lit("文字: "), _joined(F.col("ocr_texts"), 2, " "))
    peak = F.when((F.col("emotion_peak") != "") & (F.col("emotion_peak") != NOTHING),
                  F.concat(F.lit("情绪"), F.col("emotion_peak")))
    visible = F.col("visual_elements")
    effect_visual = F.when(F.size(visible) > 0, F.coalesce(
        _joined(_without(visible, "光照", "色彩"), 1, "，"), F.lit("")))

    def parts(*items: Column, fallback: str) -> Column:
        return F.coalesce(F.nullif(F.concat_ws("，", *items), F.lit("")), F.lit(fallback))

    kind = F.col("type")
    text = when_chain([
        (F.col("duration") < 0.5, "闪切过渡"),
        (kind == "title", parts(tags, shown, fallback="片头画面")),
        (kind == "video_segment", parts(_joined(_without(visible, "光照", "色彩", "构图"), 2, "，"), moved, peak,
                                        fallback="精彩片段")),
        (kind == "transition", F.coalesce(moved, F.lit("转场过渡"))),
        (kind == "effect", F.when(moved.isNull() & effect_visual.isNull(), "视觉特效").otherwise(
            F.concat_ws("，", moved, effect_visual))),
        (kind == "closing", parts(_short(_said(), 20), shown, tags, fallback="片尾画面"))],
        F.coalesce(F.nullif(F.col("brief_description"), F.lit("")), _short(_said(), 30), shown, F.lit("常规画面")))
    return rows.withColumn("semantic_label", label).withColumn(
        "time_range", F.concat(fixed(F.col("start_time"), 1), F.lit("s-"), fixed(end, 1), F.lit("s"))).withColumn(
            "description", text).drop("_n")


def clean_description(raw: Column) -> Column:
    """Readable description: no repeated half, no type prefix, plain words instead of numbers."""
    text = F.trim(raw)
    middle = F.floor(F.length(text) / 2).cast("int")
    # The last blank at or before the middle splits the text; without one it is the middle.
    head = F.substring(text, F.lit(1), middle + 1)
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    split = F.when(F.instr(head, " ") > 0, blank).otherwise(middle).cast("int")
    left = F.trim(F.substring(text, F.lit(1), split))
    right = F.trim(F.substring(text, split + 1, F.length(text)))
    text = F.when((split > 0) & (left != "") & (left == right), left).otherwise(text)

    # Type prefixes that the display already shows otherwise.
    for prefix in ("硬切", "闪切插入", "同步淡出", "交叉溶解", "淡入淡出", "黑场过渡", "白场过渡", "划像", "叠化"):
        text = F.regexp_replace(text, rf"^{prefix}[·\s]*", "")
    text = F.regexp_replace(text, "静止定镜", "画面静止")
    number = r"([\d.]+)"
    # A value above 2 has an integer part of 2 with a non-zero fraction, 3-9 or more digits.
    fast = r"0*(?:2\.\d*[1-9]\d*|[3-9][\d.]*|[1-9]\d+[\d.]*)"
    for verb, old in (("镜头拉远", "缩小"), ("镜头推进", "放大")):
        quick = "镜头快速" + verb[2:]
        shape = verb + r"\s*[（(]\s*" + old + r"\s*[xX×]\s*{}\s*[）)]"
        text = F.regexp_replace(text, shape.format(fast), quick)
        text = F.regexp_replace(text, shape.format(number), verb)
    # Scale: below 0.95 moves out, above 1.05 moves in.
    small = r"0*(?:0?\.(?:[0-8]\d*|9[0-4]?\d*|9)|0|0\.)(?![\d.])"
    large = r"0*(?:1\.0(?:5\d*[1-9]\d*|[6-9]\d*)|1\.[1-9]\d*|[2-9][\d.]*|[1-9]\d+[\d.]*)(?![\d.])"
    text = F.regexp_replace(text, r"缩放\s*[×xX]\s*" + small, "镜头快速拉远")
    text = F.regexp_replace(text, r"缩放\s*[×xX]\s*" + large, "镜头快速推进")
    text = F.regexp_replace(text, r"缩放\s*[×xX]\s*" + number, "轻微缩放")
    for side in "右左上下":
        text = F.regexp_replace(text, f"画面{side}移", f"画面向{side}移动")
    text = F.regexp_replace(text, r"\s*\|\s*位移\s*[-+]?\d+\.?\d*\s*(?:px|%)?", "")
    text = F.regexp_replace(text, r"\s*\|\s*光流\s*\d+\.?\d*", "")
    text = F.regexp_replace(text, r"\s*\|\s*旋转\s*[-+]?\d+\.?\d*°", "")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"^\s*\|\s*", ""), r"\s*\|\s*$", "")
    text = F.regexp_replace(text, r"\s*\|\s*", "、")
    return F.when(raw.isNull() | (raw == "") | (raw == "—"), F.lit("—")).otherwise(
        F.coalesce(F.nullif(text, F.lit("")), F.lit("—")))


def display_type(module_type: Column, tags: Column) -> Column:
    """Segment type for display: by module type, else by the first matching tag rule, else highlight."""
    def tagged(pattern: str) -> Column:
        return F.coalesce(F.exists(tags, lambda t: t.rlike(pattern)), F.lit(False))

    return when_chain([
        (module_type == "title", "opening"), (module_type == "video_segment", "highlight"),
        (module_type == "transition", "transition"), (module_type == "effect", "effect"),
        (tagged("开头|open"), "opening"), (tagged("结尾|clos"), "closing"), (tagged("转场|过"), "transition"),
        (tagged("特效|effect"), "effect")], "highlight")


def short_description(tags: Column, voice: Column, motion: Column) -> Column:
    """Two tags, the first 30 characters said and the motion in one line."""
    said = F.substring(voice, 1, 30)
    quote = F.concat(F.lit("「"), said, F.when(F.length(said) >= 30, "…").otherwise(""), F.lit("」"))
    line = F.concat_ws(
        "  ", _joined(tags, 2, " · "), F.when((voice != "") & (voice != NOTHING), quote),
        F.when((motion != "") & (motion != NOTHING), motion))
    return F.coalesce(F.nullif(line, F.lit("")), F.lit("—"))


def text_items(structured: Column, plain: Column) -> Column:
    """Structured texts, else the plain texts as structs without rank."""
    fields = F.transform(structured, lambda s: F.struct(
        F.coalesce(s["text"], F.lit("")).alias("text"), s["text_size_rank"].alias("size_rank"),
        F.coalesce(s["low_confidence"], F.lit(False)).alias("low_confidence")))
    bare = F.transform(F.coalesce(plain, F.array().cast("array<string>")), lambda t: F.struct(
        t.alias("text"), F.lit(None).cast("string").alias("size_rank"), F.lit(False).alias("low_confidence")))
    return F.when(F.coalesce(F.size(structured), F.lit(0)) > 0, fields).otherwise(bare)


def transcript_lines(lines: Column, voice: Column) -> Column:
    """Transcript lines of a module, else its voice text as the only line."""
    single = F.when((voice != "") & (voice != NOTHING), F.array(voice)).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, lines).otherwise(single)


def assemble(**sections: DataFrame) -> DataFrame:
    """The result record of every video as rows (video_id, section, seq, record JSON).

    Every section is a table with ``video_id``; ``seq`` is its ``idx``,
    ``seg_idx``, ``pos`` or ``frame_index``, else 0.  Rows keep a long video
    spread over many tasks; a writer partitions them by video and section.
    """
    out = None
    for name, table in sections.items():
        order = next((c for c in ("seg_idx", "pos", "frame_index", "idx") if c in table.columns), None)
        rows = table.select(
            "video_id", F.lit(name).alias("section"), (F.col(order) if order else F.lit(0)).cast("long").alias("seq"),
            F.to_json(F.struct(*[c for c in table.columns if c != "video_id"])).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out
