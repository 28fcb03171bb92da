"""Queries over frame features, video types, timeline modules and segment detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipline.constants import GRID_ZONES
from clipline.operators import classify as K
from clipline.operators import detail as X
from clipline.operators import features as V
from clipline.operators import modules as M
from clipline.operators.ordered import ordered
from clipline.plans import adapters as A
from clipline.plans.catalog_curves import music_inputs
from clipline.plans.catalog_windows import event_frames
from clipline.plans.oracle import with_tables
from clipline.session import cut, store


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


# -- features -------------------------------------------------------------

def v01(spark, d):
    return A.frames(spark, d).select("video_id", "idx", F.round(V.hist_entropy(F.col("hist")), 6).alias("entropy"))


def _color_bins(spark, d):
    """Colour histogram rows of a frame, played from the line items of an order."""
    li = A.table(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 180).alias("h"), (F.col("l_suppkey") * 7 % 256).alias("s"),
        (F.col("l_partkey") * 13 % 256).alias("v")).agg(F.sum("l_quantity").cast("long").alias("n"))


def v02(spark, d):
    return V.frame_moments(_color_bins(spark, d)).select(
        "frame", _r("brightness_mean"), _r("brightness_std", 4), _r("saturation_mean"), _r("hue_mean"))


def v03(spark, d):
    return V.color_zones(_color_bins(spark, d)).drop("avg_hue")


def v04(spark, d):
    return V.detection_counts(A.detections(spark, d))


def _frame_facts(spark, d):
    o = A.table(spark, d, "orders")
    c = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("frame"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        (c % 3).alias("face_count"), (c % 10 / 100.0).alias("edge_density"), (c % 7 / 200.0).alias("hsv_var"),
        (c % 13 / 40.0).alias("left_edge"), (c % 11 / 40.0).alias("right_edge"), *[
            (c % m / 60.0).alias(f"strip_{s}") for s, m in (("top", 5), ("bottom", 7), ("left", 9), ("right", 11))],
        (c % 17).alias("n_lines"), (c % 5).alias("diagonal_lines"))


def _faces(spark, d):
    o = A.table(spark, d, "orders").filter("o_custkey % 3 > 0")
    return o.select(F.col("o_orderkey").alias("frame"), (F.col("o_custkey") % 900).cast("double").alias("fx"),
                    F.lit(200.0).alias("fy"), F.lit(150.0).alias("fw"), F.lit(180.0).alias("fh"))


def v05(spark, d):
    out = V.filter_detections(A.detections(spark, d), _faces(spark, d), _frame_facts(spark, d))
    return out.select("frame", "det_id", "class_name", _r("confidence"), "likely_false_positive")


def v05b(spark, d):
    facts = _frame_facts(spark, d)
    return V.detection_quality(V.filter_detections(A.detections(spark, d), _faces(spark, d), facts), facts)


def v06(spark, d):
    return V.composition_type(A.detections(spark, d), _frame_facts(spark, d))


def v07(spark, d):
    return V.composition_grid(A.detections(spark, d), _frame_facts(spark, d))


def v08(spark, d):
    li = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("word"),
        F.when(F.col("l_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" w"), F.col("l_partkey").cast("string"))).alias("text"),
        F.when(F.col("l_partkey") % 5 == 0, "-1").when(F.col("l_partkey") % 7 == 0, "bad")
        .otherwise((F.col("l_partkey") % 100).cast("string")).alias("conf"),
        F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 40).alias("h"), F.lit(1000).alias("image_height"))
    return V.ocr_regions(li).select("frame", "word", "text", "confidence", "text_size_rank", "low_confidence", "region")


def v09(spark, d):
    e = A.media_events(spark, d)
    ocr = e.select("video_id", "us", F.when(F.col("k") % 6 == 0, "page.png").otherwise(
        F.concat(F.lit("/tmp/frame_"), F.col("k").cast("string"), F.lit(".png"))).alias("path"))
    keys = e.filter("event_type = 'click'").select("video_id", F.col("k").alias("frame_index"), "t_s")
    return V.ocr_timestamps(ocr, keys).select("video_id", "us", _r("t_s"))


def v10(spark, d):
    li = A.table(spark, d, "lineitem").withColumn("pair", F.col("l_suppkey"))
    tracks = li.select("pair", (F.col("l_partkey") % 640).cast("double").alias("ax"), (F.col("l_orderkey") % 360).cast("double").alias("ay"),
                       (F.col("l_partkey") % 640 * 1.05 + F.col("l_quantity")).alias("bx"),
                       (F.col("l_orderkey") % 360 * 1.03 + F.col("l_linenumber")).alias("by"), (F.col("l_tax") * 10).alias("error"))
    s = A.table(spark, d, "supplier")
    pairs = s.select(F.col("s_suppkey").alias("pair"), F.lit(640).alias("width"), F.lit(360).alias("height"),
                     F.lit(900).alias("n_points"), F.lit(100.0).alias("brightness_a"), (F.col("s_acctbal") / 50).alias("brightness_b"))
    return V.motion_from_tracks(tracks, pairs)


def _motion_rows(spark, d):
    e = A.media_events(spark, d)
    rows = ordered(e.select("video_id", "us", "value", "k"), ["video_id"], ["us"], number="idx")
    return rows.select("video_id", "idx", (F.col("value") / 97).alias("scale"), "k")


def v11(spark, d):
    return V.median3(_motion_rows(spark, d), "scale", ["video_id"], "idx").select("video_id", "idx", "scale")


def v12(spark, d):
    m = _motion_rows(spark, d)
    k = F.col("k")
    return m.select("video_id", "idx", V.motion_label(
        (k % 11 - 5) / 100.0, (k % 7 - 3) / 100.0, F.lit(1.0) + (k % 5 - 2) / 80.0, (k % 9 - 4) * 1.0,
        (k % 13 - 6) * 10.0, F.col("scale")).alias("label"))


def c01(spark, d):
    audio = music_inputs(spark, d)
    audio = audio.select("video_id", F.when(F.col("video_id") % 3 == 0, "").otherwise("激昂/紧张").alias("bgm_type"),
                         F.lit("calm").alias("mood"), "bpm")
    frames = event_frames(spark, d).withColumn("is_neutral", F.col("face_count") > 0)
    return K.video_summary(frames, audio)


def _summaries(spark, d):
    o = A.table(spark, d, "orders")
    c = F.col("o_custkey")
    words = F.array(*[F.lit(w) for w in ("激昂 / 紧张", "明快 / 活泼", "舒缓 / 沉静", "低沉 / 空灵", "")])
    return o.select(
        F.col("o_orderkey").alias("video_id"), (c % 4 / 4.0).alias("face_count_avg"), (c % 16 * 1.0).alias("optical_flow_avg"),
        (c % 13 / 100.0).alias("edge_density_avg"), F.get(words, (c % 5).cast("int")).alias("bgm_type"),
        (c % 150 * 1.0).alias("bpm"), (c % 2 == 0).alias("is_dominantly_neutral"))


def c02(spark, d):
    out = K.classify_video(_summaries(spark, d))
    return out.select("video_id", "video_type", "confidence", F.get("top3", 1)["label"].alias("second"),
                      F.get("top3", 2)["label"].alias("third"), F.get("top3", 2)["score"].alias("third_score"))


def c03(spark, d):
    given = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("video_id"),
        F.when(F.col("o_orderstatus") == "F", "food").otherwise("vlog").alias("video_type"))
    return K.resolve_type(given, K.classify_video(_summaries(spark, d)))


# -- modules --------------------------------------------------------------

def m01(spark, d):
    return M.watermarks(A.texts(spark, d), A.segments(spark, d), share=0.05)


def _lines(spark, d):
    said = A.speech(spark, d).withColumn("seq", (F.col("start_s") * 1e6).cast("long"))
    return M.attach_lines(A.segments(spark, d), said)


def m02(spark, d):
    return _lines(spark, d)


def _shown(spark, d):
    t, s = A.texts(spark, d), A.segments(spark, d)
    return M.attach_texts(s, t, M.watermarks(t, s, share=0.05))


def m02b(spark, d):
    return _shown(spark, d).select("video_id", "seg_idx", _r("t_s"), "text")


def m03(spark, d):
    out = M.to_modules(A.segments(spark, d).drop("sub_type", "confidence", "evidence"))
    return out.select("script_id", "pos", "type", "label", _r("start_time"), _r("duration"), "track_index",
                      "params.text_content", "params.transition_type")


def m04(spark, d):
    m = store(A.modules(spark, d)).withColumn("start_time", F.floor(F.col("start_time") / 30) * 30.0).withColumn(
        "duration", F.lit(30.0)).withColumn("params", F.create_map(F.lit("k"), F.col("id"))).withColumn(
            "extra_params", F.create_map(F.lit("z"), F.lit("0")))
    out = M.dedupe_modules(m)
    return out.select("script_id", "pos", "id", "type", F.col("extra_params")["k"].alias("extra_k"),
                      F.size("extra_params").cast("long").alias("n_extra"))


def _trimmed(spark, d):
    m = cut(A.modules(spark, d))
    m = ordered(m, ["script_id"], ["start_time", "pos"], number="_p")
    return M.trim_overlaps(m.withColumn("pos", F.col("_p")).drop("_p", "detail"))


def m05(spark, d):
    return _trimmed(spark, d).select("script_id", "pos", "id", _r("start_time"), _r("duration"))


def m06(spark, d):
    out = M.fill_gaps(cut(_trimmed(spark, d)), A.scripts(spark, d))
    return out.select("script_id", "pos", "type", "label", _r("start_time"), _r("duration"))


def _described(spark, d):
    li = A.modules(spark, d)
    k = F.col("pos") + F.col("script_id")
    none = F.array().cast("array<string>")
    return li.withColumn("type", F.when(k % 4 == 0, "content").when(k % 7 == 0, "closing").when(k % 9 == 0, "transition")
                         .otherwise(F.col("type"))).select(
        "*", F.when(k % 3 == 0, "无").when(k % 3 == 1, "").otherwise(F.concat(F.lit("spoken words of "), "label")).alias("voice_content"),
        F.when(k % 5 < 2, none).otherwise(F.array("label", F.lit("shown"))).alias("ocr_texts"),
        F.when(k % 11 < 3, none).otherwise(F.array(F.lit("光照: x"), F.lit("构图: y"), F.col("label"))).alias("visual_elements"),
        F.when(k % 8 == 0, "无").otherwise(F.lit("推近，慢｜x")).alias("motion"),
        F.when(k % 6 == 0, "无").otherwise("高").alias("emotion_peak"),
        F.when(k % 10 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("scene_tags"),
        F.lit("").alias("brief_description"))


def m07(spark, d):
    return M.content_description(_described(spark, d)).select("script_id", "pos", "type", "brief_description")


def m08(spark, d):
    return M.describe_modules(M.content_description(_described(spark, d))).select(
        "script_id", "pos", "semantic_label", "time_range", "description")


def _seg_spans(spark, d):
    return A.segments(spark, d).join(A.videos(spark, d), "video_id")


def m09(spark, d):
    curve = A.curve(spark, d).withColumn("value", F.col("value") / 1000)
    out = X.energy_detail(curve, _seg_spans(spark, d))
    return out.withColumn("palette", F.get(X.palette(F.col("color_tone")), 0))


def m10(spark, d):
    v = X.voice(A.segments(spark, d), _lines(spark, d))
    return v.join(A.videos(spark, d).select("video_id", X.bgm_tier(F.col("duration_s") - 600).alias("bgm_tier")), "video_id")


def doc_lines(spark, d):
    """Documents as the texts of segments: one video per source, one segment per language."""
    langs = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return A.table(spark, d, "documents").select(
        F.col("source").alias("video_id"), langs.cast("long").alias("seg_idx"), F.col("doc_id").alias("seq"), "text")


def _doc_segments(spark, d):
    return doc_lines(spark, d).select("video_id", "seg_idx").distinct().withColumn("structure_type", F.lit("effect"))


def m12(spark, d):
    lines = doc_lines(spark, d)
    words = lines.select("video_id", "seg_idx", F.col("seq").alias("order"), "text")
    out = X.high_freq(_doc_segments(spark, d), lines, words, ["order"])
    return out.withColumn("high_freq_words", F.array_join("high_freq_words", "|"))


def m13(spark, d):
    return X.sentiment(_doc_segments(spark, d), doc_lines(spark, d))


def m14(spark, d):
    conv = A.table(spark, d, "conversations").select(
        F.col("role").alias("video_id"), F.lit(0).cast("long").alias("seg_idx"), "conv_id", "turn",
        F.explode(F.split("text", " ")).alias("text"))
    return X.clean_texts(conv, ["conv_id", "turn"]).select("video_id", F.lower("text").alias("key"))


def m15(spark, d):
    texts = _shown(spark, d)
    out = X.segment_texts(A.segments(spark, d), texts, ["t_s"], 3)
    return out.select("video_id", "seg_idx", F.array_join("ocr_texts", "|").alias("ocr_texts"))


def _idx_frames(spark, d):
    """Frame features with a dense index, stored once: the detail queries read them many times."""
    f = event_frames(spark, d)
    f = ordered(f, ["video_id"], ["us"], number="idx")
    quality = F.when(F.col("face_count") == 0, "reliable").when(F.col("person_count") == 1, "suspicious").otherwise("rejected")
    light = F.col("brightness_mean")
    return cut(f.withColumns({
        "quality_flag": quality, "white_pct": light / 0.97, "warm_pct": light / 9.7, "cool_pct": F.lit(2.0),
        "neutral_pct": light / 19.7, "dark_pct": F.col("histogram_distance") * 10.3, "optical_flow": light / 9.7,
        "width": F.lit(600), "height": F.lit(700)}))


def _idx_boxes(spark, d):
    e = ordered(A.media_events(spark, d), ["video_id"], ["us"], number="idx").filter("event_type <> 'purchase'")
    kind = F.col("event_type")
    name = (F.when(kind == "view", "person").when(kind == "error", "car").when(kind == "signup", "dog").otherwise("cup"))
    x1, y1 = F.col("value") * 2, F.col("k") * 5.0
    return e.select("video_id", "idx", F.col("us").alias("det_id"), name.alias("class_name"), x1.alias("x1"), y1.alias("y1"),
                    (x1 + 50 + F.col("k") * 3.0037).alias("x2"), (y1 + 40 + F.col("value")).alias("y2"))


def _slices(spark, d):
    frames = _idx_frames(spark, d).join(X.frame_boxes(_idx_boxes(spark, d)), ["video_id", "idx"], "left").fillna(
        0.0, ["top_area", "centre_x"])
    return cut(X.frame_slices(frames, _seg_spans(spark, d)))


def m16(spark, d):
    return X.zone_means(X.frame_slices(_idx_frames(spark, d), _seg_spans(spark, d)))


def _audio(spark, d):
    v = A.videos(spark, d)
    return v.select("video_id", "duration_s", (F.col("video_id") % 2 == 0).alias("has_speech"),
                    F.when(F.col("video_id") % 3 == 0, "无").otherwise("舒缓").alias("bgm_type"),
                    (F.col("video_id") % 5 * 30.0).alias("bpm"))


def m17(spark, d):
    return X.bgm_narrative(A.curve(spark, d), A.beats(spark, d), _audio(spark, d))


def m18(spark, d):
    return X.motion_trend(X.segment_curves(_slices(spark, d)))


def m19(spark, d):
    s = A.segments(spark, d)
    tags = X.content_tags(F.array(F.col("structure_type"), F.lit("")), F.lit("推近"), F.lit("无"), F.col("structure_type"),
                          F.col("sub_type"))
    return s.select("video_id", "seg_idx", F.array_join(tags, "|").alias("tags"))


def m20(spark, d):
    s = _slices(spark, d).withColumn("composition_type", F.when(F.col("face_count") == 0, "unknown").when(
        F.col("person_count") == 1, "中心构图").otherwise("框架构图")).withColumn("composition_confidence", F.lit(0.5))
    boxes = _idx_boxes(spark, d)
    out = X.visual_summary(s, boxes, X.segment_motion(s), X.grid_rollup(s, boxes))
    return out.select("video_id", "seg_idx", F.array_join("visual_elements", "|").alias("visual_elements"))


def m20b(spark, d):
    out = X.object_phrases(_slices(spark, d), _idx_boxes(spark, d))
    return out.select("video_id", "seg_idx", "n_objects", F.array_join("objects", "|").alias("objects"))


def m21(spark, d):
    out = X.grid_rollup(_slices(spark, d), _idx_boxes(spark, d))
    return out.select("video_id", "seg_idx", "grid_dominant_zone", "center_symmetry", "diagonal_presence", "zone_center")


def m22(spark, d):
    return X.segment_motion(_slices(spark, d))


def m23(spark, d):
    return X.segment_curves(_slices(spark, d)).withColumn("first_light", F.round("first_light", 6)).withColumn(
        "last_light", F.round("last_light", 6))


def m24(spark, d):
    s = X.frame_slices(_idx_frames(spark, d), _seg_spans(spark, d))
    return X.object_transitions(s, _idx_boxes(spark, d))


def m25(spark, d):
    out = M.assemble(structure=A.segments(spark, d).select("video_id", "seg_idx", "structure_type"),
                     keyframes=A.curve(spark, d).select("video_id", "idx"), summary=A.videos(spark, d).select("video_id"))
    return out.groupBy("video_id", "section").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def m26(spark, d):
    return A.table(spark, d, "conversations").select(
        "conv_id", "turn", M.clean_description(F.concat(F.lit("硬切· 画面右移 | 位移 12.5px "), F.col("text"))).alias("text"))


def m27(spark, d):
    s = A.segments(spark, d)
    kind = M.display_type(F.col("sub_type"), F.array(F.lit("x"), F.col("structure_type")))
    line = M.short_description(F.array("structure_type", "sub_type"), F.array_join("evidence", " "), F.lit("无"))
    return s.select("video_id", "seg_idx", kind.alias("display_type"), line.alias("short_description"))


def m28(spark, d):
    texts = X.segment_texts(A.segments(spark, d), _shown(spark, d), ["t_s"], 3)
    items = M.text_items(F.col("ocr_texts_structured"), F.array(F.lit("none")))
    return texts.select("video_id", "seg_idx", F.array_join(F.transform(items, lambda i: i["text"]), "|").alias("items"))


QUERIES = {
    "v01_hist_entropy": v01, "v02_frame_moments": v02, "v03_color_zones": v03, "v04_detection_counts": v04,
    "v05_filter_detections": v05, "v05_detection_quality": v05b, "v06_composition_type": v06, "v07_composition_grid": v07,
    "v08_ocr_regions": v08, "v09_ocr_timestamps": v09, "v10_motion_from_tracks": v10, "v11_median3": v11,
    "v12_motion_label": v12, "c01_video_summary": c01, "c02_classify_video": c02, "c03_resolve_type": c03,
    "m01_watermarks": m01, "m02_attach_lines": m02, "m02_attach_texts": m02b, "m03_to_modules": m03,
    "m04_dedupe_modules": m04, "m05_trim_overlaps": m05, "m06_fill_gaps": m06, "m07_content_description": m07,
    "m08_describe_modules": m08, "m09_energy_detail": m09, "m10_voice_and_tier": m10, "m12_high_freq": m12,
    "m13_sentiment": m13, "m14_clean_texts": m14, "m15_segment_texts": m15, "m16_zone_means": m16,
    "m17_bgm_narrative": m17, "m18_motion_trend": m18, "m19_content_tags": m19, "m20_visual_summary": m20,
    "m20_object_phrases": m20b, "m21_grid_rollup": m21, "m22_segment_motion": m22, "m23_segment_curves": m23,
    "m24_object_transitions": m24, "m25_assemble": m25, "m26_clean_description": m26, "m27_display_type": m27,
    "m28_text_items": m28,
}

_BINS = """SELECT l_orderkey AS frame, l_partkey % 180 AS h, l_suppkey * 7 % 256 AS s, l_partkey * 13 % 256 AS v,
      CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL"""
_FACTS = """SELECT o_orderkey AS frame, 1920 AS width, 1080 AS height, o_custkey AS c, o_custkey % 3 AS face_count
    FROM orders"""
_FACES = """SELECT o_orderkey AS frame, (o_custkey % 900)::DOUBLE AS fx, 200.0::DOUBLE AS fy, 150.0::DOUBLE AS fw,
      180.0::DOUBLE AS fh FROM orders WHERE o_custkey % 3 > 0"""
_FILTERED = """SELECT d.frame, d.det_id, d.class_name,
      CASE WHEN has = false AND d.class_name = 'person' THEN round(confidence * 0.5, 3) ELSE confidence END AS confidence,
      (c % 10 / 100.0 < 0.03 AND c % 7 / 200.0 < 0.02 AND same >= 5) OR (d.class_name = 'person' AND coalesce(has = false, false))
        AS likely_false_positive
    FROM (SELECT *, count(*) OVER (PARTITION BY frame, class_name) AS same FROM detections) d JOIN facts USING (frame)
    LEFT JOIN (SELECT d.frame, d.det_id, bool_or(
        greatest(0.0, least(fx + fw, x2) - greatest(fx, x1)) * greatest(0.0, least(fy + fh, y2) - greatest(fy, y1))
        / least(fw * fh, greatest((x2 - x1) * (y2 - y1), 1)) > 0.15) AS has
      FROM detections d JOIN faces f USING (frame) WHERE class_name = 'person' GROUP BY d.frame, d.det_id) h
      ON h.frame = d.frame AND h.det_id = d.det_id
    WHERE NOT ((x2 - x1) * (y2 - y1) / (1920 * 1080) < 0.015 AND confidence < 0.6)"""
_GRID = """SELECT frame, sum(a) AS total, sum(CASE WHEN abs(cx - cy) < 0.12 THEN a ELSE 0 END) AS dm,
      sum(CASE WHEN abs(cx + cy - 1.0) < 0.12 THEN a ELSE 0 END) AS da, """ + ", ".join(
    f"sum(CASE WHEN z = '{z}' THEN a ELSE 0 END) AS z_{z}" for z in GRID_ZONES) + """ FROM (
    SELECT *, CASE WHEN ro = 'middle' AND co = 'center' THEN 'center' WHEN ro = 'middle' THEN co
        WHEN co = 'center' THEN ro ELSE ro || '_' || co END AS z FROM (
      SELECT *, CASE WHEN cx < 0.33 THEN 'left' WHEN cx > 0.67 THEN 'right' ELSE 'center' END AS co,
        CASE WHEN cy < 0.33 THEN 'top' WHEN cy > 0.67 THEN 'bottom' ELSE 'middle' END AS ro FROM (
        SELECT frame, (x2 - x1) * (y2 - y1) * CASE class_name WHEN 'person' THEN 1.5 ELSE 1.0 END AS a,
          (x1 + x2) / 2.0 / 1920 AS cx, (y1 + y2) / 2.0 / 1080 AS cy FROM detections))) GROUP BY frame"""
_ZSUM = {s: " + ".join(f"z_{z}" for z in GRID_ZONES if (s in z if s in ("left", "right") else z.startswith(s)))
         for s in ("left", "right", "top", "bottom")}
_C2_POINTS = {
    "flow > 10 AND ed > 0.08": {"gaming": .35, "sports": .30, "anime": .25},
    "fc > 0.5": {"vlog": .20, "lecture": .15, "parenting": .15, "beauty_fashion": .15},
    "neutral": {"commercial": .25, "lecture": .20, "knowledge": .15},
    "m = 0": {"gaming": .15, "sports": .15, "anime": .10}, "m = 1": {"vlog": .15, "travel": .15, "food": .10},
    "m = 2": {"lecture": .20, "travel": .15, "agriculture": .10}, "m = 3": {"music": .15, "film_tv": .10},
    "bpm > 120": {"gaming": .10, "sports": .10}, "bpm < 70": {"lecture": .10, "travel": .10},
    "flow < 3 AND ed < 0.04": {"lecture": .15, "knowledge": .15, "commercial": .10}}
_C2_LABELS = ["commercial", "gaming", "lecture", "film_tv", "music", "anime", "knowledge", "sports", "food", "auto",
              "short_drama", "vlog", "travel", "agriculture", "parenting", "beauty_fashion"]
_SUMS = """SELECT o_orderkey AS video_id, o_custkey % 4 / 4.0 AS fc, o_custkey % 16 * 1.0 AS flow, o_custkey % 13 / 100.0 AS ed,
      o_custkey % 5 AS m, o_custkey % 150 * 1.0 AS bpm, o_custkey % 2 = 0 AS neutral FROM orders"""
_LABEL_ARMS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.MODULE_LABELS.items())
_TOLD = """SELECT *, CASE WHEN kind = 'content' THEN coalesce(said20, left(shown, 19), '构图: y' || left(visual, 0), '环境空镜 / 常规画面')
      ELSE '' END AS brief FROM (
    SELECT *, left(said, 20) || CASE WHEN length(said) > 20 THEN '...' ELSE '' END AS said20 FROM (
      SELECT *, count(*) OVER (PARTITION BY script_id) AS n,
        CASE WHEN k % 4 = 0 THEN 'content' WHEN k % 7 = 0 THEN 'closing' WHEN k % 9 = 0 THEN 'transition' ELSE type END AS kind,
        CASE WHEN k % 3 = 2 THEN 'spoken words of ' || label END AS said,
        CASE WHEN k % 5 >= 2 THEN '文字: ' || label || ' shown' END AS shown, CASE WHEN k % 11 >= 3 THEN label END AS visual,
        CASE WHEN k % 8 <> 0 THEN '推近' END AS moved, CASE WHEN k % 6 <> 0 THEN '情绪高' END AS peak,
        CASE WHEN k % 10 <> 0 THEN 'a，b' END AS tags FROM (SELECT *, pos + script_id AS k FROM modules)))"""
_C2 = " UNION ALL ".join(
    f"SELECT video_id, {i} AS rk, '{label}' AS label, 0.0::DOUBLE" + "".join(
        f" + CASE WHEN {c} THEN {p[label]}::DOUBLE ELSE 0 END" for c, p in _C2_POINTS.items() if label in p)
    + " AS score FROM sums" for i, label in enumerate(_C2_LABELS))
_TOP = "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rk) AS rn FROM scored"
_MARKS = """SELECT * FROM (SELECT p.video_id, p.text, count(DISTINCT seg_idx) AS n_segments FROM (
      SELECT t.video_id, t.text, s.seg_idx FROM texts t JOIN segments s ON s.video_id = t.video_id
        AND t.t_s >= s.start_s AND t.t_s <= s.end_s) p GROUP BY p.video_id, p.text)
    JOIN (SELECT video_id, count(*) AS n FROM segments GROUP BY video_id) USING (video_id)
    WHERE n_segments >= greatest(2, CAST(floor(n * 0.05) AS BIGINT))"""
_SHOWN = """SELECT t.video_id, s.seg_idx, t.t_s, t.text FROM texts t JOIN segments s ON s.video_id = t.video_id
      AND t.t_s >= s.start_s AND t.t_s <= s.end_s
    WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.video_id = t.video_id AND m.text = t.text)"""
_LINES = """SELECT s.video_id, s.seg_idx, CAST(trunc(p.start_s * 1e6) AS BIGINT) AS seq, p.text FROM segments s JOIN speech p
      ON p.video_id = s.video_id AND greatest(p.start_s, s.start_s) < least(p.end_s, s.end_s)"""
_SORTED = """SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY start_time, pos) - 1 AS pos, id, type, label,
      start_time, duration FROM modules"""
_TRIM = """SELECT * FROM (SELECT script_id, pos, id, type, label, start_time, CASE WHEN start_time + duration > nxt
      THEN greatest(nxt - start_time, 0.0) ELSE duration END AS duration FROM (SELECT *,
        lead(start_time) OVER (PARTITION BY script_id ORDER BY pos) AS nxt FROM sorted)) WHERE duration > 0.05"""
_GAPS = """SELECT script_id, at_, 'content' AS type, 'content_' || printf('%.1f', f) || 's' AS label, f AS start_time,
      t - f AS duration FROM (
    SELECT script_id, pos * 2 + 2 AS at_, start_time + duration AS f,
      coalesce(lead(start_time) OVER (PARTITION BY script_id ORDER BY pos),
        CASE WHEN total_duration > 0 THEN total_duration END) AS t FROM trimmed LEFT JOIN scripts USING (script_id)
    UNION ALL SELECT script_id, 0, 0.0, arg_min(start_time, pos) FROM trimmed GROUP BY script_id
    UNION ALL SELECT script_id, 0, 0.0, total_duration FROM scripts
      WHERE script_id NOT IN (SELECT script_id FROM trimmed)) WHERE t - f > 0.05"""
_EVI = """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY us) - 1 AS idx FROM ev"""
_SL = """SELECT s.video_id, s.seg_idx, f.* EXCLUDE (video_id), f.idx - s.i0 AS slice_pos, s.i1 - s.i0 AS n_slice FROM (
      SELECT video_id, seg_idx, i0, greatest(i0 + 1, least(n, CAST(trunc(end_s / duration_s * n) AS BIGINT) + 1)) AS i1 FROM (
        SELECT g.video_id, g.seg_idx, g.end_s, v.duration_s, t.n,
          greatest(0, least(CAST(trunc(g.start_s / v.duration_s * t.n) AS BIGINT), t.n - 1)) AS i0
        FROM segments g JOIN videos v USING (video_id) JOIN totals t USING (video_id) WHERE v.duration_s > 0)) s
    JOIN evi f ON f.video_id = s.video_id AND f.idx >= s.i0 AND f.idx < s.i1"""
_CLS = """CASE event_type WHEN 'view' THEN 'person' WHEN 'error' THEN 'car' WHEN 'signup' THEN 'dog' WHEN 'click' THEN 'cup'
    END"""
_AREA = "CASE WHEN event_type <> 'purchase' THEN ((value * 2 + 50 + k * 3.0037::DOUBLE) - value * 2) * ((k * 5.0 + 40 + value) - k * 5.0) " \
        "ELSE 0.0 END"
_CURVES = f"""SELECT video_id, seg_idx, count(*) AS n_frames,
      round(coalesce(avg(CASE WHEN abs(a - p) > 1e-6 THEN a - p END), 0.0), 2) AS composition_changes,
      round(avg((value + 5) / 9.7), 2) AS flow_mean, round(stddev_pop((value + 5) / 9.7), 2) AS flow_std,
      round(max((value + 5) / 9.7), 2) AS flow_max,
      avg(CASE WHEN slice_pos < 3 THEN round((value + 5) / 255.0, 4) END) AS first_light,
      avg(CASE WHEN slice_pos >= n_slice - 3 THEN round((value + 5) / 255.0, 4) END) AS last_light
    FROM (SELECT *, lag(a) OVER (PARTITION BY video_id, seg_idx ORDER BY slice_pos) AS p FROM (
      SELECT *, {_AREA} AS a FROM sl)) GROUP BY video_id, seg_idx"""
_SLT = "segments videos totals"

ORACLE = {
    "v01_hist_entropy": with_tables("frames", """SELECT video_id, idx, round(log2(list_sum(hist)) - list_sum(
        list_transform(hist, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0.0 END)) / list_sum(hist), 6) AS entropy
        FROM frames"""),
    "v02_frame_moments": f"""SELECT frame, round(sum(v * n) / sum(n), 6) AS brightness_mean,
        round(sqrt(greatest(0.0, sum(v * v * n) / sum(n) - (sum(v * n) / sum(n)) * (sum(v * n) / sum(n)))), 4)
          AS brightness_std, round(sum(s * n) / sum(n), 6) AS saturation_mean, round(sum(h * n) / sum(n), 6) AS hue_mean
        FROM ({_BINS}) GROUP BY frame""",
    "v03_color_zones": f"""SELECT frame, round(a / t * 100.0, 2) AS white_pct, round(b / t * 100.0, 2) AS dark_pct,
        round(c / t * 100.0, 2) AS warm_pct, round(d / t * 100.0, 2) AS cool_pct, round(e / t * 100.0, 2) AS neutral_pct,
        zone AS dominant_zone, zone IN ('white', 'dark', 'neutral') AS is_neutral FROM (SELECT *,
          CASE greatest(a, b, c, d, e) WHEN a THEN 'white' WHEN b THEN 'dark' WHEN c THEN 'warm' WHEN d THEN 'cool'
          ELSE 'neutral' END AS zone FROM (SELECT frame, sum(n) AS t,
            sum(CASE z WHEN 'white' THEN n ELSE 0 END) AS a, sum(CASE z WHEN 'dark' THEN n ELSE 0 END) AS b,
            sum(CASE z WHEN 'warm' THEN n ELSE 0 END) AS c, sum(CASE z WHEN 'cool' THEN n ELSE 0 END) AS d,
            sum(CASE z WHEN 'neutral' THEN n ELSE 0 END) AS e FROM (SELECT frame, n,
              CASE WHEN s / 255.0 < 0.1 AND v / 255.0 > 0.8 THEN 'white' WHEN v / 255.0 < 0.2 THEN 'dark'
                WHEN (h <= 15 OR h >= 165) AND s / 255.0 > 0.15 THEN 'warm'
                WHEN h >= 90 AND h <= 135 AND s / 255.0 > 0.15 THEN 'cool' ELSE 'neutral' END AS z
              FROM ({_BINS})) GROUP BY frame))""",
    "v04_detection_counts": with_tables("detections", """SELECT frame,
          CAST(sum(CASE WHEN class_name = 'person' THEN n ELSE 0 END) AS BIGINT) AS person_count,
          CAST(sum(CASE WHEN class_name = 'car' THEN n ELSE 0 END) AS BIGINT) AS vehicle_count,
          CAST(sum(CASE WHEN class_name = 'dog' THEN n ELSE 0 END) AS BIGINT) AS animal_count,
          CAST(sum(n) AS BIGINT) AS object_count, arg_min(class_name, (-n, f)) AS dominant_class
        FROM (SELECT frame, class_name, count(*) AS n, min(det_id) AS f FROM detections GROUP BY ALL) GROUP BY frame"""),
    "v05_filter_detections": with_tables("detections", """SELECT frame, det_id, class_name,
        round(confidence, 6) AS confidence, likely_false_positive FROM filtered""", facts=_FACTS, faces=_FACES,
        filtered=_FILTERED),
    "v05_detection_quality": with_tables("detections", """SELECT f.frame, CASE WHEN q IS NULL THEN 'rejected' WHEN q THEN
        'suspicious' ELSE 'reliable' END AS quality_flag FROM facts f LEFT JOIN (SELECT frame,
        bool_or(likely_false_positive) AS q FROM filtered GROUP BY frame) USING (frame)""", facts=_FACTS, faces=_FACES,
        filtered=_FILTERED),
    "v07_composition_grid": with_tables("detections", f"""SELECT f.frame,
          CASE WHEN total IS NULL THEN '空' ELSE {"CASE greatest(" + ", ".join(f"z_{z}" for z in GRID_ZONES) + ") "
          + " ".join(f"WHEN z_{z} THEN '{z}'" for z in GRID_ZONES) + " END"} END AS grid_dominant_zone,
          round(coalesce(greatest({", ".join(f"z_{z}" for z in GRID_ZONES)}) / total, 0.0), 3) AS grid_dominant_ratio,
          CASE WHEN total IS NULL THEN '空' WHEN z_center / total > 0.6 THEN '居中' WHEN NOT z_center / total > 0.2
            THEN '边缘' WHEN face_count > 0 THEN '居中'
            WHEN greatest({_ZSUM['left']}, {_ZSUM['right']}) / total > 0.55
              OR greatest({_ZSUM['top']}, {_ZSUM['bottom']}) / total > 0.55 THEN '偏移' ELSE '居中' END AS center_symmetry,
          round(coalesce(z_center / total, 0.0), 3) AS center_ratio,
          coalesce(greatest(dm, da) / total >= 0.2, false) AS diagonal_presence,
          round(coalesce(greatest(dm, da) / total, 0.0), 3) AS diagonal_ratio,
          round(coalesce(total / (1920 * 1080), 0.0), 4) AS subject_coverage,
          CASE WHEN total IS NULL THEN '空' WHEN total / (1920 * 1080) < 0.05 THEN '点缀'
            WHEN total / (1920 * 1080) < 0.25 THEN '适中' ELSE '饱满' END AS subject_coverage_label,
          {", ".join(f"round(coalesce(z_{z} / total, 0.0), 3) AS zone_{z}" for z in GRID_ZONES)}
        FROM facts f LEFT JOIN grid g USING (frame)""", facts=_FACTS, grid=_GRID),
    "v08_ocr_regions": """SELECT frame, word, text, confidence, CASE WHEN h / 1000.0 >= 0.2 THEN 'large' WHEN h / 1000.0 >= 0.05
          THEN 'medium' ELSE 'small' END AS text_size_rank, confidence < 0.4 AS low_confidence,
          row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, word) - 1 AS region FROM (
        SELECT l_orderkey AS frame, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(epoch(l_shipdate) AS BIGINT)) AS word,
          'w' || l_partkey AS text, CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 = 0 THEN 0.6 ELSE l_partkey % 100 / 100.0 END::DOUBLE
            AS confidence, l_quantity AS w, l_linenumber * 40 AS h FROM lineitem WHERE l_partkey % 9 > 0)""",
    "v09_ocr_timestamps": with_tables("ev", """SELECT e.video_id, e.us, round(coalesce(m.t, 0.0), 6) AS t_s FROM ev e
        LEFT JOIN (SELECT video_id, k, min(t_s) AS t FROM ev WHERE event_type = 'click' GROUP BY video_id, k) m
        ON m.video_id = e.video_id AND m.k = e.k AND e.k % 6 <> 0"""),
    "v11_median3": with_tables("ev", """SELECT video_id, idx, CASE WHEN n >= 3 THEN round(CASE WHEN p IS NULL OR q IS NULL
          THEN (v + coalesce(p, q)) / 2 ELSE list_sort([p, v, q])[2] END, 4) ELSE v END AS scale FROM (
        SELECT video_id, idx, value / 97 AS v, lag(value / 97) OVER w AS p, lead(value / 97) OVER w AS q,
          count(*) OVER (PARTITION BY video_id) AS n FROM evi WINDOW w AS (PARTITION BY video_id ORDER BY idx))""", evi=_EVI),
    "v12_motion_label": with_tables("ev", """SELECT video_id, idx, CASE
          WHEN value / 97 > 0.6 AND abs(dx) + abs(dy) < 0.05 THEN 'CUT'
          WHEN abs(b) > 30 AND abs(sc - 1.0) < 0.03 AND abs(ro) < 1 THEN CASE WHEN b > 0 THEN 'FADE_IN' ELSE 'FADE_OUT' END
          WHEN abs(sc - 1.0) > 0.02 THEN CASE WHEN sc > 1 THEN 'ZOOM_IN' ELSE 'ZOOM_OUT' END
          WHEN abs(ro) > 2 THEN CASE WHEN ro > 0 THEN 'ROTATE_CW' ELSE 'ROTATE_CCW' END
          WHEN abs(dx) > 0.03 OR abs(dy) > 0.03 THEN CASE WHEN abs(dx) >= abs(dy)
            THEN CASE WHEN dx > 0 THEN 'PAN_RIGHT' ELSE 'PAN_LEFT' END
            ELSE CASE WHEN dy > 0 THEN 'PAN_DOWN' ELSE 'PAN_UP' END END ELSE 'STATIC' END AS label
        FROM (SELECT *, (k % 11 - 5) / 100.0::DOUBLE AS dx, (k % 7 - 3) / 100.0::DOUBLE AS dy,
          1.0::DOUBLE + (k % 5 - 2) / 80.0::DOUBLE AS sc, (k % 9 - 4) * 1.0 AS ro, (k % 13 - 6) * 10.0 AS b FROM evi)""",
        evi=_EVI),
    "c01_video_summary": with_tables("ev", """SELECT video_id, round(avg(k % 3), 3) AS face_count_avg,
        round(avg(value / 10.0), 2) AS optical_flow_avg, round(avg(k / 500.0::DOUBLE), 4) AS edge_density_avg,
        avg(CASE WHEN k % 3 > 0 THEN 1.0 ELSE 0.0 END) > 0.5 AS is_dominantly_neutral,
        CASE WHEN video_id % 3 = 0 THEN 'calm' ELSE '激昂/紧张' END AS bgm_type,
        CAST(video_id % 140 + 50 AS DOUBLE) AS bpm FROM ev GROUP BY video_id"""),
    "c02_classify_video": f"""WITH sums AS MATERIALIZED ({_SUMS}), scored AS MATERIALIZED ({_C2}), top AS MATERIALIZED ({_TOP})
        SELECT video_id, max(label) FILTER (rn = 1) AS video_type, round(max(score) FILTER (rn = 1), 4) AS confidence,
          max(label) FILTER (rn = 2) AS second, max(label) FILTER (rn = 3) AS third,
          round(max(score) FILTER (rn = 3), 4) AS third_score FROM top WHERE rn <= 3 GROUP BY video_id""",
    "c03_resolve_type": f"""WITH sums AS ({_SUMS}), scored AS ({_C2}), top AS ({_TOP})
        SELECT o_orderkey AS video_id, CASE WHEN o_orderstatus = 'F' THEN 'food' WHEN round(score, 4) > 0.4 THEN label
          ELSE 'vlog' END AS video_type FROM orders JOIN top ON video_id = o_orderkey AND rn = 1""",
    "m01_watermarks": with_tables("segments texts", "SELECT video_id, text, n_segments FROM marks", marks=_MARKS),
    "m02_attach_lines": with_tables("segments speech", "SELECT * FROM lines", lines=_LINES),
    "m02_attach_texts": with_tables("segments texts", "SELECT video_id, seg_idx, round(t_s, 6) AS t_s, text FROM shown",
                                    marks=_MARKS, shown=_SHOWN),
    "m03_to_modules": with_tables("segments", """SELECT video_id AS script_id, seg_idx AS pos,
        CASE structure_type WHEN 'opening' THEN 'title' WHEN 'transition' THEN 'transition' WHEN 'effect' THEN 'effect'
          ELSE 'video_segment' END AS type, '片段' || (seg_idx + 1) AS label, round(start_s, 6) AS start_time,
        round(greatest(end_s - start_s, 0.0), 6) AS duration,
        CASE structure_type WHEN 'opening' THEN 1 WHEN 'effect' THEN 3 ELSE 0 END::BIGINT AS track_index,
        CASE structure_type WHEN 'opening' THEN '片段' || (seg_idx + 1) END AS text_content,
        CASE structure_type WHEN 'transition' THEN 'dissolve' WHEN 'effect' THEN 'fade' WHEN 'closing' THEN 'fade_out' END
          AS transition_type FROM segments"""),
    "m04_dedupe_modules": with_tables("modules", """SELECT script_id, row_number() OVER (PARTITION BY script_id
          ORDER BY place, pos) - 1 AS pos, id, type, ek AS extra_k, CASE WHEN ek IS NULL THEN 1 ELSE 2 END::BIGINT AS n_extra
        FROM (SELECT n.*, e.id AS ek FROM nth n LEFT JOIN nth e ON n.type = 'video_segment' AND e.type = 'effect'
            AND n.script_id = e.script_id AND n.s = e.s AND n.detail = e.detail AND n.rn = e.rn
          WHERE NOT (n.type = 'effect' AND EXISTS (SELECT 1 FROM nth v WHERE v.type = 'video_segment'
            AND v.script_id = n.script_id AND v.s = n.s AND v.detail = n.detail AND v.rn = n.rn)))""",
        nth="""SELECT *, row_number() OVER (PARTITION BY script_id, s, detail, type ORDER BY pos) AS rn,
          min(pos) OVER (PARTITION BY script_id, s) AS place FROM (
          SELECT *, floor(start_time / 30) AS s FROM modules)"""),
    "m05_trim_overlaps": with_tables("modules", """SELECT script_id, pos, id, round(start_time, 6) AS start_time,
        round(duration, 6) AS duration FROM trimmed""", sorted=_SORTED, trimmed=_TRIM),
    "m06_fill_gaps": with_tables("modules scripts", """SELECT script_id, row_number() OVER (PARTITION BY script_id
          ORDER BY at_) - 1 AS pos, type, label, round(start_time, 6) AS start_time, round(duration, 6) AS duration FROM (
        SELECT script_id, pos * 2 + 1 AS at_, type, label, start_time, duration FROM trimmed UNION ALL SELECT * FROM gaps)""",
        sorted=_SORTED, trimmed=_TRIM, gaps=_GAPS),
    "m07_content_description": with_tables("modules", "SELECT script_id, pos, kind AS type, brief AS brief_description FROM told",
                                           told=_TOLD),
    "m08_describe_modules": with_tables("modules", f"""SELECT script_id, pos, CASE WHEN pos = 0 THEN '开头' WHEN pos >= n - 1
          THEN '结尾' ELSE CASE kind {_LABEL_ARMS} ELSE '内容' END END AS semantic_label,
        printf('%.1fs-%.1fs', start_time, start_time + duration) AS time_range, CASE WHEN duration < 0.5 THEN '闪切过渡' ELSE CASE kind
          WHEN 'title' THEN coalesce(nullif(concat_ws('，', tags, shown), ''), '片头画面')
          WHEN 'video_segment' THEN coalesce(nullif(concat_ws('，', visual, moved, peak), ''), '精彩片段')
          WHEN 'transition' THEN coalesce(moved, '转场过渡')
          WHEN 'effect' THEN coalesce(nullif(concat_ws('，', moved, '构图: y' || left(visual, 0)), ''), '视觉特效')
          WHEN 'closing' THEN coalesce(nullif(concat_ws('，', said20, shown, tags), ''), '片尾画面') ELSE brief END END AS description
        FROM told""", told=_TOLD),
    "m26_clean_description": r"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN '—' ELSE regexp_replace(regexp_replace(trim(
        regexp_replace('画面向右移动 ' || text, '\s+', ' ', 'g')), '\s*\|\s*$', ''), '\s*\|\s*', '、', 'g') END AS text
        FROM conversations""",
    "m09_energy_detail": with_tables("segments videos totals", """SELECT video_id, seg_idx, tone AS color_tone,
          CASE WHEN v <= 0 THEN '无' ELSE CASE WHEN v > 0.8 THEN '高' WHEN v > 0.5 THEN '中' ELSE '低' END || ' ('
            || printf('%.2f', v) || ', +' || printf('%.1f', o) || 's)' END AS emotion_peak,
          round(v, 3) AS energy_peak_value, round(o, 2) AS energy_peak_offset,
          CASE tone WHEN '高对比度' THEN '#e63946' WHEN '暖色调' THEN '#ff6b35' ELSE '#264653' END AS palette
        FROM (SELECT *, mx / gm AS v, at_ / ln * dur AS o, CASE WHEN vr > 0.01 THEN '高对比度' WHEN mn > 0.05 THEN '暖色调'
            ELSE '冷色调' END AS tone FROM (
          SELECT b.video_id, b.seg_idx, max(b.dur) AS dur, avg(c.value / 1000) AS mn, var_pop(c.value / 1000) AS vr,
            max(c.value / 1000) AS mx, arg_max(c.idx - b.i0, (c.value, -c.idx)) AS at_, max(b.i1 - b.i0) AS ln,
            max(b.gm) AS gm FROM (
            SELECT *, greatest(i0 + 1, least(CAST(trunc(end_s / duration_s * n) AS BIGINT), n)) AS i1 FROM (
              SELECT s.video_id, s.seg_idx, s.end_s, s.end_s - s.start_s AS dur, v.duration_s, t.n, t.max_value / 1000 AS gm,
                greatest(0, least(CAST(trunc(s.start_s / v.duration_s * t.n) AS BIGINT), t.n - 1)) AS i0
              FROM segments s JOIN videos v USING (video_id) JOIN totals t USING (video_id))) b
          JOIN curve c ON c.video_id = b.video_id AND c.idx >= b.i0 AND c.idx < b.i1 GROUP BY b.video_id, b.seg_idx))"""),
    "m10_voice_and_tier": with_tables("segments speech videos", """SELECT s.video_id, s.seg_idx,
        coalesce(v.t, '无') AS voice_content, CASE WHEN b > 120 THEN '激昂 / 紧张' WHEN b > 80 THEN '明快 / 活泼'
          WHEN b > 50 THEN '舒缓 / 沉静' WHEN b > 0 THEN '低沉 / 空灵' ELSE '无' END AS bgm_tier
        FROM segments s JOIN (SELECT video_id, duration_s - 600 AS b FROM videos) USING (video_id) LEFT JOIN (
          SELECT video_id, seg_idx, string_agg(text, ' ' ORDER BY seq) AS t FROM (SELECT *, row_number() OVER (
            PARTITION BY video_id, seg_idx ORDER BY seq) AS rn FROM lines) WHERE rn <= 3 GROUP BY ALL) v
        USING (video_id, seg_idx)""", lines=_LINES),
    "m12_high_freq": """SELECT video_id, seg_idx, string_agg(t, '|' ORDER BY doc_id, i) AS high_freq_words FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY doc_id, i) AS rn FROM (
          SELECT video_id, seg_idx, doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (
            SELECT source AS video_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END::BIGINT
              AS seg_idx, doc_id, regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}|[a-zA-Z]{4,}') AS w FROM documents)))
        WHERE rn <= 5 GROUP BY video_id, seg_idx""",
    "m13_sentiment": """SELECT source AS video_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3
        END::BIGINT AS seg_idx, CASE WHEN p > q THEN '正面/激昂' WHEN q > p THEN '负面/低落' ELSE '中性' END AS sentiment FROM (
        SELECT source, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' ELSE 'zz' END AS lang, """
        + " + ".join(f"max(CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END)" for w in
                     ["燃", "炸", "绝了", "高能", "神", "帅", "厉害", "精彩", "期待"]) + " AS p, "
        + " + ".join(f"max(CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END)" for w in ["完结", "再见", "结束"])
        + " AS q FROM documents GROUP BY 1, 2)",
    "m14_clean_texts": """SELECT DISTINCT role AS video_id, lower(t) AS key FROM (SELECT role,
        trim(unnest(string_split(text, ' '))) AS t FROM conversations)
        WHERE length(t) >= 2 AND NOT regexp_full_match(t, '[^\\pL\\pN_\\pM]+')
          AND NOT (length(t) <= 3 AND regexp_full_match(t, '[a-zA-Z]+'))
          AND NOT (length(t) <= 3 AND regexp_full_match(t, '\\p{Nd}+'))""",
    "m15_segment_texts": with_tables("segments texts", """SELECT s.video_id, s.seg_idx, t.x AS ocr_texts FROM segments s
        LEFT JOIN (SELECT video_id, seg_idx, string_agg(text, '|' ORDER BY t_s) AS x FROM (SELECT *, row_number() OVER (
          PARTITION BY video_id, seg_idx ORDER BY t_s) AS rn FROM shown) WHERE rn <= 3 GROUP BY ALL) t
        USING (video_id, seg_idx)""", marks=_MARKS, shown=_SHOWN),
    "m16_zone_means": with_tables(_SLT, """SELECT *, white_pct + neutral_pct + dark_pct > 50.0 AS is_dominantly_neutral FROM (
        SELECT video_id, seg_idx, round(avg((value + 5) / 0.97), 1) AS white_pct, round(avg((value + 5) / 9.7), 1) AS warm_pct,
          2.0::DOUBLE AS cool_pct, round(avg((value + 5) / 19.7), 1) AS neutral_pct, round(avg(k / 100.0::DOUBLE * 10.3), 1) AS dark_pct,
          CASE max(CASE WHEN k % 3 = 0 THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END) WHEN 2 THEN 'rejected'
            WHEN 1 THEN 'suspicious' ELSE 'reliable' END AS quality_flag FROM sl GROUP BY video_id, seg_idx)""",
        evi=_EVI, sl=_SL),
    "m17_bgm_narrative": with_tables("videos curve beats", """SELECT video_id, concat_ws(' · ',
          CASE WHEN video_id % 3 <> 0 THEN 'BGM: 舒缓' END, CASE WHEN video_id % 5 > 0 THEN 'BPM ' || video_id % 5 * 30 END,
          CASE WHEN p > 0 THEN '能量峰 ' || p || '处' END, '节拍' || CASE WHEN coalesce(b, 0) / duration_s > 2 THEN '密集'
            WHEN coalesce(b, 0) / duration_s >= 1 THEN '适中' ELSE '稀疏' END) AS bgm_narrative
        FROM videos JOIN (SELECT video_id, count(*) FILTER (value >= lim) AS p FROM curve JOIN (
            SELECT video_id, list_sort(list(value))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS lim FROM curve
            GROUP BY video_id) USING (video_id) GROUP BY video_id) USING (video_id)
        LEFT JOIN (SELECT video_id, count(*) AS b FROM beats GROUP BY video_id) USING (video_id) WHERE video_id % 2 = 1"""),
    "m18_motion_trend": with_tables(_SLT, """SELECT video_id, seg_idx, CASE WHEN br > 1.1 THEN '变亮' WHEN br < 0.9 THEN '变暗'
          ELSE '稳定' END AS brightness_trend, br AS brightness_ratio, CASE WHEN cc > 0.1 THEN '扩散' WHEN cc < -0.1 THEN '聚拢'
          ELSE '稳定' END AS scale_trend, round(cc, 3) AS scale_value, CASE WHEN pf IS NULL THEN '起始段' WHEN mr > 1.5 THEN '动效增强'
          WHEN mr < 0.6 THEN '动效减弱' ELSE '稳定' END AS movement_trend, mr AS movement_ratio FROM (
        SELECT *, composition_changes AS cc, CASE WHEN n_frames >= 3 AND first_light > 0.01 THEN round(last_light / first_light, 3)
            ELSE 1.0 END AS br, CASE WHEN flow_mean > 0.01 AND pf > 0.01 THEN round(flow_mean / pf, 3) ELSE 1.0 END AS mr FROM (
          SELECT *, lag(flow_mean) OVER (PARTITION BY video_id ORDER BY seg_idx) AS pf FROM curves))""",
        evi=_EVI, sl=_SL, curves=_CURVES),
    "m19_content_tags": with_tables("segments", """SELECT video_id, seg_idx, structure_type || '|推近|' || sub_type AS tags
        FROM segments"""),
    "m23_segment_curves": with_tables(_SLT, """SELECT * REPLACE (round(first_light, 6) AS first_light,
        round(last_light, 6) AS last_light) FROM curves""", evi=_EVI, sl=_SL, curves=_CURVES),
    "m24_object_transitions": with_tables(_SLT, f"""SELECT video_id, seg_idx,
          CAST(sum(CASE WHEN p IS NOT NULL AND c IS NOT NULL AND c <> p THEN 1 ELSE 0 END) AS BIGINT) AS fade_in_count,
          CAST(sum(CASE WHEN p IS NOT NULL AND (c IS NULL OR c <> p) THEN 1 ELSE 0 END) AS BIGINT) AS fade_out_count
        FROM (SELECT *, lag(c) OVER (PARTITION BY video_id, seg_idx ORDER BY slice_pos) AS p FROM (
          SELECT *, {_CLS} AS c FROM sl)) GROUP BY video_id, seg_idx""", evi=_EVI, sl=_SL),
    "m25_assemble": with_tables("segments curve", """SELECT video_id, 'structure' AS section, count(*) AS n,
        max(seg_idx) AS last_seq FROM segments GROUP BY video_id UNION ALL SELECT video_id, 'keyframes', count(*), max(idx)
        FROM curve GROUP BY video_id UNION ALL SELECT DISTINCT video_id, 'summary', 1, 0 FROM ev"""),
    "m27_display_type": with_tables("segments", """SELECT video_id, seg_idx, CASE structure_type WHEN 'transition' THEN
        'highlight' ELSE structure_type END AS display_type, structure_type || ' · ' || sub_type || '  「'
        || substr(e, 1, 30) || CASE WHEN length(e) >= 30 THEN '…' ELSE '' END || '」' AS short_description FROM (
        SELECT *, array_to_string(evidence, ' ') AS e FROM segments)"""),
    "m28_text_items": with_tables("segments texts", """SELECT s.video_id, s.seg_idx, coalesce(t.x, 'none') AS items
        FROM segments s LEFT JOIN (SELECT video_id, seg_idx, string_agg(text, '|' ORDER BY t_s) AS x FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY t_s) AS rn FROM shown) WHERE rn <= 3
          GROUP BY ALL) t USING (video_id, seg_idx)""", marks=_MARKS, shown=_SHOWN),
}
