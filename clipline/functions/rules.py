"""Scoring rules of the five segment types and the sub-type labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipline.functions.expressions import fixed, when_chain


def _lit(value: float) -> Column:
    return F.lit(float(value))


def _total(base: float | Column, parts: list[tuple[Column, Column | float]]) -> Column:
    """Base plus the points of every condition that holds.

    A sum of flat terms: nesting one ``when`` in the next would double the
    expression with every rule.
    """
    score = base if isinstance(base, Column) else _lit(base)
    for condition, points in parts:
        score = score + F.when(condition, points if isinstance(points, Column) else _lit(points)).otherwise(_lit(0))
    return score


def _evidence(items: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, text) for c, text in items]))


@dataclass
class _Candidate:
    applies: Column
    score: Column
    kind: str
    evidence: Column


def window_candidates() -> Column:
    """Array of struct(conf, rank, type, evidence), one entry per type whose rule applies.

    Expects the columns made by ``windows.window_signals`` and the preset fields.
    """
    return F.array_compact(F.array(*[F.when(x.applies, F.struct(
        x.score.alias("conf"), F.lit(-i).alias("rank"), F.lit(x.kind).alias("type"), x.evidence.alias("evidence")))
        for i, x in enumerate(_candidates())]))


def best_confidence() -> Column:
    """Confidence of the best candidate, without its evidence, null where no rule applies."""
    return F.greatest(*[F.when(x.applies, x.score) for x in _candidates()])


def _candidates() -> list[_Candidate]:
    """The five types in the order that decides ties."""
    c = F.col
    length = c("end_s") - c("start_s")
    rate = F.when(length > 0, c("cuts") / length).otherwise(_lit(0))
    peak = c("peak_ratio")
    face, face_ratio, flow = c("has_face"), c("avg_face_ratio"), c("avg_flow")
    saturation, edges = c("avg_saturation"), c("avg_edge_density")
    persons, vehicles, animals = c("persons"), c("vehicles"), c("animals")
    true = F.lit(True)

    # Opening: close to the start of the video.
    talking = face & (face_ratio > 0.08)
    busy = (edges > 0.15) & ~face
    group = persons >= 2
    score = F.least(_lit(0.95), _total(0.80, [
        (c("opening_word"), 0.08), (talking, 0.06), (busy, 0.04), (group, 0.04)]))
    opening = _Candidate(
        (c("start_s") < c("duration_s") * c("opening_pct")) & (c("start_s") < 5.0), score, "opening",
        _evidence([
            (true, F.lit("position_first_10pct")), (c("opening_word"), F.lit("opening_ocr_match")),
            (talking, F.lit("visual_talking_head")), (busy, F.lit("visual_complex_scene")),
            (group & face, F.lit("yolo_talking_head")), (group & ~face, F.lit("yolo_crowd_intro"))]))

    # Highlight: loud, fast, emotional.
    rules = [
        (peak > _lit(1.8) * c("energy_mult"), _lit(0.35), F.concat(F.lit("energy_peak_"), fixed(peak, 1), F.lit("x"))),
        (rate > _lit(2) * c("cut_mult"), _lit(0.20), F.concat(F.lit("cut_rate_"), fixed(rate, 1), F.lit("/s"))),
        (c("highlight_word"), _lit(0.20) * c("ocr_w"), F.lit("highlight_ocr_match")),
        (c("speech_s") / F.greatest(length, _lit(0.1)) > 0.7, _lit(0.10) * c("audio_w"),
         F.lit("high_speech_density")),
        (flow > 15.0, _lit(0.15), F.lit("visual_high_motion")),
        ((saturation > 100) & (flow > 8.0), _lit(0.10), F.lit("visual_vivid_motion")),
        (face & (face_ratio > 0.12), _lit(0.05), F.lit("visual_face_highlight")),
        (persons >= 3, _lit(0.08) * c("yolo_w"), F.lit("yolo_crowd_activity")),
        (vehicles >= 1, _lit(0.05) * c("yolo_w"), F.lit("yolo_vehicle_action")),
        (animals >= 1, _lit(0.03) * c("yolo_w"), F.lit("yolo_animal_presence"))]
    score = _total(0, [(condition, points) for condition, points, _ in rules])
    highlight = _Candidate(score > 0.3, F.least(score, _lit(0.95)), "highlight",
                           _evidence([(cond, text) for cond, _, text in rules]))

    # Transition: cuts, silence, colour shifts.
    rules = [
        (rate > 0.5, _lit(0.40), F.concat(F.lit("scene_switch_"), fixed(rate, 1), F.lit("/s"))),
        (c("transition_word"), _lit(0.20), F.lit("transition_ocr")),
        (c("silence_edge"), _lit(0.15), F.lit("silence_gap")),
        (c("max_hist_dist") > 0.5, _lit(0.15), F.lit("visual_color_shift")),
        (c("min_brightness") < 20, _lit(0.10), F.lit("visual_dark_transition"))]
    score = _total(0, [(condition, points) for condition, points, _ in rules])
    transition = _Candidate(score > 0.35, F.least(score, _lit(0.90)), "transition",
                            _evidence([(cond, text) for cond, _, text in rules]))

    # Effect: a short window with a strong signal.
    score = _total(_lit(0.65) + F.least(peak * _lit(0.05), _lit(0.15)), [(flow > 25.0, 0.10), (saturation > 150, 0.08)])
    effect = _Candidate(
        (length < 3.0) & ((peak > 2.0) | (rate > 3)), F.least(score, _lit(0.90)), "effect",
        _evidence([
            (true, F.concat(F.lit("short_segment_"), fixed(length, 1), F.lit("s"))),
            (flow > 25.0, F.lit("visual_intense_motion")), (saturation > 150, F.lit("visual_high_saturation"))]))

    # Closing: close to the end of the video.
    fade_out = (c("min_brightness") < 25) & (c("avg_flow_or_high") < 3.0)
    score = F.least(_lit(0.95), _total(0.80, [(c("closing_word"), 0.08), (c("is_fading"), 0.05), (fade_out, 0.05)]))
    closing = _Candidate(
        c("start_s") > c("duration_s") * (_lit(1.0) - c("closing_pct")), score, "closing",
        _evidence([
            (true, F.lit("position_last_15pct")), (c("closing_word"), F.lit("closing_ocr_match")),
            (c("is_fading"), F.lit("energy_fading")), (fade_out, F.lit("visual_fade_out"))]))

    return [opening, highlight, transition, effect, closing]


def best_candidate(candidates: Column) -> Column:
    """Highest confidence; ties keep the rule order."""
    return F.array_max(candidates)


def sub_type(kind: Column, evidence: Column) -> Column:
    """Fine label of a segment from its evidence.

    Arms that no evidence can reach (low flow, motion in effects) are left out.
    """
    def some(test) -> Column:
        return F.exists(evidence, test)

    def has(name: str) -> Column:
        return F.array_contains(evidence, name)

    word = some(lambda e: e.contains("ocr_match"))
    motion = some(lambda e: e.contains("visual_high_motion") | e.startswith("cut_rate_"))
    energy = some(lambda e: e.startswith("energy_peak_"))
    face = some(lambda e: e.contains("face") | e.contains("talking_head"))
    detector = some(lambda e: e.startswith("yolo_"))
    short = some(lambda e: e.startswith("short_segment_"))
    fading, dark, out = has("energy_fading"), has("visual_dark_transition"), has("visual_fade_out")
    shift, quiet, speech = has("visual_color_shift"), has("silence_gap"), has("high_speech_density")

    opening = when_chain([
        (word & ~face & ~motion, "标题卡"), (word & face, "人物引入"), (detector & face, "人物引入"),
        (motion & energy, "悬念开场"), (face & speech, "人物引入"), (word, "品牌开场")], "环境铺垫")
    highlight = when_chain([
        (motion & energy & detector, "动作高燃"), (speech & ~motion, "台词金句"), (energy & ~motion, "情绪峰值"),
        (motion & energy, "动作高燃"), (word & energy, "视觉爆发"), (motion, "动作高燃")], "视觉爆发")
    transition = when_chain([
        (quiet & dark, "硬切"), (shift & ~dark, "匹配剪辑"), (motion & shift, "滑动转场"),
        (shift & dark, "淡入淡出")], "硬切")
    effect = when_chain([(motion & energy & short, "视觉特效"), (short, "闪切插入")], "视觉特效")
    closing = when_chain([
        (fading & out, "同步淡出"), (fading, "音乐淡出"), (out, "黑场淡出"), (word, "字幕滚动")], "同步淡出")
    return when_chain([
        (kind == "opening", opening), (kind == "highlight", highlight), (kind == "transition", transition),
        (kind == "effect", effect), (kind == "closing", closing)], "未分类")
