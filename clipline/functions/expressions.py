"""Small column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to ``lo``, 1 from ``hi``, linear in between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))))


def tri(x: Column, centre: float, half: float) -> Column:
    """1 at ``centre``, 0 from ``half`` away."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x - F.lit(float(centre))) / F.lit(float(half)))


def gauss(x: Column, centre: float, sigma: float) -> Column:
    z = (x - F.lit(float(centre))) / F.lit(float(sigma))
    return F.exp(F.lit(-0.5) * z * z)


def safe_ratio(numerator: Column, denominator: Column, floor: float) -> Column:
    """``numerator / max(denominator, floor)``."""
    return numerator / F.greatest(denominator, F.lit(float(floor)))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Case-insensitive: does the text contain one of the words?"""
    lowered = F.lower(text)
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word.lower())
    return hit


def when_chain(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """First case that holds decides."""
    column = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        column = F.when(condition, value) if column is None else column.when(condition, value)
    last = default if isinstance(default, Column) else F.lit(default)
    return last if column is None else column.otherwise(last)


def first_best(scores: Sequence[tuple[str, Column]]) -> Column:
    """Struct(score, label) of the highest score; ties go to the first label."""
    entries = [F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("label"))
               for i, (n, s) in enumerate(scores)]
    return F.array_max(F.array(*entries))


def ranked(scores: Sequence[tuple[str, Column]]) -> Column:
    """Array of struct(score, rank, label), best first; ties keep the given order."""
    entries = [F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("label"))
               for i, (n, s) in enumerate(scores)]
    return F.reverse(F.array_sort(F.array(*entries)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def fixed(x: Column, digits: int) -> Column:
    """Text with 1 to 3 decimals, rounded on the exact binary value (half to even).

    ``format_string`` rounds the shortest decimal form instead, so 405.95,
    which is stored slightly below, would become 406.0.
    """
    scale = 10**digits

    def text(total: Column, sign: Column) -> Column:
        whole = (total - total % scale) / scale
        return F.concat(sign, whole.cast("long").cast("string"), F.lit("."), F.lpad((total % scale).cast("string"), digits, "0"))

    def rounded(p: Column) -> Column:
        # p: whole part, scaled count of 2^-52 grains, and what is finer than that.
        def settle(q: Column) -> Column:
            half = F.lit(2**51)
            up = F.when((q["rest"] > half) | ((q["rest"] == half) & (q["fine"] | (q["steps"] % 2 == 1))), 1).otherwise(0)
            return bind(q["whole"] * scale + q["steps"] + up, lambda total: text(total, q["sign"]))

        return bind(F.struct(
            p["sign"].alias("sign"), p["whole"].alias("whole"), F.shiftright(p["scaled"], 52).alias("steps"),
            p["scaled"].bitwiseAND(F.lit(2**52 - 1)).alias("rest"), p["fine"].alias("fine")), settle)

    def split(v: Column) -> Column:
        size = F.abs(v)

        def grained(g: Column) -> Column:
            finer = (g["grains"] - F.floor(g["grains"])) * F.lit(float(scale))
            return rounded_struct(g, finer)

        def rounded_struct(g: Column, finer: Column) -> Column:
            return bind(F.struct(
                g["sign"].alias("sign"), g["whole"].alias("whole"),
                (F.floor(g["grains"]).cast("long") * scale + F.floor(finer).cast("long")).alias("scaled"),
                (finer > F.floor(finer)).alias("fine")), rounded)

        return bind(F.struct(
            F.when(v < 0, F.lit("-")).otherwise(F.lit("")).alias("sign"), F.floor(size).cast("long").alias("whole"),
            ((size - F.floor(size)) * F.lit(float(2**52))).alias("grains")), grained)

    return bind(x, split)
