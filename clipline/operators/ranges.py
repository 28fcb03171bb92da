"""Range, interval and nearest-match joins on bucketed keys.

An equi key plus a range predicate alone would be a hash join followed by a
filter, which is quadratic in the length of a video.  Both sides are therefore
cut into buckets of the range column, and the bucket becomes part of the join
key: work per bucket stays small and one long video spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAN = 64  # growth of the bucket width from one level to the next
_SPAN_FAN = 256  # the same where two spans meet


def _bucket(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("long")


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    *,
    bucket: float,
    levels: int = 1,
) -> DataFrame:
    """Every (point, span) pair with ``start <= at <= end`` on equal keys.

    With ``levels > 1`` a span sits on the level whose bucket width
    (``bucket * 64**level``) suits its length, so even a span as long as the
    whole video covers about 64 buckets; points are looked up once per level.
    Column names of the two sides, apart from the keys, must differ.
    """
    keys = list(keys)
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    level = F.lit(0)
    for i in range(1, levels):
        level = F.when(length > F.lit(float(bucket * _FAN**i)), i).otherwise(level)
    width = F.lit(float(bucket)) * F.pow(F.lit(float(_FAN)), F.col("_level"))
    right = (spans.filter(F.col(start) <= F.col(end))
             .withColumn("_level", level)
             .withColumn("_bucket", F.explode(F.sequence(
                 _bucket(F.col(start), width), _bucket(F.col(end), width)))))
    if levels == 1:
        left = points.withColumn("_level", F.lit(0))
    else:
        left = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
    left = left.withColumn("_bucket", _bucket(F.col(at), width))
    joined = left.join(right, [*keys, "_level", "_bucket"])
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_level", "_bucket")


def meeting(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    bucket: float,
    levels: int = 3,
    stored: bool = False,
) -> DataFrame:
    """Pairs of spans on equal keys that share a bucket, each pair once; callers test the spans themselves.

    A span sits on the level whose bucket width (``bucket * 256**level``) suits
    its length, so it covers about 256 buckets at most below the last level. A
    pair meets on the level of its longer span, where the shorter one covers a
    bucket or two: left spans on their own level with right ones up to it
    (even grids), and right spans with shorter left ones (odd grids). Two short
    spans therefore never meet in a wide bucket. Of several shared buckets the
    first counts. Column names of the two sides, apart from the keys, differ.
    Tables that are ``stored`` are read once more, for the levels they have;
    no copy is made for a level on which the other side has no span.
    """
    keys = list(keys)
    width = F.lit(float(bucket)) * F.pow(F.lit(float(_SPAN_FAN)), F.floor(F.col("_grid") / 2))

    def level(span: tuple[str, str]) -> Column:
        own = F.lit(0)
        for i in range(1, levels):
            own = F.when(F.col(span[1]) - F.col(span[0]) > F.lit(float(bucket * _SPAN_FAN**i)), i).otherwise(own)
        return own

    def has(df: DataFrame, span: tuple[str, str]) -> Callable[[int], Column]:
        if not stored:
            return lambda i: F.lit(True)
        found = df.agg(F.collect_set(level(span)).alias("found")).scalar()
        return lambda i: F.array_contains(found, i)

    def spread(df: DataFrame, span: tuple[str, str], grids: Callable[[Column, int], list[tuple[Column, int]]]) -> DataFrame:
        lo, hi = F.col(span[0]), F.col(span[1])
        own = level(span)
        used = [F.when(condition, F.lit(grid)) for i in range(levels) for condition, grid in grids(own, i)]
        return (df.filter(lo <= hi).withColumn("_grid", F.explode(F.array_compact(F.array(*used))))
                .withColumn("_bucket", F.explode(F.sequence(_bucket(lo, width), _bucket(hi, width)))))

    on_left, on_right = has(left, left_span), has(right, right_span)
    one = spread(left, left_span, lambda own, i: [(own == i, 2 * i), *([((own < i) & on_right(i), 2 * i + 1)] if i else [])])
    two = spread(right, right_span, lambda own, i: [((own <= i) & on_left(i), 2 * i), *([(own == i, 2 * i + 1)] if i else [])])
    first = F.greatest(_bucket(F.col(left_span[0]), width), _bucket(F.col(right_span[0]), width))
    # Spark's guess knows nothing of the copies for each bucket and could broadcast a side of any size.
    joined = one.join(two.hint("merge"), [*keys, "_grid", "_bucket"])
    return joined.filter(F.col("_bucket") == first).drop("_grid", "_bucket")


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    bucket: float,
    levels: int = 3,
) -> DataFrame:
    """Every pair of spans with ``max(starts) < min(ends)`` on equal keys, see ``meeting``."""
    pairs = meeting(left, right, keys, left_span, right_span, bucket=bucket, levels=levels)
    return pairs.filter(F.greatest(F.col(left_span[0]), F.col(right_span[0]))
                        < F.least(F.col(left_span[1]), F.col(right_span[1])))


def edges_in_spans(
    rows: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    edges: Sequence[str],
    start: str,
    end: str,
    *,
    bucket: float,
    levels: int = 1,
) -> DataFrame:
    """Pairs where any of the ``edges`` columns of a row lies inside a span."""
    tall = rows.withColumn("_edge", F.explode(F.array(*[F.col(e) for e in edges])))
    return points_in_spans(tall, spans, keys, "_edge", start, end, bucket=bucket, levels=levels).drop("_edge")
