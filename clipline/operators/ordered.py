"""Ordered windows that never hold a whole key in one task.

A plain ``Window.partitionBy(video_id)`` sends every row of a video to one
task, so one very long video stalls the job.  Here a table is cut into even
chunks of its whole order, keys first (``chunks.borders``), whatever the order
columns are.  The window runs inside (key, chunk) after one shuffle of the
rows.  Only keys that cross a border need more: what the chunks before and
after hold of them is aggregated beside the borders, at most two entries per
chunk, and rows look it up together with their chunk.  So the input is read
twice: once, with the columns that matter, for the borders, and once for the
rows.

``order`` must be a total order inside a key.  With ``dense=True`` its first
column counts rows (0, 1, 2, ...): a chunk is then a plain division by
``ROWS_PER_CHUNK``, known without a sample, and the carry is a join with the
chunks of the keys that have several.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipline.operators.chunks import search

ROWS_PER_CHUNK = 1_000_000
#: Chunks of a table that is not dense; twice the number of shuffle partitions unless set. It bounds the carry.
CHUNKS: int | None = None

#: A sketch keeps about as many values for each task that makes one, all of which meet in one task.
SKETCH = 20_000

_CHUNK = "_chunk"


def _number_of_chunks(df: DataFrame) -> int:
    return CHUNKS or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class _Carry:
    """What a chunk says of a key, and what a row learns from other chunks of its key.

    ``totals`` are aggregates of a chunk.  ``before`` and ``after`` combine
    them over the chunks in front of and behind a chunk.  ``prepare`` adds
    columns to the rows first, ``link`` to the chunks of a key in their order.
    """

    totals: dict[str, Column]
    before: dict[str, Column] = field(default_factory=dict)
    after: dict[str, Column] = field(default_factory=dict)
    prepare: Callable[[DataFrame, list[str], str], DataFrame] | None = None
    link: Callable[[DataFrame, Window], DataFrame] = lambda df, by_chunk: df


def _carries(per: DataFrame, keys: list[str], carry: _Carry, chunk: str) -> DataFrame:
    """``per`` (a row for each key and chunk) with what the key's other chunks hold."""
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    return carry.link(per, by_chunk).withColumns({**carry.before, **carry.after})


def _dense(df: DataFrame, keys: list[str], first: str, carry: _Carry) -> tuple[DataFrame, DataFrame]:
    """Rows with their chunk, and the columns of the carry for the chunks of keys that have several."""
    rows = df.withColumn(_CHUNK, F.floor(F.col(first) / F.lit(ROWS_PER_CHUNK)).cast("long"))
    chunked = rows
    if carry.prepare:
        # Its windows need whole rows. A key of several chunks has some outside chunk 0; usually there is none, and no row is needed.
        long = rows.filter(~F.col(_CHUNK).eqNullSafe(0)).select(*keys).distinct()
        chunked = carry.prepare(rows.join(long, keys, "left_semi"), keys, _CHUNK)
    per = chunked.groupBy(*keys, _CHUNK).agg(*[e.alias(n) for n, e in carry.totals.items()])
    several = per.withColumn("_chunks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_chunks > 1")
    names = [*carry.before, *carry.after]
    return rows, _carries(several, keys, carry, _CHUNK).select(*keys, _CHUNK, *names)


def _ranged(df: DataFrame, keys: list[str], order: list[str], carry: _Carry) -> DataFrame:
    """Rows with their chunk and the columns of the carry, null where a key ends inside the chunk."""
    chunks, part = _number_of_chunks(df), "_part"
    # A task reads several of the many small partitions, each of which would open a file for every one behind it.
    parts = df.repartitionByRange(chunks, *keys, *order).withColumn(part, F.spark_partition_id()).coalesce(max(1, chunks // 8))
    own = F.struct(*keys)
    per = (carry.prepare(parts, keys, part) if carry.prepare else parts).groupBy(part, *keys).agg(
        F.min(F.struct(*order)).alias("_least"), *[e.alias(n) for n, e in carry.totals.items()])
    inside = Window.partitionBy(part)
    per = per.withColumn("_low", F.min(own).over(inside)).withColumn("_high", F.max(own).over(inside)).filter(
        (own == F.col("_low")) | (own == F.col("_high")))
    per = _carries(per, keys, carry, part)
    before = F.struct(*[F.col(n) for n in carry.before] or [F.lit(0).alias("_")])
    after = F.struct(*[F.col(n) for n in carry.after] or [F.lit(0).alias("_")])
    entry = per.groupBy(part).agg(
        F.min(F.struct(*keys, *[F.col("_least")[c].alias(f"_o{i}") for i, c in enumerate(order)])).alias("border"),
        F.min("_low").alias("low"), F.max("_high").alias("high"),
        F.min_by(before, own).alias("before"), F.max_by(after, own).alias("after"))
    table = entry.agg(F.sort_array(F.collect_list(F.struct("border", "low", "high", "before", "after"))).alias("t"))
    table = table.select(F.struct(F.col("t.border").alias("borders"), F.col("t").alias("entries")).alias("found"))
    place = F.struct(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = search(df, table, place, chunks).withColumn("_entry", F.get(F.col("_found")["entries"], F.col(_CHUNK)))
    learned = {n: F.when(F.col("_entry")[side] == own, F.col("_entry")[when][n])
               for names, side, when in ((carry.before, "low", "before"), (carry.after, "high", "after")) for n in names}
    return rows.select(*df.columns, _CHUNK, *[e.alias(n) for n, e in learned.items()])


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Add whole-key aggregates: combined per task first, then joined back as one row per key."""
    summary = df.groupBy(*keys).agg(*[e.alias(n) for n, e in totals.items()])
    return df.join(summary, list(keys))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    dense: bool = False,
    running: Mapping[str, tuple[str, Column]] | None = None,
    before: Mapping[str, tuple[str, Column]] | None = None,
    after: Mapping[str, tuple[str, Column]] | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    ``running`` aggregates up to and including the row, ``before`` up to the
    row before it, ``after`` from the next row on; each value is
    ``(function, expression)`` with function sum, max, min or count.  ``lag``
    and ``lead`` read the neighbouring row.  ``number`` names a 0-based rank.
    """
    running, before, after = dict(running or {}), dict(before or {}), dict(after or {})
    lag, lead = dict(lag or {}), dict(lead or {})
    keys, order = list(keys), list(order)
    source = list(df.columns)

    totals: dict[str, tuple[str, Column]] = {}
    for group in (running, before, after):
        for name, spec in group.items():
            totals[f"_t_{name}"] = spec
    if number:
        totals["_t_number"] = ("count", F.lit(1))
    position = F.struct(*order)
    previous = F.struct(*[e.alias(n) for n, e in lag.items()]) if lag else None
    following = F.struct(*[e.alias(n) for n, e in lead.items()]) if lead else None

    chunk = _CHUNK if dense else "_part"
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    later = by_chunk.rowsBetween(1, Window.unboundedFollowing)
    carry = _Carry({n: getattr(F, fn)(e) for n, (fn, e) in totals.items()})
    if lag:
        carry.totals["_last"] = F.max_by(previous, position)
    if lead:
        carry.totals["_first"] = F.min_by(following, position)
    for name, (fn, _) in totals.items():
        combine, behind = getattr(F, "sum" if fn == "count" else fn), name[3:] in after
        (carry.after if behind else carry.before)["_c" + name] = combine(name).over(later if behind else earlier)
    if lag:
        carry.before["_prev_last"] = F.lag("_last").over(by_chunk)
    if lead:
        carry.after["_next_first"] = F.lead("_first").over(by_chunk)
    carried = None
    if dense:
        rows, carried = _dense(df, keys, order[0], carry)
    else:
        rows = _ranged(df, keys, order, carry)

    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    until = local.rowsBetween(Window.unboundedPreceding, -1)
    onward = local.rowsBetween(1, Window.unboundedFollowing)
    columns = [F.col(c) for c in rows.columns]
    for group, frame in ((running, upto), (before, until), (after, onward)):
        for name, (fn, e) in group.items():
            columns.append(getattr(F, fn)(e).over(frame).alias(f"_l_{name}"))
    if number:
        columns.append(F.row_number().over(local).alias("_l_number"))
    if lag:
        columns.append(F.lag(previous).over(local).alias("_lag"))
    if lead:
        columns.append(F.lead(following).over(local).alias("_lead"))
    joined = rows.select(*columns)
    if carried is not None:
        joined = joined.join(carried, [*keys, _CHUNK], "left")

    def merged(name: str, fn: str) -> Column:
        here, past = F.col(f"_l_{name}"), F.col(f"_c_t_{name}")
        if fn == "sum":
            return F.when(here.isNull(), past).when(past.isNull(), here).otherwise(past + here)
        if fn == "count":
            return F.coalesce(past, F.lit(0)) + here
        return (F.greatest if fn == "max" else F.least)(past, here)

    made = {n: merged(n, fn) for g in (running, before, after) for n, (fn, _) in g.items()}
    if number:
        made[number] = F.coalesce(F.col("_c_t_number"), F.lit(0)) + F.col("_l_number") - 1
    for name in lag:
        made[name] = F.when(F.col("_lag").isNotNull(), F.col(f"_lag.{name}")).otherwise(F.col(f"_prev_last.{name}"))
    for name in lead:
        made[name] = F.when(F.col("_lead").isNotNull(), F.col(f"_lead.{name}")).otherwise(F.col(f"_next_first.{name}"))
    kept = [F.col(c) for c in source if c not in made]
    return joined.select(*kept, *[e.alias(n) for n, e in made.items()])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    dense: bool = False,
    values: Mapping[str, Column],
    together: Callable[[Column, Column], Column],
    name: str = "island",
) -> DataFrame:
    """Number the runs of neighbouring rows for which ``together(prev, cur)`` holds.

    ``prev`` and ``cur`` are structs of ``values``.  The run number starts at 1
    in every key.
    """
    keys, order = list(keys), list(order)
    source = list(df.columns)
    current = F.struct(*[e.alias(n) for n, e in values.items()])

    def opens(previous: str, own: str) -> Column:
        return F.when(F.col(previous).isNull(), 1).otherwise(
            F.when(F.coalesce(together(F.col(previous), F.col(own)), F.lit(False)), 0).otherwise(1))

    def marked(rows: DataFrame, by: list[str], chunk: str) -> DataFrame:
        local = Window.partitionBy(*by, chunk).orderBy(*order)
        rows = rows.withColumn("_cur", current).withColumn("_prev", F.lag("_cur").over(local))
        return rows.withColumn("_starts", F.when(F.col("_prev").isNull(), 0).otherwise(opens("_prev", "_cur")))

    def link(per: DataFrame, by_chunk: Window) -> DataFrame:
        return per.withColumn("_before", F.lag("_last").over(by_chunk)).withColumn("_opens", opens("_before", "_first"))

    chunk = _CHUNK if dense else "_part"
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = _Carry(
        {"_n": F.sum("_starts"), "_first": F.min_by("_cur", F.struct(*order)),
         "_last": F.max_by("_cur", F.struct(*order))},
        before={"_base": F.coalesce(F.sum(F.col("_opens") + F.col("_n")).over(earlier), F.lit(0)) + F.col("_opens")},
        prepare=marked, link=link)
    if dense:
        rows, carried = _dense(df, keys, order[0], carry)
    else:
        rows, carried = _ranged(df, keys, order, carry), None
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = marked(rows, keys, _CHUNK).withColumn("_run", F.sum("_starts").over(upto)).drop("_cur", "_prev", "_starts")
    if carried is not None:
        rows = rows.join(carried, [*keys, _CHUNK], "left")
    return rows.select(
        *[F.col(c) for c in source if c != name],
        (F.coalesce(F.col("_base"), F.lit(1)) + F.col("_run")).cast("long").alias(name))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: Mapping[str, tuple[float, Callable[[Column], Column]]],
    *,
    exact_below: int = 1_000_000,
) -> DataFrame:
    """Exact values at given ranks, one row per key.

    ``picks`` maps an output name to ``(fraction, rank)``: ``rank(n)`` is the
    0-based rank wanted among ``n`` values and ``fraction`` roughly where it
    lies.  A mergeable sketch first brackets each rank; only the values inside
    the bracket are counted and ordered.  The bracket of a key with at most
    ``exact_below`` values is the whole key, for larger keys it spans four
    sketch errors (``n / SKETCH`` each, or ``n / exact_below`` if that is more)
    around the fraction.  A rank that still lies outside its bracket is an
    error, never a missing row.  Equal values are counted before anything is
    ordered, so heavy ties cost nothing.
    """
    keys = list(keys)
    if not keys:
        whole = order_statistics(df.withColumn("_all", F.lit(1)), ["_all"], value, picks, exact_below=exact_below)
        return whole.drop("_all")
    keep = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    accuracy = min(exact_below, SKETCH)
    margin = 2.0 / accuracy
    edges: list[float] = []
    for fraction, _ in picks.values():
        edges += [max(0.0, fraction - margin), min(1.0, fraction + margin)]
    stats = keep.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"))
    small = F.col("_n") <= exact_below
    spans = []
    for i, (name, (_, rank)) in enumerate(picks.items()):
        spans.append(F.struct(
            F.lit(name).alias("pick"), rank(F.col("_n")).cast("long").alias("rank"),
            F.when(small, F.col("_min")).otherwise(F.col("_edges")[2 * i]).alias("lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_edges")[2 * i + 1]).alias("hi")))
    wanted = stats.select(*keys, F.array(*spans).alias("_spans"))

    counted = keep.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    joined = counted.join(wanted, keys)
    pairs = joined.select(*keys, "_v", "_m", F.explode("_spans").alias("_s")).filter("_v <= _s.hi")
    below = F.col("_v") < F.col("_s.lo")
    folded = pairs.groupBy(
        *keys, F.col("_s.pick").alias("_pick"), F.col("_s.rank").alias("_rank"),
        F.when(~below, F.col("_v")).alias("_at")).agg(F.sum("_m").alias("_m"))
    by_value = Window.partitionBy(*keys, "_pick").orderBy(F.col("_at").asc_nulls_first())
    seen = folded.withColumn("_seen", F.sum("_m").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    hit = (F.col("_seen") > F.col("_rank")) & (F.col("_seen") - F.col("_m") <= F.col("_rank"))
    found = seen.groupBy(*keys).agg(
        *[F.max(F.when(hit & (F.col("_pick") == name), F.col("_at"))).alias(name) for name in picks])
    missed = F.raise_error(F.lit("a rank lies outside its bracket; raise exact_below"))
    return found.select(*keys, *[F.coalesce(F.col(name), missed).alias(name) for name in picks])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float],
                **kwargs: int) -> DataFrame:
    """Linear-interpolated percentiles (``fraction`` of ``n - 1``), one row per key."""
    if not keys:
        whole = percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, wanted, **kwargs)
        return whole.drop("_all")
    picks: dict = {}
    for name, p in wanted.items():
        picks[f"_lo_{name}"] = (p, lambda n, p=p: F.floor((n - 1) * F.lit(p)))
        picks[f"_hi_{name}"] = (p, lambda n, p=p: F.ceil((n - 1) * F.lit(p)))
    found = order_statistics(df, keys, value, picks, **kwargs)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = found.join(sizes, list(keys))
    out = [F.col(k) for k in keys]
    for name, p in wanted.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = (F.col("_n") - 1) * F.lit(p)
        out.append((lo + (hi - lo) * (part - F.floor(part))).alias(name))
    return joined.select(*out)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float],
                 **kwargs: int) -> DataFrame:
    """Value at rank ``min(int(n * p / 100), n - 1)`` for every percentage p."""
    picks = {
        name: (p / 100.0, lambda n, p=p: F.least(F.floor(n * F.lit(float(p)) / F.lit(100.0)), n - 1))
        for name, p in wanted.items()}
    return order_statistics(df, keys, value, picks, **kwargs)
