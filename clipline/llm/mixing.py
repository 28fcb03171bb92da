"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipline.llm.common import WORD, fresh, text_or_empty
from clipline.session import cut

_ROWS = "doc_id long, source string, size long, source_size long, target double, whole long, key long, leaf long"


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size, n, target from one row (source, source_size, n) per source.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source, the
    excess is reshared by weight. The common level is the largest of
    (rest of the total) / (rest of the weights) along the sources ordered by
    cap per weight. Two windows over the table of sources, the only thing here
    that is not spread: one row per source.
    """
    ring = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.get(ring, ((F.col("_r") - 1) % len(weights)).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("_level", (total - before) / rest)
    level = F.max("_level").over(everything)
    return (levels.withColumn("_level", level)
            .select("source", "source_size", "n", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target")))


def pivot(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds ``parts`` (each strictly between 0 and 1) pair by pair; returns the result and who is left (or -1).

    A pair moves words from one to the other until one of the two parts is 0 or
    1. The direction is drawn so that each part keeps its expectation, and the
    sum of size x part never changes.
    """
    p, size, left = parts.tolist(), sizes.tolist(), -1
    for j in range(len(p)):
        if left < 0:
            left = j
            continue
        i = left
        up_i, down_j = (1 - p[i]) * size[i], p[j] * size[j]
        down_i, up_j = p[i] * size[i], (1 - p[j]) * size[j]
        gain, loss = min(up_i, down_j), min(down_i, up_j)
        if draws[j] * (gain + loss) < loss:
            p[i], p[j] = (1.0 if up_i <= down_j else p[i] + gain / size[i],
                          0.0 if down_j <= up_i else p[j] - gain / size[j])
        else:
            p[i], p[j] = (0.0 if down_i <= up_j else p[i] - loss / size[i],
                          1.0 if up_j <= down_i else p[j] + loss / size[j])
        open_i, open_j = 0 < p[i] < 1, 0 < p[j] < 1
        left = i if open_i else j if open_j else -1
    return np.array(p), left


def _step(last: bool, seed: int):
    """Rounds one group of fractional rows; the one left over keeps its part unless this is the root.

    The root draws it and makes good what it gains or loses by turning settled rows of the group, the longest that
    fit first, so a source misses its target by less than its shorter documents.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        group = group.reset_index(drop=True)
        rng = np.random.default_rng([seed, len(group), int(group["key"].iloc[0]) & (2 ** 63 - 1)])
        draws = rng.random(len(group) + 1)
        parts, left = pivot(group["size"].to_numpy(), group["part"].to_numpy(), draws)
        if left >= 0 and last:
            full, sizes = float(draws[-1] < parts[left]), group["size"].to_numpy()
            rest, parts[left] = abs(full - parts[left]) * sizes[left], full
            for j in range(len(parts)):
                if j != left and parts[j] == full and sizes[j] <= rest:
                    parts[j], rest = 1.0 - full, rest - sizes[j]
        group["part"] = parts
        return group
    return run


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17,
                group_rows: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size x copies) of every row.

    A source asks for target / source_size copies of each of its documents:
    the whole part is taken, the fractional part is rounded by pivotal
    rounding that keeps the source's words. Leaves of about ``group_rows``
    rows (by a hash of the id, so a source of any size is split) round on their
    own and each hands one residual up a tree of the same fan-in; the root
    settles the last one. Draws come from hashes of the ids, so reruns agree.

    Null texts have size 0; a null source is a source of its own, sorted last.
    Rows of size 0 carry no words and draw by themselves. Repeated rows are
    rows of their own. Extra columns are ignored; an empty table gives no rows.
    """
    base = cut(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size")
    ).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = cut(source_targets(sizes, weights, share, most).select(
        F.col("source").alias("_source"), "source_size", "n", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaves = F.ceil(F.col("n") / F.lit(group_rows))
    rows = (base.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate)
            .withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
            .withColumn("leaf", F.pmod(F.shiftright("key", 3), leaves).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "whole", "key", "leaf", "part"))
    settled = rows.filter((F.col("part") <= 0) | (F.col("size") == 0)).withColumn(
        "part", F.when(_uniform(F.col("key")) < F.col("part"), 1.0).otherwise(0.0))
    open_rows = rows.filter((F.col("part") > 0) & (F.col("size") > 0))
    largest = plan.agg(F.max("n")).first()[0] or 0
    groups, done = -(-largest // group_rows), [settled]
    while True:
        last = groups <= 1
        stepped = open_rows.groupBy("source", "leaf").applyInPandas(
            _step(last, seed), f"{_ROWS}, part double")
        if last:
            done.append(stepped)
            break
        stepped = cut(stepped)
        between = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(stepped.filter(~between))
        open_rows = stepped.filter(between).withColumn("leaf", F.floor(F.col("leaf") / group_rows).cast("long"))
        groups = -(-groups // group_rows)
    mixed = done[0]
    for more in done[1:]:
        mixed = mixed.unionByName(more)
    copies = F.col("whole") + F.col("part").cast("long")
    return mixed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))


def _uniform(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 11).cast("double") / F.lit(2.0 ** 53)


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as :func:`mix_sources` takes it, all columns kept.

    The copies are joined back on id, source and size. Rows that agree in all
    three take the counts of that key in turn, in the order of their texts.
    """
    doc_id, source, text = (options.get(k, k) for k in ("doc_id", "source", "text"))
    names = {k: fresh(docs, f"_mix_{k}") for k in ("id", "source", "size", "counts", "turn", "copy")}
    key = ["doc_id", "source", "size"]
    counts = mix_sources(docs, **options).groupBy(*key, "copies").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.groupBy(*key).agg(  # one entry for each different number of copies, at most most + 1
        F.sort_array(F.collect_list(F.struct("copies", "rows")), asc=False).alias("counts"))
    upto = F.transform("counts", lambda x, i: F.struct(x["copies"].alias("copies"), F.aggregate(
        F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda total, y: total + y["rows"]).alias("upto")))
    counts = counts.filter(F.col("counts")[0]["copies"] > 0).select(
        *[F.col(k).alias(f"{names[n]}r") for k, n in zip(key, ("id", "source", "size"))], upto.alias(names["counts"]))
    left = docs.withColumns({
        names["id"]: F.col(doc_id).cast("long"), names["source"]: F.col(source).cast("string"),
        names["size"]: F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")})
    same = F.lit(True)
    for k in ("id", "source", "size"):
        same = same & F.col(names[k]).eqNullSafe(F.col(f"{names[k]}r"))
    turn = Window.partitionBy(names["id"], names["source"], names["size"]).orderBy(F.col(text))
    found = left.join(counts, same).withColumn(names["turn"], F.row_number().over(turn))
    own = F.filter(names["counts"], lambda x: x["upto"] >= F.col(names["turn"]))
    times = F.coalesce(F.get(own, F.lit(0))["copies"], F.lit(0)).cast("int")
    return found.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)
