"""Connected components of a graph given as links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import stored
from clipline.session import cut

#: Links of a task between two steps of a round, unless that makes SPREAD tasks or more.
ROWS_PER_TASK, SPREAD = 100_000, 64


def _few(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in few tasks where ``rows`` are few, as it is if their number is not known."""
    if rows is None:
        return df
    few = max(1, -(-rows // ROWS_PER_TASK))
    return df.coalesce(few) if few < SPREAD else df


def _both(edges: DataFrame, rows: int | None = None) -> DataFrame:
    return _few(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), rows)


def _large_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Every neighbour above a node moves to the smallest of the node and its neighbours."""
    both = _both(edges, rows)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges run from smaller to larger."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least.hint("merge"), "b")
    return _few(moved.filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
                .union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
                .select(F.col("x").alias("a"), F.col("y").alias("b")), rows)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node on a link of ``links`` (columns a, b).

    Alternating star contraction: minima by grouping, which combines on the map
    side, so a hub with millions of links stays spread; a checkpoint cuts the
    lineage after each round; rounds grow with the logarithm of the longest
    path and end as soon as only stars are left. Few links stay in few tasks;
    where one is enough, a round has no shuffle, so unions are joined as well.
    Each broadcast and each job leaves something on the driver, so joins merge
    and one job a round tells whether it was the last.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, rows = stored(links, ROWS_PER_TASK)
    while rows:
        edges = _few(edges, rows)
        rows, stars = _shape(edges, rows)
        if stars:
            break
        large = _few(_large_star(edges, rows), rows)
        edges = cut(_few(_small_star(large, rows).distinct(), rows))
    return _few(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select("a", "a").distinct()), rows)


def _shape(edges: DataFrame, rows: int) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: what is the upper end of one is an end of no other."""
    ends = edges.select(F.col("a").alias("u"), F.lit(0).alias("upper")).union(edges.select("b", F.lit(1)))
    nodes = _few(ends, rows).groupBy("u").agg(F.sum("upper").alias("upper"), F.count(F.lit(1)).alias("ends"))
    rows, bent = nodes.agg(F.sum("upper"), F.count_if((F.col("upper") > 0) & (F.col("ends") > 1))).first()
    return rows or 0, not bent
