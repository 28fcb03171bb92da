"""Even chunks of a table in the order of several columns.

Spark's range partitioning samples the whole order (a struct of columns), and
the smallest key of each partition becomes a border. A row then finds its chunk
by a binary search among the borders, so the rows themselves are shuffled once,
by chunk, and any number of operators can agree on the same chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def borders(df: DataFrame, key: Column, chunks: int) -> DataFrame:
    """One row, a struct ``found`` with ``borders``: the smallest keys of at most ``chunks`` even chunks, ascending.

    Equal keys share a chunk. The array has at most ``chunks`` entries, which
    is the bound of what a query that uses it carries along.
    """
    dealt = df.select(key.alias("key")).repartitionByRange(chunks, "key")
    least = dealt.groupBy(F.spark_partition_id().alias("chunk")).agg(F.min("key").alias("key"))
    return least.agg(F.struct(F.sort_array(F.collect_list("key")).alias("borders")).alias("found"))


def search(df: DataFrame, found: DataFrame, key: Column, chunks: int) -> DataFrame:
    """``df`` with ``_found`` (the one row of ``found``), ``_key`` and ``_chunk``.

    ``_chunk`` is the number (from 0) of the last border not above the key, -1
    before the first. Each halving is a projection of its own: generated code
    runs through them without copying ``_found``, which callers drop.
    """
    df = df.withColumn("_found", found.scalar()).withColumn("_key", key).withColumn("_chunk", F.lit(-1))
    for step in [1 << s for s in range(max(1, chunks).bit_length() - 1, -1, -1)]:
        ahead = F.col("_chunk") + step
        df = df.withColumn("_chunk", F.when(F.get(F.col("_found")["borders"], ahead) <= F.col("_key"), ahead)
                           .otherwise(F.col("_chunk")))
    return df
