"""Sharding by rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rendezvous(key: Column, weights: Mapping[int, float], seed: int = 0) -> Column:
    """The shard of ``key``: the smallest ``-ln(u) / weight``, u in (0, 1) from a hash of (seed, key, shard).

    Every shard draws on its own, so a further shard takes only the keys it
    wins, and a changed weight moves keys only to or from that shard. Equal
    draws go to the smaller shard number. A shard of weight 0 gets nothing.
    Null keys share one draw.
    """
    if any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("id"), F.lit(float(w)).alias("w"))
                       for s, w in sorted(weights.items()) if w > 0])

    def draw(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), key, shard["id"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(2.0 ** 53)
        return F.struct((-F.ln(u) / shard["w"]).alias("d"), shard["id"].alias("id"))

    return F.array_min(F.transform(shards, draw))["id"]


def number_rows(df: DataFrame, group: str, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in no task more than a bucket of a group.

    Rows fall into buckets by a hash of ``order``; buckets are numbered by
    themselves and shifted by the sizes of those before. The table of sizes
    has at most groups x ``buckets`` rows.
    """
    split = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)).cast("int"))
    sizes = split.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = split.withColumn("_i", F.row_number().over(own))
    joined = numbered.join(starts, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(*df.columns, (F.col("_start") + F.col("_i") - 1).cast("long").alias(name))


def assign_shards(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
                  doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``key``: doc_id and the shards decide. ``slot`` numbers a
    shard's rows from 0; ``grown_shard`` is the shard under the weights
    ``grown`` (null without). A null text has no bytes (size 1, CRC 0); rows
    with a null doc_id share a shard; repeated rows each get a slot of their
    own. Only ids and digests are shuffled, never texts. Extra columns are
    ignored; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key = F.col(doc_id)
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), rendezvous(key, weights, seed).alias("shard"),
        (rendezvous(key, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    numbered = number_rows(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
