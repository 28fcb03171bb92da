"""Exact deduplication by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import SPACE, keep_rows, text_or_empty
from clipline.session import cut

#: A winner is one number: code points first, then the smaller id; 0 in the low part is a null id.
_SHIFT = Decimal(2 ** 65)
_TOP = Decimal(2 ** 63)


def normalised(text: Column) -> Column:
    """The text without any ASCII white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, "")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _described(docs: DataFrame, doc_id: str, text: str, digest) -> DataFrame:
    content = normalised(F.col(text))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.length(text_or_empty(text)).alias("n"),
        content.alias("content")).withColumn("digest", digest(F.col("content")))


def _rank(n: Column, doc_id: Column) -> Column:
    low = F.coalesce(F.lit(_TOP) - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (n.cast("decimal(11,0)") * F.lit(_SHIFT) + low).cast("decimal(38,0)")


def content_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16,
                    digest=sha256) -> DataFrame:
    """One row for each different content: digest, content, rank of the best row, rows.

    Three combining steps, each comparing the whole content beside the digest:
    inside the task that read the rows (the map side of the first grouping,
    where all rows of a task carry one salt), then per salt, then over the
    salts. A content that fills a third of the table reaches the last step as
    ``salts`` rows.
    """
    rows = _described(docs, doc_id, text, digest)
    rows = rows.select("digest", "content", _rank(F.col("n"), F.col("doc_id")).alias("rank"),
                       (F.spark_partition_id() % salts).alias("salt"))
    salted = rows.groupBy("digest", "content", "salt").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("members"))
    return salted.groupBy("digest", "content").agg(
        F.max("rank").alias("rank"), F.sum("members").alias("members"))


def _winner(classes: DataFrame) -> DataFrame:
    """Digest, keep_id, keep_n and group_size of each class."""
    low = F.col("rank") % F.lit(_SHIFT)
    return classes.select(
        *[c for c in ("digest", "content") if c in classes.columns],
        F.when(low > 0, (F.lit(_TOP) - low).cast("long")).alias("keep_id"),
        F.expr(f"(rank div {_SHIFT}BD)").cast("long").alias("keep_n"), F.col("members").alias("group_size"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16,
                     digest=sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after all ASCII white space is deleted. The
    row with the most code points, then the smallest doc_id, stays. Null and
    empty texts are one content. A null doc_id loses every tie; if it still
    wins, keep_id is null. Of rows that repeat a doc_id with an equal content
    and length, one is kept; all count in group_size. Extra columns are
    ignored; an empty table gives no rows. ``text_sha256`` is ``digest`` of
    the normalised content (another digest is for tests of collisions).
    """
    best = cut(_winner(content_classes(docs, doc_id, text, salts, digest).select("digest", "rank", "members")))
    clash = best.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    rows = _described(docs, doc_id, text, digest)
    single = rows.groupBy("doc_id", "digest", "n").agg(F.count(F.lit(1)).alias("times"))
    if clash.isEmpty():
        found = single.join(best, "digest")
    else:
        by_content = _winner(content_classes(docs, doc_id, text, salts, digest))
        by_content = by_content.join(clash, "digest", "left_semi")
        contents = rows.join(clash, "digest", "left_semi").groupBy("doc_id", "digest", "n", "content").agg(
            F.count(F.lit(1)).alias("times"))
        plain = single.join(clash, "digest", "left_anti").join(best, "digest")
        exact = contents.join(by_content, ["digest", "content"]).select(plain.columns)
        found = plain.unionByName(exact)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("_copy") == 1)
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("digest").alias("text_sha256")))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Found by the content classes of :func:`exact_duplicates`, joined back on
    id, length and digest of the content. Nulls, ties and repeated rows as
    there; an empty table stays empty.
    """
    best = _winner(content_classes(docs, doc_id, text, salts))
    winners = best.select(F.col("keep_id").alias("doc_id"), F.col("keep_n").alias("n"), "digest")
    key = {"doc_id": F.col(doc_id).cast("long"), "n": F.length(text_or_empty(text)).cast("long"),
           "digest": sha256(normalised(F.col(text)))}
    return keep_rows(docs, key, winners)
