"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipline.llm.common import SPACE, text_or_empty
from clipline.operators.chunks import borders, search

#: Hashes a sketch keeps and words of a shingle.
KEPT, WIDTH = 128, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """A hash for each word: of the word and the ``width - 1`` before it, blanks before the first.

    Words are what ASCII white space separates. The blanks give texts of a few
    words as many shingles as words, so their beginnings can still be compared.
    """
    words = F.concat(F.array_repeat(F.lit(""), width - 1), F.array_remove(F.split(text, SPACE), ""))
    return let(words, lambda w: F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))))


def bottom(hashes: Column, kept: int = KEPT) -> Column:
    """The ``kept`` smallest different hashes, ascending."""
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, kept)


def sketch(text: Column, kept: int = KEPT, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text; null texts count as empty and have no hashes."""
    return bottom(shingle_hashes(text_or_empty(text), width), kept)


def merged(a: Column, b: Column, kept: int = KEPT) -> Column:
    """The sketch of all that either of two sketches stands for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, kept)


def resemblance(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that is in both. Two empty sketches are alike."""
    share = let(merged(a, b, kept), lambda m: F.when(F.size(m) == 0, 1.0).otherwise(
        F.size(F.array_intersect(m, F.array_intersect(a, b))) / F.size(m)))
    return share.cast("double")


def distinct_shingles(a: Column, kept: int = KEPT) -> Column:
    """Estimated number of different shingles; exact below ``kept``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < kept, F.size(a).cast("double")).otherwise((kept - 1) / share)


def containment(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 where ``a`` has none."""
    alike, own, other = resemblance(a, b, kept), distinct_shingles(a, kept), distinct_shingles(b, kept)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), alike * (own + other) / ((1 + alike) * own)))


def hex_digits(a: Column) -> Column:
    """A sketch as text, 16 hex digits a hash."""
    return F.lower(F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0"))))


def merge_sketches(parts: DataFrame, keys: list[str], column: str = "sketch", kept: int = KEPT) -> DataFrame:
    """One sketch for each ``keys`` from those of its parts, in column ``column``.

    Hashes are made different on the map side, and of each key only the ``kept``
    smallest of a task go on, so a key with any number of parts never gathers.
    Parts without hashes (null or empty sketches) leave an empty sketch; null
    keys are a key.
    """
    hashes = parts.select(*keys, F.explode_outer(column).alias("_hash")).groupBy(*keys, "_hash").agg(
        F.count(F.lit(1)).alias("_n")).drop("_n")
    order = Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last())
    least = hashes.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= kept)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def with_next_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: int = KEPT,
                   width: int = WIDTH, chunks: int | None = None) -> DataFrame:
    """doc_id, text, sketch of every row and next_text, next_sketch of the row after it by falling doc_id.

    After the last row comes the first; a single row follows itself. Null ids
    come last; rows of one id by the hash of their texts. Whole texts are
    shuffled once: rows go to even chunks of that order, and the first row of a
    chunk also goes, as a guest, to the end of the chunk before it. ``chunks``
    is twice the number of shuffle partitions unless given.
    """
    spark = docs.sparkSession
    chunks = chunks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("down"),
                     F.xxhash64("text").alias("digest"))
    own = F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("guest"))
    ahead = F.struct(F.pmod(F.col("_chunk") - 1, F.size("_found.borders")).alias("chunk"), F.lit(True).alias("guest"))
    first = F.get(F.col("_found")["borders"], F.col("_chunk")) == F.col("_key")
    dealt = search(rows, borders(rows, order, chunks), order, chunks).select(
        "doc_id", "text", F.col("_key").alias("key"), F.when(first, F.array(own, ahead)).otherwise(F.array(own)).alias("at"))
    dealt = dealt.select("doc_id", "text", "key", F.explode_outer("at").alias("at")).select(
        "doc_id", "text", "key", "at.chunk", "at.guest").repartition("chunk")
    after = Window.partitionBy("chunk").orderBy("guest", "key")
    sketched = dealt.withColumn("sketch", sketch(F.col("text"), kept, width))
    return (sketched.withColumn("next_text", F.lead("text").over(after))
            .withColumn("next_sketch", F.lead("sketch").over(after)).filter("NOT guest")
            .select("doc_id", "text", "sketch", "next_text", "next_sketch"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: int = KEPT,
                          width: int = WIDTH, chunks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text are.

    The edited text has the last half of its code points (rounded down)
    replaced by the first as many, or all, of the next text by falling doc_id
    (``with_next_text``). Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (resemblance to the edited and to
    the next text), contained (the share of the text that its edited text still
    has) and distinct_shingles. Null texts count as empty; empty texts have an
    empty fingerprint and are alike; equal texts have equal fingerprints.
    Repeated rows are rows of their own; extra columns are ignored; an empty
    table gives no rows.
    """
    rows = with_next_text(docs, doc_id, text, kept, width, chunks)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), kept, width))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hex_digits(F.col("sketch")).alias("fingerprint"), hex_digits(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), kept).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), kept).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), kept).alias("contained"),
        distinct_shingles(F.col("sketch"), kept).alias("distinct_shingles"))
