"""Best-two-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import base64
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipline.llm.common import local_table, map_batches, text_or_empty
from clipline.session import cut

class TextEncoder:
    """Byte-pair ids of whole texts as little-endian 32-bit bytes; strings of special tokens are ordinary text."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def cut_points(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start: whole pieces at the end, the rest in front."""
    if length <= capacity:
        return [0]
    return [0, *range(length % capacity or capacity, length, capacity)]


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2,
                 doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every row; null texts are empty."""
    def make():
        encoder, end = TextEncoder(ranks_path, pattern), np.array([end_id], dtype="<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, scalar in enumerate(batch.column(1)):
                data = encoder.encode(scalar.as_py()) + end
                points = cut_points(len(data) // 4, capacity)
                for piece, (a, b) in enumerate(zip(points, [*points[1:], len(data) // 4])):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(data[4 * a:4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(data, "<u4")[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                       *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)
        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(rows, make, schema)


def _best_pair(lengths: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int, int]:
    """Positions of the two lengths with the largest sum within ``room``, and the sum (0: none)."""
    open_ = np.flatnonzero(counts)
    if not len(open_):
        return 0, 0, 0
    own = lengths[open_]
    partner = np.searchsorted(own, room - own, side="right") - 1
    same = partner == np.arange(len(own))
    partner = np.where(same & (counts[open_] < 2), partner - 1, partner)
    sums = np.where(partner >= 0, own + own[np.maximum(partner, 0)], 0)
    best = int(np.argmax(sums))
    return int(open_[best]), int(open_[max(int(partner[best]), 0)]), int(sums[best])


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Packs a histogram of lengths; returns (lengths of one sequence with their numbers, how many such sequences).

    A sequence takes the longest document left and then, again and again, the
    longest that fits. If room stays, its smallest document is given back for
    the two unpacked documents that together fill the enlarged gap most
    tightly. The same choice follows as long as the lengths in it last, so it
    is made once and counted; the work depends on the number of different
    lengths alone.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    out = []
    while counts.any():
        before, chosen, room = counts.copy(), [], capacity
        while True:
            fits = np.flatnonzero((counts > 0) & (lengths <= room))
            if not len(fits):
                break
            j = int(fits[-1])
            chosen.append(j)
            counts[j] -= 1
            room -= int(lengths[j])
        if room and len(chosen) > 1:
            smallest = chosen[-1]
            a, b, total = _best_pair(lengths, counts, room + int(lengths[smallest]))
            if total > lengths[smallest]:
                counts[smallest] += 1
                counts[a] -= 1
                counts[b] -= 1
                chosen[-1:] = [a, b]
        used = np.bincount(chosen, minlength=len(lengths))
        own = used > 0
        times = int((before[own] // used[own]).min())
        counts = before - used * times
        out.append(({int(lengths[j]): int(used[j]) for j in np.flatnonzero(own)[::-1]}, times))
    return out


def place(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of equal slots: (length, first rank, end rank, first sequence, slots per sequence, offset)."""
    rank: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, slots in pattern.items():
            first = rank.get(length, 0)
            rank[length] = first + slots * times
            runs.append((length, first, rank[length], sequence, slots, offset))
            offset += length * slots
        sequence += times
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = 50_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the
    driver; :func:`best_two_fit` turns it into runs of equal slots. Each piece
    finds its slot by its rank among the pieces of its length. Ranks are
    counted in hash buckets of about ``bucket_rows`` rows and shifted by the
    buckets before, so a length that most pieces share is spread.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = place(best_two_fit(histogram, capacity))
    buckets = 1
    while buckets * bucket_rows < sum(histogram.values()):
        buckets *= 2
    own = ["doc_id", "piece", "ids_crc32"]
    split = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int"))
    sizes = split.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*own)
    ranked = split.withColumn("_i", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_i") - 1).drop("_start", "_i", "_bucket")
    names = ["length", "_first", "_end", "_sequence", "_slots", "_offset"]
    table = spark.createDataFrame(local_table(runs, names))
    found = ranked.join(F.broadcast(table), "length").filter("_rank >= _first AND _rank < _end")
    slot = F.col("_rank") - F.col("_first")
    return found.select(
        *pieces.columns, (F.col("_sequence") + F.floor(slot / F.col("_slots"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (slot % F.col("_slots")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2,
                   doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut
    into pieces of ``capacity``, the first of which may be shorter. Null and
    empty texts are one piece of one id. Repeated rows (and null ids) are
    packed each for itself; extra columns are ignored; an empty table gives no
    rows. ``with_ids`` adds the ids of each piece.
    """
    pieces = cut(token_pieces(docs, ranks_path, pattern, capacity, end_id, doc_id, text, with_ids))
    return pack_pieces(pieces, capacity)
