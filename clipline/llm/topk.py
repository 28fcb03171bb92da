"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipline.session import cut

#: Dimensions whose subset sums are tabled together, so a query adds one tabled number for each of its bits.
TABLED = 4
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, dims) of non-negative numbers as bitmaps: (dims, bits, words) with one bit per row."""
    rows, dims = values.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words), dtype=np.uint64)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b].view(np.uint8)[:, :packed.shape[1]] = packed
    return out


def add_slices(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two bit-sliced numbers, least significant slice first, by bitmap arithmetic alone."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        y = b[i] if i < len(b) else None
        if y is None and carry is None:
            out.append(x)
            continue
        if y is None:
            out.append(x ^ carry)
            carry = x & carry
        elif carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return out if carry is None else [*out, carry]


def subset_sums(slices: np.ndarray) -> list[np.ndarray]:
    """For each run of TABLED dimensions the sums of all its subsets: (subsets, bits, words)."""
    dims, bits, words = slices.shape
    width, tables = bits + TABLED.bit_length(), []
    for low in range(0, dims, TABLED):
        run = slices[low:low + TABLED]
        table = np.zeros((1 << len(run), width, words), dtype=np.uint64)
        for mask in range(1, 1 << len(run)):
            top = mask.bit_length() - 1
            total = add_slices(list(table[mask ^ (1 << top)]), list(run[top]))[:width]
            table[mask, :len(total)] = total
        tables.append(table)
    return tables


def score_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Adds the slices gathered per weight (columns[w] have weight 2^w), three into two until one is left in each."""
    out, w = [], 0
    while w < len(columns):
        pile = columns[w]
        while len(pile) > 1:
            if len(pile) == 2:
                x, y = pile.pop(), pile.pop()
                total, carry = x ^ y, x & y
            else:
                x, y, z = pile.pop(), pile.pop(), pile.pop()
                half = x ^ y
                total, carry = half ^ z, (x & y) | (half & z)
            pile.insert(0, total)
            if w + 1 == len(columns):
                columns.append([])
            columns[w + 1].append(carry)
        out.append(pile[0] if pile else None)
        w += 1
    return out


def select_top(score: list[np.ndarray], candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (queries, words) of the rows surely among the top ``k`` and of those tied at the boundary.

    From the most significant slice downward: rows with the bit set are taken
    if they do not exceed ``k`` together, else the others are out.
    """
    sure, tied = np.zeros_like(candidates), candidates.copy()
    for piece in reversed(score):
        if piece is None:
            continue
        ones = tied & piece
        fits = (np.bitwise_count(sure | ones).sum(axis=1) <= k)[:, None]
        sure = np.where(fits, sure | ones, sure)
        tied = np.where(fits, tied & ~piece, ones)
    return sure, tied


class Block:
    """Bit slices of a block of quantised vectors, shifted to be non-negative, and their subset sums."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.low = int(values.min())
        self.bits = max(1, int(values.max() - self.low).bit_length())
        slices = slices_of(values - self.low, self.bits)
        self.tables = subset_sums(slices)
        rows = len(ids)
        self.everyone = np.zeros(slices.shape[2], dtype=np.uint64)
        packed = np.packbits(np.ones(rows, np.uint8), bitorder="little")
        self.everyone.view(np.uint8)[:len(packed)] = packed
        self.flipped = subset_sums((slices ^ _ONES) & self.everyone)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of the best ``k`` rows of the block, all ties at the boundary included.

        The query's bits pick tabled sums: those of positive weight add the
        slices, the sign bit adds the complements, which differ from the true
        score by the same number for all rows.
        """
        width = max(1, int(max(int(queries.max()), -int(queries.min()) - 1)).bit_length())
        columns: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
        for run in range(len(self.tables)):
            own = queries[:, run * TABLED:(run + 1) * TABLED]
            for j in range(width + 1):
                picks = (((own >> j) & 1) << np.arange(own.shape[1])).sum(axis=1)
                if not picks.any():
                    continue
                chosen = (self.flipped if j == width else self.tables)[run][picks]
                for b in range(chosen.shape[1]):
                    while len(columns) <= j + b:
                        columns.append([])
                    columns[j + b].append(chosen[:, b])
        score = score_slices(columns)
        candidates = np.repeat(self.everyone[None, :], len(queries), axis=0)
        same = query_ids[:, None] == self.ids[None, :]
        if same.any():
            packed = np.packbits(same, axis=1, bitorder="little")
            candidates.view(np.uint8)[:, :packed.shape[1]] &= ~packed
        sure, tied = select_top(score, candidates, k)
        found = np.unpackbits((sure | tied).view(np.uint8), axis=1, bitorder="little")[:, :len(self.ids)]
        out = []
        for q, row in enumerate(found):
            hits = np.flatnonzero(row)
            exact = self.values[hits] @ queries[q]
            best = np.lexsort((self.ids[hits], -exact))[:k]
            out.extend((int(query_ids[q]), int(self.ids[hits[i]]), int(exact[i])) for i in best)
        return out


def quantise(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down; vectors with a null or non-finite one are left out."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.filter(F.col(vector).isNotNull() & F.col(vec_id).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(parts, lambda x: F.floor(x * scale).cast("long")).alias("v"))
            .filter(F.size("v") > 0))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id",
          vector: str = "embedding", block_rows: int = 8192, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each row whose vec_id is divisible by ``every``.

    Blocks of about ``block_rows`` rows are indexed as bit slices; each meets
    each block of about ``query_rows`` queries in a task of its own, which
    returns k rows per query; the last ranking is over these. Ties go to the
    smaller vec_id; rows that share the query's vec_id count as the query's
    own. Vectors of different lengths are not compared. Null vectors and those
    with null or non-finite components, null ids and empty vectors take no
    part. Repeated rows each take a rank. Scores must fit 64 bits. Extra
    columns are ignored; an empty table gives no rows.
    """
    rows = cut(quantise(vectors, vec_id, vector, scale))
    asks = rows.filter(F.col("vec_id") % every == 0)
    blocks, groups = (max(1, -(-df.count() // size)) for df, size in ((rows, block_rows), (asks, query_rows)))
    spread = F.xxhash64("vec_id", "v")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), "vec_id", "v",
                        numbers(groups).alias("part"))
    posed = asks.select(numbers(blocks).alias("block"), "vec_id", "v",
                        F.pmod(spread, F.lit(groups)).cast("int").alias("part"))

    def meet(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(queries):
            sizes, asked = own["v"].map(len), queries["v"].map(len)
            for size in sorted(set(sizes) & set(asked)):
                mine, theirs = own[sizes == size], queries[asked == size]
                block = Block(mine["vec_id"].to_numpy(), np.stack(mine["v"].to_list()).astype(np.int64))
                ids, values = theirs["vec_id"].to_numpy(), np.stack(theirs["v"].to_list()).astype(np.int64)
                for low in range(0, len(ids), 64):
                    found += block.top(ids[low:low + 64], values[low:low + 64], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    partial = index.groupBy("block", "part").cogroup(posed.groupBy("block", "part")).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
