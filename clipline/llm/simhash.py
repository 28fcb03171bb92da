"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import keep_rows, map_batches, text_or_empty
from clipline.llm.components import components
from clipline.session import cut

#: Fingerprints at 3 or fewer differing bits differ in 3 bytes at most, so at least 5 of 8 positional bytes agree.
BITS = 3
MATCHES = 8 - BITS
#: Postings: three byte positions of one half. Any 5 of the 8 positions have 3 in one half.
POSTINGS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Hashes held at once while bits are counted.
_CHUNK = 1 << 18


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: a bit is 1 if set in over half of them."""
    flat, sizes = np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)
    out = np.zeros((len(sizes), 64), dtype=np.int64)
    ends = np.cumsum(sizes)
    for low in range(0, len(flat), _CHUNK):
        high = min(low + _CHUNK, len(flat))
        first = int(np.searchsorted(ends, low, side="right"))
        last = int(np.searchsorted(ends, high, side="left"))
        runs = np.arange(first, last + 1)
        runs = runs[sizes[runs] > 0]
        starts = np.maximum(ends[runs] - sizes[runs], low) - low
        out[runs] += np.add.reduceat(_bit_sums(flat[low:high]), starts, axis=0, dtype=np.int64)
    bits = (2 * out > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 (seed 42) of all ``width``-word shingles of a text, repeats included."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, 42)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-width]]]
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1:])]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (64 bits as a long) of every row.

    Words are runs of non-white characters, A-Z lower-cased, shingles joined by
    one space. Fewer words than ``width`` make one shingle; no words (null and
    empty texts too) make fingerprint 0.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, counts, found = [], [], []
            for scalar in batch.column(2):
                own = shingle_hashes(scalar.as_py(), width)
                hashes += own
                counts.append(len(own))
                if len(hashes) >= _CHUNK:
                    found.append(majority(hashes, counts))
                    hashes, counts = [], []
            found.append(majority(hashes, counts))
            fp = np.concatenate(found).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)],
                                              ["doc_id", "text_key", "fp"])
        return work

    content = text_or_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("text_key"),
                       content.alias("text"))
    return map_batches(rows, make, "doc_id long, text_key long, fp long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _posting(positions: tuple[int, ...], tag: int) -> Column:
    key = F.lit(tag).cast("long")
    for position in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
    return key


def linked(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what Hamming distance connects among distinct fingerprints; one less than the members at most.

    Searches from one member at a time over those not reached yet: tallies the
    equal bytes of each pair, drops pairs below the guaranteed number, verifies
    the rest bit by bit. A link is between two that differ in BITS bits at most.
    """
    left, out = np.sort(members.astype(np.int64)).view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            differing = left ^ here
            shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            hit = (shared >= MATCHES) & (np.bitwise_count(differing) <= BITS)
            if hit.any():
                near, left = left[hit], left[~hit]
                queue.extend(near)
                out.extend((int(here.view(np.int64)), int(x)) for x in near.view(np.int64))
    return out


def _links(groups: DataFrame) -> DataFrame:
    """Links inside each list of fingerprints."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = [pair for a, b in zip(ends[:-1], ends[1:]) for pair in linked(values[a:b])]
            a, b = (np.array([x[i] for x in found], dtype=np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return work
    return map_batches(groups, make, "a long, b long")


def fingerprint_links(fps: DataFrame, long_posting: int = 4096) -> DataFrame:
    """Links a, b whose components are those of all pairs of the distinct ``fp`` at 3 or fewer bits.

    Every fingerprint is posted under 8 keys of three positional bytes; a pair
    that shares 5 bytes meets under at least one. A posting of up to
    ``long_posting`` members is searched as it is. A longer one is posted again
    under five positional bytes (its three and any two others, which is again
    guaranteed); such a group spans 24 bits and so at most 2^24 fingerprints.
    """
    posted = fps.select("fp", F.explode(F.array(*[_posting(p, i) for i, p in enumerate(POSTINGS)])).alias("posting"))
    sizes = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = posted.join(sizes.hint("merge"), "posting")
    short = met.filter(F.col("members") <= long_posting)
    fives = list(combinations(range(8), MATCHES))
    tag = F.shiftrightunsigned("posting", 24)
    finer = F.flatten(F.array(*[
        F.when(tag == i, F.array(*[_posting(five, k) for k, five in enumerate(fives) if set(three) <= set(five)]))
        .otherwise(F.array().cast("array<long>")) for i, three in enumerate(POSTINGS)]))
    long = (met.filter(F.col("members") > long_posting).select("fp", F.explode(finer).alias("posting"))
            .dropDuplicates(["posting", "fp"]))
    groups = (short.groupBy("posting").agg(F.collect_list("fp").alias("fps")).select("fps")
              .union(long.groupBy("posting").agg(F.collect_list("fp").alias("fps")).select("fps")
                     .filter(F.size("fps") > 1)))
    return _links(groups).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
                    long_posting: int = 4096) -> DataFrame:
    """doc_id, text_key, fp, fingerprint (16 hex digits), component_id of every row.

    Fingerprints link at 3 or fewer differing bits; component_id is the
    smallest doc_id reachable over links, the row itself included. Equal
    fingerprints are one node, so copies are never paired. Null and empty
    texts have fingerprint 0 and link like any other. A null doc_id is never a
    component_id unless the whole component has none. Repeated rows are rows of
    their own; extra columns are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, doc_id, text, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(nodes.select("fp"), long_posting))
    named = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id", "root")
    return rows.join(labels.hint("merge"), "fp").select(
        "doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (then the smaller text hash), all columns kept."""
    found = near_duplicates(docs, doc_id, text, width)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    winners = found.groupBy("root").agg(F.min(order).alias("best")).select("best.doc_id", "best.text_key")
    key = {"doc_id": F.col(doc_id).cast("long"), "text_key": F.xxhash64(text_or_empty(text))}
    return keep_rows(docs, key, winners)
