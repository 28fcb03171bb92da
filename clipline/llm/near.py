"""Near copies by exact Jaccard similarity of word shingles.

SimHash fingerprints meet in the positional byte postings of ``simhash`` first;
prefix postings then find the pairs whose fingerprints lie further apart. Whole
shingle sets decide on every pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipline.llm.common import keep_rows, map_batches, stored, text_or_empty
from clipline.llm.components import components
from clipline.llm.simhash import fingerprint_links, majority, shingle_hashes
from clipline.session import cut

#: One text of so many is sampled for common shingles; those seen LEAST_SEEN times are posted last. Any order is right.
SAMPLE_SHARE, LEAST_SEEN, MOST_COMMON = 16, 3, 1 << 18
#: Rows of a task that hold a signature or a set of shingles, where there are few.
SIGNED_ROWS, SET_ROWS = 20_000, 4_000
#: Up to so many texts are picked for the check through a broadcast of their keys.
MOST_SENT = 1 << 18
#: Turns in which members of a posting meet one of them before all of them meet; after the first, only postings above SHORT.
TURNS, SHORT = 2, 16
#: What all of them meet in: blocks of so many members and bytes of signatures.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
_SLACK = 1e-9


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return _distinct(shingle_hashes(text, width))


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, dtype=np.uint64))


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(size: int, similarity: float) -> int:
    """How many shingles of a set, first in a common order, hold one of every set that similar to it."""
    return size - math.ceil(similarity * size - _SLACK) + 1 if size else 0


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - _SLACK


def signature(shingles: np.ndarray) -> bytes:
    """How many shingles fall on each of n to 2n places (64 at least), odd or even, as bits."""
    places = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def can_be_similar(a: bytes, b: bytes, size_a: int, size_b: int, similarity: float) -> bool:
    """False only where sizes or signatures prove a lower similarity: each differing bit is a shingle that one set lacks."""
    if min(size_a, size_b) < similarity * max(size_a, size_b) - _SLACK:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    apart = int(np.bitwise_count(x ^ y).sum())
    return apart <= (1 - similarity) / (1 + similarity) * (size_a + size_b) + _SLACK


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample, ascending, and how often each was seen."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(0)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["shingle"])
        return work

    sample = texts.filter(F.pmod("text_key", F.lit(SAMPLE_SHARE)) == 0).select("text")
    seen = (map_batches(sample, make, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow())
    keys = seen.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], seen.column("n").to_numpy()[order]


def _prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set), size, fp (the SimHash of the set), signature, prefix of every row."""
    keys, seen = _common(texts, width)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, fps, signs, prefixes = [], [], [], [], []
            for scalar in batch.column(2):
                own = shingle_set(scalar.as_py(), width)
                rank = np.zeros(len(own), dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rank = np.where(keys[at] == own, seen[at], 0)
                nodes.append(set_key(own))
                sizes.append(len(own))
                fps.append(majority(own, [len(own)]).view(np.int64)[0])
                signs.append(signature(own))
                prefixes.append(own[np.lexsort((own, rank))][:prefix_length(len(own), similarity)].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *prefixes])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(fps, pa.int64()), pa.array(signs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "text_key", "node", "size", "fp", "signature", "prefix"])
        return work
    return map_batches(texts.select("doc_id", "text_key", "text"), make,
                       "doc_id long, text_key long, node long, size long, fp long, signature binary, prefix array<long>")


def _possible(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose signatures prove a lower similarity, and a text of each node (key_a, key_b)."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = [c.to_pylist() for c in batch.columns[4:]]
            hit = [can_be_similar(x, y, n, m, similarity) for x, y, n, m in zip(*known)]
            return batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array(hit, pa.bool_()))
        return work

    known = nodes.select("node", "best.text_key", "signature", "size")
    left, right = known.toDF("a", "key_a", "x", "n").hint("merge"), known.toDF("b", "key_b", "y", "m").hint("merge")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "key_a", "key_b", "x", "y", "n", "m")
    return map_batches(met, make, "a long, b long, key_a long, key_b long")


def _fold(signs: np.ndarray, length: int) -> np.ndarray:
    """Signatures (one a row) of fewer places."""
    while signs.shape[1] > length:
        half = signs.shape[1] // 2
        signs = signs[:, :half] ^ signs[:, half:]
    return signs


def block_pairs(roots: np.ndarray, sizes: np.ndarray, places: np.ndarray, blocks: np.ndarray, signs: list[bytes],
                similarity: float) -> list[tuple[int, int]]:
    """Members i, j that may be similar: of different components, sizes, places and signatures leave room.

    If the members are of two blocks, only pairs across them are wanted.
    """
    lengths = np.array([len(x) for x in signs])
    at = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    whole = {n: np.frombuffer(b"".join(signs[i] for i in own), np.uint8).reshape(-1, n) for n, own in at.items()}
    kept = {(n, m): _fold(whole[n], m) for n in whole for m in whole if m <= n}
    row = {int(i): k for own in at.values() for k, i in enumerate(own)}
    two, out = blocks.min() != blocks.max(), []
    for i in range(len(signs)):
        for n, own in at.items():
            j = own[own > i]
            j = j[roots[j] != roots[i]]
            if two:
                j = j[blocks[j] != blocks[i]]
            room = np.minimum(sizes[j] - places[j], sizes[i] - places[i])
            j = j[room >= similarity / (1 + similarity) * (sizes[j] + sizes[i]) - _SLACK]
            if len(j):
                length = min(n, len(signs[i]))
                other = kept[n, length][np.searchsorted(own, j)]
                mine = kept[len(signs[i]), length][row[i]]
                apart = np.bitwise_count(other ^ mine).sum(axis=1)
                j = j[apart <= (1 - similarity) / (1 + similarity) * (sizes[j] + sizes[i]) + _SLACK]
                out.extend((i, int(x)) for x in j)
    return out


def _room(size_a: str, place_a: str, size_b: str, place_b: str, similarity: float) -> Column:
    """Whether two sets can be similar if this is the first shingle they share.

    Then all they share lies from its places on. A similar pair passes at its
    first common shingle, so it may be left out wherever it does not pass.
    """
    room = F.least(F.col(size_a) - F.col(place_a), F.col(size_b) - F.col(place_b))
    return room >= F.lit(similarity / (1 + similarity)) * (F.col(size_a) + F.col(size_b)) - _SLACK


def _met_in_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of members of short postings that are in different components and leave room."""
    left, right = (members.select("posting", *[F.col(c).alias(c + s) for c in ("node", "root", "size", "place")])
                   for s in ("_a", "_b"))
    return (left.join(right.hint("merge"), "posting").filter("node_a < node_b AND root_a <> root_b")
            .filter(_room("size_a", "place_a", "size_b", "place_b", similarity))
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())


def _met_in_blocks(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b (key_a, key_b: a text of each) of members of long postings, in different components, that may be similar.

    Members are dealt into blocks of bounded size; a task compares a block with
    a block, so that neither the members of a posting nor their pairs gather
    anywhere.
    """
    members = members.join(nodes.select("node", "signature", "best.text_key").hint("merge"), "node")
    need = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.octet_length("signature")) / BLOCK_BYTES)
    dealt = members.groupBy("posting").agg(F.ceil(need).alias("blocks"))
    rows = members.join(dealt.hint("merge"), "posting").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda b: F.struct(F.least("block", b).alias("low"), F.greatest("block", b).alias("high")))
    groups = (rows.withColumn("met", F.explode(pairs)).groupBy("posting", "met")
              .agg(F.collect_list(F.struct("node", "root", "size", "place", "block", "text_key", "signature")).alias("members"))
              .select("members"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            met = [np.empty((4, 0), np.int64)]
            for group in batch.column(0):
                found = pa.RecordBatch.from_struct_array(group.values)
                node, root, size, place, block, key = (found.column(c).to_numpy() for c in range(6))
                pairs = block_pairs(root, size, place, block, found.column(6).to_pylist(), similarity)
                i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
                i, j = np.where(node[i] < node[j], (i, j), (j, i))
                met.append(np.stack([node[i], node[j], key[i], key[j]]))
            return pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(met, axis=1))], ["a", "b", "key_a", "key_b"])
        return work
    return map_batches(groups, make, "a long, b long, key_a long, key_b long").distinct()


def _verified(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes; key_a, key_b: a text of each) whose whole shingle sets are similar enough."""
    def make_sets():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            return pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
        return work

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = [similar(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), similarity)
                   for x, y in zip(batch.column(2), batch.column(3))]
            return batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
        return work

    pairs, rows = stored(pairs)
    if not rows:
        return pairs.select("a", "b")
    keys, picked = pairs.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct(), 2 * rows
    if picked > MOST_SENT:
        keys, picked = stored(keys)
    wanted = texts.select("text_key", "text").join(F.broadcast(keys) if picked <= MOST_SENT else keys, "text_key", "left_semi")
    sets = map_batches(wanted.select("text"), make_sets, "node long, shingles array<long>")
    sets = sets.coalesce(-(-picked // SET_ROWS) or 1)
    half = pairs.select("a", "b").join(sets.toDF("a", "x").hint("merge"), "a").coalesce(-(-rows // SET_ROWS) or 1)
    met = half.join(sets.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y").coalesce(-(-rows // SET_ROWS) or 1)
    return map_batches(met, make, "a long, b long").distinct()


def _postings(rows: DataFrame, similarity: float) -> DataFrame:
    """posting, node, size, place: the prefixes, as far as another node of similar size has the shingle.

    The shingle at ``place`` of a set of n, if it is the first that is shared,
    leaves room for sets of up to (n - place) (1 + s) / s - n shingles; the
    nearest sizes in the posting tell whether there is any.
    """
    posted = rows.select("node", "size", F.posexplode("prefix").alias("place", "posting")).withColumn(
        "place", F.col("place").cast("long"))
    by_size = Window.partitionBy("posting").orderBy("size", "node")
    near = posted.repartition("posting").dropDuplicates(["posting", "node"]).withColumns(
        {"below": F.lag("size").over(by_size), "above": F.lead("size").over(by_size)})
    most = (F.col("size") - F.col("place")) * F.lit((1 + similarity) / similarity) - F.col("size") + _SLACK
    return near.filter((F.col("below") >= similarity * F.col("size") - _SLACK) | (F.col("above") <= most)).select(
        "posting", "node", "size", "place")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes whose fingerprints are equal or linked by positional byte postings, tally and bit check.

    Nodes of one fingerprint meet the smallest of them, which also stands for
    them where two fingerprints meet.
    """
    first, _ = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    alike = (nodes.join(first.hint("merge"), "fp").filter("node <> first")
             .select(F.col("first").alias("a"), F.col("node").alias("b")))
    left, right = first.toDF("x", "p").hint("merge"), first.toDF("y", "q").hint("merge")
    linked = (fingerprint_links(first.select("fp")).toDF("x", "y").join(left, "x").join(right, "y")
              .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    return alike.union(linked).distinct()


def similarity_links(texts: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links a, b whose components are those of all pairs of nodes at ``similarity`` or more.

    Pairs found by fingerprint come first. What these cannot reach is completed
    exactly: a pair that similar shares a shingle of both prefixes, so it meets
    in a posting. First, in turns, every member of a posting meets one drawn
    member, which joins large groups with few comparisons; then the members of
    a posting that are still in different components meet, in long postings
    block by block. Signatures rule out most pairs before whole sets are
    compared. Postings are stored once, dealt by shingle, so the turns move
    only the pairs they draw.
    """
    tried, _ = stored(fingerprint_pairs(nodes))
    roots = cut(components(_verified(texts, _possible(nodes, tried, similarity), width, similarity)))
    postings = cut(_postings(rows, similarity))
    for turn in range(TURNS):
        drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("turn"), "node", "size", "place")
        hubs = postings.groupBy("posting").agg(F.min(drawn).alias("hub"), F.count(F.lit(1)).alias("members"))
        if turn:
            hubs = hubs.filter(F.col("members") > SHORT)
        stars = (postings.join(hubs.select("posting", "hub").hint("merge"), "posting").filter("node <> hub.node")
                 .filter(_room("size", "place", "hub.size", "hub.place", similarity))
                 .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
        stars, left = stored(_apart(stars.join(tried.hint("merge"), ["a", "b"], "left_anti"), roots))
        if not left:
            break
        found = _verified(texts, _possible(nodes, stars, similarity), width, similarity)
        tried = tried.union(stars)
        roots = cut(components(_stars(roots).union(found)))

    members = postings.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = members.groupBy("posting").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"),
                                         F.max("root").alias("high")).filter("low < high").select("posting", "members")
    left, _ = stored(members.join(met.hint("merge"), "posting"))
    tried = tried.hint("merge")
    short, _ = stored(_met_in_pairs(left.filter(F.col("members") <= SHORT), similarity).join(tried, ["a", "b"], "left_anti"))
    long = _met_in_blocks(left.filter(F.col("members") > SHORT), nodes, similarity).join(tried, ["a", "b"], "left_anti")
    pairs = _possible(nodes, short, similarity).union(long).distinct()
    return _stars(roots).union(_verified(texts, pairs, width, similarity))


def _stars(roots: DataFrame) -> DataFrame:
    """A link of each node to its root: components found so far, without the links they came from."""
    return roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose members are in different components."""
    left, right = roots.toDF("a", "x").hint("merge"), roots.toDF("b", "y").hint("merge")
    named = pairs.join(left, "a", "left").join(right, "b", "left")
    return named.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                 similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar texts, the one with the smallest doc_id (then the smaller text hash).

    Texts link when the Jaccard similarity of their sets of ``width``-word
    shingles is ``similarity`` or more; no such pair is missed. Words and short
    texts as in ``simhash.fingerprints``; null and empty texts are alike. All
    columns are kept; of rows that repeat id and text one stays; an empty table
    gives no rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity lies above 0 and is 1 at most")
    content = text_or_empty(text)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("text_key"),
                        content.alias("text"))
    rows = cut(_prefixes(texts, width, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes, _ = stored(rows.groupBy("node").agg(F.min(order).alias("best"), F.first("signature").alias("signature"),
                                               F.first("size").alias("size"), F.first("fp").alias("fp")), SIGNED_ROWS)
    roots = components(similarity_links(texts, rows, nodes, width, similarity))
    winners = (nodes.join(roots.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
               .agg(F.min("best").alias("best")).select("best.doc_id", "best.text_key"))
    key = {"doc_id": F.col(doc_id).cast("long"), "text_key": F.xxhash64(content)}
    return keep_rows(docs, key, winners)
