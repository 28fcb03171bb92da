"""The near-copy stage against all pairs compared."""

import random

import corpus_pipeline
import numpy as np
from clipline.llm import near
from pyspark.sql import functions as F


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    sets = {d: plain_shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    pairs = []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append(both / max(1, len(sets[a] | sets[b])))
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in sets if find(d) == d}, pairs


def made_rows():
    rng, rows = random.Random(7), []
    line = "all rights are kept by the makers of this page and nobody else may copy it"
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(40, 400))]
        rows.append(" ".join(base))
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
            rows.append(" ".join(copy))
    rows += [line + f" {i} {i + 1} {i + 2}" for i in range(20)] + [None, "", "One two", "one  TWO", "one two three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_drops_every_near_copy(spark):
    rows = made_rows()
    wanted, pairs = plain_kept(rows)
    assert sum(p < 0.85 for p in pairs) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_prefixes_of_similar_sets_meet():
    assert [near.prefix_length(n, 0.8) for n in (0, 1, 4, 5, 10, 100)] == [0, 1, 1, 2, 3, 21]


def test_signatures_only_rule_out_what_is_less_similar():
    rng, ruled_out = np.random.default_rng(3), 0
    for _ in range(400):
        pool = np.unique(rng.integers(0, 2 ** 63, 700, dtype=np.uint64))
        n, share = int(rng.integers(1, 600)), rng.random() * 0.3
        a = pool[:n]
        b = np.unique(np.concatenate([a[rng.random(n) >= share / 2], pool[n:n + int(n * share / 2)]]))
        can = near.can_be_similar(near.signature(a), near.signature(b), len(a), len(b), 0.8)
        assert can or not near.similar(a, b, 0.8)
        ruled_out += not can
    assert ruled_out
    c, d = pool[:300], pool[300:600]
    assert not near.can_be_similar(near.signature(c), near.signature(d), 300, 300, 0.8)


def test_long_postings_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near, "TURNS", 1)
    monkeypatch.setattr(near, "SHORT", 3)
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near.drop_similar(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(plain_kept(rows)[0])


def test_block_pairs_leave_out_only_what_is_less_similar():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 2 ** 63, int(rng.integers(5, 300)), dtype=np.uint64))
        for _ in range(6):
            fresh = rng.integers(0, 2 ** 63, len(base), dtype=np.uint64)
            sets.append(np.unique(np.where(rng.random(len(base)) < rng.random() * 0.2, fresh, base)))
    sizes, n = np.array([len(s) for s in sets]), len(sets)
    zero = np.zeros(n, dtype=np.int64)
    for blocks in (zero, np.arange(n) % 2):
        found = set(near.block_pairs(np.arange(n), sizes, zero, blocks, [near.signature(s) for s in sets], 0.8))
        true = {(i, j) for i in range(n) for j in range(i + 1, n) if near.similar(sets[i], sets[j], 0.8)
                and (not blocks.any() or blocks[i] != blocks[j])}
        assert true <= found and len(found) < n * (n - 1) // 4


def test_stage_goes_through_fingerprint_postings(spark, monkeypatch):
    """Without the exact completion, links come from byte postings, tally and bit check, and each is similar."""
    monkeypatch.setattr(near, "_postings", lambda rows, similarity: rows.selectExpr(
        "node AS posting", "node", "size", "0L AS place").filter("false"))
    rows = made_rows()
    sets = {d: plain_shingles(t) for d, t in rows}
    kept = {r.doc_id for r in near.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact, pairs = plain_kept(rows)
    assert exact < kept and len(kept) < len(rows) - 10
    assert {d for d, s in sets.items() if not s} & kept == {min(d for d, s in sets.items() if not s)}
