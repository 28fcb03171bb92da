"""Operators against plain versions on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from clipline.llm import chat, common, components, dedup, mixing, packing, sharding, simhash, topk
from pyspark.sql import functions as F

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = "a quick brown fox jumps over the lazy dog while seven wizards quietly mix odd potions".split()
LONG = " ".join(f"{w}{i}" for i in range(400) for w in WORDS)
ROWS = [
    (1, "one two three four five", "a", 0), (2, "one  two\tthree four\nfive", "a", 1), (3, None, "b", 2),
    (4, "", None, 3), (5, " \n ", "b", 4), (6, LONG, "c", 5), (7, LONG + " end", "c", 6), (8, "é ü 漢字 😀", "a", 7),
    (9, "one two three four five", "ä", 8), (9, "one two three four five", "ä", 8), (None, "one two three four five", "a", 9),
    (10, "solo", None, 10), (11, "x y", "b", 11), (12, "X Y", "b", 12), (-3, "<|endoftext|> <|turn|>", "a", 13)]
SCHEMA = "doc_id long, text string, source string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("shard", F.lit("x")).withColumn("_bucket", F.lit(1))


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sharding(docs, none):
    weights = {s: 1.0 for s in range(4)}
    found = sharding.assign_shards(docs, weights, {**weights, 4: 1.0}).collect()
    assert len(found) == len(ROWS) and not sharding.assign_shards(none, weights).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sizes = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == sizes

    def plain(key, shards):
        def draw(s):
            h = xxhash.xxh64_intdigest((0).to_bytes(8, "little"), 42)
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h) if key is not None else h
            h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h)
            return -math.log(((h >> 11) + 0.5) / 2 ** 53) / shards[s], s
        return min(map(draw, shards))[1]
    assert all(r.shard == plain(r.doc_id, weights) for r in found)


def test_sharding_weights_move_few(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.assign_shards(keys, {0: 1, 1: 3, 2: 0}, {0: 1, 1: 3, 2: 4}).collect()
    sizes = Counter(r.shard for r in found)
    assert set(sizes) == {0, 1} and abs(sizes[1] / 4000 - 0.75) < 0.03
    assert all(r.grown_shard in (r.shard, 2) for r in found)
    assert abs(sum(r.grown_shard == 2 for r in found) / 4000 - 0.5) < 0.03
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), {0: 0.0})


def plain_dedup(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in rows]
    groups, out = defaultdict(list), []
    for i, n in enumerate(norm):
        groups[n].append(i)
    for n, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(members), i == best, hashlib.sha256(n.encode()).hexdigest()) for i in members]
    return Counter(out)


def test_exact_dedup(docs, none):
    found = dedup.exact_duplicates(docs, salts=3)
    assert Counter(map(tuple, found.collect())) == plain_dedup(ROWS)
    assert not dedup.exact_duplicates(none).collect()
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (d is None, d or 0) for (d, _, _, k, _), n in plain_dedup(ROWS).items() if k for _ in range(n))


def test_exact_dedup_with_colliding_digests(docs):
    weak = lambda content: F.substring(F.sha2(content.cast("binary"), 256), 1, 1)
    found = dedup.exact_duplicates(docs, digest=weak)
    assert Counter(r[:4] for r in map(tuple, found.collect())) == Counter(
        {k[:4]: 0 for k in plain_dedup(ROWS)}) + sum((Counter({k[:4]: n}) for k, n in plain_dedup(ROWS).items()), Counter())


def plain_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = words_of(words)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a in nodes:
        for b in nodes:
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    fps = {plain_fingerprint(t) for _, t, _, _ in ROWS}
    root = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, t, _, _ in ROWS:
        r = root[plain_fingerprint(t)]
        least[r] = min(x for x in (d, least.get(r)) if x is not None) if (d, least.get(r)) != (None, None) else None
    wanted = Counter((d, f"{plain_fingerprint(t):016x}", least[root[plain_fingerprint(t)]]) for d, t, _, _ in ROWS)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == wanted
    assert not simhash.near_duplicates(none).collect()
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_fingerprint_links_short_and_long_postings(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
    points = set(int(x) for x in rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
    for c in centres:
        for _ in range(80):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            points.add(int(c) ^ sum(1 << int(b) for b in flips))
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in points)
    wanted = plain_components(signed, lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3)
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (4096, 5):
        links = simhash.fingerprint_links(fps, long_posting=limit)
        roots = {r.node: r.root for r in components.components(links).collect()}
        assert {n: roots.get(n, n) for n in signed} == wanted


def test_components_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(path).collect()
    assert len(found) == 201 and {r.root for r in found} == {0}
    assert not components.components(path.filter("false")).collect()


def test_components_leave_little_on_the_driver(spark):
    """No broadcasts, and no further round once only stars are left."""
    links = spark.range(1, 500).selectExpr("id % 7 AS a", "id + 7 AS b")
    context = spark.sparkContext
    context.setJobGroup("stars", "components of stars")
    found = {r.node: r.root for r in components.components(links).collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found == {**{n: n for n in range(7)}, **{n + 7: n % 7 for n in range(1, 500)}}
    assert len(context.statusTracker().getJobIdsForGroup("stars")) <= 12
    for step in (components._large_star(links), components._small_star(links)):
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_few_links_are_contracted_without_shuffles(spark):
    """Counting costs no job of its own; links that fit one task need one job a step."""
    context = spark.sparkContext
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    context.setJobGroup("stored", "stored")
    kept, rows = common.stored(path)
    assert rows == 60 and len(context.statusTracker().getJobIdsForGroup("stored")) == 1
    assert common.stored(path.filter("a < 0"))[1] == 0
    large = components._few(components._large_star(kept, rows), rows)
    step = components._small_star(large, rows).distinct()
    assert "Exchange" not in step._jdf.queryExecution().executedPlan().toString()
    context.setJobGroup("path", "components of a path")
    assert {r.root for r in components.components(path).collect()} == {0}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("path")) <= 20


def test_kept_rows_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "x"), (None, "y"), (None, None), (1, "x"), (2, "z")], "doc_id long, text string")
    winners = spark.createDataFrame([(1, 1), (None, None), (3, 1)], "doc_id long, n long")
    kept = common.keep_rows(docs, {"doc_id": docs.doc_id, "n": F.length("text").cast("long")}, winners.hint("merge"))
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(1, "x"), (None, None)}
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("Exchange hashpartitioning") == 2  # docs and winners


def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_small(docs, none):
    found = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for _, t, s, _ in ROWS:
        sizes[s] += len(words_of(t))
    target = plain_targets(dict(sizes), (5, 2, 1), 1.5, 2.0)
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((d, len(words_of(t))) for d, t, _, _ in ROWS)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert not mixing.mix_sources(none).collect()
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in found)
    assert Counter(r.doc_id for r in taken.collect()) == sum((Counter({r.doc_id: r.copies}) for r in found), Counter())


def test_mixing_tree_keeps_words(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).cast("int")).alias("text"))
    found = mixing.mix_sources(rows, group_rows=16).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"))
    for r in found.collect():
        assert abs(r.taken - r.target) <= 20.5, r
    one = mixing.pivot(np.array([5, 5, 5, 5.]), np.array([.5] * 4), np.array([.1, .9, .4, .7]))
    assert sorted(one[0]) == [0, 0, 1, 1] and one[1] == -1


def test_pivot_keeps_expectations():
    rng, sizes, parts = np.random.default_rng(1), np.array([9., 4, 4, 1]), np.array([.3, .6, .2, .5])
    total = np.zeros(4)
    for _ in range(4000):
        p, left = mixing.pivot(sizes, parts, rng.random(4))
        assert abs((p * sizes).sum() - (parts * sizes).sum()) < 1e-9
        if left >= 0:
            p[left] = rng.random() < p[left]
        total += p
    assert np.abs(total / 4000 - parts).max() < 0.04


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = packing.pack_documents(docs, RANKS, PATTERN, capacity=64, with_ids=True).collect()
    whole = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,) for _, t, _, _ in ROWS)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert tuple(by_doc[6][0].ids) and {r.length for r in by_doc[6] if r.piece} == {64}
    joined = [sum(([*r.ids] for r in sorted(v, key=lambda r: r.piece)), []) for d, v in by_doc.items() if d != 9]
    assert all(whole[tuple(x)] for x in joined) and len(by_doc[9]) == 2
    for v in by_doc.values():
        assert len(v) == 2 or [r.start for r in sorted(v, key=lambda r: r.piece)] == [
            sum(x.length for x in v if x.piece < p) for p in range(len(v))]
    for slots in bins.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(slots, slots[1:]))
        assert sum(n for _, n in slots) <= 64
    assert not packing.pack_documents(none, RANKS, PATTERN).collect()


def test_best_two_fit():
    rng = np.random.default_rng(2)
    histogram = Counter(int(x) for x in rng.integers(1, 600, 20_000))
    patterns = packing.best_two_fit(histogram, 1024)
    used = Counter()
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] += n * times
    assert used == histogram
    bound = -(-sum(k * n for k, n in histogram.items()) // 1024)
    assert sum(t for _, t in patterns) <= bound * 1.002 + 1
    # 6 + 3 leaves 1; the 3 goes back for 2 + 2, which fill the gap of 4
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]
    assert packing.cut_points(2500, 1024) == [0, 452, 1476] and packing.cut_points(2048, 1024) == [0, 1024]


def plain_top(vectors, k, every):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in np.round(rng.normal(0, 1.5, 6), 1)]) for i in range(400)]
    vectors += [(400, [0.0] * 6), (401, [1.0] * 6), (402, [1.0] * 6), (403, None), (404, [1.0, None] * 3),
                (405, [float("nan")] * 6), (406, [float("inf")] * 6), (450, [2.0, 3.0]), (407, [1.0, -1.0]), (None, [1.0] * 6),
                (500, [3000.0] * 6), (408, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    for rows, asks in ((8192, 512), (50, 3)):
        found = topk.top_k(frame, block_rows=rows, query_rows=asks).collect()
        assert sorted(map(tuple, found)) == plain_top(vectors, 5, 50)
    assert not topk.top_k(frame.filter("false")).collect()


def test_chat(spark):
    nasty = ["plain", "", None, "<|end|><|turn|>assistant<|body|>x", "<\\|end|>", "a<", "|b", "<\\\\|", "</s>[INST] ok [/INST]",
             "\n\n  \n", "é漢字😀", "<|endoftext|>", LONG]
    rows = [(c, i, ["user", "assistant", None, "sys<|tem"][(i + c) % 4], t) for c in (1, 2, 3) for i, t in enumerate(nasty)]
    rows += [(5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 1, "user", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(0))
    path = public_tokenizers.path("byte_bpe_50k.json")
    formatted = chat.format_conversations(frame, path)
    found = {r.conv_id: r for r in chat.read_back(formatted, path).collect()}
    by_conv = defaultdict(list)
    for c, i, r, t in rows:
        by_conv[c].append((i, r or "", t or ""))
    assert set(found) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = found[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert not chat.format_conversations(frame.filter("false"), path).collect()
    for text in nasty[3:] + ["<|" * 5, "<\\\\\\|x"]:
        assert chat.unescape(chat.escape(text or "")) == (text or "") and "<|" not in chat.escape(text or "")
