"""Bottom-k fingerprints against a plain version."""

import hashlib
import random

import pytest
import xxhash
from clipline.llm import sketches
from pyspark.sql import functions as F

KEPT = sketches.KEPT


def plain_sketch(text, kept=KEPT):
    words, w = [""] * 4, ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] * bool(w)
            w = ""
        else:
            w += c
    hashes = set()
    for i in range(len(words) - 4):
        h = 42
        for word in words[i:i + 5]:
            h = xxhash.xxh64(word.encode(), seed=h).intdigest()
        hashes.add(h - (1 << 64) * (h >> 63))
    return sorted(hashes)[:kept], hashes


def plain_likeness(a, b, kept=KEPT):
    both = sorted(set(a) | set(b))[:kept]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def plain_rows(rows, kept=KEPT):
    """From (doc_id, text): what fingerprint_documents says, by doc_id."""
    def order(r):
        h = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        return (r[0] is None, -(r[0] or 0), h - (1 << 64) * (h >> 63))
    rows, out = sorted(rows, key=order), []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (plain_sketch(t, kept)[0] for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(a), digits(b),
                    plain_likeness(a, b, kept), plain_likeness(a, c, kept)))
    return sorted(out, key=str)


def digits(a):
    return "".join(f"{h % (1 << 64):016x}" for h in a)


def found_rows(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r[n] for n in names) for r in df.select(names).collect()), key=str)


def made():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "🙂", "ß"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 40, 400]))) for _ in range(150)]
    rows = [(i * i * (-1) ** i, t) for i, t in enumerate(texts)]
    rows += [(10 ** 15, texts[3]), (-(2 ** 63), "a b"), (2 ** 63 - 1, "\t x\x0b\ny "), (7, None), (8, ""), (9, "\n \n"), (10, "é")]
    rows += [(None, texts[5]), (None, texts[6]), (5000, texts[7]), (5000, texts[8]), (5000, texts[8]), (6000, texts[9] * 30)]
    return rows


@pytest.mark.parametrize("chunks", [1, 7, 400])
def test_documents_equal_the_plain_version_in_any_number_of_chunks(spark, chunks):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"key": F.lit("x"), "sketch": F.lit(1), "chunk": F.lit(2)}).repartition(5)
    found = sketches.fingerprint_documents(docs, chunks=chunks)
    assert found_rows(found) == plain_rows(rows)
    by_text = {}
    for r in found.join(docs.select("doc_id", "text").distinct(), "doc_id").filter("doc_id <> 5000").collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint


def test_one_row_no_rows_and_many_equal_rows(spark):
    for rows in ([(3, "one two three four five six")], [], [(3, "a b")] * 40 + [(4, "c d e")] * 40):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found_rows(sketches.fingerprint_documents(docs)) == plain_rows(rows)


def test_estimates_come_near_the_truth(spark):
    rng = random.Random(8)
    base = [f"t{rng.randrange(10 ** 6)}" for _ in range(4000)]
    rows = [(i, " ".join(base), " ".join(base[:n])) for i, n in enumerate((100, 1000, 2000, 4000))]
    df = spark.createDataFrame(rows, "i int, a string, b string").select(
        "i", sketches.sketch(F.col("a")).alias("x"), sketches.sketch(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    for r in df.select("i", sketches.resemblance(x, y).alias("j"), sketches.containment(y, x).alias("c"),
                       sketches.containment(x, y).alias("part"), sketches.distinct_shingles(y).alias("n")).collect():
        n = (100, 1000, 2000, 4000)[r.i]
        assert abs(r.j - n / 4000) < 0.13 and abs(r.part - n / 4000) < 0.2 and r.c > 0.7
        assert abs(r.n - n) < 0.3 * n and (n > KEPT or r.n == n)


def test_parts_merge_to_the_sketch_of_the_whole(spark):
    rng = random.Random(2)
    hashes = {k: [rng.getrandbits(63) for _ in range(2000)] for k in ("a", None)}
    parts = [(k, sorted(set(h[i::7]))[:KEPT]) for k, h in hashes.items() for i in range(7)] * 3 + [("none", []), ("void", None)]
    df = spark.createDataFrame(parts, "k string, sketch array<bigint>").repartition(6)
    found = {r.k: r.sketch for r in sketches.merge_sketches(df, ["k"]).collect()}
    assert found == {k: sorted(h)[:KEPT] for k, h in hashes.items()} | {"none": [], "void": []}


def test_only_native_operators_and_one_shuffle_of_texts(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = sketches.fingerprint_documents(docs)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Python" not in main and "Arrow" not in main and "Pandas" not in main
    assert main.count("Exchange hashpartitioning") == 1
