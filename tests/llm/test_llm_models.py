"""Learned and searching operators: held-out accuracy, planted cases, and plain versions."""

import random
import re

import numpy as np
import pytest
from clipline.llm import extract, licenses, queries, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return extract.default_model()


def test_machine_learns_interactions():
    """Label 1 only where both an insult and a group are named: linear weights alone cannot tell."""
    rng = np.random.default_rng(1)
    terms = [np.array([10 * (i % 2) + 1, 20 * (i // 2 % 2) + 2, 50 + int(rng.integers(30))]) for i in range(2400)]
    labels = np.array([float(i % 2 == 1 and i // 2 % 2 == 1) for i in range(2400)])
    machine = toxicity.train(terms, labels, epochs=60)
    scores = machine.scores([[r for r in machine.place[t].tolist() if r] for t in terms])
    assert ((scores >= 0.5) == (labels > 0)).mean() > 0.99
    factors = machine.factors[:, machine.place[[11, 22]]]
    assert (factors[:, 0] * factors[:, 1]).sum() > 0.1


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels)
    found = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    assert found.predicted[found.toxic == 0].mean() < 0.01
    assert found.predicted[found.toxic == 1].mean() > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "idiot fool"), (2, None), (3, ""), (None, "nice day"), (1, "idiot fool"), (5, "idiot " * 50_000)],
                                 "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    empty = toxicity.score_documents(docs.filter("false"), labels.filter("false"))
    assert empty.columns == ["doc_id", "held_out", "score", "predicted"] and not empty.collect()


def test_messages_give_exact_marginals():
    nodes = extract.parse("<div><p>a</p><ul><li>b</li></ul></div><p>c")
    names = extract.features(nodes)[0]
    rng = np.random.default_rng(0)
    unary, edges = rng.normal(0, 1, len(nodes)), rng.normal(0, 1, (3, 2, 2))
    forest = extract.plant([(nodes, names)], {})
    beliefs, _ = extract.propagate(forest, unary, edges)
    weights = np.zeros((2, len(nodes)))
    for code in range(1 << len(nodes)):
        y = [code >> i & 1 for i in range(len(nodes))]
        score = sum(u * v for u, v in zip(unary, y)) + sum(
            edges[forest.kind[i], y[n.parent], y[i]] for i, n in enumerate(nodes) if n.parent >= 0)
        for i, v in enumerate(y):
            weights[v, i] += np.exp(score)
    assert np.allclose(np.exp(beliefs), (weights / weights.sum(axis=0)).T)


def test_extraction_of_other_labelled_pages(model):
    rng, wrong, blocks = random.Random(77), 0, 0
    for _ in range(150):
        nodes = extract.parse(extract.labelled_page(rng))
        marginals, truth = model.marginals([(nodes, extract.features(nodes)[0])]), extract.truth(nodes)
        for i, node in enumerate(nodes):
            if node.parts is not None:
                blocks += 1
                wrong += (marginals[i] >= 0.5) != truth[i]
    assert wrong < 0.02 * blocks


def test_extraction_cases(model):
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
            '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy now.</div><article><h1>Head &amp; tail</h1>'
            "<p><b>One\n two&nbsp;three<br><p>Four &lt;five&gt; &copy;.</p><script>no()</script><p></p></article>"
            '<section class="comments"><p>First!</p></section><form><p>Your name</p></form><footer>&copy; Us</footer></body></html>')
    assert extract.main_text(model, [page, "", "<nav><a href=x>only menu</a></nav>"]) == [
        "Head & tail\nOne two three\nFour <five> ©.", "", ""]
    deep = "<div>" * 3000 + "<p>Some words in a deep place.</p>"
    assert len(extract.main_text(model, [deep, "<p <<a href='x>&#xZ;"])) == 2


def test_extraction_of_pages(spark, model):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    more = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (None, "u", "<article><p>x y</p></article>")], rows.schema)
    found = extract.extract_pages(rows.union(more).withColumn("text", F.lit("x")), model).collect()
    raw = {r.page_id: r.html for r in rows.collect()}
    import html as h
    for r in found:
        assert r.n_chars == len(r.text)
        if r.page_id is None or r.page_id < 0:
            assert r.text == ("x y" if r.page_id is None else "")
            continue
        inner = re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1])
        blocks = (" ".join(h.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
    assert not extract.extract_pages(rows.filter("false"), model).collect()


def plain_align(template, words):
    """Full local alignment; the best score."""
    best, above = 0, [0] * (len(words) + 1)
    for a in template:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, above[j] + (1 if a == b and a > 0 else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, max(row)), row
    return best


def test_banded_alignment_finds_the_best():
    rng = random.Random(3)
    for _ in range(60):
        template = [rng.randint(1, 30) for _ in range(rng.randint(5, 30))]
        words = [0] * 7 + template + [0] * 5
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(7, len(words) - 5)
            words[at:at + 1] = rng.choice([[], [0], [words[at], 0]])
        matched, first, end = licenses.align(template, np.array(words), 7 - 8, 7 + 8)
        assert matched <= len(template) and 0 <= first < end <= len(words)
        assert plain_align(template, words) <= matched


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("free of charge, ", "").replace("merge", "fuse")
    rows = [(1, f"Some text. {mit} More text."), (2, changed), (3, None), (4, ""), (5, "MIT is a place; released under pressure."),
            (6, "x " * 30_000 + "Released under the MIT License. " + "y " * 10 + "RELEASED under the mit license!"), (6, "released under the MIT License"),
            (None, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", F.lit("x"))
    found = licenses.scan_licenses(docs).collect()
    texts = {d: t for d, t in rows if d not in (6,)}
    by = {(r.doc_id, r.template): r for r in found if r.doc_id != 6}
    assert {k for k in by} == {(1, "mit"), (2, "mit"), (None, "cc-by-nc-4.0-line")}
    assert by[1, "mit"].coverage == 1.0 and texts[1][by[1, "mit"].start:by[1, "mit"].end] == mit
    assert 0.9 < by[2, "mit"].coverage < 1.0
    assert sum(r.doc_id == 6 for r in found) == 3
    assert not licenses.scan_licenses(docs.filter("false")).collect()


def test_license_scan_of_documents(spark):
    """Every statement that occurs word for word is found, whole, and nothing else."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {(r.doc_id, r.template, r.start) for r in licenses.scan_licenses(rows).collect()}
    short = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("-line")}
    wanted = {(r.doc_id, n, m.start()) for r in rows.collect() for n, t in short.items() for m in re.finditer(re.escape(t), r.text)}
    assert wanted and found == wanted


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        if name != "mixing":
            assert after.count() == after.dropDuplicates(["doc_id"]).count() <= before.count()
        before = after
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, empty, SF).collect()


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
