"""The factorization machine: pairs without evidence of their single terms, and its sums against plain loops."""

import numpy as np
from clipline.llm import toxicity
from pyspark.sql import functions as F


def made(n, seed, label):
    """Documents of 20 of 300 common words; two more words, each in half of them, decide the label together."""
    rng = np.random.default_rng(seed)
    words, texts, labels = [f"word{i}" for i in range(300)], [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = list(rng.choice(words, 20, replace=False)) + ["lorem"] * a + ["ipsum"] * b
        rng.shuffle(own)
        texts.append(" ".join(own))
        labels.append(float(label(a, b)))
    return texts, np.array(labels)


def scores_of(train, test):
    terms = toxicity.Terms()
    machine = toxicity.train([np.array(terms.of(t)) for t in train[0]], train[1])
    rows = toxicity.Terms(machine.place.tolist())
    return machine.scores([rows.of(t) for t in test[0]]), machine


def test_a_label_that_only_the_pair_tells_is_learned():
    for label in (lambda a, b: a != b, lambda a, b: a == b):
        scores, machine = scores_of(made(1500, 1, label), made(500, 2, label))
        wanted = made(500, 2, label)[1]
        assert len(machine.weights) - 1 < 40
        assert ((scores >= 0.5) == (wanted > 0)).mean() >= 0.9


def test_chance_pairs_are_not_kept():
    rng = np.random.default_rng(3)
    texts, _ = made(1500, 4, lambda a, b: a)
    terms = toxicity.Terms()
    assert toxicity.telling_pairs([np.array(terms.of(t)) for t in texts], (rng.random(1500) < 0.1).astype(float)) == []
    assert toxicity.telling_pairs([], np.zeros(0)) == []
    assert toxicity.telling_pairs([np.zeros(0, np.int64)] * 9, np.array([1.0] * 5 + [0.0] * 4)) == []


def test_logits_equal_a_loop_over_all_pairs_of_terms():
    rng = np.random.default_rng(5)
    weights, factors = rng.normal(size=50), rng.normal(size=(toxicity.FACTORS, 50))
    docs = [rng.choice(50, n, replace=False) for n in (0, 1, 2, 7, 30)]
    found = toxicity._logits(0.25, weights, factors, np.concatenate(docs), np.array([len(d) for d in docs]))[0]
    for doc, logit in zip(docs, found):
        wanted = 0.25 + sum(weights[i] for i in doc)
        for x in range(len(doc)):
            for y in range(x):
                wanted += sum(factors[k, doc[x]] * factors[k, doc[y]] for k in range(toxicity.FACTORS))
        assert abs(wanted - logit) < 1e-9


def test_repeated_ids_are_learned_alike_in_any_order(spark):
    rows = [(i % 60, f"text {i % 7} number {i % 60} {'bad' if i % 60 < 20 else 'good'} {i // 60}") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = toxicity.fit(docs.repartition(7), labels)
    two = toxicity.fit(docs.orderBy(F.desc("text")).repartition(3), labels)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.place, two.place)
