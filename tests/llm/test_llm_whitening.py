"""Whitening against a plain version with exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from clipline.llm import whitening
from pyspark.sql import functions as F


def plain(vectors):
    """n, deviations, covariance (floats rounded once) of lists of numbers."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(v[i] for v in x) for i in range(d)]
    y = [[n * v[i] - sums[i] for i in range(d)] for v in x]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in y), n ** 3)) for j in range(d)] for i in range(d)])
    return n, [sum(c * c for c in v) for v in y], cov, np.array(y, dtype=float) / n


def check(found, ids, vectors):
    n, deviations, cov, centred = plain(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    rows = {}
    for r in found:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert set(rows) == set(ids) and all(sorted(r) == list(range(1, len(values) + 1)) for r in rows.values())
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-4
    for at, (vec, deviation) in enumerate(zip(ids, deviations)):
        for k, r in rows[vec].items():
            assert r.n == n and int(r.deviation) == deviation
            assert abs(r.explained - values[k - 1] / np.trace(cov)) < 1e-9
    for k in range(len(values)):
        own = np.array([rows[v][k + 1].whitened for v in ids])
        if values[k] > 1e-9 * np.trace(cov):
            wanted = centred @ axes[:, k] / np.sqrt(values[k])
            assert min(np.abs(own - wanted).max(), np.abs(own + wanted).max()) < 1e-5
        else:
            assert not own.any()
    has = [k for k in range(len(values)) if values[k] > 1e-9 * np.trace(cov)]
    w = np.array([[rows[v][k + 1].whitened for k in has] for v in ids])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(len(has))).max() < 1e-4


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"component": F.lit(1), "vector": F.lit("x"), "whitened": F.lit(2)}).repartition(4)


def test_equals_the_plain_version(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 12)) @ mixed * 0.1)]
    bad = [(-1, None), (-2, []), (-3, [None] * 12), (-4, [float("nan")] * 12), (-5, [float("inf")] + [0.0] * 11),
           (-6, [0.5] * 3), (-7, [1e30] * 12)]
    found = whitening.whiten(table(spark, rows + bad)).collect()
    check(found, [i for i, _ in rows], [v for _, v in rows])


@pytest.mark.parametrize("scale", [1e-3, 1e4, 1e9])
def test_exact_at_every_size_of_entries(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate((rng.normal(size=(60, 9)) + 3) * scale)]
    check(whitening.whiten(table(spark, rows)).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_few_dimensions_no_variance_and_no_rows(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(40)]
    check(whitening.whiten(table(spark, rows)).collect(), [i for i, _ in rows], [v for _, v in rows])
    for one in ([(1, [0.25, 0.5])], [(1, [0.25, 0.5]), (2, [0.25, 0.5])]):
        found = whitening.whiten(table(spark, one)).collect()
        assert len(found) == 2 * len(one)
        assert {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in found} == {(0.0, 0.0, 0.0, 0)}
    empty = whitening.whiten(table(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.75, 0.125]), (None, [0.1, 0.9]), (4, [0.3, 0.3])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert len(found) == 10 and {r.n for r in found} == {5}


def test_wide_sums_are_exact():
    rng = np.random.default_rng(3)
    z = rng.integers(-2 ** 46, 2 ** 46, (50, 3))
    exact = [[int(v) for v in row] for row in z]
    wanted = [sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in exact) for i in range(3) for j in range(i, 3)]
    assert whitening.pair_squares(z) == wanted
    assert whitening.whole_sums(z << 14) == [sum(r[i] << 14 for r in exact) for i in range(3)]


def test_registered_query(spark):
    from clipline.llm import queries
    folder = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(queries.op12_whitening(spark, folder).collect(), [r.vec_id for r in known], [r.embedding for r in known])
