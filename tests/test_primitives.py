"""Ordered windows, range joins, order statistics and walks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipline.operators import ordered as O
from clipline.operators.audio import _fft_peak, autocorr_peak
from clipline.operators.curves import adaptive_sample, detect_cuts, sample_by_count
from clipline.operators.chunks import borders, search
from clipline.operators.ranges import overlapping, points_in_spans
from clipline.operators.walks import chunk_size, run_walk, sparse_walk


def _rows(seed=1, keys=3, n=40):
    rng = random.Random(seed)
    return [(k, i, float(rng.randint(0, 9)), t) for k in range(keys)
            for i, t in enumerate(sorted(rng.sample(range(1000), n if k else n * 2)))]


@pytest.mark.parametrize("dense", [True, False])
def test_ordered_across_chunks(spark, small_chunks, dense):
    data = _rows()
    df = spark.createDataFrame(data, "video_id int, idx long, v double, t long")
    got = O.ordered(
        df, ["video_id"], ["idx" if dense else "t"], dense=dense, number="nr",
        running={"run": ("sum", F.col("v")), "top": ("max", F.col("v"))}, before={"past": ("sum", F.col("v"))},
        after={"low": ("min", F.col("v"))}, lag={"p": F.col("v")}, lead={"f": F.col("v")}).collect()
    by_key = {}
    for k, i, v, t in data:
        by_key.setdefault(k, []).append(v)
    assert len(got) == len(data)
    for r in got:
        vs, i = by_key[r.video_id], r.idx
        assert (r.nr, r.run, r.top) == (i, sum(vs[: i + 1]), max(vs[: i + 1]))
        assert r.past == (sum(vs[:i]) if i else None)
        assert r.low == (min(vs[i + 1:]) if i + 1 < len(vs) else None)
        assert r.p == (vs[i - 1] if i else None) and r.f == (vs[i + 1] if i + 1 < len(vs) else None)


def test_islands_across_chunks(spark, small_chunks):
    data = [(0, i, float(x)) for i, x in enumerate([1] * 20 + [2] * 3 + [1] + [2] * 17)] + [(1, 0, 5.0)]
    df = spark.createDataFrame(data, "video_id int, idx long, v double")
    got = O.islands(df, ["video_id"], ["idx"], dense=True, values={"v": F.col("v")},
                    together=lambda a, b: a["v"] == b["v"]).collect()
    want = {(0, i): 1 + (i >= 20) + (i >= 23) + (i >= 24) for i in range(41)}
    want[(1, 0)] = 1
    assert {(r.video_id, r.idx): r.island for r in got} == want


@pytest.mark.parametrize("exact_below", [1_000_000, 50])
def test_percentiles(spark, exact_below):
    rng = random.Random(3)
    data = [(k, float(rng.choice([0, 0, 0, rng.random()]))) for k in range(3) for _ in range(1 if k == 2 else 700)]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r.k: r for r in O.percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}, exact_below=exact_below).collect()}
    near = {r.k: r for r in O.nearest_rank(df, ["k"], "v", {"t": 75.0}, exact_below=exact_below).collect()}
    for k in range(3):
        vs = sorted(v for kk, v in data if kk == k)
        for name, p in (("a", 25), ("b", 50), ("c", 90)):
            assert got[k][name] == pytest.approx(np.percentile(vs, p))
        assert near[k].t == vs[min(int(len(vs) * 75 / 100), len(vs) - 1)]


@pytest.mark.parametrize("levels", [1, 3])
def test_points_in_spans(spark, levels):
    rng = random.Random(5)
    pts = [(rng.randint(0, 1), rng.randint(0, 400) / 2) for _ in range(80)]
    spans = [(rng.randint(0, 1), i, s, s + rng.choice([0, 0.5, 3, 150])) for i in range(40) for s in [rng.randint(0, 300) / 2]]
    p = spark.createDataFrame(pts, "video_id int, t_s double").distinct()
    s = spark.createDataFrame(spans, "video_id int, i int, a double, b double")
    got = sorted((r.video_id, r.t_s, r.i) for r in points_in_spans(
        p, s, ["video_id"], "t_s", "a", "b", bucket=1.0, levels=levels).collect())
    assert got == sorted((k, t, i) for k, t in set(pts) for kk, i, a, b in spans if k == kk and a <= t <= b)


def test_overlapping_keeps_each_pair_once(spark):
    rng = random.Random(6)
    left = [(0, i, s, s + rng.choice([0.5, 4, 60])) for i in range(30) for s in [rng.randint(0, 200) / 2]]
    right = [(0, i, s, s + rng.choice([0.0, 1, 20])) for i in range(30) for s in [rng.randint(0, 200) / 2]]
    got = sorted((r.i, r.j) for r in overlapping(
        spark.createDataFrame(left, "video_id int, i int, a double, b double"),
        spark.createDataFrame(right, "video_id int, j int, c double, d double"),
        ["video_id"], ("a", "b"), ("c", "d"), bucket=2.0).collect())
    assert got == sorted((i, j) for _, i, a, b in left for _, j, c, d in right if max(a, c) < min(b, d))


def _curve(spark, values, video=1):
    return spark.createDataFrame([(video, i, i / 2.0, float(v)) for i, v in enumerate(values)],
                                 "video_id int, idx long, t_s double, value double")


@pytest.mark.parametrize("chunk", [None, 16])
def test_detect_cuts(spark, chunk):
    rng = random.Random(7)
    values = [rng.choice([0, 10, 30, 27]) for _ in range(150)]
    want, last = [0], 0
    for i in range(1, len(values)):
        if values[i] >= 27 and i - last >= 5:
            want.append(i)
            last = i
    got = sorted(r.idx for r in detect_cuts(_curve(spark, values), 27.0, 5, chunk=chunk).collect())
    assert got == want


@pytest.mark.parametrize("chunk", [None, 32])
def test_adaptive_sample(spark, chunk):
    rng = random.Random(8)
    diff = [rng.random() for _ in range(200)]
    threshold = sorted(diff)[min(int(len(diff) * 0.75), len(diff) - 1)]
    want, i = [], 0
    while i < len(diff) + 1:
        want.append(i)
        top = max(diff[i - 1] if i else 0.0, diff[i] if i < len(diff) else 0.0)
        i += 5 if top > threshold else 30
    got = sorted(r.frame_index for r in adaptive_sample(_curve(spark, diff), chunk=chunk).collect())
    assert got == want


def test_sample_by_count_on_a_flat_curve(spark):
    curve = _curve(spark, [1.0] * 20)
    videos = spark.createDataFrame([(1, 2.0, 21)], "video_id int, fps double, n_frames long")
    none = spark.createDataFrame([], "video_id int, t_s double")
    got = sorted(r.frame_index for r in sample_by_count(curve, none, videos, 5).collect())
    assert got == [0, 5, 10, 15, 20]
    assert sample_by_count(curve, none, videos, 0).count() == 0


def test_autocorrelation_long_path_matches_numpy(spark):
    rng = np.random.default_rng(9)
    values = np.abs(np.sin(np.arange(300) / 4.0)) + rng.random(300) / 5
    x = values / (values.max() + 1e-10)
    x = x - x.mean()
    corr = np.correlate(x, x, mode="same")
    corr = corr / (corr.max() + 1e-10)
    want = float(np.max(corr[len(corr) // 2 + 20: -20]))
    assert _fft_peak(values) == pytest.approx(want)
    curve = _curve(spark, values.tolist())
    for limit in (1 << 20, 100):
        got = autocorr_peak(curve, whole_below=limit).first().pulse_regularity
        assert got == pytest.approx(want)


@pytest.mark.parametrize("rows", [
    [(1, 5.0, i) for i in range(4000)],
    [(1, float(i), 0) for i in range(3999)] + [(1, 1e15, 0)],
    [(None, None, i) for i in range(2000)] + [(k, float("nan"), i) for k in range(20) for i in range(100)]])
def test_chunks_are_even_whatever_the_order_looks_like(spark, rows):
    df = spark.createDataFrame(rows, "k int, t double, i int").repartition(6)
    key = F.struct("k", "t", "i")
    found = search(df, borders(df, key, 16), key, 16).groupBy("_chunk").count().collect()
    assert len(found) >= 12 and max(r["count"] for r in found) < 1000 and min(r._chunk for r in found) == 0


@pytest.mark.parametrize("chunks", [1, 16, 300])
def test_ordered_over_ties_outliers_and_null_keys(spark, monkeypatch, chunks):
    monkeypatch.setattr(O, "CHUNKS", chunks)
    rng = random.Random(chunks)
    data = ([(1, 5.0, i) for i in range(900)] + [(2, float(i), 0) for i in range(99)] + [(2, 1e15, 0)]
            + [(None, None, i) for i in range(300)] + [(k, rng.random(), 0) for k in range(10, 200)])
    rng.shuffle(data)
    df = spark.createDataFrame([(*r, float(n)) for n, r in enumerate(data)], "k int, t double, i int, v double").repartition(5)
    got = O.ordered(df, ["k"], ["t", "i"], number="nr", running={"run": ("sum", F.col("v"))},
                    after={"top": ("max", F.col("v"))}, lag={"p": F.col("v")}, lead={"f": F.col("v")}).collect()
    by_key = {}
    for n, (k, t, i) in enumerate(data):
        by_key.setdefault(k, []).append(((t is not None, t or 0.0, i), float(n)))
    assert len(got) == len(data)
    for r in got:
        own = [v for _, v in sorted(by_key[r.k])]
        at = own.index(r.v)
        assert (r.nr, r.run) == (at, sum(own[:at + 1])) and r.top == max(own[at + 1:], default=None)
        assert (r.p, r.f) == (own[at - 1] if at else None, own[at + 1] if at + 1 < len(own) else None)


@pytest.mark.parametrize("chunks", [1, 40])
def test_islands_without_a_dense_order(spark, monkeypatch, chunks):
    monkeypatch.setattr(O, "CHUNKS", chunks)
    values = [1] * 90 + [2] * 3 + [1] + [2] * 77
    df = spark.createDataFrame([(0, i * 0.25, x) for i, x in enumerate(values)] + [(1, 0.0, 5)], "k int, t double, v int")
    got = {(r.k, r.t): r.island for r in O.islands(
        df.repartition(5), ["k"], ["t"], values={"v": F.col("v")}, together=lambda a, b: a["v"] == b["v"]).collect()}
    want = {(0, i * 0.25): 1 + (i >= 90) + (i >= 93) + (i >= 94) for i in range(len(values))}
    assert got == {**want, (1, 0.0): 1}


@pytest.mark.parametrize("dense", [True, False])
def test_ordered_reads_its_input_twice(spark, dense):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = O.ordered(df, ["user_id"], ["event_id"], dense=dense, number="nr", lag={"p": F.col("value")})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2


@pytest.mark.parametrize("chunk", [10, 64, 100_000])
def test_sparse_and_run_walks_equal_plain_ones(spark, chunk):
    rng = random.Random(chunk)
    marks = {k: sorted(rng.sample(range(3000), 200 if k else 3)) for k in range(3)}
    df = spark.createDataFrame([(k, i, f"m{i}") for k, own in marks.items() for i in own], "video_id int, idx long, m string")
    got = {(r.video_id, r.idx, r.m) for r in sparse_walk(df, 9, chunk=chunk).collect()}
    want = set()
    for k, own in marks.items():
        last = None
        for i in own:
            if last is None or i - last >= 9:
                want.add((k, i, f"m{i}"))
                last = i
    assert got == want
    size, runs, steps = chunk_size(7, chunk), [], []
    while len(steps) < 2500:
        n = min(rng.choice([1, 2, 5, 40]), size - len(steps) % size)
        runs.append((0, len(steps) // size, len(steps), n, rng.randint(1, 7)))
        steps += [runs[-1][-1]] * n
    table = spark.createDataFrame(runs, "video_id int, _chunk long, start long, n long, step long")
    at, visits = 0, []
    while at < len(steps):
        visits.append(at)
        at += steps[at]
    assert sorted(r.idx for r in run_walk(table, 7).collect()) == visits
