"""Embedding whitening by polarised covariances: squares of dimensions and of their pair sums, exact until the last step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.session import cut

#: Entries become floor(SCALE * c) + SHIFT. Entries of LARGEST or more in size count as not finite: their squares could
#: not be summed exactly in 38 digits.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0 ** 36
COMPONENTS = 8
_EXACT = pa.decimal128(38, 0)


@dataclass
class Whitener:
    """What a fit gives: n and sums of the integer vectors, components (rows) and their eigenvalues, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def __post_init__(self):
        self.middle = np.array([round_half(s, self.n) for s in self.sums], dtype=np.int64)
        self.rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        has = self.values > 1e-12 * max(self.trace, 0.0)
        self.factors = np.where(has[:, None], self.components / np.sqrt(np.where(has, self.values, 1.0))[:, None], 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, each divided by its deviation; 0 on a component without variance."""
        centred = (x - self.middle) - np.array([r / self.n for r in self.rest])
        return centred @ self.factors.T

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - S)^2."""
        z = x - self.middle
        largest = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        if z.shape[1] * largest ** 2 < 2 ** 62:
            y = self.n * z - np.array(self.rest, dtype=np.int64)
            return pa.array((y * y).sum(axis=1)).cast(_EXACT)
        y = z.astype(object) * self.n - np.array(self.rest, dtype=object)
        return pa.array([Decimal(int(v)) for v in (y * y).sum(axis=1)], _EXACT)


def round_half(a: int, b: int) -> int:
    """a / b to the nearest whole number."""
    return (2 * a + b) // (2 * b)


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers below LARGEST in size."""
    held = F.forall(vector, lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & held, F.lit(False))


def integers(lists: pa.Array, length: int) -> np.ndarray:
    """Lists of ``length`` numbers as rows of integers."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, length) + SHIFT


def whole_sums(rows: np.ndarray) -> list[int]:
    """Exact column sums: high and low halves apart, so no sum of 2^31 rows overflows."""
    high, low = (rows >> 24).sum(axis=0), (rows & ((1 << 24) - 1)).sum(axis=0)
    return [(int(h) << 24) + int(x) for h, x in zip(high, low)]


def pair_squares(z: np.ndarray) -> list[int]:
    """Exact sums of z_i^2 and (z_i + z_j)^2 for i < j, in the order (0,0), (0,1), ..., (1,1), ..."""
    out, largest = [], 2 * int(np.abs(z).max(initial=0))
    wide = largest ** 2 * max(1, len(z)) >= 2 ** 62
    for i in range(z.shape[1]):
        sums = z[:, i:i + 1] + z[:, i:]
        sums[:, 0] = z[:, i]
        if wide:
            sums = sums.astype(object)
        out.extend(int(v) for v in (sums * sums).sum(axis=0))
    return out


def _per_task(rows: DataFrame, fold, finish, schema: str) -> DataFrame:
    """What ``finish`` gives of the state that ``fold`` makes of all batches of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = fold(state, batch)
        if state is not None:
            yield finish(state)
    return rows.mapInArrow(run, schema)


def _added(state: list, more: list) -> list:
    return more if state is None else [a + b for a, b in zip(state, more)]


def _first_moments(rows: DataFrame) -> tuple[int, int, list[int]]:
    """The commonest length of the vectors (of equally common ones the longest), how many have it, and their sums."""
    def fold(state, batch):
        state = state or {}
        lists = batch.column(0)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            own = lists.filter(pa.array(lengths == length))
            x = integers(own, int(length))
            state[int(length)] = _added(state.get(int(length)), [len(x), *whole_sums(x)])
        return state

    def finish(state):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(state), pa.int32()), pa.array([v[0] for v in state.values()], pa.int64()),
             pa.array([[Decimal(s) for s in v[1:]] for v in state.values()], pa.list_(_EXACT))], ["length", "n", "sums"])

    parts = cut(_per_task(rows.select("vector"), fold, finish, "length int, n long, sums array<decimal(38,0)>"))
    first = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if first is None:
        return 0, 0, []
    sums = (parts.filter(F.col("length") == first.length).select(F.posexplode("sums").alias("at", "x"))
            .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect())
    return first.length, first.n, [int(r.x) for r in sums]


def _covariance(rows: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, float]:
    """Covariances and their trace, each rounded once from exact integers.

    Squares of centred values are summed for every dimension and for every sum
    of two dimensions; var(a + b) - var(a) - var(b) is twice a covariance. The
    integer nearest the mean is taken off before squaring, the rest of the mean
    afterwards, both exactly.
    """
    length = len(sums)
    middle = np.array([round_half(s, n) for s in sums], dtype=np.int64)
    at = [(i, j) for i in range(length) for j in range(i, length)]

    def fold(state, batch):
        return _added(state, pair_squares(integers(batch.column(0), length) - middle))

    def finish(state):
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(state)), pa.int32()), pa.array([Decimal(s) for s in state], _EXACT)], ["at", "x"])

    found = (_per_task(rows.select("vector"), fold, finish, "at int, x decimal(38,0)")
             .groupBy("at").agg(F.sum("x").alias("x")).toArrow().sort_by("at").column("x").to_pylist())
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    exact = {}  # n^2 times the sum of squared deviations, over n
    for (i, j), squares in zip(at, found):
        off = rest[i] + rest[j] * (i != j)
        exact[i, j] = n * int(squares) - off * off
    out = np.zeros((length, length))
    for i, j in at:
        twice = 2 * exact[i, i] if i == j else exact[i, j] - exact[i, i] - exact[j, j]
        out[i, j] = out[j, i] = twice / (2 * n * n)
    return out, sum(exact[i, i] for i in range(length)) / (n * n)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """A whitener of the column ``vector``, whose lists are all usable; None without rows."""
    length, n, sums = _first_moments(rows)
    if not n:
        return None
    covariance, trace = _covariance(rows.filter(F.size("vector") == length), n, sums)
    values, vectors = np.linalg.eigh(covariance)
    chosen = np.argsort(-values, kind="stable")[:components]
    axes = vectors[:, chosen].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return Whitener(n, sums, axes * signs[:, None], values[chosen], trace)


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """The largest entry, by size, of the measured covariance of the whitened rows minus the identity.

    Components without variance are left out; 0 if there are none.
    """
    length, k = len(model.sums), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def fold(state, batch):
        w = shared.value.whiten(integers(batch.column(0), length))
        more = np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])
        return more if state is None else state + more

    def finish(state):
        return pa.RecordBatch.from_arrays([pa.array(range(len(state)), pa.int32()), pa.array(state)], ["at", "x"])

    found = _per_task(rows.select("vector"), fold, finish, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    total = found.toArrow().sort_by("at").column("x").to_numpy()
    mean, second = total[1:k + 1] / total[0], total[k + 1:].reshape(k, k) / total[0]
    has = (model.factors != 0).any(axis=1)
    off = (second - np.outer(mean, mean) - np.eye(k))[np.ix_(has, has)]
    return float(np.abs(off).max(initial=0.0))


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable vector and component.

    Vectors that are null, empty or hold null, non-finite or oversized entries
    (LARGEST) take no part, nor do vectors of another than the commonest
    length. Everything is fitted to the vectors that remain. ``deviation`` is a
    decimal of 38 digits. A component without variance has whitened 0 and does
    not count in identity_error; without any variance explained is 0. Null and
    repeated ids are rows of their own; extra columns are ignored; an empty
    table gives no rows. The driver sees a square matrix of the dimensions.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    id_type = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"
    model = fit(rows, components)
    if model is None:
        scored, n, explained, error = rows.select(
            "vec_id", F.lit(0).cast("decimal(38,0)").alias("deviation"),
            F.array(F.lit(0.0)).alias("whitened")).filter("false"), 0, [0.0], 0.0
    else:
        length = len(model.sums)
        rows = rows.filter(F.size("vector") == length)
        n, error = model.n, identity_error(rows, model)
        explained = [float(v) / model.trace if model.trace > 0 else 0.0 for v in model.values]
        shared = rows.sparkSession.sparkContext.broadcast(model)  # a matrix of components and dimensions

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = integers(batch.column(1), length)
                w = shared.value.whiten(x)
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), shared.value.deviations(x), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                    ["vec_id", "deviation", "whitened"])
        scored = rows.mapInArrow(score, schema)
    shares = F.array(*map(F.lit, explained))
    return scored.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
