"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import Memo, map_batches, text_or_empty

#: Hash space of the terms and the lengths of word beginnings that are terms.
SPACE_BITS = 20
BEGINNINGS = (4, 5, 6)
#: The bound of the labelled sample, and how often a term must occur in it.
SAMPLE_ROWS = 16_000
LEAST_DOCS = 3
#: A term needs this likelihood ratio (G squared) against the share of label 1, so that chance terms get no weight.
LEAST_EVIDENCE = 24.0
#: Pairs of terms are tested on the documents that no such term explains, if they have this ratio. Each term must be in
#: PAIR_SHARE of the explained-by-nothing documents of label 1, and at most PAIR_TERMS terms, the commonest, are paired.
PAIR_EVIDENCE, PAIR_SHARE, PAIR_TERMS = 60.0, 0.1, 1024
FACTORS = 4
THRESHOLD = 0.3

_MARKS = ".,;:!?\"'()[]{}<>*#%$&-_/"
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


class Terms:
    """Hashed terms of texts: each word and the beginnings of longer words.

    With ``place`` (a row for each hash, 0 for none) only the terms that have a
    row are given, by their rows. Tokens are remembered.
    """

    def __init__(self, place: list[int] | None = None):
        self.place = place
        self.known = Memo(self.of_token)

    def of_token(self, token: str) -> tuple[int, ...]:
        core = token if token.isalpha() else token.strip(_MARKS)
        found, digest, shift = [], zlib.crc32, 32 - SPACE_BITS
        for word in [core] if core.isalpha() else _LETTERS.findall(core):
            found.append(digest(word.encode("utf-8")) >> shift)
            found += [digest(word[:n].encode("utf-8"), n) >> shift for n in BEGINNINGS if len(word) > n]
        if self.place is not None:
            return tuple(r for r in map(self.place.__getitem__, found) if r)
        return tuple(found)

    def of(self, text: str) -> list[int]:
        """The different terms of a whole text, sorted."""
        return sorted(set(chain.from_iterable(map(self.known.__getitem__, set(text.lower().split())))))


@dataclass
class Machine:
    """Bias, linear weights and factors of the terms kept; ``place`` maps a hash to its row, 0 for none."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    place: np.ndarray

    def scores(self, rows_of: list[list[int]]) -> np.ndarray:
        """Probabilities for documents given as the rows of their terms."""
        sizes = np.array([len(x) for x in rows_of], dtype=np.int64)
        rows = np.array([y for x in rows_of for y in x], dtype=np.int64)
        logits = _logits(self.bias, self.weights, self.factors, rows, sizes)[0]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _logits(bias, weights, factors, rows, sizes):
    """bias + sum w + 1/2 sum((sum v)^2 - sum v^2) of each document, and the sums of v."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    linear = np.bincount(owner, weights[rows], len(sizes))
    sums = np.stack([np.bincount(owner, v[rows], len(sizes)) for v in factors], axis=1)
    squares = np.bincount(owner, (factors ** 2).sum(axis=0)[rows], len(sizes))
    return bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums, owner


def evidence(hits: np.ndarray, counts: np.ndarray, positive: int, total: int) -> np.ndarray:
    """Likelihood ratio of each term: its documents with and without label 1 against those of all terms' documents."""
    share = positive / max(total, 1)
    out = np.zeros(np.shape(counts))
    for seen, expected in ((hits, counts * share), (counts - hits, counts * (1 - share))):
        some = (seen > 0) & (expected > 0)
        out[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return out


def documents_with(terms: list[np.ndarray]) -> np.ndarray:
    """In how many documents each term is; documents are counted in parts, so that no copy of all terms is made."""
    counts = np.zeros(1 << SPACE_BITS, dtype=np.int64)
    for low in range(0, len(terms), 512):
        some, times = np.unique(np.concatenate(terms[low:low + 512]), return_counts=True)
        counts[some.astype(np.int64)] += times
    return counts


def telling_pairs(terms: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int, bool]]:
    """Pairs of terms that tell labels apart although neither term does: (a, b, whether the pair speaks for label 1).

    Both terms lie below the evidence that single terms need; how often they
    meet is a matrix product over the documents given.
    """
    positive = [t for t, y in zip(terms, labels) if y > 0]
    if len(positive) < LEAST_DOCS or len(positive) == len(terms):
        return []
    seen = documents_with(positive)
    common = np.flatnonzero(seen >= max(LEAST_DOCS, PAIR_SHARE * len(positive)))
    common = np.sort(common[np.argsort(-seen[common], kind="stable")[:PAIR_TERMS]])
    if len(common) < 2:
        return []
    met = {}
    for wanted in (True, False):
        total = np.zeros((len(common), len(common)), dtype=np.float32)  # whole numbers, exact up to 2^24
        own = [t for t, y in zip(terms, labels) if (y > 0) == wanted]
        for low in range(0, len(own), 512):
            block = np.zeros((len(own[low:low + 512]), len(common)), dtype=np.float32)
            for row, found in zip(block, own[low:low + 512]):
                at = np.searchsorted(common, found)
                at = at[at < len(common)]
                row[at[np.isin(common[at], found)]] = 1
            total += block.T @ block
        met[wanted] = total
    share, out = len(positive) / len(terms), []

    def ratios(low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hits = met[True][low:high].astype(np.float64)
        counts = hits + met[False][low:high]
        return evidence(hits, counts, len(positive), len(terms)), hits, counts
    weak = np.concatenate([np.diagonal(ratios(i, i + 128)[0], i) for i in range(0, len(common), 128)]) < LEAST_EVIDENCE
    for low in range(0, len(common), 128):
        ratio, hits, counts = ratios(low, low + 128)
        strong = np.triu((ratio >= PAIR_EVIDENCE) & weak[low:low + 128, None] & weak[None, :], low + 1)
        out += [(int(common[low + i]), int(common[j]), bool(hits[i, j] > share * counts[i, j]))
                for i, j in np.argwhere(strong)]
    return out


def train(terms: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.05,
          decay: float = 2e-4, factor_decay: float = 1e-3, seed: int = 3) -> Machine:
    """Fits by adaptive gradient steps on the logistic loss.

    Terms get weights and factors if they have evidence of their own, or as
    part of a pair that has it (``telling_pairs``, among the documents without
    a term that speaks for label 1). Factors of such a pair start on one
    dimension, with equal signs if the pair speaks for label 1, else opposed.
    """
    counts, positive = documents_with(terms), [t for t, y in zip(terms, labels) if y > 0]
    hits = documents_with(positive)
    alone = (counts >= LEAST_DOCS) & (evidence(hits, counts, len(positive), len(terms)) >= LEAST_EVIDENCE)
    speaking = alone & (hits * max(len(terms), 1) > counts * len(positive))
    open_ = [i for i, t in enumerate(terms) if not speaking[t].any()]
    pairs = telling_pairs([terms[i] for i in open_], labels[open_])
    alone[[t for a, b, _ in pairs for t in (a, b)]] = True
    kept = np.flatnonzero(alone)
    place = np.zeros(1 << SPACE_BITS, dtype=np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    own = [r[r > 0] for r in (place[t] for t in terms)]
    rng = np.random.default_rng(seed)
    n = len(kept) + 1
    weights, factors = np.zeros(n), rng.normal(0, 0.01, (FACTORS, n))
    factors[:, 0] = 0
    for k, (a, b, speaks) in enumerate(pairs):
        factors[k % FACTORS, place[a]] += 0.3
        factors[k % FACTORS, place[b]] += 0.3 if speaks else -0.3
    rarity = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, seen_w, seen_v, seen_b = float(np.log(rarity / (1 - rarity))), np.full(n, 1e-6), np.full((FACTORS, n), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for low in range(0, len(order), batch):
            chosen = order[low:low + batch]
            sizes = np.array([len(own[i]) for i in chosen])
            rows = np.concatenate([own[i] for i in chosen])
            logits, sums, owner = _logits(bias, weights, factors, rows, sizes)
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]) / len(chosen)
            total = float(error.sum())
            seen_b += total ** 2
            bias -= rate * total / seen_b ** 0.5
            if not len(rows):
                continue
            touched, at = np.unique(rows, return_inverse=True)
            slope = np.bincount(at, error[owner], len(touched)) + decay * weights[touched]
            seen_w[touched] += slope ** 2
            for k in range(FACTORS):
                v = factors[k, touched]
                pull = np.bincount(at, error[owner] * sums[owner, k], len(touched))
                pull -= v * np.bincount(at, error[owner], len(touched)) - factor_decay * v
                seen_v[k, touched] += pull ** 2
                factors[k, touched] = v - rate * pull / np.sqrt(seen_v[k, touched])
            weights[touched] -= rate * slope / np.sqrt(seen_w[touched])
    return Machine(bias, weights.astype(np.float64), factors, place)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_lists(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and the hashed terms of every row."""
    def make():
        terms = Terms()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([terms.of(x.as_py()) for x in batch.column(0)], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*batch.columns[1:], found], [*keep, "terms"])
        return work

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keep], "terms array<int>"])
    return map_batches(docs.select(text_or_empty(text).alias("text"), *keep), make, schema)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from the labelled rows that are not held out.

    At most ``sample_rows`` labels are used, those with the smallest hashes of
    their ids, and each once, with the text of the smallest hash if an id
    repeats; only hashed terms leave the executors. Null labels and null ids
    are no labels.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
             .groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one")
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(one).select(
        "doc_id", "label", "one.text")
    found = term_lists(rows, ["doc_id", "label"], "text").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    terms = [x.values.to_numpy() for chunk in found.column("terms").chunks for x in chunk]
    labels_ = found.column("label").to_numpy().astype(np.float64)[order]
    machine = train([terms[i] for i in order], labels_)
    del found, terms
    pa.default_memory_pool().release_unused()  # else the driver keeps what the labelled rows took
    return machine


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    label: str = "toxic", threshold: float = THRESHOLD, machine: Machine | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (or the columns ``keep`` instead of doc_id).

    The score is the probability of label 1 by a factorization machine over the
    words of the whole text and their beginnings: each pair of terms adds the
    product of its factors to the linear weights. Null and empty texts get the
    score of a text without terms. Rows are scored one by one, repeated rows
    alike; extra columns are no inputs; an empty table gives no rows.
    """
    keep = [doc_id] if keep is None else keep
    names, scored = _scored(docs, machine or fit(docs, labels, doc_id, text, label), text, keep)
    columns = [F.col(n).alias(k) for n, k in zip(names, keep)]
    flagged = (F.col("score") >= threshold).cast("int").alias("predicted")
    if keep == [doc_id]:
        columns.append(held_out(F.col("c0")).alias("held_out"))
    return scored.select(*columns, F.col("score"), flagged)


def _scored(docs: DataFrame, model: Machine, text: str, keep: list[str]) -> tuple[list[str], DataFrame]:
    """The columns ``keep`` under the names given back, and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the hash space
    types, names = dict(docs.dtypes), [f"c{i}" for i in range(len(keep))]

    def make():
        own = shared.value
        terms = Terms(own.place.tolist())

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = np.zeros(batch.num_rows)
            for low in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(low, 256)
                scores[low:low + 256] = own.scores([terms.of(x.as_py() or "") for x in part])
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*names, "score"])
        return work

    rows = docs.select(F.col(text).alias("_text"), *[F.col(k).alias(n) for k, n in zip(keep, names)])
    schema = ", ".join([*[f"{n} {types[k]}" for n, k in zip(names, keep)], "score double"])
    return names, map_batches(rows, make, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept."""
    names, scored = _scored(docs, fit(docs, labels, doc_id, text, label), text, docs.columns)
    return scored.filter(F.col("score") < threshold).select(
        *[F.col(n).alias(k) for n, k in zip(names, docs.columns)])
