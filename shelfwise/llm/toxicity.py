"""Toxicity by non-negative positive-unlabelled learning.

A linear model on hashed features (words and their beginnings, present or not) is trained with numpy
from confirmed toxic texts and unlabelled ones. Its risk is
``prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])``: the unlabelled texts stand
for the whole corpus, and the part of their loss that toxic texts cause is taken out. Where the
second term falls below zero, the step goes back up it, so the model cannot fit that part away. The
class prior is the toxic share of all labelled training rows.

Training reads at most ``positives`` + ``unlabelled`` texts, those with the smallest hash of doc_id; all
texts are scored whole. Null or empty text: the score of the bias alone. Repeated rows have the same
score. No confirmed toxic row: every score is zero. A null doc_id is scored, but never trained on.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import small_batches

BEGINNINGS = (4, 5, 6)
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    positives: int = 2_500
    unlabelled: int = 7_500
    buckets: int = 1 << 18
    rounds: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    slack: float = 0.0  # how far below zero the second term may fall before the step turns
    least_ratio: float = 3.0  # of a feature's share in the toxic texts to its share in the unlabelled ones
    least_sigma: float = 5.0  # by so many standard deviations it must occur more often than expected there


@dataclass
class Model:
    buckets: int
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -1e9  # scores zero


def word_features(word: str, buckets: int) -> tuple[int, ...]:
    names = [word] + [f"{word[:k]}-" for k in BEGINNINGS if len(word) > k]
    return tuple(xxhash.xxh64_intdigest(n.encode()) % buckets for n in names)


def features(text: str, buckets: int, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    found: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        if (f := known.get(w)) is None:
            if len(known) >= REMEMBERED:
                known.clear()
            f = known[w] = word_features(w, buckets)
        found.update(f)
    return np.array(sorted(found), dtype=np.int32)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never read."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, ids: DataFrame, buckets: int) -> list[np.ndarray]:
    """Features of the documents with these ids, which are few by their limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in small_batches(batches):
            rows = [features(t or "", buckets, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], names=["f"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rows = chosen.dropDuplicates(["doc_id"]).select("text").mapInArrow(run, "f array<int>").toArrow()
    return [np.array(v, dtype=np.int64) for v in rows.column("f").to_pylist()]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, how: Training = Training()) -> Model:
    """The model that full gradient steps (Adam) reach from zero."""
    model = Model(how.buckets)
    if not positive or not unlabelled or not 0 < prior < 1:
        return model
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=how.buckets)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=how.buckets)
    ratio = ((in_p + 1) / (n_p + 2)) / ((in_u + 1) / (n_u + 2))
    expected = (in_u + 1) / (n_u + 2) * n_p
    kept = np.flatnonzero((ratio >= how.least_ratio) & (in_p - expected >= how.least_sigma * np.sqrt(expected)))
    number = np.full(how.buckets, -1)
    number[kept] = np.arange(len(kept))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cells = [number[r] for r in rows]
        cells = [c[c >= 0] for c in cells]
        return np.concatenate([*cells, np.empty(0, dtype=np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(c) for c in cells])

    cells_p, rows_p = matrix(positive)
    cells_u, rows_u = matrix(unlabelled)

    def value(w: np.ndarray, b: float, cells: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=w[cells], minlength=n) + b

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    w, b = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, how.rounds + 1):
        f_p, f_u = value(w, b, cells_p, rows_p, n_p), value(w, b, cells_u, rows_u, n_u)
        as_negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        s_p, s_u = sigmoid(f_p), sigmoid(f_u)
        # derivatives by each row's value
        d_p, d_u = -prior * (1 - s_p) / n_p, np.zeros(n_u)
        if as_negative >= -how.slack:
            d_p, d_u = d_p - prior * s_p / n_p, s_u / n_u
        else:
            d_p, d_u = prior * s_p / n_p, -s_u / n_u
        g = np.bincount(cells_p, weights=d_p[rows_p], minlength=len(kept)) + np.bincount(cells_u, weights=d_u[rows_u], minlength=len(kept))
        g = np.append(g + how.decay * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = how.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights = {int(k): float(x) for k, x in zip(kept, w, strict=True) if abs(x) > 1e-6}
    model.bias = float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Fit on the rows that are not held out. ``labels`` has doc_id and toxic (0, 1 or null)."""
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(*by_hash).limit(how.positives)
    others = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    others = others.orderBy(*by_hash).limit(how.unlabelled)
    return fit(_sample(docs, toxic, how.buckets), _sample(docs, others, how.buckets), prior, how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""
    weights, bias, buckets = model.weights, model.bias, model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in small_batches(batches):
            totals = []
            for text in batch.column(1).to_pylist():
                found: set[int] = set()
                for w in set(_WORD.findall((text or "").lower())):
                    if (f := known.get(w)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        f = known[w] = tuple(x for x in word_features(w, buckets) if x in weights)
                    if f:
                        found.update(f)
                totals.append(bias + sum(weights[x] for x in sorted(found)))
            value = 1 / (1 + np.exp(-np.clip(np.array(totals, dtype=float), -40, 40)))
            value[value < 1e-15] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
