"""Toxicity: cumulative-link ordinal regression over hashed words; all thresholds share one weight vector.

The labels are binary. Grades 1 and 2 are derived from them: a toxic text is graded by how many of its words tell toxic texts from others among
the *other* half of the labelled texts, so that no text has a part in its own grade. Still, severity says how much a text has of what marks toxic
texts, not what a person would call severe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, U64, mix, pieces, plus, words

FEATURE_BITS = 19
STEM = 4


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts: (text number, feature, value), one entry per distinct hash; value 1 + ln(count).

    Each word counts, and so does its stem (its first STEM bytes), which brings inflected forms together; the two have halves of the
    feature space to themselves.
    """
    half, parts = np.uint64(65 - FEATURE_BITS), []
    for k, most in enumerate((None, STEM)):
        h, _, _, first = words(data, off, NOT_WORD, most)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        parts.append((owner.astype(np.int64) << FEATURE_BITS) | (k << (FEATURE_BITS - 1)) | (h >> half).astype(np.int64))
    key, count = np.unique(np.concatenate(parts), return_counts=True)
    return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1), 1 + np.log(count)


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]) with rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, n_features: int, l1: float = 3e-4, steps: int = 150) -> OrdinalModel:
    """Adam on the cumulative-link likelihood with an L1 penalty, by proximal steps: the penalty leaves few of the weights over zero.

    Entries come in order of rows. The gaps between thresholds are exponentials, so they keep their order.
    """
    n, k = len(grade), max(1, int(grade.max(initial=0)))
    used, slot = np.unique(col, return_inverse=True)
    slot, d = slot.astype(np.int32), len(used)
    by = np.argsort(slot, kind="stable")
    of_row, of_val, cut = row[by].astype(np.int32), val[by], np.searchsorted(slot[by], np.arange(d))  # entries by feature
    del by
    share = np.array([np.clip((grade > j).mean() if n else 0, 1e-3, 0.999) for j in range(k)])
    theta = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(d), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v, at = np.zeros_like(p), np.zeros_like(p), np.arange(n)
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, p[slot] * val, n) if n else np.zeros(0)
        cum = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))  # P(grade > j)
        full = np.concatenate([np.ones((n, 1)), cum, np.zeros((n, 1))], 1)
        slope = full * (1 - full)
        prob = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        up, down = slope[at, grade] / prob, slope[at, grade + 1] / prob
        g_theta = np.zeros(k)
        np.add.at(g_theta, grade[grade > 0] - 1, up[grade > 0])
        np.add.at(g_theta, grade[grade < k], -down[grade < k])
        g_score = -(up - down) / max(n, 1)
        tail = np.cumsum(g_theta[::-1])[::-1] / max(n, 1)
        g = np.concatenate([np.add.reduceat(g_score[of_row] * of_val, cut) if d else np.zeros(0), [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.05 / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        p = p - rate * m / (1 - 0.9**t)
        p[:d] = np.sign(p[:d]) * np.maximum(np.abs(p[:d]) - rate[:d] * l1, 0)
    w = np.zeros(n_features)
    w[used] = p[:d]
    return OrdinalModel(w, p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))]))


def z_scores(toxic_docs: np.ndarray, other_docs: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far each feature's share of toxic texts is above its share of others, in standard errors."""
    a, b = toxic_docs / max(n1, 1), other_docs / max(n0, 1)
    return (a - b) / np.sqrt(np.maximum(a * (1 - a) / max(n1, 1) + b * (1 - b) / max(n0, 1), 1 / max(n1, 1) / max(n0, 1)))


def severity_grades(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, fold: np.ndarray, errors: float = 4) -> np.ndarray:
    """Grades 0, 1, 2 from binary labels: toxic texts with more than the median number of tell-tale features get 2.

    Tell-tale are features whose share of toxic texts is over `errors` standard errors above that of others, in the other fold.
    """
    grade = np.zeros(len(toxic), np.int64)
    for f in (0, 1):
        there = (fold != f)[row]
        counts = [np.bincount(col[there & (toxic[row] == t)], minlength=1 << FEATURE_BITS) for t in (1, 0)]
        z = z_scores(*counts, int((toxic[fold != f] == 1).sum()), int((toxic[fold != f] == 0).sum()))
        hits = np.bincount(row, z[col] > errors, len(toxic))
        own = (fold == f) & (toxic == 1)
        if own.any():
            grade[own] = 1 + (hits[own] > np.median(hits[own]))
    return grade


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> OrdinalModel:
    """Fits the model on at most `sample` labelled texts (those with the smallest hashed ids), the documented bound, with all their features.

    Labels that are null or belong to no document are left out; an id labelled more than once is toxic if any label says so, and an id
    that comes with several texts counts with one of them, the one with the least hash. Without a toxic label every text scores as
    grade 0. Other columns, whatever their names, are ignored. The driver gets the features of the sample, some 4 kB a text.
    """
    picked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most `sample` rows of two numbers
    rows = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in pieces(batches, "text"):
            r, c, x = features(data, off)
            cut = np.searchsorted(r, np.arange(len(off))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.ListArray.from_arrays(cut, c.astype(np.int32)), pa.ListArray.from_arrays(cut, x.astype(np.float32))], names=["doc_id", "toxic", "col", "val"])

    got = rows.mapInArrow(extract, "doc_id long, toxic int, col array<int>, val array<float>").toArrow().sort_by("doc_id").combine_chunks()
    toxic = (got.column("toxic").to_numpy() > 0).astype(np.int64)
    if not toxic.any():
        return OrdinalModel(np.zeros(1 << FEATURE_BITS), np.array([40.0, 41.0]))
    col, val = (got.column(c).combine_chunks() for c in ("col", "val"))
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    col, val = col.flatten().to_numpy(), val.flatten().to_numpy()
    fold = (mix(got.column("doc_id").to_numpy().astype(U64)) & U64(1)).astype(np.int64)
    return fit_ordinal(row, col, val, severity_grades(row, col, toxic, fold), 1 << FEATURE_BITS)


def score_toxicity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """Adds severity (expected grade: the sum of P(grade > k)), p_toxic (P(grade > 0)) and grade (the number of P(grade > k) >= 0.5).

    Null and empty texts have no features and get the grade that the thresholds alone give (0). Rows are scored one by one, so
    repeated rows get the same values. The weights (4 MB) go to every task. Input columns of those names are replaced. A very long text
    is scored whole, in one task.
    """
    names = ["severity", "p_toxic", "grade"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b, data, off in pieces(batches, text):
            r, c, x = features(data, off)
            up = m.exceed(np.bincount(r, m.weights[c] * x, len(off) - 1) if len(r) else np.zeros(len(off) - 1))
            new = [pa.array(up.sum(1)), pa.array(up[:, 0]), pa.array((up >= 0.5).sum(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return docs.mapInArrow(score, plus(docs, "severity double, p_toxic double, grade int"))
