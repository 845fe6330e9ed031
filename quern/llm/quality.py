"""Quality by a regularised quadratic discriminant (operator 5).

Each text becomes a vector of transformed statistics. Class means and covariances come from sums of
x and x x' over all labelled training rows, gathered without a sample. Covariances shrink towards
their pooled value and then towards a scaled identity; each class keeps its Cholesky factor, and the
score is the logistic of the tempered difference of the classes' log densities (Mahalanobis part,
log determinant and prior).

Defined cases: null, empty and wordless texts have a vector like any other and get a score; labels
that are null or belong to no document don't count; of several labels of one document the largest
counts; with one class only or none every score is that class's share (0.5 without labels); a
null doc_id counts as '' for the remainder; repeated rows are scored alike, also where a class has
no other; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table
from .labelled import remainder

KINDS = np.zeros(256, np.int64)  # 0 others; of bytes: 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 . and ,; 7 other marks; 8 past ASCII
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[32], KINDS[10], KINDS[128:] = 1, 2, 3, 4, 5, 8
for _c in b".,":
    KINDS[_c] = 6
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    KINDS[_c] = 7
WIDTH = 22
#: The least that is added to a covariance's diagonal, which is 1 for a statistic of usual spread; classes of equal texts have no spread.
FLOOR = 1e-3


def _logit(k, n):
    return np.log((k + 0.5) / (n - k + 0.5)) if n >= k else 0.0


def vector(text: str | None) -> np.ndarray:
    b = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    lower, upper, digit, space, feed, stops, marks, high = np.bincount(KINDS, hist, 9)[1:]
    n = len(b)
    words = b.split()
    w = len(words)
    distinct = len(set(words))
    lines = [x for x in b.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:]))) if w > 1 else 1
    lengths = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1)
    top = hist[[33, 35, 36, 37, 38, 42, 124]].max() if n else 0
    ends = sum(1 for x in words if x[-1] in b"!#$%&*|")
    small = n and len(zlib.compress(b, 1)) / n
    return np.array([
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), np.log1p(w / max(1, len(lines))), _logit(upper, lower + upper), _logit(digit, n), _logit(marks, n), _logit(stops, n), _logit(high, n), _logit(space, n), _logit(top, n), _logit(ends, w),
        np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()), _logit(distinct, w), _logit(pairs, max(1, w - 1)), _logit(len(set(lines)), len(lines)), np.sqrt(small), _logit(feed, n), np.log1p(hist.max() / max(1, n) * 10), _logit((lengths == 1).sum() if w else 0, w),
    ])


def _vectors(it):
    for b in it:
        x = [vector(t) for t in b.column(1).to_pylist()]
        flat = pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64())
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_vectors, "doc_id long, x array<double>")


def _sums(it):
    total: dict[int, list] = {}
    for df in it:
        for y, g in df.groupby("y"):
            x = np.stack(g.x.to_numpy())
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            old = total.setdefault(int(y), np.zeros((WIDTH + 1, WIDTH + 1)))
            old += x.T @ x
    for y, m in total.items():
        yield pd.DataFrame({"y": y, "i": np.arange(m.size, dtype=np.int64), "v": m.ravel()})


class Discriminant:
    def __init__(self, moments: dict[int, np.ndarray], shrink: float = 0.1, ridge: float = 0.02, temper: float = 8.0):
        n = {k: m[0, 0] for k, m in moments.items()}
        self.share = n.get(1, 0) / sum(n.values()) if n else 0.5
        self.parts, self.temper = None, temper
        if min(n.get(0, 0), n.get(1, 0)) < 2:
            return
        mean = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(n[k] * cov[k] for k in cov) / sum(n.values())
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale, self.parts = scale, {}
        for k in (0, 1):
            c = ((1 - shrink) * cov[k] + shrink * pooled) / np.outer(scale, scale)
            c = (1 - ridge) * c + max(ridge * np.trace(c) / WIDTH, FLOOR) * np.eye(WIDTH)
            factor = np.linalg.cholesky(c)
            self.parts[k] = mean[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[k] / sum(n.values()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        dense = {}
        for k, (mean, inverse, logdet, prior) in self.parts.items():
            z = (x - mean) / self.scale @ inverse.T
            dense[k] = prior - 0.5 * logdet - 0.5 * (z * z).sum(axis=1)
        gap = dense[1] - dense[0]
        return 1 / (1 + np.exp(-np.sign(gap) * np.log1p(np.abs(gap) / self.temper) * self.temper / 4))


def fit(xs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0) -> Discriminant:
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(remainder(mod) != held).filter("y in (0, 1)")
    parts = xs.join(y, "doc_id").select("y", "x").mapInPandas(_sums, "y int, i long, v double")
    rows = parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * 23 * 23 at most
    moments: dict[int, np.ndarray] = {}
    for r in rows:
        moments.setdefault(r.y, np.zeros((WIDTH + 1) ** 2))[r.i] = r.v
    return Discriminant({k: m.reshape(WIDTH + 1, WIDTH + 1) for k, m in moments.items()})


def _score(model: Discriminant):
    def run(it):
        for df in it:
            s = model.score(np.stack(df.x.to_numpy())) if len(df) else np.zeros(0)
            yield pd.DataFrame({"doc_id": df.doc_id.astype("Int64"), "score": s})

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row; labels of the held-out remainder aren't read."""
    xs = store(vectors(docs))
    return xs.mapInPandas(_score(fit(xs, labels)), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
