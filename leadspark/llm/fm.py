r"""Quality classifier: a factorisation machine.

A document's features are its hashed distinct words, statistics of its
structure, and its length (metadata that the row carries about its text).
Labels, language, source and id are never features. The score is
``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2))``:
all pairwise interactions of rank RANK, in time linear in the features by the
sum-of-squares identity.

The model is fitted on a bounded sample (``SAMPLE`` labelled rows of the
training folds, the lowest id hashes); scoring covers every row and whole text.

Null or empty text: no words, the structure statistics are those of an empty
text, and a score is still given. Rows with a null doc_id are scored and never
learnt from. Repeated rows get equal scores. No labelled row: every score is
0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
RANK = 8
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
EPOCHS = 6
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_HIGH = bytes(range(128, 256))
_STATS = 12


def _share(text: bytes, kind: bytes) -> float:
    return 1.0 - len(text.translate(None, kind)) / max(1, len(text))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the structure statistics."""
    words = text.split()
    kinds = set(words)
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = np.array([
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)),
        sum(map(len, kinds)) / max(1, len(kinds)), len(kinds) / n, len(set(lines)) / max(1, len(lines)),
        _share(text, _SYMBOLS), text.count(b"|") / n, _share(text, _DIGITS), _share(text, _UPPER),
        _share(text, _HIGH), math.log1p(len(words) / max(1, len(lines)))])
    crc = zlib.crc32
    return np.unique(np.array([crc(w) % BUCKETS for w in kinds], dtype=np.int64)), stats


class Batch:
    """Features of many documents, flat: entry e belongs to document doc[e]."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.n = len(rows)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(self.n), sizes)
        self.x = np.repeat(1.0 / np.sqrt(np.maximum(sizes, 1)), sizes)
        self.stats = np.array([s for _, s in rows]).reshape(self.n, _STATS)


class Machine:
    def __init__(self, rng: np.random.Generator):
        self.w0 = 0.0
        self.w = np.zeros(BUCKETS + _STATS)
        self.v = rng.normal(0, 0.05, (BUCKETS + _STATS, RANK))
        self.mean, self.sd = np.zeros(_STATS), np.ones(_STATS)

    def _sums(self, b: Batch):
        """Linear part, per-factor sums and per-entry factors."""
        z = np.clip((b.stats - self.mean) / self.sd, -4, 4)
        ve = self.v[b.index] * b.x[:, None]
        vs = self.v[BUCKETS:]
        total, square = z @ vs, (z ** 2) @ (vs ** 2)
        for f in range(RANK):
            total[:, f] += np.bincount(b.doc, ve[:, f], b.n)
            square[:, f] += np.bincount(b.doc, ve[:, f] ** 2, b.n)
        linear = self.w0 + z @ self.w[BUCKETS:] + np.bincount(b.doc, self.w[b.index] * b.x, b.n)
        return linear + 0.5 * (total ** 2 - square).sum(axis=1), total, ve, z

    def score(self, b: Batch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._sums(b)[0], -30, 30)))

    def fit(self, rows, labels: np.ndarray, rng: np.random.Generator, rate=0.1, decay=1e-4, size=128) -> None:
        """AdaGrad over shuffled minibatches, classes weighted evenly."""
        stats = np.array([s for _, s in rows])
        self.mean, self.sd = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        g_w, g_v, g_0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), size):
                pick = order[at:at + size]
                b = Batch([rows[i] for i in pick])
                y, total, ve, z = self._sums(b)
                d = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
                dx = d[b.doc] * b.x
                grad_w = np.zeros_like(self.w)
                grad_w[:BUCKETS] = np.bincount(b.index, dx, BUCKETS)
                grad_w[BUCKETS:] = d @ z
                grad_v = np.zeros_like(self.v)
                part = dx[:, None] * (total[b.doc] - ve)
                for f in range(RANK):
                    grad_v[:BUCKETS, f] = np.bincount(b.index, part[:, f], BUCKETS)
                grad_v[BUCKETS:] = (d[:, None] * z).T @ total - ((d[:, None] * z ** 2).sum(axis=0))[:, None] * self.v[BUCKETS:]
                grad_w += decay * self.w * (grad_w != 0)
                grad_v += decay * self.v * (grad_v != 0)
                g_w += grad_w ** 2
                g_v += grad_v ** 2
                g_0 += d.sum() ** 2
                self.w -= rate * grad_w / np.sqrt(g_w)
                self.v -= 0.2 * rate * grad_v / np.sqrt(g_v)
                self.w0 -= rate * d.sum() / math.sqrt(g_0)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Machine | None:
    """Fit on up to SAMPLE labelled documents outside the held-out fold. A
    label given twice counts by its mean."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<i:array<int>, s:array<double>>")
    def parts(text: pd.Series) -> pd.DataFrame:
        rows = [features(t) for t in text]
        return pd.DataFrame({"i": [i.astype(np.int32) for i, _ in rows], "s": [s for _, s in rows]})

    marks = (labels.filter(F.col("quality").isNotNull() & (common.fold("doc_id", folds) != held))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("__label")))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    found = docs.select("doc_id", common.text_of().cast("binary").alias("__text")).join(F.broadcast(chosen), "doc_id")
    rows = (found.select("doc_id", "__label", F.xxhash64("__text").alias("__h"), parts("__text").alias("p"))
            .dropDuplicates(["doc_id", "__h"]).select("doc_id", "__label", "p.i", "p.s").toPandas()
            .sort_values("doc_id", kind="stable"))
    y = rows["__label"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(7)
    model = Machine(rng)
    model.fit([(np.asarray(i, dtype=np.int64), np.asarray(s)) for i, s in zip(rows["i"], rows["s"])], y, rng)
    return model


def scorer(docs: DataFrame, model: Machine | None, text: str = "text") -> Column:
    """Column with the score of each whole text."""
    if model is None:
        return F.lit(0.5).cast("double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(sent.value.score(Batch([features(x) for x in t])) if len(t) else [], dtype="float64")

    return score(common.text_of(text).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted``, one per document row."""
    common.prepare(docs.sparkSession)
    model = train(docs, labels)
    return (docs.select("doc_id", scorer(docs, model).alias("score"))
            .select("doc_id", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                    "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, all their columns unchanged."""
    common.prepare(docs.sparkSession)
    return docs.filter(scorer(docs, train(docs, labels)) >= 0.5)
