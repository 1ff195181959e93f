"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features.

Statistics of a text (sizes, character classes, repetition) are standardised, held within ``CLIP``
standard deviations (what lies beyond is as far as the kernel reaches) and mapped to ``sqrt(2 / D) * cos(W x + b)``; ridge regression on the labels is solved from normal equations
that each partition sums for itself; isotonic regression on rows held out turns scores into
probabilities. Fitting uses at most ``max_rows`` labelled rows, those with the least hash of
their id; scoring reads every document whole.

Defined cases: a null text and one without any character but white space have probability 0
and are rejected; labels that are null, or whose document is missing, are not used; where one
id has several labels the worst counts, and where it has several texts each counts; without
labels of both kinds the classifier knows nothing and accepts every text that has a word; rows
that repeat are scored alike; an empty table gives an empty result; further columns pass
unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches
from folioscan.llm.textvec import slices

FEATURES, GAMMA, RIDGE, SEED, MAX_ROWS, ACCEPT, CLIP = 256, 0.05, 1e-3, 7, 20_000, 0.5, 8.0

_CLASS = np.full(256, 5, dtype=np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\f\v", 3), (b".,;:'\"-()", 4)):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:] = 6
N_STATS = 16


def statistics(text: str) -> list[float]:
    """Sixteen statistics of one text; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(_CLASS[raw], minlength=7) / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    count = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    letters = share[0] + share[1] + 1e-9
    return [
        np.log1p(len(text)), np.log1p(n), len(text) / n, np.log1p(max(map(len, count))),
        len(count) / n, np.log1p(len(count)) / np.log1p(n), same / n, max(count.values()) / n,
        share[1] / letters, share[2], share[3], share[4], share[5], share[6],
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ]


@dataclass
class Model:
    """What scoring needs; a few hundred kB, whatever the size of the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.w, self.b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.ones(len(x))
        return np.interp((self.map(x) * self.beta).sum(1), self.knots, self.values)


def fourier(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant; sums go row by row, so that a row's value doesn't depend on its batch."""
    z = np.sqrt(2 / w.shape[1]) * np.cos(np.einsum("ij,jk->ik", np.clip(x, -CLIP, CLIP), w) + b)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their rising values; equal scores are pooled first."""
    at, inverse = np.unique(score, return_inverse=True)
    w = np.bincount(inverse, weight)
    m = np.bincount(inverse, weight * y) / w
    blocks: list[list[float]] = []
    for s, v, k in zip(at, m, w):
        blocks.append([s, s, v, k])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            lo, hi = blocks[-2], blocks.pop()
            blocks[-1] = [lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / (lo[3] + hi[3]), lo[3] + hi[3]]
    return np.array([e for b in blocks for e in b[:2]]), np.array([v for b in blocks for v in (b[2], b[2])])


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled ids; that bound is what makes the broadcast safe."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__fs_id")).agg(F.min("quality").cast("double").alias("y"))
    few = y.orderBy(F.xxhash64("__fs_id"), "__fs_id").limit(max_rows)
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__fs_id")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on the labelled rows; every fifth id, by hash, is held out for the calibration. The two kinds weigh the same in total."""
    table = labelled(small_batches(docs), labels, max_rows).select("doc_id", "y", _stats()("text").alias("x"), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).alias("held"))
    # at most max_rows rows of sixteen numbers: they are gathered in 8 partitions so that what is summed doesn't grow either
    table = table.repartition(8, "doc_id").sortWithinPartitions("doc_id", "x").persist()
    try:
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features)
        kinds = {r["y"]: r["count"] for r in table.filter("not held").groupBy("y").count().collect()}
        nothing = Model(np.zeros(N_STATS), np.ones(N_STATS), w, b, np.empty(0), np.empty(0), np.empty(0))
        if len(kinds) < 2:
            return nothing
        weight = {y: sum(kinds.values()) / (2 * n) for y, n in kinds.items()}

        def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                x = np.array(p["x"].tolist(), dtype=float).reshape(-1, N_STATS)
                yield pd.DataFrame({"v": [np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]).tobytes()]})

        total = sum(np.frombuffer(r["v"]) for r in table.filter("not held").mapInPandas(moments, "v binary").collect())
        mean = total[1 : N_STATS + 1] / total[0]
        scale = np.sqrt(np.maximum(total[N_STATS + 1 :] / total[0] - mean**2, 0))
        scale[scale < 1e-9] = 1.0

        def normal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
            for p in parts:
                z = fourier((np.array(p["x"].tolist(), dtype=float).reshape(-1, N_STATS) - mean) / scale, w, b)
                k = p["y"].map(weight).to_numpy()
                a += z.T @ (z * k[:, None])
                c += z.T @ (k * p["y"].to_numpy())
            yield pd.DataFrame({"a": [a.tobytes()], "c": [c.tobytes()]})

        sums = table.filter("not held").mapInPandas(normal, "a binary, c binary").collect()
        a = sum(np.frombuffer(r["a"]) for r in sums).reshape(features + 1, features + 1)
        c = sum(np.frombuffer(r["c"]) for r in sums)
        penalty = ridge * total[0] * np.eye(features + 1)
        penalty[-1, -1] = 1e-9
        beta = np.linalg.solve(a + penalty, c)

        held = table.filter("held").select("x", "y").toPandas()
        if held["y"].nunique() < 2:
            held = table.select("x", "y").toPandas()
        score = (fourier((np.array(held["x"].tolist()) - mean) / scale, w, b) * beta).sum(1)
        return Model(mean, scale, w, b, beta, *isotonic(score, held["y"].to_numpy(), held["y"].map(weight).to_numpy()))
    finally:
        table.unpersist()


def _stats():
    @F.arrow_udf("array<double>")
    def stats(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if t is None else statistics(t) for texts in slices(part) for t in texts], type=pa.list_(pa.float64()))

    return stats


def scorer(model: Model):
    """A column function from text to the probability of good quality."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x = np.array([[0.0] * N_STATS if t is None else statistics(t) for texts in slices(part) for t in texts]).reshape(-1, N_STATS)
            p = model.probability(x) if len(x) else np.empty(0)
            p[x[:, 0] == 0] = 0.0
            yield pa.array(p)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, probability, accepted) for every row."""
    p = scorer(fit(docs, labels, **how))("text")
    return small_batches(docs).select("doc_id", p.alias("probability")).withColumn("accepted", F.col("probability") >= ACCEPT)


def quality_filter(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    p = scorer(fit(docs, labels, **how))("text")
    return small_batches(docs).withColumn("__fs_p", p).filter(F.col("__fs_p") >= ACCEPT).select(*cols)
