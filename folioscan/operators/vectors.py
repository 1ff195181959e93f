"""Exact nearest neighbours, normalisation and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _matrix(a: pa.Array) -> np.ndarray:
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 1)


def l2_distance(vector: str, query: Sequence[float]) -> Column:
    """Euclidean distance of a column of vectors to one vector, a batch of rows at a time; null for vectors of another size."""
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def distance(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            fit = np.array([x is not None and x == len(q) for x in pa.compute.list_value_length(part).to_pylist()], dtype=bool)
            out = np.full(len(part), np.nan)
            if fit.any():
                d = _matrix(part.filter(pa.array(fit))) - q
                out[fit] = np.sqrt(np.einsum("ij,ij->i", d, d))
            yield pa.array(out, mask=~fit)

    return distance(vector)


def l2_normalised(v: Column) -> Column:
    """A vector of length 1 in the same direction; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def knn(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(key, distance, rank) of the k nearest; ``allowed`` (key) restricts the candidates before they are ranked."""
    pool = vectors if allowed is None else vectors.join(allowed.select(key).distinct(), key, "left_semi")
    near = pool.select(key, l2_distance(vector, query).alias("distance")).filter("distance is not null").orderBy("distance", key).limit(k)
    return near.withColumn("rank", F.row_number().over(W.orderBy("distance", key)))


def knn_by(vectors: DataFrame, query: Sequence[float], k: int, group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, key, distance, rank): the k nearest of each group."""
    d = vectors.select(group, key, l2_distance(vector, query).alias("distance")).filter("distance is not null")
    return d.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("distance", key))).filter(F.col("rank") <= k)


def _seed(t: str) -> int:
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return int((c * np.arange(1, len(c) + 1)).sum())


def stub_seed(text: str) -> Column:
    """Sum of position (from 1) times code point: the seed of the deterministic embedder."""

    @F.arrow_udf("bigint")
    def seed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if t is None else _seed(t) for t in (x.as_py() for x in part)], type=pa.int64())

    return seed(text)


def embed_stub(text: str, size: int = 384) -> Column:
    """The deterministic embedder in one step, from text to vector; null counts as empty."""

    @F.arrow_udf("array<float>")
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            seeds = np.array([_seed(t or "") for t in (x.as_py() for x in part)], dtype=np.int64)
            out = np.zeros((len(seeds), size), dtype=np.float32)
            rows = np.arange(len(seeds))
            out[rows, seeds % size] = 1.0
            out[rows, seeds // 7 % size] = 0.5
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(seeds) + 1, dtype=np.int32) * size), pa.array(out.ravel()))

    return embed(text)


def needed(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(hash, first_doc, shared): the embeddings that texts need, one for each content, with its least key and how many share it."""
    return texts.groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(key).alias("first_doc"), F.count(F.lit(1)).alias("shared"))


def shards(vectors: DataFrame, key: str = "vec_id", size: int = 4096) -> DataFrame:
    """(shard, n, first, last): how ids are spread over blocks of ``size``."""
    return vectors.groupBy(F.floor(F.col(key) / size).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def stub_embedding(seed: Column, size: int = 384) -> Column:
    """The deterministic embedder's vector: 1.0 at seed mod size, then 0.5 at (seed div 7) mod size; none without a seed."""
    a, b = seed % size, F.call_function("div", seed, F.lit(7).cast("bigint")) % size
    return F.when(seed.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == b, 0.5).when(i == a, 1.0).otherwise(0.0).cast("float")))
