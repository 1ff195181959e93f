"""A store of vectors by id: the interface that a search engine of another make can take over, and its own implementation on Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import vectors


class VectorBackend(Protocol):
    """What search and the store ask of a vector index."""

    def upsert(self, rows: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def search(self, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame: ...
    def integrity(self, expected: DataFrame) -> DataFrame: ...
    def version(self) -> str: ...
    def capabilities(self) -> dict[str, object]: ...


class ParquetVectors:
    """Vectors (vec_id, embedding) at ``path``: each change is a segment, the latest entry of an id counts, and an entry without a vector deletes it."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int | None = None):
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), dimensions
        self.segments: list[str] = []

    def _add(self, rows: DataFrame) -> None:
        name = f"{self.path}/{len(self.segments):08d}-{uuid.uuid4().hex}"
        rows.write.parquet(name)
        self.segments.append(name)

    def upsert(self, rows: DataFrame) -> None:
        """Add or replace; vectors of another size than the store's are an error when they are written."""
        v = F.col("embedding").cast("array<float>")
        if self.dimensions is not None:
            v = F.when(F.size("embedding") == self.dimensions, v).otherwise(F.raise_error(F.concat(F.lit("a vector of another size: "), F.col("vec_id").cast("string"))).cast("array<float>"))
        self._add(rows.select("vec_id", v.alias("embedding")))

    def delete(self, ids: DataFrame) -> None:
        self._add(ids.select("vec_id", F.lit(None).cast("array<float>").alias("embedding")))

    def live(self) -> DataFrame:
        """(vec_id, embedding) of what is there."""
        if not self.segments:
            return self.spark.createDataFrame([], "vec_id bigint, embedding array<float>")
        parts = [self.spark.read.parquet(p).withColumn("s", F.lit(i)) for i, p in enumerate(self.segments)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        last = every.groupBy("vec_id").agg(F.max_by(F.struct("embedding"), "s").alias("e"))
        return last.select("vec_id", "e.embedding").filter("embedding is not null")

    def search(self, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(vec_id, distance, rank) of the k nearest, exactly."""
        return vectors.knn(self.live(), query, k, allowed=allowed)

    def integrity(self, expected: DataFrame) -> DataFrame:
        """(vec_id, issue) against expected (vec_id): missing-vector, orphan-vector or wrong-size."""
        j = expected.select("vec_id", F.lit(1).alias("x")).distinct().join(self.live(), "vec_id", "full_outer")
        size = F.lit(False) if self.dimensions is None else F.size("embedding") != self.dimensions
        said = F.when(F.col("embedding").isNull(), "missing-vector").when(F.col("x").isNull(), "orphan-vector").when(size, "wrong-size")
        return j.select("vec_id", said.alias("issue")).filter("issue is not null")

    def version(self) -> str:
        return "parquet-vectors-1"

    def capabilities(self) -> dict[str, object]:
        return {"exact": True, "metric": "l2", "filtered": True, "limit": None}
