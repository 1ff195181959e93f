"""Reciprocal rank fusion of a lexical and a vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONSTANT = 60


def fuse(lexical: DataFrame, vector: DataFrame, limit: int, key: str = "doc_id", constant: int = CONSTANT) -> DataFrame:
    """(key, score, provenance, lexical_rank, vector_rank, rank): the ``limit`` best of both rankings (key, rank).

    Equal scores keep the lexical order, what only the vectors found comes after it in theirs.
    A key that a ranking holds twice counts with its first rank.
    """
    first = lambda df, name: df.groupBy(key).agg(F.min("rank").alias(name))
    both = first(lexical, "lexical_rank").join(first(vector, "vector_rank"), key, "full_outer")
    share = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    found = both.select(
        key, (share("lexical_rank") + share("vector_rank")).alias("score"), "lexical_rank", "vector_rank",
        F.concat_ws("+", F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("vector_rank").isNotNull(), "vector")).alias("provenance"),
    )
    order = [F.desc("score"), F.col("lexical_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), F.col(key)]
    return found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))
