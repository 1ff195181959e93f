"""Differences of versions: path sets, renames, chunks, orphans; all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_plan(indexed: DataFrame, present: DataFrame, selected: DataFrame, key: str = "path") -> DataFrame:
    """(key, state): added, continuing, missing (indexed, selected or not, but gone) or unselected (indexed and there, but not asked for)."""
    tag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    j = tag(indexed, "i").join(tag(present, "p"), key, "full_outer").join(tag(selected, "s"), key, "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(yes("i") & ~yes("p"), "missing").when(yes("i") & yes("s"), "continuing").when(yes("i"), "unselected").when(yes("s") & yes("p"), "added")
    return j.select(key, state.alias("state")).filter("state is not null")


def rename_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path, sha256): content of a vanished path that turns up under one new path; only where it is 1:1 on both sides. Inputs: (path, sha256)."""
    gone, added = old.join(new.select("path"), "path", "left_anti"), new.join(old.select("path"), "path", "left_anti")
    once = lambda df, name: df.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias(name)).filter("n = 1").drop("n")
    return once(gone, "old_path").join(once(added, "new_path"), "sha256").select("old_path", "new_path", "sha256")


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, action, logical_key, old_ordinal, new_ordinal) from (source, logical_key, ordinal, semantic_hash) on either side.

    First the k-th chunk of a key pairs with the k-th of that key; of what is left, chunks whose
    hash is unique in the source on both sides pair; the rest is deleted or inserted. Paired
    chunks are kept where the hash is the same, else updated; those paired by hash are moved.
    """
    k = F.row_number().over(W.partitionBy("source", "logical_key").orderBy("ordinal"))
    a = old.withColumn("k", k).select("source", "logical_key", "k", F.col("ordinal").alias("old_ordinal"), F.col("semantic_hash").alias("old_hash"))
    b = new.withColumn("k", k).select("source", "logical_key", "k", F.col("ordinal").alias("new_ordinal"), F.col("semantic_hash").alias("new_hash"))
    j = a.join(b, ["source", "logical_key", "k"], "full_outer")
    hash_ = F.coalesce(F.when(F.col("new_ordinal").isNull(), F.col("old_hash")), F.when(F.col("old_ordinal").isNull(), F.col("new_hash")))
    left = j.withColumn("h", hash_)
    by_hash = W.partitionBy("source", "h")
    olds = F.count(F.when(F.col("h").isNotNull() & F.col("new_ordinal").isNull(), 1)).over(by_hash)
    news = F.count(F.when(F.col("h").isNotNull() & F.col("old_ordinal").isNull(), 1)).over(by_hash)
    partner = F.max("new_ordinal").over(by_hash)
    w = left.select("*", olds.alias("olds"), news.alias("news"), partner.alias("partner"))
    moved = F.col("h").isNotNull() & (F.col("olds") == 1) & (F.col("news") == 1)
    action = (
        F.when(moved & F.col("old_ordinal").isNull(), F.lit(None))  # the old side stands for both
        .when(moved, "move")
        .when(F.col("new_ordinal").isNull(), "delete")
        .when(F.col("old_ordinal").isNull(), "insert")
        .when(F.col("old_hash") == F.col("new_hash"), "keep")
        .otherwise("update")
    )
    out = w.select("source", action.alias("action"), "logical_key", "old_ordinal", F.when(moved, F.col("partner")).otherwise(F.col("new_ordinal")).alias("new_ordinal"))
    return out.filter("action is not null")


def freshness(expected: DataFrame, found: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """(key, state): missing, extra or mismatch; equal entries aren't listed."""
    j = expected.select(key, F.col(value).alias("want")).join(found.select(key, F.col(value).alias("have")), key, "full_outer")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "mismatch")
    return j.select(key, state.alias("state")).filter("state is not null")


def lacking(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: the anti join behind missing vectors, orphan embeddings, orphan links and prune plans."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by ``order``."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__k = 1").drop("__k")
