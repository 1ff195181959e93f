"""Counts, sizes and fingerprints of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of each table."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows")).select("name", "n_rows") for name, df in sorted(tables.items())])


def text_sizes(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, n_chars): total length of one column of each table, 0 for none."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("n_chars")).select("name", "n_chars") for name, (df, c) in sorted(tables.items())])


def row_digest(columns: list[Column | str]) -> Column:
    """SHA-256 of a row's values as text; null is a value of its own."""
    as_text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000"))
    return F.sha2(F.concat_ws("\u001f", *map(as_text, columns)), 256)


def fingerprints(df: DataFrame, columns: list[Column | str], by: str) -> DataFrame:
    """(by, n_rows, xor_hash, sum_hash): the same for the same rows in any order; two numbers are summed up of 60 bits of each row's digest, and no group is gathered."""
    h = F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("bigint")
    return df.select(by, h.alias("h")).groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def vector_digests(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, size, digest): a vector's size and the SHA-256 of its values, as whole multiples of 10^-6."""
    whole = F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",")
    return vectors.select(key, F.size(vector).alias("size"), F.sha2(whole, 256).alias("digest"))


def pair_counts(left: DataFrame, right: DataFrame, on: str, name: str) -> DataFrame:
    """(pair, chunks, vectors, orphans, lacking): rows on either side, those on the right without the left and the other way round."""
    j = left.select(on, F.lit(1).alias("d")).join(right.select(on, F.lit(1).alias("e")), on, "full_outer")
    return j.agg(F.lit(name).alias("pair"), F.count("d").alias("chunks"), F.count("e").alias("vectors"), F.count_if(F.col("d").isNull()).alias("orphans"), F.count_if(F.col("e").isNull()).alias("lacking"))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, exclusive or of row hashes): the same for the same rows in any order and number of files; one row reaches the driver."""
    r = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1]) ^ int(r[2])


def allocation(files: DataFrame, live: DataFrame) -> DataFrame:
    """(used, reclaimable, reclaimable_pct) of files (path, bytes) of which ``live`` (path) are referred to."""
    j = files.join(live.select("path", F.lit(True).alias("l")).distinct(), "path", "left")
    used = F.coalesce(F.sum(F.when(F.col("l"), F.col("bytes"))), F.lit(0))
    free = F.coalesce(F.sum(F.when(F.col("l").isNull(), F.col("bytes"))), F.lit(0))
    return j.agg(used.alias("used"), free.alias("reclaimable"), F.round(F.when(used + free > 0, 100 * free / (used + free)).otherwise(0.0), 2).alias("reclaimable_pct"))


def size_by_object(files: DataFrame) -> DataFrame:
    """(object, bytes, files) of (object, bytes), largest first."""
    return files.groupBy("object").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files")).orderBy(F.desc("bytes"), "object")
