"""What the operators of this package share: the shared folder, cut lineage, row identity and filters without a shuffle.

Columns that an operator adds for its own use start with ``__fs_``, so that columns of the
caller, whatever their names, are never mistaken for them.

Whether a row goes is often known of few rows only. ``may_hold`` finds the others by a bitmap of
the few keys' hashes, which has at most ``BITS`` bits (64 MB) and is broadcast; a bit that is not set
is proof, so that such rows stay where they are, and only the rest is shuffled and decided
exactly. With more keys than the bitmap has room for, more rows travel and none is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 29
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs in this process alone, as in a local test, a folder of this
    machine is made and set; on a cluster without that setting it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(df: DataFrame, size: str = "2m") -> DataFrame:
    """``df``; texts go to Python in batches of 2 MB from now on, unless the session has a size of its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH) and spark.conf.get(_BATCH, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(_BATCH, size)
    return df


_written: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation, and ids given out before the
    write stay what they are. Within ``scratch`` the table is deleted at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fs_path = path
    return out


def keep(df: DataFrame) -> DataFrame:
    """A table of ``materialise`` that a lazy result still reads: it outlives ``scratch``."""
    if _written:
        _written[-1].remove(df._fs_path)
    return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes within is deleted at the end, but for what ``keep`` was told."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Hadoop knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, 32 bytes; null for null."""
    return F.unhex(F.sha2(text, 256))


def may_hold(rows: DataFrame, key: Column, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with ``__fs_may``: false only where ``key``, a bigint hash, isn't in the one column of ``keys``. Null keys are false."""
    name = keys.columns[0]
    m = min(bits, 1 << max(15, (64 * keys.count()).bit_length()))
    place = lambda c: c.bitwiseAND(F.lit(m - 1))
    maps = keys.groupBy(F.shiftright(place(F.col(name)), 15).alias("__fs_bucket")).agg(F.bitmap_construct_agg(place(F.col(name)).bitwiseAND(F.lit(32767))).alias("__fs_map"))
    at = place(F.col("__fs_key"))
    met = rows.withColumn("__fs_key", key).join(F.broadcast(maps), F.shiftright(at, 15) == F.col("__fs_bucket"), "left")
    at = at.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substr("__fs_map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return met.withColumn("__fs_may", may).drop("__fs_key", "__fs_bucket", "__fs_map")


def row_key(x: Column, doc_id: Column) -> Column:
    """Hash of a text's hash and an id."""
    return F.xxhash64(x, F.lit(7), doc_id)


def keep_rows(docs: DataFrame, judged: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, one of each text and doc_id; rows with a null text stay.

    ``judged`` is a stored table with a row for each text: its digest, its hash ``__fs_x`` (xxhash64), the
    doc_id ``__fs_id`` that stays if ``__fs_keep``, and ``__fs_doubt``, whether any row of that text may have to go.
    Rows of texts without doubt pass where they are. Of the rest, those that are surely not kept are dropped
    where they are; what may be kept is reduced to one row of each text and id before it moves, so that a text
    that a third of all rows repeat moves once a task, and is decided by a sort-merge join.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    doubtful = judged.filter("__fs_doubt").select("__fs_x")
    tagged = may_hold(docs.withColumn("__fs_x", F.xxhash64("text")), F.when(F.col("text").isNotNull(), F.col("__fs_x")), doubtful, bits)
    sure = tagged.filter("not __fs_may").select(*cols)
    # texts that only seem doubtful, by the bitmap, are kept like those that are
    k = may_hold(judged.filter("__fs_keep").select("__fs_digest", "__fs_id", "__fs_x"), F.col("__fs_x"), doubtful, bits).filter("__fs_may")
    kept_key = k.select(row_key(F.col("__fs_x"), F.col("__fs_id")).alias("__fs_y"))
    second = may_hold(tagged.filter("__fs_may").drop("__fs_may"), row_key(F.col("__fs_x"), F.col("doc_id")), kept_key, bits).filter("__fs_may")
    once = second.withColumn("__fs_digest", digest(F.col("text"))).withColumn("__fs_id", F.col("doc_id")).dropDuplicates(["__fs_digest", "__fs_id"])
    k = k.select(F.col("__fs_digest").alias("__fs_kd"), F.col("__fs_id").alias("__fs_ki"))
    kept = once.join(k.hint("merge"), (once["__fs_digest"] == k["__fs_kd"]) & once["__fs_id"].eqNullSafe(k["__fs_ki"]), "left_semi")
    return sure.unionByName(kept.select(*cols))
