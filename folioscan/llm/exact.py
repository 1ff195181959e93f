"""Exact dedup against a persistent digest index.

The index is a Parquet table of SHA-256 digests, bucketed and sorted by digest, in a folder
that outlives the session and also holds the number of its buckets. A batch is reduced to one candidate per
digest (map-side combine, digests and ids only), anti-joined with the index by sort-merge (the index side
needs neither shuffle nor, with one file per bucket, sort) and what is new is appended.

A batch has a name. What was found new in it is first written beside the index under that name,
complete or not at all, and then appended; whoever asks for the same batch again, after a failure
wherever it happened, gets the same rows. An append that is repeated adds digests twice, which no
anti-join minds and ``compact`` removes.

Defined cases: a null text has no digest, never counts as a copy and always stays; the empty
text is a text like any other; of copies the row with the least doc_id stays (a null id comes
after all others), of rows that repeat text and doc_id any one, and as they agree in both only
further columns can tell which; of copies in different batches that of the first batch stays; an empty
batch adds nothing; an index opened with another number of buckets than it has is an error; further
columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import delete_path, digest, keep_rows, shared_dir

BUCKETS = 64


class DigestIndex:
    """Digests of all texts seen so far, at ``path``, in ``buckets`` buckets, which only the first call chooses.

    At 10^10 digests of 32 bytes, 4,096 buckets make files of about 80 MB.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._recorded(buckets)
        self.table = "fs_digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _recorded(self, buckets: int | None) -> int:
        fs, p = self._file("buckets.json")
        if fs.exists(p):
            have = json.loads(self.spark.read.text(f"{self.path}/buckets.json", wholetext=True).first()[0])
            if buckets not in (None, have):
                raise ValueError(f"the index at {self.path} has {have} buckets, not {buckets}")
            return have
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(buckets or BUCKETS).encode()))
        out.close()
        return buckets or BUCKETS

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def judged(self, docs: DataFrame) -> DataFrame:
        """(__fs_digest, __fs_id, __fs_x, __fs_keep, __fs_doubt): each text of ``docs`` once, with its least id, whether the index lacks it, and whether a row of it has to go."""
        one = (
            docs.filter(F.col("text").isNotNull())
            .select(digest(F.col("text")).alias("__fs_digest"), F.col("doc_id").alias("__fs_id"), F.xxhash64("text").alias("__fs_x"))
            .groupBy("__fs_digest")
            .agg(F.min("__fs_id").alias("__fs_id"), F.min("__fs_x").alias("__fs_x"), F.count(F.lit(1)).alias("__fs_n"))
        )
        seen = self.read().select(F.col("digest").alias("__fs_seen")).hint("merge")
        met = one["__fs_digest"] == seen["__fs_seen"]
        new = one.join(seen, met, "left_anti").select("__fs_digest", "__fs_id", "__fs_x", F.lit(True).alias("__fs_keep"), (F.col("__fs_n") > 1).alias("__fs_doubt"))
        return new.unionByName(one.join(seen, met, "left_semi").select("__fs_digest", "__fs_id", "__fs_x", F.lit(False).alias("__fs_keep"), F.lit(True).alias("__fs_doubt")))

    def fresh(self, docs: DataFrame) -> DataFrame:
        """(__fs_digest, __fs_id): one row for each text of ``docs`` that the index lacks."""
        return self.judged(docs).filter("__fs_keep").select("__fs_digest", "__fs_id")

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch; returns its ``judged`` texts as they were before. The same name gives the same rows again."""
        name = hashlib.sha256((batch or uuid.uuid4().hex).encode()).hexdigest()[:32]
        staged, done = f"{self.path}/staged/{name}", f"{self.path}/done/{name}"
        fs, complete = self._file(f"staged/{name}/_SUCCESS")
        if not fs.exists(complete):
            self.judged(docs).write.mode("overwrite").parquet(staged)
        new = self.spark.read.parquet(staged)
        fs, marker = self._file(f"done/{name}")
        if not fs.exists(marker):
            (
                new.filter("__fs_keep").select(F.col("__fs_digest").alias("digest"))
                .repartition(self.buckets, "digest")
                .sortWithinPartitions("digest")
                .write.mode("append")
                .format("parquet")
                .bucketBy(self.buckets, "digest")
                .sortBy("digest")
                .option("path", f"{self.path}/digests")
                .saveAsTable(self.table)
            )
            fs.create(marker, True).close()
        return new

    def forget(self, batch: str) -> None:
        """Delete what is kept of a batch for a second call, once its rows are safe."""
        delete_path(self.spark, f"{self.path}/staged/{hashlib.sha256(batch.encode()).hexdigest()[:32]}")

    def compact(self, to: str) -> "DigestIndex":
        """The same digests in one file per bucket, at another path."""
        out = DigestIndex(self.spark, to, self.buckets)
        (
            self.read().distinct().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{out.path}/digests").saveAsTable(out.table)
        )
        return out


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is new to the index, one for each text; see the module for the defined cases. Texts of which no row goes stay where they are."""
    return keep_rows(docs, (index or new_index(docs.sparkSession)).ingest(docs, batch))


def exact_dedup_ids(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, digest as hex) of the rows that ``exact_dedup`` keeps; the texts are read once and never shuffled."""
    judged = (index or new_index(docs.sparkSession)).ingest(docs, batch)
    kept = judged.filter("__fs_keep").select(F.col("__fs_id").alias("doc_id"), F.lower(F.hex("__fs_digest")).alias("digest"))
    return kept.unionByName(docs.filter(F.col("text").isNull()).select("doc_id", F.lit(None).cast("string").alias("digest")))


def arrivals(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` in the order of their ids, in as many parts of equal id ranges; null ids come last. Each row is in one part."""
    r = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if r[0] is None or batches < 2:
        return [docs]
    ends = [r[0] + (r[1] - r[0] + 1) * k // batches for k in range(1, batches)]
    i = F.col("doc_id")
    return [docs.filter(i < ends[0]), *[docs.filter((i >= a) & (i < b)) for a, b in zip(ends, ends[1:])], docs.filter((i >= ends[-1]) | i.isNull())]
