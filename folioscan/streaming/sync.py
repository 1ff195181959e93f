"""A folder as a stream of files into a store: each micro-batch is a partial sync of the files that are new.

State is the store itself, so that no watermark is needed: a batch that is run again after a
failure finds its files unchanged and publishes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.store import Options, Store, stub_embedder

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_into(store: Store, folder: str, checkpoint: str, options: Options | None = None, embed=stub_embedder, available_now: bool = True, glob: str = "*") -> StreamingQuery:
    """Start the query; with ``available_now`` it ends when all files that are there have been taken in."""
    files = store.spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    base = "^(file:)?/*" + re.escape(re.sub(r"^(file:)?/+", "", folder.rstrip("/"))) + "/"

    def batch(df: DataFrame, _: int) -> None:
        taken = df.select(F.regexp_replace("path", base, "").alias("path"), "content", "modificationTime")
        newest = taken.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content"))
        Store(store.spark, store.root, create=True).sync(newest, options, embed, partial=True)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
