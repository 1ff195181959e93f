"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

An item is the set of its shingles (runs of ``width`` words; see ``textvec`` for words). It is
contained in a document where some window of as many consecutive runs as the item has holds at
least ``need = ceil(threshold * size)`` of its distinct shingles. The plan:

1. One pass over the texts finds where any shingle of any item occurs; texts stay in place.
2. An item's shingles are ordered by rarity (documents that hold them, over all documents). A
   window with ``need`` of them holds one of the first ``size - need + 1``, so only hits of that
   prefix make a pair. A document with fewer runs than ``need`` makes none (length bound), and
   only windows that reach a prefix hit are looked at (positional bound).
3. Exact containment over those windows, from the hits that step 1 kept.

The item shingles are sent to the executors as a sorted array where there are at most
``broadcast_shingles`` of them. Beyond that a bitmap of their hashes is sent, which has 64 MB at most however
many there are; runs whose bit isn't set are no item's and stay, and only the rest is joined with the items.

Defined cases: null texts, on either side, and texts without words contain nothing and are
contained in nothing; an item of fewer words than ``width`` is the one run of all its words;
rows of the benchmark that repeat count once, and one item_id with several texts is contained
where any of them is, with the best of their values; a null item_id is an item like any other;
rows of documents that repeat give a result row each; of several best windows the first counts;
empty tables give empty results; further columns pass unchanged through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.common import BITS, digest, keep, materialise, may_hold, scratch, small_batches
from folioscan.llm.textvec import shingles, slices, word_hashes

WIDTH, THRESHOLD, BROADCAST_SHINGLES = 3, 0.6, 4_000_000


def _runs(part: pa.Array, widths: list[int]):
    """For each text its runs of every width as (start, hash), in one array each."""
    for texts in slices(part):
        words, off = word_hashes(texts)
        by = [shingles(words, w) for w in widths]
        for a, b in zip(off[:-1], off[1:]):
            parts = [h[a : max(a, b - w + 1)] for w, h in zip(widths, by)]
            yield np.concatenate([np.arange(len(p)) for p in parts]), np.concatenate(parts)


def _item_runs(width: int):
    @F.arrow_udf("struct<words:int,runs:array<bigint>>")
    def item_runs(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for t in part.to_pylist():
                words, _ = word_hashes([t])
                n = len(words)
                out.append({"words": n, "runs": shingles(words, min(width, n)).view(np.int64).tolist() if n else []})
            yield pa.array(out, type=pa.struct([("words", pa.int32()), ("runs", pa.list_(pa.int64()))]))

    return item_runs


def _low(v: np.ndarray, bits: int) -> np.ndarray:
    return (v & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(vocabulary: DataFrame, n: int, bits: int = BITS) -> np.ndarray:
    """One byte in eight bits: which low bits of a hash some shingle of the vocabulary has; built by the executors, ``bits`` / 8 bytes at most."""
    m = min(bits, 1 << max(15, (64 * n).bit_length()))
    at = F.col("v").bitwiseAND(F.lit(m - 1))
    maps = vocabulary.groupBy(F.shiftright(at, 15).alias("b")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("m")).toArrow()
    out = np.zeros(m // 8, dtype=np.uint8)
    for b, part in zip(maps["b"].to_pylist(), maps["m"]):
        out[b * 4096 : (b + 1) * 4096] = np.frombuffer(part.as_buffer(), dtype=np.uint8)
    return out


def _finder(vocabulary: np.ndarray | None, widths: list[int], shared=None):
    """Array of positions and array of shingles, of those in the vocabulary or, without it, of those in the shared bitmap."""
    if vocabulary is not None:
        vocabulary = np.sort(vocabulary.view(np.uint64))
        few = np.zeros(1 << 20, dtype=bool)
        few[_low(vocabulary, 1 << 20)] = True
    kind = pa.struct([("p", pa.list_(pa.int32())), ("v", pa.list_(pa.int64())), ("runs", pa.int32())])

    @F.arrow_udf("struct<p:array<int>,v:array<bigint>,runs:int>")
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = None if vocabulary is not None else shared.value
        for part in parts:
            ps, vs, sizes, runs = [], [], [], []
            for p, v in _runs(part, widths):
                runs.append(len(v))
                if vocabulary is not None:
                    maybe = np.flatnonzero(few[_low(v, 1 << 20)])
                    if len(maybe):
                        at = np.searchsorted(vocabulary, v[maybe])
                        at[at == len(vocabulary)] = 0
                        maybe = maybe[vocabulary[at] == v[maybe]]
                else:
                    at = _low(v, 8 * len(bits))
                    maybe = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                p, v = p[maybe], v[maybe]
                ps.append(p)
                vs.append(v)
                sizes.append(len(p))
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = lambda xs, t: pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(xs) if xs else np.empty(0, np.uint64)).astype(np.uint64).view(np.int64).astype(t)))
            yield pa.StructArray.from_arrays([flat(ps, np.int32), flat(vs, np.int64), pa.array(runs, type=pa.int32())], fields=list(kind))

    return find


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    own = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").alias("item_id"), "text").distinct()
    runs = own.select("item_id", _item_runs(width)("text").alias("r")).filter(F.size("r.runs") > 0)
    return materialise(runs.select(F.monotonically_increasing_id().alias("item"), "item_id", F.least(F.col("r.words"), F.lit(width)).alias("width"), F.size("r.runs").alias("span"), F.array_sort(F.array_distinct("r.runs")).alias("vs")), "leak-items")


def _best():
    """Of the hits of one item in one document, the first window with most distinct shingles: (count, start)."""

    @F.arrow_udf("struct<n:int,start:int>")
    def best(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ps, vs, mine, spans, anchors in parts:
            out = []
            for p, v, own, span, at in zip(ps.to_pylist(), vs.to_pylist(), mine.to_pylist(), spans.to_pylist(), anchors.to_pylist()):
                own, at = set(own), sorted(at)
                hits = sorted((x, y) for x, y in zip(p, v) if y in own)
                count: dict[int, int] = {}
                lo = near = top = start = 0
                for x, y in hits:
                    count[y] = count.get(y, 0) + 1
                    while hits[lo][0] <= x - span:
                        z = hits[lo][1]
                        count[z] -= 1
                        if not count[z]:
                            del count[z]
                        lo += 1
                    while near < len(at) and at[near] <= x - span:
                        near += 1
                    if near < len(at) and at[near] <= x and len(count) > top:  # the window reaches a prefix hit
                        top, start = len(count), hits[lo][0]
                out.append({"n": top, "start": start})
            yield pa.array(out, type=pa.struct([("n", pa.int32()), ("start", pa.int32())]))

    return best


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float, broadcast_shingles: int) -> DataFrame:
    """A stored table (row, item_id, doc_id, digest, x, m) of what is contained in which row."""
    spark = docs.sparkSession
    with scratch(spark):
        items = _items(benchmark, width)
        need = F.greatest(F.lit(1), F.ceil(F.size("vs") * F.lit(threshold) - 1e-9)).cast("int")
        words = items.select("item", "item_id", "width", "span", "vs", F.size("vs").alias("size"), need.alias("need"))
        vocabulary = items.select(F.explode("vs").alias("v")).distinct()
        widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [width]  # at most ``width`` of them
        rows = small_batches(docs).filter(F.col("text").isNotNull()).select("doc_id", "text", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("x"))
        n = vocabulary.count()
        found = _finder(vocabulary.toPandas()["v"].to_numpy(dtype=np.int64), widths) if n <= broadcast_shingles else _finder(None, widths, spark.sparkContext.broadcast(_bitmap(vocabulary, n)))
        hits = rows.select("doc_id", "digest", "x", found("text").alias("h")).filter(F.size("h.v") > 0)
        hits = hits.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "x", F.col("h.p").alias("p"), F.col("h.v").alias("v"), F.col("h.runs").alias("runs"))
        hits = materialise(hits, "leak-hits")
        at = hits.select("row", "runs", F.explode(F.arrays_zip("p", "v")).alias("z")).select("row", "runs", F.col("z.p").alias("p"), F.col("z.v").alias("v"))
        if n > broadcast_shingles:  # the bitmap's hits, without those that are no item's
            at = materialise(at.join(vocabulary, "v", "left_semi").select("row", "runs", "p", "v"), "leak-runs")
            sure = at.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("z"))
            hits = materialise(hits.select("row", "doc_id", "digest", "x", "runs").join(sure, "row").select("row", "doc_id", "digest", "x", F.col("z.p").alias("p"), F.col("z.v").alias("v"), "runs"), "leak-sure")
        frequency = hits.select(F.explode(F.array_distinct("v")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("docs"))
        ordered = words.select("item", "size", "need", F.explode("vs").alias("v")).join(frequency, "v", "left").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "v")))
        prefix = ordered.filter("docs is not null and rank <= size - need + 1").select("item", "need", "v")
        pairs = at.join(prefix, "v").filter("runs >= need").groupBy("row", "item").agg(F.collect_set("p").alias("anchors"))
        looked = pairs.join(hits, "row").join(words.withColumnRenamed("vs", "own"), "item")
        b = looked.select("doc_id", "digest", "x", "item_id", "size", "need", _best()("p", "v", "own", "span", "anchors").alias("b"), "row")
        best = F.max(F.struct((F.col("b.n") / F.col("size")).alias("c"), (-F.col("b.start")).alias("s"))).alias("m")
        return keep(materialise(b.filter("b.n >= need").groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("x").alias("x"), best), "leaks"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, containment, start_word) for each document and benchmark item that it contains; start_word is the window's first hit, from 0."""
    found = _leaks(docs, benchmark, width, threshold, broadcast_shingles)
    return found.select("doc_id", "item_id", F.round("m.c", 6).alias("containment"), (-F.col("m.s")).alias("start_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item.

    Rows that surely stay, by a bitmap of the others' texts, aren't moved; nor are those that surely go. What is moved
    are texts whose hash falls on that of a text that goes, to be compared by digest.
    """
    bad = _leaks(docs, benchmark, width, threshold, broadcast_shingles).select(F.col("digest").alias("__fs_bad"), F.col("x").alias("__fs_bx")).distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    tagged = may_hold(docs.withColumn("__fs_x", F.xxhash64("text")), F.when(F.col("text").isNotNull(), F.col("__fs_x")), bad.select("__fs_bx"))
    rest = tagged.filter("__fs_may").drop("__fs_may").withColumn("__fs_digest", digest(F.col("text")))
    own = rest.select(F.col("__fs_digest").alias("__fs_d"), F.col("__fs_x").alias("__fs_dx")).distinct()
    innocent = materialise(own.join(bad.select("__fs_bad").hint("merge"), own["__fs_d"] == bad["__fs_bad"], "left_anti"), "leak-innocent")
    maybe = may_hold(rest, F.col("__fs_x"), innocent.select("__fs_dx")).filter("__fs_may")
    kept = maybe.join(innocent.select("__fs_d").hint("merge"), maybe["__fs_digest"] == innocent["__fs_d"], "left_semi")
    return tagged.filter("not __fs_may").select(*cols).unionByName(kept.select(*cols))
