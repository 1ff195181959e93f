"""Near-duplicate search with bottom-k sketches of one hash function.

A text's shingles are its runs of ``width`` words; its sketch is the ``k`` least hashes among
them. Equal texts count as one node. The plan:

1. Nodes: one row per distinct text with sketch, set size and least doc_id (one read of the texts, which
   stay where they are; only sketches move).
2. Inverted lists: a pair with Jaccard similarity J shares each of the ``k`` least values of
   its union with probability J, so that ``need = floor(slack * size)`` shared values are
   asked for. Values are ordered by document frequency, rarest first; two sketches that share
   ``need`` values share one among the first ``size - need + 1`` of that order, so only those
   are listed. Passages that many documents hold are frequent and so drop out of the lists of
   every document that has enough text of its own; no list is ever cut.
3. Estimate on the union's sketch, then exact Jaccard. For the latter, pairs are gathered into
   tasks by their least neighbour, so that a group's shingle sets travel once, not once per
   pair; a task beyond ``block`` shingles is split by node hash into pairs of blocks, and small
   tasks share a bin. Texts that are read again for it are picked by a bitmap of bounded size.
4. Groups: connected components of the verified pairs, by alternating large and small stars.
   A group of m texts has m(m-1)/2 pairs, so for groups steps 2 and 3 run twice: first each
   text is held against the two ends of its lists, then every two texts of a list that are
   not in one group by then. For that the groups of a list meet first and only then their members, so
   that one stray on a list of a million texts of one group makes a million pairs, not their
   square. Both together give the components that all pairs would give.

Recall: with k = 32 and slack = 0.28 a pair at the threshold 0.5 passes steps 2 and 3 with a
probability over 0.99 each; pairs above it with more.

Defined cases: a null text belongs to no group and always stays; equal texts, the empty one
too, are one group whatever their ids; a text of fewer words than ``width`` has one shingle,
all its words; texts without any word match only equal texts; rows that repeat text and
doc_id count once in a group and the filter keeps one of them; in a group the row with the
least doc_id stays (null ids last, then the least digest); an empty table gives an empty
result; further columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import delete_path, digest, keep, keep_rows, materialise, may_hold, row_key, scratch, small_batches
from folioscan.llm.textvec import shingle_sets, slices

WIDTH, K, THRESHOLD, SLACK, BLOCK = 3, 32, 0.5, 0.28, 500_000
#: With the top bit flipped, the signed order of stored values is the unsigned order of the hashes by which the least were taken.
_TOP = np.uint64(1 << 63)


def _sketcher(width: int, k: int):
    kind = pa.struct([("sk", pa.list_(pa.int64())), ("n", pa.int64())])

    @F.arrow_udf("struct<sk:array<bigint>,n:bigint>")
    def sketch(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            values, sizes, ns = [], [], []
            for texts in slices(part):
                for found in shingle_sets(texts, width):
                    values.append((found[:k] ^ _TOP).view(np.int64))  # a copy; a view would keep all shingles
                    sizes.append(min(k, len(found)))
                    ns.append(len(found))
            offsets = np.zeros(len(part) + 1, dtype=np.int32)
            np.cumsum(sizes, out=offsets[1:])
            sk = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))
            yield pa.StructArray.from_arrays([sk, pa.array(ns, type=pa.int64())], fields=list(kind))

    return sketch


def nodes_of(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(node, digest, x, id, rows, sk, n): one row per distinct text, kept in the shared folder; node is a number of that table alone, id the least doc_id, rows the number of its rows."""
    text = F.col("text")
    rows = small_batches(docs).filter(text.isNotNull()).select(F.col("doc_id").alias("id"), digest(text).alias("digest"), F.xxhash64(text).alias("x"), _sketcher(width, k)("text").alias("s"))
    one = rows.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("x"), F.first("s").alias("s"))
    return materialise(one.select(F.monotonically_increasing_id().alias("node"), "digest", "x", "id", "rows", F.array_sort("s.sk").alias("sk"), F.col("s.n").alias("n")), "near-nodes")


def _need(size, slack: float):
    return F.greatest(F.lit(1), F.floor(size * F.lit(slack))).cast("int")


def inverted_lists(nodes: DataFrame, slack: float = SLACK) -> DataFrame:
    """(v, node, n): the values by which each node can be found, those of step 2."""
    sized = nodes.filter(F.size("sk") > 0).select("node", "n", F.size("sk").alias("size"), F.explode("sk").alias("v"))
    freq = sized.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = sized.join(freq, "v")
    ordered = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"))
    # values that no other sketch has are the rarest and fill the first places
    room = F.col("size") - _need(F.col("size"), slack) + 1 - (F.col("size") - F.size("vs"))
    prefix = ordered.filter(room > 0).select("node", "n", F.explode(F.slice("vs", F.lit(1), room)).alias("x"))
    return materialise(prefix.select(F.col("x.v").alias("v"), "node", "n"), "near-lists")


def _alike(threshold: float):
    return F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)


def all_pairs(lists: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): every two nodes on a common list whose set sizes allow the threshold."""
    side = lambda c: lists.select("v", F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    return side("a").join(side("b"), "v").filter((F.col("a") < F.col("b")) & _alike(threshold)).select("a", "b").distinct()


def cross_pairs(lists: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): every two nodes of different ``label`` on a common list whose set sizes allow the threshold.

    On long lists with few labels, labels meet first, so that nodes of one label never do; on the others, where most
    pairs are of different labels anyway, nodes meet at once.
    """
    groups = lists.groupBy("v", "label").agg(F.count(F.lit(1)).alias("m"))
    kinds = groups.groupBy("v").agg(F.count(F.lit(1)).alias("labels"), F.sum("m").alias("m")).filter("labels > 1")
    kinds = kinds.select("v", ((F.col("m") > 64) & (4 * F.col("labels") < F.col("m"))).alias("few"))
    mixed = materialise(lists.join(kinds, "v"), "near-mixed")
    loose, dense = mixed.filter("not few"), mixed.filter("few")
    member = lambda df, c: df.select("v", F.col("label").alias(f"l{c}"), F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    met = member(loose, "a").join(member(loose, "b"), "v").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _alike(threshold)).select("a", "b")
    own = dense.groupBy("v", "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = lambda c: own.select("v", F.col("label").alias(f"l{c}"), F.col("lo").alias(f"lo{c}"), F.col("hi").alias(f"hi{c}"))
    could = (F.col("hia") >= F.col("lob") * F.lit(threshold)) & (F.col("hib") >= F.col("loa") * F.lit(threshold))
    pairs = side("a").join(side("b"), "v").filter((F.col("la") < F.col("lb")) & could).select("v", "la", "lb")
    pairs = pairs.join(member(dense, "a"), ["v", "la"]).join(member(dense, "b"), ["v", "lb"]).filter(_alike(threshold))
    return met.union(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def star_pairs(lists: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): each node with the least and the greatest node of its lists; no more pairs than list entries, twice."""
    ends = lists.groupBy("v").agg(F.min(F.struct("node", "n")).alias("x"), F.max(F.struct("node", "n")).alias("y"))
    heads = ends.filter("x.node <> y.node").select("v", F.explode(F.array("x", "y")).alias("h"))
    met = lists.join(heads, "v").select("node", F.col("n").alias("na"), F.col("h.node").alias("head"), F.col("h.n").alias("nb"))
    return met.filter((F.col("node") != F.col("head")) & _alike(threshold)).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def estimated(pairs: DataFrame, nodes: DataFrame, k: int = K, slack: float = SLACK) -> DataFrame:
    """(a, b, na, nb): the pairs that share enough of the sketch of their union, with their set sizes."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sk").alias(f"sk{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("ska", "skb")), 1, k)
    hit = F.size(F.array_intersect(F.array_intersect("ska", "skb"), union))
    return materialise(both.filter(hit >= _need(F.size(union), slack)).select("a", "b", "na", "nb"), "near-pairs")


def _set_maker(width: int):
    @F.arrow_udf("array<bigint>")
    def sets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            values = [x.view(np.int64) for texts in slices(part) for x in shingle_sets(texts, width)]
            offsets = np.zeros(len(part) + 1, dtype=np.int32)
            np.cumsum([len(v) for v in values], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))

    return sets


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of the sorted set ``x`` each of the others, none empty, holds."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    sizes = np.array([len(o) for o in others])
    return np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def _verify(threshold: float, together: int = 1 << 19):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        own = {n: np.sort(s) for n, s in zip(sets["node"], sets["shingles"])}
        left, right, found = [], [], []
        for a, part in pairs.groupby("a"):
            x, bs = own[a], part["b"].to_numpy()
            sizes = np.array([len(own[b]) for b in bs])
            turn = np.cumsum(sizes) // together  # a partner's whole set, many partners at once
            for t in np.unique(turn):
                some, n = bs[turn == t], sizes[turn == t]
                both = _shared(x, [own[b] for b in some])
                j = both / (len(x) + n - both)
                good = j >= threshold
                left.append(np.full(good.sum(), a))
                right.append(some[good])
                found.append(j[good])
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
        return pd.DataFrame({"a": cat(left, "int64"), "b": cat(right, "int64"), "jaccard": cat(found, "float64")})

    return run


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, jaccard) of the candidate pairs (a, b, na, nb) whose exact Jaccard similarity reaches the threshold."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("na").alias("n")).union(pairs.select("b", "a", "nb"))
    least = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    put = pairs.join(least.select(F.col("node").alias("a"), F.col("least").alias("la")), "a").join(least.select(F.col("node").alias("b"), F.col("least").alias("lb")), "b").select("a", "b", "na", "nb", F.least("la", "lb").alias("task"))
    put = materialise(put, "near-tasks")
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("e")
    members = put.select("task", both).select("task", "e.*").distinct()
    blocks = members.groupBy("task").agg(F.ceil(F.sum("n") / block).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    keyed = put.join(blocks, "task").select("a", "b", "na", "nb", F.xxhash64("task", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("h"))
    keyed = materialise(keyed, "near-blocks")
    # small tasks share a bin, so that a bin has about as many shingles as one full task
    total = keyed.select("h", both).select("h", "e.*").distinct().agg(F.sum("n")).first()[0] or 0
    keyed = keyed.select(F.pmod("h", F.lit(total // block + 1)).alias("bin"), "a", "b")
    wanted = keyed.select(F.col("bin").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()
    bins = wanted.groupBy("node").agg(F.collect_list("to").alias("to"))  # as many as the node has blocks, each full of shingles
    ids = materialise(bins.join(nodes.select("node", "digest", "x", "id"), "node"), "near-wanted")
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("__fs_id"), "text")
    again = may_hold(rows, row_key(F.xxhash64("text"), F.col("__fs_id")), ids.select(row_key(F.col("x"), F.col("id")).alias("y"))).filter("__fs_may")
    again = again.select(digest(F.col("text")).alias("digest"), "text").dropDuplicates(["digest"])
    sets = again.join(ids.hint("merge"), "digest").select("node", "to", _set_maker(width)("text").alias("shingles"))
    sent = sets.select("node", F.explode("to").alias("to"), "shingles")
    return keyed.groupBy("bin").cogroup(sent.groupBy("to")).applyInPandas(_verify(threshold), "a bigint, b bigint, jaccard double")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each connected component, for every node of ``edges`` (a, b).

    Each round is a large star (every greater neighbour is linked to the least one) and a
    small star (every lesser neighbour likewise); rounds grow with the logarithm of the
    number of nodes. It ends when a round changes nothing.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    last = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = materialise(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_pairs(docs: DataFrame, width: int = WIDTH, k: int = K, threshold: float = THRESHOLD, slack: float = SLACK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs): the distinct texts, and all of their pairs (a, b, jaccard) that are near duplicates; equal texts share a node."""
    with scratch(docs.sparkSession):
        nodes = keep(nodes_of(docs, width, k))
        pairs = estimated(all_pairs(inverted_lists(nodes, slack), threshold), nodes, k, slack)
        return nodes, keep(materialise(verified(docs, nodes, pairs, width, threshold, block), "near-verified"))


def _grouped(docs: DataFrame, width: int = WIDTH, k: int = K, threshold: float = THRESHOLD, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """(label, digest, x, id, rows) of every distinct text, without all pairs of a group, which are as many as its square: first stars, then every pair that stars left apart."""
    with scratch(docs.sparkSession):
        nodes = nodes_of(docs, width, k)
        lists = inverted_lists(nodes, slack)
        stars = estimated(star_pairs(lists, threshold), nodes, k, slack)
        edges = materialise(verified(docs, nodes, stars, width, threshold, block), "near-stars")
        first = components(edges)
        apart = materialise(lists.join(first, "node", "left").select("v", "node", "n", F.coalesce("label", "node").alias("label")), "near-apart")
        rest = estimated(cross_pairs(apart, threshold).join(stars.select("a", "b"), ["a", "b"], "left_anti"), nodes, k, slack)
        more = materialise(verified(docs, nodes, rest, width, threshold, block), "near-rest")
        labels = components(edges.select("a", "b").union(more.select("a", "b")))
        return keep(materialise(nodes.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), "digest", "x", "id", "rows"), "near-grouped"))


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, keep_id, n_docs): each document that has near duplicates, once, with the least id of its class and the number of ids in that class.

    Copies aren't expanded into pairs and no class is gathered: a class may hold a third of all rows. Rows without an id aren't listed.
    """
    grouped = _grouped(docs, **how)
    ids = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", digest(F.col("text")).alias("digest"))
    member = materialise(ids.join(grouped.select("digest", "label").hint("merge"), "digest").select("doc_id", "label").distinct(), "near-members")
    delete_path(docs.sparkSession, grouped._fs_path)
    classes = member.groupBy("label").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_docs")).filter("n_docs > 1")
    return member.join(classes, "label").select("doc_id", "keep_id", "n_docs")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays; see the module for which, and for the defined cases."""
    grouped = _grouped(docs, **how)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    classes = grouped.groupBy("label").agg(F.min(first)["digest"].alias("kept"), F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("all"))
    judged = grouped.join(classes, "label").select(
        F.col("digest").alias("__fs_digest"), F.col("id").alias("__fs_id"), F.col("x").alias("__fs_x"), (F.col("digest") == F.col("kept")).alias("__fs_keep"), ((F.col("texts") > 1) | (F.col("all") > 1)).alias("__fs_doubt"),
    )
    judged = materialise(judged, "near-judged")
    delete_path(docs.sparkSession, grouped._fs_path)
    return keep_rows(docs, judged)
