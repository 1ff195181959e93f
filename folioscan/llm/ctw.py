"""LM scoring by context-tree weighting over byte contexts.

Each byte is coded as eight binary decisions, most significant first. A decision, given by the
bits before it, has a tree of contexts: the root (no context), then the last byte, the last
two, to ``DEPTH`` bytes. A node holds how often its decision fell on either side in the corpus;
its Krichevsky-Trofimov block probability depends on those two counts alone, so that counting
can be spread and summed in any order. From the deepest nodes up,

    log Pw = log Pe                                         at depth DEPTH
    log Pw = log(1/2) + log(Pe + product of the children's Pw)   above,

and the predictive probability of a decision is the mixture over all depths of the estimates
(n + 1/2) / (n0 + n1 + 1), each weighted by the posterior that the tree ends there. A byte
costs the sum of its eight decisions, a text the sum of its bytes; the result is bits per byte.

The plan: (1) counts of all runs of DEPTH + 1 bytes, summed in each task, then by shuffle: what
is gathered follows the corpus and its variety. (2) The tree is worked upwards in groups that
share the last two bytes, each on its own; sums per last byte (65,280 rows at most, whatever
the corpus) meet in the driver, which settles the two top levels. (3) Downwards in the same
groups: the cost of each run. (4) Texts are scored by looking each byte's run up; the table
of costs is broadcast while it has at most ``broadcast_rows`` rows, beyond that it is joined with
each text's runs.

Defined cases: texts begin after DEPTH zero bytes; a null text has null scores, the empty text
0 bytes, 0 bits and null bits per byte; rows that repeat count as often as they stand and score
alike; runs that the corpus lacks (where it isn't the scored table) count zero times and cost
what the tree gives to the unseen; an empty corpus gives 8 bits per byte; a text of any length is
scored whole; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import keep, materialise, scratch, small_batches
from folioscan.llm.textvec import give_back, slices

DEPTH, GROUP_ROWS, BROADCAST_ROWS = 4, 150_000, 2_000_000
_U = np.uint64


def _runs(raws: list[bytes], depth: int) -> np.ndarray:
    """Big-endian runs of depth + 1 bytes that end at each byte of the texts, one after the other."""
    pad = bytes(depth)
    a = np.frombuffer(b"".join(x for r in raws for x in (pad, r)), dtype=np.uint8)
    if len(a) <= depth:
        return np.empty(0, dtype=_U)
    key = np.zeros(len(a) - depth, dtype=_U)
    for i in range(depth + 1):
        key <<= _U(8)
        key |= a[i : len(a) - depth + i].astype(_U)
    size = np.array([len(r) for r in raws])
    keep = np.ones(len(key), dtype=bool)
    for end in np.cumsum(size + depth)[:-1]:
        keep[end - depth : end] = False  # runs that end in the next text's padding
    return key[keep]


def _raw(part: pa.Array) -> Iterator[list[bytes]]:
    """The texts' bytes, a slice of the batch at a time; nothing for null."""
    for texts in slices(part):
        yield [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def _fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n, first)


def _counter(depth: int, weight: int, hold: int = 2_000_000):
    """Counts of runs, summed over a task; once more than ``hold`` different runs are held, they are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        loose = 0

        def out():
            k, n = _fold(keys, counts)
            for i in range(0, len(k), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 500_000].view(np.int64)), pa.array(n[i : i + 500_000])], names=["run", "n"])

        for batch in batches:
            for raws in _raw(batch.column(0)):
                k, n = np.unique(_runs(raws, depth), return_counts=True)
                if not len(k):
                    continue
                keys.append(k)
                counts.append(n.astype(np.int64) * weight)
                loose += len(k)
                if loose > hold:
                    k, n = _fold(keys, counts)
                    keys[:], counts[:], loose = [k], [n], 0
                    if len(k) > hold:
                        yield from out()
                        keys.clear()
                        counts.clear()
        if keys:
            yield from out()

    return run


def run_counts(docs: DataFrame, depth: int = DEPTH, weight: int = 1) -> DataFrame:
    """(run, n): how often each run of depth + 1 bytes stands in the texts, times ``weight``."""
    texts = small_batches(docs).filter(F.col("text").isNotNull()).select("text")
    return texts.mapInArrow(_counter(depth, weight), "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


_LG = np.array([lgamma(i + 0.5) for i in range(4096)])
_LG1 = np.array([0.0] + [lgamma(i) for i in range(1, 4097)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of large x by Stirling's series (x > 4000: exact to a double's last places)."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Log block probability of a zeros and c ones under Krichevsky-Trofimov."""

    def half(n):
        return np.where(n < 4096, _LG[np.minimum(n, 4095)], _lgamma(np.maximum(n, 4000) + 0.5))

    s = a + c + 1
    return half(a) + half(c) - 2 * _LG[0] - np.where(s <= 4096, _LG1[np.minimum(s, 4096)], _lgamma(np.maximum(s, 4000).astype(float)))


class Nodes:
    """The nodes of one depth and one decision: keys (context, earlier bits), sorted; counts; log Pe; log Pw."""

    def __init__(self, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, j: int):
        node = ctx << _U(8) | (_U(1 << j) | sym >> _U(8 - j))
        bit = (sym >> _U(7 - j)) & _U(1)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        self.key = node[first]
        self.row = np.cumsum(np.concatenate(([0], (node[1:] != node[:-1]).astype(np.int64))))
        total, one = np.add.reduceat(n, first), np.add.reduceat(n * bit.astype(np.int64), first)
        self.zeros, self.ones = total - one, one
        self.pe = log_kt(self.zeros, self.ones)
        self.pw = self.pe
        self.stop = np.ones(len(first))

    def settle(self, children: np.ndarray) -> None:
        """Weigh the end of the tree here against the children's log Pw."""
        self.pw = np.log(0.5) + np.logaddexp(self.pe, children)
        self.stop = np.exp(np.log(0.5) + self.pe - self.pw)


def _tree(run: np.ndarray, n: np.ndarray, depth: int, top: int):
    """Nodes by depth (top..depth) and decision, and the tables of rows they stand on; rows of one group.

    The context is turned round, last byte first, so that a node's descendants follow it.
    """
    sym = run & _U(255)
    rev = np.zeros(len(run), dtype=_U)
    for i in range(depth):
        rev = rev << _U(8) | (run >> _U(8 * (i + 1))) & _U(255)
    order = np.lexsort((sym, rev))
    rev, sym, n = rev[order], sym[order], n[order]
    tables, nodes = {}, {}
    ctx = rev
    back = np.arange(len(run))
    for d in range(depth, top - 1, -1):
        if d < depth:
            full = (ctx >> _U(8)) << _U(8) | sym
            key, inverse = np.unique(full, return_inverse=True)
            n = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)
            ctx, sym, back = key >> _U(8), key & _U(255), inverse[back]
        tables[d] = back  # for each run, the row of this depth's table
        nodes[d] = [Nodes(ctx, sym, n, j) for j in range(8)]
        if d < depth:
            for j in range(8):
                below, here = nodes[d + 1][j], nodes[d][j]
                parent = (below.key >> _U(16)) << _U(8) | below.key & _U(255)
                here.settle(np.bincount(np.searchsorted(here.key, parent), weights=below.pw, minlength=len(here.key)))
    return order, tables, nodes


def _upward(depth: int):
    def run(t: pa.Table) -> pa.Table:
        _, _, nodes = _tree(t["run"].to_numpy().view(_U), t["n"].to_numpy(), depth, 2)
        key = np.concatenate([x.key for x in nodes[2]])
        cols = [np.concatenate([getattr(x, k) for x in nodes[2]]) for k in ("zeros", "ones", "pw")]
        parent = (key >> _U(16)) << _U(8) | key & _U(255)
        one, inverse = np.unique(parent, return_inverse=True)
        sums = [np.bincount(inverse, weights=c, minlength=len(one)) for c in cols]
        return pa.table({"node": one.astype(np.int64), "zeros": sums[0].astype(np.int64), "ones": sums[1].astype(np.int64), "pw": sums[2]})

    return run


def _crown(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two top levels: for each last byte and decision the mixture so far for 0 and 1, and the weight left for deeper nodes."""
    zeros, ones, pw = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        zeros[r["node"] >> 8, r["node"] & 255], ones[r["node"] >> 8, r["node"] & 255], pw[r["node"] >> 8, r["node"] & 255] = r["zeros"], r["ones"], r["pw"]
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    pe = log_kt(zeros, ones)
    w1 = np.log(0.5) + np.logaddexp(pe, pw)
    s1 = np.exp(np.log(0.5) + pe - w1)
    z0, o0 = zeros.sum(0), ones.sum(0)
    p0 = log_kt(z0, o0)
    s0 = np.exp(np.log(0.5) + p0 - (np.log(0.5) + np.logaddexp(p0, w1.sum(0))))
    kt = lambda a, t: (a + 0.5) / (t + 1)
    mix = [s0 * kt(x0, z0 + o0) + (1 - s0) * s1 * kt(x1, zeros + ones) for x0, x1 in ((z0, zeros), (o0, ones))]
    return mix[0], mix[1], (1 - s0) * (1 - s1)


def _downward(depth: int, crown: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(t: pa.Table) -> pa.Table:
        key = t["run"].to_numpy().view(_U)
        order, tables, nodes = _tree(key, t["n"].to_numpy(), depth, 2)
        sym = (key[order] & _U(255)).astype(np.int64)
        last = ((key[order] >> _U(8)) & _U(255)).astype(np.int64)
        bits = np.zeros(len(key))
        for j in range(8):
            before, bit = (1 << j) | sym >> (8 - j), (sym >> (7 - j)) & 1
            p = np.where(bit == 1, crown[1][last, before], crown[0][last, before])
            left = crown[2][last, before]
            for d in range(2, depth + 1):
                x = nodes[d][j]
                kt = (np.stack([x.zeros, x.ones]) + 0.5) / (x.zeros + x.ones + 1)
                at = x.row[tables[d]]
                p = p + left * x.stop[at] * kt[bit, at]
                left = left * (1 - x.stop[at])
            bits -= np.log2(p)
        return pa.table({"run": key[order].view(np.int64), "times": t["n"].to_numpy()[order], "bits": bits})

    return run


def run_costs(counts: DataFrame, depth: int = DEPTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(run, times, bits): how often each run stands in the corpus, and what its last byte costs after the bytes before it."""
    rows = counts.count()
    groups = rows // group_rows + 1
    # the last two bytes of the context
    grouped = counts.withColumn("g", F.pmod(F.xxhash64(F.shiftright("run", 8).bitwiseAND(F.lit(65535))), F.lit(groups)))
    up = grouped.groupBy("g").applyInArrow(_upward(depth), "node bigint, zeros bigint, ones bigint, pw double")
    crown = _crown(up.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("pw")).collect())
    return materialise(grouped.groupBy("g").applyInArrow(_downward(depth, crown), "run bigint, times bigint, bits double"), "ctw-costs")


class Table:
    """Runs and their costs in open addressing, looked up a whole array at a time."""

    def __init__(self, run: np.ndarray, bits: np.ndarray):
        size = 1 << max(4, int(2 * len(run)).bit_length())
        self.shift = _U(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.key = np.full(size, np.iinfo(np.uint64).max, dtype=_U)
        self.bits = np.zeros(size, dtype=np.float64)
        run, left = run.astype(_U), np.arange(len(run))
        at = self._slot(run)
        while len(left):
            free = self.key[at[left]] == np.iinfo(np.uint64).max
            won = left[free]
            self.key[at[won]] = run[won]
            ours = self.key[at[left]] == run[left]
            self.bits[at[left[ours]]] = bits[left[ours]]
            left = left[~ours]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, run: np.ndarray) -> np.ndarray:
        return ((run * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, and where the table has none."""
        at = self._slot(run)
        left = np.flatnonzero(self.key[at] != run)
        gone = []
        while len(left):
            none = self.key[at[left]] == np.iinfo(np.uint64).max
            gone.append(left[none])
            left = left[~none]
            at[left] = (at[left] + 1) & self.mask
            left = left[self.key[at[left]] != run[left]]
        lost = np.concatenate(gone) if gone else left
        bits = self.bits[at]
        bits[lost] = 0.0
        return bits, np.sort(lost)


_TABLES: dict[int, Table] = {}


def _lookup(shared, depth: int):
    kind = pa.list_(pa.struct([("run", pa.int64()), ("n", pa.int64())]))

    @F.arrow_udf("struct<n:bigint,bits:double,rare:array<struct<run:bigint,n:bigint>>>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if shared.id not in _TABLES:
            _TABLES.clear()
            run, bits = shared.value
            _TABLES[shared.id] = Table(run, bits)
        table = _TABLES[shared.id]
        for part in parts:
            sizes, sums, rare, counts, ends = [], [], [], [], [0]
            for raws in _raw(part):
                size = np.array([len(r) for r in raws])
                runs = _runs(raws, depth)
                cost, lost = table.get(runs)
                total = np.zeros(len(raws))
                full = np.flatnonzero(size)
                if len(full):
                    total[full] = np.add.reduceat(cost, (np.cumsum(size) - size)[full])
                sizes.append(size)
                sums.append(total)
                cuts = np.searchsorted(lost, np.cumsum(size))
                for a, b in zip([0, *cuts[:-1]], cuts):
                    if b > a:
                        k, n = np.unique(runs[lost[a:b]], return_counts=True)
                        rare.append(k)
                        counts.append(n)
                    ends.append(ends[-1] + (len(rare[-1]) if b > a else 0))
            cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
            items = pa.StructArray.from_arrays([pa.array(cat(rare, _U).view(np.int64)), pa.array(cat(counts, np.int64))], names=["run", "n"])
            none = part.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), items).cast(kind)
            yield pa.StructArray.from_arrays([pa.array(cat(sizes, np.int64).astype(np.int64), mask=none), pa.array(cat(sums, np.float64), mask=none), lists], names=["n", "bits", "rare"])
            give_back()

    return score


class _Shared:
    """A broadcast value with an id that is the same in every worker."""

    def __init__(self, spark, value):
        import uuid

        self.id, self._b = uuid.uuid4().int, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


def _common(costs: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(the commonest runs, ``most`` of them at most; the others, None where there are none)."""
    if costs.count() <= most:
        return costs, None
    # how many runs occur as often: as many rows as there are different numbers
    levels = costs.groupBy("times").count().orderBy(F.desc("times"))
    room, least = most, None
    for r in levels.toLocalIterator():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["times"]
    if least is None:
        return costs.limit(0), costs
    return costs.filter(F.col("times") >= least), costs.filter(F.col("times") < least)


def ctw_scores(docs: DataFrame, corpus: DataFrame | None = None, depth: int = DEPTH, group_rows: int = GROUP_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row, under the tree of ``corpus`` (``docs`` itself where none is given); depth 2 to 6."""
    spark = docs.sparkSession
    with scratch(spark):
        counts = run_counts(docs if corpus is None else corpus, depth)
        if corpus is not None:
            counts = counts.union(run_counts(docs, depth, 0)).groupBy("run").agg(F.sum("n").alias("n"))
        counts = materialise(counts, "ctw-counts")
        costs = run_costs(counts, depth, group_rows)
        common, rare = _common(costs, broadcast_rows)
        table = common.select("run", "bits").toArrow()
        shared = _Shared(spark, (table["run"].to_numpy().view(_U), table["bits"].to_numpy()))
        s = small_batches(docs).select("doc_id", _lookup(shared, depth)("text").alias("s"))
        out = s.select("doc_id", F.col("s.n").alias("n_bytes"), F.col("s.bits").alias("bits"), F.col("s.rare").alias("rare"))
        if rare is not None:
            rows = keep(materialise(out.select(F.monotonically_increasing_id().alias("row"), "*"), "ctw-rows"))
            runs = rows.select("row", F.explode("rare").alias("x")).select("row", "x.run", "x.n")
            summed = materialise(runs.join(rare.select("run", F.col("bits").alias("each")), "run").groupBy("row").agg(F.sum(F.col("n") * F.col("each")).alias("more")), "ctw-rare")
            out = rows.join(keep(summed), "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    bits = F.round("bits", 9)
    return out.select("doc_id", "n_bytes", bits.alias("bits"), F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))
