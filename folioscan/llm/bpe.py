"""Byte-level BPE by speculation: longest matches are proposed, verified in bulk, mended where wrong.

A text is cut into pieces by the vocabulary's pattern. For each new piece the longest token
that fits is taken from the left; such a sequence is the BPE encoding exactly if each adjacent
pair of tokens is one that BPE leaves apart, which is tested for all distinct pairs at once by
undoing merges on both sides of the boundary in step. Only pieces with a failing pair are
merged pair by pair, all of a batch in step; long ones each by itself. Pieces recur, so a worker keeps those it has seen in two halves of ``MEMORY`` bytes together:
when the younger is full it becomes the older, and what is met again moves to the new one. Pieces of more than ``KEPT`` signs are never kept. A long text is cut into pieces
part by part, at white space after another sign, where pieces end whatever stands around.

Decoding concatenates the tokens' bytes.

The vocabulary is a file of base64 token and rank a line, read by every worker from ``path``,
or, where the workers lack that file, from the copy that ``spark.sparkContext.addFile`` sent.

Defined cases: a null text has null tokens and a null count; the empty text has none; rows
that repeat are encoded alike; strings that look like special tokens are ordinary text; ids
out of the vocabulary raise an error when decoded; further columns pass unchanged.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches
from folioscan.llm.textvec import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, letters, numbers and other signs, each with a space before it, and white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY, KEPT, PART = 16 << 20, 64, 1 << 17
_NONE = np.iinfo(np.int64).max
#: ``PATTERN`` for texts that are ASCII, which the plainer engine finds faster.
_SPACE = "".join(f"\\x{i:02x}" for i in range(128) if regex.match(r"\s", chr(i)))
_ASCII = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+").replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s+", f"[{_SPACE}]+"))
_CUT = regex.compile(r"(?<=\S)\s")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact BPE of one piece: the adjacent pair of least rank, the leftmost of equals, is merged until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) < 200:
        none = 1 << 60
        get = ranks.get
        at = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while at and (low := min(at)) != none:
            i = at.index(low)
            both = parts[i] = parts[i] + parts.pop(i + 1)
            del at[i]
            if i:
                at[i - 1] = get(parts[i - 1] + both, none)
            if i < len(at):
                at[i] = get(both + parts[i + 1], none)
        return [ranks[p] for p in parts]
    import heapq  # long pieces: the same order of merges from a heap over a linked list, in flat arrays
    from array import array

    n = len(parts)
    after, before, alive = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(b"\x01") * n
    heap = [r << 40 | i for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        rank, i = x >> 40, x & 0xFFFFFFFFFF
        if not alive[i] or (j := after[i]) >= n or ranks.get(both := parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j], alive[j], after[i] = both, b"", 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, r << 40 | a)
    return [ranks[p] for p, x in zip(parts, alive) if x]


class Codec:
    """Encoder and decoder of one vocabulary; ``counts`` tells how many pieces passed and failed verification."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes: list[bytes | None] = [None] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        keys, made = [], []
        self.offered: dict[bytes, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                lesser = self._halves(token, i)
                if lesser is None:
                    continue  # BPE never makes this token, so it isn't proposed
                self.left[i], self.right[i] = lesser
                keys.append(lesser[0] << 32 | lesser[1])
                made.append(i)
            self.offered[token] = i
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]
        self.reach: dict[bytes, int] = {}  # of the longest token that begins with these four bytes
        for token in self.offered:
            if len(token) > self.reach.get(token[:4], 3):
                self.reach[token[:4]] = len(token)
        # every two tokens that together are a token, however that one is made
        get, both = ranks.get, []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    both.append((a << 32 | b, i))
        pairs = np.array(both, dtype=np.int64).reshape(-1, 2)
        self.pairs, self.joint = (pairs[np.argsort(pairs[:, 0])].T.copy() if len(pairs) else (np.array([-1]), np.array([_NONE])))
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.counts = [0, 0]
        self.tokens: pa.Array | None = None

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> "Codec":
        if not os.path.exists(path):
            from pyspark import SparkFiles

            path = SparkFiles.get(os.path.basename(path))
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge, the last of all in this token's own encoding, makes it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = [r if (r := self.ranks.get(a + b, rank)) < rank else rank for a, b in zip(parts, parts[1:])]
            low = min(at)
            if low == rank:
                return None
            i = at.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def greedy(self, piece: bytes) -> list[int]:
        """The longest token at each place."""
        out, i, n, get, reach = [], 0, len(piece), self.offered.get, self.reach.get
        while i < n:
            j = min(n, i + reach(piece[i : i + 4], 3))
            while (t := get(piece[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, ``_NONE`` where it has none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joint[at], _NONE)

    def merged(self, raw: list[bytes]) -> list[bytes]:
        """``merge`` of each of these pieces, as the bytes of int32: in each step every piece that isn't done has its next pair merged."""
        short = [i for i, b in enumerate(raw) if 0 < len(b) <= KEPT] if self.single.min() >= 0 else []
        out = [b""] * len(raw)
        for i in set(range(len(raw))).difference(short):
            out[i] = np.array(merge(raw[i], self.ranks), dtype=np.int32).tobytes()
        if not short:
            return out
        lengths = np.array([len(raw[i]) for i in short])
        ids = self.single[np.frombuffer(b"".join([raw[i] for i in short]), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(short)), lengths)
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        ended = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            over = low == _NONE
            if over.any():
                ended.append((owner[over], ids[over]))
                ids, owner, rank, low = ids[~over], owner[~over], rank[~over], low[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low)
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]  # the leftmost of equals
            ids[at] = rank[at]
            left = np.ones(len(ids), dtype=bool)
            left[at + 1] = False
            ids, owner, rank = ids[left], owner[left], rank[left]
            at -= np.arange(len(at))
            rank[at] = _NONE
            changed = np.r_[at, at[at > 0] - 1]
            changed = changed[changed < len(ids) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self._rank(ids[changed], ids[changed + 1])
        owner = np.concatenate([o for o, _ in ended])
        order = np.argsort(owner, kind="stable")
        whole, at = np.concatenate([x for _, x in ended])[order].astype(np.int32).tobytes(), 0
        for i, end in zip(short, (4 * np.cumsum(np.bincount(owner))).tolist()):
            out[i], at = whole[at:end], end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE leaves the boundary between them.

        The merge made last on either side is undone, the later one first; the boundary
        breaks if the tokens then next to it would have merged before the one just undone.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        good = np.ones(len(a), dtype=bool)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), dtype=np.int64)
            joint = np.where(self.keys[at] == key, self.made[at], np.iinfo(np.int64).max) if len(self.keys) else np.full(len(key), np.iinfo(np.int64).max)
            bad = joint < limit[open_]
            good[open_[bad]] = False
            x, y, rest = x[~bad], y[~bad], open_[~bad]
            xs, ys = self.right[x], self.left[y]
            single_x, single_y = xs == x, ys == y
            undo_x = ~single_x & ((x > y) | single_y)
            undo_y = ~undo_x & ~single_y
            a[rest[undo_x]] = xs[undo_x]
            limit[rest[undo_x]] = x[undo_x]
            b[rest[undo_y]] = ys[undo_y]
            limit[rest[undo_y]] = y[undo_y] + 1
            open_ = rest[undo_x | undo_y]
        return good

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces together; ``known`` has the ids of each as the bytes of int32."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        guess = [self.greedy(b) for b in raw]
        size = np.array([len(g) for g in guess], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(guess), dtype=np.int64, count=int(size.sum()))
        inner = np.ones(max(len(flat) - 1, 0), dtype=bool)
        ends = np.cumsum(size)[:-1]
        inner[ends[(ends > 0) & (ends <= len(inner))] - 1] = False
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        owner = np.repeat(np.arange(len(pieces)), size)[:-1][inner] if len(flat) else np.empty(0, dtype=np.int64)
        failed = np.unique(owner[~fine]).tolist()
        self.counts[0] += len(pieces) - len(failed)
        self.counts[1] += len(failed)
        whole, at = flat.astype(np.int32).tobytes(), 0
        for p, end in zip(pieces, (4 * np.cumsum(size)).tolist()):
            self.known[p], at = whole[at:end], end
        for i, ids in zip(failed, self.merged([raw[i] for i in failed])):
            self.known[pieces[i]] = ids

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that no piece of the usual pattern crosses; with another pattern it stays whole."""
        at = 0
        while self.pattern.pattern == PATTERN and len(text) - at > PART and (m := _CUT.search(text, at + PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _group(self, parts: list[str]) -> list[bytes]:
        """Ids of these parts, their new pieces learnt together; long pieces are known for as long as this takes."""
        usual = self.pattern.pattern == PATTERN
        cut = [(_ASCII if usual and p.isascii() else self.pattern).findall(p) for p in parts]
        if self.held > MEMORY // 2:
            self.older, self.known, self.held = self.known, {}, 0
        known, older = self.known, self.older
        fresh = list(set().union(*cut).difference(known))
        if new := [p for p in fresh if p not in older]:
            self.learn(new)
        known.update({p: older[p] for p in fresh if p in older})
        self.held += sum(map(len, fresh)) + sum(map(len, map(known.__getitem__, fresh))) + 200 * len(fresh)  # what Python needs beside
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > KEPT:
                self.held -= len(p) + len(known.pop(p)) + 200
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(group, self._group([p for _, p in group])):
                out[i].append(ids)
            group.clear()

        for i, t in enumerate(texts):
            for part in self._parts(t):
                group.append((i, part))
                size += len(part)
                if size >= PART:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(ids), dtype=np.int32) for ids in out]

    def decode(self, ids) -> bytes:
        """The bytes of token ids."""
        try:
            return b"".join([self.bytes[i] for i in ids])
        except (IndexError, TypeError) as e:
            raise KeyError(f"an id that the vocabulary lacks: {e}") from e


    def intact(self, texts: list[str | None], ids: list[np.ndarray]) -> list[bool | None]:
        """Whether the ids of each text decode to its bytes, null for a null text; the bytes of all are compared at once, and one by one if they differ."""
        if self.tokens is None:
            self.tokens = pa.array(self.bytes, type=pa.large_binary())
        got = self.tokens.take(pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.frombuffer(got.buffers()[1], dtype=np.int64)[: len(got) + 1]
        ends = offsets[np.cumsum([len(x) for x in ids], dtype=np.int64)] if ids else offsets[:0]
        if not got.null_count and np.array_equal(ends, np.cumsum([len(b) for b in raw], dtype=np.int64)) and memoryview(got.buffers()[2] or b"")[: int(offsets[-1])] == b"".join(raw):
            return [None if t is None else True for t in texts]
        return [None if t is None else self.decode(x.tolist()) == b for t, x, b in zip(texts, ids, raw)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    """This process's codec of a vocabulary file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec.load(path, pattern)
    return _CODECS[path, pattern]


def _lists(ids: list[np.ndarray], mask: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)), mask=mask)


def encoded(text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Column of array<int>: the token ids of a text column."""

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for part in parts:
            yield _lists([x for texts in slices(part) for x in c.encode([t or "" for t in texts])], part.is_null())

    return run(text)


def decoded(tokens: str, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Column of string: the text of a column of token ids; bytes that aren't UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for part in parts:
            yield pa.array([None if t is None else c.decode(t).decode("utf-8", "replace") for t in (part[i].as_py() for i in range(len(part)))], type=pa.string())

    return run(tokens)


def tokenize(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row."""
    return small_batches(docs).select("doc_id", encoded("text", path, pattern).alias("tokens")).select("doc_id", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), "tokens")


def detokenize(rows: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) of rows of ``tokenize``."""
    return rows.select("doc_id", decoded("tokens", path, pattern).alias("text"))


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, tokens, intact) of every row; intact: decoding gave the text's bytes again, null for a null text."""

    @F.arrow_udf("struct<tokens:array<int>,intact:boolean>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for part in parts:
            ids: list[np.ndarray] = []
            intact: list[bool | None] = []
            for texts in slices(part):
                got = c.encode([t or "" for t in texts])
                intact.extend(c.intact(texts, got))
                ids.extend(got)
            yield pa.StructArray.from_arrays([_lists(ids, part.is_null()), pa.array(intact, type=pa.bool_())], names=["tokens", "intact"])

    r = small_batches(docs).select("doc_id", run("text").alias("r"))
    return r.select("doc_id", F.when(F.col("r.tokens").isNotNull(), F.size("r.tokens")).alias("n_tokens"), F.col("r.tokens").alias("tokens"), F.col("r.intact").alias("intact"))
