"""Language identification by rank-order profiles.

A text's letter n-grams (of 1 to 3 characters of the lower-cased words, each word with a space
before and after it) are ordered by frequency; the ``TOP`` most frequent are its profile. The
distance to a language's profile sums, over the text's profile, how far each n-gram is out of
its place there, and ``TOP`` where the language's profile lacks it. The least distance wins.

Language profiles come from at most ``PER_LANGUAGE`` labelled documents of each language, those
with the least hash of their id; identification reads every text whole.

Defined cases: equal frequencies are ordered by the n-gram itself, equal distances by the name
of the language; a null text and one without letters have a null language and distance; labels
that are null teach nothing; without any labelled text all languages are null; rows that repeat
are treated alike; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches
from folioscan.llm.textvec import slices

TOP, PER_LANGUAGE, LONGEST, BROADCAST_ROWS = 300, 900, 3, 500_000
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def grams(text: str | None) -> np.ndarray:
    """All n-grams, 21 bits a character from the left, so that their order is that of the strings."""
    if not text:
        return np.empty(0, dtype=np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    m = _letters()[a]
    if not m.any():
        return np.empty(0, dtype=np.int64)
    end = np.concatenate(([False], m[:-1])) & ~m  # the first sign after a word stands for the space
    x = np.where(m, a, 32)[m | end].astype(np.int64)
    x = np.concatenate(([32], x, [32] if m[-1] else [])).astype(np.int64)
    space = x == 32
    one = x[~space] << 42
    two = (x[:-1] << 42 | x[1:] << 21)[~(space[:-1] & space[1:])]
    three = (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[~space[1:-1]]
    return np.concatenate([one, two, three])


def profile(text: str | None, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order."""
    g = grams(text)
    if not len(g):
        return g
    key, n = np.unique(g, return_counts=True)
    return key[np.argsort(-n, kind="stable")[:top]]


def _counter():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, []).append(grams(text))
        for lang, parts in held.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), type=pa.string()), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    return count


def profiles(docs: DataFrame, top: int = TOP, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """The profile of each language of ``docs.lang``. Only ids and labels are ranked, a task passing on at most ``per_language`` of each."""
    order = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = docs.filter("lang is not null and doc_id is not null and text is not null").select("lang", "doc_id").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)
    chosen = chosen.select(F.col("lang").alias("__fs_lang"), F.col("doc_id").alias("__fs_id")).distinct()
    few = chosen.count() <= BROADCAST_ROWS  # with more, by sort-merge
    texts = docs.filter("text is not null").join(F.broadcast(chosen) if few else chosen.hint("merge"), (F.col("doc_id") == F.col("__fs_id")) & (F.col("lang") == F.col("__fs_lang")), "left_semi")
    n = texts.select("lang", "text").mapInArrow(_counter(), "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    best = n.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "g"))).filter(F.col("k") <= top).orderBy("lang", "k")
    out: dict[str, list[int]] = {}
    for r in best.select("lang", "g").collect():  # top rows of each language
        out.setdefault(r["lang"], []).append(r["g"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _identifier(known: dict[str, np.ndarray], top: int):
    names = sorted(known)
    keys = np.unique(np.concatenate([known[n] for n in names])) if names else np.empty(0, dtype=np.int64)
    place = np.full((len(keys) + 1, len(names)), -1, dtype=np.int64)  # the last row: in no profile
    for i, n in enumerate(names):
        place[np.searchsorted(keys, known[n]), i] = np.arange(len(known[n]))

    @F.arrow_udf("struct<language:string,distance:bigint>")
    def identify(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            lang, far = [], []
            for t in (t for texts in slices(part) for t in texts):
                p = profile(t, top)
                if not len(p) or not names:
                    lang.append(None)
                    far.append(None)
                    continue
                at = np.searchsorted(keys, p)
                at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != p)] = len(keys)
                there = place[at]
                d = np.where(there < 0, top, np.abs(there - np.arange(len(p))[:, None])).sum(0)
                lang.append(names[int(d.argmin())])
                far.append(int(d.min()))
            yield pa.StructArray.from_arrays([pa.array(lang, type=pa.string()), pa.array(far, type=pa.int64())], names=["language", "distance"])

    return identify


def identify(docs: DataFrame, training: DataFrame | None = None, top: int = TOP, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, language, distance) of every row; ``training`` (doc_id, text, lang) is ``docs`` itself where none is given."""
    known = profiles(docs if training is None else training, top, per_language)
    return small_batches(docs).select("doc_id", _identifier(known, top)("text").alias("r")).select("doc_id", "r.language", "r.distance")
