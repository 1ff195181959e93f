"""Leaks against every window of every document and item."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscan.llm import decontam

W = decontam.WIDTH


def words_of(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode("utf-8", "surrogatepass"))


def brute(docs, items, threshold=decontam.THRESHOLD):
    """{(doc_id, item_id): (containment, start of the window's first hit)}"""
    found = {}
    for d, text in docs:
        for i, item in items:
            if text is None or item is None or not (own := words_of(item)):
                continue
            width = min(W, len(own))
            runs = [tuple(own[k : k + width]) for k in range(len(own) - width + 1)]
            want, span = set(runs), len(runs)
            w = words_of(text)
            here = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            need = max(1, math.ceil(threshold * len(want) - 1e-9))
            for s in range(len(here)):
                if here[s] in want:
                    n = len(set(here[s : s + span]) & want)
                    if n >= need and n / len(want) > found.get((d, i), (0,))[0]:
                        found[d, i] = (n / len(want), s)
    return found


def got(df):
    return {(r["doc_id"], r["item_id"]): (r["containment"], r["start_word"]) for r in df.collect()}


@pytest.fixture
def bench(spark):
    return lambda texts, ids=None: spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts)), "item_id bigint, text string")


def agrees(found, want):
    return found.keys() == want.keys() and all(abs(found[k][0] - want[k][0]) < 1e-6 for k in want)


def test_against_brute_force(docs, bench):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [" ".join(r.choices(vocabulary, k=r.randint(1, 30))) for _ in range(25)]
    texts = []
    for _ in range(120):
        t = r.choices(vocabulary, k=r.randint(0, 60))
        if r.random() < 0.6:
            piece = [w if r.random() > 0.1 else "zz" for w in r.choice(items).split()]
            at = r.randint(0, len(t))
            t[at:at] = piece
        texts.append(" ".join(t))
    want = brute(list(enumerate(texts)), list(enumerate(items)))
    assert len(want) > 40
    found = got(decontam.leaks(docs(texts), bench(items)))
    assert agrees(found, want)
    assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in want.items()}
    joined = decontam.leaks(docs(texts), bench(items), broadcast_shingles=0)
    assert got(joined) == found


def test_planted_passages(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r[0], r[1]) for r in d.select("doc_id", "text").collect()], [(r[0], r[1]) for r in b.select("item_id", "text").collect()])
    assert want and agrees(got(decontam.leaks(d, b)), want)


def test_filter_drops_leaks_alone(docs, bench):
    d = docs(["x a b c d e y", "a b", None, "", "something else here", "x a b c d e y"])
    left = decontam.decontaminate(d, bench(["a b c d e", None, "", "..."]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4]
    assert sorted(r["doc_id"] for r in decontam.decontaminate(d, bench(["a b c d e"]), broadcast_shingles=0).collect()) == [1, 2, 3, 4]


def test_short_items_and_repeats(docs, bench):
    d = docs(["one two", "two one", "one two", "only one"], [7, 8, 7, 9])
    assert got(decontam.leaks(d, bench(["one two", "one two", "ONE, two!"], [1, 1, 1]))) == {(7, 1): (1.0, 0)}
    assert decontam.leaks(d, bench(["one two"])).count() == 2  # a row for each of the repeated rows


def test_null_ids(docs, bench):
    rows = decontam.leaks(docs(["p q r s"], [None]), bench(["p q r s"], [None])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(None, None)]


def test_empty_tables(docs, bench):
    assert decontam.leaks(docs([]), bench(["a b c"])).count() == 0
    assert decontam.leaks(docs(["a b c"]), bench([])).count() == 0
    assert decontam.decontaminate(docs(["a b c"]), bench([])).count() == 1
    assert decontam.decontaminate(docs([]), bench([])).count() == 0


def test_long_text_and_ties(docs, bench):
    item = " ".join(f"k{i}" for i in range(20))
    text = "pad " * 300_000 + item + " pad" * 50 + " " + item
    assert got(decontam.leaks(docs([text]), bench([item]))) == {(0, 0): (1.0, 300_000)}  # of two best windows the first


def test_further_columns_stay(docs, bench, clashing):
    d = clashing(docs(["a b c d", "other words"]))
    b = bench(["a b c d"]).withColumn("doc_id", F.lit(1)).withColumn("digest", F.lit("x"))
    assert got(decontam.leaks(d, b)) == {(0, 0): (1.0, 0)}
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns and [r["doc_id"] for r in left.collect()] == [1]


def test_beyond_the_bound_a_bitmap_with_collisions_gives_the_same(docs, bench, monkeypatch):
    monkeypatch.setattr(decontam, "BITS", 1 << 15)
    build = decontam._bitmap
    monkeypatch.setattr(decontam, "_bitmap", lambda vocabulary, n: build(vocabulary, n, 1 << 15))
    r = random.Random(12)
    items = [" ".join(f"i{k}w{j}" for j in range(60)) for k in range(40)]
    texts = [" ".join(r.choices([f"t{j}" for j in range(3000)], k=400)) + (" " + r.choice(items) if k % 3 == 0 else "") for k in range(60)]
    one, other = got(decontam.leaks(docs(texts), bench(items))), got(decontam.leaks(docs(texts), bench(items), broadcast_shingles=0))
    assert one == other and len(one) == 20


def test_many_copies_of_a_leak_all_go(docs, bench):
    texts = ["pad a b c d e f"] * 300 + [f"own text number {i} here" for i in range(50)]
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs(texts), bench(["a b c d e f"])).collect()) == list(range(300, 350))
