"""Context-tree weighting against the recursion written out over one tree for each decision."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscan.llm import ctw


def brute(corpus, texts, depth):
    """bits of each text, from a plain tree of dictionaries."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        raw = bytes(depth) + text.encode()
        for i in range(depth, len(raw)):
            for j in range(8):
                yield raw[i - depth : i], (1 << j) | raw[i] >> (8 - j), raw[i] >> (7 - j) & 1

    for text in corpus:
        for context, before, bit in decisions(text):
            for d in range(depth + 1):
                counts[before, context[depth - d :]][bit] += 1

    def log_pe(c):
        a, b = c
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    children = defaultdict(list)
    for before, context in counts:
        if context:
            children[before, context[1:]].append((before, context))
    weighted = {}
    for node in sorted(counts, key=lambda n: -len(n[1])):
        pe = log_pe(counts[node])
        if len(node[1]) == depth:
            weighted[node] = pe
        else:
            below = sum(weighted[c] for c in children[node])
            top = max(pe, below)
            weighted[node] = math.log(0.5) + top + math.log(math.exp(pe - top) + math.exp(below - top))
    out = []
    for text in texts:
        bits = 0.0
        for context, before, bit in decisions(text):
            p, left = 0.0, 1.0
            for d in range(depth + 1):
                node = (before, context[depth - d :])
                c = counts[node] if node in counts else [0, 0]
                kt = (c[bit] + 0.5) / (sum(c) + 1)
                stop = 1.0 if d == depth else (math.exp(math.log(0.5) + log_pe(c) - weighted[node]) if node in weighted else 0.5)
                p += left * stop * kt
                left *= 1 - stop
            bits -= math.log2(p)
        out.append(bits)
    return out


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a", "", "zzzz", "ünïcödé the", "the cat sat on the mat"]


def scores(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_against_the_recursion(docs, depth):
    got = scores(ctw.ctw_scores(docs(TEXTS), depth=depth, group_rows=7))
    for i, bits in enumerate(brute(TEXTS, TEXTS, depth)):
        assert got[i]["bits"] == pytest.approx(bits, rel=1e-9, abs=1e-9)
        assert got[i]["n_bytes"] == len(TEXTS[i].encode())


def test_another_corpus_and_unseen_runs(docs):
    corpus = ["abcabcabc", "abd"]
    got = scores(ctw.ctw_scores(docs(["abc", "xyz", "abcx"]), docs(corpus), depth=3))
    for i, bits in enumerate(brute(corpus, ["abc", "xyz", "abcx"], 3)):
        assert got[i]["bits"] == pytest.approx(bits, rel=1e-9)
    assert got[0]["bits_per_byte"] < got[1]["bits_per_byte"]


def test_joined_way_gives_the_same(docs):
    texts = [*TEXTS, None]
    one, other = scores(ctw.ctw_scores(docs(texts))), scores(ctw.ctw_scores(docs(texts), broadcast_rows=0))
    assert one.keys() == other.keys()
    for i in one:
        assert one[i]["n_bytes"] == other[i]["n_bytes"]
        assert one[i]["bits"] == pytest.approx(other[i]["bits"])


def test_defined_cases(docs, clashing):
    got = scores(ctw.ctw_scores(clashing(docs([None, "", "same", "same", "long text " * 100_000]))))
    assert (got[0]["n_bytes"], got[0]["bits"], got[0]["bits_per_byte"]) == (None, None, None)
    assert (got[1]["n_bytes"], got[1]["bits"], got[1]["bits_per_byte"]) == (0, 0.0, None)
    assert got[2]["bits"] == got[3]["bits"]
    assert got[4]["n_bytes"] == 1_000_000 and got[4]["bits_per_byte"] < 0.1
    assert ctw.ctw_scores(docs([])).count() == 0


def test_empty_corpus_costs_eight_bits(docs):
    got = scores(ctw.ctw_scores(docs(["abc", None]), docs([])))
    assert got[0]["bits_per_byte"] == pytest.approx(8.0) and got[1]["bits"] is None


def test_counts_do_not_depend_on_tasks(docs):
    r = random.Random(5)
    texts = ["".join(r.choices("abcdef ", k=r.randint(0, 200))) for _ in range(50)]
    one = ctw.run_counts(docs(texts).coalesce(1)).orderBy("run").collect()
    assert one == ctw.run_counts(docs(texts).repartition(9)).orderBy("run").collect()
    assert sum(x["n"] for x in one) == sum(map(len, texts))


def test_what_is_gathered_follows_the_corpus(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    half = ctw.run_counts(d.filter(F.col("doc_id") % 2 == 0)).agg(F.sum("n"), F.count("run")).first()
    full = ctw.run_counts(d).agg(F.sum("n"), F.count("run")).first()
    assert full[0] > 1.2 * half[0] and full[1] > half[1]
    assert full[0] == d.agg(F.sum(F.octet_length("text"))).first()[0]


def test_some_runs_common_and_some_rare_give_the_same(docs):
    texts = [*TEXTS, None, "the cat", "q" * 50 + "rare"]
    one = scores(ctw.ctw_scores(docs(texts)))
    for most in (1, 7, 30, 60):
        other = scores(ctw.ctw_scores(docs(texts), broadcast_rows=most))
        assert {i: r["bits"] for i, r in other.items()} == pytest.approx({i: r["bits"] for i, r in one.items()}, abs=1e-8)


def test_the_commonest_are_taken(spark):
    costs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([9, 5, 5, 2, 2, 2, 1])], "run bigint, times bigint, bits double")
    for most, want in ((0, 0), (1, 1), (2, 1), (3, 3), (5, 3), (6, 6), (7, 7)):
        common, rare = ctw._common(costs, most)
        assert common.count() == want and (0 if rare is None else rare.count()) == 7 - want
