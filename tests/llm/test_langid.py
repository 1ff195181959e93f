"""Rank-order profiles against plain dictionaries, and accuracy on labelled text."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscan.llm import langid


def brute_profile(text, top=langid.TOP):
    count = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        s = f" {w} "
        for n in (1, 2, 3):
            count.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " ")
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:top]]


def packed(g):
    out = 0
    for i in range(3):
        out = out << 21 | (ord(g[i]) if i < len(g) else 0)
    return out


TEXTS = ["The cat sat on the mat", "a", "", "123 !!", "Ägyptische Größe, ÉTÉ", "x" * 50, "one two  three\nfour", "a1b2c3"]


def test_profiles_against_dictionaries():
    for t in TEXTS:
        assert langid.profile(t).tolist() == [packed(g) for g in brute_profile(t)], t


def test_distances_against_dictionaries(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    known = {k: v.tolist() for k, v in langid.profiles(df).items()}
    got = {r["doc_id"]: (r["language"], r["distance"]) for r in langid.identify(df).collect()}
    for r in df.select("doc_id", "text").collect():
        own = [packed(g) for g in brute_profile(r["text"])]
        far = {}
        for name, p in known.items():
            place = {g: i for i, g in enumerate(p)}
            far[name] = sum(abs(i - place[g]) if g in place else langid.TOP for i, g in enumerate(own))
        best = min(far.items(), key=lambda x: (x[1], x[0])) if own else (None, None)
        assert got[r["doc_id"]] == best


def test_accuracy_on_rows_not_learned_from(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = langid.identify(df.filter(held), df.filter(~held)).join(df.select("doc_id", "lang", "text"), "doc_id")
    right = [r["language"] == r["lang"] for r in got.filter(F.length("text") > 40).collect()]
    assert len(right) > 200 and np.mean(right) > 0.95


def test_defined_cases(spark, docs, clashing):
    train = spark.createDataFrame([(1, "the house and the garden of the town", "en"), (2, "das Haus und der Garten der Stadt", "de"), (3, "no label here", None), (None, "no id", "fr"), (4, None, "de")], "doc_id bigint, text string, lang string")
    rows = langid.identify(clashing(docs([None, "", "12 34", "the garden", "the garden", "der Garten und das Haus", "the town " * 200_000])), train).collect()
    by = {r["doc_id"]: r["language"] for r in rows}
    assert by == {0: None, 1: None, 2: None, 3: "en", 4: "en", 5: "de", 6: "en"}
    assert {r["distance"] for r in rows if r["doc_id"] < 3} == {None}
    assert langid.identify(docs([]), train).count() == 0
    nothing = langid.identify(docs(["text"]), train.filter("lang is null")).collect()
    assert [(r["language"], r["distance"]) for r in nothing] == [(None, None)]


def test_equal_distances_go_to_the_first_name(spark, docs):
    train = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa")], "doc_id bigint, text string, lang string")
    assert langid.identify(docs(["same words"]), train).first()["language"] == "aa"


def test_bound_on_training_rows(spark):
    train = spark.createDataFrame([(i, f"text {'abcdefgh'[i % 8]}", "en") for i in range(40)], "doc_id bigint, text string, lang string")
    few, all_ = langid.profiles(train, per_language=1), langid.profiles(train)
    assert len(few["en"]) < len(all_["en"])
