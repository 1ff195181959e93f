"""Quality classifier: held-out accuracy, parts of the fit against direct computation, and the defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import quality, queries

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    model = quality.fit(docs, labels.filter(~held))
    rows = docs.join(labels.filter(held), "doc_id").select(quality.scorer(model)("text").alias("p"), "quality").collect()
    p, y = np.array([r["p"] for r in rows]), np.array([r["quality"] for r in rows])
    right = ((p >= quality.ACCEPT) == (y == 1))
    assert len(y) > 80
    assert (right[y == 1].mean() + right[y == 0].mean()) / 2 > 0.8
    assert right[y == 1].mean() > 0.9  # clean documents stay


def test_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(0)
    w, b = r.normal(0, np.sqrt(2 * quality.GAMMA), (4, 6000)), r.uniform(0, 2 * np.pi, 6000)
    x = r.normal(size=(20, 4))
    z = quality.fourier(x, w, b)[:, :-1]
    exact = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_isotonic_pools_violators():
    knots, values = quality.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 0, 1]), np.ones(5))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert np.interp([1, 2, 3, 4], knots, values) == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_normal_equations_do_not_depend_on_the_partitioning(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one, other = quality.fit(docs.coalesce(1), labels), quality.fit(docs.repartition(7), labels)
    assert one.beta == pytest.approx(other.beta, rel=1e-6, abs=1e-8)


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)


GOOD = "The river runs through the quiet valley, and people of the town walk along its banks in the evening."
BAD = "buy now buy now buy now !!!! $$$$ 1234 1234 1234"


def corpus(docs, labels):
    texts = [f"{GOOD} Number {i} is told again." for i in range(30)] + [f"{BAD} {i}" for i in range(30)]
    return docs(texts), labels([(i, int(i < 30), 0) for i in range(60)])


def test_defined_cases(docs, labels):
    d, y = corpus(docs, labels)
    odd = docs([None, "", "  \n ", GOOD, GOOD, "word " * 300_000], [100, 101, 102, 103, 103, 104])
    rows = quality.quality_scores(d.union(odd), y.union(labels([(None, 1, 0), (3, None, 0), (999, 1, 1)]))).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 66
    for i in (100, 101, 102):
        assert by[i]["probability"] == 0 and not by[i]["accepted"]
    assert by[103]["accepted"] and by[0]["accepted"] and not by[40]["accepted"]
    assert len({r["probability"] for r in rows if r["doc_id"] == 103}) == 1


def test_without_both_kinds_all_with_words_pass(docs, labels):
    d = docs([GOOD, BAD, "", None])
    for y in (labels([]), labels([(0, 1, 0)])):
        assert sorted(r["doc_id"] for r in quality.quality_filter(d, y).collect()) == [0, 1]


def test_the_worst_of_several_labels_counts(docs, labels):
    d, y = corpus(docs, labels)
    twice = quality.labelled(d, y.union(labels([(0, 0, 0), (1, 1, 0)]))).filter("doc_id < 2").collect()
    assert {(r["doc_id"], r["y"]) for r in twice} == {(0, 0.0), (1, 1.0)} and len(twice) == 2


def test_bound_on_labelled_rows(docs, labels):
    d, y = corpus(docs, labels)
    assert quality.labelled(d, y, max_rows=10).count() == 10


def test_empty_table(docs, labels):
    assert quality.quality_scores(docs([]), labels([(1, 1, 0)])).count() == 0


def test_further_columns_stay(docs, labels, clashing):
    d, y = corpus(docs, labels)
    d = clashing(d)
    kept = quality.quality_filter(d, y.withColumn("text", F.lit("t")))
    assert kept.columns == d.columns and 25 <= kept.count() <= 35


def test_query_gives_every_document(spark, sf):
    got = queries.op3_quality(spark, sf)
    assert got.columns == ["doc_id", "probability", "accepted"]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert {r["accepted"] for r in rows} >= {True, False}


def brute_statistics(text):
    """The sixteen statistics, one by one from their description."""
    words = text.split()
    if not words:
        return [0.0] * 16
    raw, n = text.encode(), len(text.split())
    share = lambda test: sum(map(test, raw)) / len(raw)
    lower, upper = share(lambda c: 97 <= c <= 122), share(lambda c: 65 <= c <= 90)
    digits, space = share(lambda c: 48 <= c <= 57), share(lambda c: c in b" \t\n\r\f\v")
    points, high = share(lambda c: c in b".,;:'\"-()"), share(lambda c: c >= 0x80)
    kinds = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log(1 + len(text)), np.log(1 + n), len(text) / n, np.log(1 + max(len(w) for w in words)), len(kinds) / n, np.log(1 + len(kinds)) / np.log(1 + n),
        sum(a == b for a, b in zip(words, words[1:])) / n, max(words.count(w) for w in kinds) / n, upper / (lower + upper + 1e-9), digits, space, points, 1 - lower - upper - digits - space - points - high, high,
        1 - len(set(lines)) / len(lines), np.log(1 + n / len(lines)),
    ]


def brute_isotonic(score, y, weight):
    """The monotone fit by its min-max formula, at the distinct scores."""
    at = np.unique(score)
    w = np.array([weight[score == s].sum() for s in at])
    m = np.array([(weight * y)[score == s].sum() for s in at]) / w
    mean = lambda i, j: (w[i : j + 1] * m[i : j + 1]).sum() / w[i : j + 1].sum()
    return at, np.array([max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])


def test_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {}
    for r in labels.collect():
        if r["quality"] is not None and docs.get(r["doc_id"]) is not None:
            y[r["doc_id"]] = min(r["quality"], y.get(r["doc_id"], 1))
    parts = spark.createDataFrame([(i,) for i in y], "doc_id bigint").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(5)) == 0).alias("held")).collect()
    held = {r["doc_id"]: r["held"] for r in parts}
    x = {i: np.array(brute_statistics(t)) if t else np.zeros(16) for i, t in docs.items()}
    train, test = [i for i in y if not held[i]], [i for i in y if held[i]]
    m, s = np.mean([x[i] for i in train], 0), np.std([x[i] for i in train], 0)
    s[s < 1e-9] = 1.0
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, np.sqrt(2 * quality.GAMMA), (16, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = {i: np.append(np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((v - m) / s, -quality.CLIP, quality.CLIP) @ w + b), 1.0) for i, v in x.items()}
    n = len(train)
    weight = {k: n / (2 * sum(y[i] == k for i in train)) for k in (0, 1)}
    a, c = np.zeros((quality.FEATURES + 1,) * 2), np.zeros(quality.FEATURES + 1)
    for i in train:
        a += weight[y[i]] * np.outer(z[i], z[i])
        c += weight[y[i]] * y[i] * z[i]
    ridge = np.diag([quality.RIDGE * n] * quality.FEATURES + [1e-9])
    beta = np.linalg.solve(a + ridge, c)
    at, value = brute_isotonic(np.array([z[i] @ beta for i in test]), np.array([float(y[i]) for i in test]), np.array([weight[y[i]] for i in test]))
    for r in queries.op3_quality(spark, sf).collect():
        t = docs[r["doc_id"]]
        p = float(np.interp(z[r["doc_id"]] @ beta, at, value)) if t and t.split() else 0.0
        assert r["probability"] == pytest.approx(p, abs=1e-4)
        assert abs(p - quality.ACCEPT) < 1e-3 or r["accepted"] == (p >= quality.ACCEPT)
