"""Near duplicates against all pairs of exact shingle sets."""

import random
import re
from itertools import combinations

from folioscan.llm import neardup


def shingle_set(text, width=neardup.WIDTH):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode("utf-8", "surrogatepass"))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, threshold=neardup.THRESHOLD):
    """(pairs of distinct texts that reach the threshold, groups of ids)."""
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, set()).add(i)
    sets = {t: shingle_set(t) for t in texts}
    pairs, parent = set(), {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
            pairs.add(frozenset((min(texts[a]), min(texts[b]))))
            parent[root(a)] = root(b)
    groups = {}
    for t, ids in texts.items():
        groups.setdefault(root(t), set()).update(ids)
    return pairs, {frozenset(g) for g in groups.values() if len(g) > 1}


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["keep_id"], set()).add(r["doc_id"])
        assert r["n_docs"] > 1
    assert all(k == min(g) for k, g in out.items())
    return {frozenset(g) for g in out.values()}


def noisy(seed=3, n=60):
    """Texts, near copies of them at several distances, and a passage that many of them share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    shared = " ".join(r.choices(words, k=25))
    out = []
    for i in range(n):
        base = r.choices(words, k=r.randint(20, 200))
        out.append(" ".join(base) + (" " + shared if i % 2 else ""))
        for _ in range(i % 4):
            copy = [w if r.random() > 0.04 * (i % 5) else r.choice(words) for w in base]
            out.append(" ".join(copy))
    return out


def test_pairs_against_brute_force(docs):
    texts = noisy()
    want, _ = brute(list(enumerate(texts)))
    nodes, pairs = neardup.near_pairs(docs(texts))
    name = {r["node"]: r["id"] for r in nodes.collect()}
    got = {frozenset((name[r["a"]], name[r["b"]])) for r in pairs.collect()}
    assert got <= want  # verified exactly
    assert len(want) > 30 and len(got) >= 0.97 * len(want)


def test_short_and_long_texts_at_the_threshold_against_brute_force(docs):
    texts = []
    for i in range(100):
        base = [f"p{i}w{j}" for j in range(68)]
        texts += [" ".join(base[:35]), " ".join(base)]  # 33 and 66 shingles
    want, _ = brute(list(enumerate(texts)))
    nodes, pairs = neardup.near_pairs(docs(texts))
    name = {r["node"]: r["id"] for r in nodes.collect()}
    got = {frozenset((name[r["a"]], name[r["b"]])) for r in pairs.collect()}
    assert len(want) == 100 and got <= want and len(got) >= 0.97 * len(want)


def test_groups_against_brute_force_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    _, want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = groups(neardup.near_groups(df))
    assert len(want) > 5 and len(got & want) >= 0.9 * len(want)


def test_large_group_in_blocks(docs):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"own{k}"] + base[k + 1 :]) for k in range(60)]
    assert groups(neardup.near_groups(docs(texts), block=7)) == {frozenset(range(60))}


def test_equal_texts_and_words_only_in_order(docs):
    got = groups(neardup.near_groups(docs(["", "", "!!", "??", "a b", "a b", "one two three", "three two one"], [1, 2, 3, 4, 5, 6, 7, 8])))
    assert got == {frozenset((1, 2)), frozenset((5, 6))}


def test_one_of_each_group_stays(docs):
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "q r s t u v", None, None, "", "", "a b c d e f g h i j"]
    got = neardup.near_dedup(docs(texts, [4, 3, 2, 1, 1, 7, 6, 9]))
    assert sorted((r["doc_id"], r["text"]) for r in got.filter("text is not null").collect()) == [(2, "q r s t u v"), (3, "a b c d e f g h i k"), (6, "")]
    assert got.filter("text is null").count() == 2


def test_null_ids_and_repeated_rows(docs):
    got = neardup.near_dedup(docs(["a b c d", "a b c d", "a b c d", "x y z q"], [None, None, 5, None]))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("5", "a b c d"), ("None", "x y z q")]
    again = neardup.near_dedup(docs(["a b c d"] * 4, [5, 5, 5, 5]))
    assert again.count() == 1


def test_empty_table(docs):
    assert neardup.near_groups(docs([])).count() == 0
    assert neardup.near_dedup(docs([])).count() == 0
    assert neardup.near_dedup(docs([None])).count() == 1


def test_very_long_texts(docs):
    r = random.Random(1)
    words = [str(r.randint(0, 10**6)) for _ in range(200_000)]
    assert groups(neardup.near_groups(docs([" ".join(words), " ".join(words[:-50]), " ".join(words[:1000])]))) == {frozenset((0, 1))}


def test_further_columns_stay(docs, clashing):
    df = clashing(docs(["a b c d", "a b c d", "e f g h"]))
    got = neardup.near_dedup(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_short_texts_at_many_sizes_against_brute_force(docs):
    r = random.Random(21)
    texts = []
    for i in range(120):
        n = r.randint(22, 72)
        base = [f"s{i}w{j}" for j in range(n)]
        keep = r.randint(int(0.52 * n), int(0.62 * n))
        texts += [" ".join(base), " ".join(base[:keep])]
    want, _ = brute(list(enumerate(texts)))
    nodes, pairs = neardup.near_pairs(docs(texts))
    name = {r["node"]: r["id"] for r in nodes.collect()}
    got = {frozenset((name[r["a"]], name[r["b"]])) for r in pairs.collect()}
    assert len(want) > 80 and got <= want and len(got) >= 0.99 * len(want)


def test_labels_meet_before_their_members(spark):
    rows = [(1, n, 10, 0) for n in range(80)] + [(1, 99, 10, 99), (1, 98, 30, 98)] + [(2, n, 10, 5) for n in range(5)] + [(3, n, 10, n % 3) for n in range(200, 206)]
    lists = spark.createDataFrame(rows, "v bigint, node bigint, n bigint, label bigint")
    got = {(r["a"], r["b"]) for r in neardup.cross_pairs(lists).collect()}
    want = {(n, 99) for n in range(80)} | {(a, b) for a in range(200, 206) for b in range(a, 206) if a % 3 != b % 3}
    assert got == want and neardup.cross_pairs(lists.filter("v = 2")).count() == 0  # 98 is too large for any of them


def test_one_text_in_most_rows(docs):
    texts = ["the same text of a few words"] * 400 + [f"text {i} that is quite its own with number {i * 7}" for i in range(40)] + ["the same text of a few words more"]
    df = docs(texts)
    assert sorted(r["doc_id"] for r in neardup.near_dedup(df).collect()) == [0, *range(400, 440)]
    rows = neardup.near_groups(df).collect()
    assert len(rows) == 401 and {(r["keep_id"], r["n_docs"]) for r in rows} == {(0, 401)}


def test_intermediate_tables_are_deleted(spark, docs):
    import os

    from folioscan.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    neardup.near_dedup(docs(["a b c d e", "a b c d e f"])).count()
    assert sorted(n.rpartition("-")[0] for n in set(os.listdir(root)) - before) == ["near-judged"]
