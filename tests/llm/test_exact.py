"""Exact dedup against grouping by text in Python."""

from folioscan.llm import exact


def kept(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None)


def test_keeps_the_least_id_of_each_text(docs):
    got = exact.exact_dedup(docs(["a b", "c", "a b", "", "", "A b"], [5, 2, 3, 9, 8, 1]))
    assert kept(got) == [(1, "A b"), (2, "c"), (3, "a b"), (8, "")]


def test_nulls_and_repeated_rows(docs):
    got = exact.exact_dedup(docs([None, None, "x", "x", "x", "y"], [1, 1, 4, 4, None, None]))
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, None), (1, None), (4, "x"), (None, "y")], key=str)


def test_null_and_empty_text_differ(docs):
    ids = {(r["doc_id"], r["digest"] is None) for r in exact.exact_dedup_ids(docs(["", None, "", None])).collect()}
    assert ids == {(0, False), (1, True), (3, True)}


def test_later_batches_are_held_against_the_index(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert kept(exact.exact_dedup(docs(["a", "b", "a"]), index)) == [(0, "a"), (1, "b")]
    assert kept(exact.exact_dedup(docs(["b", "c", None], [10, 11, 12]), index)) == [(11, "c"), (12, None)]
    assert kept(exact.exact_dedup(docs(["a", "b", "c"], [20, 21, 22]), index)) == []
    assert index.read().count() == 3
    small = index.compact(f"file://{tmp_path}/small")
    assert small.read().count() == 3
    assert kept(exact.exact_dedup(docs(["c", "d"], [30, 31]), small)) == [(31, "d")]


def test_empty_table(docs):
    assert exact.exact_dedup(docs([])).count() == 0
    assert exact.exact_dedup_ids(docs([])).count() == 0


def test_very_long_texts(docs):
    long = "word " * 400_000
    assert kept(exact.exact_dedup_ids(docs([long, long, long + "x"])).selectExpr("doc_id", "'' text")) == [(0, ""), (2, "")]


def test_further_columns_stay(docs, clashing):
    df = clashing(docs(["a", "a", None]))
    got = exact.exact_dedup(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["with.dot"]) for r in got.collect()) == [(0, "extra with.dot"), (2, "extra with.dot")]


def test_the_index_side_is_neither_shuffled_nor_broadcast(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/plan", buckets=4)
    index.ingest(docs([f"text {i}" for i in range(100)]))
    plan = index.fresh(docs(["q"]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    scan = plan[plan.index("FileScan parquet") - 400 :] if "fs_digests" in plan else plan
    assert "Bucketed: true" in plan or "fs_digests" in scan


def test_another_number_of_buckets_is_an_error(spark, tmp_path):
    import pytest

    path = f"file://{tmp_path}/index"
    exact.DigestIndex(spark, path, buckets=4)
    assert exact.DigestIndex(spark, path).buckets == 4
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, path, buckets=8)


def test_a_batch_that_is_asked_for_again_gives_the_same_rows(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    one = docs(["a", "b", "a"])
    assert kept(exact.exact_dedup(one, index, "monday")) == [(0, "a"), (1, "b")]
    # the caller died before it wrote them
    assert kept(exact.exact_dedup(one, exact.DigestIndex(spark, index.path), "monday")) == [(0, "a"), (1, "b")]
    assert index.read().count() == 2
    assert kept(exact.exact_dedup(one, index, "tuesday")) == []
    index.forget("tuesday")


def test_an_append_that_was_not_marked_is_repeated_without_harm(spark, docs, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.ingest(docs(["a", "b"]), "x")
    for p in (tmp_path / "index" / "done").iterdir():
        p.unlink()
    assert kept(exact.exact_dedup(docs(["a", "b"]), index, "x")) == [(0, "a"), (1, "b")]
    assert kept(exact.exact_dedup(docs(["a", "c"], [7, 8]), index, "y")) == [(8, "c")]
    assert index.compact(f"file://{tmp_path}/small").read().count() == 3


def test_arrivals_are_the_whole_table_in_order(docs):
    d = docs([f"t{i % 7}" for i in range(50)] + [None, "x"], [*range(50), 60, None])
    parts = exact.arrivals(d, 3)
    ids = [[r["doc_id"] for r in p.collect()] for p in parts]
    assert sorted((i for p in ids for i in p), key=str) == sorted([*range(50), 60, None], key=str)
    assert max(ids[0]) < min(ids[1]) and max(ids[1]) < min(i for i in ids[2] if i is not None)
    assert exact.arrivals(docs([]), 3)[0].count() == 0


def test_against_grouping_with_collisions_of_the_bitmap(spark, docs):
    import random

    from folioscan.llm import common

    r = random.Random(2)
    texts = [f"text {r.randint(0, 4000)}" for _ in range(6000)] + ["hot"] * 3000
    index = exact.new_index(spark)
    got = common.keep_rows(docs(texts), index.ingest(docs(texts)), bits=1 << 15)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(t, i)
    assert kept(got) == sorted((i, t) for t, i in least.items())


def test_texts_without_copies_are_not_shuffled(spark, docs):
    plan = exact.exact_dedup(docs(["a", "b", "c", "a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and "LeftSemi" in plan
