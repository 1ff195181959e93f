"""What a store takes of disk, and that nothing of it is lost for that."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from test_store import A, B, files, store  # noqa: F401

from folioscan.operators import postings
from folioscan.operators.store import Store
from folioscan.sources import units


def _bytes(root: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root.removeprefix("file://")) for f in fs)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    return {f"t{i}": "\n\n".join(" ".join(r.choices(words, k=150)) for _ in range(6)) for i in range(250)}


def test_a_store_takes_little_more_than_its_texts(spark, store, texts):  # noqa: F811
    store.sync(files(spark, **texts))
    assert {r["path"]: r["text"] for r in store.pages().collect()} == {f"{k}.md": v for k, v in texts.items()}
    size = sum(map(len, texts.values()))
    assert _bytes(store.root) < 3 * size  # postings alone took more than eight times the text
    joined = " ".join(r["body"] for r in store.chunks().collect())
    assert store.postings().agg(F.sum("tf")).first()[0] == len(joined.split())
    store.prune(F.col("path") < "t2")
    n = store.chunks().count()
    assert store.compact()["chunks"] == n and store.vacuum() > 0
    assert store.postings().select("chunk_id").distinct().count() == n and _bytes(store.root) < 3 * size and store.doctor().count() == 0


def test_a_torn_file_keeps_what_it_was_and_others_are_taken_in(spark, store, monkeypatch):  # noqa: F811
    store.sync(files(spark, a=A))
    before = sorted(map(str, store.chunks().drop("segment").collect()))
    parse = units.parse_files
    torn = F.when(F.col("path") == "a.md", F.concat("content", F.lit(" x").cast("binary"))).otherwise(F.col("content"))
    monkeypatch.setattr("folioscan.operators.store.U.parse_files", lambda f: parse(f.withColumn("content", torn)))
    r = store.sync(files(spark, a=A + " more", b=B))
    assert (r.added, r.changed, r.failed, r.chunks_inserted) == (1, 1, 1, 1)
    assert sorted(map(str, store.chunks().filter("path = 'a.md'").drop("segment").collect())) == before
    assert sorted(x["path"] for x in store.pages().collect()) == ["a.md", "b.md"] and store.doctor().count() == 0


def test_runs_of_an_index(spark, monkeypatch):
    """Several runs in one batch, empty texts and nulls among them."""
    monkeypatch.setattr(postings, "RUN", 5)
    monkeypatch.setattr(postings, "OUT", 2)
    import pyarrow as pa

    tokens = [["b", "a", "b"], [], None, ["c"] * 7, ["a", "é"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(tokens, type=pa.list_(pa.string()))], names=["k", "t"])
    got = [tuple(r.values()) for b in postings._inverted(iter([batch])) for r in b.to_pylist()]
    assert got == [(0, "a", 1, [1], 3), (0, "b", 2, [0, 2], 3), (3, "c", 7, list(range(7)), 7), (4, "a", 1, [0], 2), (4, "é", 1, [1], 2)]


def test_a_page_costs_little_beside_its_chunks_and_a_posting_names_its_chunk_once(spark, store, texts, tmp_path):  # noqa: F811
    store.sync(files(spark, **texts))
    zstd = lambda df, name: df.write.option("compression", "zstd").parquet(f"file://{tmp_path}/{name}")
    zstd(store.chunks().select("chunk_id", "source_id", "body", "lexical_hash", "semantic_hash"), "bodies")
    assert _bytes(f"{store.root}/{store.state['pages'][0]}") < 1.3 * _bytes(f"{tmp_path}/bodies")
    zstd(store.postings().select("chunk_id", "source_id", "length"), "ids")
    zstd(store.postings().select("term", "tf", "positions"), "rest")
    assert _bytes(f"{store.root}/{store.state['postings'][0]}") < _bytes(f"{tmp_path}/rest") + 0.8 * _bytes(f"{tmp_path}/ids")


def test_a_store_of_version_1_is_read_and_goes_on_as_version_2(spark, store):  # noqa: F811
    store.sync(files(spark, a=A, b=B))
    rows = lambda s: {k: sorted(str(r.asDict()) for r in getattr(s, k)().collect()) for k in ("chunks", "pages", "postings")}
    want, named = rows(store), dict(store.state)
    for k in ("chunks", "pages", "postings"):  # with the columns that version 1 had
        store._segment(k, named[k]).filter("page is not null" if k == "pages" else "chunk_id is not null").write.parquet(f"{store.root}/v=old/{k}")
        named[k] = [f"v=old/{k}"]
    store._publish(named)
    path = f"{store.root.removeprefix('file://')}/versions/{store.state['number']:012d}.json"
    with open(path) as f:
        text = f.read()
    with open(path, "w") as f:
        f.write(text.replace('"store": 2', '"store": 1'))
    for crc in glob.glob(f"{os.path.dirname(path)}/.*.crc"):
        os.remove(crc)
    old = Store(spark, store.root)
    assert old.state["store"] == 1 and rows(old) == want
    old.sync(files(spark, a=A, b=B + " More.", c="new"))
    assert old.state["store"] == 2 and {r["path"]: r["text"] for r in old.pages().collect()} == {"a.md": A, "b.md": B + " More.", "c.md": "new"} and old.doctor().count() == 0
