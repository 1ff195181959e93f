"""Store: sync in all its cases, search, prune, doctor, compaction, streaming."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators.search import search
from folioscan.operators.store import Options, Store, StoreError
from folioscan.streaming.sync import stream_into

A = "# Storage\n\nBatteries store energy for the evening peak.\n\n## Coal\n\nBrown coal retires in 2035."
B = "# Wind\n\nOffshore wind grows quickly along the coast."


def files(spark, **texts):
    return spark.createDataFrame([(f"{p}.md", bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", create=True)


def test_life_of_a_store(spark, store):
    r = store.sync(files(spark, a=A, b=B))
    assert (r.added, r.failed, r.unchanged) == (2, 0, 0) and r.embedded == store.chunks().count() == r.chunks_inserted
    assert store.doctor().count() == 0
    first = {(x["path"], x["body"]): x["chunk_id"] for x in store.chunks().collect()}

    again = store.sync(files(spark, a=A, b=B))
    assert (again.unchanged, again.embedded, again.version) == (2, 0, r.version)  # nothing is published

    moved = store.sync(files(spark, new=A, b=B))
    assert (moved.renamed, moved.added, moved.missing, moved.embedded) == (1, 0, 0, 0)
    assert {x["chunk_id"] for x in store.chunks().collect()} == set(first.values())

    changed = store.sync(files(spark, new=A.replace("2035", "2036"), b=B))
    assert (changed.changed, changed.embedded, changed.chunks_updated) == (1, 1, 1)
    kept = {x["chunk_id"] for x in store.chunks().collect()}
    assert kept == set(first.values())  # an updated chunk keeps its id

    gone = store.sync(files(spark, b=B))
    assert gone.missing == 1 and store.sources().count() == 2
    assert [x["path"] for x in store.prune_plan(F.col("path") == "b.md").collect()] == ["new.md"]
    assert store.prune(F.col("path") == "b.md") == 1 and store.sources().count() == 1
    before = {x["chunk_id"] for x in store.chunks().collect()}
    assert store.compact() == {"chunks": len(before), "sources": 1}
    assert {x["chunk_id"] for x in store.chunks().collect()} == before and store.doctor().count() == 0
    assert store.vacuum() > 0 and store.chunks().count() == len(before)
    assert Store(spark, store.root).chunks().count() == len(before)


def test_offsets_move_and_model_switch(spark, store):
    store.sync(files(spark, a="# A\n\nalpha\n\n# B\n\nbeta"), Options(max_chars=40))
    ids = {x["body"]: (x["chunk_id"], x["line_start"]) for x in store.chunks().collect()}
    r = store.sync(files(spark, a="# A\n\nalpha is longer\nnow\n\n# B\n\nbeta"), Options(max_chars=40))
    now = {x["body"]: (x["chunk_id"], x["line_start"]) for x in store.chunks().collect()}
    beta = next(b for b in ids if "beta" in b)
    assert now[beta][0] == ids[beta][0] and now[beta][1] == ids[beta][1] + 1 and r.embedded == 1
    n = store.chunks().count()
    assert store.sync(files(spark, a="# A\n\nalpha is longer\nnow\n\n# B\n\nbeta"), Options(max_chars=40, model="stub@2")).embedded == n
    assert store.embeddings("stub@1").count() == n + 1 and store.embeddings("stub@2").count() == n


def test_bad_files_and_partial_syncs(spark, store):
    bad = spark.createDataFrame([("x.xlsx", bytearray(b"junk")), ("a.md", bytearray(A.encode()))], "path string, content binary")
    r = store.sync(bad)
    assert (r.added, r.failed) == (2, 1) and r.errors[0].startswith("x.xlsx") and store.sources().count() == 1
    r = store.sync(files(spark, b=B), partial=True)
    assert (r.added, r.missing) == (1, 0) and store.sources().count() == 2
    assert store.sync(files(spark)).missing == 2


def test_search(spark, store):
    store.sync(files(spark, a=A, b=B))
    rows = search(store, "coal").collect()
    assert rows[0]["path"] == "a.md" and "Brown coal" in rows[0]["body"] and rows[0]["provenance"] == "lexical+vector"
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert {r["provenance"] for r in search(store, "nothing-matches-this").collect()} <= {"vector"}
    assert search(store, "coal", source_types=["pdf"]).count() == 0
    assert search(store, "coal", limit=1).count() == 1


def test_unknown_stores(spark, tmp_path):
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/none")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "CURRENT").write_text('{"store": 99}')
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/odd")


def test_doctor_finds_damage(spark, store):
    store.sync(files(spark, a=A))
    store.state["embeddings"] = []
    assert {r["issue"] for r in store.doctor().collect()} == {"chunk-without-embedding"}


def test_stream(spark, store, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text(A)
    (folder / "sub" / "b.md").write_text(B)
    q = stream_into(store, str(folder), f"file://{tmp_path}/checkpoint")
    q.awaitTermination(120)
    (folder / "c.md").write_text("# New\n\nthird")
    q = stream_into(store, str(folder), f"file://{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert sorted(r["path"] for r in Store(spark, store.root).sources().collect()) == ["a.md", "c.md", "sub/b.md"]
