"""The pipeline against the same stages done by brute force, and its contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P  # noqa: E402
from test_decontam import brute as brute_leaks  # noqa: E402
from test_neardup import brute as brute_groups  # noqa: E402

from folioscan.llm import bpe, quality  # noqa: E402


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality.fit(docs, labels)
    rows = {}
    for r in docs.select("doc_id", "text").collect():
        import numpy as np

        p = model.probability(np.array([quality.statistics(r["text"])]))[0] if r["text"] and r["text"].split() else 0.0
        if p >= quality.ACCEPT:
            rows[r["doc_id"]] = r["text"]
    least = {}
    for i in sorted(rows):
        least.setdefault(rows[i], i)
    rows = {i: t for t, i in least.items()}
    _, groups = brute_groups(list(rows.items()))
    for g in groups:
        for i in sorted(g)[1:]:
            rows.pop(i)
    for d, _ in brute_leaks(list(rows.items()), items):
        rows.pop(d, None)
    codec = bpe.codec()
    got = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        assert got[i]["tokens"] == codec.encode([t])[0].tolist() and codec.decode(got[i]["tokens"]).decode() == t


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "a few words", None, None, 11)]])
def test_odd_documents(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if i + 1 < len(P.STAGES):
            assert out.columns == docs.columns
            docs = out
        else:
            assert "doc_id" in out.columns
        assert out.count() <= len(rows)


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "tokens"]
