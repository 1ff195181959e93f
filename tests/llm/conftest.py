from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, ids=None):
    """A documents table of these texts; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if t is None else "en", "web", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCUMENTS)


@pytest.fixture
def docs(spark):
    return lambda texts, ids=None: documents(spark, texts, ids)


@pytest.fixture
def clashing(spark):
    """The same table with further columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    def make(df):
        names = ["digest", "id", "node", "label", "n", "v", "a", "b", "sk", "r", "s", "h", "x", "y", "p", "k", "item_id", "tokens", "probability", "row", "with.dot", "words"]
        return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in names])

    return make
