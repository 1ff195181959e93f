"""DataFrames as Markdown tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscan.operators import publish as P
from folioscan.operators.normalise import normalise_table

ROWS = [("wind|x", 1500.0, "2024-01-02", "a*b"), ("solar", None, "2024-01-03", "<tag>"), ("coal", -2.5, "2024-01-01", None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(i, a, b, dt.datetime.fromisoformat(c), d) for i, (a, b, c, d) in enumerate(ROWS, 1)], "n int, technology string, capital_cost double, at timestamp, notes string")


def test_table(df):
    got = P.knowledge_table(df, table_id="costs", order_by=["n"], caption="Costs", columns=["technology", "capital_cost", "at", "notes"], units={"capital_cost": "EUR"}, row_identity=["technology"], summary=True).splitlines()
    assert got[0] == '<!-- knowledge-table: {"row_identity": ["technology"], "units": {"capital cost": "EUR"}} -->'
    assert got[2:7] == ["| technology | capital cost | at | notes |", "| :--- | ---: | :--- | :--- |", r"| wind\|x | 1500 | 2024-01-02 | a\*b |", "| solar | not available | 2024-01-03 | &lt;tag&gt; |", "| coal | -2.5 | 2024-01-01 | not available |"]
    assert got[8] == ": Costs {#costs}"
    assert got[10].startswith("**First-row finding.** For **wind") and "capital cost is **1500 EUR**" in got[10]


def test_it_can_be_read_again(df):
    t = normalise_table(P.knowledge_table(df, table_id="costs", order_by=["n"], caption="Costs", ordering="n ascending"))
    assert t.table_id == "costs" and len(t.rows) == 3 and not t.has_errors and t.rows[0][1] == "wind|x"


def test_errors(df):
    for how in ({"table_id": "9x"}, {"table_id": "x", "columns": ["zz"]}, {"table_id": "x", "labels": {"zz": "y"}}, {"table_id": "x", "labels": {"notes": "n"}}, {"table_id": "x", "max_rows": 1}):
        with pytest.raises((ValueError, KeyError)):
            P.knowledge_table(df, order_by=["n"], **how)


def test_numbers_as_python_writes_them(spark):
    values = [0.0, 1.0, -1.5, 123456.0, 1234567.0, 0.0001, 0.00001234, 999999.5, 3.14159265, 1e20, -2.5e-7, 100000.0, 12345.678]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", P.general(F.col("v")).alias("s")).collect()
    assert [(r["v"], r["s"]) for r in rows] == [(v, f"{v:g}") for v in values]
    got = spark.createDataFrame([(1234.5678,)], "v double").select(*[P.formatted(F.col("v"), spark.createDataFrame([(1.0,)]).schema[0].dataType, f).alias(str(i)) for i, f in enumerate([".2f", ",.1f", ".1%", "d"])]).first()
    assert list(got) == ["1234.57", "1,234.6", "123456.8%", "1234"]


def test_empty(df):
    assert P.summarise_first(df.limit(0), ["n"]) == "**First-row finding.** The table contains no rows."
    assert P.knowledge_table(df.limit(0), table_id="e", order_by=["n"], columns=["n"]).splitlines()[-2:] == ["| n |", "| ---: |"]
