"""Reports: prose, scopes, issues and quotes."""

import pytest

from folioscan.operators import report as R

PAGES = [("src/a.pdf", 1, "Some page text about\ncoal."), ("src/a.pdf", 65, "The quick brown\nfox jumps."), ("src/b.md", 1, "Body of b.")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "path string, page bigint, text string")


def check(spark, pages, text, name="reports/r.md"):
    i, q = R.verify_reports(spark.createDataFrame([(name, text)], "report string, text string"), pages)
    return {(r["key"], r["issue"]) for r in i.collect()}, [(r["quote"], r["key"], r["status"]) for r in q.orderBy("n").collect()]


def test_clean_report(spark, pages):
    issues, quotes = check(spark, pages, 'As [shown][a65] there.\n\n> "The quick brown\n> fox jumps."\n\n[a65]: ../src/a.pdf#page=65\n')
    assert issues == set() and quotes == [("The quick brown\nfox jumps.", "a65", "exact")]


def test_issues(spark, pages):
    text = """[x][none] [x][bad] [x][zero] [x][out] [x][unknown] [x][page] [x][dup] [x][amb] `[x][code]`

```
[x][fenced]
```
<!-- [x][comment] -->

[bad]: ../src/a.pdf#page=x
[zero]: ../src/a.pdf#page=0
[out]: ../../etc/a.pdf#page=1
[unknown]: ../src/z.pdf#page=1
[page]: ../src/a.pdf#page=9
[dup]: ../src/a.pdf#page=1
[dup]: ../src/a.pdf#page=1
[amb]: ../src/a.pdf#page=1
[amb]: ../src/b.md#page=1
"""
    issues, _ = check(spark, pages, text)
    assert issues == {("none", "missing-definition"), ("bad", "malformed-page"), ("zero", "bad-page"), ("out", "path-outside-root"), ("unknown", "unindexed-path"), ("page", "page-not-indexed"), ("dup", "duplicate-definition"), ("amb", "ambiguous-definition")}


DEFS = "\n\n[a]: ../src/a.pdf#page=1\n[b]: ../src/b.md#page=1\n"


@pytest.mark.parametrize(("text", "expected"), [
    ("First [x][a].\n\nThen [x][b].\n\n> Body of b.", ("b", "exact")),
    ("First [x][a].\nThen [x][b].\n\n> Body of b.", (None, "structural-error")),
    ("[x][b]\n\n# Heading\n\n> Body of b.", (None, "structural-error")),
    ("[x][b]\n\n- item\n> Body of b.", (None, "structural-error")),
    ("[x][a]\n\n> Some page  text about coal.", ("a", "normalised")),
    ("[x][a]\n\n> Not there.", ("a", "not-found")),
    ("[x][a]\n\n> ", (None, "structural-error")),
])
def test_scopes(spark, pages, text, expected):
    _, quotes = check(spark, pages, text + DEFS)
    status = quotes[0][1:]
    assert status[1] == expected[1] and (expected[0] is None or status[0] == expected[0])


def test_no_reports(spark, pages):
    i, q = R.verify_reports(spark.createDataFrame([], "report string, text string"), pages)
    assert i.count() == 0 and q.count() == 0
