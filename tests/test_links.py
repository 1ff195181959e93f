"""Source links and staged documents."""

import pytest

from folioscan.operators.site import export_site
from folioscan.sources import links as L

GOOD = 'schema_version = 3\n[[source]]\nname = "r"\nlocal_path = "sources/report.pdf"\npublic_url = "https://publisher.example/report.pdf"\n[source.metadata]\npublisher = "P"\n'


def entry(name="x", path="sources/x.pdf", url="https://a.example/x.pdf", more=""):
    return f'[[source]]\nname = "{name}"\nlocal_path = "{path}"\npublic_url = "{url}"\n{more}\n'


@pytest.fixture
def links(tmp_path):
    p = tmp_path / "links.toml"
    p.write_text(GOOD + entry("m", "notes/n.md", "https://a.example/n"))
    return L.load(p)


def test_load(links):
    found, faults = links
    assert faults == [] and found["sources/report.pdf"].metadata == {"publisher": "P"}


@pytest.mark.parametrize("bad", [
    entry("r"), entry(path="sources/report.pdf"), entry(path="../x.pdf"), entry(path="/x.pdf"), entry(path="x.txt"), entry(path="x.pdf#page=1"), entry(url="http://a.example/x"), entry(url="https://u:p@a.example/x"),
    entry(url="https://a.example/x#f"), entry(more="odd = 1"), entry(name=" "), entry(more="metadata = 3"), '[[source]]\nname = "only"\n',
])
def test_faults(tmp_path, bad):
    p = tmp_path / "links.toml"
    p.write_text(GOOD + bad)
    found, faults = L.load(p)
    assert len(faults) == 1 and list(found) == ["sources/report.pdf"]


def test_versions(tmp_path):
    p = tmp_path / "links.toml"
    p.write_text("schema_version = 2\n")
    assert L.load(p)[1]


TEXT = """---
link: "[a](../sources/report.pdf#page=1)"
---
See [a](../sources/report.pdf#page=2) and [b](../notes/n.md#top), [c](other.md), `[d](../sources/report.pdf#page=3)`.

```
[e](../sources/report.pdf#page=4)
```

[f]: ../sources/report.pdf#page=5"""


def test_staged(links):
    got = L.staged(TEXT, "docs/page.md", links[0]).split("\n")
    assert got[1] == TEXT.split("\n")[1] and got[6] == TEXT.split("\n")[6]
    assert got[3] == "See [a](https://publisher.example/report.pdf#page=2) and [b](https://a.example/n#top), [c](other.md), `[d](../sources/report.pdf#page=3)`."
    assert got[9] == "[f]: https://publisher.example/report.pdf#page=5"
    local = L.staged(TEXT, "docs/page.md", links[0], public=False, out_path="build/deep/page.md")
    assert "[a](../../sources/report.pdf#page=2)" in local
    with pytest.raises(L.LinkError):
        L.staged("[z](none.pdf#page=1)", "docs/page.md", links[0])


def test_in_bulk(spark, links, tmp_path):
    docs = spark.createDataFrame([("docs/p.md", TEXT), ("docs/q.md", "[z](none.pdf#page=1)"), ("docs/r.md", None)], "path string, text string")
    rows = {r["path"]: r for r in L.stage_documents(docs, links[0]).collect()}
    assert rows["docs/q.md"]["error"] and rows["docs/p.md"]["error"] is None and rows["docs/r.md"]["text"] is None
    cited = spark.createDataFrame([("sources/report.pdf",), ("x.pdf",)], "path string")
    known = spark.createDataFrame([("sources/report.pdf",)], "local_path string")
    assert [(r["path"], r["issue"]) for r in L.registry_issues(cited, known).collect()] == [("x.pdf", "no-entry")]
    site = spark.createDataFrame([("a.html.md", "# T\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n[code](x.py)\n"), ("b.md", "none")], "path string, text string")
    assert export_site(site, f"file://{tmp_path}/site") == {"page_count": 2, "table_count": 1}
    page = spark.read.parquet(f"file://{tmp_path}/site/pages").filter("destination = 'a.md'").first()
    assert "[code](x.md)" in page["text"] and "Retrieval text" in page["text"]
    assert spark.read.json(f"file://{tmp_path}/site/tables").first()["headers"] == ["A", "B"]
