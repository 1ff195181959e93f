"""HTML tables are read once, and what isn't asked for stays in Python."""

from html.parser import HTMLParser

from folioscan.operators import normalise
from folioscan.sources import doctables as D

ODD = [
    "<table><thead><tr><th>Key</th><th>What</th></tr></thead><tbody><tr><td rowspan=\"2\">1</td><td>a</td></tr><tr><td>b</td></tr></tbody></table>",
    "<TABLE id=t><caption>C</caption><tr><TH>A<th>B<tr><td>1 <b>x</b> &amp; y<td><script>if (a </td> b) {</script>2</table>",
    "<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>", "<table><tr><td colspan=2>a</td ></tr><tr><td>b</td><td>c<!-- </td> --></td></tr></table>", "<table></table>",
]


def _tables():
    return [[t.to_dict() for t in normalise.document_tables("# H\n\n" + x + "\n")] for x in ODD]


def test_a_table_is_read_once(monkeypatch):
    fed = []
    feed = HTMLParser.feed
    monkeypatch.setattr(D._Reader, "feed", lambda self, data: (fed.append(data), feed(self, data)), raising=False)
    assert len(normalise.document_tables(ODD[0])) == 1 and len(fed) == 1


def test_the_short_way_gives_what_the_long_one_gives(monkeypatch):
    short = _tables()
    assert [len(x) for x in short] == [1] * 5 and short[0][0]["rows"] == [["1", "a"], ["1", "b"]]
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.delattr(D._Reader, name)
    assert _tables() == short


def test_chosen_fields(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id bigint, text string")
    whole = normalise.documents_tables(docs).select("doc_id", "table_no", "source_format", "rows", "diagnostics")
    some = normalise.documents_tables(docs, fields=("source_format", "rows", "diagnostics")).select(*whole.columns)
    assert some.dtypes == whole.dtypes and sorted(map(str, some.collect())) == sorted(map(str, whole.collect()))
