"""Table normalisation: the fixtures' expectations, readers, scanner and documents in bulk."""

import json

import pytest

from folioscan.operators import normalise as N
from folioscan.sources import doctables as D


def codes(t):
    return [d.code for d in t.diagnostics]


def pipe(headers, *rows, comment=None, tail=""):
    line = lambda c: "| " + " | ".join(c) + " |"
    body = "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])
    return (f"<!-- knowledge-table: {json.dumps(comment)} -->\n\n" if comment else "") + body + tail


RANKED = pipe(
    ["Rank", "Place", "Date", "Temperature (°C)"], ["1", "Oodnadatta Airport, South Australia", "1960-01-02", "50.7"], ["2", "Onslow", "2022-01-13", "50.5"],
    comment={"ordering": "Temperature descending", "row_identity": ["Place", "Date"]}, tail="\n\n: Hottest days {#hot}",
)


def test_ranked_table():
    t = N.normalise_table(RANKED)
    assert codes(t) == [] and t.supported and (t.table_id, t.caption) == ("hot", "Hottest days")
    assert t.normalised_text.split("\n\n")[1].startswith("Rank 1. Place: Oodnadatta")
    assert t.row_ids[0] == "hot:row-f69c2d542ee7696e"
    assert t.row_records[0].endswith("Temperature (°C): 50.7.")
    assert t.canonical_markdown.splitlines()[0] == "| Rank | Place | Date | Temperature (°C) |"


def test_derived_id_does_not_depend_on_values():
    a, b = (N.normalise_table(pipe(["A", "B"], [x, "1"])) for x in "xy")
    assert a.table_id == b.table_id and a.row_ids != b.row_ids and a.source_hash != b.source_hash


@pytest.mark.parametrize(("source", "expected"), [
    (pipe(["Value (°C)"], ["323.85 K"], ["50.5 °C"]), ["table.unit-conflict", "table.mixed-units"]),
    (pipe(["Name", "Value"], ["a", "8"], ["b", "10"], comment={"ordering": "Value descending"}), ["table.ordering-mismatch"]),
    (pipe(["Rank", "N"], ["1", "a"], ["1", "b"]), ["table.duplicate-rank"]),
    (pipe(["Rank", "N"], ["2", "a"], ["1", "b"]), ["table.nonmonotonic-rank"]),
    (pipe(["Date", "N"], ["2024-02-01", "a"], ["2024-01-01", "b"], comment={"ordering": "Date ascending"}), ["table.ordering-mismatch"]),
    (pipe(["A", "N"], ["", "a"], ["2", "b"], comment={"ordering": "A ascending"}), ["table.ordering-mismatch"]),
    (pipe(["A", "N"], ["2", "a"], ["1", "a"], ["", "c"], comment={"ordering": "A descending then N ascending"}), []),
    (pipe(["A"], ["1"], comment={"ordering": "somehow"}), ["table.ordering-unchecked"]),
    (pipe(["A", "A"], ["1", "2"]), ["table.duplicate-headers"]),
    (pipe(["A", "B"]), ["table.empty-body"]),
    (pipe(["A", "B"], ["1", "2"], ["1", "2"]), ["table.duplicate-rows"]),
    (pipe(["A", "B"], ["1", "2"], ["1", "3"], comment={"row_identity": ["A"]}), ["table.duplicate-row-identity"]),
    (pipe(["A", "B"], ["", "2"], comment={"row_identity": ["A"]}), ["table.missing-row-identity-value"]),
    (pipe(["A", "B"], ["1", "2"], comment={"row_identity": ["Z"]}), ["table.missing-row-identity-column"]),
    (pipe(["A", "B"], ["1"]), ["table.ragged-row"]),
    (pipe(["A", ""], ["1", "2"]), ["table.empty-header"]),
    (pipe(["Power (MW)"], ["3"], comment={"units": {"Power (MW)": "GW"}}), ["table.header-unit-conflict"]),
    (pipe(["Value (estimated)", "Power (MW)"], ["3", "4 MW"]), []),
])
def test_findings(source, expected):
    assert codes(N.normalise_table(source)) == expected
    if any("conflict" not in c and c in ("table.ordering-mismatch", "table.duplicate-rank", "table.ragged-row") for c in expected):
        with pytest.raises(D.TableError):
            N.normalise_table(source, strict=True)


def test_labels_and_units():
    t = N.normalise_table(pipe(["tmax", "n"], ["50.7", "NA"], comment={"labels": {"tmax": "Daily maximum temperature"}, "units": {"tmax": "°C", "n": "kg"}}))
    assert t.headers == ["Daily maximum temperature", "n"]
    assert t.normalised_text.endswith("Row 1. Daily maximum temperature: 50.7 °C; n: not available.")


def test_identity_ignores_the_rank():
    ids = {N.normalise_table(pipe(["Rank", "Name"], [r, "x"], comment={"row_identity": ["Name"], "table_id": "t"})).row_ids[0] for r in "19"}
    assert len(ids) == 1


def test_grid_and_simple_and_multiline():
    grid = "+-----+------+\n| A   | B    |\n+:===:+=====:+\n| 1   | two  |\n|     | more |\n+-----+------+\n| 3   | 4    |\n+-----+------+\n"
    t = N.normalise_table(grid)
    assert (t.headers, t.rows) == (["A", "B"], [["1", "two more"], ["3", "4"]]) and ":---: | ---:" in t.canonical_markdown
    simple = "  Right  Left\n-------  -----\n     12  ab\n      3  cd\n\n: Numbers\n"
    t = N.normalise_table(simple)
    assert (t.headers, t.rows, t.caption) == (["Right", "Left"], [["12", "ab"], ["3", "cd"]], "Numbers")
    multi = "-------------------------\nName       Long\n           header\n---------- --------------\nfirst      a text of\n           two lines\n\nsecond     b\n-------------------------\n"
    t = N.normalise_table(multi)
    assert (t.headers, t.rows) == (["Name", "Long header"], [["first", "a text of two lines"], ["second", "b"]])


def test_inline_markdown_of_cells():
    t = N.normalise_table(pipe(["**Bold**", "Link"], [r"a \| b *c*", "[label](http://x.y)"], ["`x|y`".replace("|", r"\|"), "$a_1$ &amp; 2 * 3"]))
    assert t.headers == ["Bold", "Link"]
    assert t.rows[0] == ["a | b c", "label (http://x.y)"]
    assert t.rows[1][1] == "$a_1$ & 2 * 3"


def test_html():
    t = N.normalise_table('<table id="x1"><caption>Cap <b>one</b></caption><thead><tr><th colspan="2">Both</th></tr><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td rowspan="2">1</td><td>2<br>3</td></tr><tr><td><a href="u">4</a></td></tr></tbody></table>')
    assert (t.table_id, t.caption, t.headers) == ("x1", "Cap one", ["Both / A", "Both / B"])
    assert t.rows == [["1", "2 3"], ["1", "4 (u)"]]
    assert codes(t).count("table.span-expanded") == 2 and t.source_format == "html"
    inner = "<table><tr><td>i</td></tr></table>"
    nested = N.normalise_table(f"<table><tr><th>Outer</th></tr><tr><td>{inner}</td></tr></table>")
    assert not nested.supported and "table.unsupported-nested-table" in codes(nested)
    assert codes(N.normalise_table("<table><tr><td>1</td></tr></table>")) == ["table.generated-headers"]
    assert "table.rowspan-overflow" in codes(N.normalise_table('<table><tr><th>A</th></tr><tr><td rowspan="3">1</td></tr></table>'))


DOCUMENT = f"""# First

## Inner

{RANKED}

```text
{pipe(["fenced"], ["1"])}
```

```{{=html}}
<table><tr><th>H</th></tr><tr><td>1</td></tr></table>
```

# Second

<table id="hot"><tr><th>Z</th></tr><tr><td>9</td></tr></table>

<!-- knowledge-table: {{not-json}} -->
{pipe(["Q"], ["1"])}
"""


def test_document():
    ts = N.document_tables(DOCUMENT, "d.md")
    assert [t.section_path for t in ts] == [["First", "Inner"], ["First", "Inner"], ["Second"], ["Second"]]
    assert [t.source_format for t in ts] == ["markdown", "html", "html", "markdown"]
    assert "table.duplicate-id" in codes(ts[2])
    assert [t.start_line for t in ts] == sorted(t.start_line for t in ts)
    lines = DOCUMENT.splitlines()
    assert lines[ts[0].start_line - 1].startswith("<!--") and lines[ts[0].end_line - 1].startswith(": Hottest")
    assert codes(ts[3]) == ["table.normalisation-failed"] and not ts[3].supported and ts[3].raw_source


def test_blocks_are_idempotent():
    once, tables = N.with_blocks(DOCUMENT)
    assert len(tables) == 4 and N.with_blocks(once)[0] == once
    assert N.without_blocks(once).split() == DOCUMENT.split()


def test_one_table_is_wanted():
    for source in ("no table", RANKED + "\n\n" + RANKED):
        with pytest.raises(D.TableError):
            N.normalise_table(source)


def test_many_documents(spark):
    docs = spark.createDataFrame([(1, DOCUMENT, "a.md"), (2, None, "b.md"), (3, "", "c.md"), (4, RANKED, None)], "doc_id bigint, text string, path string")
    ts = N.documents_tables(docs, path="path").cache()
    assert {(r["doc_id"], r["n"]) for r in ts.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {(1, 4), (4, 1)}
    rows = N.table_rows(ts).filter("doc_id = 4").orderBy("row").collect()
    assert [r["row"] for r in rows] == [1, 2] and rows[0]["row_id"] == "hot:row-f69c2d542ee7696e"
    counts = {(r["doc_id"], r["table_id"]): r["errors"] for r in N.diagnostic_counts(ts).collect()}
    assert counts[4, "hot"] == 0
    plan = ts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # documents stay where they are
