"""Markdown and workbook units."""

import io
import json
import zipfile

import pytest

from folioscan.sources import units as U

OOXML = "http://schemas.openxmlformats.org"
MAIN = f'xmlns="{OOXML}/spreadsheetml/2006/main"'


def tag(element, body="", /, **attributes):
    said = "".join(f' {k.replace("_", ":")}="{v}"' for k, v in attributes.items())
    return f"<{element}{said}>{body}</{element}>"


def cell(ref, value=None, kind=None, formula=None):
    body = (tag("f", formula) if formula else "") + (tag("is", tag("t", value)) if kind == "inlineStr" else tag("v", value) if value is not None else "")
    return tag("c", body, r=ref, **({"t": kind} if kind else {}))


def row(*cells, **attributes):
    return tag("row", "".join(cells), **attributes)


def workbook(rows: str, shared: str = "", name: str = "Retirement assumptions", kind: str = "worksheet") -> bytes:
    out = io.BytesIO()
    relation = tag("Relationship", Type=f"http://x/{kind}", Target="worksheets/one.xml", Id="first")
    sheet = tag("sheet", name=name, sheetId=1, r_id="first")
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{OOXML}/officeDocument/2006/relationships">{tag("sheets", sheet)}</workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{OOXML}/package/2006/relationships">{relation}</Relationships>',
        "xl/worksheets/one.xml": f"<worksheet {MAIN}>{tag('sheetData', rows)}</worksheet>",
    }
    if shared:
        parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>{shared}</sst>"
    with zipfile.ZipFile(out, "w") as z:
        for part, body in parts.items():
            z.writestr(part, body)
    return out.getvalue()


SHARED = tag("si", tag("t", "Technology")) + tag("si", tag("r", tag("t", "Retirement ")) + tag("r", tag("t", "year"))) + tag("si", tag("t", "Brown coal"))
BOOK = workbook(
    row(cell("A1", "0", "s"), cell("B1", "1", "s"), r=1) + row(cell("A2", "2", "s"), cell("B2", "2035"), cell("C2", "2040", formula="B2+5"), r=2)
    + row(cell("A3", "Note", "inlineStr"), cell("B3", formula="B2"), r=3) + row(cell("XFD1048576"), r=1048576), SHARED,
)


def test_workbook():
    us = U.workbook_units(BOOK)
    assert len(us) == 3
    assert us[0]["text"] == 'Worksheet "Retirement assumptions", row 1, cells A1:B1\nA1 = "Technology"\nB1 = "Retirement year"'
    assert 'C2 = FORMULA "=B2+5"; cached = 2040' in us[1]["text"] and 'B3 = FORMULA "=B2"' in us[2]["text"] and "cached" not in us[2]["text"]
    at = json.loads(us[1]["locator"])
    assert (at["range"], at["start_cell"], at["end_cell"], at["row_start"], at["sheet_state"]) == ("A2:C2", "A2", "C2", 2, "visible")


def test_workbook_limits():
    long = "x" * 400
    us = U.workbook_units(workbook(row(*[cell(f"{c}1", long, "inlineStr") for c in "ABC"], r=1) + row(cell("A2", formula="1+" * 200 + "1"))))
    assert [json.loads(u["locator"])["range"] for u in us] == ["A1:B1", "C1", "A2"]
    assert "… [truncated; 401 characters]" in us[2]["text"]
    assert U.workbook_units(workbook("<row/>", kind="chartsheet")) == []
    for bad in (b"no zip", workbook(row(cell("A1", "9", "s"), r=1))):
        with pytest.raises(U.WorkbookError):
            U.workbook_units(bad)


def test_markdown():
    us = U.markdown_units("intro\nline\n\n# A\n\ntext\n## B\np1\n\np2\n# A\nagain\n#no heading\n")
    assert [(u["content_type"], u["logical_key"], u["line_start"], u["line_end"]) for u in us] == [
        ("body", "root#0:p0000", 1, 2), ("heading", "A#0:heading", 4, 4), ("body", "A#0:p0000", 6, 6), ("heading", "A/B#0:heading", 7, 7),
        ("body", "A/B#0:p0000", 8, 8), ("body", "A/B#0:p0001", 10, 10), ("heading", "A#1:heading", 11, 11), ("body", "A#1:p0000", 12, 13),
    ]
    assert us[4]["heading_path"] == ["A", "B"] and us[7]["text"] == "again\n#no heading"
    assert U.markdown_units("") == []


def test_long_paragraphs():
    words = " ".join(f"word{i:04d}" for i in range(1000))
    pieces = U.split_words(words, 2400)
    assert " ".join(pieces) == words and max(map(len, pieces)) <= 2400 and len(pieces) == 4
    assert U.split_words("a " + "b" * 30 + " c", 10) == ["a", "b" * 30, "c"]
    us = U.markdown_units("x\n\n" + words)
    assert [u["logical_key"] for u in us] == ["root#0:p0000", "root#0:p0001", "root#0:p0002:sub01", "root#0:p0003:sub02", "root#0:p0004:sub03"]


def test_files(spark):
    files = spark.createDataFrame([("a.md", bytearray(b"# T\n\nbody")), ("b.xlsx", bytearray(BOOK)), ("c.xlsx", bytearray(b"bad")), ("d.pdf", bytearray(b"%PDF")), ("e.md", bytearray(b"\xff\xfe"))], "path string, content binary")
    rows = {r["path"]: r for r in U.parse_files(files).collect()}
    assert len(rows["a.md"]["units"]) == 2 and len(rows["b.xlsx"]["units"]) == 3
    assert all(rows[p]["error"] and not rows[p]["units"] for p in ("c.xlsx", "d.pdf", "e.md"))
