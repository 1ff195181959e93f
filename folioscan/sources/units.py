"""Documents as text units: Markdown by headings and paragraphs, workbooks by rows.

Each file is parsed where its task holds it; a row of ``units`` is a unit of one source.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.sources.manifest import source_type

MAX_UNIT, MAX_ROW_UNIT, MAX_FORMULA = 2400, 1000, 240
#: Bytes of files whose units are Python objects at one time.
HELD = 1 << 20
_HEADING = re.compile(r"(?P<marks>#{1,6})\s+(?P<title>.*)$")
_REF = re.compile(r"([A-Z]{1,3})([1-9]\d*)$")


class WorkbookError(ValueError):
    """Not a workbook that can be read."""


def split_words(text: str, limit: int = MAX_UNIT) -> list[str]:
    """Pieces between single spaces, each with as many words as fit; a longer word stands alone."""
    if len(text) <= limit:
        return [text]
    out: list[list[str]] = [[]]
    used = 0
    for w in text.split(" "):
        if out[-1] and used + len(w) + 1 > limit:
            out.append([])
            used = 0
        out[-1].append(w)
        used += len(w) + 1
    return [" ".join(p) for p in out]


def markdown_units(text: str, limit: int = MAX_UNIT) -> list[dict[str, Any]]:
    """Headings and paragraphs with heading path, lines from 1 and a logical key that tells repeated headings apart.

    Fences aren't looked at: a line in code that looks like a heading is one.
    """
    out: list[dict[str, Any]] = []
    path: list[str] = []
    times: Counter[str] = Counter()
    key, count, held, first = "root#0", 0, [], 0

    def paragraph(end: int) -> None:
        nonlocal count
        body = "\n".join(held).strip()
        held.clear()
        if not body:
            return
        for k, piece in enumerate(split_words(body, limit)):
            out.append({"text": piece, "logical_key": f"{key}:p{count:04d}" + (f":sub{k:02d}" if k else ""), "heading_path": list(path), "content_type": "body", "line_start": first, "line_end": end, "locator": None})
            count += 1

    lines = text.splitlines()
    for n, line in enumerate(lines, 1):
        if m := _HEADING.match(line):
            paragraph(n - 1)
            title = m["title"].strip()
            path = path[: len(m["marks"]) - 1] + [title]
            joined = "/".join(path)
            key, count = f"{joined}#{times[joined]}", 0
            times[joined] += 1
            out.append({"text": title, "logical_key": f"{key}:heading", "heading_path": list(path), "content_type": "heading", "line_start": n, "line_end": n, "locator": None})
        elif not line.strip():
            paragraph(n - 1)
        else:
            first = first if held else n
            held.append(line)
    paragraph(len(lines))
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ET.Element | None) -> str:
    return "" if e is None else "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t")


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e if _local(x.tag) == name), None)


def _sheets(z: zipfile.ZipFile) -> list[tuple[int, str, str, str]]:
    """(index, name, state, part) of every worksheet."""
    try:
        targets = {r.attrib["Id"]: (r.attrib["Target"], r.attrib.get("Type", "/worksheet")) for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    except (KeyError, ET.ParseError) as e:
        raise WorkbookError(f"not a workbook: {e}") from e
    out = []
    for k, s in enumerate(sheets, 1):
        target, kind = targets[next(v for a, v in s.attrib.items() if _local(a) == "id" and a != "id")]
        if not kind.endswith("/worksheet"):
            continue
        part = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target))
        if part.startswith(".."):
            raise WorkbookError(f"a sheet outside the package: {target}")
        out.append((k, s.attrib["name"], s.attrib.get("state", "visible"), part))
    return out


def _shown(c: ET.Element, shared: list[str]) -> str | None:
    """A cell's formula and value as text, or None where it has neither."""
    quoted = lambda s: json.dumps(s, ensure_ascii=False)
    kind, v, f = c.attrib.get("t"), _child(c, "v"), _child(c, "f")
    raw = (v.text or "") if v is not None else ""
    if kind == "inlineStr":
        raw = _text(_child(c, "is"))
    elif kind == "s" and raw:
        if not raw.isdigit() or int(raw) >= len(shared):
            raise WorkbookError(f"no shared string {raw}")
        raw = shared[int(raw)]
    elif kind == "b":
        raw = "TRUE" if raw == "1" else "FALSE"
    elif kind == "e":
        raw = f"#ERROR {raw}"
    value = quoted(raw) if kind in ("inlineStr", "s", "e", "str", "d") else raw
    if f is None or f.text is None:
        return value if raw else None
    formula = f.text if len(f.text) <= MAX_FORMULA else f"{f.text[:MAX_FORMULA]}… [truncated; {len(f.text)} characters]"
    return f"FORMULA {quoted('=' + formula)}" + (f"; cached = {value}" if raw else "")


def workbook_units(content: bytes, limit: int = MAX_ROW_UNIT) -> list[dict[str, Any]]:
    """The rows of every worksheet that hold anything, in pieces of cells that fit the limit; cells with style alone are left out."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"not a workbook: {e}") from e
    out: list[dict[str, Any]] = []
    with z:
        shared = [_text(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        for index, name, state, part in _sheets(z):
            nth = 0
            with z.open(part) as f:
                for _, row in ET.iterparse(f):
                    if _local(row.tag) != "row":
                        continue
                    nth += 1
                    cells = [(c.attrib["r"], s) for c in row if _local(c.tag) == "c" and _REF.match(c.attrib.get("r", "")) and (s := _shown(c, shared)) is not None]
                    declared = row.attrib.get("r", "")
                    row.clear()
                    if not cells:
                        continue
                    n = int(declared) if declared.isdigit() else int(_REF.match(cells[0][0]).group(2))
                    title = lambda p: f"Worksheet {json.dumps(name, ensure_ascii=False)}, row {n}, cells {p[0][0] if len(p) == 1 else p[0][0] + ':' + p[-1][0]}\n" + "\n".join(f"{r} = {s}" for r, s in p)  # noqa: B023, E731
                    pieces: list[list[tuple[str, str]]] = [[]]
                    for c in cells:
                        if pieces[-1] and len(title([*pieces[-1], c])) > limit:
                            pieces.append([])
                        pieces[-1].append(c)
                    for k, p in enumerate(pieces, 1):
                        a, b = p[0][0], p[-1][0]
                        locator = {"kind": "workbook-cells", "sheet": name, "sheet_index": index, "sheet_state": state, "range": a if a == b else f"{a}:{b}", "start_cell": a, "end_cell": b, "row_start": n, "row_end": n}
                        out.append({"text": title(p), "logical_key": f"sheet{index}:row{n}" + (f":part{k:02d}" if len(pieces) > 1 else ""), "heading_path": [name], "content_type": "workbook-row", "line_start": None, "line_end": None, "locator": json.dumps(locator, ensure_ascii=False)})
    return out


_UNIT = pa.struct([("text", pa.string()), ("logical_key", pa.string()), ("heading_path", pa.list_(pa.string())), ("content_type", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("locator", pa.string())])
_UNIT_SQL = "struct<error:string,units:array<struct<text:string,logical_key:string,heading_path:array<string>,content_type:string,line_start:int,line_end:int,locator:string>>>"

#: Parsers by source type; each takes a file's bytes and gives its units. Further ones can be added.
PARSERS = {"markdown": lambda b: markdown_units(b.decode("utf-8")), "workbook": workbook_units}


def parse_files(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """(path, source_type, sha256, error, units and further columns) of (path, content and further columns); what has no parser or can't be read has an error and no units."""
    further = [c for c in files.columns if c not in ("path", "content")]
    chosen = PARSERS if parsers is None else parsers
    parsed = pa.struct([("error", pa.string()), ("units", pa.list_(_UNIT))])

    @F.arrow_udf(_UNIT_SQL)
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, contents in parts:
            done, out, size = [], [], 0
            for kind, content in zip(kinds, contents):
                try:
                    if (kind := kind.as_py()) not in chosen:
                        raise ValueError(f"no parser for {kind}")
                    out.append({"error": None, "units": chosen[kind](content := content.as_py())})
                    size += len(content)
                except Exception as e:  # whatever one damaged file raises (zlib, zipfile, encryption, ...) must not end the job
                    out.append({"error": f"{type(e).__name__}: {e}", "units": []})
                if size > HELD:
                    done.append(pa.array(out, type=parsed))
                    out, size = [], 0
            yield pa.concat_arrays([*done, pa.array(out, type=parsed)])

    kind = F.when(F.lower("path").rlike("\\.(md|markdown|qmd)$"), "markdown").when(F.lower("path").rlike("\\.xls[xm]$"), "workbook").when(F.lower("path").rlike("\\.pdf$"), "pdf").otherwise("unknown")
    return files.select("path", *further, kind.alias("source_type"), F.sha2("content", 256).alias("sha256"), run(kind, F.col("content")).alias("p")).select("path", "source_type", "sha256", "p.error", "p.units", *further)


def page_texts() -> Column:
    """The pages of a file (path, content) as an array of (page, text): a Markdown file is one page, its whole text; what isn't UTF-8 has none. Workbooks have no pages."""
    text = F.when(F.lower("path").rlike("\\.(md|markdown|qmd)$"), F.expr("try_validate_utf8(cast(content as string))"))
    return F.filter(F.array(F.struct(F.lit(1).alias("page"), text.alias("text"))), lambda p: p["text"].isNotNull())


def pages_of(files: DataFrame) -> DataFrame:
    """(path, page, text) of files (path, content)."""
    return files.select("path", F.explode(page_texts()).alias("p")).select("path", "p.page", "p.text")


def units_of(parsed: DataFrame) -> DataFrame:
    """(path, source_type, ordinal, line, text and the other fields of a unit) of ``parse_files``."""
    u = parsed.select("path", "source_type", F.posexplode("units").alias("ordinal", "u"))
    return u.select("path", "source_type", "ordinal", F.col("u.line_start").alias("line"), "u.*")


__all__ = ["MAX_UNIT", "PARSERS", "WorkbookError", "markdown_units", "page_texts", "pages_of", "parse_files", "source_type", "split_words", "units_of", "workbook_units"]
