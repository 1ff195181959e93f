"""Tables of one Markdown or HTML document: where they stand, and their cells.

``scan`` walks a document's lines once, keeps track of headings, fences and table metadata
comments, and yields each table with its lines and section path. Pipe, grid, simple and
multiline tables and ``<table>`` elements are read; a table that can't be read is yielded with
the reason, never dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any

from folioscan.functions.pytext import caption_and_id, collapse_space, escape_pipe_cell, inline_text


Number = int | None
Grid = list[list[str]]
Said = dict[str, Any]


class TableError(ValueError):
    """A table that can't be read without guessing."""


@dataclass
class Diagnostic:
    code: str
    severity: str
    message: str
    row: Number = None
    column: Number = None


def fault(code: str, message: str, **at: int) -> Diagnostic:
    return Diagnostic(f"table.{code}", "error", message, **at)


def warning(code: str, message: str, **at: int) -> Diagnostic:
    return Diagnostic(f"table.{code}", "warning", message, **at)


@dataclass
class Parsed:
    """Cells and what the source says about them."""

    headers: list[str]
    rows: Grid
    alignments: list[str]
    caption: str | None = None
    table_id: str | None = None
    diagnostics: list[Diagnostic] = field(default_factory=list)


@dataclass
class Found:
    """A table's place: lines ``start`` to ``end`` from 1, both inclusive."""

    kind: str  # pipe, grid, simple, html
    start: int
    end: int
    source: str
    section: tuple
    metadata: Said


_HEADING = re.compile(r"(?P<marks>#{1,6})\s+(?P<title>\S.*?)\s*$")
_FENCE = re.compile(r"\s*(~{3,}|`{3,})(.*)$")
_RAW_HTML = re.compile(r"(?i)\s*(?:\{=html\}|@raw\s+html)\s*$")
METADATA = re.compile(r"(?s)<!--\s*[A-Za-z]+-table\s*:\s*(?P<said>\{.*?\})\s*-->")
_CAPTION = re.compile(r"\s*(?:[Tt]able)?:\s+(\S.*)")
_RULE = re.compile(r":?-{3,}:?")
_TAG = re.compile(r"<(/?)table\b[^>]*>", re.I)
_GRID_EDGE = re.compile(r"\s*\+(?:[:=-]+\+)+\s*$")
_DASHES = re.compile(r" {0,3}-{2,}(?: +-{2,})+ *$")
_FULL_DASHES = re.compile(r" {0,3}-{5,} *$")


def pipe_cells(line: str) -> list[str]:
    """The cells of a pipe row; a backslash keeps the next sign, itself going unless the sign needs it as Markdown."""
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    if s.endswith("|") and (len(s) - len(s[:-1].rstrip("\\")) - 1) % 2 == 0:
        s = s[:-1]
    cells, at, i = [], 0, 0
    while i < len(s):
        if s[i] == "\\":
            i += 2
            continue
        if s[i] == "|":
            cells.append(s[at:i])
            at = i + 1
        i += 1
    cells.append(s[at:])
    return [c.strip() for c in cells]


def _alignment(rule: str) -> str:
    return {(True, True): "center", (True, False): "left", (False, True): "right"}.get((rule.startswith(":"), rule.endswith(":")), "default")


def pipe_starts(lines: list[str], i: int) -> bool:
    pair = lines[i : i + 2]
    if len(pair) < 2 or not all("|" in x for x in pair):
        return False
    rules = pipe_cells(pair[1])
    return len(pipe_cells(lines[i])) == len(rules) and all(map(_RULE.fullmatch, rules))


def _caption_after(lines: list[str], at: int) -> int:
    """End of the caption that follows, else ``at``."""
    j = at
    while j < len(lines) and not lines[j].strip():
        j += 1
    return j + 1 if j < len(lines) and _CAPTION.match(lines[j]) else at


def fragments(html: str) -> list[str]:
    """Outermost ``<table>`` elements, byte for byte."""
    out, depth, start = [], 0, 0
    for m in _TAG.finditer(html):
        if not m.group(1):
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(html[start : m.end()])
    return out


def scan(text: str) -> Iterator[Found]:
    """Every table of a document, in order."""
    lines = text.splitlines()
    path: list[str] = []
    waiting: tuple[int, Said] | None = None
    i = 0

    def found(kind: str, end: int, source: str | None = None, metadata: bool = True) -> Found:
        start = waiting[0] if waiting else i
        return Found(kind, start + 1, end, "\n".join(lines[start:end]) if source is None else source, tuple(p for p in path if p), dict(waiting[1]) if waiting and metadata else {})

    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            mark = m.group(1)
            close = next((j for j in range(i + 1, len(lines)) if (c := _FENCE.match(lines[j])) and c.group(1)[0] == mark[0] and len(c.group(1)) >= len(mark) and not c.group(2).strip()), len(lines))
            if _RAW_HTML.match(m.group(2)) and close < len(lines):
                for k, source in enumerate(fragments("\n".join(lines[i + 1 : close]))):
                    yield found("html", close + 1, source, k == 0)
            waiting, i = None, close + 1
            continue
        if m := _HEADING.match(line):
            level = len(m["marks"])
            path = (path + [""] * level)[: level - 1] + [m["title"]]
            waiting, i = None, i + 1
            continue
        if (m := METADATA.fullmatch(line.strip())) is not None:
            try:
                said = json.loads(m.group(1))
            except json.JSONDecodeError:
                said = None
            waiting, i = (i, said if isinstance(said, dict) else {}), i + 1
            continue
        if not line.strip():
            i += 1
            continue
        kind, end = None, i
        if _TAG.search(line):
            depth = 0
            while end < len(lines):
                depth += sum(-1 if m.group(1) else 1 for m in _TAG.finditer(lines[end]))
                end += 1
                if depth <= 0:
                    break
            if depth <= 0:
                for k, source in enumerate(fragments("\n".join(lines[i:end]))):
                    yield found("html", end, source, k == 0)
                waiting, i = None, end
                continue
            end = i
        elif pipe_starts(lines, i):
            kind, end = "pipe", i + 2
            while end < len(lines) and "|" in lines[end] and not lines[end].lstrip().startswith(":"):
                end += 1
        elif _GRID_EDGE.match(line):
            kind, end = "grid", i + 1
            while end < len(lines) and lines[end].lstrip()[:1] in ("+", "|"):
                end += 1
            kind = kind if end > i + 2 and _GRID_EDGE.match(lines[end - 1]) else None
        elif _FULL_DASHES.match(line) or (_DASHES.match(line) and not _FULL_DASHES.match(line)):
            kind, end = _dashed_end(lines, i, headerless=bool(_DASHES.match(line)))
        elif i + 1 < len(lines) and _DASHES.match(lines[i + 1]):
            kind, end = "simple", i + 2
            while end < len(lines) and lines[end].strip():
                end += 1
        if kind:
            end = _caption_after(lines, end)
            yield found(kind, end)
            waiting, i = None, end
            continue
        waiting, i = None, i + 1


def _dashed_end(lines: list[str], i: int, headerless: bool) -> tuple[str | None, int]:
    """A multiline table between full rules, or a simple table without headers between column rules."""
    for j in range(i + 1, len(lines)):
        if _FULL_DASHES.match(lines[j]) or (headerless and _DASHES.match(lines[j])):
            inside = any(_DASHES.match(x) for x in lines[i:j])
            return ("simple", j + 1) if inside and j > i + 1 else (None, i)
        if _HEADING.match(lines[j]):
            break
    return None, i


def _caption_of(lines: list[str]) -> tuple[str | None, str | None]:
    for line in reversed(lines):
        if m := _CAPTION.match(line):
            caption, table_id = caption_and_id(m.group(1))
            return inline_text(caption) or None, table_id
        if line.strip():
            break
    return None, None


def _headed(headers: list[str], width: int, diagnostics: list[Diagnostic]) -> list[str]:
    """Headers without gaps."""
    if not any(headers):
        diagnostics.append(warning("generated-headers", "No usable headers; columns are named by number."))
        return [f"Column {k}" for k in range(1, width + 1)]
    for k, h in enumerate(headers):
        if not h:
            diagnostics.append(warning("empty-header", f"Header {k + 1} is empty; it is named by number.", column=k + 1))
    return [h or f"Column {k}" for k, h in enumerate(headers, 1)]


def read_pipe(source: str) -> Parsed:
    """A pipe table; rows are padded or cut to the header's width, and rows of another width are reported."""
    lines = source.splitlines()
    i = next((k for k in range(len(lines)) if pipe_starts(lines, k)), None)
    if i is None:
        raise TableError("no pipe table in the source")
    d: list[Diagnostic] = []
    raw = pipe_cells(lines[i])
    width, rows, n, j = len(raw), [], 0, i + 2
    while j < len(lines) and "|" in lines[j] and lines[j].strip() and not lines[j].lstrip().startswith(":"):
        n += 1
        cells = pipe_cells(lines[j])
        if len(cells) != width:
            d.append(fault("ragged-row", f"Row has {len(cells)} cell(s) under {width} header(s).", row=n))
        rows.append([inline_text(c) for c in (cells + [""] * width)[:width]])
        j += 1
    caption, table_id = _caption_of(lines[j:])
    return Parsed(_headed([inline_text(c) for c in raw], width, d), rows, [_alignment(c) for c in pipe_cells(lines[i + 1])], caption, table_id, d)


def _grid_cells(lines: list[str], top: int, bottom: int) -> list[tuple[int, int, int, int]]:
    """Boxes (top, left, bottom, right) of the cells of a grid, in order, traced from corner to corner."""
    at = lambda y, x: lines[y][x] if 0 <= y <= bottom and x < len(lines[y]) else " "
    found: list[tuple[int, int, int, int]] = []
    corners = [(top, 0)]
    seen = set()
    while corners:
        corners.sort()
        y, x = corners.pop(0)
        if (y, x) in seen or y >= bottom or at(y, x) != "+":
            continue
        seen.add((y, x))
        box = None
        right = x + 1
        while right < len(lines[y]) and at(y, right) in "-=+:":
            if at(y, right) == "+":
                down = y + 1
                while down <= bottom and at(down, right) in "|+":
                    if at(down, right) == "+" and all(at(down, k) in "-=+:" for k in range(x, right + 1)) and at(down, x) == "+" and all(at(k, x) in "|+" for k in range(y, down + 1)):
                        box = (y, x, down, right)
                        break
                    down += 1
                if box:
                    break
            right += 1
        if box:
            found.append(box)
            corners += [(y, box[3]), (box[2], x)]
    return sorted(found)


def read_grid(source: str) -> Parsed:
    """A grid table; rules of equals signs part headers, body and footers. A cell that spans places repeats its value in each."""
    lines = [x.rstrip() for x in source.splitlines()]
    edges = [k for k, x in enumerate(lines) if _GRID_EDGE.match(x)]
    if len(edges) < 2:
        raise TableError("a grid table needs two rules")
    top, bottom = edges[0], edges[-1]
    indent = len(lines[top]) - len(lines[top].lstrip())
    lines = [x[indent:] for x in lines]
    width = len(lines[top])
    boxes = _grid_cells(lines, top, bottom)
    area = sum((b[2] - b[0]) * (b[3] - b[1]) for b in boxes)
    if not boxes or any(len(lines[k]) != width for k in range(top, bottom + 1)) or area != (bottom - top) * (width - 1):
        raise TableError("the cells of a grid table don't fill it")
    d: list[Diagnostic] = []
    ys, xs = sorted({y for b in boxes for y in (b[0], b[2])}), sorted({x for b in boxes for x in (b[1], b[3])})
    grid = [[""] * (len(xs) - 1) for _ in ys[1:]]
    strong = [k for k in ys[:-1] if k > top and "=" in lines[k] and "-" not in lines[k]]
    for y, x, down, right in boxes:
        text = inline_text(" ".join(filter(None, (lines[k][x + 1 : right].strip() for k in range(y + 1, down)))))
        rows, cols = range(ys.index(y), ys.index(down)), range(xs.index(x), xs.index(right))
        if len(rows) * len(cols) > 1:
            d.append(warning("span-expanded", f"A cell of {len(rows)}x{len(cols)} places repeats its value in each.", row=rows[0] + 1, column=cols[0] + 1))
        for r in rows:
            for c in cols:
                grid[r][c] = text
    closed = "=" in lines[bottom] and "-" not in lines[bottom]
    head = ys.index(strong[0]) if strong and not (closed and len(strong) == 1 and strong[0] != ys[1]) else 0
    foot = ys.index(strong[-1]) if closed and strong and ys.index(strong[-1]) > head else len(grid)
    if foot < len(grid):
        d.append(warning("footer-rows", f"{len(grid) - foot} footer row(s) are kept as the last rows."))
    rule = lines[ys[head]]
    alignments = [_alignment(rule[l + 1 : r]) for l, r in zip(xs, xs[1:])]
    headers = [" / ".join(dict.fromkeys(filter(None, col))) for col in zip(*grid[:head])] if head else [""] * (len(xs) - 1)
    caption, table_id = _caption_of(lines[bottom + 1 :])
    return Parsed(_headed(headers, len(headers), d), grid[head:], alignments, caption, table_id, d)


def read_simple(source: str) -> Parsed:
    """A simple or multiline table: columns stand under runs of dashes; full rules or blank lines part the rows of a multiline one."""
    lines = [x for x in source.splitlines() if not METADATA.fullmatch(x.strip())]
    while lines and not lines[0].strip():
        lines.pop(0)
    rule = next((k for k, x in enumerate(lines) if _DASHES.match(x) and not _FULL_DASHES.match(x)), None)
    if rule is None:
        raise TableError("no rule over columns")
    spans = [m.span() for m in re.finditer("-+", lines[rule])]
    cut = lambda x: [x[a : (spans[k + 1][0] if k + 1 < len(spans) else None)].strip() for k, (a, _) in enumerate(spans)]
    multi = rule > 0 and bool(_FULL_DASHES.match(lines[0])) or any(_FULL_DASHES.match(x) for x in lines[rule + 1 :]) and rule > 1
    top = [x for x in lines[:rule] if not _FULL_DASHES.match(x)]
    end = next((k for k in range(rule + 1, len(lines)) if _FULL_DASHES.match(lines[k]) or _DASHES.match(lines[k])), None)
    if end is None:
        end = next((k for k in range(rule + 1, len(lines)) if _CAPTION.match(lines[k]) or (not multi and not lines[k].strip())), len(lines))
    groups: list[list[str]] = [[]]
    for x in lines[rule + 1 : end]:
        if multi and not x.strip():
            groups.append([])
        elif x.strip():
            groups[-1].append(x) if multi else groups.append([x])
    rows = [[inline_text(" ".join(filter(None, c))) for c in zip(*map(cut, g))] for g in groups if g]
    d: list[Diagnostic] = []
    headers = [inline_text(" ".join(filter(None, c))) for c in zip(*map(cut, top))] if top else [""] * len(spans)
    alignments = []
    for k, (a, b) in enumerate(spans):
        first = top[0] if top else (lines[rule + 1] if rule + 1 < len(lines) else "")
        cell = first[a:b]
        left, right = cell[:1].strip() == "", first[b - 1 : b].strip() == ""
        alignments.append({(True, True): "center", (False, True): "left", (True, False): "right"}.get((left, right), "default"))
    caption, table_id = _caption_of(lines[end:])
    return Parsed(_headed(headers, len(spans), d), rows, alignments, caption, table_id, d)


@dataclass
class _Cell:
    head: bool
    rows: int
    cols: int
    text: str


_PLAIN_TAG = re.compile(r"<(/?)(t[dhr]|thead|tbody|tfoot)>")


class _Reader(HTMLParser):
    """Rows of the outermost table, in which cells, and whether under thead."""

    _SKIP = frozenset(("script", "style"))
    _LISTS = frozenset(("ul", "ol", "li"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth = self.tables = 0
        self.nested = self.in_head = False
        self.rows: list[tuple[bool, list[_Cell]]] = []
        self.caption: str | None = None
        self.table_id: str | None = None
        self.stack: list[tuple[str, dict, list[str]]] = []
        self.skip = 0

    def updatepos(self, i: int, j: int) -> int:
        """Nobody asks for lines."""
        return j

    def parse_starttag(self, i: int) -> int:
        """Most tags of a table are bare; they go the short way."""
        m = None if self.cdata_elem else _PLAIN_TAG.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        self.handle_starttag(m[2], [])
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = None if self.cdata_elem else _PLAIN_TAG.match(self.rawdata, i)
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[2])
        return m.end()

    def _close_to(self, names: set[str]) -> None:
        while any(n in names for n, _, _ in self.stack):
            self._pop()

    def _pop(self) -> None:
        name, attrs, parts = self.stack.pop()
        got = collapse_space(("; " if name in self._LISTS else " ").join(x for x in parts if x))
        if name == "a":
            href = (attrs.get("href") or "").strip()
            got = f"{got} ({href})" if href else got
        elif name == "code":
            got = f"`{got}`"
        if name in ("td", "th"):
            if not self.rows:
                self.rows.append((self.in_head, []))
            self.rows[-1][1].append(_Cell(name == "th", self._span(attrs, "rowspan"), self._span(attrs, "colspan"), got))
        elif name == "caption":
            self.caption = got or None
        elif self.stack:
            self.stack[-1][2].append(got)

    @staticmethod
    def _span(attrs: dict, name: str) -> int:
        if name not in attrs:
            return 1
        value = (attrs.get(name) or "1").strip()
        return max(1, int(value)) if re.fullmatch(r"[+-]?\d{1,6}", value) else 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables += 1
                named = (a.get("id") or "").strip()
                self.table_id = named or None
            else:
                self.nested = True
                if self.stack and self.depth == 2:
                    self.stack[-1][2].append("[nested table omitted]")
            return
        if self.depth != 1:
            return
        if tag in self._SKIP:
            self.skip += 1
        elif tag == "thead":
            self.in_head = True
        elif tag in ("tbody", "tfoot"):
            self._close_to({"td", "th"})
            self.in_head = False
        elif tag == "tr":
            self._close_to({"td", "th"})
            self.rows.append((self.in_head, []))
        elif tag in ("td", "th"):
            self._close_to({"td", "th"})
            self.stack.append((tag, a, []))
        elif tag == "caption":
            self.stack.append((tag, a, []))
        elif self.stack and tag == "img":
            alt, src = [(a.get(k) or other).strip() for k, other in (("alt", "image"), ("src", ""))]
            self.stack[-1][2].append(f"{alt} ({src})" if src else alt)
        elif self.stack and tag not in ("br", "hr", "wbr", "input", "col", "meta", "link"):
            self.stack.append((tag, a, []))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack and self.stack[-1][0] == tag and tag not in ("td", "th", "caption"):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            if self.depth == 1:
                self._close_to({"td", "th", "caption"})
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1:
            if tag in self._SKIP:
                self.skip = max(0, self.skip - 1)
            elif tag == "thead":
                self._close_to({"td", "th"})
                self.in_head = False
            elif tag == "tr":
                self._close_to({"td", "th"})
            elif any(n == tag for n, _, _ in self.stack):
                while self.stack[-1][0] != tag:
                    self._pop()
                self._pop()

    def handle_data(self, data: str) -> None:
        if self.depth == 1 and self.stack and not self.skip:
            self.stack[-1][2].append(collapse_space(data))


def read_html(source: str) -> Parsed:
    """One ``<table>``: spans repeat their value in every place they cover; headers are thead, else the leading rows of th alone."""
    r = _Reader()
    r.feed(source)
    r.close()
    if r.tables != 1:
        raise TableError(f"one table is wanted; the source has {r.tables}")
    if not r.rows:
        raise TableError("the table has no rows")
    d: list[Diagnostic] = []
    if r.nested:
        d.append(fault("unsupported-nested-table", "A table inside a cell isn't flattened."))
    width = max(sum(c.cols for c in cells) for _, cells in r.rows)
    grid: list[list[str]] = []
    hanging: dict[int, tuple[int, str]] = {}
    for n, (_, cells) in enumerate(r.rows, 1):
        row: list[str | None] = [None] * width
        for k, (left, text) in list(hanging.items()):
            row[k] = text
            hanging[k] = (left - 1, text)
            if left == 1:
                del hanging[k]
        at = 0
        for c in cells:
            while at < width and row[at] is not None:
                at += 1
            if at == width:
                d.append(fault("extra-cell", "The row has more cells than there are columns.", row=n))
                break
            if c.rows > 1 or c.cols > 1:
                d.append(warning("span-expanded", f"A cell of {c.rows}x{c.cols} places repeats its value in each.", row=n, column=at + 1))
            if at + c.cols > width:
                d.append(fault("span-overflow", "The span leaves the table.", row=n, column=at + 1))
            for k in range(at, min(width, at + c.cols)):
                row[k] = c.text
                if c.rows > 1:
                    hanging[k] = (c.rows - 1, c.text)
            at += c.cols
        grid.append([x or "" for x in row])
    if hanging:
        d.append(fault("rowspan-overflow", "A span reaches below the last row."))
    heads = [k for k, (head, _) in enumerate(r.rows) if head]
    if not heads:
        while len(heads) < len(r.rows) and (cells := r.rows[len(heads)][1]) and all(c.head for c in cells):
            heads.append(len(heads))
    if heads:
        headers = [" / ".join(dict.fromkeys(filter(None, col))) or f"Column {k}" for k, col in enumerate(zip(*[grid[k] for k in heads]), 1)]
    else:
        headers = [f"Column {k}" for k in range(1, width + 1)]
        d.append(warning("generated-headers", "No complete header row; columns are named by number."))
    return Parsed(headers, [x for k, x in enumerate(grid) if k not in heads], ["default"] * width, r.caption, r.table_id, d)


READERS = {"pipe": read_pipe, "grid": read_grid, "simple": read_simple, "html": read_html}


def html_to_pipe(p: Parsed) -> str:
    """An HTML table, as read, as a pipe table."""
    row = lambda cells: "| " + " | ".join(map(escape_pipe_cell, cells)) + " |"
    out = [row(p.headers), row(["---"] * len(p.headers)), *map(row, p.rows)]
    if p.caption:
        out += ["", f": {p.caption}" + (f" {{#{p.table_id}}}" if p.table_id else "")]
    return "\n".join(out)
