"""Table normalisation: each table of a document in one canonical form, with text, ids, hashes and findings.

A document's tables depend on its lines alone, so documents are spread over the tasks and nothing is
shuffled; the work inside a document is Python over Arrow batches. ``documents_tables`` gives a
row per table, ``table_rows`` a row per record.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import pytext as P
from folioscan.sources import doctables as D
from folioscan.sources.doctables import Diagnostic, Parsed, TableError, fault, warning

VERSION = "tables-1"
MEMORY = "<memory>"
Maybe = str | None
Names = Sequence[str]
Words = Mapping[str, str]
_CLAUSE = re.compile(r"(?i)([^,]+?)\s+(asc|desc)ending\b")
_ISO = re.compile(r"(?:\d\d){2}(?:-\d\d){2}(?:[ T].*|)$")


@dataclass
class Context:
    """What the caller knows about a table; it goes before what the source says."""

    document_path: str = MEMORY
    section_path: Names = ()
    source_code_path: Maybe = None
    table_id: Maybe = None
    caption: Maybe = None
    ordering: Maybe = None
    metadata: Mapping = field(default_factory=dict)


@dataclass
class Table:
    """A normalised table."""

    table_id: str
    caption: str | None
    section_path: list[str]
    headers: list[str]
    rows: list[list[str]]
    source_format: str
    raw_source: str
    canonical_markdown: str
    normalised_text: str
    row_ids: list[str]
    row_records: list[str]
    diagnostics: list[Diagnostic]
    supported: bool
    source_hash: str
    document_path: str
    source_code_path: str | None
    start_line: int | None = None
    end_line: int | None = None
    metadata: str = "{}"
    version: str = VERSION

    @property
    def has_errors(self) -> bool:
        return "error" in {d.severity for d in self.diagnostics}

    def to_dict(self) -> dict:
        return asdict(self) | {"metadata": json.loads(self.metadata)}

    def to_json(self, indent=2) -> str:
        said = self.to_dict()
        return json.dumps(said, sort_keys=True, indent=indent, ensure_ascii=False)


def _ordinal(headers: Names) -> int | None:
    return next((k for k, h in enumerate(headers) if P.normalise_label(h) in P.ORDINALS), None)


def _identity_columns(headers: Names, identity: Names) -> list[int | None]:
    if not identity:
        return []
    place = {P.normalise_label(h): k for k, h in enumerate(headers)}
    return [place.get(P.normalise_label(c)) for c in identity]


def row_id(table_id: str, headers: Names, row: Names, identity: Names) -> str:
    """Hash of the identity columns where the table has them all, else of the whole row."""
    at = _identity_columns(headers, identity)
    if at and None not in at:
        what = {"identity": [[headers[k], row[k]] for k in at]}
    else:
        what = {"row": [list(x) for x in zip(headers, row)]}
    return f"{table_id}:row-{P.digest(what, 16)}"


def derived_id(caption: str | None, section: Names, document: str, headers: Names) -> str:
    """An id that doesn't depend on the values."""
    title = caption or (section[-1] if section else "table")
    return f"{P.slug(title)}-{P.digest({'document': document, 'section': list(section), 'headers': list(headers)}, 8)}"


def sort_value(s: str) -> tuple[int, Any]:
    """Numbers, then dates (naive ones as UTC), then text without regard to case."""
    s = s.strip()
    if _ISO.match(s):
        try:
            at = datetime.fromisoformat(s)
            return 1, (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()
        except ValueError:
            try:
                return 1, float(date.fromisoformat(s[:10]).toordinal())
            except ValueError:
                pass
    n = P.number(s)
    return (0, n) if n is not None else (2, s.casefold())


def _best_header(phrase: str, headers: Names) -> int | None:
    want = P.normalise_label(phrase)
    words = set(want.split()).difference("by sort sorted ordered".split())
    scores = []
    for h in headers:
        have = P.normalise_label(h)
        scores.append(len(words & set(have.split())) + 10 * (have in want or want in have))
    best = max(scores, default=0)
    return scores.index(best) if best else None


def check_ordering(headers: Names, rows: Sequence[Names], ordering: str) -> Diagnostic | None:
    """Whether stable sorting by the declared clauses would move a row; missing values come last either way."""
    clauses = [(k, way.lower() == "desc") for phrase, way in _CLAUSE.findall(ordering.replace(" then ", ", ")) if (k := _best_header(phrase.strip(), headers)) is not None]
    if not clauses:
        return Diagnostic("table.ordering-unchecked", "info", f'No column fits the declared ordering "{ordering}".')
    order = list(range(len(rows)))
    for k, down in reversed(clauses):
        there = [i for i in order if not P.is_missing(rows[i][k])]
        order = sorted(there, key=lambda i: sort_value(rows[i][k]), reverse=down) + [i for i in order if P.is_missing(rows[i][k])]
    if order != list(range(len(rows))):
        return fault("ordering-mismatch", f'Rows don\'t stand in the declared order "{ordering}".')
    return None


def _unit_findings(headers: Names, raw: Names, rows: Sequence[Names], units: Words) -> Iterator[Diagnostic]:
    key = lambda u: re.sub(r"\s+", "", u).casefold().replace("μ", "µ")
    for k, (h, r) in enumerate(zip(headers, raw)):
        own = P.header_unit(h)
        declared = units.get(r) or units.get(h) or own
        if declared and own and key(declared) != key(own):
            yield warning("header-unit-conflict", f'"{h}" has the unit "{own}" in its header, but "{declared}" is declared.', column=k + 1)
        seen: dict[str, str] = {}
        for n, row in enumerate(rows, 1):
            u = P.cell_unit(row[k])
            if u is None:
                continue
            seen.setdefault(key(u), u)
            if declared and key(u) != key(declared):
                yield warning("unit-conflict", f'A value in "{u}" under "{h}", whose unit is "{declared}".', row=n, column=k + 1)
        if len(seen) > 1:
            yield warning("mixed-units", f'"{h}" mixes the units {", ".join(sorted(seen.values(), key=str.casefold))}.', column=k + 1)


def findings(headers: Names, raw: Names, rows: Sequence[Names], units: Words, identity: Names, ordering: Maybe) -> Iterator[Diagnostic]:
    """Everything that is wrong or odd about a table's content."""
    twice = sorted(h for h, n in Counter(map(P.normalise_label, headers)).items() if n > 1)
    if twice:
        yield fault("duplicate-headers", "Headers that are the same once normalised: " + ", ".join(twice))
    if not rows:
        yield warning("empty-body", "There are no data rows.")
    extra = len(rows) - len(set(map(tuple, rows)))
    if extra:
        yield warning("duplicate-rows", f"{extra} row(s) repeat an earlier one.")
    o = _ordinal(headers)
    if o is not None:
        values = [v for row in rows if (v := row[o].strip())]
        if len(set(values)) < len(values):
            yield fault("duplicate-rank", f'Values of "{headers[o]}" recur.', column=o + 1)
        numbers = [P.number(v) for v in values]
        if None not in numbers and any(a > b for a, b in zip(numbers, numbers[1:])):
            yield warning("nonmonotonic-rank", f'"{headers[o]}" falls somewhere.', column=o + 1)
    at = _identity_columns(headers, identity)
    for name, k in zip(identity, at):
        if k is None:
            yield fault("missing-row-identity-column", f'The row identity names "{name}", which is no column.')
    if at and None not in at:
        first: dict[tuple, int] = {}
        for n, row in enumerate(rows, 1):
            gone = [headers[k] for k in at if P.is_missing(row[k])]
            if gone:
                yield fault("missing-row-identity-value", "The row identity lacks: " + ", ".join(gone), row=n)
                continue
            before = first.setdefault(tuple(row[k].strip() for k in at), n)
            if before != n:
                yield fault("duplicate-row-identity", f"Same identity as row {before}.", row=n)
    yield from _unit_findings(headers, raw, rows, units)
    if ordering and (d := check_ordering(headers, rows, ordering)):
        yield d


def row_sentence(number: int, headers: Names, raw: Names, row: Names, units: Words) -> str:
    """A record in words; the ordinal column names it and isn't repeated."""
    o = _ordinal(headers)
    name = f"Row {number}" if o is None or P.is_missing(row[o]) else f"{headers[o]} {row[o]}"
    parts = []
    for k, (h, r, v) in enumerate(zip(headers, raw, row)):
        if k == o:
            continue
        if P.is_missing(v):
            v = "not available"
        elif (u := units.get(r) or units.get(h)) and u not in h and P.cell_unit(v) is None:
            v = f"{v} {u}"
        parts.append(f"{h}: {v}")
    return P.sentence(f"{name}. {'; '.join(parts)}")


def _text_map(said: Mapping, name: str) -> Words:
    try:
        return {str(k): str(v) for k, v in dict(said.get(name) or {}).items()}
    except (TypeError, ValueError) as e:
        raise TableError(f"{name} must map names to texts") from e


def _text_list(said: Mapping, name: str) -> list:
    v = said.get(name) or []
    if not isinstance(v, (str, list, tuple)):
        raise TableError(f"{name} must list names")
    return [v] if isinstance(v, str) else [*map(str, v)]


def build(parsed: Parsed, source: str, source_format: str, context: Context, metadata: Mapping[str, Any], canonical: str | None = None, lines: tuple[int, int] | None = None) -> Table:
    """The normalised table of parsed cells."""
    labels, units, identity = _text_map(metadata, "labels"), _text_map(metadata, "units"), _text_list(metadata, "row_identity")
    description = metadata.get("description") or None
    ordering = context.ordering or metadata.get("ordering") or None
    raw = list(map(P.collapse_space, parsed.headers))
    headers = [labels.get(h, h) for h in raw]
    rows = [list(map(P.collapse_space, row)) for row in parsed.rows]
    caption = next(filter(None, (context.caption, parsed.caption, description)), None)
    section = list(context.section_path)
    table_id = context.table_id or parsed.table_id or metadata.get("table_id") or derived_id(caption, section, context.document_path, headers)
    found = [*parsed.diagnostics, *findings(headers, raw, rows, units, identity, ordering)]

    title = caption or (section[-1] if section else table_id)
    document = context.document_path if context.document_path != MEMORY else None
    facts = {
        "Table": title, "Table identifier": table_id, "Source document": document, "Executable source": context.source_code_path, "Section": " > ".join(section),
        "Description": None if description == title else description, "Ordering": ordering, "Row identity columns": "; ".join(identity),
    }
    about = [f"{name}: {fact}" for name, fact in facts.items() if fact] + ["Columns: " + "; ".join(headers)]
    said = [row_sentence(n, headers, raw, row, units) for n, row in enumerate(rows, 1)]
    front = " ".join(map(P.sentence, about))

    if canonical is None:
        line = lambda cells: "| " + " | ".join(cells) + " |"
        marks = dict(left=":---", right="---:", center=":---:")
        rules = [marks.get(a, "---") for a, _ in zip([*parsed.alignments, *[""] * len(headers)], headers)]
        shown = [line(map(P.escape_pipe_cell, cells)) for cells in (headers, *rows)]
        below = f"\n\n: {caption} {{#{table_id}}}" if caption else ""
        canonical = "\n".join([shown[0], line(rules), *shown[1:]]) + below
    kept = dict(metadata) | dict(raw_headers=raw, row_identity=identity, units=units, labels=labels)
    kept |= {k: v for k, v in (("ordering", ordering), ("description", description)) if v}
    return Table(
        table_id, caption, section, headers, rows, source_format, source, canonical, "\n\n".join(["\n".join(about), *(said or ["This table contains no data rows."])]),
        [row_id(table_id, headers, row, identity) for row in rows], [f"{front} {s}" for s in said], found, not any(d.severity == "error" and d.code.startswith("table.unsupported") for d in found),
        source_hash(source, context), context.document_path, context.source_code_path, *(lines or (None, None)), metadata=P.canonical_json(kept),
    )


def source_hash(source: str, context: Context) -> str:
    """Of the source and all that the caller said."""
    return P.digest({"source": source, "version": VERSION, "context": asdict(context) | {"section_path": list(context.section_path), "metadata": dict(context.metadata)}})


def _commented(source: str) -> dict[str, Any]:
    m = D.METADATA.search(source)
    if not m:
        return {}
    try:
        said = json.loads(m.group(1))
    except json.JSONDecodeError as e:
        raise TableError(f"table metadata isn't JSON: {e}") from e
    if not isinstance(said, dict):
        raise TableError("table metadata isn't a JSON object")
    return said


def _strictly(table: Table, strict: bool) -> Table:
    if strict and (table.has_errors or not table.supported):
        raise TableError(f"{table.table_id}: " + "; ".join(d.message for d in table.diagnostics if d.severity == "error"))
    return table


def normalise_table(source: str, context: Context | None = None, strict: bool = False, kind: str = "auto", pipe_fallback: bool = False) -> Table:
    """Exactly one table, Markdown or HTML; with ``strict`` an error among the findings raises TableError.

    ``kind`` restricts what is looked for: markdown, html or, as found, auto. With ``pipe_fallback`` a source in which no table is found by
    its surroundings is read as a bare pipe table from its first line that looks like one, and the table says so.
    """
    context = context or Context()
    found = [f for f in D.scan(source) if kind == "auto" or (f.kind == "html") == (kind == "html")]
    if not found and pipe_fallback and kind != "html":
        parsed = D.read_pipe("\n".join(x.strip().strip("`~").strip() if set(x.strip()) <= set("`~") else x.strip() for x in source.splitlines()))
        parsed.diagnostics.append(warning("pipe-fallback", "Read by the reduced reader of pipe tables."))
        return _strictly(build(parsed, source, "markdown", context, _commented(source) | dict(context.metadata)), strict)
    if len(found) != 1:
        raise TableError(f"one table is wanted; the source has {len(found)}")
    f = found[0]
    html = f.kind == "html"
    metadata = ({} if html else _commented(source)) | dict(context.metadata)
    parsed = D.READERS[f.kind](f.source)
    return _strictly(build(parsed, source, "html" if html else "markdown", context, metadata, D.html_to_pipe(parsed) if html else None), strict)


def _failed(f: D.Found, context: Context, error: Exception) -> Table:
    """A table that couldn't be read, kept as raw evidence."""
    ids = re.findall(r"\{#([A-Za-z][\w.:-]*)\}", f.source) if f.kind != "html" else re.findall(r"(?i)<table[^>]*?\sid=[\"']?([A-Za-z][\w.:-]*)", f.source)[:1]
    table_id = f.metadata.get("table_id") or (ids[-1] if ids else f"table-{P.digest([context.document_path, list(f.section), f.start, f.kind], 8)}")
    d = fault("normalisation-failed", f"Kept as raw evidence: {error}")
    return Table(str(table_id), None, list(f.section), [], [], "html" if f.kind == "html" else "markdown", f.source, "", "", [], [], [d], False, source_hash(f.source, context), context.document_path, context.source_code_path, f.start, f.end, P.canonical_json(f.metadata | {"error": str(error)}))


def document_tables(text: str, document_path: str = MEMORY, source_code_path: Maybe = None, strict: bool = False) -> list[Table]:
    """All tables of one document, in order."""
    out: list[Table] = []
    seen: Counter[str] = Counter()
    for f in D.scan(text):
        context = Context(document_path, f.section, source_code_path, metadata=f.metadata | {"source_start_line": f.start, "source_end_line": f.end})
        try:
            html = f.kind == "html"
            metadata = ({} if html else _commented(f.source)) | dict(context.metadata)
            parsed = D.READERS[f.kind](f.source)
            t = build(parsed, f.source, "html" if html else "markdown", context, metadata, D.html_to_pipe(parsed) if html else None, (f.start, f.end))
        except TableError as e:
            if strict:
                raise
            t = _failed(f, context, e)
        seen[t.table_id] += 1
        if seen[t.table_id] > 1:
            t.diagnostics.append(fault("duplicate-id", f'"{t.table_id}" already names a table of this document.'))
        out.append(_strictly(t, strict))
    return out


_DIAGNOSTIC = pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("row", pa.int32()), ("column", pa.int32())])
_STRINGS = pa.list_(pa.string())
_TABLE = pa.struct([
    ("table_id", pa.string()), ("caption", pa.string()), ("section_path", _STRINGS), ("headers", _STRINGS), ("rows", pa.list_(_STRINGS)), ("source_format", pa.string()), ("raw_source", pa.string()),
    ("canonical_markdown", pa.string()), ("normalised_text", pa.string()), ("row_ids", _STRINGS), ("row_records", _STRINGS), ("diagnostics", pa.list_(_DIAGNOSTIC)), ("supported", pa.bool_()), ("source_hash", pa.string()),
    ("document_path", pa.string()), ("source_code_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("metadata", pa.string()), ("version", pa.string()),
])
_KINDS = {f.name: "string" for f in _TABLE} | dict.fromkeys(("section_path", "headers", "row_ids", "row_records"), "array<string>") | {"rows": "array<array<string>>", "supported": "boolean", "start_line": "int", "end_line": "int"}
_KINDS["diagnostics"] = "array<struct<code:string,severity:string,message:string,row:int,column:int>>"
_SQL = f"array<struct<{','.join(f'{n}:{k}' for n, k in _KINDS.items())}>>"


def documents_tables(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, strict: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """(key, table_no, all fields of Table) for every table of every document; ``path`` names the column with document paths.

    A null text has no tables. With ``strict`` a table with errors fails the job. With ``fields`` only these leave Python.
    """
    kind = pa.struct([f for f in _TABLE if fields is None or f.name in fields])
    names = [f.name for f in kind]
    ddl = _SQL if fields is None else f"array<struct<{','.join(f'{n}:{_KINDS[n]}' for n in names)}>>"

    def shallow(t: Table) -> dict:
        said = vars(t)
        return {n: [vars(d) for d in t.diagnostics] if n == "diagnostics" else said[n] for n in names}

    @F.arrow_udf(ddl)
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, texts in parts:
            yield pa.array([[] if t is None else [shallow(x) for x in document_tables(t, p or "<memory>", strict=strict)] for p, t in zip(paths.to_pylist(), texts.to_pylist())], type=pa.list_(kind))

    where = F.col(path).cast("string") if path else F.lit("<memory>")
    return docs.select(key, F.posexplode(run(where, F.col(text))).alias("table_no", "t")).select(key, "table_no", "t.*")


def table_rows(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_id, row, row_id, record, cells) of every record."""
    z = F.posexplode(F.arrays_zip(F.col("row_ids").alias("i"), F.col("row_records").alias("r"), F.col("rows").alias("c")))
    return tables.select(key, "table_id", z.alias("at", "z")).select(key, "table_id", (F.col("at") + 1).alias("row"), F.col("z.i").alias("row_id"), F.col("z.r").alias("record"), F.col("z.c").alias("cells"))


def diagnostic_counts(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_id, errors, warnings, infos) of every table."""
    n = lambda s: F.size(F.filter("diagnostics", lambda d: d["severity"] == s))
    return tables.select(key, "table_id", n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))


_OPEN, _CLOSE = "<!-- table-text:start", "<!-- table-text:end -->"


def text_block(t: Table) -> str:
    """A table's retrieval text as a collapsible block, for people to look at."""
    opening = f'{_OPEN} source-hash="{t.source_hash}" table-id="{t.table_id}" -->'
    name = P.escape_inline(t.caption or (t.section_path or [t.table_id])[-1])
    lines = [opening, '::: {.callout-note title="Retrieval text of this table" collapse="true"}', "", f"**{name}** (`{t.table_id}`)  "]
    if t.section_path:
        lines.append(f"**Section:** {' &gt; '.join(map(P.escape_inline, t.section_path))}  ")
    lines += ["", *(P.fence(t.normalised_text, "text") if t.normalised_text else ["This table could not be read; there is no text."])]
    if t.diagnostics:
        lines += ["", "**Diagnostics**"]
        for d in t.diagnostics:
            at = (f" row {d.row}" if d.row is not None else "") + (f" column {d.column}" if d.column is not None else "")
            lines.append(f"- `{d.severity}:{d.code}`{at}: {P.escape_inline(d.message)}")
    return "\n".join([*lines, "", ":::", _CLOSE])


def without_blocks(text: str) -> str:
    """A document without blocks of ``text_block``."""
    return re.sub(r"\n*^" + re.escape(_OPEN) + r".*?^" + re.escape(_CLOSE) + r"[ \t]*$", "", text, flags=re.S | re.M)


def with_blocks(text: str, document_path: str = "<memory>", strict: bool = False) -> tuple[str, list[Table]]:
    """A document with each table's block under it, and its tables; doing it twice changes nothing."""
    plain = without_blocks(text)
    tables = document_tables(plain, document_path, strict=strict)
    lines = plain.splitlines()
    for t in sorted(tables, key=lambda t: -(t.end_line or len(lines))):
        end = t.end_line or len(lines)
        lines[end:end] = ["", text_block(t)]
    return "\n".join(lines) + ("\n" if plain.endswith("\n") else ""), tables


def inspection(t: Table) -> str:
    """Raw source, canonical table, text and records of one table, as Markdown."""
    parts = (("Source", t.raw_source, "markdown"), ("Canonical", t.canonical_markdown, "markdown"), ("Text", t.normalised_text, "text"))
    out = [f"# `{t.table_id}` of `{t.document_path}`", ""]
    for name, text, language in parts:
        out += [f"## {name}", "", *P.fence(text.rstrip(), language), ""]
    out += ["## Records", ""]
    for n, (i, r) in enumerate(zip(t.row_ids, t.row_records), 1):
        out += [f"### {n}", "", f"Record ID: `{i}`", "", r, ""]
    return "\n".join(out)
