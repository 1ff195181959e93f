"""Command line: ``python -m folioscan.cli COMMAND``. Exit codes: 0 all well, 1 findings or nothing found, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from folioscan.operators.normalise import Context, document_tables, inspection, normalise_table, with_blocks
from folioscan.sources.doctables import TableError


def _spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _print(value) -> None:
    print(json.dumps(value, ensure_ascii=False, default=str))


def _table(a) -> int:
    text = Path(a.input).read_text(encoding="utf-8")
    context = Context(a.document_path or a.input, tuple(a.section or ()), None, a.table_id, a.caption, a.ordering)
    try:
        t = normalise_table(text, context, a.strict, a.kind, a.allow_pipe_fallback)
    except TableError as e:
        print(e, file=sys.stderr)
        return 1
    print({"text": lambda: t.normalised_text, "json": t.to_json, "canonical-markdown": lambda: t.canonical_markdown, "debug-markdown": lambda: inspection(t)}[a.to]())
    return 0


def _document(a) -> int:
    text = Path(a.input).read_text(encoding="utf-8")
    try:
        if a.to == "embedding-markdown":
            sys.stdout.write(with_blocks(text, a.input, a.strict)[0])
            return 0
        tables = document_tables(text, a.input, strict=a.strict)
    except TableError as e:
        print(e, file=sys.stderr)
        return 1
    for t in tables:
        if a.to == "jsonl":
            print(t.to_json(indent=None))
        else:
            n = {s: sum(d.severity == s for d in t.diagnostics) for s in ("error", "warning", "info")}
            print(f"{t.table_id}\t{len(t.rows)} rows\t{n['error']} errors\t{n['warning']} warnings")
    return 0


def _check(a) -> int:
    root = Path(a.path)
    if root.is_file():
        found = [(str(root), t.table_id, d.code, d.message) for t in document_tables(root.read_text(encoding="utf-8"), str(root)) for d in t.diagnostics if d.severity == "error"]
    else:  # a tree is read by the tasks that hold its files
        from pyspark.sql import functions as F

        from folioscan.operators.normalise import documents_tables

        files = _spark().read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).filter(F.lower("path").rlike("\\.(md|markdown|qmd|html)$"))
        tables = documents_tables(files.select("path", F.col("content").cast("string").alias("text")), "path", path="path")
        rows = tables.select("path", "table_id", F.explode("diagnostics").alias("d")).filter("d.severity = 'error'").select("path", "table_id", "d.code", "d.message").orderBy("path", "table_id", "code")
        found = [tuple(r) for r in rows.toLocalIterator()]
    for f in found:
        print("{}: {}: {}: {}".format(*f))
    return int(bool(found))


def _store(a, create: bool = False):
    from folioscan.operators.store import Store

    return Store(_spark(), a.store, create)


def _rules(a):
    from folioscan.sources import manifest

    return manifest.merge([manifest.load(m) for m in a.manifest])


def _sync(a) -> int:
    from folioscan.operators.store import Options
    from folioscan.sources import manifest

    s = _store(a, True)
    files = manifest.discover(s.spark, a.root, _rules(a)).select("path", "content")
    r = s.sync(files, Options(a.max_chunk_chars, full=a.full, reembed=a.reembed))
    _print(r.to_dict())
    return int(r.failed > 0)


def _search(a) -> int:
    from folioscan.operators.search import search

    rows = search(_store(a), a.query, a.limit, a.lexical_limit, a.vector_limit, a.source_type).toJSON().collect()  # at most ``limit`` rows
    print("\n".join(rows))
    return 0


def _prune(a) -> int:
    from pyspark.sql import functions as F

    s, rules = _store(a), _rules(a)
    if not (rules.explicit or rules.include):
        print("a rule that selects something is needed", file=sys.stderr)
        return 2
    keep = rules.column(F.col("path"))
    if a.apply:
        _print({"pruned": s.prune(keep)})
    else:
        for r in s.prune_plan(keep).orderBy("path").toLocalIterator():
            print(r["path"])
    return 0


def _doctor(a) -> int:
    n = 0
    for r in _store(a).doctor().orderBy("issue", "key").toLocalIterator():
        n += 1
        print(f"{r['issue']}\t{r['key']}")
    return int(n > 0)


def _compact(a) -> int:
    s = _store(a)
    _print(s.compact())
    if a.vacuum:
        s.vacuum()
    return 0


def _verify(a) -> int:
    from folioscan.operators.report import verify_reports

    s = _store(a)
    text = Path(a.file).read_text(encoding="utf-8")
    reports = s.spark.createDataFrame([(a.report_path or a.file, text)], "report string, text string")
    pages = s.spark.read.parquet(a.pages)
    issues, quotes = verify_reports(reports, pages)
    i, q = [r.asDict() for r in issues.collect()], [r.asDict() for r in quotes.collect()]  # of one report
    _print({"issues": i, "quotes": q})
    return int(bool(i) or any(x["status"] not in ("exact", "normalised") for x in q))


def _source(a, s):
    """(path, source type) of a source of the store, or None."""
    from pyspark.sql import functions as F

    from folioscan.sources.manifest import ManifestError, relative

    try:
        path = relative(a.source)
    except ManifestError as e:
        print(json.dumps({"error": "path-error", "detail": str(e)}), file=sys.stderr)
        raise SystemExit(2) from e
    row = s.sources().filter(F.col("path") == path).select("path", "source_type").first()
    return path, None if row is None else row["source_type"]


def _page(a) -> int:
    from pyspark.sql import functions as F

    from folioscan.operators.pages import PageSelectionSyntaxError, PageSelectionUnavailableError, parse_selector, resolve
    from folioscan.operators.pageview import page_rows, page_text

    s = _store(a)
    path, kind = _source(a, s)
    if kind == "workbook":
        print(f"{path} has no pages", file=sys.stderr)
        return 2
    pages = s.pages().filter(F.col("path") == path).select("path", "page", "text")
    try:
        wanted = resolve(a.pages, [r["page"] for r in pages.select("page").collect()])  # of one source
    except PageSelectionSyntaxError as e:
        print(e, file=sys.stderr)
        return 2
    except PageSelectionUnavailableError as e:
        print(f"not found: {path} page {e.page}", file=sys.stderr)
        return 1
    if a.format == "json":
        rows = page_rows(pages.filter(F.col("page").isin(wanted)), s.sources()).orderBy("physical_page")
        _print([r.asDict(recursive=True) for r in rows.collect()])
    else:
        print(page_text(pages, parse_selector(a.pages)).first()["text"])
    return 0


def _quote(a) -> int:
    from pyspark.sql import functions as F

    from folioscan.operators.evidence import verify_quotes

    s = _store(a)
    path, _ = _source(a, s)
    quote = s.spark.createDataFrame([(0, path, a.page, a.quote)], "quote_id int, source string, page int, quote string")
    pages = s.pages().filter(F.col("path") == path).selectExpr("path as source", "page", "text")
    status = verify_quotes(quote, pages).first()["status"]
    _print({"status": status, "page": a.page, "quote": a.quote, "source_path": path})
    return int(status not in ("exact", "normalised"))


def _diagnose(a) -> int:
    from folioscan.operators import maintenance as M

    s = _store(a)
    tables = {"chunks": s.chunks(), "sources": s.sources(), "pages": s.pages(), "postings": s.postings(), "embeddings": s.embeddings()}
    counts = {r["name"]: r["n_rows"] for r in M.row_counts(tables).collect()}
    sizes = {r["name"]: r["n_chars"] for r in M.text_sizes({"chunks": (tables["chunks"], "body"), "pages": (tables["pages"], "text")}).collect()}
    _print({"version": s.state["version"], "rows": counts, "characters": sizes})
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscan", description=__doc__)
    c = p.add_subparsers(dest="command", required=True)
    t = c.add_parser("table", help="normalise exactly one table")
    t.add_argument("input")
    t.add_argument("--to", default="text", choices="text json canonical-markdown debug-markdown".split())
    for name in ("document-path", "table-id", "caption", "ordering"):
        t.add_argument(f"--{name}")
    t.add_argument("--section", action="append")
    t.add_argument("--strict", action="store_true")
    t.add_argument("--from", dest="kind", default="auto", choices="auto markdown html".split())
    t.add_argument("--allow-pipe-fallback", action="store_true")
    t.set_defaults(run=_table)
    d = c.add_parser("document", help="normalise every table of a document")
    d.add_argument("input")
    d.add_argument("--to", default="summary", choices="summary jsonl embedding-markdown".split())
    d.add_argument("--strict", action="store_true")
    d.set_defaults(run=_document)
    k = c.add_parser("check", help="report tables with errors in a file or tree")
    k.add_argument("path")
    k.set_defaults(run=_check)
    for name, run, about in (("sync", _sync, "bring a store up to its files"), ("search", _search, "hybrid search"), ("prune", _prune, "list or drop sources that no rule selects"), ("doctor", _doctor, "list what is wrong"), ("compact", _compact, "rewrite live rows"), ("verify", _verify, "check a report's citations and quotes"), ("page", _page, "pages of a source"), ("quote", _quote, "check a quote on a page"), ("diagnose", _diagnose, "counts and sizes of a store")):
        s = c.add_parser(name, help=about)
        s.add_argument("--store", required=True)
        s.set_defaults(run=run)
        if name in ("sync", "prune"):
            s.add_argument("--manifest", action="append", required=True)
        if name == "sync":
            s.add_argument("--root", required=True)
            s.add_argument("--max-chunk-chars", default=1200, type=int)
            s.add_argument("--full", action="store_true")
            s.add_argument("--reembed", action="store_true")
        elif name == "search":
            s.add_argument("query")
            for option, depth in (("--limit", 10), ("--lexical-limit", 50), ("--vector-limit", 50)):
                s.add_argument(option, default=depth, type=int)
            s.add_argument("--source-type", action="append")
        elif name == "prune":
            s.add_argument("--apply", action="store_true")
        elif name == "page":
            s.add_argument("source")
            s.add_argument("pages", nargs="?")
            s.add_argument("--format", default="text", choices=("text", "json"))
        elif name == "quote":
            s.add_argument("source")
            s.add_argument("page", type=int)
            s.add_argument("quote")
        elif name == "compact":
            s.add_argument("--vacuum", action="store_true")
        elif name == "verify":
            s.add_argument("file")
            s.add_argument("--pages", required=True)
            s.add_argument("--report-path")
    return p


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
