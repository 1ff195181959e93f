"""Reports that cite pages: their definitions, citations and quotes, and whether they hold.

A report's lines are read in Python where its task holds them (fences, comments and inline code
aren't prose; a quote belongs to the citation of its paragraph); what they claim is then checked
against indexed sources and pages by joins.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as X

_DEFINITION = re.compile(r" {0,3}\[(?P<key>[^\]\[^][^\]]*)\]:[ \t]*(?:(?P<bare>[^<\s]\S*)|<(?P<angle>[^<>]+)>)\s*$")
_DESTINATION = re.compile(r"(?P<path>[^#]+)#page=(?P<page>\d+)$")
_CITATION = re.compile(r"\[[^\]\[]+\]\[(?P<key>[^\]\[]+)\]")
_QUOTE = re.compile(r" {0,3}> ?(?P<said>.*)")
_BREAK = re.compile(r" {0,3}(?:#{1,6}\s|(?:[-*_]\s*){3,}$|[-+*]\s+|\d+[.)]\s+)")
_FENCE = re.compile(r" {0,3}(~{3,}|`{3,})")


@dataclass
class Claims:
    """What one report says."""

    definitions: list[tuple[str, str | None, int | None]] = field(default_factory=list)  # key, path, page; neither where malformed
    citations: set[str] = field(default_factory=set)
    quotes: list[tuple[int, str, list[str]]] = field(default_factory=list)  # number, text, keys of the paragraph


def prose(lines: Sequence[str]) -> list:
    """Lines with everything that isn't prose blanked: fenced and indented code, comments, inline code."""
    out, fence, comment, after_blank = [], None, False, True
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                fence = None
            out.append("")
            continue
        if m and not comment:
            fence = m.group(1)
            out.append("")
            continue
        kept = ""
        while line:
            if comment:
                _, end, line = line.partition("-->")
                comment = not end
            else:
                before, start, line = line.partition("<!--")
                kept += before
                comment = bool(start)
        if after_blank and re.match(r"(?: {4}|\t)", kept):
            out.append("")
            continue
        after_blank = not kept.strip()
        out.append(re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", lambda m: " " * len(m.group()), kept))
    return out


def claims(text: str, report_path: str = "") -> Claims:
    """Definitions, citations and quotes of one report; paths are taken from the report's folder."""
    c = Claims()
    lines = prose(text.splitlines())
    base = posixpath.dirname(report_path)
    keys: list[str] = []
    pending, i = False, 0
    while i < len(lines):
        line = lines[i]
        if m := _DEFINITION.match(line):
            d = _DESTINATION.match(m["angle"] or m["bare"])
            if d:
                c.definitions.append((m["key"], posixpath.normpath(posixpath.join(base, d["path"].replace("\\", "/"))), int(d["page"])))
            elif "#page" in line or ".pdf" in line:
                c.definitions.append((m["key"], None, None))
            i += 1
            continue
        if _QUOTE.match(line):
            parts = []
            while i < len(lines) and (q := _QUOTE.match(lines[i])):
                parts.append(q["said"])
                i += 1
            quote = "\n".join(parts).strip()
            c.quotes.append((len(c.quotes) + 1, quote.removeprefix('"').removesuffix('"'), list(dict.fromkeys(keys))))
            continue
        i += 1
        if not line.strip():
            pending = True
            continue
        own = [m["key"] for m in _CITATION.finditer(line)]
        c.citations.update(own)
        if _BREAK.match(line):
            keys = []
        elif pending:
            keys = own
        else:
            keys = keys + own
        pending = False
    return c


_CLAIMS = pa.struct([
    ("definitions", pa.list_(pa.struct([("key", pa.string()), ("path", pa.string()), ("page", pa.int64())]))), ("citations", pa.list_(pa.string())),
    ("quotes", pa.list_(pa.struct([("n", pa.int32()), ("quote", pa.string()), ("keys", pa.list_(pa.string()))]))),
])


def read_claims(reports: DataFrame) -> DataFrame:
    """(report, definitions, citations, quotes) of reports (report, text)."""

    @F.arrow_udf("struct<definitions:array<struct<key:string,path:string,page:bigint>>,citations:array<string>,quotes:array<struct<n:int,quote:string,keys:array<string>>>>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, texts in parts:
            out = []
            for name, text in zip(names.to_pylist(), texts.to_pylist()):
                c = claims(text or "", str(name))
                out.append({"definitions": [{"key": k, "path": p, "page": n} for k, p, n in c.definitions], "citations": sorted(c.citations), "quotes": [{"n": n, "quote": q, "keys": k} for n, q, k in c.quotes]})
            yield pa.array(out, type=_CLAIMS)

    return reports.select("report", run(F.col("report").cast("string"), F.col("text")).alias("c")).select("report", "c.*")


def verify_reports(reports: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, quotes) of reports (report, text) against indexed pages (path, page, text).

    issues: (report, key, issue) with missing-definition, duplicate-definition, ambiguous-definition,
    malformed-page, bad-page, path-outside-root, unindexed-path or page-not-indexed.
    quotes: (report, n, quote, key, path, page, status) with exact, normalised, not-found or, where
    the paragraph doesn't cite exactly one indexed page, structural-error.
    """
    c = read_claims(reports)
    d = c.select("report", F.explode("definitions").alias("d")).select("report", "d.key", "d.path", "d.page")
    one = d.groupBy("report", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").isNull()).alias("bad"), F.count_distinct(F.struct("path", "page")).alias("different"), F.first("path", ignorenulls=True).alias("path"), F.first("page", ignorenulls=True).alias("page"),
    )
    said = F.when(F.col("bad") > 0, "malformed-page").when((F.col("n") > 1) & (F.col("different") > 1), "ambiguous-definition").when(F.col("n") > 1, "duplicate-definition")
    own = one.select("report", "key", said.alias("issue")).filter("issue is not null")
    have_path, have_page = pages.select("path", F.lit(True).alias("s")).distinct(), pages.select("path", "page", F.lit(True).alias("p")).distinct()
    known = one.withColumn("said", said).join(have_path, "path", "left").join(have_page, ["path", "page"], "left")
    fault = (
        F.when(F.col("said").isNotNull(), F.lit(None)).when(F.col("n").isNull(), "missing-definition").when(F.col("page") <= 0, "bad-page")
        .when(F.col("path").startswith("..") | F.col("path").startswith("/"), "path-outside-root").when(F.col("s").isNull(), "unindexed-path").when(F.col("p").isNull(), "page-not-indexed")
    )
    cited = c.select("report", F.explode("citations").alias("key")).distinct().join(known, ["report", "key"], "left")
    issues = cited.select("report", "key", fault.alias("issue")).filter("issue is not null").union(own)

    good = known.filter("said is null and page > 0 and p").select("report", F.col("key").alias("k"), "path", "page")
    q = c.select("report", F.explode("quotes").alias("q")).select("report", "q.n", "q.quote", F.col("q.keys").alias("keys"))
    bound = q.select("report", "n", F.explode("keys").alias("k")).join(good, ["report", "k"]).groupBy("report", "n").agg(F.count(F.lit(1)).alias("viable"), F.first("k").alias("key"), F.first("path").alias("path"), F.first("page").alias("page"))
    j = q.join(bound.filter("viable = 1"), ["report", "n"], "left").join(pages.select("path", "page", F.col("text").alias("t")), ["path", "page"], "left")
    flat = X.normalise_text(F.col("quote"))
    status = F.when((flat == "") | F.col("key").isNull(), "structural-error").when(F.contains("t", "quote"), "exact").when(F.contains(X.normalise_text(F.col("t")), flat), "normalised").otherwise("not-found")
    return issues, j.select("report", "n", "quote", "key", "path", "page", status.alias("status"))
