"""Quotes, citations and pages as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators.pages import Term


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, source, page, status) of quotes (quote_id, source, page, quote) against pages (source, page, text).

    exact: the page has the quote as it is; normalised: it has it but for white space;
    not-found: neither, or no such page; structural-error: a blank quote.
    """
    j = quotes.join(pages.select("source", "page", F.col("text").alias("__t")), ["source", "page"], "left")
    flat = X.normalise_text(F.col("quote"))
    status = (
        F.when(flat == "", "structural-error").when(F.contains("__t", "quote"), "exact")
        .when(F.contains(X.normalise_text(F.col("__t")), flat), "normalised").otherwise("not-found")
    )
    return j.select("quote_id", "source", "page", status.alias("status"))


QUOTE_BYTES = 32 << 20


def _quote_finder(quotes: list[tuple[int, str, str]]):
    """Array of (number, exact) of the quotes (number, quote, flat quote) that a text holds.

    A quote's words but its first and last stand between spaces in whatever text holds it: of those, the one
    with most letters names the quotes that a text is searched for. Quotes without such a word are searched for in every text.
    """
    by: dict[str, list[tuple[int, str, str]]] = {}
    always = []
    for q in quotes:
        inner = q[2].split(" ")[1:-1]
        if inner:
            by.setdefault(max(inner, key=lambda w: (len(w), w)), []).append(q)
        else:
            always.append(q)
    kind = pa.list_(pa.struct([("k", pa.int64()), ("exact", pa.bool_())]))

    @F.arrow_udf("array<struct<k:bigint,exact:boolean>>")
    def find(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, flats in parts:
            out = []
            for text, flat in zip(texts, flats):
                text, flat = text.as_py(), flat.as_py()
                if text is None:
                    out.append([])
                    continue
                some = [q for w in by.keys() & set(flat.split(" ")) for q in by[w]] + always
                out.append([{"k": k, "exact": quote in text} for k, quote, own in some if own in flat])
            yield pa.array(out, type=kind)

    return find


def find_quotes(quotes: DataFrame, docs: DataFrame, most_bytes: int = QUOTE_BYTES) -> DataFrame:
    """(quote_id, doc_id, status) wherever a text of docs (doc_id, text) holds a quote (quote_id, quote) whose page isn't known.

    Quotes are sent to the texts, which stay where they are: all at once up to ``most_bytes``, beyond that in as many blocks as
    are needed, each of which reads the texts anew.
    """
    flat = X.normalise_text(F.col("quote"))
    q = quotes.filter(flat != "").select("quote_id", "quote", flat.alias("flat")).distinct()
    size = q.agg(F.coalesce(F.sum(F.octet_length("quote") + F.octet_length("flat")), F.lit(0))).first()[0]
    blocks = int(size // most_bytes) + 1
    found = None
    for b in range(blocks):
        mine = q.filter(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == b).collect()
        ids = docs.sparkSession.createDataFrame([(k, r["quote_id"]) for k, r in enumerate(mine)], q.select(F.lit(0).cast("bigint").alias("k"), "quote_id").schema)
        find = _quote_finder([(k, r["quote"], r["flat"]) for k, r in enumerate(mine)])
        hits = docs.select("doc_id", F.explode(find("text", X.normalise_text(F.col("text")))).alias("h")).select("doc_id", "h.k", "h.exact")
        part = hits.join(F.broadcast(ids), "k").select("quote_id", "doc_id", F.when(F.col("exact"), "exact").otherwise("normalised").alias("status"))
        found = part if found is None else found.union(part)
    return found


def citation_issues(citations: DataFrame, definitions: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(report, key, issue) of citations (report, key) by definitions (report, key, path, page), sources (path) and pages (path, page)."""
    d = definitions.groupBy("report", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path", "page").alias("m"), F.first("path").alias("path"), F.first("page").alias("page"))
    twice = d.filter("n > 1").select("report", "key", F.when(F.col("m") > 1, "ambiguous-definition").otherwise("duplicate-definition").alias("issue"))
    used = citations.select("report", "key").distinct().join(d, ["report", "key"], "left").filter("n is null or n = 1")
    used = used.join(sources.select("path", F.lit(True).alias("s")).distinct(), "path", "left").join(pages.select("path", "page", F.lit(True).alias("p")).distinct(), ["path", "page"], "left")
    issue = (
        F.when(F.col("n").isNull(), "missing-definition").when(F.col("page") <= 0, "bad-page").when(F.col("path").startswith("/") | F.col("path").startswith(".."), "path-outside-root")
        .when(F.col("s").isNull(), "unindexed-path").when(F.col("p").isNull(), "page-not-indexed")
    )
    return used.select("report", "key", issue.alias("issue")).filter("issue is not null").union(twice)


def quote_scopes(lines: DataFrame, by: str, order: str, boundary: Column, key: Column, quote: Column) -> DataFrame:
    """(by, order, key): each quote line with the one key of its scope, null where the scope has none or several; a boundary line begins a scope and belongs to it."""
    w = W.partitionBy(by).orderBy(order)
    s = lines.select(by, order, F.sum(F.when(boundary, 1).otherwise(0)).over(w).alias("scope"), key.alias("k"), quote.alias("q"))
    before = W.partitionBy(by, "scope").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    seen = s.withColumn("ks", F.collect_set("k").over(before))
    return seen.filter("q").select(by, order, F.when(F.size("ks") == 1, F.col("ks")[0]).alias("key"))


def select_pages(pages: DataFrame, terms: list[Term] | None, default: int = 1, source: str = "source", page: str = "page") -> DataFrame:
    """(source, page) that a parsed selector asks of each source; sources that lack a page which the selector needs are left out (see ``missing_pages``)."""
    bad = missing_pages(pages, terms, default, source, page)
    have = pages.select(source, page).distinct()
    want = F.col(page) == default if terms is None else F.lit(True) if terms[0].kind == "all" else _any([_holds(t, page) for t in terms])
    return have.filter(want).join(bad.select(source), source, "left_anti")


def missing_pages(pages: DataFrame, terms: list[Term] | None, default: int = 1, source: str = "source", page: str = "page") -> DataFrame:
    """(source, missing): the first page that a selector needs and a source lacks. Open ends reach to each source's last page."""
    have = pages.select(source, page).distinct()
    last = have.groupBy(source).agg(F.max(page).alias("last"), F.collect_set(page).alias("all"))
    if terms is None:
        need = F.array(F.lit(default))
    elif terms[0].kind == "all":
        need = F.array().cast("array<int>")
    else:
        parts = []
        for t in terms:
            if t.kind == "from":
                parts.append(F.when(F.col("last") < t.start, F.array(F.lit(t.start))).otherwise(F.sequence(F.lit(t.start), F.greatest(F.col("last").cast("int"), F.lit(t.start)))))
            elif t.kind == "page":
                parts.append(F.array(F.lit(t.start)))
            else:
                parts.append(F.sequence(F.lit(t.start), F.lit(t.end)))
        need = F.concat(*[p.cast("array<int>") for p in parts])
    gap = F.array_min(F.array_except(need, F.transform("all", lambda x: x.cast("int"))))
    return last.select(source, gap.alias("missing")).filter("missing is not null")


def _holds(t: Term, page: str) -> Column:
    if t.kind == "page":
        return F.col(page) == t.start
    return F.col(page) >= t.start if t.kind == "from" else F.col(page).between(t.start, t.end)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def nearby_text(figures: DataFrame, blocks: DataFrame, x_slack: float = 20.0, y_gap: float = 72.0) -> DataFrame:
    """(figure_id, nearby_text): text blocks (page, x0, y0, x1, y1, text) that overlap a figure's width, give or take, within a vertical gap; joined by y."""
    f = figures.select("figure_id", F.col("page").alias("fp"), *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])
    gap = F.greatest(F.col("y0") - F.col("fy1"), F.col("fy0") - F.col("y1"), F.lit(0.0))
    j = f.join(blocks, (F.col("fp") == F.col("page")) & (F.col("x0") <= F.col("fx1") + x_slack) & (F.col("x1") >= F.col("fx0") - x_slack) & (gap <= y_gap))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda b: b["text"]), " ")
    return j.groupBy("figure_id").agg(text.alias("nearby_text"))


def band_counts(events: DataFrame, kind_left: str, kind_right: str, seconds: int, by: str = "user_id", at: str = "ts", kind: str = "event_type", key: str = "event_id") -> DataFrame:
    """(key, n): events of one kind, and how many of the other the same ``by`` has within so many seconds; a band join bucketed by time so that it hashes."""
    # seconds since 1970 by the clock of the column, which no time zone shifts
    clock = F.expr(f"cast(cast(cast(`{at}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6))")
    b = F.floor(F.col("t") / seconds)
    timed = events.select(key, by, kind, clock.alias("t"))
    left = timed.filter(F.col(kind) == kind_left).select(key, by, "t", F.explode(F.array(b - 1, b, b + 1)).alias("bucket"))
    right = timed.filter(F.col(kind) == kind_right).select(F.col(by).alias("rb"), F.col("t").alias("rt"), b.alias("rbucket"))
    near = F.abs(F.col("t") - F.col("rt")) <= seconds
    j = left.join(right, (left[by] == right["rb"]) & (left["bucket"] == right["rbucket"]) & near)
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
