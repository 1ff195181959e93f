"""Units to chunks: a budgeted fold over the ordered units of a source, and what a chunk holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import text as X

MAX_CHARS = 1200


def _lines(text: Column) -> Column:
    """The lines of a text that aren't blank, each with its number from 1."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.filter(lines, lambda x: X.collapse_space(x["text"]) != "")


def line_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, line, text): the lines of each text that aren't blank; ordinal counts them, line counts all, from 1. Nothing is shuffled."""
    return docs.select(key, F.posexplode(_lines(F.col(text))).alias("at", "u")).select(key, (F.col("at") + 1).alias("ordinal"), "u.line", "u.text")


def unit_offsets(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds start and end: units follow each other with two signs between."""
    before = W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return units.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def fold(sizes: Sequence[int], sections: Sequence[str | None], max_chars: int = MAX_CHARS) -> list[dict[str, int]]:
    """Groups of units: where each begins, how many units it has, the offset it begins at and the signs it spans.

    A group ends where the next unit would exceed the budget or begins another section; each
    unit costs its size and two, after it has been added. No unit is split.
    """
    out: list[dict[str, int]] = []
    used = at = 0
    for i, (n, s) in enumerate(zip(sizes, sections)):
        if not out or used + n > max_chars or s != sections[i - 1]:
            out.append({"start": i, "n": 0, "at": at, "span": -2})
            used = 0
        out[-1]["n"] += 1
        out[-1]["span"] += n + 2
        used += n + 2
        at += n + 2
    return out


def groups(sizes: Column, sections: Column, max_chars: int = MAX_CHARS) -> Column:
    """``fold`` of arrays of unit sizes and section keys, as an array; one pass over each source's units."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("at", pa.int64()), ("span", pa.int64())]))

    @F.arrow_udf("array<struct<start:int,n:int,at:bigint,span:bigint>>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ns, ss in parts:
            yield pa.array([fold(n or [], s or [], max_chars) for n, s in zip(ns.to_pylist(), ss.to_pylist())], type=kind)

    return run(sizes, sections)


def _chunked(rows: DataFrame, key: str, section: bool, max_chars: int) -> DataFrame:
    """Chunks of (key, us): each joined out of its slice of the units, where they are."""
    part = lambda f: F.transform("us", f)
    g = groups(part(lambda u: F.length(u["text"])), part(lambda u: u["s"]) if section else part(lambda u: F.lit("")), max_chars)

    def chunk(x, i):
        us = F.slice(F.col("us"), x["start"] + 1, x["n"])
        return F.struct(
            i.alias("chunk"), F.array_join(F.transform(us, lambda u: u["text"]), "\n\n").alias("body"), x["n"].cast("bigint").alias("n_units"), F.element_at(us, 1)["line"].alias("line_start"),
            F.element_at(us, -1)["line"].alias("line_end"), x["at"].alias("start"), (x["at"] + x["span"]).alias("end"),
        )

    got = rows.withColumn("__g", g).select(key, F.explode(F.transform("__g", chunk)).alias("c")).select(key, "c.*")
    return got.withColumn("n_chars", F.length("body")).withColumn("lexical_hash", X.lexical_hash(F.col("body")))


def chunks(units: DataFrame, key: str = "doc_id", max_chars: int = MAX_CHARS, section: str | None = None) -> DataFrame:
    """(key, chunk, body, n_units, line_start, line_end, start, end, n_chars, lexical_hash) of units (key, ordinal, line, text).

    The units of one source are gathered in order, folded once and joined in place; sources
    are spread over the tasks.
    """
    s = F.col(section).cast("string") if section else F.lit("")
    rows = units.select(key, F.struct("ordinal", "line", "text", s.alias("s")).alias("u")).groupBy(key).agg(F.array_sort(F.collect_list("u")).alias("us"))
    return _chunked(rows, key, section is not None, max_chars)


def document_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """``chunks`` of the lines of each text, which never leave their row: no shuffle."""
    return _chunked(docs.select(key, _lines(F.col(text)).alias("us")), key, False, max_chars)


def sections(units: DataFrame, heading: Column, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, section, occurrence): the latest heading at or before each unit, and for a heading how many equal ones went before."""
    h = units.withColumn("__h", heading)
    so_far = W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    times = F.row_number().over(W.partitionBy(key, "__h").orderBy("ordinal")) - 1
    return h.select(key, "ordinal", F.last("__h", True).over(so_far).alias("section"), F.when(F.col("__h").isNotNull(), times).alias("occurrence"))


def excel_bounds(cells: DataFrame, by: list[str], ref: str = "ref") -> DataFrame:
    """(by, range): the bounding A1 range of cell references; null if any isn't one."""
    c = cells.select(*by, X.a1_column(F.col(ref)).alias("c"), X.a1_row(F.col(ref)).alias("r"))
    got = c.groupBy(*by).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.count_if(F.col("r").isNull()).alias("bad"))
    start, end = F.concat(X.a1_label(F.col("c0")), F.col("r0")), F.concat(X.a1_label(F.col("c1")), F.col("r1"))
    return got.select(*by, F.when(F.col("bad") == 0, F.when(start == end, start).otherwise(F.concat_ws(":", start, end))).alias("range"))
