"""Text blocks of laid-out pages, in the order they are read, as units.

Where the blocks come from (a PDF library, character recognition, a layout model) is for the caller; a row is a
block with its page and box. Pages are spread over the tasks; a source's pages are only brought together to number its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADING_CHARS = 70


def reading_order() -> list[Column]:
    """Down the page, then across, both to a tenth of a point; equal places by their text."""
    return [F.round("y0", 1), F.round("x0", 1), F.col("text")]


def is_heading(text: Column) -> Column:
    """Short, and not the end of a sentence or clause."""
    return (F.length(text) <= HEADING_CHARS) & ~text.rlike("[.,;]$")


def block_units(blocks: DataFrame, source: str = "source", page: str = "page") -> DataFrame:
    """(source, page, position, content_type, section, start, end, text) of blocks (source, page, x0, y0, text).

    Blank blocks count for nothing. A section is the latest heading of its own page; offsets run over a page, two
    signs between units.
    """
    b = blocks.withColumn("text", F.trim(F.col("text"))).filter("text <> ''")
    on_page = W.partitionBy(source, page).orderBy(*reading_order())
    n = b.select(source, page, F.row_number().over(on_page).alias("position"), "text", is_heading(F.col("text")).alias("h"))
    so_far = W.partitionBy(source, page).orderBy("position")
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    section = F.last(F.when(F.col("h"), F.col("text")), True).over(so_far.rowsBetween(W.unboundedPreceding, 0))
    u = n.select(source, page, "position", F.when(F.col("h"), "heading").otherwise("body").alias("content_type"), section.alias("section"), start.alias("start"), "text")
    return u.withColumn("end", F.col("start") + F.length("text"))


def page_texts(blocks: DataFrame, source: str = "source", page: str = "page") -> DataFrame:
    """(source, page, text): the blocks of each page in reading order, a blank line between them."""
    b = blocks.withColumn("text", F.trim(F.col("text"))).filter("text <> ''").groupBy(source, page).agg(F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("y"), F.round("x0", 1).alias("x"), "text"))).alias("bs"))  # of one page
    return b.select(source, page, F.array_join(F.transform("bs", lambda x: x["text"]), "\n\n").alias("text"))
