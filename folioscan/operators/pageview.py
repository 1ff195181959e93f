"""Pages as people and programs ask for them: a source's text by pages, page rows with their images, quotes on a known page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators import evidence
from folioscan.operators.pages import Term


def page_assets(assets: DataFrame) -> DataFrame:
    """(path, page, page_render, figure_crops) of assets (path, page, asset_type, asset_path): the first render by path, and all crops in order."""
    kind = F.col("asset_type")
    render = F.min(F.when(kind == "page-render", F.col("asset_path")))
    crops = F.sort_array(F.collect_list(F.when(kind == "figure-crop", F.col("asset_path"))))  # as many as a page has figures
    return assets.groupBy("path", "page").agg(render.alias("page_render"), crops.alias("figure_crops"))


def page_rows(pages: DataFrame, sources: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(source_path, physical_page, text, pdf_link, page_render, figure_crops) of pages (path, page, text) of known sources (path, source_type).

    Workbooks have no pages; a link stands where the source is a PDF.
    """
    p = pages.join(sources.filter("source_type <> 'workbook'").select("path", "source_type"), "path")
    if assets is not None:
        p = p.join(page_assets(assets), ["path", "page"], "left")
    else:
        p = p.withColumns({"page_render": F.lit(None).cast("string"), "figure_crops": F.array().cast("array<string>")})
    link = F.when(F.col("source_type") == "pdf", F.concat("path", F.lit("#page="), F.col("page").cast("string")))
    return p.select(F.col("path").alias("source_path"), F.col("page").alias("physical_page"), "text", link.alias("pdf_link"), "page_render", F.coalesce("figure_crops", F.array().cast("array<string>")).alias("figure_crops"))


def page_text(pages: DataFrame, terms: list[Term] | None, default: int = 1) -> DataFrame:
    """(path, text): what a selector asks of each source of pages (path, page, text); several pages stand under a line that names them.

    A source that lacks a page which the selector needs isn't there; ``evidence.missing_pages`` names that page.
    """
    want = evidence.select_pages(pages, terms, default, "path", "page")
    got = pages.join(want, ["path", "page"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("ps"))  # the selected pages of one source
    marked = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("--- physical page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])), "\n\n")
    return got.select("path", F.when(F.size("ps") == 1, F.col("ps")[0]["text"]).otherwise(marked).alias("text"))


def longer_text(text: Column, ocr: Column, least: int = 20) -> tuple[Column, Column]:
    """(text, method): a page whose text has fewer than ``least`` signs takes that of character recognition where it is longer."""
    use = (F.length(F.trim(F.coalesce(text, F.lit("")))) < least) & (F.length(F.coalesce(ocr, F.lit(""))) > F.length(F.coalesce(text, F.lit(""))))
    return F.when(use, ocr).otherwise(F.coalesce(text, F.lit(""))), F.when(use, "ocr").otherwise("text")
