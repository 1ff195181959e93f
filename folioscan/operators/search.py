"""Hybrid search over a store: BM25 and exact nearest neighbours, fused by rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.operators import fusion, lexical, postings, vectors
from folioscan.operators.store import Store, stub_embedder

LIMIT, LEXICAL_LIMIT, VECTOR_LIMIT = 10, 50, 50


def embed_query(store: Store, query: str, embed: Callable[[str], Column]) -> list[float]:
    """The vector of one query, by the embedder of the chunks."""
    return list(store.spark.createDataFrame([(query,)], "q string").select(embed("q")).first()[0])


def search(
    store: Store, query: str, limit: int = LIMIT, lexical_limit: int = LEXICAL_LIMIT, vector_limit: int = VECTOR_LIMIT, source_types: Sequence[str] | None = None, embed: Callable[[str], Column] = stub_embedder, model: str | None = None,
) -> DataFrame:
    """(rank, chunk_id, score, provenance, lexical_rank, vector_rank, path, source_type, heading_path, content_type, line_start, line_end, locator, body).

    Source types restrict both rankings before they are cut; corpus statistics stay those of all
    chunks. Each vector ranks the chunks that share its hash. A query that isn't of the query
    language is searched for as a phrase.
    """
    chunks = store.chunks()
    pool = chunks.filter(F.col("source_type").isin(list(source_types))) if source_types else chunks
    parsed, _ = lexical.parse_or_phrase(query)
    allowed = pool.select("chunk_id") if source_types else None
    found = lexical.top(postings.bm25(store.postings(), store.statistics(), parsed, "chunk_id", allowed), lexical_limit, "chunk_id")
    near = vectors.knn(store.embeddings(model or store.state["active"]), embed_query(store, query, embed), vector_limit, key="semantic_hash", vector="vector", allowed=pool)
    hits = near.join(pool.select("semantic_hash", "chunk_id"), "semantic_hash")
    ranked = hits.select("chunk_id", F.row_number().over(W.orderBy("rank", "chunk_id")).alias("rank"))  # vector_limit hashes and the chunks that share them
    fused = fusion.fuse(found.select("chunk_id", "rank"), ranked, limit, key="chunk_id")
    shown = chunks.select("chunk_id", "path", "source_type", "heading_path", "content_type", "line_start", "line_end", "locator", "body")
    return F.broadcast(fused).join(shown, "chunk_id").select("rank", "chunk_id", "score", "provenance", "lexical_rank", "vector_rank", "path", "source_type", "heading_path", "content_type", "line_start", "line_end", "locator", "body").orderBy("rank")


def payload(found: DataFrame, sources: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Search results as nested rows, the form of the JSON output: heading path, ranges of lines, locator, provenance and, for a page of a PDF, its link and assets.

    ``found`` is what ``search`` gives, with a column ``page`` where pages are known; ``sources`` (path, sha256).
    """
    from folioscan.operators.pageview import page_assets

    f = found if "page" in found.columns else found.withColumn("page", F.lit(None).cast("int"))
    f = f.join(sources.select("path", F.col("sha256").alias("source_sha256")), "path", "left")
    if assets is not None:
        f = f.join(page_assets(assets), ["path", "page"], "left")
    link = F.when((F.col("source_type") == "pdf") & F.col("page").isNotNull(), F.concat("path", F.lit("#page="), F.col("page").cast("string")))
    extra = [] if assets is None else ["page_render", F.coalesce("figure_crops", F.array().cast("array<string>")).alias("figure_crops")]
    return f.select(
        "rank", F.col("path").alias("source_path"), "source_type", "source_sha256", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"), F.col("body").alias("passage"), F.col("page").alias("physical_page"),
        F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("line_range"), "locator", "content_type", F.sort_array(F.split("provenance", "\\+")).alias("provenance"), F.col("score").alias("fused_score"), link.alias("pdf_link"), *extra,
    )
