"""A copy of a documentation tree with each table's retrieval text under it, its tables as JSON lines and a manifest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import normalise as N


def augmented(docs: DataFrame) -> DataFrame:
    """(path, destination, text, tables) of docs (path, text): blocks added, source suffixes of links made .md, tables as JSON."""

    @F.arrow_udf("struct<text:string,tables:array<string>>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import json

        for paths, texts in parts:
            out = []
            for p, t in zip(paths.to_pylist(), texts.to_pylist()):
                text, tables = (None, []) if t is None else N.with_blocks(t, p or "<memory>")
                out.append({"text": text, "tables": [json.dumps(asdict(x), ensure_ascii=False, sort_keys=True) for x in tables]})
            yield pa.array(out, type=pa.struct([("text", pa.string()), ("tables", pa.list_(pa.string()))]))

    r = docs.select("path", run("path", "text").alias("r"))
    links = F.regexp_replace("r.text", "(\\]\\([^()\\s?#]+)\\.(?:py|jl|qmd)(?=[)?#])", "$1.md")
    return r.select("path", X.published_path(F.col("path")).alias("destination"), links.alias("text"), F.col("r.tables").alias("tables"))


def export_site(docs: DataFrame, out: str) -> dict[str, int]:
    """Write ``pages`` (path, destination, text) as Parquet, ``tables`` as JSON lines and ``manifest`` as JSON below ``out``; gives the counts.

    Pages are rows, not files: a tree of small files is for whoever serves it to write. An
    existing folder is refused.
    """
    a = augmented(docs)
    a.write.parquet(f"{out}/staged")
    spark = docs.sparkSession
    a = spark.read.parquet(f"{out}/staged")
    a.select("path", "destination", "text").write.parquet(f"{out}/pages")
    a.select(F.explode("tables").alias("value")).write.text(f"{out}/tables")
    manifest = a.select("path", "destination", F.transform("tables", lambda t: F.get_json_object(t, "$.table_id")).alias("tables"))
    manifest.write.json(f"{out}/manifest")
    r = a.agg(F.count(F.lit(1)).alias("p"), F.coalesce(F.sum(F.size("tables")), F.lit(0)).alias("t")).first()
    return {"page_count": r["p"], "table_count": r["t"]}
