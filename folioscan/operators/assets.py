"""Images of pages: generations of files, what refers to them, names and safe paths.

A generation is a folder ``imgs/generations/<id>`` that one run fills and nobody changes; a row of the assets
table refers to a file of one. A generation without references can be deleted.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROOT = "imgs/generations/"


class AssetError(ValueError):
    """A path that doesn't belong to the images."""


def resolve(identifier: str) -> str:
    """The identifier, if it is a plain relative path below ``imgs/generations``."""
    if not identifier or "\x00" in identifier or "\\" in identifier or identifier.startswith("/") or re.match(r"^[A-Za-z]:", identifier):
        raise AssetError(f"not a relative POSIX path: {identifier!r}")
    parts = identifier.split("/")
    if not identifier.startswith(_ROOT) or len(parts) < 4 or any(p in ("", ".", "..") for p in parts):
        raise AssetError(f"not below {_ROOT}: {identifier!r}")
    return identifier


def path_issue(path: Column) -> Column:
    """``resolve`` as an expression: absolute, not-posix, wrong-root, not-normalised, or null for a good path."""
    return (
        F.when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "absolute").when(path.contains("\\") | (path == ""), "not-posix").when(~path.startswith(_ROOT), "wrong-root")
        .when(path.rlike("(^|/)(\\.{0,2})(/|$)") | (F.size(F.split(path, "/")) < 4), "not-normalised")
    )


def generation(path: Column) -> Column:
    """The generation that an asset's path names, or null."""
    g = F.regexp_extract(path, "^imgs/generations/([^/]+)/", 1)
    return F.when(g != "", g)


def generations(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(generation, files, referred, state) of files (asset_path) by assets (asset_path): live, partly referred to, or orphan, to be deleted."""
    refer = assets.select("asset_path", F.lit(1).alias("r")).distinct()
    j = files.select("asset_path").distinct().join(refer, "asset_path", "left").withColumn("generation", generation(F.col("asset_path"))).filter("generation is not null")
    g = j.groupBy("generation").agg(F.count(F.lit(1)).alias("files"), F.count("r").alias("referred"))
    return g.withColumn("state", F.when(F.col("referred") == 0, "orphan").when(F.col("referred") < F.col("files"), "partial").otherwise("live"))


def issues(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(asset_path, issue) of assets (asset_path, sha256) against files (asset_path, sha256): a bad path, missing-file or hash-mismatch."""
    j = assets.select("asset_path", F.col("sha256").alias("want")).join(files.select("asset_path", F.col("sha256").alias("have")), "asset_path", "left")
    said = F.coalesce(path_issue(F.col("asset_path")), F.when(F.col("have").isNull(), "missing-file").when(F.col("have") != F.col("want"), "hash-mismatch"))
    return j.select("asset_path", said.alias("issue")).filter("issue is not null")


def name_slug(stem: Column, limit: int = 24) -> Column:
    """A file's stem in letters, digits and ``._-``, at most ``limit`` signs; "source" for none."""
    s = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), "^[.\\-_]+|[.\\-_]+$", "")
    return F.substring(F.when(s == "", "source").otherwise(s), 1, limit)


def selector_token(selector: Column, pages: Column) -> Column:
    """Twelve digits that stand for a selector and the pages that it came to."""
    raw = F.concat(F.coalesce(selector, F.lit("1")), F.lit("|"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ","))
    return F.substring(F.sha2(raw, 256), 1, 12)


def extract_name(stem: Column, selector: Column, pages: Column, suffix: str = ".pdf", prefix: str = "extract") -> Column:
    """The name of a file with selected pages, 72 signs before its suffix at most."""
    return F.concat(F.substring(F.concat_ws("-", F.lit(prefix), name_slug(stem), selector_token(selector, pages)), 1, 72), F.lit(suffix))


def token(selector: str | None, pages: list[int]) -> str:
    """``selector_token`` of plain values."""
    return sha256(f"{'1' if selector is None else selector}|{','.join(map(str, pages))}".encode()).hexdigest()[:12]
