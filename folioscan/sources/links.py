"""Registry of source links: where a local source is published, and documents with their links led there."""

from __future__ import annotations

import posixpath
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.report import prose

SCHEMA = 3


class LinkError(ValueError):
    """A link to a source that isn't registered exactly once."""


@dataclass(frozen=True)
class Link:
    name: str
    local_path: str  # below the root
    public_url: str
    metadata: dict = field(default_factory=dict, compare=False)


def _fault(n: int, e: Any, known: dict[str, Link]) -> str | None:
    """What is wrong with entry n, or None."""
    if not isinstance(e, dict):
        return f"entry {n} isn't a table"
    if odd := set(e) - {"name", "local_path", "public_url", "metadata"}:
        return f"entry {n}: unknown {', '.join(sorted(odd))}"
    for k in ("local_path", "name", "public_url"):
        if not isinstance(e.get(k), str) or not e[k].strip():
            return f"entry {n}: {k} must be a text"
    if not isinstance(e.get("metadata", {}), dict):
        return f"entry {n}: metadata must be a table"
    raw = e["local_path"].replace("\\", "/")
    path = posixpath.normpath(raw)
    if set("?#") & set(raw) or raw.startswith("/") or path.startswith("..") or not path.lower().endswith((".pdf", ".md")):
        return f"entry {n}: local_path must be a .pdf or .md below the root, without query or fragment"
    if path in known:
        return f"entry {n}: {path} is registered already"
    if any(e["name"] == x.name for x in known.values()):
        return f"entry {n}: the name {e['name']} is taken"
    url = urlsplit(e["public_url"])
    if url.scheme != "https" or not url.netloc or url.username is not None or url.password is not None or url.fragment:
        return f"entry {n}: public_url must be https, without credentials or fragment"
    return None


def load(path: str | Path) -> tuple[dict[str, Link], list[str]]:
    """(links by local path, what is wrong); entries with a fault are left out."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    if data.get("schema_version") != SCHEMA:
        return {}, [f"schema_version must be {SCHEMA}"]
    entries = data["source"] if "source" in data else []
    if not isinstance(entries, list):
        return {}, ["source must be an array of tables"]
    out: dict[str, Link] = {}
    faults = []
    for n, e in enumerate(entries, 1):
        if said := _fault(n, e, out):
            faults.append(said)
        else:
            p = posixpath.normpath(e["local_path"].replace("\\", "/"))
            out[p] = Link(e["name"], p, e["public_url"], e.get("metadata", {}))
    return out, faults


_TARGET = re.compile(r"(?P<before>(?<!!)\[[^\]\[]*\]\(|^ {0,3}\[[^\]\[]+\]:\s*)(?P<to>[^\s()<>?]+\.(?:pdf#page=[1-9]\d*|md(?:#[^\s()<>#]+)?))(?=[\s)]|$)", re.I)


def staged(text: str, path: str, links: dict[str, Link], public: bool = True, out_path: str | None = None) -> str:
    """A document whose links to registered sources lead to their public place, or to the local one as seen from ``out_path``.

    Code, comments and tables are left alone. A PDF link needs its source registered; a Markdown link
    without one is ordinary navigation and stays.
    """
    base, out_base = posixpath.dirname(path), posixpath.dirname(out_path or path)
    lines = text.split("\n")
    start = 0
    if lines and lines[0].strip() == "---":  # front matter
        start = next((k + 1 for k in range(1, len(lines)) if lines[k].strip() in ("---", "...")), 0)
    shown = prose(lines[start:])
    for k, kept in enumerate(shown, start):
        if not kept.strip() or kept.lstrip().startswith("|") or len(kept) != len(lines[k]):
            continue

        def one(m: re.Match) -> str:
            local, _, tail = m["to"].partition("#")
            link = links.get(posixpath.normpath(posixpath.join(base, local)))
            if link is None:
                if "://" not in local and local.lower().endswith(".pdf"):
                    raise LinkError(f"{path}: {local} isn't registered")
                return m.group()
            to = link.public_url if public else posixpath.relpath(link.local_path, out_base or ".")
            return m["before"] + to + (f"#{tail}" if tail else "")

        found = list(_TARGET.finditer(kept))  # inline code is blanked here, so that places in the line stay what they are
        for m in reversed(found):
            lines[k] = lines[k][: m.start()] + one(m) + lines[k][m.end() :]
    return "\n".join(lines)


def stage_documents(docs: DataFrame, links: dict[str, Link], public: bool = True) -> DataFrame:
    """(path, text, error) of docs (path, text) with links rewritten; a document with an unregistered PDF keeps its text and has an error."""

    @F.arrow_udf("struct<text:string,error:string>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, texts in parts:
            out = []
            for p, t in zip(paths.to_pylist(), texts.to_pylist()):
                try:
                    out.append({"text": None if t is None else staged(t, p or "", links, public), "error": None})
                except LinkError as e:
                    out.append({"text": t, "error": str(e)})
            yield pa.array(out, type=pa.struct([("text", pa.string()), ("error", pa.string())]))

    return docs.select("path", run("path", "text").alias("s")).select("path", "s.text", "s.error")


def registry_issues(cited: DataFrame, links: DataFrame) -> DataFrame:
    """(path, issue) of cited paths by links (local_path): no-entry or ambiguous-entry."""
    n = links.groupBy(F.col("local_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    j = cited.select("path").distinct().join(n, "path", "left")
    return j.select("path", F.when(F.col("n").isNull(), "no-entry").when(F.col("n") > 1, "ambiguous-entry").alias("issue")).filter("issue is not null")
