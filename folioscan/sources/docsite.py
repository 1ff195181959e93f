"""Documentation trees: the contract that names their folders, what of them is indexed, in which languages they are built, and whether copies are fresh.

Trees are DataFrames of (path, content) or (path, text); comparing and filtering them are joins and expressions, and
files are written by the tasks that hold them.
"""

from __future__ import annotations

import os
import posixpath
import re
import shutil
import tomllib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators import diff

EXCLUDED_FOLDERS = ("_quarto", "_site", "site_libs", "build", "dist", "__pycache__", "model-cache")
_FIELDS = ("authored_root", "retained_root", "staged_root", "source_links", "index_output", "publication_exclude")


class ContractError(ValueError):
    """A documentation contract that isn't valid."""


@dataclass(frozen=True)
class Contract:
    authored_root: str
    retained_root: str
    staged_root: str
    source_links: str
    index_output: str
    publication_exclude: tuple[str, ...] = ()
    render_command: tuple[str, ...] | None = None


def _inside(a: str, b: str) -> bool:
    return a == b or a.startswith(b.rstrip("/") + "/")


def contract(path: str | Path) -> Contract:
    """The contract of one TOML file, schema_version 1 and a table docs: paths below the root, none within another but authored and retained where they are the same."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("schema_version") != 1 or set(data) != {"schema_version", "docs"} or not isinstance(data["docs"], dict):
        raise ContractError("schema_version = 1 and a table [docs] are needed")
    docs = dict(data["docs"])
    command = docs.pop("host_render_command", None)
    if odd := set(docs) ^ set(_FIELDS):
        raise ContractError(f"unknown or missing: {', '.join(sorted(odd))}")
    if command is not None and not (isinstance(command, list) and command and all(isinstance(x, str) and x for x in command)):
        raise ContractError("host_render_command must list arguments")

    def clean(name: str, value) -> str:
        if not isinstance(value, str) or not value.strip() or value.startswith("/") or "\\" in value:
            raise ContractError(f"{name} must be a relative path")
        out = posixpath.normpath(value)
        if out.startswith(".."):
            raise ContractError(f"{name} leaves the root")
        return out

    roots = {k: clean(k, docs[k]) for k in _FIELDS[:-1]}
    if not isinstance(docs["publication_exclude"], list):
        raise ContractError("publication_exclude must be an array")
    names = list(roots)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            same = {a, b} == {"authored_root", "retained_root"} and roots[a] == roots[b]
            if not same and (_inside(roots[a], roots[b]) or _inside(roots[b], roots[a])):
                raise ContractError(f"{a} and {b} overlap")
    return Contract(*roots.values(), tuple(clean("publication_exclude", x) for x in docs["publication_exclude"]), tuple(command) if command else None)


def retained(path: Column, exclude: Iterable[str] = ()) -> Column:
    """Whether a path of the tree is indexed: no hidden, built or dependency folder on it, no HTML, nothing excluded from publication."""
    folders = "|".join(map(re.escape, EXCLUDED_FOLDERS))
    out = ~path.rlike(f"(^|/)(?:\\.[^/]+|{folders}|[^/]*_files)/") & ~F.lower(path).rlike("\\.html?$")
    for x in exclude:
        out = out & (path != x) & ~path.startswith(x.rstrip("/") + "/")
    return out


def language(path: Column, text: Column) -> Column:
    """python, julia or null, by suffix or, for .qmd, by the engine that the front matter names."""
    suffix = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    front = F.regexp_extract(text, "(?s)\\A---(.*?)\\n---", 1)
    engine = F.lower(F.coalesce(F.nullif(F.regexp_extract(front, "(?m)^jupyter:[ \\t]*(\\S+)", 1), F.lit("")), F.regexp_extract(front, "(?m)^engine:[ \\t]*(\\S+)", 1)))
    by_engine = F.when(engine.contains("julia"), "julia").when(engine.contains("python") | (engine == "jupyter"), "python")
    return F.when(suffix == ".py", "python").when(suffix == ".jl", "julia").when(suffix == ".qmd", by_engine)


def build_variant(languages: set[str], only: str | None = None, julia: bool = False, overlays: Iterable[str] = ()) -> str:
    """combined, python, julia or prose, by what the tree holds and what can run here; an error where a wish can't be met."""
    have, overlays = languages & {"python", "julia"}, set(overlays)
    if only is not None:
        if only not in have:
            raise ContractError(f"no input in {only}")
        if only == "julia" and not julia:
            raise ContractError("Julia isn't there")
        if len(have) > 1 and only not in overlays:
            raise ContractError(f"an overlay for {only} is needed")
        return only
    if have == {"python", "julia"}:
        if julia:
            return "combined"
        if "python" not in overlays:
            raise ContractError("an overlay for python is needed where Julia isn't there")
        return "python"
    if have == {"julia"} and not julia:
        raise ContractError("Julia isn't there")
    return next(iter(have), "prose")


def hashes(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, sha256) of files (path, content): the manifest of a tree."""
    return files.select("path", F.sha2(content, 256).alias("sha256"))


def freshness(manifest: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """(path, state) of a tree against the manifest (path, sha256) that was written for it: missing, extra or mismatch."""
    return diff.freshness(manifest, hashes(files, content))


def mirror(docs: DataFrame, root: str, text: str = "text") -> int:
    """Write docs (path, text) as files below ``root``, a folder that all tasks reach as a local path, replacing what was there in one step; gives the number of files.

    The new tree is complete before the old one goes; paths that leave the root are an error before anything is written.
    """
    bad = docs.filter(F.col("path").startswith("/") | F.col("path").rlike("(^|/)\\.\\.(/|$)") | (F.col("path") == "")).select("path").limit(1).collect()
    if bad:
        raise ContractError(f"a path outside the tree: {bad[0]['path']}")
    root = root.rstrip("/")
    staged = f"{root}.staged-{uuid.uuid4().hex}"

    def write(rows: Iterator) -> None:
        for r in rows:
            p = Path(staged, r["path"])
            p.parent.mkdir(parents=True, exist_ok=True)
            tmp = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
            tmp.write_text(r[text] or "", encoding="utf-8")
            os.replace(tmp, p)  # a task that is run again writes the same

    Path(staged).mkdir(parents=True)
    docs.select("path", text).foreachPartition(write)
    old = f"{root}.old-{uuid.uuid4().hex}"
    if os.path.exists(root):
        os.rename(root, old)
    os.rename(staged, root)
    shutil.rmtree(old, ignore_errors=True)
    return sum(len(files) for _, _, files in os.walk(root))
