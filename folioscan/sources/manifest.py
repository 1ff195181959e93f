"""Manifests: which files belong to a corpus."""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".xlsx": "workbook", ".xlsm": "workbook"}


class ManifestError(ValueError):
    """A manifest that isn't valid."""


@dataclass
class Rules:
    """Explicit paths and globs, in order of first mention; origins name where a rule comes from."""

    explicit: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    origins: dict[str, str] = field(default_factory=dict)

    def selects(self, path: str) -> bool:
        """Named or included, and not excluded."""
        return (path in self.explicit or any(matches(path, g) for g in self.include)) and not any(matches(path, g) for g in self.exclude)

    def column(self, path: Column) -> Column:
        """The same as an expression."""
        yes = path.isin(self.explicit) if self.explicit else F.lit(False)
        for g in self.include:
            yes = yes | glob_column(path, g)
        for g in self.exclude:
            yes = yes & ~glob_column(path, g)
        return yes


def _variants(glob: str) -> list[str]:
    return [glob, glob.replace("**/", "")] if "**/" in glob else [glob]


def matches(path: str, glob: str) -> bool:
    """Case-sensitive; ``*`` crosses slashes; ``**/`` may stand for nothing."""
    return any(fnmatch.fnmatchcase(path, g) for g in _variants(glob))


def glob_column(path: Column, glob: str) -> Column:
    """``matches`` as an expression, by the regular expression that the glob means."""
    out = None
    for g in _variants(glob):
        body = fnmatch.translate(g)
        body = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", body, flags=re.S)
        one = path.rlike("(?s)^(?:" + re.sub(r"\(\?>(.*?)\)", r"(?:\1)", body) + ")$")
        out = one if out is None else out | one
    return out


def relative(value: str, glob: bool = False) -> str:
    """A declared path in normal form; absolute paths, escapes and, without ``glob``, wild cards are errors."""
    v = value.replace("\\", "/").strip()
    if not v or v.startswith("/") or re.match(r"^[A-Za-z]:", v):
        raise ManifestError(f"not a relative path: {value!r}")
    if glob:
        if ".." in v.split("/"):
            raise ManifestError(f"path leaves the root: {value!r}")
        return v
    if any(c in v for c in "*?["):
        raise ManifestError(f"a glob where a path belongs: {value!r}")
    v = posixpath.normpath(v)
    if v == ".." or v.startswith("../"):
        raise ManifestError(f"path leaves the root: {value!r}")
    return v


def source_type(path: str) -> str:
    kind = SUFFIXES.get(posixpath.splitext(path)[1].lower())
    if kind is None:
        raise ManifestError(f"unsupported source: {path}")
    return kind


def load(path: str | Path) -> Rules:
    """Rules of one TOML file: schema_version 1 and arrays source (path), include and exclude (glob), each with an optional origin."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    if data.pop("schema_version", None) != 1:
        raise ManifestError(f"{path}: schema_version must be 1")
    r = Rules()
    for name, key, out in (("source", "path", r.explicit), ("include", "glob", r.include), ("exclude", "glob", r.exclude)):
        for entry in data.pop(name, []):
            unknown = set(entry) - {key, "origin"}
            if unknown or not isinstance(entry.get(key), str):
                raise ManifestError(f"{path}: [[{name}]] takes {key} and origin, not {sorted(unknown)}")
            value = relative(entry[key], glob=name != "source")
            if name == "source":
                source_type(value)
            if value not in out:
                out.append(value)
            r.origins.setdefault(value, entry.get("origin", "local"))
    if data:
        raise ManifestError(f"{path}: unknown keys {sorted(data)}")
    return r


def merge(rules: list[Rules]) -> Rules:
    """One after the other; what is mentioned first stays, but for the origin ``local``, which wins."""
    out = Rules()
    for r in rules:
        for mine, theirs in ((out.explicit, r.explicit), (out.include, r.include), (out.exclude, r.exclude)):
            mine.extend(x for x in theirs if x not in mine)
        for k, v in r.origins.items():
            if k not in out.origins or v == "local":
                out.origins[k] = v
    return out


def report(paths: DataFrame, rules: Rules) -> DataFrame:
    """(kind, value) of discovered paths (path) by rules: available, excluded (found, but excluded), missing (explicit, not found) and unmatched (a glob that fits nothing)."""
    spark = paths.sparkSession
    p = paths.select("path").distinct()
    out = p.filter(rules.column(F.col("path"))).select(F.lit("available").alias("kind"), F.col("path").alias("value"))
    gone = F.lit(False)
    for g in rules.exclude:
        gone = gone | glob_column(F.col("path"), g)
    out = out.union(p.filter(gone).select(F.lit("excluded"), "path"))
    named = spark.createDataFrame([(x,) for x in rules.explicit], "path string")
    out = out.union(named.join(p, "path", "left_anti").select(F.lit("missing"), "path"))
    # one pass over the paths for all globs
    fits = p.agg(*[F.coalesce(F.bool_or(glob_column(F.col("path"), g)), F.lit(False)).alias(f"g{i}") for i, g in enumerate(rules.include)] or [F.lit(True).alias("none")])
    globs = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"g{i}").alias("fits")) for i, g in enumerate(rules.include)])).alias("x") if rules.include else None
    return out if globs is None else out.union(fits.select(globs).filter("not x.fits").select(F.lit("unmatched"), "x.g"))


def discover(spark: SparkSession, root: str, rules: Rules) -> DataFrame:
    """(path, source_type, sha256, size_bytes, mtime, content) of the selected files below ``root``; content is read where a query needs it. Links in a local tree aren't followed."""
    if "://" not in root:  # of a local tree, what a link leads to may stand outside it
        root = os.path.realpath(root)
        links = [os.path.relpath(os.path.join(d, n), root) for d, ds, fs in os.walk(root) for n in [*ds, *fs] if os.path.islink(os.path.join(d, n))]
    else:
        links = []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root else "file:" + str(Path(root).resolve())
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/+", "file:/"), "^" + re.escape(re.sub(r"^file:/+", "file:/", base.rstrip("/"))) + "/", "")
    f = files.select(rel.alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    suffix = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix]
    for link in links:
        f = f.filter((F.col("path") != link) & ~F.col("path").startswith(link + "/"))
    return f.filter(kind.isNotNull() & rules.column(F.col("path"))).select("path", kind.alias("source_type"), F.sha2("content", 256).alias("sha256"), "size_bytes", "mtime", "content")
