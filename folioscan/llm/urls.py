"""URL filter: logistic regression on hashed character n-grams of host and path.

Host and path (lower case, digits as 0, without scheme, user, port, query and fragment) give
n-grams of 3 to 5 signs, hashed with the part they stand in to ``2**BITS`` weights. The model is
fitted in the driver to a small labelled table of (url, block), by default ``seed_table()``, six hundred
that were labelled by hand; 2 MB of weights go to the workers.

Defined cases: a null or blank url has a null probability and isn't blocked; labels that are null
or whose url is null aren't used; without labels of both kinds nothing is blocked; a url without
a scheme or path is read as far as it goes; rows that repeat are judged alike; an empty table
gives an empty result; further columns pass unchanged through the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A url goes from 0.7 on, where one allowed url in twenty of the seed table does if it is held out.
BITS, SIZES, THRESHOLD, MAX_ROWS = 18, (3, 4, 5), 0.7, 50_000
_SPLIT = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)(?::\d*)?([^?#]*)")

#: Hosts and paths of both kinds, labelled by hand: gambling, adult sites, pill shops, advertising, fraud and the like
#: against the press, schools, libraries, clubs and shops, many of which hold the same letters ("essex", "cheapside", "poker-face").
TABLE = Path(__file__).with_name("url_labels.tsv")


def seed_table(path: Path = TABLE) -> list[tuple[str, int]]:
    """The labelled urls of a file: block (0 or 1) and url, parted by a tab, below a header."""
    rows = [line.split("\t") for line in path.read_text(encoding="utf-8").splitlines()[1:] if line.strip()]
    return [(url, int(block)) for block, url in rows]


def parts(url: str) -> tuple[str, str]:
    """Host and path as the model reads them."""
    m = _SPLIT.match(url.strip().lower())
    host, path = m.group(1), m.group(2)
    return re.sub(r"\d", "0", host), re.sub(r"\d", "0", path)


def hashed(urls: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all n-grams of all urls, and offsets of each url; a url has at least the one of its bounds."""
    pieces, spans = [], [0]
    for u in urls:
        host, path = parts(u)
        pieces += [f"^{host}$", f"{path}$"]
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    start = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in raw], out=start[1:])
    a = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), np.diff(start))
    keys, who = [], []
    for n in SIZES:
        if len(a) < n:
            continue
        h = np.zeros(len(a) - n + 1, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + a[i : len(a) - n + 1 + i] + np.uint64(1)
        inside = owner[: len(h)] == owner[n - 1 :]
        h, o = h[inside], owner[: len(h)][inside]
        h = (h * np.uint64(4) + (o % 2).astype(np.uint64) + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((h >> np.uint64(64 - bits)).astype(np.int64))
        who.append(o // 2)
    if not keys:
        return np.empty(0, dtype=np.int64), np.zeros(len(urls) + 1, dtype=np.int64)
    key, url = np.concatenate(keys), np.concatenate(who)
    order = np.argsort(url, kind="stable")
    spans = np.searchsorted(url[order], np.arange(len(urls) + 1))
    return key[order], spans


def fit(rows: list[tuple[str, int]], bits: int = BITS, ridge: float = 1e-3, rounds: int = 100, rate: float = 0.5) -> tuple[np.ndarray, float] | None:
    """Weights and bias by full-batch gradient steps scaled to each weight's own past (Adagrad); None without both kinds."""
    y = np.array([b for _, b in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    key, off = hashed([u for u, _ in rows], bits)
    owner = np.repeat(np.arange(len(rows)), np.diff(off))
    used, key = np.unique(key, return_inverse=True)
    w, bias, past, past_b = np.zeros(len(used)), 0.0, np.full(len(used), 1e-6), 1e-6
    kind = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both kinds weigh the same
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(owner, weights=w[key], minlength=len(rows)) + bias)))
        e = (p - y) * kind
        g = np.bincount(key, weights=e[owner], minlength=len(used)) + ridge * w / len(used)
        past += g * g
        past_b += e.sum() ** 2
        w -= 0.1 * rate * g / np.sqrt(past)
        bias -= 0.1 * rate * e.sum() / np.sqrt(past_b)
    full = np.zeros(1 << bits)
    full[used] = w
    return full, bias


def predict(model: tuple[np.ndarray, float] | None, urls: list[str | None], bits: int = BITS) -> list[float | None]:
    """Probability that each url is to be blocked."""
    there = [i for i, u in enumerate(urls) if u is not None and u.strip()]
    out: list[float | None] = [None] * len(urls)
    if model is None:
        for i in there:
            out[i] = 0.0
        return out
    key, off = hashed([urls[i] for i in there], bits)
    total = np.concatenate(([0.0], np.cumsum(model[0][key])))
    for i, z in zip(there, total[off[1:]] - total[off[:-1]] + model[1]):
        out[i] = float(1 / (1 + np.exp(-z)))
    return out


def labels_of(spark: SparkSession, table: DataFrame | None, max_rows: int) -> list[tuple[str, int]]:
    """The labelled rows: ``table`` (url, block), of which at most ``max_rows`` by least hash are used, or the seed table."""
    if table is None:
        return seed_table()
    few = table.filter("url is not null and block is not null").select("url", F.col("block").cast("int").alias("block")).orderBy(F.xxhash64("url"), "url", "block").limit(max_rows)
    return [(r["url"], r["block"]) for r in few.collect()]


def _column(model, bits: int):
    @F.arrow_udf("double")
    def score(parts_: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts_:
            yield pa.array(predict(model, part.to_pylist(), bits), type=pa.float64())

    return score


def url_scores(pages: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(page_id, url, probability, blocked) of every row."""
    model = fit(labels_of(pages.sparkSession, labels, max_rows))
    p = pages.select("page_id", "url", F.round(_column(model, BITS)("url"), 9).alias("probability"))
    return p.withColumn("blocked", F.coalesce(F.col("probability") >= threshold, F.lit(False)))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``pages`` that aren't blocked."""
    cols = [F.col(f"`{c}`") for c in pages.columns]
    model = fit(labels_of(pages.sparkSession, labels, max_rows))
    p = pages.withColumn("__fs_p", _column(model, BITS)("url"))
    return p.filter(F.col("__fs_p").isNull() | (F.col("__fs_p") < threshold)).select(*cols)
