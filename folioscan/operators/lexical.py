"""Full-text search: tokens, postings, BM25 and its query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def fold(c: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters, digits and private-use signs of the folded text."""
    return F.filter(F.split(fold(c), "[^\\p{L}\\p{N}\\p{Co}]+"), lambda t: t != "")


def fold_word(word: str) -> str:
    """The same folding of one word in the driver."""
    return word.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, positions, length) of every term of every text; terms are hashed over the tasks."""
    t = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), F.posexplode("t").alias("at", "term"))
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"), F.first("length").alias("length"))


@dataclass
class Query:
    """A parsed query: an operator with parts, or a leaf."""

    kind: str  # term, prefix, phrase, first, near, and, or, not
    words: list[str] = field(default_factory=list)
    parts: list["Query"] = field(default_factory=list)
    gap: int = 10

    def leaves(self) -> list["Query"]:
        return [self] if self.words else [x for p in self.parts for x in p.leaves()]


class QuerySyntaxError(ValueError):
    """Not of the query language."""


_PIECE = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|(\()|(\))|([^\s()"^*]+)(\*)?|(\^))')


def _words(s: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", fold_word(s)) if w]


def parse(text: str) -> Query:
    """Words (all must match), "phrases", prefix*, ^first, AND, OR, NOT, NEAR(a b, n) and brackets.

    NEAR counts the places of its words that begin a stretch of n + 2 tokens in which they all stand.
    Words with other signs raise QuerySyntaxError, which ``parse_or_phrase`` takes as a wish for
    the quoted phrase; that holds for hyphens and colons too.
    """
    pieces, at = [], 0
    while at < len(text.rstrip()):
        m = _PIECE.match(text, at)
        if m is None:
            raise QuerySyntaxError(text)
        pieces.append(m)
        at = m.end()
    pos = 0

    def peek():
        return pieces[pos] if pos < len(pieces) else None

    def word_is(m, w: str) -> bool:
        return m is not None and m.group(5) == w and not m.group(6)

    def leaf() -> Query:
        nonlocal pos
        m = peek()
        if m is None or m.group(4):
            raise QuerySyntaxError(text)
        pos += 1
        if m.group(3):
            q = either()
            if peek() is None or not peek().group(4):
                raise QuerySyntaxError(text)
            pos += 1
            return q
        if m.group(7):
            q = leaf()
            if q.kind not in ("term", "phrase"):
                raise QuerySyntaxError(text)
            return Query("first", q.words)
        if m.group(1) is not None:
            words = _words(m.group(1))
            return Query("phrase" if len(words) != 1 else "term", words)
        w = m.group(5)
        if w == "NEAR" and peek() is not None and peek().group(3):
            pos += 1
            parts, gap = [], 10
            while peek() is not None and not peek().group(4):
                if peek().group(5) and re.fullmatch(r".*,\d*|,|\d+", peek().group(5)) and parts:
                    inner = peek().group(5)
                    pos += 1
                    name, _, n = inner.rpartition(",") if "," in inner else ("", "", inner)
                    if name:
                        parts.append(Query("term", _words(name)))
                    gap = int(n) if n else gap
                else:
                    parts.append(leaf())
            if peek() is None:
                raise QuerySyntaxError(text)
            pos += 1
            return Query("near", [w for p in parts for w in p.words], gap=gap)
        if w in ("AND", "OR", "NOT") or not re.fullmatch(r"[\w]+", w):
            raise QuerySyntaxError(text)
        words = _words(w)
        if not words:
            raise QuerySyntaxError(text)
        if m.group(6):
            return Query("prefix", words)
        return Query("term" if len(words) == 1 else "phrase", words)

    def without() -> Query:
        nonlocal pos
        q = leaf()
        while word_is(peek(), "NOT"):
            pos += 1
            q = Query("not", parts=[q, leaf()])
        return q

    def both() -> Query:
        nonlocal pos
        parts = [without()]
        while peek() is not None and not peek().group(4) and not word_is(peek(), "OR"):
            if word_is(peek(), "AND"):
                pos += 1
            parts.append(without())
        return parts[0] if len(parts) == 1 else Query("and", parts=parts)

    def either() -> Query:
        nonlocal pos
        parts = [both()]
        while word_is(peek(), "OR"):
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Query("or", parts=parts)

    q = either()
    if pos != len(pieces):
        raise QuerySyntaxError(text)
    return q


def parse_or_phrase(text: str) -> tuple[Query, bool]:
    """The query, and whether it had to be taken as a phrase."""
    try:
        return parse(text), False
    except QuerySyntaxError:
        return Query("phrase", _words(text)), True


def _frequency(leaf: Query) -> Column:
    """How often a leaf occurs in the column ``t`` of tokens."""
    t = F.col("t")
    if leaf.kind == "term":
        return F.size(t) - F.size(F.array_remove(t, leaf.words[0]))
    if leaf.kind == "prefix":
        return F.size(F.filter(t, lambda x: x.startswith(leaf.words[0])))
    n = len(leaf.words)
    if not n:
        return F.lit(0)
    if leaf.kind == "first":
        return F.when(F.slice(t, 1, n) == F.array(*map(F.lit, leaf.words)), 1).otherwise(0)
    if leaf.kind == "phrase":  # every token with a space on either side, so that matches may overlap
        return F.regexp_count(F.concat(F.lit(" "), F.array_join(t, "  "), F.lit(" ")), F.lit("(?= " + "  ".join(leaf.words) + " )"))
    words = list(dict.fromkeys(leaf.words))  # one pass from the end; the state has the latest place of each word
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("count"), *[F.lit(None).cast("int").alias(f"p{k}") for k in range(len(words))])

    def step(a, x):
        i = a["i"] + 1
        at = [F.when(x == w, i).otherwise(a[f"p{k}"]) for k, w in enumerate(words)]
        all_there = reduce(lambda u, v: u & v, [p.isNotNull() for p in at])
        first = F.array_min(F.array(*at))
        hit = x.isin(words) & all_there & (i - first <= leaf.gap + 1)
        return F.struct(i.alias("i"), (a["count"] + F.when(hit, 1).otherwise(0)).alias("count"), *[p.alias(f"p{k}") for k, p in enumerate(at)])

    return F.aggregate(F.reverse(t), start, step, lambda a: a["count"])


def _holds(q: Query, names: dict[int, str]) -> Column:
    if q.words or q.kind in ("term", "phrase", "prefix", "first", "near"):
        return F.col(names[id(q)]) > 0
    parts = [_holds(p, names) for p in q.parts]
    if q.kind == "and":
        return reduce(lambda a, b: a & b, parts)
    return reduce(lambda a, b: a | b, parts) if q.kind == "or" else parts[0] & ~parts[1]


def bm25(docs: DataFrame, query: Query | str, key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(key, score) of all matches, best (least) first in value; statistics are those of the whole corpus, ``where`` only chooses candidates.

    A task counts each leaf in its own texts; one row of statistics is all that is exchanged.
    """
    q = parse_or_phrase(query)[0] if isinstance(query, str) else query
    leaves = [x for x in q.leaves()] or [q]
    names = {id(x): f"tf{i}" for i, x in enumerate(leaves)}
    extra = [] if where is None else [where.alias("chosen")]
    base = docs.select(key, tokens(F.col(text)).alias("t"), *extra).select(key, F.size("t").alias("dl"), *[_frequency(x).alias(names[id(x)]) for x in leaves], *[c for c in (["chosen"] if extra else [])])
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(names[id(x)]) > 0, 1).otherwise(0)).alias(f"df_{names[id(x)]}") for x in leaves])
    hits = base.filter(_holds(q, names))
    hits = hits.filter("chosen") if extra else hits
    scored = hits.crossJoin(F.broadcast(stats))  # one row

    def part(name: str) -> Column:
        tf, df = F.col(name), F.col(f"df_{name}")
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    negated = {id(y) for p in _negated(q) for y in p.leaves()}  # by identity: the same words may stand on both sides
    positive = [names[id(x)] for x in leaves if id(x) not in negated]
    return scored.select(key, (-reduce(lambda a, b: a + b, map(part, positive))).alias("score"))


def _negated(q: Query) -> list[Query]:
    if q.kind == "not":
        return [q.parts[1], *_negated(q.parts[0])]
    return [x for p in q.parts for x in _negated(p)]


def top(scored: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The ``limit`` best with their rank, ties by key."""
    from pyspark.sql import Window as W

    best = scored.orderBy("score", key).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy("score", key)))
