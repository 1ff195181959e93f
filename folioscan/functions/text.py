"""Scalar text functions as Spark columns; each has its plain Python twin in ``pytext``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.isspace has it; Java's \s, with or without (?U), is another set.
SPACE = "[\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
MISSING = ["", *"na n/a nan null".split(), "not available"]
LOWER_UNITS = "pu p.u. pa hz h min s ms kg g km m mm bar degc degf".split()
_TAIL_UNIT = "(?:\\(([^()]*)\\)|\\[([^\\[\\]]*)\\])" + SPACE + "*$"
_QUANTITY = "^" + SPACE + "*[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?" + SPACE + "*([%$€£¥°Ωµμa-zA-Z][%$€£¥°Ωµμ·*^./0-9a-zA-Z_-]*)" + SPACE + "*$"
_NUMBER = "^" + SPACE + "*([-+]?[0-9][0-9,]*(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"


def collapse_space(c: Column) -> Column:
    """White space runs become one space, none at either end."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


normalise_text = collapse_space


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def slug(c: Column, fallback: str = "table") -> Column:
    """Lower-case ASCII letters and digits, joined by hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(none_if_empty(s), F.lit(fallback))


def caption_id(c: Column) -> Column:
    """The id in a caption's final ``{#id}``, or null."""
    return none_if_empty(F.regexp_extract(c, "\\{#([a-zA-Z][\\w.:-]*)\\}" + SPACE + "*$", 1))


def strip_caption_id(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "*\\{#([a-zA-Z][\\w.:-]*)\\}" + SPACE + "*$", ""))


def escape_pipe_cell(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_inline(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\|$*_~`\\[\\]<>])", "\\\\$1")


def escape_cell(c: Column) -> Column:
    """HTML entities first, then Markdown signs."""
    h = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(h, "([\\\\|$*_~`\\[\\]])", "\\\\$1")


def looks_like_unit(c: Column) -> Column:
    """Signs that units have, known lower-case units, or a single word with a capital or digit; 32 signs at most."""
    u = collapse_space(c)
    marked = u.rlike("[°%/$€£¥·^]")
    word = ~u.contains(" ") & (F.lower(u).isin(LOWER_UNITS) | u.rlike("[\\p{Lu}\\p{Nd}]"))
    return (u != "") & (F.length(u) <= 32) & (marked | word)


def header_unit(c: Column) -> Column:
    """The unit in a header's final brackets, or null."""
    a, b = F.regexp_extract(c, _TAIL_UNIT, 1), F.regexp_extract(c, _TAIL_UNIT, 2)
    u = collapse_space(F.when(a != "", a).otherwise(b))
    return F.when(looks_like_unit(u), u)


def cell_unit(c: Column) -> Column:
    """The unit that follows a cell's number, or null."""
    return none_if_empty(F.regexp_extract(c, _QUANTITY, 1))


def is_missing(c: Column) -> Column:
    return F.lower(collapse_space(c)).isin(MISSING)


def normalise_label(c: Column) -> Column:
    """A header without its unit, lower case, its words of ASCII letters and digits."""
    bare = F.when(header_unit(c).isNotNull(), F.regexp_replace(c, _TAIL_UNIT, "")).otherwise(c)
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def humanise(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("_"), F.lit(" ")))


def upper_initial(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def lower_initial(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def sentence(c: Column) -> Column:
    """Ends with a full stop unless it ends a sentence already; the empty text stays."""
    s = collapse_space(c)
    return F.when((s == "") | s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def numeric_prefix(c: Column) -> Column:
    """The number at a cell's beginning, thousands separators left out, or null."""
    return none_if_empty(F.replace(F.regexp_extract(c, _NUMBER, 1), F.lit(","), F.lit(""))).cast("double")


def sort_key(c: Column) -> Column:
    """Typed order of cells: numbers, ISO dates, text, missing."""
    iso = F.trim(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    at = F.unix_micros(F.try_to_timestamp(F.replace(F.trim(c), F.lit("Z"), F.lit("+00:00")))) / 1e6
    n = numeric_prefix(c)
    kind = F.when(is_missing(c), 3).when(iso & at.isNotNull(), 1).when(n.isNotNull(), 0).otherwise(2)
    return F.struct(kind.alias("kind"), F.when(kind == 1, at).when(kind == 0, n).otherwise(0.0).alias("number"), F.when(kind == 2, F.lower(F.trim(c))).otherwise("").alias("text"))


def json_string(c: Column) -> Column:
    """A string as Python's json.dumps(ensure_ascii=False) writes it."""
    s = c
    for raw, out in (("\\", "\\\\"), ("\"", "\\\""), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        s = F.replace(s, F.lit(raw), F.lit(out))
    return F.concat(F.lit("\""), s, F.lit("\""))


def lexical_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def semantic_hash(version: str, source_type: Column, context_json: Column, body: Column) -> Column:
    """Identity of a chunk's meaning: reflowed text under the same headings has the same."""
    return F.sha2(F.concat_ws("\u001f", F.lit(version), source_type, context_json, normalise_text(body)), 256)


def a1_column(ref: Column) -> Column:
    """Column number of a cell reference such as AB12."""
    letters = F.regexp_extract_all(F.regexp_extract(ref, "^([A-Z]+)[0-9]+$", 1), F.lit("([A-Z])"), F.lit(1))
    return F.aggregate(letters, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)


def a1_row(ref: Column) -> Column:
    return F.regexp_extract(ref, "^[A-Z]+([0-9]+)$", 1).cast("int")


def a1_label(n: Column) -> Column:
    """Column letters of a number up to 18,278 (three letters; sheets end at 16,384)."""
    one, two, three = (n - 1) % 26, F.floor((n - 27) / 26) % 26, F.floor((n - 703) / 676) % 26
    letter = lambda k: F.chr((k + 65).cast("bigint"))
    return F.concat(F.when(n > 702, letter(three)).otherwise(""), F.when(n > 26, letter(two)).otherwise(""), letter(one))


def page_destination(c: Column) -> tuple[Column, Column]:
    """(path, page) of ``path#page=N``; nulls where it isn't one."""
    page = none_if_empty(F.regexp_extract(c, "^[^#]+#page=([1-9][0-9]*)$", 1)).cast("int")
    return F.when(page.isNotNull(), F.regexp_extract(c, "^([^#]+)#page=", 1)), page


def markdown_link(c: Column) -> Column:
    """Source suffixes of a link become .md, whatever query or anchor follows."""
    return F.regexp_replace(c, "\\.(?:py|jl|qmd)(?=$|[?#])", ".md")


def published_path(c: Column) -> Column:
    return F.regexp_replace(c, "\\.html\\.md$", ".md")


def fence_for(c: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    runs = F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
