"""DataFrames as Markdown tables with semantic metadata, and their first row in words.

Rows are rendered by expressions where they stand; what reaches the driver is the finished
Markdown of one table, which is meant to be read by people: a table beyond ``max_rows`` is
refused rather than cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import text as X
from folioscan.operators.tables import first_row_summary

MAX_ROWS = 100_000
TITLE = "First-row finding"
_ID = re.compile(r"(?a)[A-Za-z][\w.:-]*")
#: A Python format specification such as ".2f" or ",.0f", or a function of Columns.
Formatter = str | Callable[[Column], Column]
Maybe = str | None
Names = Sequence[str] | None
Words = Mapping[str, str] | None
Formats = Mapping[str, Formatter] | None
Order = Sequence[str | Column]


def metadata_comment(**what) -> str:
    """The comment that carries a table's metadata; empty values are left out, and without any there is no comment."""
    said = {k: v for k, v in what.items() if v}
    return f"<!-- knowledge-table: {json.dumps(said, ensure_ascii=False, sort_keys=True)} -->" if said else ""


def general(c: Column) -> Column:
    """Up to six significant digits, as ``%g`` writes them."""
    # rounding to six digits may carry into the next power of ten
    power = F.when(c == 0, 0).otherwise(F.floor(F.log10(F.abs(F.format_string("%.5e", c).cast("double")))))
    fixed = F.lit(None).cast("string")
    for p in range(-4, 6):
        fixed = F.when(power == p, F.format_string(f"%.{5 - p}f", c)).otherwise(fixed)
    trimmed = F.when(F.instr(fixed, ".") > 0, F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", "")).otherwise(fixed)
    science = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", c), "(\\.[0-9]*?)0+e", "$1e"), "\\.e", "e")
    return F.when(F.isnan(c), "not available").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when((power < -4) | (power > 5), science).otherwise(trimmed)


def formatted(c: Column, kind: T.DataType, how: Formatter | None = None) -> Column:
    """A value as text: null and NaN are "not available", midnight timestamps are dates."""
    if callable(how):
        text = how(c).cast("string")
    elif how:
        m = re.fullmatch(r"(,?)(?:\.(\d+))?([fde%]?)", how)
        if not m:
            raise ValueError(f"format {how!r} isn't known; give a function of Columns")
        digits = m.group(2) or ("6" if m.group(3) in "fe%" and m.group(3) else "0")
        if m.group(3) == "d":
            text = F.format_string(f"%{m.group(1)}d", c.cast("bigint"))
        elif m.group(3) == "%":
            text = F.concat(F.format_string(f"%{m.group(1)}.{digits}f", c.cast("double") * 100), F.lit("%"))
        else:
            text = F.format_string(f"%{m.group(1)}.{digits}{m.group(3) or 'f'}", c.cast("double"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = general(c.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        midnight = F.date_trunc("day", c) == c
        text = F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "\\.000000$", ""))
    elif isinstance(kind, T.BooleanType):
        text = F.initcap(c.cast("string"))
    else:
        text = c.cast("string")
    gone = c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()
    return F.when(gone, "not available").otherwise(text)


def _human(name: str) -> str:
    return name.replace("_", " ").strip()


def _checked(df: DataFrame, columns: Sequence[str], **maps: Mapping[str, object]) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise KeyError(f"no such columns: {unknown}")
    for name, m in maps.items():
        if odd := [c for c in m if c not in columns]:
            raise KeyError(f"{name} names columns that aren't shown: {odd}")


def table_lines(df: DataFrame, order_by: Sequence[str | Column], columns: Sequence[str], formats: Mapping[str, Formatter] | None = None) -> DataFrame:
    """(line): a pipe row for each row of ``df``, ordered."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [X.escape_cell(formatted(F.col(f"`{c}`"), kinds[c], (formats or {}).get(c))) for c in columns]
    return df.orderBy(*order_by).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def knowledge_table(
    df: DataFrame, *, table_id: str, order_by: Order, caption: Maybe = None, description: Maybe = None, ordering: Maybe = None, columns: Names = None, row_identity: Names = None,
    labels: Words = None, units: Words = None, formats: Formats = None, summary: bool | Names = False, max_rows: int = MAX_ROWS,
) -> str:
    """One pipe table of a DataFrame in a given order, with its metadata, caption and, if wished, its first row in words."""
    if not _ID.fullmatch(table_id):
        raise ValueError(f"table_id {table_id!r}: a letter first, then letters, digits and _.:-")
    labels, formats, units = dict(labels or {}), dict(formats or {}), dict(units or {})
    shown, identity = list(columns or df.columns), list(row_identity or [])
    _checked(df, shown, labels=labels, formats=formats, units=units)
    _checked(df, identity)
    name = lambda c: labels.get(c, _human(c))
    heads = [name(c) for c in shown]
    if len(set(heads)) < len(heads):
        raise ValueError("labels of shown columns must differ")
    rows = [r["line"] for r in table_lines(df, order_by, shown, formats).limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; use table_lines for tables of that size")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rules = ["---:" if isinstance(kinds[c], T.NumericType) else ":---" for c in shown]
    escape = lambda s: re.sub(r"([\\|$*_~`\[\]])", r"\\\1", s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    comment = metadata_comment(table_id=None if caption is not None else table_id, description=description, ordering=ordering, units={name(c): u for c, u in units.items()}, row_identity=[name(c) for c in identity])
    out = [comment, ""] if comment else []
    out += [f"| {' | '.join(cells)} |" for cells in (map(escape, heads), rules)] + rows + [""]
    if caption is not None:
        out += [": %s {#%s}" % (caption, table_id)]
    if summary is not False:
        out += ["", summarise_first(df, order_by, shown if summary is True else list(summary), labels, units, formats)]
    return "\n".join(out)


def summarise_first(df: DataFrame, order_by: Order, columns: Names = None, labels: Words = None, units: Words = None, formats: Formats = None, prefix: str = TITLE) -> str:
    """The first row by a given order in words."""
    shown = list(df.columns if columns is None else columns)
    _checked(df, shown)
    if not shown:
        return " ".join([f"**{prefix}.**", "No fields were selected."])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    text = df.orderBy(*keys).limit(1).select(*[formatted(F.col(f"`{c}`"), kinds[c], (formats or {}).get(c)).alias(c) for c in shown])
    row = first_row_summary(text, [F.monotonically_increasing_id()], {c: (labels or {}).get(c, _human(c)) for c in shown}, dict(units or {}), prefix).first()
    return row["summary"] if row else " ".join([f"**{prefix}.**", "The table contains no rows."])
