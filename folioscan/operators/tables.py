"""Checks and text of tables that are DataFrames: the relational half of table normalisation.

``normalise`` does the same for tables found in documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import text as X


def duplicate_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, duplicates): rows beyond the first of each distinct combination."""
    n = df.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*by).agg(F.sum(F.col("__n") - 1).alias("duplicates"))


def duplicate_ordinals(df: DataFrame, by: Sequence[str], ordinal: str) -> DataFrame:
    """(by, duplicate_rank): whether a value of the ordinal column recurs in its table."""
    n = df.filter(F.col(ordinal).isNotNull()).groupBy(*by, ordinal).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*by).agg((F.max("__n") > 1).alias("duplicate_rank"))


def nonmonotonic(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, nonmonotonic): whether the numbers fall anywhere in the given order."""
    step = df.withColumn("__p", F.lag(value).over(W.partitionBy(*by).orderBy(order)))
    return step.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("__p") > F.col(value)), F.lit(False)).alias("nonmonotonic"))


def ordering_mismatch(df: DataFrame, by: Sequence[str], position: str, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """(by, mismatch): whether stable sorting by (column, ascending or descending) would move any row; missing values come last either way."""
    order = []
    for c, direction in keys:
        order += [F.col(c).asc_nulls_last() if direction == "ascending" else F.col(c).desc_nulls_last()]
    want = F.row_number().over(W.partitionBy(*by).orderBy(*order, position))
    have = F.row_number().over(W.partitionBy(*by).orderBy(position))
    return df.select(*by, (want != have).alias("__m")).groupBy(*by).agg(F.bool_or("__m").alias("mismatch"))


def duplicate_identity(df: DataFrame, by: Sequence[str], identity: Sequence[str], row_number: str) -> DataFrame:
    """(by, row, first_row): rows whose identity an earlier row has; rows with a missing part aren't compared."""
    w = W.partitionBy(*by, *identity).orderBy(row_number)
    first = df.filter(~F.greatest(*[F.col(c).isNull() for c in identity], F.lit(False))).withColumn("first_row", F.first(row_number).over(w))
    return first.filter(F.col("first_row") < F.col(row_number)).select(*by, F.col(row_number).alias("row"), "first_row")


def mixed_units(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, units, mixed): distinct units that cells state, in order of their lower case."""
    u = cells.select(*by, X.cell_unit(F.col(value)).alias("u")).filter("u is not null")
    got = u.groupBy(*by).agg(F.array_sort(F.collect_set(F.lower("u"))).alias("units"))
    return got.select(*by, F.array_join("units", ", ").alias("units"), (F.size("units") > 1).alias("mixed"))


def second_ids(tables: DataFrame, document: str, table_id: str, order: str) -> DataFrame:
    """Rows of tables whose id an earlier table of the document has."""
    return tables.withColumn("__k", F.row_number().over(W.partitionBy(document, table_id).orderBy(order))).filter("__k > 1").drop("__k")


def pipe_row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[X.escape_pipe_cell(c) for c in cells]), F.lit(" |"))


def row_payload(headers: Sequence[str], cells: Sequence[Column], identity: bool = False) -> Column:
    """The description that a row id hashes: header and value pairs, as Python's json.dumps writes them."""
    pairs = [F.concat(F.lit("["), X.json_string(F.lit(h)), F.lit(", "), X.json_string(c), F.lit("]")) for h, c in zip(headers, cells)]
    return F.concat(F.lit('{"identity": [' if identity else '{"row": ['), F.concat_ws(", ", *pairs), F.lit("]}"))


def row_id(table_id: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{table_id}:row-"), F.substring(F.sha2(payload, 256), 1, 16))


def row_text(name: Column, headers: Sequence[str], cells: Sequence[Column], units: Mapping[str, str] | None = None) -> Column:
    """The sentence of a row: its name, then header and value; a declared unit follows values that state none."""
    fields = []
    for h, c in zip(headers, cells):
        missing = F.coalesce(X.is_missing(c), F.lit(True))
        value = F.when(missing, "not available").otherwise(c)
        unit = (units or {}).get(h)
        if unit and unit not in h:
            value = F.when(~missing & X.cell_unit(c).isNull(), F.concat(value, F.lit(f" {unit}"))).otherwise(value)
        fields.append(F.concat(F.lit(f"{h}: "), value))
    return X.sentence(F.concat(name, F.lit(". "), F.concat_ws("; ", *fields)))


def first_row_summary(df: DataFrame, order_by: Sequence[Column | str], labels: Mapping[str, str], units: Mapping[str, str] | None = None, prefix="First-row finding") -> DataFrame:
    """(summary): the first row by a given order in words; columns must be strings."""
    row = df.orderBy(*order_by).limit(1)
    value = lambda c: X.escape_inline(F.when(X.is_missing(F.col(c)) | F.col(c).isNull(), "not available").otherwise(F.concat(F.col(c), F.lit(f" {units[c]}")) if units and c in units else F.col(c)))
    names = list(labels)
    if len(names) == 1:
        label = labels[names[0]]
        return row.select(F.concat(F.lit(f"**{prefix}.** {label[:1].upper()}{label[1:]} is **"), value(names[0]), F.lit("**.")).alias("summary"))
    parts = [F.concat(F.lit(f"{labels[c][:1].lower()}{labels[c][1:]} is **"), value(c), F.lit("**")) for c in names[1:]]
    if len(parts) > 2:
        said = F.concat(F.concat_ws(", ", *parts[:-1]), F.lit(", and "), parts[-1])
    else:
        said = F.concat_ws(" and ", *parts)
    return row.select(F.concat(F.lit(f"**{prefix}.** For **"), value(names[0]), F.lit("**, "), said, F.lit(".")).alias("summary"))
