"""Delimited text in, FD text out."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from determina.functions import cells, masks


def read_delimited(
    spark: SparkSession,
    path: str,
    width: int | None = None,
    separator: str = ",",
    quote: str = '"',
    distinct: bool = True,
) -> DataFrame:
    """A headerless delimited file as a table of strings ``c0, c1, ..``.

    Blanks count, and an empty cell is an empty string equal to every other empty
    cell. Quoted separators stay in their cell. A row shorter than the table is
    filled with empty cells, so no cell is lost: without ``width`` the table is as wide
    as the widest line, found by one aggregate over the file, and with a ``width`` a
    wider line is an error. Repeated rows are dropped unless ``distinct=False``.
    """
    options = {
        "sep": separator, "quote": quote, "escape": quote, "mode": "PERMISSIVE",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    lines = spark.read.text(path)
    here = cell_count(F.col("value"), separator, quote)
    if width is None:
        width = _largest(lines, here)
    # Parsed line by line, since the csv reader leaves out blank lines.
    schema = cells.numbered_schema(width, T.StringType())
    row = F.from_csv(_not_wider(here, width), schema.toDDL(), options).alias("row")
    df = lines.select(row).select("row.*").fillna("")
    return df.dropDuplicates() if distinct else df


def read_split_lines(
    spark: SparkSession, path: str, drop: Iterable[int] = (), width: int | None = None,
    separator: str = ",",
) -> DataFrame:
    """Lines split on the separator alone (quotes are text), less the columns whose
    numbers are in ``drop``. Without ``width`` the table is as wide as the widest line;
    with one, a wider line is an error."""
    lines = spark.read.text(path)
    here = F.size(cells.split_cells(F.col("value"), separator))
    if width is None:
        width = _largest(lines, here)
    parts = cells.split_cells(_not_wider(here, width), separator)
    dropped = set(drop)
    return lines.select(parts.alias("parts")).select(
        [
            F.coalesce(F.get(F.col("parts"), F.lit(i)), F.lit("")).alias(f"c{i}")
            for i in range(width)
            if i + 1 not in dropped
        ]
    )


def cell_count(line: Column, separator: str, quote: str) -> Column:
    """Cells of a delimited line: separators outside of quoted cells, and one. A quote
    that is never closed hides nothing, so the count is never too small."""
    s, q = re.escape(separator), re.escape(quote)
    quoted = rf"(^|{s}){q}(?:[^{q}]|{q}{q})*{q}"
    bare = F.regexp_replace(line, quoted, "$1")
    return F.size(cells.split_cells(bare, separator))


def _largest(lines: DataFrame, count: Column) -> int:
    (width,) = lines.agg(F.max(count)).first()
    if not width:
        raise ValueError("the file has no lines to count columns in; give a width")
    return width


def _not_wider(count: Column, width: int) -> Column:
    """The line, or an error if it would lose cells."""
    message = F.concat(F.lit(f"a line has more than {width} cells: "), F.substring("value", 1, 200))
    return F.when(count > width, F.raise_error(message)).otherwise(F.col("value"))


def fd_lines(fds: DataFrame) -> DataFrame:
    """One text line per left side, e.g. ``[column1,column4]:column2,column7``.

    Takes ``lhs ARRAY<INT>, rhs INT``.
    """
    return (
        fds.select(F.array_sort("lhs").alias("lhs"), "rhs")
        .groupBy("lhs")
        .agg(F.collect_set("rhs").alias("rhs"))
        .select(
            F.concat(
                F.lit("["), masks.labels(F.col("lhs")), F.lit("]:"), masks.labels(F.col("rhs"))
            ).alias("value")
        )
    )


def write_fds(fds: DataFrame, path: str) -> None:
    """Write FDs as text lines to a new folder."""
    fd_lines(fds).write.text(path)


def line_widths(lines: DataFrame, separator: str = ",") -> DataFrame:
    """``width INT, n_rows BIGINT``: how many lines have how many cells. A table has
    one width; more than one means ragged lines. Takes ``value STRING``."""
    return (
        lines.select(F.size(cells.split_cells(F.col("value"), separator)).alias("width"))
        .groupBy("width")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
