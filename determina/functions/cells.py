"""Row and cell expressions: keys, arrays, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sql_name(name: str) -> str:
    """A column name for use in SQL text, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col(sql_name(name))


def names_at(df: DataFrame, ordinals: Sequence[int]) -> list[str]:
    """Column names for 1-based numbers."""
    columns = df.columns
    for i in ordinals:
        if not 1 <= i <= len(columns):
            raise ValueError(f"there is no column {i}; the table has {len(columns)}")
    return [columns[i - 1] for i in ordinals]


def composite_key(names: Sequence[str]) -> Column:
    """One key for several columns. A struct keeps values apart ('a b'+'c' is not
    'a'+'b c') and keeps nulls, so equal keys mean equal cells."""
    return F.struct(*[quoted(n) for n in names])


def row_array(df: DataFrame) -> Column:
    """The row as an array indexed by column position. All columns need one type."""
    return F.array(*[quoted(n) for n in df.columns])


def split_cells(line: Column, separator: str = ",") -> Column:
    """The cells of a line, trailing empty cells kept."""
    pattern = "".join("\\" + ch if not ch.isalnum() else ch for ch in separator)
    return F.split(line, pattern, -1)


def join_cells(df: DataFrame, separator: str = ",") -> Column:
    """A row as one line; a null cell is an empty cell."""
    return F.concat_ws(
        separator, *[F.coalesce(quoted(n).cast("string"), F.lit("")) for n in df.columns]
    )


def numbered_schema(width: int, kind: T.DataType | None = None) -> T.StructType:
    """Nullable fields ``c0 .. c<width-1>``, integers unless another type is given."""
    kind = kind or T.IntegerType()
    return T.StructType([T.StructField(f"c{i}", kind, True) for i in range(width)])


def cast_all(df: DataFrame, kind: T.DataType | str) -> DataFrame:
    """Every column in the given type."""
    return df.select([quoted(n).cast(kind).alias(n) for n in df.columns])
