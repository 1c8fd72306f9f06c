"""Table operators: projection, duplicates, vocabulary, set operations on FD tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.functions import cells


def project_excluding(df: DataFrame, drop: Iterable[int]) -> DataFrame:
    """The table without the columns whose numbers are in ``drop``."""
    dropped = set(drop)
    return df.select(
        [cells.quoted(n) for i, n in enumerate(df.columns, 1) if i not in dropped]
    )


def project_distinct(df: DataFrame, drop: Iterable[int]) -> DataFrame:
    """As ``project_excluding``, repeated rows removed."""
    return project_excluding(df, drop).distinct()


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def vocabulary(df: DataFrame) -> DataFrame:
    """Every different cell of a table as text, with the number of cells holding it.

    Each column is counted by itself before the columns are put together, so what is
    shuffled is the different words per column and not the cells. One missing cell
    counts as a word like any other.
    """
    per_column = None
    for name in df.columns:
        words = (
            df.select(cells.quoted(name).cast("string").alias("word"))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        per_column = words if per_column is None else per_column.unionByName(words)
    return per_column.groupBy("word").agg(F.sum("n").alias("n"))


def fd_difference(fds: DataFrame, other: DataFrame) -> DataFrame:
    """FDs of the first table that are not in the second."""
    return fds.join(other.select("lhs", "rhs"), ["lhs", "rhs"], "left_anti")


def fd_union(fds: DataFrame, other: DataFrame) -> DataFrame:
    """FDs in either table, each once."""
    return fds.select("lhs", "rhs").unionByName(other.select("lhs", "rhs")).distinct()
