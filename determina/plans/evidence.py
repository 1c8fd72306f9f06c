"""Refutations from a bounded sample of rows.

Two rows that agree on the columns G and differ on A refute ``X -> A`` for every X
inside G. A few thousand pairs of similar rows refute most of the lattice before the
table is read again. Evidence only ever refutes; what it leaves is tested on all rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from determina.functions import cells
from determina.operators.counts import union_all
from determina.operators.lattice import maximal_only
from determina.sources.staging import stage


class ColumnProfile(NamedTuple):
    ordinal: int
    name: str
    n: int
    n_rows: int
    max_group: int
    has_null: bool


def sample_rows(df: DataFrame, profile: list[ColumnProfile], target: int) -> DataFrame:
    """About ``target`` rows drawn evenly, and about as many more for each column with
    very many values: all rows of those values that fall in one hash slice.

    Even draws from a large table hardly ever hold two rows of the same order or
    user; a slice holds all rows of some. One scan takes both. A table of no more
    than ``target`` rows is taken as it is.
    """
    n_rows = profile[0].n_rows
    if n_rows <= target:
        return df
    # What the source's columns cost to draw, not what they hold: the slices hash.
    slices = n_rows // target
    keep = F.rand(17) < target / n_rows
    for column in profile:
        # Columns with fewer values would have slices of one large group each or none,
        # and a value held by many rows must not bring them all along.
        if column.n >= 8 * slices and column.max_group <= target and column.n < n_rows:
            keep = keep | (F.pmod(F.xxhash64(cells.quoted(column.name)), F.lit(slices)) == 0)
    return df.filter(keep)


def _agreement(ordinals: list[int]) -> str:
    """The mask of columns in which a row equals its predecessor ``p``."""
    return " | ".join(f"if(c{i} <=> p.c{i}, {1 << (i - 1)}L, 0L)" for i in ordinals)


def agree_sets(sample: DataFrame, profile: list[ColumnProfile]) -> DataFrame:
    """``agree BIGINT``: different sets of columns on which neighbours agree.

    The sample is ordered in each column's groups, once with coarse and once with fine
    columns leading, so that neighbours share long runs of values.
    """
    ordinals = [c.ordinal for c in profile]
    by_n = [f"c{c.ordinal}" for c in sorted(profile, key=lambda c: (c.n, c.ordinal))]
    whole = f"struct({', '.join(f'c{i}' for i in ordinals)})"
    parts = []
    for i in ordinals:
        rest = [c for c in by_n if c != f"c{i}"]
        for order in (rest, rest[::-1]):
            before = f"lag({whole}) OVER (PARTITION BY c{i} ORDER BY {', '.join(order)}) AS p"
            parts.append(
                sample.selectExpr("*", before)
                .filter("p IS NOT NULL")
                .selectExpr(f"{_agreement(ordinals)} AS agree")
            )
    return union_all(parts).distinct()


def failures_in_sample(df: DataFrame, profile: list[ColumnProfile], target: int) -> DataFrame:
    """``lhs BIGINT, rhs INT``, staged: maximal left sides seen not to determine a
    right side. ``profile`` names the columns to use."""
    numbered = [cells.quoted(c.name).alias(f"c{c.ordinal}") for c in profile]
    sample = sample_rows(df, profile, target).select(numbered)
    sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # A slice may be unlucky; windows over the sample are for bounded samples only.
        if sample.count() > target * (len(profile) + 1) * 2:
            sample.unpersist()
            even = df.sample(target / profile[0].n_rows, seed=17).select(numbered)
            sample = even.persist(StorageLevel.MEMORY_AND_DISK)
        columns = ", ".join(str(c.ordinal) for c in profile)
        failures = (
            agree_sets(sample, profile)
            .selectExpr("agree AS lhs", f"explode(array({columns})) AS rhs")
            .filter("lhs & shiftleft(1L, rhs - 1) = 0L")
        )
        return stage(maximal_only(stage(failures, "agreements")), "failures")
    finally:
        sample.unpersist()
