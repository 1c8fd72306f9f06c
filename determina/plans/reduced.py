"""What every search over a reduced table shares: before it, constants and all but one of each class of
equivalent columns leave; after it, they come back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.functions import cells, masks
from determina.operators import classes, counts
from determina.sources.staging import scratch, stage, stage_result

PAIRS = "lhs bigint, rhs int"

#: rows, column counts (ordinal, n), one-column FDs (lhs mask, rhs) -> minimal FDs (lhs mask, rhs)
Search = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def numbered_columns(df: DataFrame, columns: Sequence[str] | None, as_text: bool) -> DataFrame:
    """Some columns or all, named by their number: names may repeat, as after a join."""
    if columns is not None:
        df = df.select([cells.quoted(c) for c in columns])
    if not df.columns:
        raise ValueError("the table has no columns")
    df = df.toDF(*[f"c{i}" for i in range(1, len(df.columns) + 1)])
    return cells.cast_all(df, "string") if as_text else df


def search_reduced(
    df: DataFrame, search: Search, columns: Sequence[str] | None = None, constants: str = "strict",
    as_text: bool = False, stage_input: bool = False,
) -> DataFrame:
    """``lhs ARRAY<INT>, rhs INT``: what a search finds among the columns that vary and differ, with
    equivalents and constants put back. All steps are tables of a row per column or FD."""
    df = numbered_columns(df, columns, as_text)
    width = len(df.columns)
    with scratch(df.sparkSession):
        if stage_input:
            df = stage(df, "input")
        sizes = stage(counts.column_counts(df), "columns")
        singles = stage(classes.single_fds(df), "singles")
        members = stage(classes.equivalence_classes(singles), "classes")
        mapping = stage(classes.reduced_columns(sizes, members), "mapping")
        kept = sorted((r.new_ord, r.old_ord) for r in mapping.collect())
        if len(kept) > masks.MAX_COLUMNS:
            raise ValueError(f"{len(kept)} columns vary and differ; this search handles {masks.MAX_COLUMNS}")
        fds = counts.local_table(df.sparkSession, [], PAIRS)
        if len(kept) > 1:
            rows = df.select([f"c{old}" for _, old in kept])
            own = mapping.select(F.col("new_ord").alias("ordinal"), "n")
            fds = stage(search(rows, own, classes.restated_fds(singles, mapping)), "minimal")
        longest = fds.agg(F.max(masks.size(F.col("lhs")))).first()[0] or 0
        constant = counts.constant_columns(sizes)
        return stage_result(classes.recover(fds, mapping, members, constant, width, longest, constants), "fds")
