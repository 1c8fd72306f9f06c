"""Tests of functional dependencies.

``X -> A`` holds when rows equal on X are equal on A. Two tests:

* the count test compares the number of different X with that of different X + A;
* the group test looks whether A has one value in each group of X.

The group test answers for many left sides and all their right sides in one scan and
one shuffle. Right sides of a fixed-width type compare their own minimum and maximum;
texts compare those of a 64-bit hash, which keeps the aggregation in hash tables.
Unequal hashes prove unequal texts, so a refutation is final; equal hashes prove
nothing, and such right sides are left to the count test.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from determina.functions import cells, masks
from determina.operators import counted, counts
from determina.operators.counts import batches, column_counts, local_table, set_count, union_all

_FIXED_WIDTH = (
    T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
    T.DayTimeIntervalType,
)


class Test(NamedTuple):
    """A left side and all right sides asked of it, as masks."""

    lhs: int
    rhs: int


def is_fixed_width(kind: T.DataType) -> bool:
    return isinstance(kind, _FIXED_WIDTH)


def is_hashable_text(kind: T.DataType) -> bool:
    """Texts and bytes whose equality is that of their bytes."""
    return isinstance(kind, T.BinaryType) or (
        isinstance(kind, T.StringType) and kind.simpleString() == "string"
    )


def _spread(df: DataFrame, ordinal: int, nullable: bool) -> tuple[str, list[str], str]:
    """What to carry of a right side, its aggregates over a group and, from them,
    whether the group is *seen* to hold two values. Types with neither a minimum nor a
    byte hash are never seen to."""
    field = df.schema[ordinal - 1]
    value = cells.sql_name(field.name)
    carried, lo, hi, gap = (f"{w}{ordinal}" for w in ("r", "lo", "hi", "gap"))
    spread = [f"min({carried}) AS {lo}", f"max({carried}) AS {hi}"]
    if is_fixed_width(field.dataType):
        if not nullable:
            return f"{value} AS {carried}", spread, f"{lo} <> {hi}"
        spread.append(f"max({carried} IS NULL) AS {gap}")
        split = f"coalesce({lo} <> {hi}, false) OR ({gap} AND {lo} IS NOT NULL)"
        return f"{value} AS {carried}", spread, split
    if is_hashable_text(field.dataType):
        return f"xxhash64({value}) AS {carried}", spread, f"{lo} <> {hi}"
    return f"0 AS {carried}", [], "false"


def group_shapes(
    df: DataFrame,
    tests: Sequence[Test],
    not_null: Iterable[int] = (),
    slices: int = 1,
    watched: int = 0,
) -> DataFrame:
    """``lhs BIGINT, agree BIGINT, differ BIGINT, n BIGINT``: for each test, how many
    groups of rows equal on its left side are of which shape.

    Each row goes once to every test, with the columns outside the test's left side
    blanked, and the copies are grouped together. ``differ`` are right sides of the
    tests, and columns of ``watched``, with two different values in the group;
    ``agree`` are the left side and those surely with one.

    With ``slices`` above 1 a row goes only to the tests for which its left side falls
    in one of that many hash slices. Groups stay whole, so what differs does differ,
    but nothing is known of the other groups.

    Copies with equal left sides are combined before the shuffle, so a group that
    holds a large part of the table is one row per map task. ``not_null`` names
    columns known to hold no nulls.
    """
    not_null = set(not_null)
    left = masks.ordinals_of(_all_of(t.lhs for t in tests))
    right = masks.ordinals_of(_all_of(t.rhs for t in tests) | watched)
    name = {i: cells.sql_name(n) for i, n in enumerate(df.columns, 1)}
    carried, aggs, differ, agree = [], [], ["0L"], ["lhs"]
    for a in right:
        value, spread, split = _spread(df, a, a not in not_null)
        carried.append(value)
        aggs += spread
        if spread:
            differ.append(f"if({split}, {1 << (a - 1)}L, 0L)")
            if is_fixed_width(df.schema[a - 1].dataType):
                agree.append(f"if({split}, 0L, {1 << (a - 1)}L)")
    if slices > 1:
        chosen = [
            f"if(pmod(xxhash64({', '.join(name[i] for i in masks.ordinals_of(t.lhs))}), {slices}L)"
            f" = 0L, {t.lhs}L, NULL)" if t.lhs else f"{t.lhs}L"
            for t in tests
        ]
        sent = f"explode(array_compact(array({', '.join(chosen)}))) AS lhs"
    else:
        sent = f"explode(array({', '.join(f'{t.lhs}L' for t in tests)})) AS lhs"
    copies = df.selectExpr(*[f"{name[i]} AS k{i}" for i in left], *carried, sent)
    keys = [f"if(lhs & {1 << (i - 1)}L = 0L, NULL, k{i}) AS k{i}" for i in left]
    masked = copies.selectExpr("lhs", *keys, *[f"r{a}" for a in right])
    groups = masked.groupBy("lhs", *[f"k{i}" for i in left]).agg(
        *[F.expr(e) for e in aggs or ["1 AS one"]]
    )
    shapes = groups.selectExpr(
        "lhs", f"{' | '.join(agree)} AS agree", f"{' | '.join(differ)} AS differ"
    )
    return shapes.groupBy("lhs", "agree", "differ").agg(F.expr("count(1) AS n"))


def group_test(
    df: DataFrame, tests: Sequence[Test], not_null: Iterable[int] = ()
) -> DataFrame:
    """``lhs BIGINT, n_lhs BIGINT, refuted BIGINT``, a row per test if there are rows.

    ``n_lhs`` is the number of groups; ``refuted`` holds the right sides with two
    different values in some group, and maybe others that nobody asked for.
    """
    return summed_shapes(group_shapes(df, tests, not_null))


def summed_shapes(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("lhs").agg(
        F.expr("sum(n) AS n_lhs"), F.expr("bit_or(differ) AS refuted")
    )


def seen_failures(shapes: DataFrame) -> DataFrame:
    """``lhs BIGINT, rhs INT``: a group whose rows agree on some columns and differ in
    another shows that those columns, and fewer, do not determine it."""
    return (
        shapes.filter("differ <> 0L")
        .select(F.col("agree").alias("lhs"), F.explode(masks.members(F.col("differ"))).alias("rhs"))
        .distinct()
    )


def one_left_side(df: DataFrame, test: Test, not_null: Iterable[int] = ()) -> DataFrame:
    """The row of ``group_test`` for one test, reading only its own columns."""
    not_null = set(not_null)
    keys = [cells.sql_name(n) for n in cells.names_at(df, masks.ordinals_of(test.lhs))]
    carried, aggs, refuted = [], [], ["0L"]
    for a in masks.ordinals_of(test.rhs):
        value, spread, split = _spread(df, a, a not in not_null)
        carried.append(value)
        aggs += spread
        if spread:
            refuted.append(f"if(coalesce(max({split}), false), {1 << (a - 1)}L, 0L)")
    groups = df.selectExpr(*keys, *carried).groupBy(*keys).agg(
        *[F.expr(e) for e in aggs or ["1 AS one"]]
    )
    return groups.agg(
        F.expr(f"{test.lhs}L AS lhs"),
        F.expr("count(1) AS n_lhs"),
        F.expr(f"{' | '.join(refuted)} AS refuted"),
    )


def _all_of(some: Iterable[int]) -> int:
    out = 0
    for mask in some:
        out |= mask
    return out


def needs_confirmation(df: DataFrame, rhs: int) -> int:
    """The members of ``rhs`` for which the group test can only refute."""
    return masks.mask_of(
        a for a in masks.ordinals_of(rhs) if not is_fixed_width(df.schema[a - 1].dataType)
    )


# --- candidate tables --------------------------------------------------------


def candidate_counts(df: DataFrame, candidates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``mask, n`` for the left sides of ``lhs, rhs`` candidates and for the left
    sides with their right side added, and all of ``known(attrs, n)``: counts of an earlier call of
    ``counted.count_sets`` on the same rows, which are not made again."""
    return counted.as_masks(counted.count_sets(df, counted.candidate_sets(candidates), known))


def judge_by_counts(
    candidates: DataFrame, counts: DataFrame, column_counts: DataFrame
) -> DataFrame:
    """Candidates with ``n_lhs, n_all, holds``, from counts of the sets involved.

    A left side with fewer different tuples than the right side has values cannot
    determine it, whatever the third count says.
    """
    left = counts.select(F.col("mask").alias("lhs"), F.col("n").alias("n_lhs"))
    whole = counts.select(F.col("mask").alias("whole"), F.col("n").alias("n_all"))
    right = column_counts.select(F.col("ordinal").alias("rhs"), F.col("n").alias("n_rhs"))
    return (
        candidates.withColumn("whole", F.col("lhs").bitwiseOR(masks.bit(F.col("rhs"))))
        .join(left, "lhs")
        .join(right, "rhs")
        .join(whole, "whole")
        .withColumn(
            "holds", (F.col("n_lhs") >= F.col("n_rhs")) & (F.col("n_lhs") == F.col("n_all"))
        )
        .select(*candidates.columns, "n_lhs", "n_all", "holds")
    )


def prove_by_counts(
    candidates: DataFrame, counts: DataFrame, column_counts: DataFrame
) -> DataFrame:
    """The candidates that hold."""
    return judge_by_counts(candidates, counts, column_counts).filter("holds").select("lhs", "rhs")


def refute_by_counts(
    candidates: DataFrame, counts: DataFrame, column_counts: DataFrame
) -> DataFrame:
    """The candidates that fail."""
    return judge_by_counts(candidates, counts, column_counts).filter("not holds").select("lhs", "rhs")


def group_verdicts(df: DataFrame, shared: int, candidates: DataFrame) -> DataFrame:
    """``value, lhs, rhs, n_lhs, n_all``: for each group of rows that share a value of
    column ``shared``, the different left sides and the different left + right sides.

    A candidate holds inside a group when the two are equal. Each left side must
    contain the shared column, so a set's groups never cross two of its values.
    One scan sends each row to every set involved, with the columns outside it
    blanked; different tuples are counted per set and value, and the counts of a
    value meet by two joins, however many candidates there are. Rows of a large table
    are spread first, so that no task makes many more than ``COPIES`` copies. No
    candidates give an empty table.
    """
    (name,) = cells.names_at(df, [shared])
    pairs = candidates.select("lhs", "rhs", F.col("lhs").bitwiseOR(masks.bit(F.col("rhs"))).alias("whole")).distinct()
    # Sets of columns, as many as the caller's candidates name; no rows are read here.
    wanted = sorted({r[0] for r in pairs.select(F.explode(F.array("lhs", "whole"))).distinct().toLocalIterator()})
    if any(not mask >> (shared - 1) & 1 for mask in wanted):
        raise ValueError(f"column {shared} is not in every left side")
    if not wanted:
        kind = df.schema[name].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"value {kind}, lhs bigint, rhs int, n_lhs bigint, n_all bigint")
    used = masks.ordinals_of(_all_of(wanted))
    names = {i: cells.sql_name(n) for i, n in enumerate(df.columns, 1)}
    sent = f"explode(array({', '.join(f'{m}L' for m in wanted)})) AS mask"
    kept = [f"if(mask & {1 << (i - 1)}L = 0L, NULL, k{i}) AS k{i}" for i in used]
    rows = df.selectExpr(*[f"{names[i]} AS k{i}" for i in used])
    tasks = -(-df.count() * len(wanted) // counts.COPIES)
    if tasks > 1:
        rows = rows.repartition(tasks, *rows.columns)
    tuples = rows.selectExpr("*", sent).selectExpr("mask", *kept).distinct()
    sizes = tuples.groupBy("mask", F.col(f"k{shared}").alias("value")).agg(F.expr("count(1) AS n"))
    left = pairs.join(sizes.select(F.col("mask").alias("lhs"), "value", F.col("n").alias("n_lhs")), "lhs")
    whole = sizes.select(F.col("mask").alias("of"), F.col("value").alias("at"), F.col("n").alias("n_all"))
    return left.join(whole, (F.col("whole") == F.col("of")) & F.col("value").eqNullSafe(F.col("at"))).select(
        "value", "lhs", "rhs", "n_lhs", "n_all"
    )


def group_constancy(df: DataFrame, shared: int, lhs: Sequence[int], rhs: Sequence[int]) -> DataFrame:
    """``value, ok<rhs>...``: for each value of column ``shared``, whether the left
    side determines each right side among its rows. One scan answers for all."""
    (name,) = cells.names_at(df, [shared])
    keys = [cells.quoted(n) for n in cells.names_at(df, sorted(set(lhs) | {shared}))]
    inner = df.groupBy(*keys).agg(*[F.expr(f"{_one_value(df, a)} AS ok{a}") for a in rhs])
    return inner.groupBy(cells.quoted(name).alias("value")).agg(
        *[F.bool_and(f"ok{a}").alias(f"ok{a}") for a in rhs]
    )


def _one_value(df: DataFrame, ordinal: int) -> str:
    """Whether a group has one value of a column, a missing one counted as a value."""
    field = df.schema[ordinal - 1]
    value = cells.sql_name(field.name)
    if is_fixed_width(field.dataType):
        gap = f"(max({value} IS NULL) AND min({value}) IS NOT NULL)"
        return f"min({value}) <=> max({value}) AND NOT {gap}"
    # A struct of one cell has a minimum and a maximum that do not skip nulls.
    return f"min(struct({value})) <=> max(struct({value}))"


def group_votes(verdicts: DataFrame) -> DataFrame:
    """``lhs, rhs, n_holding, n_groups`` from ``group_verdicts``: in how many groups a
    candidate holds."""
    return verdicts.groupBy("lhs", "rhs").agg(
        F.count_if(F.col("n_lhs") == F.col("n_all")).alias("n_holding"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def prove_by_groups(df: DataFrame, shared: int, candidates: DataFrame) -> DataFrame:
    """Candidates that hold in every group of a shared column."""
    votes = group_votes(group_verdicts(df, shared, candidates))
    return votes.filter(F.col("n_holding") == F.col("n_groups")).select("lhs", "rhs")


def refute_by_groups(df: DataFrame, shared: int, candidates: DataFrame) -> DataFrame:
    """Candidates that fail in some group of a shared column."""
    return (
        group_verdicts(df, shared, candidates)
        .filter(F.col("n_lhs") != F.col("n_all"))
        .select("lhs", "rhs")
        .distinct()
    )


def widest_by_groups(df: DataFrame, shared: int, candidates: DataFrame) -> DataFrame:
    """``lhs, rhs`` of the candidates that hold, tested within the groups of a shared
    column. Candidates whose left side lacks that column are tested by counts."""
    has = masks.has(F.col("lhs"), F.lit(shared))
    grouped, rest = candidates.filter(has), candidates.filter(~has)
    by_groups = grouped.join(refute_by_groups(df, shared, grouped), ["lhs", "rhs"], "left_anti").select("lhs", "rhs")
    counted = judge_by_counts(rest, candidate_counts(df, rest), column_counts(df)).filter("holds")
    return by_groups.unionByName(counted.select("lhs", "rhs"))


# --- given dependencies ------------------------------------------------------


def check_fds(df: DataFrame, fds: Sequence[tuple[Sequence[str], str]]) -> DataFrame:
    """``lhs STRING, rhs STRING, holds BOOLEAN`` for FDs given by column names, of a
    table of any number of columns."""
    position = {n: i for i, n in enumerate(df.columns, 1)}
    pairs = [
        (",".join(lhs), rhs, frozenset(position[n] for n in lhs), position[rhs]) for lhs, rhs in fds
    ]
    wanted = sorted({tuple(sorted(s)) for _, _, x, a in pairs for s in (x, x | {a})})
    n = {}
    for part in batches(list(enumerate(wanted))):
        plan = union_all([set_count(df, s).selectExpr(f"{i} AS at", "n") for i, s in part])
        n.update((wanted[r["at"]], r.n) for r in plan.collect())
    return local_table(
        df.sparkSession,
        [(lhs, rhs, n[tuple(sorted(x))] == n[tuple(sorted(x | {a}))]) for lhs, rhs, x, a in pairs],
        "lhs string, rhs string, holds boolean",
    )


def violations(df: DataFrame, lhs: Sequence[str], rhs: str) -> DataFrame:
    """The left side values with more than one right side value, and how many.

    Different pairs are found first and counted per left side after, so a left side
    with very many right sides is spread over the tasks.
    """
    keys = [cells.quoted(n) for n in lhs]
    return (
        df.select(*keys, cells.quoted(rhs).alias("_rhs"))
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rhs_values"))
        .filter(F.col("n_rhs_values") > 1)
    )
