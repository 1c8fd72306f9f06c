"""Discovery by groups of rows, with what is known in each group carried along.

``X -> A`` holds when it holds in every group of rows that share a column of X. Left sides grow from
their lowest column, which is the shared one, so all left sides with one lowest column are tested on
the same groups: on a copy of the table that is grouped by that column once and read by all of them
without an exchange. The state of the search is a table ``value, lhs, rhs`` of the groups where a
candidate fails. A larger left side holds wherever a smaller one does, so the next level reads the
rows of those groups only, and a candidate holds when no group is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.functions import masks
from determina.operators import checks, counts, lattice
from determina.plans.reduced import search_reduced
from determina.sources.staging import scratch, scratch_path, stage, stage_result

# A value held by more than one row in so many is frequent: its rows are kept apart, not in one file,
# and grouped with partial aggregation. There are fewer such values than this.
FREQUENT = 64


class GroupedCopy:
    """A copy of a table, bucketed by a column, and the rows of very frequent values apart.

    ``close`` forgets the table; its files go with the scope it was made in.
    """

    def __init__(self, rows: DataFrame, shared: int, buckets: int | None = None):
        buckets = buckets or rows.sparkSession.sparkContext.defaultParallelism
        self.spark = rows.sparkSession
        self.shared = shared
        rows = rows.toDF(*[f"k{i}" for i in range(1, len(rows.columns) + 1)])
        self.value = f"k{shared}"
        sizes = stage(counts.group_sizes(rows, shared), "groups")
        limit = (sizes.agg(F.sum("n_rows")).first()[0] or 0) // FREQUENT
        hot = stage(sizes.filter(F.col("n_rows") > max(limit, 1)).select("value"), "hot")
        same = F.expr(f"{self.value} <=> value")
        self.table = f"grouped_{uuid.uuid4().hex}"
        calm = rows.join(F.broadcast(hot), same, "left_anti")
        calm.repartition(buckets, self.value).write.bucketBy(buckets, self.value).option("path", scratch_path(self.spark, "grouped")).saveAsTable(self.table)
        self.parts = [self.spark.table(self.table)]
        if not hot.isEmpty():
            self.parts.append(stage(rows.join(F.broadcast(hot), same, "left_semi"), "frequent"))

    def constancy(self, tests: Sequence[tuple[int, list[int]]], open_values: DataFrame | None = None) -> DataFrame:
        """``value, lhs, rhs`` of the groups in which a left side has two right side values.

        ``tests`` are (left mask with the shared column, right sides); ``open_values(value)`` limits
        the groups that are read. No exchange on the bucketed rows: a group lies in one file.
        """
        plans = []
        for part in self.parts:
            if open_values is not None:
                part = part.join(open_values, F.expr(f"{self.value} <=> value"), "left_semi")
            for lhs, rhs in tests:
                verdict = checks.group_constancy(part, self.shared, masks.ordinals_of(lhs), rhs)
                failing = F.filter(F.array(*[F.when(~F.col(f"ok{a}"), F.lit(a)) for a in rhs]), lambda a: a.isNotNull())
                plans.append(verdict.select("value", F.lit(lhs).cast("bigint").alias("lhs"), F.explode(failing).alias("rhs")))
        return counts.union_all(plans)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def failing_groups(df: DataFrame, shared: int, tests: Sequence[tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """``value, lhs, rhs``: for left sides with a shared column, given as (left columns, right
    columns), the groups of its values in which they do not determine a right side."""
    with scratch(df.sparkSession):
        copy = GroupedCopy(df, shared)
        try:
            return stage_result(copy.constancy([(masks.mask_of(lhs), list(rhs)) for lhs, rhs in tests]), "failing-groups")
        finally:
            copy.close()


def _tests(candidates: DataFrame) -> list[tuple[int, list[int]]]:
    """Left sides and their right sides, which name the plans of a level."""
    grouped = candidates.groupBy("lhs").agg(F.array_sort(F.collect_set("rhs")).alias("rhs"))
    return sorted((r.lhs, list(r.rhs)) for r in grouped.collect())


def search_in_groups(rows: DataFrame, column_counts: DataFrame, singles: DataFrame, batch: int = counts.BATCH) -> DataFrame:
    """``lhs BIGINT, rhs INT``: all minimal FDs between the columns of a table, as
    ``two_ended.sweep_from_both_ends``.

    One column after the other is the lowest of the left sides; FDs found with a lower one prune.
    """
    ordinals = list(range(1, len(rows.columns) + 1))
    found = stage(singles.select("lhs", "rhs"), "found")
    for shared in ordinals[:-1]:
        higher = ordinals[shared:]
        one = 1 << (shared - 1)
        ones = counts.local_table(rows.sparkSession, [(one, a) for a in ordinals if a != shared], "lhs bigint, rhs int")
        failing = ones.join(found, ["lhs", "rhs"], "left_anti")
        copy, state = None, None
        try:
            for level in range(2, len(higher) + 2):
                grown = lattice.next_level(failing, higher)
                cands = stage(lattice.prune_implied(grown, found).select("lhs", "rhs"), f"candidates{shared}-{level}")
                tests = _tests(cands)
                if not tests:
                    break
                copy = copy or GroupedCopy(rows, shared)
                open_values = None if state is None else state.join(cands.select("rhs").distinct(), "rhs", "left_semi").select("value").distinct()
                path = scratch_path(rows.sparkSession, "open-groups")
                for part in counts.batches(tests, batch):
                    copy.constancy(part, open_values).write.mode("append").parquet(path)
                state = rows.sparkSession.read.parquet(path)
                fails = stage(state.select("lhs", "rhs").distinct(), "fails")
                found = stage(found.unionByName(cands.join(fails, ["lhs", "rhs"], "left_anti")), "found")
                failing = fails
        finally:
            if copy:
                copy.close()
    return lattice.minimal_only(found)


def discover_fds_by_groups(df: DataFrame, **options) -> DataFrame:
    """``discover_fds`` without a limit of the left side, by tests in groups of rows.

    ``options`` are ``columns``, ``constants``, ``as_text`` and ``stage_input``.
    """
    return search_reduced(df, search_in_groups, **options)
