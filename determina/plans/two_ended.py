"""Discovery from both ends of the candidate lattice.

Below, candidates grow column by column; what holds is minimal and settles all larger left
sides. Above, the search starts from all other columns as the left side and takes columns away:
what fails settles all smaller left sides, what holds is carried down a level, until a smaller FD
replaces it. The ends work in turn and meet in the middle, so tables whose left sides are wide are
searched in few tests from above, and those with narrow ones from below.

Everything is a table of left and right sides: candidates, what holds, what fails, and the counts
that answer for them, which are carried from level to level. The driver sees one row per column,
the names of the sets that a plan counts, and whether a level is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.functions import masks
from determina.operators import checks, counted, counts, lattice
from determina.plans.reduced import PAIRS, search_reduced
from determina.sources.staging import stage


class _Judge:
    """Answers for tables of candidates by counts, which it keeps as a table."""

    def __init__(self, rows: DataFrame, column_counts: DataFrame):
        self.rows = rows
        self.column_counts = column_counts
        self.known = column_counts.select(F.array("ordinal").alias("attrs"), "n")

    def __call__(self, candidates: DataFrame, name: str) -> DataFrame:
        """Staged ``lhs, rhs, holds``."""
        candidates = stage(candidates.select("lhs", "rhs"), name)
        self.known = counted.count_sets(self.rows, counted.candidate_sets(candidates), self.known)
        judged = checks.judge_by_counts(candidates, counted.as_masks(self.known), self.column_counts)
        return stage(judged.select("lhs", "rhs", "holds"), name)


def _smaller(live: DataFrame) -> DataFrame:
    """Each left side without each of its columns, with the same right side."""
    return live.withColumn("i", F.explode(masks.members(F.col("lhs")))).select(
        masks.difference(F.col("lhs"), masks.bit(F.col("i"))).alias("lhs"), "rhs"
    ).distinct()


def sweep_from_both_ends(rows: DataFrame, column_counts: DataFrame, singles: DataFrame) -> DataFrame:
    """``lhs BIGINT, rhs INT``: all minimal FDs between the columns of a table, none of them
    constant. ``column_counts(ordinal, n)``; ``singles(lhs, rhs)`` are the FDs of one column."""
    spark = rows.sparkSession
    ordinals = list(range(1, len(rows.columns) + 1))
    judge = _Judge(rows, column_counts)
    found = stage(singles.select("lhs", "rhs"), "found")
    failed = proved = counts.local_table(spark, [], PAIRS)
    ones = counts.local_table(spark, [(1 << (i - 1), a) for i in ordinals for a in ordinals if i != a], PAIRS)
    failing = ones.join(found, ["lhs", "rhs"], "left_anti")
    live = lattice.widest_candidates(spark, ordinals)
    low, high = 2, len(ordinals) - 1
    while low <= high:
        # From above: nothing smaller than a failure holds, nothing larger than an FD is open.
        live = stage(lattice.prune_refuted(live, failed), f"live{high}")
        if live.isEmpty():
            break
        judged = judge(lattice.prune_implied(live, found), f"above{high}")
        fails = judged.filter("not holds").select("lhs", "rhs")
        failed = stage(lattice.maximal_only(failed.unionByName(fails)), "failed")
        proved = stage(lattice.minimal_only(proved.unionByName(judged.filter("holds").select("lhs", "rhs"))), "proved")
        live = live.join(fails, ["lhs", "rhs"], "left_anti")
        high -= 1
        if low > high:
            break
        # From below: all smaller left sides are settled, so what holds here is minimal.
        level = stage(lattice.prune_implied(lattice.next_level(failing, ordinals), found).select("lhs", "rhs"), f"level{low}")
        if level.isEmpty():
            break
        judged = judge(lattice.prune_refuted(level, failed), f"below{low}")
        holds = judged.filter("holds").select("lhs", "rhs")
        found = stage(found.unionByName(holds), "found")
        failing = level.join(holds, ["lhs", "rhs"], "left_anti")
        live = _smaller(live)
        low += 1
    return lattice.minimal_only(found.unionByName(proved).distinct())


def discover_fds_from_both_ends(df: DataFrame, **options) -> DataFrame:
    """``discover_fds`` without a limit of the left side, searched from both ends.

    ``options`` are ``columns``, ``constants``, ``as_text`` and ``stage_input``.
    """
    return search_reduced(df, sweep_from_both_ends, **options)
