"""Candidate tables: ``level INT, lhs BIGINT, rhs INT``.

Pruning joins on the right side and one column of the smaller left side, picked by a
hash, with containment as the rest of the condition. A right side is one of few values;
with the column a table falls into many more keys, and no key holds most of it. Repeated
rows harm neither a semi nor an anti join, so none are dropped on the way, and Spark
broadcasts whatever is small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from determina.functions import masks


def _bits(ordinals: Iterable[int]) -> Column:
    return F.array(*[F.lit(i) for i in sorted(ordinals)]).cast("array<int>")


def widest_candidates(spark: SparkSession, ordinals: Iterable[int]) -> DataFrame:
    """For each column, all the others as its left side."""
    whole = masks.mask_of(ordinals)
    return spark.range(1).select(F.explode(_bits(ordinals)).alias("rhs")).select(
        F.lit(whole).cast("bigint").bitwiseXOR(masks.bit(F.col("rhs"))).alias("lhs"), "rhs"
    )


def attribute_sets(
    spark: SparkSession, ordinals: Iterable[int], max_size: int | None = None
) -> DataFrame:
    """``lhs BIGINT, level INT``: every set of some columns but the empty one.

    The numbers 1 to 2^n - 1 are spread over the tasks and their n bits moved to the
    columns' places; with ``max_size`` the sets are grown from smaller ones instead, so
    larger sets are never made.
    """
    ordinals = sorted(set(ordinals))
    if max_size is None:
        if len(ordinals) > 62:
            raise ValueError("more than 2^62 sets; give a max_size")
        moved = " | ".join(
            f"shiftleft(shiftright(id, {j}) & 1L, {i - 1})" for j, i in enumerate(ordinals)
        )
        return (
            spark.range(1, 1 << len(ordinals))
            .select(F.expr(moved or "id").alias("lhs"))
            .select("lhs", masks.size(F.col("lhs")).alias("level"))
        )
    level = spark.range(1).select(F.explode(_bits(ordinals)).alias("i")).select(
        masks.bit(F.col("i")).alias("lhs")
    )
    out = level
    for _ in range(1, min(max_size, len(ordinals))):
        level = _extend(level, ordinals)
        out = out.unionByName(level)
    return out.select("lhs", masks.size(F.col("lhs")).alias("level"))


def _extend(sets: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """Each set with each column beyond its highest: every larger set comes once."""
    return (
        sets.withColumn("i", F.explode(_bits(ordinals)))
        .filter(masks.bit(F.col("i")) > F.col("lhs"))
        .withColumn("lhs", F.col("lhs").bitwiseOR(masks.bit(F.col("i"))))
        .drop("i")
    )


def candidates(sets: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """Every set as a left side with every column outside it as the right side."""
    return (
        sets.withColumn("rhs", F.explode(_bits(ordinals)))
        .filter(~masks.has(F.col("lhs"), F.col("rhs")))
        .select("level", "lhs", "rhs")
    )


def drop_end_levels(cands: DataFrame, width: int) -> DataFrame:
    """Without the one-column left sides and those of all other columns."""
    return cands.filter((F.col("level") != 1) & (F.col("level") != width - 1))


def at_level(cands: DataFrame, level: int) -> DataFrame:
    return cands.filter(F.col("level") == level)


def with_column_at_level(cands: DataFrame, level: int, ordinal: int) -> DataFrame:
    """Candidates of a level whose left side has a column."""
    return at_level(cands, level).filter(masks.has(F.col("lhs"), F.lit(ordinal)))


def inside(cands: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """Candidates with both sides among some columns."""
    part = F.lit(masks.mask_of(ordinals)).cast("bigint")
    return cands.filter(
        masks.covers(part, F.col("lhs").bitwiseOR(masks.bit(F.col("rhs"))))
    )


def level_sizes(cands: DataFrame) -> DataFrame:
    return cands.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def _keyed(small: DataFrame) -> DataFrame:
    """With ``key``: one member of ``lhs``, by a hash of the set. The empty set, which is part of
    every set, comes with all keys; a right side has it once at most."""
    chosen = F.pmod(F.xxhash64("lhs"), F.greatest(masks.size(F.col("lhs")), F.lit(1))).cast("int")
    one = F.array(F.get(masks.members(F.col("lhs")), chosen))
    every = F.sequence(F.lit(0), F.lit(masks.MAX_COLUMNS))
    return small.withColumn("key", F.explode(F.when(F.col("lhs") == 0, every).otherwise(one)))


def _spread(big: DataFrame) -> DataFrame:
    """Once for each member of ``lhs``, as ``key``; the empty set once, with a key of its own."""
    return big.withColumn("key", F.explode(F.when(F.col("lhs") == 0, F.array(F.lit(0))).otherwise(masks.members(F.col("lhs")))))


def _around(big: DataFrame, small: DataFrame, proper: bool = False) -> DataFrame:
    """``lhs, rhs`` of ``big`` whose left side covers one of ``small`` with their right side;
    a row may come several times."""
    return _contained(_spread, big, _keyed, small, lambda a, b: masks.covers(a, b), proper)


def _within(small: DataFrame, big: DataFrame, proper: bool = False) -> DataFrame:
    """``lhs, rhs`` of ``small`` whose left side is within one of ``big`` with their right side;
    a row may come several times."""
    return _contained(_keyed, small, _spread, big, lambda a, b: masks.covers(b, a), proper)


def _contained(key_left, left, key_right, right, fits, proper: bool) -> DataFrame:
    other = key_right(right.select("lhs", "rhs")).select(
        F.col("lhs").alias("other"), F.col("rhs").alias("other_rhs"), F.col("key").alias("other_key")
    )
    match = (F.col("rhs") == F.col("other_rhs")) & (F.col("key") == F.col("other_key"))
    match = match & fits(F.col("lhs"), F.col("other"))
    if proper:
        match = match & (F.col("lhs") != F.col("other"))
    return key_left(left.select("lhs", "rhs")).join(other, match, "left_semi").select("lhs", "rhs")


def prune_implied(cands: DataFrame, fds: DataFrame) -> DataFrame:
    """Without candidates whose left side covers that of an FD with their right side."""
    return cands.join(_around(cands, fds), ["lhs", "rhs"], "left_anti").select(cands.columns)


def prune_refuted(cands: DataFrame, failures: DataFrame) -> DataFrame:
    """Without candidates whose left side is within that of a failure with their
    right side."""
    return cands.join(_within(cands, failures), ["lhs", "rhs"], "left_anti").select(cands.columns)


def prune_redundant(cands: DataFrame, fds: DataFrame) -> DataFrame:
    """Without candidates whose left side determines one of its own columns by others.

    Such a set has as many different tuples as the set without that column, so it
    determines nothing that the smaller set does not.
    """
    inner = fds.select(
        F.col("lhs").bitwiseOR(masks.bit(F.col("rhs"))).alias("known_all"),
        F.col("rhs").alias("known_rhs"),
    )
    held = (
        cands.select("lhs").distinct()
        .withColumn("member", F.explode(masks.members(F.col("lhs"))))
        .join(
            inner,
            (F.col("member") == F.col("known_rhs"))
            & masks.covers(F.col("lhs"), F.col("known_all")),
            "left_semi",
        )
        .select("lhs")
    )
    return cands.join(held, "lhs", "left_anti")


def minimal_only(fds: DataFrame) -> DataFrame:
    """FDs with no FD of a smaller left side inside theirs."""
    return fds.join(_around(fds, fds, proper=True), ["lhs", "rhs"], "left_anti").select(fds.columns)


def maximal_only(failures: DataFrame) -> DataFrame:
    """Failures with no failure of a larger left side around theirs."""
    return failures.join(
        _within(failures, failures, proper=True), ["lhs", "rhs"], "left_anti"
    ).select(failures.columns)


def grown_failures(failures: DataFrame, cands: DataFrame) -> DataFrame:
    """``lhs, rhs, grown``: each failure with the candidates that have one column more
    on the left. ``failures(lhs, rhs)``, ``cands(level, lhs, rhs)``."""
    larger = _spread(cands.select("lhs", "rhs", F.col("level").alias("_level")))
    larger = larger.withColumnRenamed("lhs", "grown")
    failed = _keyed(failures.select("lhs", "rhs", (masks.size(F.col("lhs")) + 1).alias("_level")))
    return (
        failed.join(larger, ["rhs", "_level", "key"])
        .filter(masks.covers(F.col("grown"), F.col("lhs")))
        .select("lhs", "rhs", "grown")
    )


def known_in_groups(verdicts: DataFrame, grown: DataFrame) -> DataFrame:
    """``value, lhs, rhs``: grown candidates already known to hold among the rows of
    one value, because what they grew from holds there.

    ``verdicts(value, lhs, rhs, n_lhs, n_all)``, ``grown(lhs, rhs, grown)``.
    """
    return (
        verdicts.filter(F.col("n_lhs") == F.col("n_all"))
        .join(grown, ["lhs", "rhs"])
        .select("value", F.col("grown").alias("lhs"), "rhs")
        .distinct()
    )


def next_level(failed: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """Candidates one column larger than some that failed.

    Each failed left side takes only columns beyond its highest, so a candidate is
    made once, from the part of it without its highest column, and no shuffle is
    needed to drop repeats. A candidate worth testing has only failures inside, that
    part among them, so none is missed.
    """
    return (
        _extend(failed.select("lhs", "rhs"), ordinals)
        .filter(~masks.has(F.col("lhs"), F.col("rhs")))
        .select(masks.size(F.col("lhs")).alias("level"), "lhs", "rhs")
    )
