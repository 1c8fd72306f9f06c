"""Discovery by counts alone, level by level over free sets.

A set of columns is free when it has more different tuples than each set with one column less:
then none of its columns follows from the others. The left side of a minimal FD is free, and all
that is needed to read FDs off is one count per set:

* ``X -> A`` holds exactly when X and X + A have the same count;
* what follows from X is its closure; what follows from some smaller part of X is known from the
  level below. The difference are the right sides for which X is minimal;
* a set that is not free has the count of its largest part, so only sets whose parts are all free
  are counted on the rows.

Sets, counts, closures and FDs are tables of one row per set; each level is a few joins and
groupings on the set. The driver sees the size of each level, and the names of the sets that a
plan counts. Sets are arrays of column numbers, so tables may have any number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from determina.operators import classes, counted, counts
from determina.sources.staging import scratch, stage, stage_result

EMPTY = "array<int>"


def _numbers(ordinals: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in ordinals]).cast(EMPTY)


def free_set_levels(df: DataFrame, ordinals: list[int], max_lhs: int | None = None):
    """For each level, the staged table ``attrs, n, quasi, closure`` of its free sets.

    ``quasi`` holds what follows from parts of the set, ``closure`` all that follows, both ascending
    and without the set itself. The columns ``ordinals`` must vary. Sets that determine every
    column are not extended. The last level is the one of ``max_lhs`` columns, or that without
    larger free sets.
    """
    spark = df.sparkSession
    whole = _numbers(ordinals)
    n_all = counts.set_count(df, ordinals).first()[0]
    level = counted.count_sets(df, spark.range(1).select(F.explode(F.transform(whole, lambda i: F.array(i))).alias("attrs")))
    level = level.withColumn("quasi", F.array().cast(EMPTY))
    # What a set and a column more count together, for the sets of the level below.
    grown = level.select(F.array().cast(EMPTY).alias("attrs"), F.get("attrs", F.lit(0)).alias("a"), F.lit(1).cast("bigint").alias("n"), F.col("n").alias("n_both"))
    size = 1
    while True:
        rest = F.array_except(F.array_except(whole, "attrs"), "quasi")
        pairs = level.where(F.col("n") < n_all).withColumn("a", F.explode(rest))
        pairs = stage(pairs.withColumn("both", counted.with_member(F.col("attrs"), F.col("a"))), f"pairs{size}")
        made = pairs.groupBy("both").agg(F.count(F.lit(1)).alias("ways"), F.max("n").alias("most"), F.flatten(F.collect_list("quasi")).alias("quasi"))
        # All parts of the set are free, determine not all, and none implies its other column.
        complete = stage(made.where(F.col("ways") == size + 1), f"complete{size}")
        n_of = counted.count_sets(df, complete.select(F.col("both").alias("attrs")))

        sums = pairs.join(n_of.select(F.col("attrs").alias("both"), F.col("n").alias("n_both")), "both", "left")
        parts = pairs.withColumn("b", F.explode("attrs")).select("both", "a", counted.without_member(F.col("attrs"), F.col("b")).alias("part"))
        below = grown.select(F.col("attrs").alias("part"), "a", F.col("n_both").alias("n_part"))
        known = parts.join(below, ["part", "a"]).groupBy("both", "a").agg(F.max("n_part").alias("n_part"))
        sums = sums.join(known, ["both", "a"], "left").withColumn("n_both", F.coalesce("n_both", F.greatest("n", "n_part")))
        grown = stage(sums.select("attrs", "a", "n", "n_both"), f"grown{size}")

        follows = grown.where("n_both = n").groupBy("attrs").agg(F.collect_set("a").alias("new"))
        others = F.array_except(whole, "attrs")
        closure = F.when(F.col("n") == n_all, others).otherwise(F.array_sort(F.array_union("quasi", F.coalesce("new", F.array().cast(EMPTY)))))
        closed = stage(level.join(follows, "attrs", "left").select("attrs", "n", "quasi", closure.alias("closure")), f"closed{size}")
        yield closed
        size += 1
        if size > (max_lhs or len(ordinals)):
            return
        # The quasi-closure of a larger set is what its parts imply, but for its own members.
        own = closed.select("attrs", F.col("closure").alias("implied"))
        larger = complete.join(n_of.withColumnRenamed("attrs", "both"), "both").where("n > most").select("both", "n")
        parts = larger.withColumn("b", F.explode("both")).withColumn("attrs", counted.without_member(F.col("both"), F.col("b")))
        level = parts.join(own, "attrs").groupBy(F.col("both").alias("attrs"), "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("implied")))).alias("quasi"))
        level = stage(level, f"free{size}")
        grown = grown.unionByName(_implied(closed, whole))
        if level.isEmpty():
            return


def _implied(closed: DataFrame, whole: Column) -> DataFrame:
    """Columns that follow add nothing to a set's count."""
    known = F.when(F.size(F.array_except(F.array_except(whole, "attrs"), "closure")) == 0, F.col("closure")).otherwise(F.col("quasi"))
    return closed.select("attrs", F.explode(known).alias("a"), "n", F.col("n").alias("n_both"))


def fds_of_free_sets(level: DataFrame) -> DataFrame:
    """``lhs ARRAY<INT>, rhs INT`` with the free sets of a level as minimal left sides."""
    return level.select(F.col("attrs").alias("lhs"), F.explode(F.array_except("closure", "quasi")).alias("rhs"))


def discover_by_free_sets(df: DataFrame, max_lhs: int | None = None, constants: str = "strict") -> DataFrame:
    """All minimal FDs of a table, ``lhs ARRAY<INT>, rhs INT``, by counts of free sets."""
    with scratch(df.sparkSession):
        df = df.toDF(*[f"c{i}" for i in range(1, len(df.columns) + 1)])
        width = len(df.columns)
        sizes = {}
        for part in counts.batches(list(range(1, width + 1)), counts.PLAN):
            sizes.update((part[r.at], r.n) for r in counts.numbered_set_counts(df, [[i] for i in part]).collect())
        varying = [i for i, n in sizes.items() if n > 1]
        constant = counts.local_table(df.sparkSession, [(i,) for i, n in sizes.items() if n <= 1], "ordinal int")
        found = [classes.constant_fds(constant, width, "strict" if max_lhs == 0 else constants)]
        if varying and max_lhs != 0:
            found += [fds_of_free_sets(level) for level in free_set_levels(df, varying, max_lhs)]
        return stage_result(counts.union_all(found), "fds")
