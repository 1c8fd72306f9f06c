"""Counts of attribute sets as a table that grows.

``attrs ARRAY<INT>, n BIGINT``: a set of columns, ascending, and its different tuples. Sets come as a
table and are counted once; later calls join what is there. The driver sees how many sets are
missing and, portion by portion, the names of the sets that a plan counts. Sets of any number of
columns fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from determina.functions import masks
from determina.operators.counts import PLAN, local_table, numbered_set_counts
from determina.sources.staging import scratch_path, stage

SCHEMA = "attrs array<int>, n bigint"


def with_member(attrs: Column, ordinal: Column) -> Column:
    return F.array_sort(F.array_append(attrs, ordinal))


def without_member(attrs: Column, ordinal: Column) -> Column:
    return F.filter(attrs, lambda x: x != ordinal)


def count_sets(df: DataFrame, sets: DataFrame, known: DataFrame | None = None, portion: int = PLAN) -> DataFrame:
    """``attrs, n`` of the sets ``attrs`` of a table and of all in ``known``, counting only what
    ``known`` lacks.

    ``known(attrs, n)`` is what an earlier call on the same rows gave. Missing sets that fill more
    than one portion are dealt to portions by a hash; each portion is one plan, whose counts are
    appended to one staged table. Repeated sets come once.
    """
    spark = df.sparkSession
    missing = sets.select("attrs").distinct()
    if known is not None:
        missing = missing.join(known.select("attrs"), "attrs", "left_anti")
    names = [r.attrs for r in missing.limit(portion + 1).collect()]
    if len(names) <= portion:
        dealt = [names] if names else []
    else:
        missing = stage(missing.withColumn("hash", F.xxhash64("attrs")), "missing")
        portions = -(-missing.count() // portion)
        dealt = (
            [r.attrs for r in missing.where(F.pmod("hash", F.lit(portions)) == turn).select("attrs").collect()]
            for turn in range(portions)
        )
    path = scratch_path(spark, "counts")
    counted = local_table(spark, [], SCHEMA)
    for names in dealt:
        if names:
            named = local_table(spark, list(enumerate(names)), "at int, attrs array<int>")
            named.join(numbered_set_counts(df, names), "at").select("attrs", "n").write.mode("append").parquet(path)
            counted = spark.read.schema(counted.schema).parquet(path)
    return counted if known is None else known.unionByName(counted)


def candidate_sets(candidates: DataFrame) -> DataFrame:
    """``attrs`` of the left sides of ``lhs BIGINT, rhs INT`` candidates and of these with their
    right side."""
    left = masks.members(F.col("lhs"))
    return candidates.select(F.explode(F.array(left, with_member(left, F.col("rhs")))).alias("attrs"))


def as_masks(counts: DataFrame) -> DataFrame:
    """``mask BIGINT, n`` of sets of columns that fit a mask."""
    total = F.aggregate("attrs", F.lit(0).cast("bigint"), lambda mask, i: mask.bitwiseOR(masks.bit(i)))
    return counts.select(total.alias("mask"), "n")


def from_masks(counts: DataFrame) -> DataFrame:
    """``attrs, n`` of ``mask, n``."""
    return counts.select(masks.members(F.col("mask")).alias("attrs"), "n")
