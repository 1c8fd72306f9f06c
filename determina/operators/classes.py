"""One-column dependencies, equivalent columns, reduced and restored schemas.

The tables here hold one row per column or pair of columns; the joins on them are
small whatever the number of table rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from determina.functions import masks
from determina.operators.counts import column_counts, local_table, pair_counts, set_counts, varying_columns


def match_counts(singles: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lhs INT, rhs INT``: columns with as many different values as one of their
    pairs has. ``singles(ordinal, n)`` and ``pairs(a, b, n)``."""
    both_ways = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("lhs"), F.col("b").alias("rhs")),
                F.struct(F.col("b").alias("lhs"), F.col("a").alias("rhs")),
            )
        ).alias("p"),
        "n",
    ).select("p.lhs", "p.rhs", "n")
    return both_ways.join(
        singles.select(F.col("ordinal").alias("lhs"), "n"), ["lhs", "n"]
    ).select("lhs", "rhs")


def single_fds(df: DataFrame) -> DataFrame:
    """``lhs INT, rhs INT``: one-column FDs between columns that are not constant, by
    comparing the counts of single columns and of all pairs."""
    profile = [(r.ordinal, r.n) for r in varying_columns(column_counts(df)).collect()]
    singles = local_table(df.sparkSession, profile, "ordinal int, n bigint")
    return match_counts(singles, pair_counts(df, [i for i, _ in profile]))


def ordered_pairs(counts: DataFrame) -> DataFrame:
    """``lhs, rhs, both``: pairs worth testing, from the column with more different
    values to the one with fewer. Columns with equal counts come once and stand for
    both directions. ``counts(ordinal, n)``."""
    x = counts.select(F.col("ordinal").alias("lhs"), F.col("n").alias("n_lhs"))
    y = counts.select(F.col("ordinal").alias("rhs"), F.col("n").alias("n_rhs"))
    # One row per column on each side.
    return x.join(
        F.broadcast(y),
        (F.col("n_lhs") > F.col("n_rhs"))
        | ((F.col("n_lhs") == F.col("n_rhs")) & (F.col("lhs") < F.col("rhs"))),
    ).select("lhs", "rhs", (F.col("n_lhs") == F.col("n_rhs")).alias("both"))


def single_fds_ordered(df: DataFrame) -> DataFrame:
    """The result of ``single_fds``, from the pairs of ``ordered_pairs`` only."""
    spark = df.sparkSession
    profile = [(r.ordinal, r.n) for r in varying_columns(column_counts(df)).collect()]
    counts = local_table(spark, profile, "ordinal int, n bigint")
    pairs = ordered_pairs(counts).withColumn(
        "mask", masks.bit(F.col("lhs")).bitwiseOR(masks.bit(F.col("rhs")))
    )
    tested = set_counts(df, [r["mask"] for r in pairs.select("mask").collect()])
    holding = (
        pairs.join(tested, "mask")
        .join(counts.select(F.col("ordinal").alias("lhs"), F.col("n").alias("n_lhs")), "lhs")
        .filter(F.col("n") == F.col("n_lhs"))
    )
    return holding.select("lhs", "rhs").union(holding.filter("both").select("rhs", "lhs"))


def _mutual(fds: DataFrame) -> DataFrame:
    back = fds.select(F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"))
    return fds.join(back, ["lhs", "rhs"], "left_semi")


def equivalence_classes(fds: DataFrame) -> DataFrame:
    """``rep INT, member INT`` for columns that determine each other.

    Mutual dependency is transitive, so a column sees its whole class among its own
    partners and the lowest number of them all is the representative. The
    representative is a member too.
    """
    return _mutual(fds).groupBy(F.col("lhs").alias("member")).agg(
        F.least(F.min("rhs"), F.col("lhs")).alias("rep")
    ).select("rep", "member")


def one_way_fds(fds: DataFrame) -> DataFrame:
    """One-column FDs whose reverse does not hold."""
    back = fds.select(F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"))
    return fds.join(back, ["lhs", "rhs"], "left_anti")


def representatives(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """``rep, n``: the member of each class with most different values. They all have
    the same number, so it is the lowest column number that counts."""
    return (
        classes.join(counts.withColumnRenamed("ordinal", "member"), "member")
        .groupBy("rep")
        .agg(F.max_by("member", F.struct("n", -F.col("member"))).alias("rep_member"),
             F.max("n").alias("n"))
        .select(F.col("rep_member").alias("rep"), "n")
    )


def reduced_columns(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """``new_ord, old_ord, n``: the columns left without constants and without the
    other members of each class, numbered anew in their old order."""
    others = classes.filter(F.col("member") != F.col("rep")).select(
        F.col("member").alias("ordinal")
    )
    kept = varying_columns(counts).join(others, "ordinal", "left_anti")
    # One row per column of the table.
    return kept.select(
        F.row_number().over(Window.orderBy("ordinal")).alias("new_ord"),
        F.col("ordinal").alias("old_ord"),
        "n",
    )


def renumber(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``lhs INT, rhs INT`` pairs in new numbers; pairs of dropped columns go.

    ``mapping(new_ord, old_ord)`` has a row per column.
    """
    left = mapping.select(F.col("old_ord").alias("lhs"), F.col("new_ord").alias("new_lhs"))
    right = mapping.select(F.col("old_ord").alias("rhs"), F.col("new_ord").alias("new_rhs"))
    return (
        pairs.join(F.broadcast(left), "lhs")
        .join(F.broadcast(right), "rhs")
        .select(F.col("new_lhs").alias("lhs"), F.col("new_rhs").alias("rhs"))
    )


def restated_fds(fds: DataFrame, mapping: DataFrame) -> DataFrame:
    """``lhs BIGINT`` mask and ``rhs INT`` of one-column FDs on the reduced schema."""
    return renumber(fds, mapping).select(masks.bit(F.col("lhs")).alias("lhs"), "rhs")


def alternatives(mapping: DataFrame, classes: DataFrame) -> DataFrame:
    """``new_ord, member``: the old columns a reduced column stands for."""
    own = mapping.select("new_ord", F.col("old_ord").alias("member"))
    others = classes.filter(F.col("member") != F.col("rep")).join(
        mapping.select("new_ord", F.col("old_ord").alias("rep")), "rep"
    )
    return own.unionByName(others.select("new_ord", "member"))


def substitute_left(fds: DataFrame, stands_for: DataFrame, longest: int) -> DataFrame:
    """``lhs ARRAY<INT>`` in old numbers and ``rhs`` as it was: an FD for every choice
    of old columns on its left side.

    ``fds(lhs BIGINT, rhs INT)``, left sides of at most ``longest`` columns;
    ``stands_for(new_ord, member)`` has a row per column of the table. One join per
    place in the left side.
    """
    choice = F.broadcast(stands_for.select(
        F.col("new_ord").alias("_new"), F.col("member").alias("_member")
    ))
    out = fds.withColumn("_places", masks.members(F.col("lhs"))).withColumn(
        "_done", F.array().cast("array<int>")
    )
    for i in range(longest):
        place = F.get(F.col("_places"), F.lit(i))
        out = (
            out.withColumn("_place", place)
            .join(choice, F.col("_place") == F.col("_new"), "left")
            .withColumn(
                "_done",
                F.when(F.col("_member").isNull(), F.col("_done")).otherwise(
                    F.concat("_done", F.array("_member"))
                ),
            )
            .drop("_place", "_new", "_member")
        )
    return out.select(F.array_sort("_done").alias("lhs"), "rhs")


def expand_right(fds: DataFrame, stands_for: DataFrame) -> DataFrame:
    """FDs with each old column their reduced right side stands for."""
    right = stands_for.select(F.col("new_ord").alias("rhs"), "member")
    return fds.join(F.broadcast(right), "rhs").select("lhs", F.col("member").alias("rhs"))


def class_fds(classes: DataFrame) -> DataFrame:
    """Each member of a class determines each other member."""
    x = classes.select("rep", F.col("member").alias("x"))
    y = classes.select("rep", F.col("member").alias("y"))
    return x.join(y, "rep").filter(F.col("x") != F.col("y")).select(
        F.array("x").alias("lhs"), F.col("y").alias("rhs")
    )


def constant_fds(constants: DataFrame, width: int, form: str = "strict") -> DataFrame:
    """``{} -> c`` for every constant column; with ``form="expand"`` also ``y -> c``
    for every other column ``y`` of the table."""
    if form not in ("strict", "expand"):
        raise ValueError("form is 'strict' or 'expand'")
    empty = constants.select(
        F.array().cast("array<int>").alias("lhs"), F.col("ordinal").alias("rhs")
    )
    if form == "strict":
        return empty
    other = constants.select(
        F.explode(F.sequence(F.lit(1), F.lit(width))).alias("y"), F.col("ordinal").alias("rhs")
    ).filter(F.col("y") != F.col("rhs"))
    return empty.unionByName(other.select(F.array("y").alias("lhs"), "rhs"))


def recover(
    fds: DataFrame,
    mapping: DataFrame,
    classes: DataFrame,
    constants: DataFrame,
    width: int,
    longest: int,
    form: str = "strict",
) -> DataFrame:
    """FDs of the reduced schema as FDs of the table: ``lhs ARRAY<INT>, rhs INT``."""
    stands_for = alternatives(mapping, classes)
    return (
        expand_right(substitute_left(fds, stands_for, longest), stands_for)
        .unionByName(class_fds(classes))
        .unionByName(constant_fds(constants, width, form))
    )


def as_text(fds: DataFrame) -> DataFrame:
    """``lhs ARRAY<INT>, rhs INT`` as ``lhs STRING`` (``column1,column4``) and ``rhs``."""
    return fds.select(masks.labels(F.col("lhs")).alias("lhs"), masks.label(F.col("rhs")).alias("rhs"))


def grouped_right_sides(fds: DataFrame) -> DataFrame:
    """``lhs, rhs``: all right sides of a left side in one row, ascending."""
    return fds.groupBy("lhs").agg(F.array_sort(F.collect_set("rhs")).alias("rhs"))
