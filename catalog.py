"""The registered queries: one Spark query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import determina as d
from determina.functions import cells, masks
from determina.operators import checks, classes, counts, dictionary, lattice, tables
from determina.plans import group_search
from determina.sources.staging import fresh_path, stage

LINEITEM8 = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
    "l_returnflag", "l_linestatus",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region, and a constant."""
    customer, nation, region = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey", "c_mktsegment", "n_nationkey", "n_name", "r_regionkey", "r_name",
            F.lit(1).alias("src"),
        )
    )


def lineitem8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(*LINEITEM8)


def gaps(spark, sf_dir):
    """Customers with missing values in three columns."""
    return load(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "nullif(c_nationkey, 5) nation", "nullif(c_mktsegment, 'BUILDING') segment",
        "nullif(c_nationkey % 4, 2) fourth", "c_acctbal",
    )


def lineitem_supplier(spark, sf_dir):
    """Columns of lineitem with the supplier's name, which stands for its key."""
    left, right = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    return left.join(right, left["l_suppkey"] == right["s_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_suppkey", "s_name", "s_nationkey"
    )


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    derived = {"geo": geo, "lineitem8": lineitem8, "gaps": gaps, "lineitem_supplier": lineitem_supplier}
    return derived.get(name) or (
        lambda spark, sf_dir: load(spark, sf_dir, name)
    )


def _all(df: DataFrame) -> list[int]:
    return list(range(1, len(df.columns) + 1))


# --- sources and sinks ---------------------------------------------------------


def delimited_source(spark, sf_dir):
    path = fresh_path(spark, "customer-csv")
    load(spark, sf_dir, "customer").write.csv(path)
    return d.read_delimited(spark, path, width=5)


def split_lines_source(spark, sf_dir):
    path = fresh_path(spark, "lineitem-text")
    df = load(spark, sf_dir, "lineitem")
    df.select(cells.join_cells(df).alias("value")).write.text(path)
    return d.read_split_lines(spark, path, drop=[11])


def staged_table(spark, sf_dir):
    return stage(load(spark, sf_dir, "events"))


def fd_text_sink(spark, sf_dir):
    path = fresh_path(spark, "fds")
    d.write_fds(d.discover_fds(load(spark, sf_dir, "orders")), path)
    return spark.read.text(path)


# --- projections and expressions -----------------------------------------------


def project_by_number(spark, sf_dir):
    return tables.project_excluding(load(spark, sf_dir, "lineitem"), [5, 6, 7, 8, 9, 10])


def project_distinct(spark, sf_dir):
    return tables.project_distinct(load(spark, sf_dir, "lineitem"), [1, 4, 5, 6, 7, 8, 11])


def cast_all_columns(spark, sf_dir):
    return cells.cast_all(load(spark, sf_dir, "lineitem"), "string")


def numbered_integers(spark, sf_dir):
    df = load(spark, sf_dir, "labels")
    schema = cells.numbered_schema(len(df.columns))
    return cells.cast_all(df, schema[0].dataType).toDF(*schema.names)


def row_arrays(spark, sf_dir):
    df = cells.cast_all(load(spark, sf_dir, "part"), "string")
    return df.select(F.concat_ws("|", cells.row_array(df)).alias("cells"))


def composite_keys(spark, sf_dir):
    key = cells.composite_key(["l_partkey", "l_suppkey"]).alias("key")
    return (
        load(spark, sf_dir, "lineitem").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .select("key.l_partkey", "key.l_suppkey", "n")
    )


def split_cells(spark, sf_dir):
    parts = cells.split_cells(F.col("text"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.size(parts).cast("bigint").alias("n_cells"), F.element_at(parts, -1).alias("last_cell")
    )


def joined_cells(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    return df.select(cells.join_cells(df).alias("value"))


def varying_columns(spark, sf_dir):
    return counts.varying_columns(counts.column_counts(geo(spark, sf_dir)))


def set_functions(spark, sf_dir):
    found = _fds_up_to(load(spark, sf_dir, "orders"), 2)
    lhs, rhs = F.col("lhs"), masks.bit(F.col("rhs"))
    whole = F.lit(63).cast("bigint")
    return found.select(
        "lhs", "rhs",
        masks.union(lhs, rhs).alias("with_rhs"),
        masks.intersection(lhs, masks.union(rhs, F.lit(2).cast("bigint"))).alias("shared"),
        masks.difference(whole, lhs).alias("rest"),
        masks.has(lhs, F.lit(2)).alias("has_second"),
        masks.covers(lhs, F.lit(10).cast("bigint")).alias("covers_two"),
        masks.size(lhs).alias("size"),
    )


def set_labels(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    wanted = range(1, 1 << len(df.columns))
    return counts.set_counts(df, wanted).select(
        masks.labels(masks.members(F.col("mask"))).alias("cols"), "n"
    )


# --- duplicates and set operations ----------------------------------------------


def distinct_rows(spark, sf_dir):
    return tables.distinct_rows(load(spark, sf_dir, "documents"))


def vocabulary(spark, sf_dir):
    return tables.vocabulary(load(spark, sf_dir, "part"))


def _candidates(df: DataFrame, size: int | None = None) -> DataFrame:
    sets = lattice.attribute_sets(df.sparkSession, _all(df), size)
    return lattice.candidates(sets, _all(df))


def _prove(df: DataFrame, cands: DataFrame) -> DataFrame:
    return checks.prove_by_counts(
        cands, checks.candidate_counts(df, cands), counts.column_counts(df)
    )


def _refute(df: DataFrame, cands: DataFrame) -> DataFrame:
    return checks.refute_by_counts(
        cands, checks.candidate_counts(df, cands), counts.column_counts(df)
    )


def _fds_up_to(df: DataFrame, size: int | None) -> DataFrame:
    return stage(_prove(df, _candidates(df, size)), "fds")


def fd_difference(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    cands = _candidates(df, 2)
    return tables.fd_difference(cands.select("lhs", "rhs"), _refute(df, cands))


def fd_union(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    found, level = _fds_up_to(df, 3), masks.size(F.col("lhs"))
    return tables.fd_union(found.filter(level <= 2), found.filter(level >= 2))


# --- joins -----------------------------------------------------------------------


def build_dictionary(spark, sf_dir):
    return dictionary.build_dictionary(load(spark, sf_dir, "part")).select("word", "id")


def dictionary_encoded(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return dictionary.encode(df, dictionary.build_dictionary(df))


def count_matches(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    singles = counts.varying_columns(counts.column_counts(df))
    return classes.match_counts(singles, counts.pair_counts(df, _all(df)))


def containment_join(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    return lattice.prune_implied(_candidates(df), _fds_up_to(df, 2))


def renumbered_pairs(spark, sf_dir):
    df, fds, found, groups = _geo_classes(spark, sf_dir)
    return classes.renumber(classes.one_way_fds(fds), classes.reduced_columns(found, groups))


# --- aggregations ------------------------------------------------------------------


def column_counts(spark, sf_dir):
    return counts.column_counts(load(spark, sf_dir, "lineitem"))


def column_profile(spark, sf_dir):
    return counts.column_profile(load(spark, sf_dir, "lineitem"))


def constant_columns(spark, sf_dir):
    return counts.constant_columns(counts.column_counts(geo(spark, sf_dir)))


def pair_counts(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return counts.pair_counts(df, _all(df))


def set_count(spark, sf_dir):
    return counts.set_count(load(spark, sf_dir, "lineitem"), [1, 4, 5])


def set_counts(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return counts.set_counts(df, range(1, 1 << len(df.columns)))


def set_counts_in_one_scan(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return counts.set_counts_in_one_scan(df, range(1, 1 << len(df.columns)))


def group_sizes(spark, sf_dir):
    return counts.group_sizes(load(spark, sf_dir, "lineitem"), 2)


def group_count(spark, sf_dir):
    return counts.group_count(load(spark, sf_dir, "lineitem"), 2)


# Candidates whose left sides share the column user_id (3) of events.
def _event_candidates(df: DataFrame, level: int = 2) -> DataFrame:
    return lattice.with_column_at_level(_candidates(df, level), level, 3)


def group_verdicts(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    return checks.group_verdicts(df, 3, _event_candidates(df))


def group_constancy(spark, sf_dir):
    return checks.group_constancy(load(spark, sf_dir, "events"), 3, [3, 5], [4, 6])


def group_votes(spark, sf_dir):
    return checks.group_votes(group_verdicts(spark, sf_dir))


def violations(spark, sf_dir):
    return d.violations(load(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], "l_suppkey")


def given_fds(spark, sf_dir):
    return d.check_fds(
        load(spark, sf_dir, "orders"),
        [(["o_orderkey"], "o_custkey"), (["o_custkey"], "o_orderkey"),
         (["o_custkey", "o_totalprice"], "o_orderdate"), ([], "o_orderstatus")],
    )


def right_sides(spark, sf_dir):
    fds = d.discover_fds(load(spark, sf_dir, "customer"))
    return classes.grouped_right_sides(fds).select(
        masks.labels(F.col("lhs")).alias("lhs"), masks.labels(F.col("rhs")).alias("rhs")
    )


# --- sort, first row -----------------------------------------------------------------


def ranked_columns(spark, sf_dir):
    return counts.rank_columns(counts.column_counts(load(spark, sf_dir, "lineitem")))


def class_representatives(spark, sf_dir):
    _, _, found, groups = _geo_classes(spark, sf_dir)
    return classes.representatives(groups, found)


def line_widths(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    return d.line_widths(df.select(cells.join_cells(df).alias("value")))


# --- dependencies ----------------------------------------------------------------------


def single_fds(spark, sf_dir):
    return classes.single_fds(load(spark, sf_dir, "orders"))


def single_fds_ordered(spark, sf_dir):
    return classes.single_fds_ordered(load(spark, sf_dir, "orders"))


def prove_by_counts(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    return _prove(df, lattice.at_level(_candidates(df), 2))


def refute_by_counts(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    return _refute(df, lattice.at_level(_candidates(df), 2))


def prove_by_groups(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    return checks.prove_by_groups(df, 3, _event_candidates(df))


def refute_by_groups(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    return checks.refute_by_groups(df, 3, _event_candidates(df))


def grouped_test(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    tests = [checks.Test(1 << i, 63 & ~(1 << i)) for i in range(6)]
    asked = F.lit(63).cast("bigint").bitwiseXOR(F.col("lhs"))
    return checks.group_test(df, tests).select(
        "lhs", "n_lhs", F.col("refuted").bitwiseAND(asked).alias("refuted")
    )


def widest_candidates(spark, sf_dir):
    df, _, found, groups = _geo_classes(spark, sf_dir)
    kept = [r.new_ord for r in classes.reduced_columns(found, groups).collect()]
    return lattice.widest_candidates(spark, kept)


def widest_fds(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return _prove(df, lattice.widest_candidates(spark, _all(df)))


def widest_fds_by_groups(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return checks.widest_by_groups(df, 3, lattice.widest_candidates(spark, _all(df)))


# --- classes, reduction, recovery --------------------------------------------------------


def _geo_classes(spark, sf_dir):
    df = geo(spark, sf_dir)
    fds = stage(classes.single_fds(df), "single-fds")
    found = stage(counts.column_counts(df), "column-counts")
    return df, fds, found, classes.equivalence_classes(fds)


def equivalence_classes(spark, sf_dir):
    return _geo_classes(spark, sf_dir)[3]


def one_way_fds(spark, sf_dir):
    return classes.one_way_fds(_geo_classes(spark, sf_dir)[1])


def reduced_columns(spark, sf_dir):
    _, _, found, groups = _geo_classes(spark, sf_dir)
    return classes.reduced_columns(found, groups)


def restated_fds(spark, sf_dir):
    _, fds, found, groups = _geo_classes(spark, sf_dir)
    return classes.restated_fds(classes.one_way_fds(fds), classes.reduced_columns(found, groups))


def _geo_recovery(spark, sf_dir):
    df, fds, found, groups = _geo_classes(spark, sf_dir)
    mapping = stage(classes.reduced_columns(found, groups), "mapping")
    restated = classes.restated_fds(classes.one_way_fds(fds), mapping)
    return df, restated, classes.alternatives(mapping, groups), found, groups


def substituted_left(spark, sf_dir):
    _, restated, stands_for, _, _ = _geo_recovery(spark, sf_dir)
    return classes.substitute_left(restated, stands_for, 1).select(
        masks.labels(F.col("lhs")).alias("lhs"), "rhs"
    )


def expanded_right(spark, sf_dir):
    _, restated, stands_for, _, _ = _geo_recovery(spark, sf_dir)
    return d.as_text(
        classes.expand_right(classes.substitute_left(restated, stands_for, 1), stands_for)
    )


def class_fds(spark, sf_dir):
    return d.as_text(classes.class_fds(_geo_classes(spark, sf_dir)[3]))


def constant_fds(spark, sf_dir):
    df = geo(spark, sf_dir)
    constants = counts.constant_columns(counts.column_counts(df))
    return d.as_text(classes.constant_fds(constants, len(df.columns)))


def constant_fds_expanded(spark, sf_dir):
    df = geo(spark, sf_dir)
    constants = counts.constant_columns(counts.column_counts(df))
    return d.as_text(classes.constant_fds(constants, len(df.columns), "expand"))


def fd_text(spark, sf_dir):
    return d.fd_lines(d.discover_fds(load(spark, sf_dir, "part")))


# --- candidate tables -----------------------------------------------------------------------


def _geo_kept(spark, sf_dir):
    return [r.new_ord for r in reduced_columns(spark, sf_dir).collect()]


def attribute_sets(spark, sf_dir):
    return lattice.attribute_sets(spark, _geo_kept(spark, sf_dir))


def all_candidates(spark, sf_dir):
    kept = _geo_kept(spark, sf_dir)
    return lattice.candidates(lattice.attribute_sets(spark, kept), kept)


def inner_levels(spark, sf_dir):
    kept = _geo_kept(spark, sf_dir)
    cands = lattice.candidates(lattice.attribute_sets(spark, kept), kept)
    return lattice.drop_end_levels(cands, len(kept))


def level_sizes(spark, sf_dir):
    return lattice.level_sizes(all_candidates(spark, sf_dir))


def candidates_with_column(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    open_cands = lattice.prune_implied(_candidates(df), _fds_up_to(df, 1))
    return lattice.with_column_at_level(open_cands, 2, 3)


def candidates_inside(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return lattice.inside(lattice.prune_implied(_candidates(df), _fds_up_to(df, 1)), [2, 3, 5])


def candidates_not_implied(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return lattice.prune_implied(_candidates(df), _fds_up_to(df, 1))


def candidates_not_refuted(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    failures = stage(_refute(df, lattice.at_level(_candidates(df), 3)), "failures")
    return lattice.prune_refuted(_candidates(df), failures)


def candidates_not_redundant(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return lattice.prune_redundant(_candidates(df), _fds_up_to(df, 1))


def fds_not_implied(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return lattice.prune_implied(
        _prove(df, lattice.at_level(_candidates(df), 3)), _fds_up_to(df, 1)
    )


def minimal_fds(spark, sf_dir):
    return lattice.minimal_only(_fds_up_to(load(spark, sf_dir, "orders"), None))


def maximal_failures(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return lattice.maximal_only(stage(_refute(df, _candidates(df)), "failures"))


def grown_failures(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    cands = _candidates(df)
    return lattice.grown_failures(_refute(df, lattice.at_level(cands, 2)), cands)


def next_level(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return lattice.next_level(_refute(df, lattice.at_level(_candidates(df), 2)), _all(df))


def known_in_groups(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    verdicts = checks.group_verdicts(df, 3, _event_candidates(df))
    grown = lattice.grown_failures(
        checks.refute_by_groups(df, 3, _event_candidates(df)), _event_candidates(df, 3)
    )
    return lattice.known_in_groups(verdicts, grown)


# --- discovery ---------------------------------------------------------------------------------


def _discover(name: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        return d.as_text(d.discover_fds(_table(name)(spark, sf_dir), **options))

    return query


def discover_from_text(spark, sf_dir):
    """Text in, FD text out: orders written as lines, read, searched and written."""
    source, target = fresh_path(spark, "orders-text"), fresh_path(spark, "fds")
    load(spark, sf_dir, "orders").write.csv(source, timestampFormat="yyyy-MM-dd HH:mm:ss")
    d.write_fds(d.discover_fds(d.read_delimited(spark, source), stage_input=True), target)
    return spark.read.text(target)


def discover_by_count(spark, sf_dir):
    return d.as_text(d.discover_fds_by_count(load(spark, sf_dir, "part")))


def discover_in_parts(spark, sf_dir):
    return d.as_text(
        d.discover_fds_in_parts(
            load(spark, sf_dir, "part"),
            [["p_partkey", "p_name", "p_brand"], ["p_type", "p_size", "p_retailprice"]],
        )
    )


def discover_from_both_ends(spark, sf_dir):
    return d.as_text(d.discover_fds_from_both_ends(load(spark, sf_dir, "orders")))


def discover_by_groups(spark, sf_dir):
    return d.as_text(d.discover_fds_by_groups(load(spark, sf_dir, "customer")))


def discover_sliced(spark, sf_dir):
    """With a sample and hash slices as for a large table."""
    return d.as_text(d.discover_fds(load(spark, sf_dir, "orders"), sample_rows=500, slice_rows=1000))


def failing_groups(spark, sf_dir):
    """Groups of a user's events in which the user and one other column do not give a third."""
    tests = [([3, x], [a for a in (1, 2, 4, 5, 6) if a != x]) for x in (1, 2, 4, 5, 6)]
    return group_search.failing_groups(load(spark, sf_dir, "events"), 3, tests)


def discover_columns(spark, sf_dir):
    return d.as_text(
        d.discover_fds(load(spark, sf_dir, "part"), columns=["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        delimited_source, split_lines_source, staged_table, fd_text_sink,
        project_by_number, project_distinct, cast_all_columns, numbered_integers, row_arrays,
        composite_keys, split_cells, joined_cells, varying_columns, set_functions, set_labels,
        distinct_rows, vocabulary, fd_difference, fd_union,
        build_dictionary, dictionary_encoded, count_matches, containment_join, renumbered_pairs,
        column_counts, column_profile, constant_columns, pair_counts, set_count, set_counts,
        set_counts_in_one_scan, group_sizes, group_count, group_verdicts, group_constancy,
        group_votes, violations, given_fds, right_sides,
        ranked_columns, class_representatives, line_widths,
        single_fds, single_fds_ordered, prove_by_counts, refute_by_counts, prove_by_groups,
        refute_by_groups, grouped_test, widest_candidates, widest_fds, widest_fds_by_groups,
        equivalence_classes, one_way_fds, reduced_columns, restated_fds, substituted_left,
        expanded_right, class_fds, constant_fds, constant_fds_expanded, fd_text,
        attribute_sets, all_candidates, inner_levels, level_sizes, candidates_with_column,
        candidates_inside, candidates_not_implied, candidates_not_refuted,
        candidates_not_redundant, fds_not_implied, minimal_fds, maximal_failures,
        grown_failures, next_level, known_in_groups,
        discover_by_count, discover_in_parts, discover_columns, discover_from_text,
        discover_from_both_ends, discover_by_groups, discover_sliced, failing_groups,
    )
} | {
    f"discover_{name}": _discover(name)
    for name in ("nation", "supplier", "customer", "part", "orders", "events", "documents",
                 "conversations", "labels", "pages", "benchmark", "embeddings", "geo", "gaps",
                 "lineitem", "lineitem8", "lineitem_supplier")
} | {
    "discover_geo_expanded": _discover("geo", constants="expand"),
    "discover_customer_as_text": _discover("customer", as_text=True),
    "discover_lineitem_up_to_3": _discover("lineitem", max_lhs=3),
}
