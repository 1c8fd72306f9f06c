"""Edge cases of candidate tables and tests of candidates."""

import random

import determina as d
from determina.operators import checks, counts, lattice


def test_no_candidates_give_empty_tables(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    none = spark.createDataFrame([], "level int, lhs bigint, rhs int")
    assert checks.group_verdicts(df, 1, none).collect() == []
    assert checks.prove_by_groups(df, 1, none).collect() == []
    assert checks.refute_by_groups(df, 1, none).collect() == []
    assert checks.widest_by_groups(df, 1, none).collect() == []
    assert counts.set_counts_in_one_scan(df, []).collect() == []


def test_group_verdicts_reads_the_table_once(spark):
    df = spark.range(100).selectExpr("id % 5 a", "id % 7 b", "id % 3 c", "nullif(id % 4, 1) e")
    cands = spark.createDataFrame([(1 | 2, 3), (1 | 2, 4), (1 | 4, 2), (1 | 8, 2)], "lhs bigint, rhs int")
    out = checks.group_verdicts(df, 1, cands)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    rows = [r.asDict() for r in df.collect()]
    name = {1: "a", 2: "b", 3: "c", 4: "e"}
    for r in out.collect():
        mine = [x for x in rows if x["a"] == r.value]
        left = [name[i] for i in name if r.lhs >> (i - 1) & 1]
        assert r.n_lhs == len({tuple(x[c] for c in left) for x in mine})
        assert r.n_all == len({tuple(x[c] for c in [*left, name[r.rhs]]) for x in mine})
    assert out.count() == 20


def test_shared_value_may_be_missing(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 1, 2), (1, 1, 1)], "a int, b int, c int")
    cands = spark.createDataFrame([(1 | 2, 3)], "lhs bigint, rhs int")
    got = {(r.value, r.n_lhs, r.n_all) for r in checks.group_verdicts(df, 1, cands).collect()}
    assert got == {(None, 1, 2), (1, 1, 1)}


def test_sets_of_far_columns(spark):
    got = lattice.attribute_sets(spark, [1, 40, 63]).collect()
    bits = [1, 1 << 39, 1 << 62]
    want = {sum(b for j, b in enumerate(bits) if k >> j & 1) for k in range(1, 8)}
    assert {r.lhs for r in got} == want and all(r.level == bin(r.lhs).count("1") for r in got)
    assert lattice.attribute_sets(spark, []).collect() == []


def test_more_columns_than_a_mask_holds(spark):
    df = spark.range(30).selectExpr(*[f"id % {2 + i % 5} c{i}" for i in range(70)])
    got = {(r.lhs, r.rhs): r.holds for r in d.check_fds(df, [(["c69"], "c4"), (["c64"], "c66"), ([], "c68"), (["c0", "c65"], "c1")]).collect()}
    assert got == {("c69", "c4"): True, ("c64", "c66"): True, ("", "c68"): False, ("c0,c65", "c1"): False}


def test_containment_against_all_pairs(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(0, 64), rng.randrange(1, 4)) for _ in range(120)})
    known = sorted({(rng.randrange(0, 64) & rng.randrange(0, 64), rng.randrange(1, 4)) for _ in range(25)})
    df, other = (spark.createDataFrame(x, "lhs bigint, rhs int") for x in (rows, known))
    as_set = lambda t: sorted((r.lhs, r.rhs) for r in t.collect())
    has = lambda big, small: big & small == small
    assert as_set(lattice.prune_implied(df, other)) == [(x, a) for x, a in rows if not any(b == a and has(x, y) for y, b in known)]
    assert as_set(lattice.prune_refuted(df, other)) == [(x, a) for x, a in rows if not any(b == a and has(y, x) for y, b in known)]
    assert as_set(lattice.minimal_only(df)) == [(x, a) for x, a in rows if not any(b == a and y != x and has(x, y) for y, b in rows)]
    assert as_set(lattice.maximal_only(df)) == [(x, a) for x, a in rows if not any(b == a and y != x and has(y, x) for y, b in rows)]
