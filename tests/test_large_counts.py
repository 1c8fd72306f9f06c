"""Counts of tables that are too large for copies of their rows: all ways, on small tables."""

from __future__ import annotations

import math
from itertools import combinations

import pytest

from determina.functions import masks
from determina.operators import checks, counts
from determina.plans import discover, prover

KINDS = "k int, a bigint, x double, f float, s string, b binary, t timestamp, m decimal(9,2), l array<int>"


def rows(n: int):
    import datetime
    import decimal

    zero, nan = (0.0, -0.0), (math.nan, None)
    for i in range(n):
        yield (
            i % 97, None if i % 5 == 0 else i % 31, zero[i % 2] if i % 3 else nan[i % 2], float(i % 4) if i % 7 else math.nan,
            None if i % 6 == 0 else f"s{i % 8}", bytes([i % 3]), datetime.datetime(2020, 1, 1 + i % 9),
            decimal.Decimal(i % 13) / 4, [i % 2, 1] if i % 11 else None,
        )


@pytest.fixture
def ways(monkeypatch):
    taken, real = set(), counts._leading

    def leading(*given):
        way = real(*given)
        taken.add(way[0])
        return way

    monkeypatch.setattr(counts, "_leading", leading)
    monkeypatch.setattr(counts, "FEW", 30)
    monkeypatch.setattr(counts, "ROWS", 350)
    monkeypatch.setattr(counts, "COPIES", 3000)
    return taken


@pytest.mark.parametrize("hot", [1, 70, 10_000])
def test_counts_by_every_way(spark, monkeypatch, ways, hot):
    """Whatever the way, tuples are counted as Spark groups them: one NaN, one zero, missing is a value."""
    monkeypatch.setattr(counts, "HOT", hot)
    df = spark.createDataFrame(list(rows(700)), KINDS)
    sets = [masks.mask_of(s) for size in (1, 2, 4, 9) for s in combinations(range(1, 10), size)][::9]
    want = {m: df.select([df.columns[i - 1] for i in masks.ordinals_of(m)]).distinct().count() for m in sets}
    for count in (counts.set_counts, counts.set_counts_in_one_scan):
        assert {r.mask: r.n for r in count(df, sets).collect()} == want
    assert ways == {1: {"few", "hot"}, 70: {"few", "lead", "copies", "hot"}, 10_000: {"few", "lead", "copies"}}[hot]


def test_a_large_table_is_sent_once_for_each_leading_column(spark, ways):
    df = spark.range(3000).selectExpr("id", "id % 700 AS a", "id % 600 AS b", "id % 5 AS c")
    counted = counts.numbered_set_counts(df, [[2, 3], [2, 4], [2, 3, 4], [3, 4], [1, 2], [1, 2, 3]])
    text = counted._jdf.queryExecution().executedPlan().toString()
    # Sets around the key ``id`` are known; the others meet by a or b, without an exchange of copies.
    assert text.count("REPARTITION_BY_NUM") == 2 and "Generate explode" not in text
    assert {r.at: r.n for r in counted.collect()} == {0: 3000, 1: 700, 2: 3000, 3: 600, 4: 3000, 5: 3000}


def test_tuples_beyond_a_number_of_64_bits(spark, monkeypatch, ways):
    monkeypatch.setattr(counts, "ROWS", 4000)
    df = spark.range(4000).selectExpr(*[f"(id * {k}) % 3989 AS c{k}" for k in (1, 3, 5, 7, 11, 13)])
    assert [r.n for r in counts.set_counts(df, [63]).collect()] == [3989]


def test_groups_are_tested_on_spread_rows(spark, monkeypatch):
    """A task makes about as many copies as wanted, though the table lies in one partition."""
    df = spark.createDataFrame([(i % 3, i % 5, i % 7) for i in range(210)], "a int, b int, c int").coalesce(1)
    cands = spark.createDataFrame([(1, 2), (3, 3), (5, 2)], "lhs bigint, rhs int")
    plain = sorted(tuple(r) for r in checks.group_verdicts(df, 1, cands).collect())
    monkeypatch.setattr(counts, "COPIES", 100)
    spread = checks.group_verdicts(df, 1, cands)
    assert "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in spread.collect()) == plain and len(plain) == 9


def test_rows_of_a_value_tell_all_they_agree_on(spark):
    df = spark.createDataFrame(list(rows(200)), KINDS).select("k", "a", "x", "f", "s")
    plain = df.selectExpr("k", "a", "x", "f", "s", "monotonically_increasing_id() AS id").cache()
    same = " + ".join(f"if(p.{c} <=> q.{c}, {1 << i}L, 0L)" for i, c in enumerate(("k", "a", "x", "f", "s")))
    for ordinal, name in ((1, "k"), (2, "a"), (3, "x")):
        pairs = plain.alias("p").join(plain.alias("q")).where(f"p.id < q.id AND p.{name} <=> q.{name}")
        want = {r.agree for r in pairs.selectExpr(f"{same} AS agree").distinct().collect()}
        got = [r.agree for r in counts.agreements(df, ordinal, 200).collect()]
        assert set(got) == want and len(got) == len(want) > 1
    assert counts.agreements(df.limit(0), 1, 0).isEmpty()


def test_left_sides_around_rare_values_need_no_tests(spark, monkeypatch):
    """Rows of rare values are compared once; no left side around them is tested, and all FDs are found."""
    df = spark.range(4000).selectExpr(
        "id div 4 AS a", "id * 7 % 900 AS b", "id * id % 13 AS c", "id % 4 AS d", "hash(id) % 3 AS e", "id * id % 13 % 2 AS f"
    ).cache()
    tested, real = [], prover.Prover.decide

    def decide(self, tests):
        tested.extend(t.lhs for t in tests)
        return real(self, tests)

    def found(**options):
        return {(tuple(r.lhs), r.rhs) for r in discover.discover_fds(df, **options).collect()}

    want = found(check="count")
    monkeypatch.setattr(prover.Prover, "decide", decide)
    monkeypatch.setattr(discover, "COMPARED_ROWS", 10)
    assert found(sample_rows=20, slice_rows=50) == want and len(want) > 5
    assert not any(lhs & 0b11 for lhs in tested)


def test_a_large_table_counts_the_open_tests_together(spark, monkeypatch):
    """However many portions of tests there are, rows are exchanged for two sets of counts at most."""
    df = spark.range(3000).selectExpr(*[f"hash(id, {k}) % {40 + k} AS c{k}" for k in range(5)], "id % 2 AS f").cache()
    plain = prover.Prover(df, 3000, [], check="count")
    large = prover.Prover(df, 3000, [], slice_rows=1000)
    assert plain.slices == large.slices // 3 == 1
    large.batch = 4
    calls, real = [], counts.set_counts
    monkeypatch.setattr(counts, "set_counts", lambda *given: calls.append(1) or real(*given))
    monkeypatch.setattr(checks, "one_left_side", None)
    tests = [checks.Test(m, 63 & ~m) for m in range(1, 63)]
    assert large.decide(tests) == plain.decide(tests) and len(calls) <= 2
