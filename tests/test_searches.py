"""The searches from both ends, by counts of free sets, by groups and in parts."""

import random
import threading
import time

import pytest
from brute import as_set, minimal_fds

import determina as d
from determina.functions import masks
from determina.operators import checks, counted, counts, lattice
from determina.plans import discover, free_sets, group_search, two_ended
from determina.sources.staging import scratch, stage


def table(spark, rows, kinds=None):
    return spark.createDataFrame(rows, ", ".join(f"x{i} {k}" for i, k in enumerate(kinds or ["int"] * len(rows[0]))))


def wide_sums(seed, width, modulus, n):
    """The last column is a sum of all others but one: its minimal left side is wide."""
    rnd = random.Random(seed)
    rows = [[rnd.randrange(modulus) for _ in range(width - 1)] for _ in range(n)]
    return [(*r, sum(r[:-1]) % modulus) for r in rows]


CASES = {
    "one_row": [(1, 2, 3)],
    "one_column": [(1,), (2,)],
    "two_columns": [(1, 1), (1, 2), (2, 1)],
    "nulls": [(None, 1, 2), (None, 1, 2), (1, None, 2), (2, 2, None), (1, 2, 2)],
    "equivalent": [(i, i, i % 2, i % 2, 7) for i in range(5)],
    "wide": wide_sums(1, 6, 3, 150),
    "random": [tuple(random.Random(i).choices([None, 0, 1, 2], k=4)) for i in range(12)],
}


@pytest.mark.parametrize("case", CASES)
def test_all_searches_agree_with_brute_force(spark, case):
    rows = CASES[case]
    df, want = table(spark, rows), minimal_fds(rows, len(rows[0]))
    assert as_set(d.discover_fds_from_both_ends(df)) == want
    assert as_set(d.discover_fds_by_count(df)) == want
    if case != "wide":
        assert as_set(d.discover_fds_by_groups(df)) == want


def test_texts_and_empty_table(spark):
    df = table(spark, [("a", 1, 2.0), ("b", 1, 2.5), (None, 2, 2.0), ("a", 1, 2.0)], ["string", "int", "double"])
    want = as_set(d.discover_fds(df))
    for search in (d.discover_fds_from_both_ends, d.discover_fds_by_count, d.discover_fds_by_groups):
        assert as_set(search(df)) == want
        assert as_set(search(df.where("false"))) == {((), 1), ((), 2), ((), 3)}
    assert as_set(d.discover_fds_by_count(df, max_lhs=1, columns=["x2", "x0"], constants="expand")) == {((2,), 1)}


def counted_sets(monkeypatch, search) -> int:
    """How many sets a search counts on the rows."""
    seen, real = [], counts.numbered_set_counts
    monkeypatch.setattr(counted, "numbered_set_counts", lambda df, sets: seen.extend(sets) or real(df, sets))
    search()
    monkeypatch.undo()
    return len(seen)


def test_wide_left_sides_need_few_counts_from_above(spark, monkeypatch):
    df = table(spark, wide_sums(2, 7, 4, 1500))
    both = counted_sets(monkeypatch, lambda: two_ended.discover_fds_from_both_ends(df).count())
    below = counted_sets(monkeypatch, lambda: free_sets.discover_by_free_sets(df).count())
    assert both < below


def test_a_smaller_fd_replaces_what_was_proved_from_above(spark):
    rows = [(a, b, c, e, (a + b) % 3) for a in range(3) for b in range(3) for c in range(2) for e in range(2)]
    found = as_set(d.discover_fds_from_both_ends(table(spark, rows)))
    assert ((1, 2), 5) in found and found == minimal_fds(rows, 5)


def test_counts_share_one_exchange_per_leading_column(spark):
    df = table(spark, [(i % 3, i % 4, i % 5, f"t{i % 2}") for i in range(60)], ["int", "int", "bigint", "string"])
    sets = [[1, 2], [1, 3], [1, 4], [1, 2, 3], [2, 3], [2, 4], [3, 4], [1], []]
    plan = counts.numbered_set_counts(df, sets)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # Three leading columns, one set alone; each has an exchange of values and one of counts.
    assert text.count("Exchange hashpartitioning(at") + text.count("Exchange hashpartitioning(k") <= 6 + 1
    got = {tuple(sets[r.at]): r.n for r in plan.collect()}
    assert got == {tuple(s): df.select([f"x{i - 1}" for i in s]).distinct().count() if s else 1 for s in sets}
    assert {r.n for r in counts.numbered_set_counts(df.where("false"), sets).collect()} == {0}


def test_counts_are_carried_and_dealt_in_portions(spark, monkeypatch):
    df = table(spark, [tuple(random.Random(i).choices(range(3), k=6)) for i in range(40)])
    sets = counted.from_masks(spark.range(1, 64).selectExpr("id AS mask", "0L AS n")).select("attrs")
    first = counted.count_sets(df, sets.where("size(attrs) < 3"))
    every = counted.count_sets(df, sets.unionByName(sets), first, portion=7)
    got = {tuple(r.attrs): r.n for r in every.collect()}
    assert len(got) == 63 == every.count()
    assert all(n == df.select([f"x{i - 1}" for i in s]).distinct().count() for s, n in got.items())
    assert counted_sets(monkeypatch, lambda: counted.count_sets(df, sets, every).count()) == 0


def test_candidate_counts_with_known(spark):
    df = table(spark, CASES["random"])
    cands = lattice.candidates(lattice.attribute_sets(spark, range(1, 5), 2), range(1, 5))
    plain = {(r.mask, r.n) for r in checks.candidate_counts(df, cands).collect()}
    known = counted.count_sets(df, counted.candidate_sets(cands.where("level = 1")))
    assert {(r.mask, r.n) for r in checks.candidate_counts(df, cands, known).collect()} == plain


def test_grouped_copy_is_read_without_an_exchange(spark):
    rows = [(0 if i % 3 == 0 else i % 50, i % 7, i % 5, f"t{i % 4}") for i in range(900)]
    df = table(spark, rows, ["int", "int", "int", "string"])
    tests = [(masks.mask_of([1, 2]), [3, 4]), (masks.mask_of([1, 3]), [2])]
    with scratch(spark):
        copy = group_search.GroupedCopy(df, 1, buckets=4)
        try:
            assert len(copy.parts) == 2, "a third of the rows share a value"
            got = {tuple(r) for r in copy.constancy(tests).collect()}
            copy.parts = copy.parts[:1]
            assert "Exchange" not in copy.constancy(tests)._jdf.queryExecution().executedPlan().toString()
        finally:
            copy.close()
    want = set()
    for value in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == value]
        for lhs, rhs in ((2, 3), (2, 4), (3, 2)):
            if len({(r[lhs - 1], r[rhs - 1]) for r in mine}) > len({r[lhs - 1] for r in mine}):
                want.add((value, masks.mask_of([1, lhs]), rhs))
    assert got == want


def test_groups_settled_by_a_smaller_set_are_not_read(spark, monkeypatch):
    read = []
    real = group_search.GroupedCopy.constancy
    monkeypatch.setattr(group_search.GroupedCopy, "constancy",
                        lambda self, tests, values=None: read.append(values and values.count()) or real(self, tests, values))
    rows = [(g, a, b, (a + b) % 3 if g == 0 else a % 3) for g in range(6) for a in range(3) for b in range(3)]
    df = table(spark, rows)
    assert as_set(d.discover_fds_by_groups(df)) == minimal_fds(rows, 4)
    assert None in read and any(n is not None and n < 6 for n in read)


def test_parts_overlap_in_time(spark, monkeypatch):
    spans, real = [], discover._Discovery._search_part

    def timed(self, number, fds, area):
        start = time.monotonic()
        out = real(self, number, fds, area)
        spans.append((start, time.monotonic()))
        return out

    monkeypatch.setattr(discover._Discovery, "_search_part", timed)
    rows = [tuple(random.Random(i).choices(range(4), k=6)) for i in range(30)]
    got = as_set(d.discover_fds_in_parts(table(spark, rows), [["x0", "x1", "x2"], ["x3", "x4", "x5"]]))
    assert got == minimal_fds(rows, 6)
    (a, b), (c, e) = spans
    assert max(a, c) < min(b, e)


def test_two_discoveries_in_two_threads(spark):
    rows = [tuple(random.Random(i).choices(range(4), k=4)) for i in range(30)]
    df, want, got = table(spark, rows), minimal_fds(rows, 4), {}

    def run(k):
        with scratch(spark):
            mine = stage(df, "mine")
            got[k] = (as_set(d.discover_fds_from_both_ends(mine) if k else d.discover_fds(mine)), mine.count())

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {0: (want, 30), 1: (want, 30)}


def test_containment_with_the_empty_set(spark):
    fds = counts.local_table(spark, [(0, 3), (3, 4), (1, 3)], "lhs bigint, rhs int")
    cands = counts.local_table(spark, [(1, 0, 3), (1, 3, 3), (1, 3, 4), (1, 1, 4), (1, 0, 4)], "level int, lhs bigint, rhs int")
    pairs = lambda df: sorted((r.lhs, r.rhs) for r in df.collect())
    assert pairs(lattice.prune_implied(cands, fds)) == [(0, 4), (1, 4)]
    assert pairs(lattice.prune_refuted(cands, fds)) == [(3, 3)]
    assert pairs(lattice.minimal_only(fds)) == [(0, 3), (3, 4)]
    assert pairs(lattice.maximal_only(fds)) == [(1, 3), (3, 4)]
    keys = [r.key for r in lattice._spread(cands).collect()]
    assert keys.count(0) == 2, "only empty sets have the key of the empty set"
