import random

import pytest
from brute import as_set, holds, minimal_fds
from pyspark.sql import types as T

import determina as d
from determina.plans import discover


def table(spark, rows, kinds=None):
    width = len(rows[0]) if rows else len(kinds)
    kinds = kinds or ["int"] * width
    return spark.createDataFrame(rows, ", ".join(f"x{i} {k}" for i, k in enumerate(kinds)))


XOR = [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]

CASES = {
    "null_on_right": ([(1, None), (1, "q"), (2, "z")], ["int", "string"], "2>1"),
    "null_equals_null_left": ([(None, 1), (None, 2), (3, 1)], None, ""),
    "null_equals_null_holds": ([(None, 1), (None, 1), (3, 2)], None, "1>2 2>1"),
    "all_null_column": ([(1, None), (2, None)], None, ">2"),
    "one_row": ([(1, 2, 3)], None, ">1 >2 >3"),
    "no_rows": ([], ["int", "string"], ">1 >2"),
    "one_column": ([(1,), (2,)], None, ""),
    "two_columns_nothing": ([(1, 1), (1, 2), (2, 1)], None, ""),
    "three_columns": (XOR, None, "1,2>3 1,3>2 2,3>1"),
    "four_equivalent": (
        [(i,) * 4 for i in range(3)], None,
        " ".join(f"{a}>{b}" for a in range(1, 5) for b in range(1, 5) if a != b),
    ),
    "five_equivalent": (
        [(i,) * 5 for i in range(3)], None,
        " ".join(f"{a}>{b}" for a in range(1, 6) for b in range(1, 6) if a != b),
    ),
    "substitution": (
        [(*r, r[0]) for r in XOR], None, "1,2>3 2,4>3 1,3>2 3,4>2 2,3>1 2,3>4 1>4 4>1"
    ),
    "repeated_rows": (XOR * 3, None, "1,2>3 1,3>2 2,3>1"),
    "empty_is_not_null": ([("", 1), (None, 2), ("", 1)], ["string", "int"], "1>2 2>1"),
    "key_like_pairs": (
        [(1, "a b", "c"), (2, "a", "b c"), (3, "a b", "c d")], ["int", "string", "string"],
        "1>2 1>3 3>1 3>2",
    ),
    "nan_is_nan": ([(float("nan"), 1), (float("nan"), 1), (1.0, 2)], ["double", "int"], "1>2 2>1"),
    "arrays": ([([1], 1), ([1], 2), ([2], 3)], ["array<int>", "int"], "2>1"),
}


def parse(text):
    out = set()
    for fd in text.split():
        lhs, rhs = fd.split(">")
        out.add((tuple(int(i) for i in lhs.split(",") if i), int(rhs)))
    return out


@pytest.mark.parametrize("case", CASES)
def test_small_tables(spark, case):
    rows, kinds, expected = CASES[case]
    assert as_set(d.discover_fds(table(spark, rows, kinds))) == parse(expected)


def test_signed_zero_typed_and_as_text(spark):
    df = table(spark, [(0.0, 1), (-0.0, 1), (0.0, 1)], ["double", "int"])
    assert as_set(d.discover_fds(df)) == {((), 1), ((), 2)}
    assert as_set(d.discover_fds(df, as_text=True)) == {((), 2)}


def test_constants_expanded(spark):
    df = table(spark, [(1, 7, 8), (2, 7, 8)])
    assert as_set(d.discover_fds(df)) == {((), 2), ((), 3)}
    assert as_set(d.discover_fds(df, constants="expand")) == {
        ((), 2), ((), 3), ((1,), 2), ((1,), 3), ((2,), 3), ((3,), 2)
    }


def test_more_columns_than_a_mask_holds(spark):
    """Seventy columns that vary: sixty-two keys and eight with few values."""
    rnd = random.Random(4)
    few = [rnd.choices(range(3), k=7) for _ in range(25)]
    rows = [(*f[:4], *[i * 7 + k for k in range(62)], *f[4:], (f[0] + f[1]) % 3) for i, f in enumerate(few)]
    df = table(spark, rows)
    want = minimal_fds(rows, 70, 2)
    assert any(len(lhs) == 2 for lhs, _ in want)
    assert as_set(d.discover_fds(df, max_lhs=2)) == want
    wide = table(spark, [(1, *[0] * 69, 1), (2, *[0] * 69, 2)])
    found = as_set(d.discover_fds(wide))
    assert ((1,), 71) in found and ((71,), 1) in found and ((), 70) in found
    assert len(found) == 71


def test_names_with_dots_and_ticks(spark):
    df = table(spark, XOR).toDF("a.b", "c`d", "e f")
    assert as_set(d.discover_fds(df)) == parse("1,2>3 1,3>2 2,3>1")
    assert d.violations(df, ["a.b"], "c`d").count() == 2


def test_repeated_names_and_staged_input(spark):
    df = table(spark, XOR).toDF("a", "b", "a")
    assert as_set(d.discover_fds(df, stage_input=True)) == parse("1,2>3 1,3>2 2,3>1")


def test_wrong_options(spark):
    df = table(spark, XOR)
    for options in ({"check": "no"}, {"constants": "no"}):
        with pytest.raises(ValueError):
            d.discover_fds(df, **options)


def random_rows(seed, n, widths, nulls=0.05):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        row = [None if rnd.random() < nulls else rnd.randrange(w) for w in widths]
        rows.append(row)
    # A dependent column and an equal one, so that there is something to find.
    for r in rows:
        r.append(((r[0] or 0) * 7 + (r[1] or 0)) % 5 if len(r) > 1 else 0)
        r.append(r[1] if len(r) > 2 else 0)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", range(3))
def test_random_small(spark, seed):
    rows = random_rows(seed, 12, [2, 3, 4, 3])
    rows = [(*r[:2], None if r[2] is None else f"t{r[2]}", *r[3:]) for r in rows]
    df = table(spark, rows, ["int", "bigint", "string", "int", "int", "bigint"])
    expected = minimal_fds(rows, 6)
    assert as_set(d.discover_fds(df)) == expected
    assert as_set(d.discover_fds_by_count(df)) == expected
    for lhs, rhs in expected:
        assert holds(rows, lhs, rhs)


@pytest.mark.parametrize("short", [10_000, 2])
def test_random_with_sample_slices_and_shared_rows(spark, monkeypatch, short):
    """Settings that make a small table take the way of a large one."""
    monkeypatch.setattr(discover, "PERSIST_CELLS", 0)
    monkeypatch.setattr(discover, "SHARE_FROM", 2)
    monkeypatch.setattr(discover, "SHORT_COLUMN", short)
    rows = random_rows(7, 900, [400, 30, 300, 20, 40], nulls=0.01)
    rows = [(*r[:2], f"t{r[2]}", *r[3:]) for r in rows]
    df = table(spark, rows, ["int", "int", "string", "int", "int", "int", "int"])
    df = df.withColumn("x4", df.x4 * 1.5)
    found = as_set(d.discover_fds(df, sample_rows=60, slice_rows=90))
    assert found == minimal_fds(rows, 7)


def test_search_in_parts_and_limits(spark):
    rows = random_rows(11, 40, [3, 4, 5, 3])
    df = table(spark, rows)
    expected = minimal_fds(rows, 6)
    assert as_set(d.discover_fds_in_parts(df, [["x0", "x1", "x4"], ["x2", "x3", "x5"]])) == expected
    assert as_set(d.discover_fds(df, max_lhs=2)) == {f for f in expected if len(f[0]) <= 2}
    some = minimal_fds([(r[3], r[1], r[4]) for r in rows], 3)
    assert as_set(d.discover_fds(df, columns=["x3", "x1", "x4"])) == some


def test_one_hot_group(spark):
    """One value holds most rows; another breaks the dependency once."""
    rows = [(0, 1, i % 3) for i in range(400)] + [(i, i % 2, i % 3) for i in range(1, 150)]
    rows += [(149, 0, 2)]
    df = table(spark, rows)
    assert as_set(d.discover_fds(df, sample_rows=40, slice_rows=50)) == minimal_fds(rows, 3)


def test_masks():
    from determina.functions import masks

    assert masks.ordinals_of(masks.mask_of([63, 1, 7])) == [1, 7, 63]
    with pytest.raises(ValueError):
        masks.mask_of([64])


def test_structs(spark):
    kind = T.StructType([T.StructField("s", T.StructType([T.StructField("a", T.StringType())])),
                         T.StructField("k", T.IntegerType())])
    df = spark.createDataFrame([(("u",), 1), (("u",), 1), (("v",), 2), ((None,), 3)], kind)
    assert as_set(d.discover_fds(df)) == {((1,), 2), ((2,), 1)}
