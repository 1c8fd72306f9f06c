import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

import determina as d
from determina.operators import dictionary, tables
from determina.sources.staging import checkpoint_root, fresh_path


def write_lines(tmp_path, lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_trailing_empty_cells(spark, tmp_path):
    df = d.read_delimited(spark, write_lines(tmp_path, ["a,,", ",,3", "a,,"]))
    assert sorted(map(tuple, df.collect())) == [("", "", "3"), ("a", "", "")]


def test_quotes_and_blanks(spark, tmp_path):
    df = d.read_delimited(spark, write_lines(tmp_path, ['"x,y",2,3', " 1,1.0,1"]))
    assert sorted(map(tuple, df.collect())) == [(" 1", "1.0", "1"), ("x,y", "2", "3")]


def test_short_rows_and_duplicates(spark, tmp_path):
    path = write_lines(tmp_path, ["1,2,3", "4", "1,2,3"])
    assert d.read_delimited(spark, path, distinct=False).count() == 3
    assert sorted(map(tuple, d.read_delimited(spark, path).collect())) == [("1", "2", "3"), ("4", "", "")]


def test_blank_line_is_a_row(spark, tmp_path):
    df = d.read_delimited(spark, write_lines(tmp_path, ["a", "", "b"]))
    assert sorted(map(tuple, df.collect())) == [("",), ("a",), ("b",)]


def test_split_lines(spark, tmp_path):
    df = d.read_split_lines(spark, write_lines(tmp_path, ['"x,y",2', "a,b,"]), drop=[2])
    assert sorted(map(tuple, df.collect())) == [('"x', "2"), ("a", "")]
    widths = d.line_widths(spark.read.text(write_lines(tmp_path, ["a,b", "c", "d,e"])))
    assert sorted(map(tuple, widths.collect())) == [(1, 1), (2, 2)]


def test_fd_lines(spark, tmp_path):
    fds = spark.createDataFrame([([4, 1], 7), ([1, 4], 2), ([], 3)], "lhs array<int>, rhs int")
    out = str(tmp_path / "out")
    d.write_fds(fds, out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == ["[]:column3", "[column1,column4]:column2,column7"]


def test_command_line(tmp_path):
    src = write_lines(tmp_path, ["1,a,x", "2,a,x", "3,b,x"])
    out = tmp_path / "out"
    subprocess.run(
        [sys.executable, "-m", "determina", src, str(out), "--checkpoints", str(tmp_path / "cp")],
        check=True, cwd=ROOT, timeout=300,
    )
    lines = [l for f in out.glob("part-*") for l in f.read_text().splitlines()]
    assert sorted(lines) == ["[]:column3", "[column1]:column2"]


@pytest.mark.parametrize("part", [1, 3, 10_000])
def test_frequent_and_rare_words_are_encoded(spark, monkeypatch, part):
    """Whichever words are broadcast, every cell has its word's id; a word of no row has none."""
    monkeypatch.setattr(dictionary, "FREQUENT", part)
    monkeypatch.setattr(dictionary, "FREQUENT_BYTES", 30)
    rows = [(i, "often" if i % 2 else None, "x" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, `a.b` string, word string")
    book = dictionary.build_dictionary(df)
    ids = {r.word: r.id for r in book.collect()}
    got = sorted(tuple(r) for r in dictionary.encode(df, book).collect())
    assert got == sorted((ids[str(i)], ids[a], ids[w]) for i, a, w in rows)
    assert dictionary.encode(df.limit(0), book).collect() == []
    other = spark.createDataFrame([("none", "often")], "a string, b string")
    assert [tuple(r) for r in dictionary.encode(other, book).collect()] == [(None, ids["often"])]


def test_dictionary_ids_are_dense_and_ordered(spark):
    df = spark.createDataFrame([("b", None), ("a", "c"), ("b", "")], "x string, y string")
    found = {r.word: r.id for r in dictionary.build_dictionary(df).collect()}
    assert found == {None: 0, "": 1, "a": 2, "b": 3, "c": 4}
    ids = dictionary.encode(df, dictionary.build_dictionary(df))
    assert sorted(map(tuple, ids.collect())) == [(2, 4), (3, 0), (3, 1)]


def test_encode_with_hot_and_cold_words(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("x"),
        F.lit("same").alias("y"),
    )
    book = {r.word: r.id for r in dictionary.build_dictionary(df).collect()}
    ids = dictionary.encode(df, dictionary.build_dictionary(df)).collect()
    expected = sorted((book[r.x], book[r.y]) for r in df.collect())
    assert sorted(map(tuple, ids)) == expected


def test_short_columns(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "x string, y int")
    out = dictionary.encode_short_columns(df, {"x": 3, "y": 3}, 10)
    assert sorted(map(tuple, out.collect())) == [(0, 2), (1, 3), (2, 1)]
    assert dictionary.encode_short_columns(df, {"x": 3}, 2).schema == df.schema


def test_long_values_and_maps_stay(spark, monkeypatch):
    df = spark.sql("select map(id % 2, 'a') m, repeat(cast(id as string), 9) t, id from range(6)")
    monkeypatch.setattr(dictionary, "MOST_BYTES", 20)
    assert dictionary.encode_short_columns(df, {"m": 2, "t": 6}, 10).schema == df.schema
    got = {(tuple(r.lhs), r.rhs) for r in d.discover_fds(df.select("m", "id")).collect()}
    assert got == {((2,), 1)}


def test_vocabulary_counts_missing(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert {r.word: r.n for r in tables.vocabulary(df).collect()} == {"a": 2, None: 2}


def test_checkpoint_folder(spark, tmp_path):
    assert fresh_path(spark) != fresh_path(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert checkpoint_root(spark)


@pytest.mark.parametrize("place", [0, 1, 2])
def test_wide_line_keeps_its_cells(spark, tmp_path, place):
    lines = ["1,2", "4,5"]
    lines.insert(place, 'a,"b,c",d')
    path = write_lines(tmp_path, lines)
    rows = sorted(map(tuple, d.read_delimited(spark, path).collect()))
    assert rows == [("1", "2", ""), ("4", "5", ""), ("a", "b,c", "d")]
    parts = sorted(map(tuple, d.read_split_lines(spark, path).collect()))
    assert parts == [("1", "2", "", ""), ("4", "5", "", ""), ("a", '"b', 'c"', "d")]


def test_wide_line_under_a_width_is_an_error(spark, tmp_path):
    path = write_lines(tmp_path, ['"a,a",2', "1,2,3"])
    for read in (d.read_delimited, d.read_split_lines):
        with pytest.raises(Exception, match="more than 2 cells"):
            read(spark, path, width=2).collect()
    fine = write_lines(tmp_path, ['"a,a",2', '"b""q,b",""'])
    assert sorted(map(tuple, d.read_delimited(spark, fine, width=2).collect())) == [("a,a", "2"), ('b"q,b', "")]


def test_nothing_staged_is_left(spark, tmp_path):
    """After a discovery, and after one that fails, only the result is in the folder."""
    import os

    root = checkpoint_root(spark).removeprefix("file:")
    there = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = there()
    df = spark.createDataFrame([(i, i % 3, i % 7, (i * i) % 5) for i in range(200)], "a int, b int, c int, e int")
    fds = d.discover_fds(df, stage_input=True)
    assert fds.count() > 0 and len(there() - before) == 1
    bad = df.selectExpr("a", "raise_error('broken') b")
    with pytest.raises(Exception, match="broken"):
        d.discover_fds(bad, stage_input=True)
    assert len(there() - before) == 1
