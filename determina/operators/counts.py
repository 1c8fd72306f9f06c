"""Distinct counts of attribute sets, and groups of rows.

Every count is a grouping followed by a count of the groups. Spark combines equal
keys before the shuffle, so a value held by a third of all rows is sent once per map
task. Nulls group together, so one missing value is one value.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from determina.functions import cells, masks

# Sets counted by one action. Each is its own small plan over the columns it needs.
BATCH = 32

# Sets counted by one plan that shares exchanges.
PLAN = 128

# Sets with at most this many different tuples are combined where the rows are read.
FEW = 100_000

# Copies of rows, one per row and set, that a task combines.
COPIES = 1_000_000

# Rows that a task numbers, and rows of a value from which it is hot: no rows meet by it.
ROWS = HOT = 250_000

_NUMBERED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small table of facts the driver holds. Spark knows its size, so a join with
    it is a broadcast only while it is small."""
    kind = T.StructType.fromDDL(schema)
    rows = list(rows)
    arrow = pa.table(
        [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kind)],
        names=kind.names,
    )
    return spark.createDataFrame(arrow, kind)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def batches(items: Sequence, size: int = BATCH) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def set_count(df: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """One row ``n``: the number of different tuples in some columns.

    No columns make one empty tuple if the table has rows.
    """
    names = [cells.sql_name(n) for n in cells.names_at(df, sorted(ordinals))]
    if not names:
        return df.agg(F.expr("least(count(1), 1L) AS n"))
    return df.select(*names).distinct().agg(F.expr("count(1) AS n"))


class Sizes(NamedTuple):
    """Rows of a table and, by column number, the different values and the rows of the most frequent one."""

    n_rows: int
    values: dict[int, int]
    largest: dict[int, int]


# What was measured, for as long as the caller keeps the table.
_measured: WeakKeyDictionary[DataFrame, Sizes] = WeakKeyDictionary()


def column_sizes(df: DataFrame) -> Sizes:
    """The sizes of all columns of a table, measured once for each handle of it."""
    if df not in _measured:
        found: list = []
        for names in batches(df.columns):
            start = len(found)
            part = df.select([cells.quoted(n) for n in names])
            found += [(start + r.ordinal, r.n, r.n_rows, r.max_group) for r in column_profile(part).collect()]
        remember_sizes(df, found)
    return _measured[df]


def remember_sizes(df: DataFrame, found: Iterable[tuple[int, int, int, int]]) -> None:
    """File (number, different values, rows, rows of the most frequent value) of all columns of a table."""
    found = list(found)
    _measured[df] = Sizes(
        max((rows for _, _, rows, _ in found), default=0),
        {i: n for i, n, _, _ in found}, {i: most for i, _, _, most in found},
    )


def _copies(rows: DataFrame, kinds: Sequence[str], lead: int, sets: Sequence[tuple[int, Sequence[int]]]) -> DataFrame:
    """``at, k<lead>, v...``: a row of the columns ``k<number>`` once per set, with the set's other
    columns in slots, one for each type and place, so a copy is as wide as the widest set and not
    as wide as the table."""
    slots: dict[tuple[str, int], list[str]] = {}
    for at, others in sets:
        filled: dict[str, int] = {}
        for i in others:
            kind = kinds[i - 1]
            place = filled[kind] = filled.get(kind, -1) + 1
            slots.setdefault((kind, place), []).append(f"WHEN {at} THEN k{i}")
    values = [f"CASE at {' '.join(when)} END AS v{j}" for j, when in enumerate(slots.values())]
    sent = f"explode(array({', '.join(str(at) for at, _ in sets)})) AS at"
    return rows.selectExpr(*rows.columns, sent).selectExpr("at", f"k{lead}", *values)


def _led_by(
    df: DataFrame, lead: int, sets: Sequence[tuple[int, Sequence[int]]], sizes: Sizes, way: str
) -> DataFrame:
    """``at, n`` for sets that share a leading column, from one scan. ``sets`` are (number, other columns).

    ``way`` is how equal tuples meet:

    * ``few``: copies are combined where they are read, then in one exchange of the few left;
    * ``lead``: rows meet by their leading value, in so many tasks that each has about ``ROWS``, and
      are not copied: a task numbers the values of its columns and counts different numbers;
    * ``copies``: as ``lead`` for types that are not numbered, with ``COPIES`` copies in a task;
    * ``hot``: rows are spread by all their values, so that no task makes more copies, and the
      combined copies are exchanged by theirs, so a frequent leading value lies in no single task.
    """
    kinds = [f.dataType.simpleString() for f in df.schema]
    names = [cells.sql_name(n) for n in df.columns]
    used = sorted({lead, *(i for _, others in sets for i in others)})
    if way == "lead":
        # One zero and one NaN, as Spark groups them.
        rows = df.selectExpr(*[f"{_as_grouped(df, i)} AS k{i}" for i in used])
        places = [[(at, [used.index(i) for i in (lead, *others)]) for at, others in sets]]
        counted = rows.repartition(-(-sizes.n_rows // ROWS), f"k{lead}").mapInArrow(_count_numbers(places), "at int, n bigint")
        return counted.groupBy("at").agg(F.sum("n").alias("n"))
    rows = df.selectExpr(*[f"{names[i - 1]} AS k{i}" for i in used])
    if way != "few":
        tasks = -(-sizes.n_rows * len(sets) // COPIES)
        rows = rows.repartition(tasks, *([f"k{lead}"] if way == "copies" else rows.columns))
    return _copies(rows, kinds, lead, sets).distinct().groupBy("at").agg(F.expr("count(1) AS n"))


def _as_grouped(df: DataFrame, ordinal: int) -> str:
    """A column's value with one zero and one NaN, as Spark groups them."""
    field = df.schema[ordinal - 1]
    name = cells.sql_name(field.name)
    return f"nanvl({name}, double('NaN')) + 0D" if isinstance(field.dataType, T.FractionalType) and not isinstance(field.dataType, T.DecimalType) else name


def _numbering():
    """Task code, made here so that it travels with the code that calls it: batches to the values of each
    column as numbers from 1, missing as 0, how many numbers there are and, if ``named``, the values of
    the last column in their order."""

    def numbered(batches, named: bool = False) -> tuple[list[np.ndarray], list[int], list]:
        coded: list[list[pa.Array]] = []
        for batch in batches:
            coded.append([pc.dictionary_encode(column) for column in batch.columns])
        numbers, most, own = [], [], []
        for chunks in zip(*coded, strict=True):
            column = pa.chunked_array(chunks).unify_dictionaries()
            codes = [chunk.indices.fill_null(-1).to_numpy(zero_copy_only=False) for chunk in column.chunks]
            numbers.append(np.concatenate(codes).astype(np.int64) + 1)
            most.append(len(column.chunk(0).dictionary) + 1)
        if coded and named:
            own = column.chunk(0).dictionary.to_pylist()
        return numbers, most, own

    return numbered


def _count_numbers(turns: Sequence[Sequence[tuple[int, Sequence[int]]]]):
    """Task code: rows to ``at, n``, the different tuples of each of some sets of columns in them. With
    several turns the last column tells whose sets a row is for."""
    numbered = _numbering()

    def run(batches):
        numbers, most, own = numbered(batches, len(turns) > 1)
        if not numbers:
            return
        for turn, sets in enumerate(turns):
            mine = numbers
            if len(turns) > 1:
                here = np.flatnonzero(numbers[-1] == own.index(turn) + 1) if turn in own else []
                if not len(here):
                    continue
                mine = [codes[here] for codes in numbers]
            for at, members in sets:
                code, size = mine[members[0]], most[members[0]]
                for i in members[1:]:
                    if size * most[i] >= 1 << 62:
                        values, code = np.unique(code, return_inverse=True)
                        size = len(values)
                    code, size = code * most[i] + mine[i], size * most[i]
                code = np.sort(code)
                n = 1 + int(np.count_nonzero(code[1:] != code[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64())], ["at", "n"])

    return run


def agreements(df: DataFrame, ordinal: int, n_rows: int) -> DataFrame:
    """``agree BIGINT``: every set of columns on which two rows that share a column's value agree, with
    no column left out.

    The rows meet by that column in one exchange, and a task compares each row with all others of its
    value. For columns that tasks number and whose values are held by few rows each, and for few
    columns, since a task notes which of their sets it has seen.
    """
    rows = df.selectExpr(*[f"{_as_grouped(df, i)} AS k{i}" for i in range(1, len(df.columns) + 1)])
    met = rows.repartition(max(1, -(-n_rows // ROWS)), f"k{ordinal}")
    return met.mapInArrow(_compare(ordinal - 1), "agree bigint").distinct()


def _compare(lead: int):
    """Task code: rows to the sets of columns on which two rows of one value of column ``lead`` agree."""
    numbered = _numbering()

    def run(batches):
        numbers, _, _ = numbered(batches)
        if not numbers:
            return
        order = np.argsort(numbers[lead], kind="stable")
        columns = [column[order].astype(np.int32) for column in numbers]
        first = np.flatnonzero(np.diff(columns[lead], prepend=-1))
        sizes = np.diff(np.append(first, len(order)))
        after = np.repeat(first + sizes, sizes) - 1 - np.arange(len(order))
        seen = np.zeros(1 << len(columns), bool)
        apart, at = 1, np.flatnonzero(after)
        while len(at):
            most = 2 * len(at) > len(order)
            agree = np.zeros(len(order) - apart if most else len(at), np.int32)
            for i, column in enumerate(columns):
                same = column[:-apart] == column[apart:] if most else column[at] == column[at + apart]
                agree |= same.astype(np.int32) << i
            seen[agree[at] if most else agree] = True
            apart += 1
            at = at[after[at] >= apart]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int64())], ["agree"])

    return run


def is_numbered(kind: T.DataType, n: int) -> bool:
    """Whether tasks number the values of a column of ``n`` values: texts only if they are few, since
    a task keeps its different values."""
    return isinstance(kind, _NUMBERED) or (n <= FEW and kind.simpleString() in ("string", "binary"))


def _leading(df: DataFrame, members: Sequence[int], sizes: Sizes) -> tuple[str, int]:
    """How the tuples of some columns meet, and the column that leads: the one of most values that is
    never hot."""
    lead = min(members)
    if min(sizes.n_rows, math.prod(sizes.values[i] for i in members)) <= FEW:
        return "few", lead
    even = [i for i in members if sizes.largest[i] <= HOT]
    if not even:
        return "hot", lead
    numbered = all(is_numbered(df.schema[i - 1].dataType, sizes.values[i]) for i in members)
    return "lead" if numbered else "copies", max(even, key=lambda i: (sizes.values[i], -i))


def numbered_set_counts(df: DataFrame, sets: Sequence[Sequence[int]]) -> DataFrame:
    """``at INT, n BIGINT``: different tuples of each of some lists of column numbers, by its place
    in the list. One exchange per leading column serves all sets that it leads.

    The columns are counted first. A set around a column without repeated values has as many tuples
    as the table has rows.
    """
    sizes = column_sizes(df)
    known, led = _dealt(df, sets, sizes)
    parts = [_led_by(df, lead, own, sizes, way) for (way, lead), own in led.items()]
    return union_all([local_table(df.sparkSession, known, "at int, n bigint"), *parts])


def _dealt(df: DataFrame, sets: Sequence[Sequence[int]], sizes: Sizes):
    """(place, count) of the sets whose count the sizes tell, and (place, other columns) of the others
    by the way of their tuples and their leading column."""
    led: dict[tuple[str, int], list[tuple[int, Sequence[int]]]] = {}
    known: list[tuple[int, int]] = []
    for at, members in enumerate(sets):
        members = sorted(members)
        if not members:
            known.append((at, min(sizes.n_rows, 1)))
        elif len(members) == 1:
            known.append((at, sizes.values[members[0]]))
        elif any(sizes.values[i] == sizes.n_rows for i in members):
            known.append((at, sizes.n_rows))
        else:
            way, lead = _leading(df, members, sizes)
            led.setdefault((way, lead), []).append((at, [i for i in members if i != lead]))
    return known, led


def set_counts(df: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """``mask BIGINT, n BIGINT`` for many attribute sets.

    Up to ``PLAN`` sets make one plan, with one exchange per leading column. A longer list
    runs portion by portion, so that no plan grows with it; what comes back is one number per
    set the caller named.
    """
    wanted = sorted(set(wanted))
    spark = df.sparkSession
    if not wanted:
        return local_table(spark, [], "mask bigint, n bigint")
    if len(wanted) <= PLAN:
        names = local_table(spark, list(enumerate(wanted)), "at int, mask bigint")
        return names.join(numbered_set_counts(df, [masks.ordinals_of(m) for m in wanted]), "at").select("mask", "n")
    # Sets of one leading column in as few portions as can be: each portion exchanges the rows for each of its.
    sizes = column_sizes(df)
    wanted.sort(key=lambda mask: (_leading(df, masks.ordinals_of(mask) or [1], sizes), mask))
    rows = [row for part in batches(wanted, PLAN) for row in set_counts(df, part).collect()]
    return local_table(spark, rows, "mask bigint, n bigint")


def set_counts_in_one_scan(df: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """As ``set_counts``, with all sets of a way in one exchange. Better for small tables, where the
    plans cost more than the rows; a large table is better read set by set, a few columns at a time.

    Sets of few tuples get each row with the columns outside them blanked, and the copies are combined
    before the exchange. For the others a row is sent once for each leading column.
    """
    wanted = sorted(set(wanted))
    spark = df.sparkSession
    if not wanted:
        return local_table(spark, [], "mask bigint, n bigint")
    sizes = column_sizes(df)
    known, led = _dealt(df, [masks.ordinals_of(m) for m in wanted], sizes)
    parts = [local_table(spark, [(wanted[at], n) for at, n in known], "mask bigint, n bigint")]
    for spread in (False, True):
        sent = [wanted[at] for (way, _), own in led.items() for at, _ in own if way != "lead" and (way != "few") == spread]
        if sent:
            parts.append(_blanked(df, sent, sizes.n_rows if spread else 0))
    turns = [(lead, own) for (way, lead), own in led.items() if way == "lead"]
    if turns:
        names = local_table(spark, list(enumerate(wanted)), "at int, mask bigint")
        parts.append(names.join(_in_turns(df, turns, sizes), "at").select("mask", "n"))
    return union_all(parts)


def _blanked(df: DataFrame, wanted: Sequence[int], n_rows: int) -> DataFrame:
    """``mask, n``: each row goes to every set with the columns outside it blanked. With ``n_rows`` the
    rows are spread first, so that a task makes about ``COPIES`` copies."""
    used = masks.ordinals_of(reduce(lambda a, b: a | b, wanted))
    name = {i: cells.sql_name(n) for i, n in enumerate(df.columns, 1)}
    sent = f"explode(array({', '.join(f'{m}L' for m in wanted)})) AS mask"
    kept = [f"if(mask & {1 << (i - 1)}L = 0L, NULL, k{i}) AS k{i}" for i in used]
    rows = df.selectExpr(*[f"{name[i]} AS k{i}" for i in used])
    if n_rows:
        rows = rows.repartition(-(-n_rows * len(wanted) // COPIES), *rows.columns)
    return rows.selectExpr("*", sent).selectExpr("mask", *kept).distinct().groupBy("mask").agg(F.expr("count(1) AS n"))


def _in_turns(df: DataFrame, turns: Sequence[tuple[int, Sequence[tuple[int, Sequence[int]]]]], sizes: Sizes) -> DataFrame:
    """``at, n`` of sets of several leading columns: a row once for each of these, in one exchange."""
    columns = [sorted({lead, *(i for _, others in own for i in others)}) for lead, own in turns]
    used = sorted({i for part in columns for i in part})
    rows = df.selectExpr(*[f"{_as_grouped(df, i)} AS k{i}" for i in used], f"explode(sequence(0, {len(turns) - 1})) AS turn")
    spot = " ".join(f"WHEN {turn} THEN xxhash64(k{lead})" for turn, (lead, _) in enumerate(turns))
    kept = [f"if(turn IN ({', '.join(str(t) for t, part in enumerate(columns) if i in part)}), k{i}, NULL) AS k{i}" for i in used]
    tasks = -(-sizes.n_rows * len(turns) // ROWS)
    copies = rows.selectExpr(*kept, "turn", f"CASE turn {spot} END AS spot").repartition(tasks, "turn", "spot").drop("spot")
    places = [[(at, [used.index(i) for i in (lead, *others)]) for at, others in own] for lead, own in turns]
    return copies.mapInArrow(_count_numbers(places), "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: ``ordinal, name, n`` (different values), ``n_rows, max_group``
    (rows of the most frequent value) and ``has_null``. Reads each column once."""
    parts = []
    for i, name in enumerate(df.columns, 1):
        groups = df.groupBy(cells.quoted(name).alias("value")).agg(F.expr("count(1) AS rows"))
        parts.append(
            groups.agg(
                F.expr(f"{i} AS ordinal"),
                F.lit(name).alias("name"),
                F.expr("count(1) AS n"),
                F.expr("coalesce(sum(rows), 0L) AS n_rows"),
                F.expr("coalesce(max(rows), 0L) AS max_group"),
                F.expr("coalesce(max(value IS NULL), false) AS has_null"),
            )
        )
    return union_all(parts)


def column_counts(df: DataFrame) -> DataFrame:
    """``ordinal INT, n BIGINT``: different values of each column."""
    return union_all(
        [set_count(df, [i]).selectExpr(f"{i} AS ordinal", "n")
         for i in range(1, len(df.columns) + 1)]
    )


def constant_columns(counts: DataFrame) -> DataFrame:
    """Columns with one value at most (none in an empty table)."""
    return counts.filter(F.col("n") <= 1).select("ordinal")


def varying_columns(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("n") > 1)


def pair_counts(df: DataFrame, ordinals: Iterable[int]) -> DataFrame:
    """``a INT, b INT, n BIGINT`` with ``a < b``: different pairs of two columns."""
    wanted = [masks.mask_of(p) for p in combinations(sorted(ordinals), 2)]
    counts = set_counts(df, wanted)
    member = masks.members(F.col("mask"))
    return counts.select(
        F.element_at(member, 1).alias("a"), F.element_at(member, 2).alias("b"), "n"
    )


def rank_columns(counts: DataFrame) -> DataFrame:
    """Columns from most to fewest different values, equal counts by number.

    One row per column of the table, so the ranking window is as small as the schema.
    """
    order = Window.orderBy(F.desc("n"), F.asc("ordinal"))
    return counts.select("ordinal", "n", F.row_number().over(order).alias("position"))


def group_sizes(df: DataFrame, ordinal: int) -> DataFrame:
    """``value, n_rows`` of each group of rows sharing a column's value."""
    (name,) = cells.names_at(df, [ordinal])
    return df.groupBy(cells.quoted(name).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def group_count(df: DataFrame, ordinal: int) -> DataFrame:
    """One row ``n_groups``."""
    return set_count(df, [ordinal]).select(F.col("n").alias("n_groups"))
