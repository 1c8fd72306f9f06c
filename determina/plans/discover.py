"""Discovery of all minimal functional dependencies of a table.

The rows stay in Spark. The driver steers: it names the attribute sets of the next
batch of tests and reads one row per test. Candidates, FDs and failures are small
staged tables, pruned by joins.

Order of work:

1. one pass per column for its counts; constants leave;
2. evidence against candidates from a bounded sample; of large tables of few columns also
   all failures around columns whose values are held by few rows each;
3. one-column FDs; equivalent columns leave but one;
4. for right sides without an FD so far, all other columns as the left side: if they
   do not determine it, nothing does;
5. level by level, candidates that no FD, failure or count has settled are tested on
   all rows;
6. equivalents and constants come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from copy import copy
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.functions import cells, masks
from determina.operators import checks, classes, counts, lattice
from determina.operators.dictionary import encode_short_columns
from determina.plans.evidence import ColumnProfile, failures_in_sample
from determina.plans.free_sets import discover_by_free_sets
from determina.plans.prover import SLICE_ROWS, Prover, SharedRows
from determina.plans.reduced import numbered_columns
from determina.sources.staging import scratch, stage, stage_result

# Cells up to which the columns in use are kept in memory between tests. Larger tables
# are written once with short columns encoded, and each test reads only its columns.
PERSIST_CELLS = 400_000_000

SAMPLE_ROWS = 5_000

# Texts of columns with no more different values than this are searched as numbers.
SHORT_COLUMN = 10_000

# Left sides to test from which looking for the rows that matter to them is worth it.
SHARE_FROM = 8

# Groups of columns searched at the same time.
PARTS_AT_ONCE = 8

# Tables of at most this many columns have the rows of a value compared with each other, for columns
# without a value of more rows.
COMPARED_COLUMNS = 12
COMPARED_ROWS = 2_000

# Tables of fewer rows than this many samples are tested without a sample.
EVIDENCE_FROM = 4


class Settings(NamedTuple):
    check: str = "group"
    max_lhs: int | None = None
    sample_rows: int = SAMPLE_ROWS
    slice_rows: int = SLICE_ROWS


def discover_fds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_lhs: int | None = None,
    constants: str = "strict",
    as_text: bool = False,
    check: str = "group",
    parts: Sequence[Sequence[str]] | None = None,
    stage_input: bool = False,
    sample_rows: int = SAMPLE_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """All minimal FDs of a table: ``lhs ARRAY<INT>, rhs INT`` in column numbers.

    ``columns`` limits the search to some columns, which keep their numbers in the
    order given. ``max_lhs`` limits the size of left sides. ``constants="expand"``
    also reports every other column for a constant one. ``as_text`` compares texts
    instead of typed values. ``check`` is ``"group"`` or ``"count"``. ``parts`` are
    disjoint groups of columns to search within before searching across them.
    ``stage_input`` first writes the table to the shared folder: for text files, joins
    and other inputs that cost more to make than to read, since the profile reads them
    once per column. Missing values are equal to each other. The result does not
    depend on ``check``, ``parts`` and the settings after it.
    """
    if check not in ("group", "count"):
        raise ValueError("check is 'group' or 'count'")
    if constants not in ("strict", "expand"):
        raise ValueError("constants is 'strict' or 'expand'")
    if columns is not None:
        df = df.select([cells.quoted(c) for c in columns])
    if not df.columns:
        raise ValueError("the table has no columns")
    # Numbers for names: they may repeat, as after a join.
    numbered = {name: f"c{i}" for i, name in enumerate(df.columns, 1)}
    df = df.toDF(*[f"c{i}" for i in range(1, len(df.columns) + 1)])
    if parts is not None:
        parts = [[numbered[n] for n in part] for part in parts]
    if as_text:
        df = cells.cast_all(df, "string")
    settings = Settings(check, max_lhs, sample_rows, slice_rows)
    with scratch(df.sparkSession):
        if stage_input:
            df = stage(df, "input")
        return _Discovery(df, settings).run(constants, parts)


def discover_fds_by_count(
    df: DataFrame, columns: Sequence[str] | None = None, max_lhs: int | None = None,
    constants: str = "strict", as_text: bool = False, stage_input: bool = False,
) -> DataFrame:
    """``discover_fds`` by counts of free sets alone, for tables of any number of columns."""
    df = numbered_columns(df, columns, as_text)
    with scratch(df.sparkSession):
        if stage_input:
            df = stage(df, "input")
        return discover_by_free_sets(df, max_lhs, constants)


def discover_fds_in_parts(
    df: DataFrame, parts: Sequence[Sequence[str]], **options
) -> DataFrame:
    """``discover_fds``, first within groups of columns and then across them.

    What holds among some columns of a table holds in the table, so the FDs and the
    failures within a group are final when the search across starts. The groups are
    searched at once, each by its own thread of Spark jobs.
    """
    return discover_fds(df, parts=parts, **options)


class _Discovery:
    def __init__(self, df: DataFrame, settings: Settings):
        self.spark = df.sparkSession
        self.source = df
        self.settings = settings
        self.width = len(df.columns)

    def _test_candidates(self, cands: DataFrame) -> list[tuple[int, int]]:
        """Test a table of candidates that no failure known refutes, in driver-sized portions; FDs
        as pairs."""
        grouped = cands.groupBy("lhs").agg(F.bit_or(masks.bit(F.col("rhs"))).alias("rhs"))
        asked = sorted(checks.Test(r.lhs, r.rhs) for r in grouped.toLocalIterator())
        # All failures around a column whose rows were compared are known: what is left holds.
        found = [(t.lhs, t.rhs) for t in asked if t.lhs & self.compared]
        tests = [t for t in asked if not t.lhs & self.compared]
        self._share([t.lhs for t in tests])
        lessons = []
        for shared in (False, True):
            prover = self.shared.prover if shared else self.prover
            mine = [t for t in tests if self.shared.covers(t.lhs) == shared]
            if prover:
                found += prover.decide(mine)
            lesson = prover.new_failures() if prover else None
            if lesson is not None:
                lessons.append(lesson)
        if lessons:
            seen = counts.union_all([f for f in [self.failures, *lessons] if f is not None]).distinct()
            self.failures = stage(lattice.maximal_only(seen), "failures")
        return [(lhs, a) for lhs, rhs in found for a in masks.ordinals_of(rhs)]

    def _share(self, open_lhs: list[int]) -> None:
        """Before many tests on many rows, look for rows that do for them."""
        left = [lhs for lhs in open_lhs if lhs.bit_count() > 1 and not self.shared.covers(lhs)]
        if self.prover.slices > 1 and len(left) >= SHARE_FROM:
            self.shared.add_for(left, {c.ordinal: c.n for c in self.profile})

    # -- small tables ---------------------------------------------------------

    def _pairs(self, pairs: Iterable[tuple[int, int]]) -> DataFrame:
        return counts.local_table(self.spark, pairs, "lhs bigint, rhs int")

    def _possible(self) -> str:
        """Enough values on the left: the numbers of different values multiply to no
        less than the right side has. In logarithms, with room for rounding."""
        sizes = {c.ordinal: math.log(c.n) for c in self.profile}
        most = " + ".join(f"if(lhs & {1 << (i - 1)}L = 0L, 0D, {v!r}D)" for i, v in sizes.items())
        least = " ".join(f"WHEN {i} THEN {v!r}D" for i, v in sizes.items())
        return f"{most} >= CASE rhs {least} END - 1e-6D"

    # -- stages ---------------------------------------------------------------

    def run(self, constants: str, parts) -> DataFrame:
        self._profile_columns()
        constant = [c for c in self.all_profile if c.n <= 1]
        varying = [c for c in self.all_profile if c.n > 1]
        if len(varying) > masks.MAX_COLUMNS:
            # Sets of so many columns do not fit a mask.
            return discover_by_free_sets(self.source, self.settings.max_lhs, constants)
        constant_table = counts.local_table(self.spark, [(c.ordinal,) for c in constant], "ordinal int")
        if self.settings.max_lhs == 0 or not varying:
            return stage_result(classes.constant_fds(
                constant_table, self.width, "strict" if self.settings.max_lhs == 0 else constants
            ), "fds")

        # The search numbers the columns that vary from 1; ``slots`` leads back.
        slots = {i: c.ordinal for i, c in enumerate(varying, 1)}
        self.profile = [c._replace(ordinal=i) for i, c in enumerate(varying, 1)]
        self.n_rows = self.profile[0].n_rows
        self.rows = encode_short_columns(
            self.source.select([cells.quoted(c.name) for c in varying]),
            {c.name: c.n for c in varying}, SHORT_COLUMN,
        )
        keep = self.n_rows * len(varying) <= PERSIST_CELLS
        if keep:
            # A small table may come as one file; its tests are worth more tasks.
            self.rows = self.rows.repartition(
                self.spark.sparkContext.defaultParallelism
            ).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            self.rows = stage(self.rows, "encoded")
        counts.remember_sizes(self.rows, [(c.ordinal, c.n, c.n_rows, c.max_group) for c in self.profile])
        try:
            sampled = self.n_rows > self.settings.sample_rows * EVIDENCE_FROM
            self.prover = Prover(
                self.rows, self.n_rows, {c.ordinal for c in self.profile if not c.has_null},
                self.settings.check, self.settings.slice_rows, learning=sampled,
            )
            self.shared = SharedRows(self.prover, self.n_rows)
            self.prover.counted = {1 << (c.ordinal - 1): c.n for c in self.profile}
            self.failures = None
            if sampled:
                self.failures = failures_in_sample(
                    self.rows, self.profile, self.settings.sample_rows
                )
            self._compare_rows()
            singles = self._single_fds()
            groups, kept = self._reduce(singles)
            fds = self._sweep(singles, kept, self._part_masks(parts, varying))
        finally:
            if keep:
                self.rows.unpersist()

        mapping = counts.local_table(
            self.spark, [(i, slots[i]) for i in kept], "new_ord int, old_ord int"
        )
        members = counts.local_table(
            self.spark,
            [(slots[r], slots[m]) for r, ms in groups.items() for m in ms],
            "rep int, member int",
        )
        return stage_result(
            classes.recover(
                self._pairs(fds), mapping, members, constant_table, self.width,
                max((lhs.bit_count() for lhs, _ in fds), default=0), constants,
            ),
            "fds",
        )

    def _profile_columns(self) -> None:
        self.all_profile: list[ColumnProfile] = []
        for start in range(0, self.width, counts.BATCH):
            names = self.source.columns[start : start + counts.BATCH]
            part = self.source.select([cells.quoted(n) for n in names])
            for r in counts.column_profile(part).collect():
                self.all_profile.append(
                    ColumnProfile(r.ordinal + start, r.name, r.n, r.n_rows, r.max_group, r.has_null)
                )
        self.all_profile.sort()

    def _compare_rows(self) -> None:
        """On a large table of few columns, compare the rows of each value of the columns whose values
        are held by few rows each. That tells every failure of every left side around such a column
        from one exchange per column, however many candidates there are."""
        self.compared = 0
        kinds = self.rows.schema
        if (
            self.settings.check != "group" or self.prover.slices == 1 or len(self.profile) > COMPARED_COLUMNS
            or not all(counts.is_numbered(kinds[c.ordinal - 1].dataType, c.n) for c in self.profile)
        ):
            return
        few = [c.ordinal for c in self.profile if c.n < c.n_rows and c.max_group <= COMPARED_ROWS]
        if not few:
            return
        agree = stage(counts.union_all([counts.agreements(self.rows, i, self.n_rows) for i in few]).distinct(), "agreements")
        columns = ", ".join(str(c.ordinal) for c in self.profile)
        seen = agree.selectExpr("agree AS lhs", f"explode(array({columns})) AS rhs").filter("lhs & shiftleft(1L, rhs - 1) = 0L")
        if self.failures is not None:
            seen = seen.unionByName(self.failures).distinct()
        self.failures = stage(lattice.maximal_only(stage(seen, "seen")), "failures")
        self.compared = masks.mask_of(few)

    def _single_fds(self) -> set[tuple[int, int]]:
        """One-column FDs as pairs of column numbers."""
        by_ordinal = {c.ordinal: c for c in self.profile}
        # A column without repeated values determines every other.
        keys = {c.ordinal for c in self.profile if c.n == c.n_rows}
        pairs = [
            (1 << (x - 1), a)
            for x in by_ordinal for a in by_ordinal
            if x != a and x not in keys and by_ordinal[x].n >= by_ordinal[a].n
        ]
        left = self._not_refuted(self._pairs(pairs))
        self.prover.learn((1 << (k - 1), a) for k in keys for a in by_ordinal if a != k)
        found = {
            (masks.ordinals_of(lhs)[0], a) for lhs, a in self._test_candidates(left)
        }
        return found | {(k, a) for k in keys for a in by_ordinal if a != k}

    def _reduce(self, singles: set[tuple[int, int]]) -> tuple[dict[int, set[int]], list[int]]:
        """Classes by representative, and the columns kept."""
        pairs = counts.local_table(self.spark, sorted(singles), "lhs int, rhs int")
        groups: dict[int, set[int]] = {}
        for r in classes.equivalence_classes(pairs).collect():
            groups.setdefault(r.rep, set()).add(r.member)
        dropped = {m for rep, ms in groups.items() for m in ms if m != rep}
        return groups, [c.ordinal for c in self.profile if c.ordinal not in dropped]

    def _part_masks(self, parts, varying) -> list[int]:
        if parts is None:
            return []
        position = {c.name: i for i, c in enumerate(varying, 1)}
        return [masks.mask_of(position[n] for n in part if n in position) for part in parts]

    def _sweep(
        self, singles: set[tuple[int, int]], kept: list[int], parts: list[int]
    ) -> list[tuple[int, int]]:
        """Minimal FDs among the kept columns, as pairs of a mask and a number."""
        inside = set(kept)
        fds = sorted((1 << (x - 1), a) for x, a in singles if x in inside and a in inside)
        whole = masks.mask_of(kept)
        if parts:
            with ThreadPoolExecutor(min(len(parts), PARTS_AT_ONCE)) as pool:
                turns = [
                    pool.submit(copy_context().run, self._search_part, i, fds, part & whole)
                    for i, part in enumerate(parts)
                ]
                fds = sorted({fd for turn in turns for fd in turn.result()})
        return self._levels(fds, whole, [p & whole for p in parts])

    def _search_part(self, number: int, fds: list[tuple[int, int]], area: int) -> list[tuple[int, int]]:
        """The search within some columns, by a copy with a prover, counts and staged tables of
        its own; only the rows and the evidence so far are shared, and read."""
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"part-{number}")
        own = copy(self)
        own.prover = Prover(
            self.rows, self.n_rows, self.prover.not_null, self.settings.check,
            self.settings.slice_rows, learning=self.prover.learning,
        )
        own.prover.counted = {1 << (c.ordinal - 1): c.n for c in self.profile}
        own.shared = SharedRows(own.prover, self.n_rows)
        with scratch(self.spark):
            return own._levels(fds, area, [])

    def _levels(
        self, fds: list[tuple[int, int]], area: int, done: list[int]
    ) -> list[tuple[int, int]]:
        """Add the minimal FDs within ``area`` of left sides of two columns and more.
        Candidates inside one of the areas ``done`` are FDs already found or fail."""
        columns = masks.ordinals_of(area)
        limit = len(columns) - 1
        if self.settings.max_lhs is not None:
            limit = min(limit, self.settings.max_lhs)
        if limit < 2:
            return fds
        self.prover.learn(fds)
        targets = self._reachable(fds, area)
        known = set(fds)
        failed = self._pairs(
            (1 << (x - 1), a) for x in columns for a in targets
            if x != a and (1 << (x - 1), a) not in known
        )
        for level in range(2, limit + 1):
            table = self._pairs(fds)
            cands = lattice.prune_implied(lattice.next_level(failed, columns), table)
            cands = stage(lattice.prune_redundant(cands, table), f"level{level}")
            open_cands = cands.filter(self._possible())
            for part in done:
                open_cands = open_cands.filter(
                    f"(lhs | shiftleft(1L, rhs - 1)) & {part}L <> (lhs | shiftleft(1L, rhs - 1))"
                )
            found = self._test_candidates(self._not_refuted(open_cands))
            fds = fds + found
            self.prover.learn(fds)
            if self.shared.prover:
                self.shared.prover.recount()
            failed = cands
            if found:
                failed = cands.join(self._pairs(found), ["lhs", "rhs"], "left_anti")
            if level < limit and failed.isEmpty():
                break
        return fds

    def _not_refuted(self, cands: DataFrame) -> DataFrame:
        if self.failures is None:
            return cands
        return lattice.prune_refuted(cands, self.failures)

    def _reachable(self, fds: list[tuple[int, int]], area: int) -> list[int]:
        """Right sides that some left side in ``area`` may determine. One that its
        widest left side does not determine, no other does either."""
        columns = masks.ordinals_of(area)
        settled = {a for lhs, a in fds if lhs & area == lhs and area >> (a - 1) & 1}
        unknown = [a for a in columns if a not in settled]
        if unknown:
            top = self._pairs((area ^ 1 << (a - 1), a) for a in unknown)
            settled.update(a for _, a in self._test_candidates(self._not_refuted(top)))
        return sorted(settled)
