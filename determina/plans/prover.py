"""Exact answers for batches of tests on all rows of a table."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.functions import cells, masks
from determina.operators import checks, counts
from determina.sources.staging import stage

# Rows times tests of one scan of a small table.
COPIES = 4_000_000

# Tests of one scan of a large table.
WIDE_BATCH = 64

# A slice of a large table has at least the first number of rows, at most the second,
# and in between so many that a batch of slices stays smaller than the table.
SLICE_ROWS = 50_000
SLICE_ROWS_MAX = 10_000_000


class Closures:
    """What follows from the FDs known so far. Sets with the same closure have the
    same number of different tuples."""

    def __init__(self) -> None:
        self.left = np.zeros(0, dtype=np.int64)
        self.right = np.zeros(0, dtype=np.int64)

    def learn(self, fds: Iterable[tuple[int, int]]) -> None:
        """FDs as pairs of a left mask and a column number."""
        fds = list(fds)
        self.left = np.array([lhs for lhs, _ in fds], dtype=np.int64)
        self.right = np.array([1 << (a - 1) for _, a in fds], dtype=np.int64)

    def of(self, mask: int) -> int:
        while True:
            hit = (self.left & ~np.int64(mask)) == 0
            grown = mask | int(np.bitwise_or.reduce(self.right[hit], initial=0))
            if grown == mask:
                return mask
            mask = grown

    def narrowed(self, mask: int, drop_first: Iterable[int]) -> int:
        """A subset of columns with the same closure, to count instead."""
        whole = self.of(mask)
        for i in drop_first:
            less = mask & ~(1 << (i - 1))
            if less != mask and self.of(less) == whole:
                mask = less
        return mask


class Prover:
    """Tests on one table. The driver gets one row per test or set that it named."""

    def __init__(
        self, rows: DataFrame, n_rows: int, not_null: Iterable[int],
        check: str = "group", slice_rows: int = SLICE_ROWS, learning: bool = False,
    ):
        self.rows = rows
        self.not_null = set(not_null)
        self.check = check
        self.closures = Closures()
        self.counted: dict[int, int] = {}
        self.learning = learning
        self.lessons: list[DataFrame] = []
        self.watched = masks.mask_of(
            i for i, f in enumerate(rows.schema, 1) if checks.is_fixed_width(f.dataType)
        )
        per_slice = max(slice_rows, min(n_rows // 256, SLICE_ROWS_MAX))
        self.slices = 1 if n_rows < 2 * per_slice else n_rows // per_slice
        self.batch = WIDE_BATCH
        if self.slices == 1:
            self.batch = max(16, min(512, COPIES // max(n_rows, 1)))
        kinds = rows.schema
        by_width = sorted(
            range(1, len(kinds) + 1),
            key=lambda i: (checks.is_fixed_width(kinds[i - 1].dataType), -i),
        )
        self.wide_first = by_width

    def learn(self, fds: Iterable[tuple[int, int]]) -> None:
        self.closures.learn(fds)
        self.recount()

    def recount(self) -> None:
        """File the counts under what their sets now determine."""
        self.counted = {self.closures.of(m): n for m, n in self.counted.items()}

    def decide(self, tests: list[checks.Test]) -> list[tuple[int, int]]:
        """``(lhs, proved right sides)`` of some tests. They are refuted a scan's portion at a time; what
        is left is counted together, since each portion of counts exchanges the rows."""
        left: list[tuple[int, int]] = []
        proved: dict[int, int] = {}
        for portion in counts.batches(tests, self.batch):
            if self.check == "group":
                left += self._group_test(portion, proved)
            else:
                left += [(t.lhs, t.rhs) for t in portion]
        self._count_test(left, proved)
        return sorted((lhs, rhs) for lhs, rhs in proved.items() if rhs)

    def _group_test(self, tests, proved: dict[int, int]) -> list[tuple[int, int]]:
        """Refute in one scan; returns what is still open."""
        asked = {t.lhs: t.rhs for t in tests}
        shapes = checks.group_shapes(
            self.rows, tests, self.not_null, self.slices, self.watched if self.learning else 0
        )
        if self.learning:
            shapes = stage(shapes, "shapes")
            self.lessons.append(shapes)
        for r in checks.summed_shapes(shapes).collect():
            asked[r.lhs] &= ~r.refuted
            if self.slices == 1:
                self.counted[self.closures.of(r.lhs)] = r.n_lhs
                open_rhs = checks.needs_confirmation(self.rows, asked[r.lhs])
                proved[r.lhs] = asked[r.lhs] & ~open_rhs
                asked[r.lhs] = open_rhs
        return [(lhs, rhs) for lhs, rhs in asked.items() if rhs]

    def new_failures(self) -> DataFrame | None:
        """``lhs, rhs`` seen in the groups since the last call."""
        if not self.lessons:
            return None
        seen, self.lessons = counts.union_all(self.lessons), []
        return checks.seen_failures(seen)

    def _count_test(self, left: list[tuple[int, int]], proved: dict[int, int]) -> None:
        """X determines all of several columns exactly when X with all of them has no
        more different tuples than X, so one count settles them together. Where it
        fails on a small table, the groups of X tell the right sides apart. Those they cannot
        tell, for being texts, and all of a large table are counted one by one: counts share
        the exchanges that groups would make for each left side."""
        self._count(m for lhs, rhs in left for m in (lhs, lhs | rhs))
        mixed = []
        for lhs, rhs in left:
            if self._n(lhs) == self._n(lhs | rhs):
                proved[lhs] = proved.get(lhs, 0) | rhs
            elif rhs.bit_count() > 1:
                mixed.append(checks.Test(lhs, rhs))
        asked = {t.lhs: t.rhs for t in mixed}
        if self.check == "group" and self.slices == 1:
            for part in counts.batches(mixed):
                plan = [checks.one_left_side(self.rows, t, self.not_null) for t in part]
                for r in counts.union_all(plan).collect():
                    open_rhs = checks.needs_confirmation(self.rows, asked[r.lhs])
                    proved[r.lhs] = proved.get(r.lhs, 0) | asked[r.lhs] & ~r.refuted & ~open_rhs
                    asked[r.lhs] &= open_rhs & ~r.refuted
        apart = [(lhs, 1 << (a - 1)) for lhs, rhs in asked.items() for a in masks.ordinals_of(rhs)]
        self._count(lhs | a for lhs, a in apart)
        for lhs, a in apart:
            if self._n(lhs) == self._n(lhs | a):
                proved[lhs] = proved.get(lhs, 0) | a

    def _n(self, mask: int) -> int:
        return self.counted[self.closures.of(mask)]

    def _count(self, wanted: Iterable[int]) -> None:
        missing = {}
        for mask in wanted:
            closed = self.closures.of(mask)
            if closed not in self.counted and closed not in missing:
                missing[closed] = self.closures.narrowed(mask, self.wide_first)
        closed_of = {narrow: closed for closed, narrow in missing.items()}
        # A small table is counted in as few scans as the tests are made in.
        small = self.slices == 1
        count = counts.set_counts_in_one_scan if small else counts.set_counts
        self.counted.update(dict.fromkeys(closed_of.values(), 0))
        for part in counts.batches(sorted(closed_of), self.batch if small else max(1, len(closed_of))):
            for r in count(self.rows, part).collect():
                self.counted[closed_of[r.mask]] = r.n


# A set of columns is nearly a key when at most this part of the rows can share its
# values with another row.
SHARED_PART = 0.25

# Nearly-key sets looked for and used at a time.
SETS_SIZED = 64
SETS_USED = 16


def rows_with_company(rows: DataFrame, mask: int) -> DataFrame:
    """Rows that some other row equals on a set of columns.

    The repeated values are found by a grouping and looked up by a semi join, so a
    value held by very many rows never comes together in one task.
    """
    names = cells.names_at(rows, masks.ordinals_of(mask))
    quoted = [cells.sql_name(n) for n in names]
    repeated = (
        rows.groupBy(*quoted).agg(F.expr("count(1) AS _rows")).filter("_rows > 1")
        .selectExpr(*[f"{q} AS _k{i}" for i, q in enumerate(quoted)])
    )
    same = F.expr(" AND ".join(f"{q} <=> _k{i}" for i, q in enumerate(quoted)))
    return rows.join(repeated, same, "left_semi")


class SharedRows:
    """The rows that matter for left sides around nearly-key sets of columns.

    Only rows equal on X can refute ``X -> A``. If X covers a set P, such rows are
    equal on P too. For a set P that is nearly a key, the rows that share their values
    on P are few, and every test with a left side around P gives the same answer on
    them as on the whole table.
    """

    def __init__(self, whole: Prover, n_rows: int):
        self.whole = whole
        self.n_rows = n_rows
        self.sets: list[int] = []
        self.refused: set[int] = set()
        self.rows: DataFrame | None = None
        self.prover: Prover | None = None

    def covers(self, lhs: int) -> bool:
        return any(lhs & p == p for p in self.sets)

    def add_for(self, open_lhs: list[int], sizes: dict[int, int]) -> None:
        """Look for nearly-key sets inside some left sides, one column smaller.

        ``sizes`` are the numbers of values of the columns. The sets are sized by
        estimates from one scan without a shuffle, and used from the one most left
        sides cover. The choice affects only where tests are run.
        """
        wanted = Counter(
            lhs & ~(1 << (i - 1)) for lhs in open_lhs for i in masks.ordinals_of(lhs)
        )
        least = (1 - SHARED_PART / 2) * self.n_rows
        sets = [
            p for p, _ in sorted(wanted.items(), key=lambda item: (-item[1], item[0]))
            if p not in self.refused
            and math.prod(sizes[i] for i in masks.ordinals_of(p)) >= least
        ][:SETS_SIZED]
        if not sets:
            return
        rows = self.whole.rows
        estimates = rows.agg(*[
            F.expr(f"approx_count_distinct(xxhash64({self._names(p)})) AS n{p}") for p in sets
        ]).head()
        self.refused.update(sets)
        near = [p for p in sets if estimates[f"n{p}"] >= least * 0.95]
        # Of n rows with d different values at most 2 (n - d) share theirs.
        room = self.n_rows // 2
        chosen, left = [], set(open_lhs)
        while near and left and len(chosen) < SETS_USED:
            best = max(near, key=lambda p: sum(lhs & p == p for lhs in left))
            near.remove(best)
            covered = {lhs for lhs in left if lhs & best == best}
            if len(covered) < 2:
                break
            room -= max(0, 2 * (self.n_rows - estimates[f"n{best}"]))
            if room < 0:
                break
            chosen.append(best)
            left -= covered
        if not chosen:
            return
        parts = [rows_with_company(rows, p) for p in chosen]
        if self.rows is not None:
            parts.append(self.rows)
        shared = stage(counts.union_all(parts), "shared-rows")
        n_shared = shared.count()
        if n_shared > self.n_rows // 2:
            return
        self.sets += chosen
        self.rows = shared
        prover = Prover(
            shared, n_shared, self.whole.not_null, self.whole.check, learning=self.whole.learning
        )
        prover.lessons = self.prover.lessons if self.prover else []
        prover.closures = self.whole.closures
        self.prover = prover

    def _names(self, mask: int) -> str:
        return ", ".join(
            cells.sql_name(n) for n in cells.names_at(self.whole.rows, masks.ordinals_of(mask))
        )
