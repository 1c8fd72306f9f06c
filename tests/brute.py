"""Minimal FDs by trying every left side on plain Python rows."""

from __future__ import annotations

from itertools import combinations


def holds(rows, lhs, rhs) -> bool:
    seen = {}
    return all(
        seen.setdefault(tuple(r[i - 1] for i in lhs), r[rhs - 1]) == r[rhs - 1] for r in rows
    )


def minimal_fds(rows, width, max_lhs=None):
    found = set()
    top = width - 1 if max_lhs is None else min(max_lhs, width - 1)
    for rhs in range(1, width + 1):
        others = [i for i in range(1, width + 1) if i != rhs]
        mine = []
        for size in range(top + 1):
            for lhs in combinations(others, size):
                if not any(set(m) <= set(lhs) for m in mine) and holds(rows, lhs, rhs):
                    mine.append(lhs)
        found |= {(lhs, rhs) for lhs in mine}
    return found


def as_set(fds):
    rows = [(tuple(r.lhs), r.rhs) for r in fds.collect()]
    assert len(rows) == len(set(rows)), "an FD came twice"
    return set(rows)
