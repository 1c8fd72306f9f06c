"""Attribute sets as BIGINT bit masks.

Column number ``i`` (1-based) is bit ``1 << (i - 1)``, so union, intersection,
membership and containment are single bitwise instructions inside codegen and a
set is an 8-byte join or grouping key. 63 columns fit in a signed long.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COLUMNS = 63


def mask_of(ordinals: Iterable[int]) -> int:
    """The mask of some column numbers, as a plain integer for use in a plan."""
    mask = 0
    for i in ordinals:
        if not 1 <= i <= MAX_COLUMNS:
            raise ValueError(f"column number {i} does not fit a mask of {MAX_COLUMNS} columns")
        mask |= 1 << (i - 1)
    return mask


def ordinals_of(mask: int) -> list[int]:
    """The column numbers in a mask, ascending."""
    return [i + 1 for i in range(mask.bit_length()) if mask >> i & 1]


def bit(ordinal: Column) -> Column:
    """One-member set of a column number."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (ordinal - 1).cast("int"))


def union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def intersection(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def difference(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def has(mask: Column, ordinal: Column) -> Column:
    return mask.bitwiseAND(bit(ordinal)) != 0


def covers(big: Column, small: Column) -> Column:
    """Every member of ``small`` is in ``big``."""
    return big.bitwiseAND(small) == small


def size(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def members(mask: Column) -> Column:
    """The column numbers of a mask as an ascending array."""
    return F.filter(
        F.sequence(F.lit(1), F.lit(MAX_COLUMNS)), lambda i: has(mask, i)
    )


def label(ordinal: Column) -> Column:
    return F.concat(F.lit("column"), ordinal.cast("string"))


def labels(ordinals: Column) -> Column:
    """``array(4, 1)`` as ``column1,column4``; an empty array as an empty string."""
    return F.concat_ws(",", F.transform(F.array_sort(ordinals), label))
