"""Periodic runs of words, by dyadic square catching.

For every power of two ``size`` a catcher stands on each block of ``size`` words that begins at a
multiple of half of it (every place, for one word). Once its block is complete it compares the block
with what is appended: word by word one shift further, for ``size`` words, until the block comes back.
The block and its return are a square of that shift. Squares are stretched to both sides as long as
words that far apart are equal; squares of one period that touch are one run.

A run of period p and at least four periods holds, in full and once more p words later, a block of
the smallest power of two that is at least p. A block as long as p comes back within its run exactly
every p words, so the first return tells the smallest period, and no run is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from determina.llm.shared import chunks, mix

#: A run has at least so many periods and so many words.
PERIODS, WORDS = 4, 6
#: Catchers and shifts compared at once.
CATCHERS, SHIFTS = 1 << 14, 64


class Numbers(dict):
    """Words by number, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def catch(names: np.ndarray, at: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that come back first at a shift of more than half of ``size``, ``size`` at most.

    ``names[i]`` stands for the ``size`` words from i, ``at`` are the blocks and ``ends`` the ends of
    their texts.
    """
    blocks, shifts = [], []
    for k in range(0, len(at), CATCHERS):
        open_at, room = at[k : k + CATCHERS], (ends - size - at)[k : k + CATCHERS]
        for first in range(1, size + 1, SHIFTS):
            shift = np.arange(first, min(first + SHIFTS, size + 1))
            fits = shift <= room[:, None]
            later = np.where(fits, open_at[:, None] + shift, open_at[:, None])
            same = fits & (names[later] == names[open_at][:, None])
            back = same.any(axis=1)
            found = shift[same.argmax(axis=1)]
            good = back & (found > size // 2)
            blocks.append(open_at[good])
            shifts.append(found[good])
            stay = ~back & (room > shift[-1])
            open_at, room = open_at[stay], room[stay]
            if not len(open_at):
                break
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *blocks]), np.concatenate([empty, *shifts])


def stretch(codes: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The widest stretch around ``at`` in which words ``period`` apart are equal."""
    end, step = at, 64
    while end + period < high:
        upto = min(end + step, high - period)
        other = codes[end:upto] != codes[end + period : upto + period]
        if other.any():
            end += int(other.argmax())
            break
        end, step = upto, 2 * step
    start, step = at, 64
    while start > low:
        since = max(start - step, low)
        other = (codes[since:start] != codes[since + period : start + period])[::-1]
        if other.any():
            start -= int(other.argmax())
            break
        start, step = since, 2 * step
    return start, end + period


def runs_of(codes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, in order; text i is ``codes[first[i]:first[i + 1]]``."""
    names, size = codes.astype(np.uint64), 1
    counts = np.diff(first)
    found = []
    while True:
        least = size // 2 + 1
        long = np.flatnonzero(counts >= max(WORDS, PERIODS * least))
        if not len(long):
            break
        step = max(1, size // 2)
        many = (counts[long] - size - least) // step + 1
        at = np.repeat(first[long], many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        blocks, shifts = catch(names, at, np.repeat(first[long + 1], many), size)
        order = np.lexsort((blocks, shifts))
        blocks, shifts = blocks[order], shifts[order]
        k = 0
        while k < len(blocks):
            block, period = int(blocks[k]), int(shifts[k])
            text = int(np.searchsorted(first, block, "right")) - 1
            start, end = stretch(codes, block, period, int(first[text]), int(first[text + 1]))
            if end - start >= max(WORDS, PERIODS * period):
                found.append((start, end, period))
            # Squares of this period within the run say nothing new.
            last = int(np.searchsorted(shifts, period, "right"))
            k = max(k + 1, k + int(np.searchsorted(blocks[k:last], end - period - size, "right")))
        names = mix(names[: max(0, len(names) - size)] * np.uint64(0x9E3779B97F4A7C15) + mix(names[size:])) if len(names) > size else names[:0]
        names = np.concatenate([names, np.zeros(len(codes) - len(names), np.uint64)])
        size *= 2
    return sorted(set(found))


def _run_batches(batches):
    """Task code: (row, text) to (row, n_words, runs, collapsed)."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            number, raw = Numbers(), data.tobytes()
            words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            codes = np.fromiter((number[w] for own in words for w in own), np.int64, int(first[-1]))
            drop = np.zeros(len(codes) + 1, np.int64)
            runs = runs_of(codes, first)
            for start, end, period in runs:
                drop[start + period] += 1
                drop[end] -= 1
            kept = np.cumsum(drop[:-1]) == 0
            text_of = np.searchsorted(first, [r[0] for r in runs], "right") - 1
            lists: list[list] = [[] for _ in words]
            for text, (start, end, period) in zip(text_of.tolist(), runs, strict=True):
                lists[text].append({"start": start - int(first[text]), "length": end - start, "period": period})
            left = [own if not found else [own[i] for i in np.flatnonzero(kept[a:b]).tolist()]
                    for own, found, a, b in zip(words, lists, first[:-1], first[1:], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(lists, kind),
                 pa.array([b" ".join(x).decode() for x in left], pa.string())],
                ["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, n_words, runs, collapsed) of every row.

    ``row`` holds all columns of ``docs``, whatever their names; ``runs`` are (start, length, period)
    of the maximal runs of at least four periods and six words, by start and then period, in numbers
    of words separated by ASCII white space. Words are compared exactly. ``collapsed`` are the words
    that no run holds after its first period, joined by one space. A null or empty text has no words,
    no runs and an empty ``collapsed``. Rows are independent: repeated rows and ids, null ids and an
    empty table need no care. No shuffle; a task holds the words of one megabyte of texts or of one
    longer text.
    """
    table = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    added = StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return table.mapInArrow(_run_batches, StructType([table.schema["row"], *added.fields]))


def run_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One line per run: (row, start, length, period)."""
    return periodic_runs(docs, text).select("row", F.explode("runs").alias("run")).select("row", "run.*")
