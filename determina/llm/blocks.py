"""Texts as blocks of word numbers.

A block holds about eight megabytes of whole texts: its distinct words once, and for every text the
numbers of its words. What has to be known about words is joined to the distinct words of blocks, a
small part of all words, and comes back to the block by its key. No word is a hot key, since each
block has it once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from determina.llm.shared import Hasher, chunks, list_array, staged

BLOCK = 8 << 20
#: Ranges of hashes whose words are counted in a block that spells its words.
RANGES = 1 << 16
#: Words compared byte by byte at a time.
STRIDE = 1 << 17
#: bytes and offsets of some texts -> bytes, starts, ends, number of the first word of each text
Splitter = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed: the lowest bytes of all, then the next ones."""
    planes = values.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _block_batches(split: Splitter, strings: bool):
    """Task code: (id, text, train) to blocks."""

    def run(batches):
        hasher, number = Hasher(), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, hashes, words, firsts, size = [], [], {}, [0], 0
            for lo, hi, raw, offsets in chunks(batch.column("text")):
                data, starts, ends, first = split(raw, offsets)
                own = hasher.load(data).spans(starts, ends)
                if strings:
                    own = _told_apart(own, data, starts, ends, words)
                hashes.append(own)
                firsts += (first[1:] + firsts[-1]).tolist()
                rows.append((lo, hi))
                size += len(raw)
                if size >= BLOCK or hi == len(batch):
                    yield _block(number, batch.slice(rows[0][0], hi - rows[0][0]), hashes, words, np.array(firsts), strings)
                    number += 1
                    rows, hashes, words, firsts, size = [], [], {}, [0], 0

    return run


def _told_apart(own: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: dict[int, bytes]) -> np.ndarray:
    """Keys of words, their hashes; a word whose hash another word of the block has takes the next free
    number. ``words`` has the spelling of every key and takes up the new ones."""
    distinct, at, codes = np.unique(own, return_index=True, return_inverse=True)
    size = ends - starts
    twin = size != size[at][codes]
    for same in np.array_split(np.flatnonzero(~twin), len(own) // STRIDE + 1):
        n = size[same]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unlike = data[np.repeat(starts[same], n) + within] != data[np.repeat(starts[at][codes[same]], n) + within]
        twin[np.repeat(same, n)[unlike]] = True
    for k, text in zip(distinct.tolist(), (data[starts[i] : ends[i]].tobytes() for i in at), strict=True):
        if words.setdefault(k, text) != text:
            twin[own == np.uint64(k)] = True
    if not twin.any():
        return own
    out = own.copy()
    for i in np.flatnonzero(twin):
        key, text = int(own[i]), data[starts[i] : ends[i]].tobytes()
        while words.setdefault(key, text) != text:
            key = (key + 1) % (1 << 64)
        out[i] = key
    return out


def _block(number: int, batch: pa.RecordBatch, hashes: list, words: dict[int, bytes], firsts: np.ndarray, strings: bool) -> pa.RecordBatch:
    every = np.concatenate(hashes)
    distinct, codes = np.unique(every, return_inverse=True)
    train = np.repeat(np.array(batch.column("train").to_pylist(), bool), np.diff(firsts))
    counts = np.bincount(codes, train, len(distinct)).astype(np.int64)
    spelled = [words[k] for k in distinct.tolist()] if strings else []
    ranges = pack(np.bincount((distinct >> np.uint64(48)).astype(np.int64), minlength=RANGES)) if strings else None
    one = np.array([0, len(batch)])
    vocabulary = np.array([0, len(distinct)])
    ids = batch.column("id")
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.ListArray.from_arrays(pa.array(one.astype(np.int32)), ids), list_array(np.array(batch.column("train").to_pylist(), bool), one, pa.bool_()),
         list_array(np.diff(firsts).astype(np.int32), one, pa.int32()), pa.array([pack(codes)], pa.binary()),
         list_array(distinct.view(np.int64)[: 0 if strings else None], vocabulary * (not strings), pa.int64()), list_array(counts, vocabulary, pa.int64()),
         pa.array([spelled], pa.list_(pa.binary())), pa.array([ranges], pa.binary())],
        ["block", "ids", "train", "sizes", "codes", "words", "counts", "spelled", "ranges"])


def blocks_of(docs: DataFrame, id_col: str, text: str, train, split: Splitter, strings: bool = False) -> DataFrame:
    """Staged blocks: (block, ids, train, sizes, codes, words, counts, spelled, ranges).

    ``words`` are 64-bit digests, ``counts`` how often each occurs in rows where ``train`` holds. With
    ``strings`` the words stand in ``spelled`` instead, as bytes in the order of their digests, ``words``
    is empty, and ``ranges`` tells how many words have their digest in each of ``RANGES`` equal ranges.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    schema = StructType([
        StructField("block", StructType.fromDDL("x long")["x"].dataType), StructField("ids", ArrayType(rows.schema["id"].dataType)),
        *StructType.fromDDL("train array<boolean>, sizes array<int>, codes binary, words array<long>, counts array<long>, spelled array<binary>, ranges binary").fields])
    return staged(rows.mapInArrow(_block_batches(split, strings), schema), "blocks")
