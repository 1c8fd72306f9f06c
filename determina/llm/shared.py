"""Tokens and hashes of whole texts as numpy arrays, staged tables, connected components.

Task code reads texts straight from Arrow buffers in chunks of about a megabyte (a longer text is
a chunk of its own), so a task's memory is bounded by the longest text and not by the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words made of digits, letters and everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it may be unset, one beside the
    warehouse. On a cluster an unset one is an error: the driver's folder is no shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: no lineage is left, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# ---- texts in Arrow buffers ------------------------------------------------------------------


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, offsets = text_arrays(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokens(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[filled] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---- hashes -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any spans of a byte array from one running sum of powers, modulo 2**64."""

    def __init__(self) -> None:
        self.size = 0

    def _grow(self, n: int) -> None:
        if n >= self.size:
            self.size = max(n + 1, CHUNK + 4096)
            for name, base in (("power", BASE), ("inverse", np.uint64(pow(int(BASE), -1, 1 << 64)))):
                steps = np.full(self.size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def load(self, data: np.ndarray) -> Hasher:
        n = len(data)
        self._grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])
        return self

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal byte strings, at any place."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` bytes."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


# ---- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round every node points at its smallest neighbour, chains of pointers are halved until they
    end, and edges move to the ends. Groupings combine before the shuffle and joins have one side
    with unique keys, so a node with very many edges can be split. Rounds grow with the logarithm of
    the longest chain. Edges with a null end are ignored; no edges give an empty table.
    """
    edges = staged(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a != b").distinct(), "edges",
    )
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
                       .withColumn("root", F.least("node", "root")), "pointers")
        while True:
            ends = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = staged(point.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
            point = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = point
        else:
            ends = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = staged(total.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        left = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = staged(
            edges.join(left, "a").join(right, "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges",
        )
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total.select("node", F.col("root").alias("component"))
