"""Prefix trie of sequences by van Emde Boas recursion.

Depths are cut at half, each half again, until blocks have one depth. Going down, all cuts of one size
are made at once: a block's sequences get the name of their prefix at the cut from the name of the
block's root and the digest of the half block between them, so every prefix has its name after as
many rounds as the depth has binary digits. The upper half and the forest below each cut prefix are
then blocks of their own. Going up, totals are grafted in the same order: blocks of one size pair up,
and what is summed in a lower block's root goes to each node above it in the upper block.

Names are SHA-256 digests, which any lost task makes anew. All joins are on a sequence and a depth, so
a prefix that a third of all sequences share is no hot key but in groupings, which combine first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from determina.llm.shared import staged

ROOT = hashlib.sha256(b"root").hexdigest()


def _named(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


# ---- names of prefixes ------------------------------------------------------------------------


def half_blocks(items: DataFrame, levels: int) -> list[DataFrame]:
    """By level j: (seq, i, name) of the 2**j tokens from number i * 2**j on, where a sequence has all."""
    out = [staged(items.select("seq", (F.col("d") - 1).alias("i"), F.col("token").alias("name")), "half0")]
    for j in range(1, levels):
        side = lambda bit: F.max(F.when(F.col("i") % 2 == bit, F.col("name")))
        both = out[-1].groupBy("seq", F.shiftright("i", 1).alias("i")).agg(side(0).alias("l"), side(1).alias("r"))
        out.append(staged(both.where("l is not null and r is not null").select("seq", "i", _named("l", "r").alias("name")), f"half{j}"))
    return out


def prefix_names(items: DataFrame, sequences: DataFrame, levels: int) -> DataFrame:
    """(seq, d, name) of every prefix of every sequence, the empty one at depth 0 included."""
    names = sequences.select("seq", F.lit(0).cast("long").alias("d"), F.unhex(F.lit(ROOT)).alias("name"))
    for j, half in reversed(list(enumerate(half_blocks(items, levels)))):
        upper = half.where("i % 2 = 0").select("seq", F.shiftleft("i", j).alias("d"), F.col("name").alias("half"))
        cut = names.join(upper, ["seq", "d"]).select("seq", (F.col("d") + (1 << j)).alias("d"), _named("name", "half").alias("name"))
        names = staged(names.unionByName(cut), f"names{j}")
    return names


# ---- digests of members -----------------------------------------------------------------------


def _joined_batches(batches):
    """Task code: rows (d, rep, seq) in order to one row (d, rep, seq, part) for each node and batch."""
    for batch in batches:
        d, rep, seq = (batch.column(c).to_numpy() for c in ("d", "rep", "seq"))
        if not len(d):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (rep[1:] != rep[:-1]), [True]]))
        parts = [",".join(map(str, seq[a:b].tolist())) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        at = cut[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(rep[at]), pa.array(seq[at]), pa.array(parts)], ["d", "rep", "seq", "part"])


def _digest_batches(batches):
    """Task code: parts in order to (d, rep, ends_sha256); one digest is open at a time."""
    at, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for d, rep, part in zip(*(batch.column(c).to_pylist() for c in ("d", "rep", "part")), strict=True):
            if (d, rep) == at:
                digest.update(b",")
            else:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (d, rep), hashlib.sha256()
            digest.update(part.encode())
        yield _digests(done)
    if at is not None:
        yield _digests([(*at, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["d", "rep", "ends_sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """(d, rep, ends_sha256) from (d, rep, seq): SHA-256 of the decimal seqs, ascending, comma-joined.

    Rows are sorted by ranges, so the members of one node lie in many tasks, which join them to long
    strings; a digest is made of these strings in turn and holds none of them.
    """
    order = ["d", "rep", "seq"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_batches, "d long, rep long, seq long, part string")
    return parts.repartition("d", "rep").sortWithinPartitions(*order).mapInArrow(_digest_batches, "d long, rep long, ends_sha256 string")


# ---- the trie ---------------------------------------------------------------------------------


def prefix_trie(items: DataFrame, sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of all sequences.

    ``items`` are (seq long, d long, token binary, bytes long): the tokens of each sequence, numbered
    from 1 without gaps; equal tokens have equal bytes. ``sequences`` (seq long) are all sequences,
    each once, those without tokens too.

    Returns (seq, depth, parent_seq, n_seqs, n_children, n_leaves, saved, ends_sha256): a node is the
    distinct sequence of the first ``depth`` tokens, called by its smallest member ``seq``;
    ``n_leaves`` are the nodes without children of its subtree, itself included, ``saved`` the sum
    over its subtree of (n_seqs - 1) * bytes of the last token, ``ends_sha256`` the digest of the
    members that end here. The root has no parent. No sequences: no nodes, not even the root.
    """
    items = staged(items.select("seq", "d", "token", F.col("bytes").cast("long").alias("bytes")), "items")
    sequences = staged(sequences.select("seq"), "sequences")
    lengths = items.groupBy("seq").agg(F.max("d").alias("d"))
    deepest = items.agg(F.max("d")).first()[0] or 0
    levels = int(deepest).bit_length()
    names = prefix_names(items, sequences, levels)
    nodes = staged(names.groupBy("d", "name").agg(F.min("seq").alias("rep"), F.count(F.lit(1)).alias("n_seqs")), "nodes")

    # From here on a node is (d, rep). All sequences share the root.
    below = names.where("d > 0").join(nodes.select("d", "name", "rep"), ["d", "name"]).select("seq", "d", "rep")
    smallest = sequences.agg(F.min("seq")).first()[0]
    top = sequences.select("seq", F.lit(0).cast("long").alias("d"), F.lit(smallest).cast("long").alias("rep"))
    path = staged(below.unionByName(top), "paths")
    above = path.select(F.col("seq").alias("rep"), (F.col("d") + 1).alias("d"), F.col("rep").alias("parent"))
    size = items.select(F.col("seq").alias("rep"), "d", "bytes")
    nodes = staged(nodes.select("d", "rep", "n_seqs").join(above, ["rep", "d"], "left").join(size, ["rep", "d"], "left"), "linked")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("rep")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, ["d", "rep"], "left").fillna(0, ["n_children", "bytes"]), "nodes")

    totals = nodes.select("d", "rep", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                          ((F.col("n_seqs") - 1) * F.col("bytes")).alias("saved"))
    for j in range(levels):
        totals = _grafted(totals, path, j)

    ended = sequences.join(lengths, "seq", "left").fillna(0, ["d"]).join(path, ["seq", "d"])
    return (
        nodes.join(totals, ["d", "rep"]).join(member_digests(ended.select("d", "rep", "seq")), ["d", "rep"], "left")
        .select(F.col("rep").alias("seq"), F.col("d").alias("depth"), F.col("parent").alias("parent_seq"), "n_seqs", "n_children", "n_leaves", "saved",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )


def _grafted(totals: DataFrame, path: DataFrame, j: int) -> DataFrame:
    """Totals of blocks of 2**(j+1) depths from those of blocks of 2**j: every root of a lower block
    adds its totals to the nodes above it in the upper block, found on the path of its member."""
    lower = totals.where((F.shiftright("d", j) % 2 == 1) & (F.shiftleft(F.shiftright("d", j), j) == F.col("d")))
    roots = lower.select(F.col("rep").alias("seq"), F.col("d").alias("cut"), "n_leaves", "saved")
    upper = path.where(F.shiftright("d", j) % 2 == 0).withColumn("cut", F.shiftleft(F.shiftright("d", j) + 1, j))
    moved = upper.join(roots, ["seq", "cut"]).select("d", "rep", "n_leaves", "saved")
    return staged(totals.unionByName(moved).groupBy("d", "rep").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), f"totals{j}")


# ---- conversations ----------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Staged (conv, pos, token, bytes): turns numbered from 1 by ``turn``, null first.

    Rows of one turn number are ordered by a digest of role and text. Null roles and texts are empty;
    rows without a conversation are left out. Rows are sorted by ranges, so a conversation of very
    many turns lies in many tasks; places count on from one task's last row to the next.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    token = F.unhex(F.sha2(F.concat(F.octet_length(part(role)).cast("string"), F.lit(":"), part(role), part(text)), 256))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), token.alias("token"), F.octet_length(part(text)).cast("long").alias("bytes")).where("conv is not null")
    order = ["conv", F.asc_nulls_first("turn"), "token"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "token", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = staged(placed, "turns")
    parts = placed.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # The window has one row for each task that has rows of a conversation.
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.select("conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("m"))
    return staged(placed.join(counted, ["conv", "part"]).select("conv", (F.col("place") - F.col("first") + F.col("m") + 1).alias("pos"), "token", "bytes"), "numbered")


def shared_starts(turns: DataFrame, base: Column, keep: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(items, sequences) of conversations that begin like another one.

    Every conversation ``conv`` of ``turns`` gets the first ``keep`` turns of conversation ``base``
    (both expressions of ``conv``, ``keep`` at most ``most``), then its own after its first ``keep``.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("base", base).withColumn("keep", keep)
    starts = sizes.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    starts = staged(starts.select("conv", "base", "keep", F.least("keep", F.coalesce("base_n", F.lit(0))).alias("given")), "starts")
    head = turns.where(F.col("pos") <= most).withColumnRenamed("conv", "base").join(starts, "base").where("pos <= given")
    own = turns.join(starts, "conv").where("pos > keep").withColumn("pos", F.col("given") + F.col("pos") - F.col("keep"))
    item = [F.col("conv").alias("seq"), F.col("pos").cast("long").alias("d"), "token", "bytes"]
    return head.select(*item).unionByName(own.select(*item)), starts.select(F.col("conv").alias("seq"))
