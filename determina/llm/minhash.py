"""Near-duplicates by b-bit MinHash.

128 minima of a text's shingles give 32 bands of four and a packed signature of their low four
bits. Texts that share a band are candidates; the share of equal nibbles, corrected for the 1/16
that agree by chance, drops pairs that cannot be similar; the full shingle sets confirm the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from determina.llm.shared import LOWER, SPACED, Hasher, chunks, components, list_array, mix, staged, tokens

MINIMA, BAND = 128, 4
#: Estimates below this are no candidates for 0.75: five standard errors of 128 nibbles.
ESTIMATE = 0.55
#: Members of a group that one task compares with its core, about.
DEALT = 256
SEED = 7


def shingle_sets(data, offsets, hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the offsets of the texts among them."""
    data = LOWER[data]
    starts, ends, first = tokens(data, offsets, SPACED)
    words = hasher.load(data).spans(starts, ends)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    value = np.zeros(len(owner), np.uint64)
    for step in range(size):
        there = at + step < first[1:][owner]
        word = words[np.minimum(at + step, max(len(words) - 1, 0))]
        value = np.where(there, mix(value + word), value)
    value ^= np.minimum(n, size)[owner].astype(np.uint64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def sketch_batches(size: int):
    """Task code: (id, text) to (id, n_shingles, k1, k2, bands, signature)."""

    def run(batches):
        hasher = Hasher()
        rng = np.random.default_rng(SEED)
        factor = (rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        shift = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                values, where = shingle_sets(data, offsets, hasher, size)
                n = np.diff(where)
                full = np.flatnonzero(n)
                short = (mix(values * np.uint64(3)) >> np.uint64(32)).astype(np.uint32)
                minima = np.zeros((hi - lo, MINIMA), np.uint32)
                if len(full):
                    for k in range(MINIMA):
                        minima[full, k] = np.minimum.reduceat(mixed32(short * factor[k] + shift[k]), where[full])
                keys = []
                for salt in (1, 2):
                    sums = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(mix(values + np.uint64(salt)), out=sums[1:])
                    keys.append((sums[where[1:]] - sums[where[:-1]]).view(np.int64))
                bands = np.zeros((hi - lo, MINIMA // BAND), np.uint64)
                for step in range(BAND):
                    bands = mix(bands + minima[:, step::BAND] + np.uint64(1))
                bands = mix(bands + np.arange(MINIMA // BAND, dtype=np.uint64)).view(np.int64)
                nibbles = (minima & np.uint32(15)).astype(np.uint64).reshape(hi - lo, MINIMA // 16, 16)
                packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
                width = lambda x: np.arange(hi - lo + 1) * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]),
                     list_array(bands.ravel(), width(bands), pa.int64()), list_array(packed.ravel(), width(packed), pa.int64())],
                    ["id", "n_shingles", "k1", "k2", "bands", "signature"],
                )

    return run


def mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x ^ (x >> np.uint32(13))


def set_batches(size: int):
    """Task code: (id, text) to (id, shingles)."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                values, where = shingle_sets(data, offsets, hasher, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), list_array(values.view(np.int64), where, pa.int64())], ["id", "shingles"])

    return run


def estimate(a: str, b: str):
    """Collision-corrected similarity of two packed signatures by bit counts."""
    differing = None
    for i in range(MINIMA // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differing = F.bit_count(x) if differing is None else differing + F.bit_count(x)
    return ((1 - differing / MINIMA) - 1 / 16) / (1 - 1 / 16)


def split_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs to test, (a, b) each, of members (g, id, component) of a group across components.

    A group's core are the shingles that more than half of its members have. A member is the core
    without what it lacks and with what it has beyond: together its edits. Two members of core parts
    i and j have ``core - i - j + common edits`` more in common than their sizes alone give, so a
    number of common edits, known from sizes and core parts, decides their link. Where it is 0, all
    members of two cells of equal numbers are linked, and stars to one member of each cell join them
    as all the pairs would. Where it is more, that many edits are common, so the two share one among
    the first of their edits, rarest first: all but as many as the number needs to be sure of one.
    """
    rows = groups.select("g", "id").join(sets, "id").select("g", "id", F.explode("shingles").alias("s"))
    total = groups.groupBy("g").agg(F.count("*").alias("n"))
    often = rows.groupBy("g", "s").agg(F.count("*").alias("c")).join(total, "g")
    kinds = staged(often.select("g", "s", "n", "c", (2 * F.col("c") > F.col("n")).alias("core")), "kinds")
    marked = staged(rows.join(kinds, ["g", "s"]).select("g", "id", "s", "c", "core"), "marked")
    core = kinds.where("core")
    cores = core.groupBy("g").agg(F.count("*").alias("k"))
    parts = marked.where("core").groupBy("g", "id").agg(F.count("*").alias("i"))
    sizes = sets.select("id", F.size("shingles").cast("long").alias("size"))
    members = groups.join(sizes, "id").join(parts, ["g", "id"], "left").join(cores, "g", "left").na.fill(0, ["i", "k"])
    members = staged(members.select("g", "id", "component", "i", "size", "k"), "members")

    def needed(k: str, i: str, size: str, j: str, other: str):
        """Common edits that make a link."""
        return F.col(k) - F.col(i) - F.col(j) + F.ceil(percent * (F.col(size) + F.col(other)) / (100 + percent))

    cells = staged(members.groupBy("g", "k", "i", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("first")), "cells")
    one = cells.select("g", "k", *(F.col(c).alias(f"{c}_a") for c in ("i", "size", "lo", "hi", "first")))
    other = cells.select("g", *(F.col(c).alias(f"{c}_b") for c in ("i", "size", "lo", "hi", "first")))
    mixes = F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")
    fewest = F.greatest(needed("k", "i_a", "size_a", "i_b", "size_b"), F.lit(0))
    edits = lambda x: F.col("k") + F.col(f"size_{x}") - 2 * F.col(f"i_{x}")
    may = staged(one.join(other, "g").where(mixes & (fewest <= F.least(edits("a"), edits("b"))))
                 .select("g", F.col("i_a").alias("i"), F.col("size_a").alias("size"), "first_a", "first_b", fewest.alias("fewest")), "cell-pairs")
    met = may.groupBy("g", "i", "size").agg(F.min(F.when(F.col("fewest") == 0, F.col("first_b"))).alias("sure"), F.min(F.when(F.col("fewest") > 0, F.col("fewest"))).alias("fewest"))
    met = staged(members.join(met, ["g", "i", "size"]), "met")
    stars = met.where("sure is not null").select(F.col("id").alias("x"), F.col("sure").alias("y")).unionByName(may.where("fewest = 0").select(F.col("first_a").alias("x"), F.col("first_b").alias("y")))

    open_members = met.where("fewest is not null").drop("sure")
    # The core comes in a copy for every so many members, so a large group is many tasks' work.
    deals = F.ceil(F.col("n") / DEALT).cast("int")
    copies = core.select("g", "s", (F.col("n") - F.col("c")).alias("often"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    dealt = open_members.join(total, "g").select("g", "id", F.pmod(F.xxhash64("id"), deals).cast("int").alias("deal"))
    beyond = marked.where("not core").select("g", "id", "s", F.col("c").alias("often"))
    lacking = dealt.join(copies, ["g", "deal"]).join(marked.where("core").select("g", "id", "s"), ["g", "id", "s"], "left_anti").select("g", "id", "s", "often")
    by_rarity = Window.partitionBy("g", "id").orderBy("often", "s")
    placed = beyond.unionByName(lacking).withColumn("at", F.row_number().over(by_rarity))
    first = placed.join(open_members, ["g", "id"]).where("often > 1 and at <= k + size - 2 * i - fewest + 1")
    first = staged(first.select("g", "s", "at", "id", "component", "i", "size", "k"), "edits")
    left = first.select("g", "s", "k", *(F.col(c).alias(f"{c}_a") for c in ("at", "id", "component", "i", "size")))
    right = first.select("g", "s", *(F.col(c).alias(f"{c}_b") for c in ("at", "id", "component", "i", "size")))
    least = needed("k", "i_a", "size_a", "i_b", "size_b")
    early = (F.col("at_a") <= edits("a") - least + 1) & (F.col("at_b") <= edits("b") - least + 1)
    tests = left.join(right, ["g", "s"]).where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & (least > 0) & early)
    ordered = lambda t, x, y: t.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    return ordered(stars, "x", "y"), ordered(tests, "id_a", "id_b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, leaders: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept): classes of documents with 100 * common >= percent * union.

    Texts with the same shingle set are one node, its smallest id. In every band bucket a leader is
    compared with the members that are not yet in its component: first the member that shares most
    bands with others, which is near the middle of its group, then one chosen by a hash each round.
    After ``leaders`` rounds the members of buckets that still mix components are grouped by leader;
    ``split_pairs`` gives links that counts prove and the pairs that share enough rare edits to be
    linked, so no link that could join two classes is left out and no bucket gives all pairs.

    Null or empty texts have no shingles and link with nothing. Rows that share an id are one
    document and come back once each; rows with a null id link with nothing, have a null component
    and are kept. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = staged(rows.mapInArrow(sketch_batches(size), "id long, n_shingles long, k1 long, k2 long, bands array<long>, signature array<long>"), "sketches")
    usable = sketches.where("id is not null and n_shingles > 0")
    sets = usable.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"))
    members = sketches.join(sets, ["k1", "k2", "n_shingles"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"))

    nodes = staged(usable.join(sets.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi")
                   .select("id", "bands", "signature"), "nodes")
    banded = nodes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    buckets = staged(banded.join(shared, "band"), "buckets")
    wanted = staged(buckets.groupBy("id").agg(F.count("*").alias("shared_bands")), "wanted")
    signatures = staged(nodes.join(wanted.select("id"), "id", "left_semi").select("id", "signature"), "signatures")
    full = staged(rows.join(wanted.select("id"), "id", "left_semi").mapInArrow(set_batches(size), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("id").alias(name), F.col(table.columns[1]).alias(f"{table.columns[1]}_{name}"))

    def links(pairs: DataFrame) -> DataFrame:
        near = (pairs.join(side(signatures, "a"), "a").join(side(signatures, "b"), "b")
                .where(estimate("signature_a", "signature_b") >= ESTIMATE).select("a", "b"))
        both = near.join(side(full, "a"), "a").join(side(full, "b"), "b")
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        joint = F.size("shingles_a") + F.size("shingles_b") - common
        return both.where(100 * common >= percent * joint).select("a", "b")

    found, tested, labels = None, None, None
    for turn in range(leaders + 1):
        sure = None
        held = buckets if labels is None else buckets.join(labels, "id", "left")
        held = held.withColumn("component", F.col("id") if labels is None else F.coalesce("component", "id"))
        order = F.xxhash64(F.col("id"), F.lit(turn))
        if turn == 0:
            held, order = held.join(wanted, "id"), -F.col("shared_bands")
        mixed = held.groupBy("band").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min(F.struct(order.alias("order"), "id", "component")).alias("leader"),
        ).where("lo < hi")
        open_buckets = staged(held.select("band", "id", "component").join(mixed.select("band", "leader"), "band"), "open")
        if open_buckets.isEmpty():
            break
        if turn < leaders:
            pairs = open_buckets.where("component != leader.component").select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).distinct()
        else:
            groups = open_buckets.select(F.col("leader.id").alias("g"), "id", "component").distinct()
            sure, pairs = split_pairs(staged(groups, "groups"), full, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if pairs.isEmpty() and sure is None:
            continue
        new = links(pairs)
        new = staged(new if sure is None else new.unionByName(sure), "links")
        if new.isEmpty():
            continue
        found = new if found is None else found.unionByName(new)
        labels = components(found).withColumnRenamed("node", "id")

    if labels is None:
        result = members.withColumn("component_id", F.coalesce("rep", "id"))
    else:
        named = labels.select(F.col("id").alias("rep"), "component")
        result = members.join(named, "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "id"))
    return result.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
