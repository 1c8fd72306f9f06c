"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every string of ``length`` bytes is named by the smallest hash among its stretches of ``anchor``
bytes, so equal strings share a name and strings of one name lie together in a piece of text. Only
names found at two places or more go on. Pieces of one name meet in one bucket; a bucket's pieces are
dealt to shards, each shard's suffixes are sorted once, and the shards' transforms are merged by
refining how they interleave: each step orders the suffixes by two more leading bytes, using the
transforms alone, and carries blocks of equal prefixes along. After ``length`` bytes a block is a
common prefix of at least that length: a repeated interval.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from determina.llm.shared import Hasher, chunks, list_array, mix, runs, staged

LENGTH, ANCHOR = 200, 48


# ---- pieces of text by name -------------------------------------------------------------------


def pieces_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(name, first start, number of starts) of every piece; starts are places in ``data``."""
    wide = length - anchor + 1
    stretches = names = hasher.load(data).windows(anchor)
    if len(names) < wide:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    span = 1
    while 2 * span <= wide:
        names = np.minimum(names[:-span], names[span:])
        span *= 2
    if span < wide:
        names = np.minimum(names[: len(names) - (wide - span)], names[wide - span :])
    # names[p] is that of the string at p; strings must not leave their text.
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(inside[: len(names)]) > 0
    change = np.ones(len(names) + 1, bool)
    # A piece also ends where its string starts with the name's stretch, which then falls out; so a
    # piece has at most ``wide`` starts and no two equal strings, however periodic the text is.
    change[1:-1] = (names[1:] != names[:-1]) | (valid[1:] != valid[:-1]) | (stretches[: len(names) - 1] == names[:-1])
    change[offsets[:-1][offsets[:-1] < len(names)]] = True
    cut = np.flatnonzero(change)
    begin, size = cut[:-1], np.diff(cut)
    good = valid[begin]
    return names[begin[good]], begin[good], size[good]


def _piece_batches(length: int, anchor: int):
    """Task code: (k1, k2, id, text) to (name, k1, k2, id, start, n); a text met twice in a task once."""

    def run(batches):
        hasher, met = Hasher(), set()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                k1, k2 = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("k1", "k2"))
                name, begin, size = pieces_of(data, offsets, hasher, length, anchor)
                doc = np.searchsorted(offsets, begin, "right") - 1
                first = np.ones(hi - lo, bool)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    first[i] = key not in met
                    met.add(key)
                keep = first[doc]
                name, begin, size, doc = name[keep], begin[keep], size[keep], doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(k1[doc]), pa.array(k2[doc]), batch.column("id").take(pa.array(lo + doc)),
                     pa.array((begin - offsets[doc]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["name", "k1", "k2", "id", "start", "n"])

    return run


def _cut_batches(length: int):
    """Task code: (k1, k2, text, pieces) to (name, d1, d2, piece, k1, k2, start, n)."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                column = batch.column("pieces").slice(lo, hi - lo)
                many = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = column.flatten()
                name, start, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("name", "start", "n"))
                doc = np.repeat(np.arange(hi - lo), many)
                begin = offsets[doc] + start
                end = begin + size + length - 1
                d1 = hasher.load(data).spans(begin, end)
                d2 = mix(hasher.spans(begin, begin + length) * np.uint64(3) + hasher.spans(end - length, end) + size.astype(np.uint64))
                where = np.concatenate([[0], np.cumsum(end - begin)])
                body = data[np.repeat(begin - where[:-1], end - begin) + np.arange(where[-1])]
                piece = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                k1, k2 = (batch.column(c).slice(lo, hi - lo).to_numpy()[doc] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), piece, pa.array(k1), pa.array(k2), pa.array(start), pa.array(size)],
                    ["name", "d1", "d2", "piece", "k1", "k2", "start", "n"])

    return run


# ---- transforms and their merge ---------------------------------------------------------------


def sorted_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their next ``length`` bytes, round the end; ties in any order."""
    n = len(text)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | np.roll(text, -k)
    depth = 8
    while True:
        order = np.argsort(rank, kind="stable")
        if depth >= length:
            return order
        held = rank[order]
        dense = np.empty(n, np.uint64)
        dense[order] = np.cumsum(np.concatenate(([False], held[1:] != held[:-1]))).astype(np.uint64)
        step = min(depth, length - depth)
        rank = (dense << np.uint64(32)) | np.roll(dense, -step)
        depth += step


def transform(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix in order: the two bytes before it, as one number, and the rank of the suffix
    that begins with them."""
    rank = np.empty(len(text), np.int32)
    rank[order] = np.arange(len(text), dtype=np.int32)
    return (text[order - 2].astype(np.uint16) << np.uint16(8)) | text[order - 1], rank[order - 2]


def merge(transforms: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the asked suffixes of sorted shards after ``length`` bytes, and their blocks.

    Suffixes are numbered shard by shard, each in its own order. ``asked`` are the suffixes that
    follow the strings in question. Each step puts two bytes in front of all of them and keeps the
    order of before among equal ones, so after k steps they are interleaved by their first 2k bytes;
    blocks are those with the same bytes. A suffix alone in its block stays alone and leaves. What
    is returned begins the strings that occur twice or more. ``length`` is even.
    """
    sizes = np.cumsum([0, *(len(lead) for lead, _ in transforms)])
    lead = np.concatenate([x for x, _ in transforms])
    before = np.concatenate([r + np.int32(at) for (_, r), at in zip(transforms, sizes[:-1], strict=True)])
    suffix = np.sort(asked)
    block = np.zeros(len(suffix), np.int32)
    for _ in range(0, length, 2):
        key = lead[suffix]
        order = np.argsort(key, kind="stable")
        key, block = key[order], block[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        kept = ~(new[:-1] & new[1:])
        block = np.cumsum(new[:-1], dtype=np.int32)[kept]
        suffix = before[suffix[order[kept]]]
    return suffix, block


def repeated_starts(body: np.ndarray, where: np.ndarray, starts: np.ndarray, length: int, shards: int = 4) -> np.ndarray:
    """Which places of ``body`` are starts whose string also begins at another start.

    ``where`` are the ends of the pieces (with a leading 0), ``starts`` the starts of each piece.
    """
    n = len(where) - 1
    shards = max(1, min(shards, n))
    bounds = where[np.linspace(0, n, shards + 1).astype(int)]
    begin = np.repeat(where[:-1], starts)
    follow = begin + length + np.arange(len(begin)) - np.repeat(np.cumsum(starts) - starts, starts)
    transforms, orders, asked = [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        order = sorted_suffixes(body[a:b], length)
        rank = np.empty(b - a, np.int64)
        rank[order] = np.arange(b - a)
        asked.append(a + rank[(follow[(begin >= a) & (begin < b)] - a) % (b - a)])
        transforms.append(transform(body[a:b], order))
        orders.append(order + a)
    suffix, _ = merge(transforms, np.concatenate(asked), length)
    out = np.zeros(len(body), bool)
    out[np.concatenate(orders)[suffix]] = True
    return out


def _merge_bucket(length: int):
    """Task code: the pieces (d1, d2, n, piece) of a bucket to the repeated runs of starts of each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["d1", "d2", "n", "piece"]).combine_chunks()
        pieces = table.column("piece").to_pylist()
        body = np.frombuffer(b"".join(pieces), np.uint8)
        where = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        repeated = repeated_starts(body, where, table.column("n").to_numpy(), length)
        begin, end = runs(repeated)
        piece = np.searchsorted(where, begin, "right") - 1
        # Starts of two pieces are never neighbours: a piece ends with bytes that are no starts.
        d1, d2 = (table.column(c).to_numpy()[piece] for c in ("d1", "d2"))
        return pa.table({"d1": d1, "d2": d2, "begin": (begin - where[piece]).astype(np.int32), "end": (end - where[piece]).astype(np.int32)})

    return run


def _window_batches(length: int):
    """Task code: (d1, d2, n, piece) to (w1, w2, d1, d2, offset), one row per string of the piece."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("piece"), 1 << 18):
                size = batch.column("n").slice(lo, hi - lo).to_numpy()
                piece = np.repeat(np.arange(hi - lo), size)
                offset = np.arange(len(piece)) - (np.cumsum(size) - size)[piece]
                at = offsets[piece] + offset
                w1 = hasher.load(data).spans(at, at + length)
                w2 = mix(hasher.spans(at, at + length // 2) * np.uint64(5) + hasher.spans(at + length // 3, at + length))
                d1, d2 = (batch.column(c).slice(lo, hi - lo).to_numpy()[piece] for c in ("d1", "d2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(d1), pa.array(d2), pa.array(offset.astype(np.int32))],
                    ["w1", "w2", "d1", "d2", "offset"])

    return run


def _remove_batches(length: int):
    """Task code: (k1, k2, text, begins, ends) to (k1, k2, n_removed, spans, kept, clean).

    ``clean`` is the kept text without parts of characters at the edges of what is removed.
    """

    def run(batches):
        for batch in batches:
            begins, ends = batch.column("begins"), batch.column("ends")
            texts = batch.column("text")
            removed, spans, kept, clean = [], [], [], []
            for i in range(len(batch)):
                text = texts[i].as_py()
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, begins[i].values.to_numpy(), 1)
                np.add.at(edge, ends[i].values.to_numpy() + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                a, b = runs(gone)
                removed.append(int(gone.sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                parts = [text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)]
                kept.append(b"".join(parts))
                clean.append("".join(x.decode("utf-8", "ignore") for x in parts))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(clean, pa.string())],
                ["k1", "k2", "n_removed", "spans", "kept", "clean"])

    return run


# ---- the job ----------------------------------------------------------------------------------


def text_keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("k2")]


def repeated_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR,
                  hot: int = 16_384, bucket_bytes: int = 512 << 10) -> tuple[DataFrame, DataFrame]:
    """Distinct texts that repeat something, and their cleaned form.

    Returns (k1, k2, copies) of texts that several rows share, and (k1, k2, n_removed, spans, kept,
    clean) of distinct texts that share strings with other texts or within themselves.

    A bucket takes names of ``hot`` distinct pieces at most, about five megabytes. The strings of a
    name with more are counted by 128-bit digests, an exact way but for digests that collide.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).cast("binary").alias("text")).where(F.octet_length("text") >= length)
    rows = rows.select(*text_keys(F.col("text")), "id", "text")
    same = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")

    named = staged(rows.mapInArrow(_piece_batches(length, anchor), "name long, k1 long, k2 long, id string, start int, n int"), "names")
    place = F.xxhash64("k1", "k2", "start")
    twice = named.groupBy("name").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("name")
    once = named.join(twice, "name").groupBy("k1", "k2", "name", "start", "n").agg(F.min("id").alias("id"))
    wanted = once.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.collect_list(F.struct("name", "start", "n")).alias("pieces"))
    texts = staged(rows.join(wanted, ["k1", "k2", "id"]).select("k1", "k2", "text", "pieces"), "texts")
    cut = staged(texts.mapInArrow(_cut_batches(length), "name long, d1 long, d2 long, piece binary, k1 long, k2 long, start int, n int"), "pieces")

    # Pieces that are equal as a whole are one from here on; each of their strings is at two places.
    one = cut.groupBy("name", "d1", "d2", "n").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    kinds = staged(one, "kinds")
    whole = kinds.where("lo < hi").select("d1", "d2", F.lit(0).alias("begin"), F.col("n").alias("end"))
    crowd = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    first = kinds.join(crowd, "name").select("name", "d1", "d2", F.col("lo").alias("place"), (F.col("kinds") > hot).alias("hot"))
    kept = staged(cut.withColumn("place", place).join(first, ["name", "d1", "d2", "place"]).select("name", "d1", "d2", "n", "piece", "hot"), "shared")

    size = kept.where("not hot").agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    merged = kept.where("not hot").withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    merged = merged.groupBy("bucket").applyInArrow(_merge_bucket(length), "d1 long, d2 long, begin int, end int")
    strings = staged(kept.where("hot").select("d1", "d2", "n", "piece").mapInArrow(_window_batches(length), "w1 long, w2 long, d1 long, d2 long, offset int"), "strings")
    spot = F.xxhash64("d1", "d2", "offset")
    often = strings.groupBy("w1", "w2").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo < hi").select("w1", "w2")
    counted = strings.join(often, ["w1", "w2"]).select("d1", "d2", F.col("offset").alias("begin"), (F.col("offset") + 1).alias("end"))

    # Adjacent starts of a piece are joined before they go to every place of the piece.
    found = staged(whole.unionByName(merged).unionByName(counted), "found")
    lists = found.groupBy("d1", "d2").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    spots = cut.select("d1", "d2", "k1", "k2", "start").join(lists, ["d1", "d2"])
    shifted = F.transform("ranges", lambda r: r["begin"] + F.col("start"))
    ended = F.transform("ranges", lambda r: r["end"] + F.col("start"))
    by_text = spots.select("k1", "k2", shifted.alias("begins"), ended.alias("ends")).groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    cleaned = texts.select("k1", "k2", "text").join(by_text, ["k1", "k2"]).mapInArrow(
        _remove_batches(length), "k1 long, k2 long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, clean string")
    return same, cleaned


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, **settings) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Texts are UTF-8 bytes; null is empty. A byte goes if it lies in a string of ``length`` bytes that
    also starts anywhere else, judged on the input. Texts shorter than that lose nothing; texts that
    several rows share lose everything. Null or repeated ids change nothing, extra columns are
    ignored, and an empty table gives an empty result.
    """
    same, cleaned = repeated_runs(docs, text, id_col, length, **settings)
    cleaned = cleaned.select("k1", "k2", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha")).dropDuplicates(["k1", "k2"])
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(id_col), raw.alias("raw")).select(F.col(id_col), *text_keys(F.col("raw")), F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("own"))
    joined = rows.join(same, ["k1", "k2"], "left").join(staged(cleaned, "cleaned"), ["k1", "k2"], "left")
    gone = F.col("copies").isNotNull()
    return joined.select(
        id_col, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, **settings) -> DataFrame:
    """``docs`` without repeated strings; rows of which nothing is left go, rows without text stay."""
    same, cleaned = repeated_runs(docs, text, id_col, length, **settings)
    keys = text_keys(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), *keys)
    joined = rows.join(same, ["k1", "k2"], "left").join(cleaned.select("k1", "k2", "clean"), ["k1", "k2"], "left")
    joined = joined.where("copies is null and (clean is null or clean != '')")
    return joined.select(*(F.coalesce("clean", "text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
