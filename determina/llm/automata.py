"""Removal of repeated passages by suffix automata of reference shards.

All texts are the reference and all are streamed over it. So that no text has to meet every shard,
reference and stream are cut alike: a window of ``window`` words is named by the smallest hash among
its stretches of four words, neighbouring windows of one name are a passage, and passages of one name,
the only ones that can share a window, go to one shard. A shard is at most some hundred kilobytes of
distinct passages with the number of their places; its suffix automaton, whose states count the places
where their strings end, stays in the one task that the shard's passages are sent to, which is less
than a broadcast of every automaton to every task. The matching statistic of a word is the length of
the longest string that ends there and ends elsewhere too; where it reaches the threshold, the words it
covers go.

Hashes only decide who meets whom. What is equal is decided by the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from determina.llm.shared import SPACED, Hasher, chunks, mix, runs, staged, tokens

#: Words of a window, and of the stretches that name it.
WINDOW, STRETCH = 35, 4
#: A name with more distinct passages than this is spread over shards by single windows.
CROWD = 1024
SHARD_BYTES = 512 << 10


# ---- suffix automaton -------------------------------------------------------------------------


class Automaton:
    """The suffix automaton of several sequences, each with a number of places."""

    def __init__(self) -> None:
        self.length, self.link, self.after, self.places = [0], [-1], [{}], [0]

    def add(self, words: list, places: int) -> list[int]:
        """Read a sequence; the states of its beginnings, which stay theirs."""
        length, link, after, count = self.length, self.link, self.after, self.places
        last, states = 0, []
        for word in words:
            known = after[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._part(last, word, known)
            else:
                new, at = len(length), last
                length.append(length[last] + 1)
                link.append(0)
                after.append({})
                count.append(0)
                while at >= 0 and word not in after[at]:
                    after[at][word] = new
                    at = link[at]
                if at >= 0:
                    known = after[at][word]
                    link[new] = known if length[known] == length[at] + 1 else self._part(at, word, known)
                last = new
            count[last] += places
            states.append(last)
        return states

    def _part(self, at: int, word, known: int) -> int:
        """A state of its own for the strings of ``known`` that extend those of ``at``."""
        new = len(self.length)
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.after.append(dict(self.after[known]))
        self.places.append(0)
        self.link[known] = new
        while at >= 0 and self.after[at].get(word) == known:
            self.after[at][word] = new
            at = self.link[at]
        return new

    def close(self) -> Automaton:
        """After the last sequence: ``repeated[s]`` is the length of the longest string of state s or
        its suffixes that ends at two places or more."""
        length, link, places = self.length, self.link, self.places
        order = np.argsort(np.array(length), kind="stable").tolist()
        for s in reversed(order[1:]):
            places[link[s]] += places[s]
        self.repeated = [0] * len(length)
        for s in order[1:]:
            self.repeated[s] = length[s] if places[s] > 1 else self.repeated[link[s]]
        return self

    def statistics(self, words: list) -> list[int]:
        """For each word of any text, the longest string that ends there and occurs in a sequence."""
        length, link, after = self.length, self.link, self.after
        at, long, out = 0, 0, []
        for word in words:
            while at and word not in after[at]:
                at = link[at]
                long = length[at]
            if word in after[at]:
                at = after[at][word]
                long += 1
            out.append(long)
        return out


def covered(statistics: list[int], least: int) -> np.ndarray:
    """Which words a string of at least ``least`` words covers, by the statistics of all words."""
    long = np.array(statistics, np.int64)
    edge = np.zeros(len(long) + 1, np.int64)
    ends = np.flatnonzero(long >= least)
    np.add.at(edge, ends + 1 - long[ends], 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge[:-1]) > 0


# ---- passages ---------------------------------------------------------------------------------


def passages(hashes: np.ndarray, first: np.ndarray, window: int, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows) of all passages; text i has the words ``first[i]`` on.

    A passage ends before the name's stretch falls out, so no window occurs in it twice.
    """
    windows = len(hashes) - window + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = hashes
    for k in range(1, stretch):
        names = mix(names[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    stretches, wide, span = names, window - stretch + 1, 1
    while 2 * span <= wide:
        names = np.minimum(names[:-span], names[span:])
        span *= 2
    if span < wide:
        names = np.minimum(names[: len(names) - (wide - span)], names[wide - span :])
    edge = np.zeros(windows + 1, np.int64)
    long = np.flatnonzero(np.diff(first) >= window)
    np.add.at(edge, first[long], 1)
    np.add.at(edge, np.minimum(first[long + 1] - window + 1, windows), -1)
    valid = np.cumsum(edge[:-1]) > 0
    change = np.ones(windows + 1, bool)
    change[1:-1] = (names[1:] != names[:-1]) | (valid[1:] != valid[:-1]) | (stretches[: windows - 1] == names[:-1])
    change[first[:-1][first[:-1] < windows]] = True
    cut = np.flatnonzero(change)
    begin, many = cut[:-1], np.diff(cut)
    good = valid[begin]
    return names[begin[good]], begin[good], many[good]


def _name_batches(window: int, stretch: int):
    """Task code: (k1, k2, text) to (name, k1, k2, start, n)."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                starts, ends, first = tokens(data, offsets, SPACED)
                name, begin, many = passages(hasher.load(data).spans(starts, ends), first, window, stretch)
                text = np.searchsorted(first, begin, "right") - 1
                k1, k2 = (batch.column(c).slice(lo, hi - lo).to_numpy()[text] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(k1), pa.array(k2), pa.array((begin - first[text]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["name", "k1", "k2", "start", "n"])

    return run


def _cut_batches(window: int):
    """Task code: (k1, k2, text, copies, passages) to (name, passage, k1, k2, start, n, copies)."""

    def run(batches):
        for batch in batches:
            k1, k2, copies = (batch.column(c) for c in ("k1", "k2", "copies"))
            for i in range(len(batch)):
                words = batch.column("text")[i].as_buffer().to_pybytes().split()
                own = batch.column("passages")[i].values
                start, n = (own.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                bodies = [b" ".join(words[a : a + m + window - 1]) for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                same = lambda value: pa.repeat(value, len(bodies))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [own.field("name"), pa.array(bodies, pa.binary()), same(k1[i]), same(k2[i]), own.field("start"), own.field("n"), same(copies[i])],
                    ["name", "passage", "k1", "k2", "start", "n", "copies"])

    return run


def _single_windows(window: int):
    """Task code: (passage, n, p1, p2, places) to (passage, offset, p1, p2, places) of single windows."""

    def run(batches):
        extra = ("p1", "p2", "places")
        for batch in batches:
            n = batch.column("n").to_numpy()
            bodies = []
            for i in range(len(batch)):
                words = batch.column("passage")[i].as_py().split(b" ")
                bodies += [b" ".join(words[j : j + window]) for j in range(int(n[i]))]
            row = pa.array(np.repeat(np.arange(len(batch)), n))
            offset = np.arange(len(bodies)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bodies, pa.binary()), pa.array(offset.astype(np.int32)), *(batch.column(c).take(row) for c in extra)], ["passage", "offset", *extra])

    return run


def _shard(window: int):
    """Task code: the passages (p1, p2, passage, places) of a shard to the runs of their repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        automaton, states = Automaton(), []
        for body, places in zip(table.column("passage").to_pylist(), table.column("places").to_pylist(), strict=True):
            states.append(automaton.add([number.setdefault(w, len(number)) for w in body.split(b" ")], places))
        repeated = automaton.close().repeated
        at, begins, ends = [], [], []
        for i, own in enumerate(states):
            begin, end = runs(np.array([repeated[s] >= window for s in own[window - 1 :]], bool))
            if len(begin):
                at.append(i)
                begins.append(begin.tolist())
                ends.append(end.tolist())
        took, kind = table.take(pa.array(at, pa.int64())), pa.list_(pa.int32())
        return pa.table({"p1": took.column("p1"), "p2": took.column("p2"), "begins": pa.array(begins, kind), "ends": pa.array(ends, kind)})

    return run


# ---- the job ----------------------------------------------------------------------------------


def _keys(column: str, *names: str) -> list[Column]:
    return [F.xxhash64(column).alias(names[0]), F.xxhash64(F.lit(1), column, F.octet_length(column)).alias(names[1])]


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW, stretch: int = STRETCH,
                     crowd: int = CROWD, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Staged distinct texts that share a name with another passage, and their repeated windows.

    Returns (k1, k2, text) and (k1, k2, begins, ends), runs of window starts by word number. Equal
    texts are one text whose passages have that many places. ``k1, k2`` are 128 bits of a text.
    """
    rows = docs.select(F.col(text).cast("binary").alias("text")).where(F.octet_length("text") >= 2 * window - 1)
    rows = rows.select(*_keys("text", "k1", "k2"), "text")
    named = rows.mapInArrow(_name_batches(window, stretch), "name long, k1 long, k2 long, start int, n int")
    named = staged(named.groupBy("name", "k1", "k2", "start", "n").agg(F.count(F.lit(1)).alias("copies")), "names")
    twice = staged(named.groupBy("name").agg(F.sum("copies").alias("places")).where("places > 1").select("name"), "twice")
    wanted = named.join(twice, "name").groupBy("k1", "k2").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("name", "start", "n")).alias("passages"))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"])
    texts = staged(texts.select("k1", "k2", "text", "copies", "passages"), "texts")

    cut = texts.mapInArrow(_cut_batches(window), "name long, passage binary, k1 long, k2 long, start int, n int, copies long")
    cut = staged(cut.select("name", "passage", *_keys("passage", "p1", "p2"), "k1", "k2", "start", "n", "copies"), "passages")
    kinds = cut.groupBy("name", "passage", "n").agg(F.sum("copies").alias("places"))
    kinds = staged(kinds.select("name", "passage", *_keys("passage", "p1", "p2"), "n", "places"), "kinds")
    crowded = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("passage") * F.col("n")).alias("bytes"))
    crowded = staged(crowded.where(F.col("kinds") > crowd).select("name", "bytes"), "crowded")

    # Passages of crowded names go as single windows, each to the shard of its own words.
    single = kinds.join(crowded, "name").select("passage", "n", "p1", "p2", "places")
    single = single.mapInArrow(_single_windows(window), "passage binary, offset int, p1 long, p2 long, places long")
    single = staged(single.select("passage", *_keys("passage", "w1", "w2"), "offset", "p1", "p2", "places"), "windows")
    apart = single.groupBy("w1", "w2", "passage").agg(F.sum("places").alias("places"))
    reference = kinds.join(crowded, "name", "left_anti").select("p1", "p2", "passage", "places", F.col("name").alias("dealt"))
    reference = reference.unionByName(apart.select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), "passage", "places", F.col("w1").alias("dealt")))
    size = sum(t.agg(F.sum(x)).first()[0] or 0 for t, x in ((kinds, F.octet_length("passage")), (crowded, F.col("bytes"))))
    shards = max(1, -(-size // shard_bytes))
    sent = reference.select(F.pmod(F.xxhash64("dealt"), F.lit(shards)).alias("shard"), "p1", "p2", "passage", "places")
    found = staged(sent.groupBy("shard").applyInArrow(_shard(window), "p1 long, p2 long, begins array<int>, ends array<int>"), "found")

    again = single.join(found.select(F.col("p1").alias("w1"), F.col("p2").alias("w2")), ["w1", "w2"]).groupBy("p1", "p2")
    again = again.agg(F.collect_list("offset").alias("begins"), F.collect_list(F.col("offset") + 1).alias("ends"))
    every = staged(found.unionByName(again), "repeated")
    moved = [F.transform(c, lambda x: x + F.col("start")).alias(c) for c in ("begins", "ends")]
    back = cut.select("p1", "p2", "k1", "k2", "start").join(every, ["p1", "p2"]).select("k1", "k2", *moved)
    back = back.groupBy("k1", "k2").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")))
    return texts.select("k1", "k2", "text"), back


def _gone(words: int, begins: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows of these runs of starts cover."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, ends + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept_batches(window: int):
    """Task code: (k1, k2, text, begins, ends) to (k1, k2, n_removed, spans, kept)."""

    def run(batches):
        for batch in batches:
            removed, spans, kept = [], [], []
            for i in range(len(batch)):
                words = batch.column("text")[i].as_buffer().to_pybytes().split()
                gone = _gone(len(words), *(batch.column(c)[i].values.to_numpy() for c in ("begins", "ends")), window)
                a, b = runs(gone)
                removed.append(int(gone.sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(b" ".join([w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[x:y]]).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                ["k1", "k2", "n_removed", "spans", "kept"])

    return run


def cleaned_texts(docs: DataFrame, text: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """(k1, k2, n_removed, spans, kept) of distinct texts that repeat something, by their keys.

    ``spans`` are word numbers of what goes, ``kept`` the other words, joined by one space.
    """
    texts, found = repeated_windows(docs, text, window, **limits)
    return texts.join(found, ["k1", "k2"]).mapInArrow(
        _kept_batches(window), "k1 long, k2 long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def _word_batches(batches):
    """Task code: (row, k1, k2, text) to (row, k1, k2, n_words, words_sha256)."""
    import hashlib

    for batch in batches:
        n, sha = [], []
        for _, _, data, offsets in chunks(batch.column("text")):
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = raw[a:b].split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "k1", "k2")), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                         ["row", "k1", "k2", "n_words", "words_sha256"])


def digests(docs: DataFrame, text: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """(row, n_words, n_removed, spans, kept_sha256) of every row, ``row`` being all its columns.

    Words are separated by ASCII white space and compared as they are. A word goes if it lies in a
    window of ``window`` words of its text that begins anywhere else, in the same text or another; what
    goes is judged on the texts as given. Equal texts in several rows repeat each other, whatever their
    ids. Null and empty texts have no words; texts shorter than a window lose nothing.
    """
    table = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = table.select("row", *_keys("text", "k1", "k2"), "text")
    words = table.mapInArrow(_word_batches, StructType([table.schema["row"], *StructType.fromDDL("k1 long, k2 long, n_words long, words_sha256 string").fields]))
    clean = cleaned_texts(docs, text, window, **limits).select("k1", "k2", "n_removed", "spans", F.sha2("kept", 256).alias("sha"))
    return words.join(clean, ["k1", "k2"], "left").select(
        "row", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("sha", "words_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, **limits) -> DataFrame:
    """``docs`` without repeated passages; a text that loses nothing stays as it is, one that does is
    its kept words joined by one space. Rows stay, also those that become empty."""
    clean = cleaned_texts(docs, text, window, **limits).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept").alias("_kept"))
    table = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("row", *_keys("text", "k1", "k2"))
    joined = table.join(clean, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return joined.select(*((F.coalesce("_kept", F.col("row")[c]) if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
