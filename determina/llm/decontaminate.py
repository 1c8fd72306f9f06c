"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words is streamed over the training words; the longest match that ends
at each word tells whether a window of an item occurs there. Words that no item has reset the match,
so only runs of known words are walked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from determina.llm.shared import ALNUM, LOWER, Hasher, chunks, list_array, runs, tokens


class Automaton:
    """Every run of words of every item is a path from state 0.

    ``state_items[s]`` are the items that contain the strings of state s; ``window_state[s]`` is the
    state on the suffix path of s that holds its last ``window`` words, or -1; ``whole[s]`` are the
    (length, item) of items shorter than a window that end on the suffix path of s.
    """

    def __init__(self, items: list[np.ndarray], window: int) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        seqs = [x.tolist() for x in items]
        for seq in seqs:
            last = 0
            for word in seq:
                last = self._add(last, word)
        n = len(self.length)
        self.state_items: list[set[int]] = [set() for _ in range(n)]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, seq in enumerate(seqs):
            at = 0
            for word in seq:
                at = up = self.next[at][word]
                while up > 0 and len(seq) >= window and k not in self.state_items[up]:
                    self.state_items[up].add(k)
                    up = self.link[up]
            if 0 < len(seq) < window:
                ends[at].append((len(seq), k))
        self.window_state, self.whole = [-1] * n, [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.whole[s] = (*ends[s], *self.whole[up])
            if self.length[s] >= window:
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, at: int, word: int, long: int) -> int:
        """The state of the strings of ``long`` that are as short as those that ``at`` extends."""
        if self.length[long] == self.length[at] + 1:
            return long
        copy = self._state(self.length[at] + 1, self.link[long], dict(self.next[long]))
        self.link[long] = copy
        while at >= 0 and self.next[at].get(word) == long:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.next[at][word])
        return new

    def matches(self, words: list[int], window: int):
        """(position after the match, words matched, items) of each window that ends in ``words``."""
        after, link, length, state, long = self.next, self.link, self.length, 0, 0
        for i, word in enumerate(words, 1):
            while state and word not in after[state]:
                state = link[state]
                long = length[state]
            if word in after[state]:
                state = after[state][word]
                long += 1
            if long >= window and self.window_state[state] >= 0:
                yield i, window, self.state_items[self.window_state[state]]
            for size, item in self.whole[state]:
                if size <= long:
                    yield i, size, (item,)


def _clean_batches(names: list[str], texts: list[str], window: int, longest: int, coverage: float):
    """Task code: (row, text, starts, ends, items) to the same with hits of these items added."""

    def run(batches):
        hasher = Hasher()
        parts = []
        for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
            data = LOWER[data]
            starts, ends, first = tokens(data, offsets, ALNUM)
            hashes = hasher.load(data).spans(starts, ends)
            parts += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        items = [np.searchsorted(known, x) for x in parts]
        least = min([min(len(x), window) for x in items if len(x)], default=window)
        automaton = Automaton(items, window)
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text")):
                data = LOWER[raw]
                starts, ends, first = tokens(data, offsets, ALNUM)
                hashes = hasher.load(data).spans(starts, ends)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                is_known = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                # A run of known words never crosses into the next text.
                run_starts, run_ends = runs(np.insert(is_known, first[1:-1], False))
                shift = np.searchsorted(first[1:-1] + np.arange(len(first) - 2), run_starts, "right")
                run_starts, run_ends = run_starts - shift, run_ends - shift
                edge = np.zeros(len(starts) + 1, np.int64)
                found: dict[int, set[int]] = {}
                for a, b in zip(run_starts.tolist(), run_ends.tolist(), strict=True):
                    if b - a < least:
                        continue
                    for end, size, which in automaton.matches(at[a:b].tolist(), window):
                        edge[a + end - size] += 1
                        edge[a + end] -= 1
                        found.setdefault(int(np.searchsorted(first, a, "right")) - 1, set()).update(which)
                hit = np.cumsum(edge[:-1]) > 0
                earlier = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("starts", "ends", "items")]
                for doc in range(hi - lo):
                    for a, b in zip(earlier[0][doc], earlier[1][doc], strict=True):
                        hit[first[doc] + a : first[doc] + b] = True
                yield _rows(batch, lo, hi, raw, offsets, (starts, ends, first), hit, found, earlier[2], names, longest, coverage)

    return run


def _rows(batch, lo, hi, raw, offsets, words, hit, found, earlier, names, longest, coverage):
    starts, ends, first = words
    out: dict[str, list] = {k: [] for k in ("starts", "ends", "items", "n_words", "n_hit", "spans", "clean", "dropped")}
    for doc in range(hi - lo):
        a, b = first[doc], first[doc + 1]
        own = hit[a:b]
        run_a, run_b = runs(own) if own.any() else (own[:0], own[:0])
        n_hit = int(own.sum())
        cuts = [(x, y) for x, y in zip(run_a.tolist(), run_b.tolist(), strict=True) if y - x >= longest]
        spans = [(int(starts[a + x] - offsets[doc]), int(ends[a + y - 1] - offsets[doc])) for x, y in cuts]
        clean = None
        if spans:
            text, at, kept = raw[offsets[doc] : offsets[doc + 1]].tobytes(), 0, []
            for x, y in spans:
                kept.append(text[at:x])
                at = y
            clean = b"".join([*kept, text[at:]]).decode()
        out["starts"].append(run_a.tolist())
        out["ends"].append(run_b.tolist())
        out["items"].append(sorted({*earlier[doc], *(names[k] for k in found.get(doc, ()))}))
        out["n_words"].append(int(b - a))
        out["n_hit"].append(n_hit)
        out["spans"].append([{"start": x, "end": y} for x, y in spans])
        out["clean"].append(clean)
        out["dropped"].append(n_hit > 0 and n_hit > coverage * (b - a))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int64(), span, pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [batch.column("row").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
        ["row", "text", *out],
    )


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, longest: int = 1, coverage: float = 0.5, shard_bytes: int = 4 << 20) -> DataFrame:
    """(row, text, starts, ends, items, n_words, n_hit, spans, clean, dropped) of every document.

    ``row`` holds all columns of ``docs``. ``starts`` and ``ends`` are word numbers of maximal runs
    of hit words, ``items`` the ids (as text, sorted) with an occurring window. Runs of ``longest``
    words or more are cut out: ``spans`` are their byte ranges and ``clean`` the text without them
    (null: nothing to cut). ``dropped``: more than ``coverage`` of the words are hit.

    Items are read by the driver in shards of about ``shard_bytes``; each shard is one automaton,
    sent to the tasks, and all shards are streamed over the texts in one stage without a shuffle.
    Null or empty texts have no words. Null items, or items without words, have no window; an item
    with a null id is called by the empty text. Repeated items count once each id. No items: no hits.
    """
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    nothing = F.array().cast("array<int>")
    table = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), nothing.alias("starts"), nothing.alias("ends"), F.array().cast("array<string>").alias("items"))
    added = StructType.fromDDL("starts array<int>, ends array<int>, items array<string>, n_words long, n_hit long, "
                               "spans array<struct<start:long,end:long>>, clean string, dropped boolean")
    kind = StructType(table.schema.fields[:2] + added.fields)
    for shard in range(shards):
        here = sorted((r.name, r.text) for r in chosen.where(F.pmod(F.xxhash64("name", "text"), F.lit(shards)) == shard).collect())
        names, texts = [r[0] for r in here], [r[1] for r in here]
        table = table.select("row", "text", "starts", "ends", "items").mapInArrow(_clean_batches(names, texts, window, longest, coverage), kind)
    return table


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the hit spans cut out of the text; documents over the coverage limit go."""
    found = contamination(docs, items, text_col, **limits).where("not dropped")
    return found.select(*(F.coalesce("clean", "text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
