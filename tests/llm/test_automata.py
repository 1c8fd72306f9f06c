import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.brute_texts import words_as_are

from determina.llm import automata


def brute(texts: list, window: int) -> list[tuple[int, int, list, str]]:
    """(words, removed, spans, sha256 of what is kept) of each text, from all windows of all texts."""
    split = [words_as_are(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        edges = [i for i in range(len(w) + 1) if (i < len(w) and gone[i]) != (i > 0 and gone[i - 1])]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), list(zip(edges[::2], edges[1::2], strict=True)), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed: int) -> list:
    """Shared passages in changing surroundings, copies, near copies, periods and stray white space."""
    rng = random.Random(seed)
    prose = lambda n: [rng.choice("abcdefgé") + rng.choice("xyz") for _ in range(n)]
    shared = [prose(rng.randrange(8, 40)) for _ in range(4)]
    texts = [prose(rng.randrange(0, 30)) + rng.choice(shared) + prose(rng.randrange(0, 30)) for _ in range(60)]
    texts += [[*shared[0][:k], "new", *shared[0][k:]] for k in range(len(shared[0]))]
    texts += [texts[0], texts[0], ["q"] * 40, ["q", "r"] * 30, [*prose(20)] * 3, prose(9), prose(11)]
    return [rng.choice([" ", "\n", " \t"]).join(t) for t in texts] + [None, "", "  ", texts[1][0]]


@pytest.mark.parametrize(("seed", "crowd", "shard_bytes"), [(1, 1024, 512 << 10), (2, 3, 900), (3, 1, 300), (4, 20, 5000)])
def test_against_all_windows(spark, seed, crowd, shard_bytes):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = automata.digests(docs, window=10, crowd=crowd, shard_bytes=shard_bytes).collect()
    want = brute(texts, 10)
    assert {r.row.doc_id: (r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256) for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("seed", range(20))
def test_statistics_against_all_strings(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(6)]
    places = [rng.randrange(1, 3) for _ in texts]
    automaton = automata.Automaton()
    states = [automaton.add(t, p) for t, p in zip(texts, places, strict=True)]
    automaton.close()
    ends = Counter(tuple(t[i:j]) for t, p in zip(texts, places, strict=True) for i in range(len(t)) for j in range(i + 1, len(t) + 1) for _ in range(p))
    for t, own in zip(texts, states, strict=True):
        longest = [max((k for k in range(i + 1) if k and ends[tuple(t[i - k : i])] > 1), default=0) for i in range(1, len(t) + 1)]
        assert [automaton.repeated[s] for s in own] == longest
    other = [rng.randrange(3) for _ in range(60)]
    longest = [max((k for k in range(i + 1) if k and ends[tuple(other[i - k : i])] > 0), default=0) for i in range(1, len(other) + 1)]
    assert automaton.statistics(other) == longest
    want = [any(i - longest[i - 1] <= x < i and longest[i - 1] >= 4 for i in range(1, 61)) for x in range(60)]
    assert automata.covered(longest, 4).tolist() == want


def test_edge_cases(spark):
    rng = random.Random(3)
    long = [str(rng.randrange(10**6)) for _ in range(60_000)]
    rows = [(1, None, 1), (2, "", 1), (None, " ".join(long), 1), (3, "q " * 35, 1), (4, "z " * 36, 1), (5, " ".join(long[500:600]), 1), (5, "x " * 34, 1),
            (6, " ".join(str(i) for i in range(50)), 1), (6, " ".join(str(i) for i in range(50)), 1)]
    got = automata.digests(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((r.row.doc_id or 0, r.n_words, r.n_removed) for r in got) == [
        (0, 60_000, 100), (1, 0, 0), (2, 0, 0), (3, 35, 0), (4, 36, 36), (5, 34, 0), (5, 100, 100), (6, 50, 50), (6, 50, 50)]
    assert automata.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_remove_repeats(spark):
    shared = " ".join(f"part{i}" for i in range(40))
    rows = [(1, f"a  {shared} b", "x"), (2, f"{shared}\nc  d", "y"), (3, "left  as it is", "z"), (4, None, None), (5, shared, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    got = automata.remove_repeats(table)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a b", "x"), (2, "c d", "y"), (3, "left  as it is", "z"), (4, None, None), (5, "", "x")]
    assert automata.remove_repeats(table.where("false")).collect() == []


def test_passages_hold_every_window_once():
    rng = np.random.default_rng(2)
    sizes = [0, 9, 10, 11, 300, 0, 40]
    hashes = rng.integers(0, 40, sum(sizes)).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, begin, many = automata.passages(hashes, first, 10, 4)
    got = [b + k for b, m in zip(begin.tolist(), many.tolist(), strict=True) for k in range(m)]
    assert got == [int(f) + i for f, n in zip(first[:-1], sizes, strict=True) for i in range(n - 9)]
