import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.brute_texts import words_as_are

from determina.llm import periods, queries


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, from every period and every place."""
    out = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def fast_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([x for t in texts for x in t], np.int64)
    out = [[] for _ in texts]
    for start, end, period in periods.runs_of(codes, first):
        k = int(np.searchsorted(first, start, "right")) - 1
        out[k].append((start - int(first[k]), end - start, period))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_random_words(texts):
    assert fast_runs(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_planted_runs(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t += [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
            root = [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33]))]
            t += (root * 7)[: len(root) * 4 + rng.randrange(0, len(root) * 3)]
        texts.append(t)
    assert fast_runs(texts) == [brute_runs(t) for t in texts]


def test_long_text():
    rng = np.random.default_rng(1)
    root = rng.integers(0, 50, 3000)
    text = np.concatenate([rng.integers(0, 50, 1000), np.tile(root, 5)[:13_000], rng.integers(50, 99, 500), np.zeros(20_000, int)])
    (start, end, period), last = periods.runs_of(text, np.array([0, len(text)]))
    assert period == 3000 and 900 < start <= 1000 and 14_000 <= end < 14_010
    assert last == (14_500, 34_500, 1)


def digest(doc_id, text):
    """What the query returns for a document, from its definition."""
    w = words_as_are(text)
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "x x x x x", "x x x x x x", "a b a b a b a b", "a b\ta b\n a  b a"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 80))) for _ in range(150)]
    texts += [" ".join(str(rng.randrange(400)) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    texts += ["wort " * 3000, "é ü " * 40 + "é", "A a " * 9]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "q " * 9, None), (7, "again " * 8, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periods(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *digest(i, t)) for i, t, _ in rows], key=str)


def test_empty_table_and_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string, runs int")
    assert periods.periodic_runs(none).collect() == [] and periods.run_lines(none).collect() == []
    lines = periods.run_lines(spark.createDataFrame([("a " * 6 + "b " * 7, 1), (None, 2)], "text string, start int")).collect()
    assert [(r.row.start, r.start, r.length, r.period) for r in lines] == [(1, 0, 6, 1), (1, 6, 7, 1)]
