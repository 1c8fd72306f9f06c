import random

import numpy as np
import pytest
from llm.brute_texts import repeated

from determina.llm import bwt


def corpus(seed: int) -> list[str]:
    """Passages shared by texts, copies, periods and stretches of another alphabet."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(20) for _ in range(4)]
    texts = [prose(rng.randrange(0, 30)) + rng.choice(shared)[: rng.randrange(40, 90)] + prose(rng.randrange(0, 30)) for _ in range(40)]
    return [*texts, texts[0], texts[1], "ab" * 100, "abc" * 30 + prose(5) + "abc" * 30, "", "x", "ééé" * 40]


@pytest.mark.parametrize("hot", [1, 3, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed, hot):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = bwt.digests(spark.createDataFrame(rows, "doc_id long, text string"), length=40, anchor=12, hot=hot, bucket_bytes=2000).collect()
    want = repeated([t.encode() for t in texts], 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_edge_cases(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, None, 1), (2, "", 1), (None, long, 1), (3, "q" * 199, 1), (4, "q" * 200, 1), (5, "z" * 201, 1), (5, long[1000:1400], 1), (6, "y" * 300, 1), (6, "y" * 300, 1)]
    got = bwt.digests(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")).collect()
    keyed = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in got)
    # 199 equal bytes are in no string of 200; 200 are one string, which occurs once; 201 hold it twice.
    assert keyed == [(0, 300_000, 400, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 199, 0, 0), (4, 200, 0, 0), (5, 201, 201, 1), (5, 400, 400, 1), (6, 300, 300, 1), (6, 300, 300, 1)]
    assert bwt.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_remove_keeps_characters_whole(spark):
    shared = "é" * 3 + "".join(f"part {i} of a passage, " for i in range(20))
    rows = [(1, "ü" + shared + "end", "x"), (2, "û" + shared + "fin", "x"), (3, "quiet", "x"), (4, None, "x"), (5, shared, "x"), (6, shared, "x")]
    got = {r.doc_id: r.text for r in bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()}
    # ü and û share their first byte, which is cut with the passage; nothing of the other half stays.
    assert got == {1: "end", 2: "fin", 3: "quiet", 4: None} or got == {1: "üend", 2: "ûfin", 3: "quiet", 4: None}


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_interleaves_suffixes(shards):
    """Suffixes of strings that occur twice come back in the order of a sort, in blocks of equal strings."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(shards)]
    orders = [bwt.sorted_suffixes(t, 6) for t in texts]
    suffix, block = bwt.merge([bwt.transform(t, o) for t, o in zip(texts, orders, strict=True)], np.arange(60 * shards), 6)
    prefix = lambda s, i: bytes(np.roll(texts[s], -i)[:6])
    every = sorted(prefix(s, i) for s in range(shards) for i in range(60))
    merged = [prefix(x // 60, orders[x // 60][x % 60]) for x in suffix]
    assert merged == [p for p in every if every.count(p) > 1] and len(set(suffix.tolist())) == len(suffix)
    assert [merged[i] != merged[i - 1] for i in range(1, len(merged))] == (np.diff(block) != 0).tolist()
    for s in range(shards):
        own = [x for x in suffix if x // 60 == s]
        assert all(prefix(s, orders[s][a % 60]) <= prefix(s, orders[s][b % 60]) for a, b in zip(own, own[1:], strict=False))
