import random

import pytest
from llm.brute_texts import classes, shingles
from pyspark.sql import functions as F

from determina.llm import minhash

SCHEMA = "doc_id long, text string, n_shingles string, kept int"


def family(seed: int, groups: int = 4, copies: int = 14) -> list[tuple]:
    """Groups of texts with more and more words replaced, so similarities lie on both sides of 0.75."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(60)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                text[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(text)))
    return rows


@pytest.mark.parametrize("leaders", [0, 1, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, leaders):
    rows = family(seed)
    sets = {d: shingles(t) for d, t in rows}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = classes(sorted(sets), link)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaders=leaders).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, "x", 1), (2, "", "x", 1), (3, " \t\n", None, None), (4, "one Two", "x", 1), (9, "ONE\ttwo", "x", 1), (5, long, "x", 1),
        (6, long, "x", 1), (None, long, "x", 1), (7, "une\x1cdeux", "x", 1), (8, "Élan vital a b c", "x", 1), (8, "Élan vital a b c", "x", 1), (10, "élan vital a b c", "x", 1),
    ]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id)
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 29_996, 5, True), (6, 29_996, 5, False), (7, 1, 7, True), (8, 1, 8, True), (8, 1, 8, True), (9, 1, 4, False), (10, 1, 10, True)]
    free = [r for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id, r.kept) for r in free] == [(29_996, None, True)]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimate_follows_similarity(spark):
    """Packed signatures of 64 pairs with a similarity of one half give about one half on average."""
    rows = []
    for k in range(64):
        common = [f"c{k}_{i}" for i in range(100)]
        rows += [(2 * k, " ".join(common + [f"a{k}_{i}" for i in range(46)])), (2 * k + 1, " ".join(common + [f"b{k}_{i}" for i in range(46)]))]
    df = spark.createDataFrame(rows, "id long, text string").mapInArrow(minhash.sketch_batches(5), "id long, n_shingles long, k1 long, k2 long, bands array<long>, signature array<long>")
    a, b = (df.where(F.col("id") % 2 == r).select((F.col("id") - r).alias("p"), F.col("signature").alias(n)) for r, n in ((0, "a"), (1, "b")))
    mean = a.join(b, "p").select(F.avg(minhash.estimate("a", "b"))).first()[0]
    assert abs(mean - 96 / 188) < 0.03
