import numpy as np
from llm.brute_texts import classes

from determina.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def test_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows, vectors = [], {}
    for label in range(3):
        centres = rng.normal(size=(6, 16))
        for k in range(160):
            v = (centres[k % 6] + rng.normal(size=16) * rng.choice([0.02, 0.13, 0.2, 1.0])).astype(np.float32)
            if k % 40 == 39:
                v = np.array(rows[-1][1], np.float32)
            rows.append((label * 1000 + k, v.tolist(), label, "x"))
            vectors[label * 1000 + k] = (label, v.astype(float) / np.linalg.norm(v.astype(float)))
    near = lambda a, b: vectors[a][0] == vectors[b][0] and vectors[a][1] @ vectors[b][1] >= 0.98
    want = classes(sorted(vectors), near)
    links = {a: sum(near(a, b) for b in vectors if b != a) for a in vectors}
    assert sum(links.values()) > 500
    for size in (10_000, 60):
        got = hnsw.near_vectors(spark.createDataFrame(rows, SCHEMA), shard_rows=size, beam=4).collect()
        found = {r.vec_id: r.n_links for r in got}
        assert sum(found.values()) >= 0.999 * sum(links.values()) and all(found[k] <= links[k] for k in links)
        assert {r.vec_id: (r.component_id, r.kept) for r in got} == {k: (want[k], want[k] == k) for k in want}


def test_graph_recall():
    """Beams over the layers find the nearest nodes of random vectors."""
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(3000, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = hnsw.Graph(unit)
    queries = unit[:200].astype(np.float32)
    ids, _ = graph.search(queries, np.full((200, 1), graph.entry), 0, 128)
    exact = np.argsort(-(queries @ unit.T.astype(np.float32)), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), exact.tolist(), strict=True)]) > 0.9


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1, "x"), (2, v, 1, "x"), (3, v, 2, "x"), (4, v, None, "x"), (5, None, 1, "x"), (6, [0.0, 0.0, 0.0], 1, "x"), (7, [1.0, None, 3.0], 1, "x"), (8, [1.0, float("nan"), 3.0], 1, "x"),
        (9, [1.0, float("inf"), 3.0], 1, "x"), (10, [2.0, 4.0, 6.0], 1, "x"), (11, [1.0, 2.0], 1, "x"), (12, [], 1, "x"), (None, v, 1, "x"), (13, [1e30, 2e30, 3e30], 1, "x"), (14, [-0.0, 1.0, 0.0], 3, "x"), (15, [0.0, 1.0, 0.0], 3, "x"),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    alone = {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11, 12)}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 13: (3, 1, False), 14: (1, 14, True), 15: (1, 14, False), None: (0, None, True)} | alone
    assert hnsw.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
