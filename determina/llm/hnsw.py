"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label are dealt to shards of bounded size; a task builds one graph per shard. Every
shard of the label is then searched for every vector: a beam walks the graph, and is widened while
its worst member is still a link, and for all vectors while the recall on an audit of exact answers
falls short. Cosines are confirmed in double precision and linked vectors are united.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.llm.shared import components, mix, staged

#: Room for single precision when candidates are picked; double precision decides.
SLACK = 1e-4


class Graph:
    """A layered graph over unit vectors; links of node i in layer l are ``layers[l][i]`` (-1: none)."""

    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 5) -> None:
        self.vectors, self.degree = vectors.astype(np.float32), degree
        n = len(vectors)
        drawn = (mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) + np.float64(1)) / 2.0**64
        level = np.minimum(-np.log(drawn) / np.log(degree), 6).astype(int)
        self.layers = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(level.max() + 1 if n else 1)]
        order = np.argsort(-level, kind="stable")
        self.entry, done = (int(order[0]) if n else -1), 1
        while done < n:
            batch = order[done : done + max(1, min(done // 2, 512))]
            self._insert(batch, level, beam)
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int) -> None:
        near = np.full((len(batch), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            width = beam if (level[batch] >= k).any() else 4
            near, _ = self.search(self.vectors[batch], near, k, width)
            here = np.flatnonzero(level[batch] >= k)
            if not len(here):
                continue
            mates = self.vectors[batch[here]] @ self.vectors[batch[here]].T
            np.fill_diagonal(mates, -2)
            few = min(8, len(here) - 1)
            extra = batch[here][np.argpartition(-mates, few - 1, axis=1)[:, :few]] if few else np.zeros((len(here), 0), int)
            links = self._choose(batch[here], np.concatenate([near[here], extra], 1), self.layers[k].shape[1] // (2 if k == 0 else 1))
            self.layers[k][batch[here], : links.shape[1]] = links
            self._link_back(batch[here], links, k)

    def _link_back(self, nodes: np.ndarray, links: np.ndarray, k: int) -> None:
        to, source = links.ravel(), np.repeat(nodes, links.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, begin, count = np.unique(to, return_index=True, return_counts=True)
        # Many new links to one node are taken in turns, so that no step is wider than the layer.
        step = self.layers[k].shape[1]
        for turn in range(-(-int(count.max(initial=0)) // step)):
            live = np.flatnonzero(count > turn * step)
            at = begin[live, None] + turn * step + np.arange(step)
            new = np.where(at < (begin + count)[live, None], source[np.minimum(at, len(source) - 1)], -1)
            own = targets[live]
            self.layers[k][own] = self._choose(own, np.concatenate([self.layers[k][own], new], 1), step)

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` links: candidates nearer to the node than to a chosen one, then the nearest."""
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        by_id = np.sort(candidates, axis=1)
        by_id[:, 1:][by_id[:, 1:] == by_id[:, :-1]] = -1
        sims = np.einsum("nd,ncd->nc", self.vectors[nodes], self.vectors[by_id])
        sims[by_id < 0] = -2
        order = np.argsort(-sims, axis=1)[:, : 3 * most]
        by_id, sims = np.take_along_axis(by_id, order, 1), np.take_along_axis(sims, order, 1)
        among = np.matmul(self.vectors[by_id], self.vectors[by_id].transpose(0, 2, 1))
        chosen = np.zeros(by_id.shape, bool)
        closest = np.full(by_id.shape, -2.0, np.float32)
        for j in range(by_id.shape[1]):
            good = (by_id[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (chosen.sum(1) < most)
            chosen[:, j] = good
            closest = np.where(good[:, None], np.maximum(closest, among[:, j]), closest)
        rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out = np.full((len(nodes), most), -1, np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(by_id, rank, 1)
        return out

    def search(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and cosines of the ``beam`` nearest nodes found, best first."""
        m, links = len(queries), self.layers[layer]
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -2, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, len(self.vectors)), bool)
        # So many of the best open nodes are expanded together.
        turn = max(4, beam // 16)
        live, new = np.arange(m), entries[:, :beam]
        while len(live):
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            row, col = np.nonzero((new >= 0) & ~seen[live[:, None], new])
            node = new[row, col]
            seen[live[row], node] = True
            # Nodes not met before, moved to the left; all others cost nothing from here on.
            many = np.bincount(row, minlength=len(live))
            col = np.arange(len(row)) - (np.cumsum(many) - many)[row]
            width = beam + int(many.max(initial=0))
            all_ids = np.full((len(live), width), -1, np.int64)
            all_sims = np.full((len(live), width), -2, np.float32)
            all_open = np.zeros((len(live), width), bool)
            all_ids[:, :beam], all_sims[:, :beam], all_open[:, :beam] = ids[live], sims[live], open_[live]
            all_ids[row, beam + col], all_open[row, beam + col] = node, True
            all_sims[row, beam + col] = np.einsum("nd,nd->n", queries[live[row]], self.vectors[node])
            if width > beam:
                best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                all_ids, all_sims, all_open = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))
            ranked = np.where(all_open, all_sims, -3)
            pick = np.argpartition(-ranked, turn - 1, axis=1)[:, :turn] if beam > turn else np.broadcast_to(np.arange(beam), (len(live), beam))
            wanted = np.take_along_axis(all_open, pick, 1)
            picked = np.where(wanted, np.take_along_axis(all_ids, pick, 1), -1)
            np.put_along_axis(all_open, pick, False, 1)
            ids[live], sims[live], open_[live] = all_ids, all_sims, all_open
            going = wanted.any(1)
            live, picked = live[going], picked[going]
            new = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(len(live), pick.shape[1] * links.shape[1])
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def near(self, queries: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """For every query, the nodes found at ``threshold`` or more; beams that end full are widened fourfold."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        if self.entry < 0:
            return out
        todo, beam = np.arange(len(queries)), min(beam, len(self.vectors))
        while len(todo):
            rest, block = [], max(8, min(512, (1 << 20) // (8 * beam)))
            for a in range(0, len(todo), block):
                own = todo[a : a + block]
                at = np.full((len(own), 1), self.entry)
                for layer in range(len(self.layers) - 1, 0, -1):
                    at, _ = self.search(queries[own], at, layer, 4)
                ids, sims = self.search(queries[own], at, 0, beam)
                for k, i in enumerate(own):
                    if sims[k, -1] >= threshold and beam < len(self.vectors):
                        rest.append(i)
                    else:
                        out[i] = ids[k][(sims[k] >= threshold) & (ids[k] >= 0)]
            todo, beam = np.array(rest, int), min(4 * beam, len(self.vectors))
        return out


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard (label, dim, shard, rep, copies, embedding) to its packed graph."""
    rows = rows.sort_values("rep")
    vectors = np.stack(rows["embedding"].to_list()).astype(np.float64)
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    vectors /= np.abs(vectors).max(1, keepdims=True)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = Graph(unit)
    packed = _pack(ids=rows["rep"].to_numpy(np.int64), copies=rows["copies"].to_numpy(np.int64), unit=unit, entry=np.array(graph.entry), **{f"layer{k}": x for k, x in enumerate(graph.layers)})
    return pd.DataFrame({"label": [rows["label"].iloc[0]], "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "graph": [packed]})


def _unpack(packed: bytes) -> tuple[dict, Graph]:
    data = dict(np.load(io.BytesIO(packed)))
    graph = Graph.__new__(Graph)
    graph.vectors, graph.entry = data["unit"].astype(np.float32), int(data["entry"])
    graph.layers = [data[f"layer{k}"] for k in range(sum(x.startswith("layer") for x in data))]
    return data, graph


def found_links(data: dict, graph: Graph, queries: np.ndarray, threshold: float, beam: int, recall: float, audits: int) -> list[np.ndarray]:
    """Nodes with a cosine of ``threshold`` or more, with beams wide enough for the audited recall."""
    sample = np.argsort(mix(np.arange(len(queries), dtype=np.uint64)))[:audits]
    exact = queries[sample] @ data["unit"].T >= threshold
    least = float(threshold - SLACK)
    small = queries.astype(np.float32)
    while True:
        audit = graph.near(small[sample], least, beam)
        hit = sum(exact[k, x].sum() for k, x in enumerate(audit))
        if hit >= recall * exact.sum() or beam >= len(data["unit"]):
            break
        beam *= 2
    return [x[(data["unit"][x] @ queries[i]) >= threshold] for i, x in enumerate(graph.near(small, least, beam))]


def _search(threshold: float, beam: int, recall: float, audits: int):
    """Task code: one pair of shards to link counts (b is null) and edges that unite what is linked."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b, out_n = [], [], []
        for packed, other, same in zip(rows["graph"], rows["queries"], rows["same"], strict=True):
            data, graph = _unpack(packed)
            mine = data if same else dict(np.load(io.BytesIO(other)))
            links = found_links(data, graph, mine["unit"], threshold, beam, recall, audits)
            if same:
                links = [x[x != i] for i, x in enumerate(links)]
            # A link found from either end counts at both within a shard.
            source = np.repeat(np.arange(len(links)), [len(x) for x in links])
            target = np.concatenate(links) if links else np.zeros(0, np.int64)
            if same:
                pairs = np.unique(np.concatenate([np.stack([source, target], 1), np.stack([target, source], 1)]), axis=0)
                source, target = pairs[:, 0], pairs[:, 1]
            counts = np.bincount(source, data["copies"][target], len(links)).astype(np.int64)
            have = np.flatnonzero(counts)
            out_a.append(mine["ids"][have])
            out_b.append(np.full(len(have), -1))
            out_n.append(counts[have])
            a, b = _forest(mine["ids"][source], data["ids"][target])
            out_a.append(a)
            out_b.append(b)
            out_n.append(np.full(len(a), -1))
        a, b, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_n))
        return pd.DataFrame({"a": a, "b": b, "n": n})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge (node, smallest node) for every node of the links but the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
                 shard_rows: int = 8192, beam: int = 32, recall: float = 0.999, audits: int = 256) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of one label with a cosine of ``threshold`` or more are linked.

    Equal vectors of a label are one node with a number of copies. A label is split into shards of
    about ``shard_rows`` nodes, so no task holds a whole label, and each shard's graph is searched
    for each shard's vectors. Counting every link of a label needs every shard, so work grows with
    the square of the shards of one label.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing; so do rows with a null id, whose component is null and which are kept. Vectors of
    different lengths are not compared. Every row counts as a vector, repeated ids too. Extra
    columns are ignored; an empty table gives an empty result.
    """
    v = F.col("v")
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    given = given.withColumn("v", F.when(good, F.transform(v, lambda x: x + F.lit(0.0)))).withColumn("dim", F.size("v"))
    usable = given.where("v is not null")
    nodes = usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    many = nodes.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = nodes.join(many, "label").select(
        "label", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"), "rep", "copies", F.col("v").alias("embedding"))
    kind = dict(rows.dtypes)[label]
    graphs = staged(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, f"label {kind}, dim int, shard int, graph binary"), "graphs")
    left = graphs.select("label", "dim", "shard", "graph")
    right = graphs.select("label", "dim", F.col("shard").alias("other"), F.col("graph").alias("queries"))
    same = F.col("shard") == F.col("other")
    pairs = left.join(right, ["label", "dim"]).select("label", "dim", "shard", "other", "graph", F.when(~same, F.col("queries")).alias("queries"), same.alias("same"))
    found = staged(pairs.groupBy("label", "dim", "shard", "other").applyInPandas(_search(threshold, beam, recall, audits), "a long, b long, n long"), "links")
    counts = found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = components(found.where("n < 0").select("a", "b")).withColumnRenamed("node", "rep")
    members = given.join(nodes, ["label", "v"], "left").select("id", "rep", "copies")
    joined = members.join(counts, "rep", "left").join(classes, "rep", "left")
    out = joined.select(
        F.col("id").alias(id_col), F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
