"""Scores of texts by a log-bilinear model trained with noise-contrastive estimation.

The model's outputs are the most frequent training words, the end of a text, and "another word"; a
context is the three outputs before. The prediction is a sum of context vectors, each weighted by
its place, and its product with an output's vector, plus a bias, is that output's score. Training
tells true words from words drawn by frequency, over all training texts, in tasks whose parameters
are averaged. Scores are normalised by a softmax over all outputs in batched matrix products.
Another word has its add-one frequency among all other training words, one share left for new ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from determina.llm.blocks import blocks_of, unpack
from determina.llm.shared import LOWER, SPACED, crc_mod, staged, tokens

OUTPUTS, SIZE, CONTEXT = 500, 16, 3
#: Training: tokens in a step, noise words in a step, step size, rounds of averaging.
STEP, NOISE, RATE, ROUNDS = 8192, 32, 0.1, 2


def split_words(raw: np.ndarray, offsets: np.ndarray):
    data = LOWER[raw]
    return data, *tokens(data, offsets, SPACED)


class Outputs:
    """Numbers of outputs: frequent words by descending count, then another word, end, and begin."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, other: int, ends: int) -> None:
        order = np.argsort(words)
        self.words, self.number = words[order], order
        self.other, self.end, self.begin = len(words), len(words) + 1, len(words) + 2
        share = np.concatenate([counts, [other, ends]]).astype(float) + 1
        self.share = share / share.sum()

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.other)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.number[at], self.other)


def stream(outputs: np.ndarray, sizes: np.ndarray, kinds: Outputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with an end after every text, the contexts before them, and the text of each."""
    length = sizes + 1
    last = np.cumsum(length) - 1
    target = np.full(int(length.sum()), kinds.end)
    word = np.ones(len(target), bool)
    word[last] = False
    target[word] = outputs
    doc = np.repeat(np.arange(len(sizes)), length)
    place = np.arange(len(target)) - (last - sizes)[doc]
    context = np.full((len(target), CONTEXT), kinds.begin)
    for k in range(1, CONTEXT + 1):
        there = np.flatnonzero(place >= k)
        context[there, k - 1] = target[there - k]
    return target, context, doc


def start(share: np.ndarray) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(3), len(share)
    return {
        "seen": rng.normal(0, 0.1, (n + 1, SIZE)).astype(np.float32), "place": np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32),
        "out": rng.normal(0, 0.1, (n, SIZE)).astype(np.float32), "bias": np.log(share).astype(np.float32),
    }


def sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each number below ``n``."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def train_step(p: dict, grown: dict, target: np.ndarray, context: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One step on true targets against ``noise`` words; ``log_noise`` is log(k * share) of all outputs."""
    n, bias = len(p["bias"]), p["bias"] - log_noise
    seen = [p["seen"][context[:, k]] for k in range(CONTEXT)]
    guess = sum(v * w for v, w in zip(seen, p["place"], strict=True))
    out_true, out_noise = p["out"][target], p["out"][noise]
    up = 1 / (1 + np.exp(np.clip(np.einsum("bd,bd->b", guess, out_true) + bias[target], -30, 30)))
    down = guess @ out_noise.T + bias[noise]
    np.clip(down, -30, 30, out=down)
    down = -1 / (1 + np.exp(-down))
    d_guess = up[:, None] * out_true + down @ out_noise
    both = sum_rows(target, np.concatenate([up[:, None] * guess, up[:, None]], 1), n)
    grad = {"out": both[:, :-1].copy(), "bias": both[:, -1].copy(), "seen": np.zeros_like(p["seen"]), "place": np.zeros_like(p["place"])}
    np.add.at(grad["out"], noise, down.T @ guess)
    np.add.at(grad["bias"], noise, down.sum(0))
    for k in range(CONTEXT):
        grad["seen"] += sum_rows(context[:, k], d_guess * p["place"][k], n + 1)
        grad["place"][k] = np.einsum("bd,bd->d", d_guess, seen[k])
    for k, g in grad.items():
        g /= len(target)
        grown[k] += g * g
        p[k] += RATE * g / np.sqrt(grown[k])


def log_probabilities(p: dict, target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Normalised natural log probability of every target; equal contexts are computed once."""
    n = len(p["bias"]) + 1
    code = np.zeros(len(target), np.int64)
    for k in range(CONTEXT):
        code = code * n + context[:, k]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    guess = np.einsum("bcd,cd->bd", p["seen"][context[first]], p["place"])
    total = np.empty(len(first), np.float32)
    for a in range(0, len(first), 4096):
        score = guess[a : a + 4096] @ p["out"].T + p["bias"]
        top = score.max(1, keepdims=True)
        np.exp(np.subtract(score, top, out=score), out=score)
        total[a : a + 4096] = np.log(score.sum(1)) + top[:, 0]
    own = np.einsum("bd,bd->b", guess[group], p["out"][target]) + p["bias"][target]
    return own.astype(float) - total[group]


def _train_batches(shared, turn: int):
    """Task code: blocks to one row (parameters, tokens) of the task; each round has its own share of every block's tokens."""

    def run(batches):
        kinds, p = shared.value
        grown = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        log_noise = (np.log(kinds.share) + np.log(NOISE)).astype(np.float32)
        used = 0
        for batch in batches:
            for i in range(len(batch)):
                number = batch.column("block")[i].as_py()
                rng = np.random.default_rng(number)
                codes, words = unpack(batch.column("codes")[i].as_py()), batch.column("words")[i].values.to_numpy().view(np.uint64)
                sizes = batch.column("sizes")[i].values.to_numpy().astype(np.int64)
                target, context, doc = stream(kinds.of(words)[codes], sizes, kinds)
                own = np.flatnonzero(np.array(batch.column("train")[i].as_py(), bool)[doc])
                rng.shuffle(own)
                own = own[turn::ROUNDS]
                for a in range(0, len(own), STEP):
                    at = own[a : a + STEP]
                    train_step(p, grown, target[at], context[at], rng.choice(len(kinds.share), NOISE, p=kinds.share), log_noise)
                used += len(own)
        if used:
            flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64())), pa.array([float(used)])], ["values", "weight"])

    return run


def _averaged(rows: DataFrame, p: dict) -> dict:
    """Parameters of the tasks, weighted by their tokens; averaged by place, so tasks can be many."""
    places = rows.select(F.posexplode("values").alias("at", "value"), "weight")
    mean = places.groupBy("at").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    flat = {r.at: r["mean"] for r in mean.collect()}
    if not flat:
        return p
    values, out, at = np.array([flat[k] for k in range(len(flat))], np.float32), {}, 0
    for k in sorted(p):
        out[k] = values[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return out


def _score_groups(shared):
    """Task code: the counts (idx, c) of a block's words and the block to scores of its texts."""

    def run(known: pa.Table, block: pa.Table) -> pa.Table:
        kinds, p, total, distinct, rest, ends = shared.value
        out = []
        for i in range(block.num_rows):
            words = block.column("words")[i].values.to_numpy().view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            counts[known.column("idx").to_numpy()] = known.column("c").to_numpy()
            codes, sizes = unpack(block.column("codes")[i].as_py()), block.column("sizes")[i].values.to_numpy().astype(np.int64)
            output = kinds.of(words)
            target, context, doc = stream(output[codes], sizes, kinds)
            count = np.full(len(target), ends, np.int64)
            is_word = np.ones(len(target), bool)
            is_word[np.cumsum(sizes + 1) - 1] = False
            count[is_word] = counts[codes]
            base = np.log10((count + 1) / (total + 1 * (distinct + 1)))
            score = log_probabilities(p, target, context) / np.log(10)
            other = target == kinds.other
            score[other] += np.log10((count[other] + 1) / (rest + 1))
            n = len(sizes)
            out.append(pa.table({
                "id": block.column("ids")[i].values, "n_tokens": sizes + 1, "n_known": np.bincount(doc, count > 0, n).astype(np.int64),
                "train_tokens": np.full(n, total, np.int64), "base_score": np.bincount(doc, base, n), "score": np.bincount(doc, score, n)}))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train=None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Counts, totals and training take all rows where ``train`` holds. A null or empty text is one end
    token. Without training rows nothing is known and scores are those of an untrained model. Rows
    that share an id, or have none, are scored each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    train = crc_mod(id_col, 7) != 2 if train is None else train
    blocks = blocks_of(docs, id_col, text, train, split_words)
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where("x.counts > 0")
    counts = staged(each.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")), "counts")
    tokens_seen, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()[0]
    top = counts.orderBy(F.desc("c"), "word").limit(OUTPUTS).collect()
    frequent = sum(r.c for r in top)
    rest = tokens_seen - frequent + distinct - len(top)
    kinds = Outputs(np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.int64), tokens_seen - frequent, ends)
    p = start(kinds.share)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((kinds, p))
        p = _averaged(staged(blocks.mapInArrow(_train_batches(shared, turn), "values array<double>, weight double"), "parameters"), p)
    shared = spark.sparkContext.broadcast((kinds, p, tokens_seen + ends, distinct + (ends > 0), rest, ends))
    places = blocks.select(F.col("block").alias("home"), F.posexplode("words").alias("idx", "word"))
    known = places.join(counts, "word").select("home", "idx", "c")
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = known.groupBy("home").cogroup(blocks.select("block", "ids", "sizes", "codes", "words").groupBy("block")).applyInArrow(
        _score_groups(shared), f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
