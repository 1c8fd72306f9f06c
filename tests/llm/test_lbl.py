import math
import zlib
from collections import Counter

import numpy as np
from conftest import SF_DIR
from llm.brute_texts import words

from determina.llm import lbl


def base_scores(rows: list[tuple]) -> dict:
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows}
    bags = [(k, [*words(t), None]) for k, t in rows]
    count = Counter(w for k, bag in bags if not held[k] for w in bag)
    n, v = sum(count.values()), len(count)
    return {k: (len(bag), sum(count[w] > 0 for w in bag), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in bag)) for k, bag in bags}


def check(spark, rows):
    got = lbl.score_texts(spark.createDataFrame(rows, "doc_id long, text string, c int")).collect()
    want = base_scores([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, total) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-12)
        assert r.score < 0 or n_tokens == 1
    return got


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = check(spark, [(d.doc_id, d.text, 1) for d in docs])
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    """Over all outputs, and within another word over all known and one new word."""
    rng = np.random.default_rng(0)
    share = np.full(9, 1 / 9)
    p = lbl.start(share)
    p = {k: v + rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in p.items()}
    context = np.repeat(rng.integers(0, 10, (5, lbl.CONTEXT)), 9, axis=0)
    each = np.exp(lbl.log_probabilities(p, np.tile(np.arange(9), 5), context)).reshape(5, 9)
    assert np.allclose(each.sum(1), 1, atol=1e-5)


def test_training_learns_what_follows():
    rng = np.random.default_rng(1)
    seq = np.tile([0, 1, 2, 3], 4000)
    context = np.stack([np.roll(seq, k) for k in (1, 2, 3)], 1)
    share = np.full(6, 1 / 6)
    p, log_noise = lbl.start(share), np.log(share * lbl.NOISE).astype(np.float32)
    grown = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    for _ in range(150):
        at = rng.integers(0, len(seq), 512)
        lbl.train_step(p, grown, seq[at], context[at], rng.choice(6, lbl.NOISE), log_noise)
    assert np.exp(lbl.log_probabilities(p, seq[:100], context[:100])).mean() > 0.9


def test_edge_cases(spark):
    check(spark, [(1, None, 1), (2, "", 1), (3, "a A a", 1), (3, "a A a", 1), (None, "b " * 50_000, 1), (5, "\x1c x", 1), (14, "new words", 1)])
    assert lbl.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    check(spark, [(only[0], "all held out", 1), (only[1], None, 1)])


def test_score_is_the_sum_of_its_tokens(spark, monkeypatch):
    """Whole texts, token by token over the trained parameters; each round trains its half of the tokens."""
    from determina.llm.shared import Hasher

    given, real, trained, step = [], lbl._score_groups, [], lbl._averaged
    monkeypatch.setattr(lbl, "OUTPUTS", 6)
    monkeypatch.setattr(lbl, "_score_groups", lambda shared: given.append(shared.value) or real(shared))
    monkeypatch.setattr(lbl, "_averaged", lambda rows, p: trained.append(rows.agg({"weight": "sum"}).first()[0]) or step(rows, p))
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.geometric(0.2, int(rng.integers(0, 40))))) for k in range(60)]
    got = lbl.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    kinds, p, total, _, rest, _ = given[0]
    assert sum(trained) == total and abs(trained[0] - trained[1]) <= 1
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    count = Counter(w for k, t in rows if k not in held for w in words(t))
    number = dict(zip(kinds.words.tolist(), kinds.number.tolist(), strict=True))
    for r in got:
        text, past, want = words(dict(rows)[r.doc_id]), [kinds.begin] * lbl.CONTEXT, 0.0
        for w in [*text, None]:
            data = np.frombuffer((w or "").encode(), np.uint8)
            key = None if w is None else int(Hasher().load(data).spans(np.array([0]), np.array([len(data)]))[0])
            t = kinds.end if w is None else number.get(key, kinds.other)
            guess = sum(p["seen"][past[k]].astype(float) * p["place"][k] for k in range(lbl.CONTEXT))
            scores = p["out"].astype(float) @ guess + p["bias"]
            want += (scores[t] - np.log(np.exp(scores).sum())) / math.log(10)
            if t == kinds.other:
                want += math.log10((count[w] + 1) / (rest + 1))
            past = [t, *past[:-1]]
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-4)
