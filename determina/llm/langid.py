"""Language identification by a linear-chain conditional random field over words.

Each word has hashed features: prefixes and suffixes of two and three bytes, inner trigrams, the
word itself, and whether a learned lexicon claims it for a language. Transitions are learned from
sequences joined from several languages, so a text that switches is labelled word by word by
forward-backward. Words are chained in segments of at most 64; a text's language is the one with
the largest mean posterior over its words that may hold letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from determina.llm.shared import LOWER, SPACED, Hasher, chunks, crc_mod, mix, tokens

SEGMENT = 64
ROWS = 1 << 18
#: Bytes that letters can have.
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_lang: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, lexicon_lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the weights, word) of every feature."""
    n, long = len(starts), ends - starts
    every = np.arange(n)
    rows, owners = [hashes], [every]
    for size in (2, 3):
        fit = np.flatnonzero(long >= size)
        for kind, at in ((size, starts[fit]), (size + 10, ends[fit] - size)):
            code = np.zeros(len(fit), np.uint64)
            for k in range(size):
                code = code * np.uint64(256) + data[at + k]
            rows.append(mix(code * np.uint64(32) + np.uint64(kind)))
            owners.append(fit)
    inner = np.maximum(long - 2, 0)
    owner = np.repeat(every, inner)
    at = starts[owner] + np.arange(len(owner)) - (np.cumsum(inner) - inner)[owner]
    code = (data[at].astype(np.uint64) << np.uint64(16)) | (data[at + 1].astype(np.uint64) << np.uint64(8)) | data[at + 2] if len(at) else np.zeros(0, np.uint64)
    rows.append(mix(code * np.uint64(32) + np.uint64(20)))
    owners.append(owner)
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        claimed = np.flatnonzero(lexicon[place] == hashes)
        rows.append(mix(lexicon_lang[place[claimed]].astype(np.uint64) * np.uint64(32) + np.uint64(21)))
        owners.append(claimed)
    return (np.concatenate(rows) % np.uint64(ROWS)).astype(np.int64), np.concatenate(owners)


def scores(weights: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    picked = weights[rows]
    return np.stack([np.bincount(owner, picked[:, k], n) for k in range(weights.shape[1])], 1)


def posteriors(emission: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over (segments, words, languages): word posteriors and expected transitions."""
    s, t, n = emission.shape
    psi = np.exp(emission - emission.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        a = (alpha[:, k - 1] @ move) * psi[:, k]
        alpha[:, k] = a / a.sum(1, keepdims=True)
    for k in range(t - 2, -1, -1):
        b = (psi[:, k + 1] * beta[:, k + 1]) @ move.T
        beta[:, k] = np.where(valid[:, k + 1, None], b / b.sum(1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    return gamma, _pairs(alpha, psi * beta, valid, move)


def _pairs(alpha: np.ndarray, after: np.ndarray, valid: np.ndarray, move: np.ndarray) -> np.ndarray:
    both = alpha[:, :-1, :, None] * move * after[:, 1:, None, :]
    both /= both.sum((2, 3), keepdims=True)
    return (both * valid[:, 1:, None, None]).sum((0, 1))


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of every segment."""
    n = np.diff(first)
    many = -(-n // SEGMENT)
    owner = np.repeat(np.arange(len(n)), many)
    start = first[:-1][owner] + SEGMENT * (np.arange(len(owner)) - (np.cumsum(many) - many)[owner])
    return start, np.minimum(first[1:][owner] - start, SEGMENT)


def train(samples: list[tuple[str, str]], epochs: int = 6, batch: int = 128, rate: float = 0.3, seed: int = 1) -> Model | None:
    """Fit on (language, text segment) samples; None without samples.

    Sequences of 64 words take one to three stretches of words of drawn languages.
    """
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng, hasher = np.random.default_rng(seed), Hasher()
    pools: list[list[np.ndarray]] = [[] for _ in langs]
    words, starts_all, ends_all, hashes_all, base = [], [], [], [], 0
    count = 0
    for lang, text in sorted(samples):
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        starts, ends, _ = tokens(data, np.array([0, len(data)]), SPACED)
        words.append(data)
        starts_all.append(starts + base)
        ends_all.append(ends + base)
        hashes_all.append(hasher.load(data).spans(starts, ends))
        pools[langs.index(lang)].append(np.arange(count, count + len(starts)))
        base, count = base + len(data), count + len(starts)
    data, starts, ends, hashes = (np.concatenate(x) for x in (words, starts_all, ends_all, hashes_all))
    pool = [np.concatenate(p) for p in pools]
    lang_of = np.empty(count, np.int64)
    for k, p in enumerate(pool):
        lang_of[p] = k
    known, at = np.unique(hashes, return_inverse=True)
    by_lang = np.stack([np.bincount(at[p], minlength=len(known)) for p in pool], 1)
    clear = (by_lang.sum(1) >= 4) & (by_lang.max(1) >= 0.8 * by_lang.sum(1))
    lexicon, lexicon_lang = known[clear], by_lang[clear].argmax(1)
    n = len(langs)
    weights, transitions = np.zeros((ROWS, n), np.float32), np.zeros((n, n))
    seen, seen_move = np.full(ROWS, 1e-3), np.full((n, n), 1e-3)
    for _ in range(epochs * max(1, count // (batch * SEGMENT))):
        picks = np.empty((batch, SEGMENT), np.int64)
        for row in picks:
            cuts = np.sort(rng.integers(0, SEGMENT, rng.integers(0, 3)))
            for a, b in zip([0, *cuts], [*cuts, SEGMENT], strict=True):
                own = pool[rng.integers(n)]
                row[a:b] = own[(rng.integers(len(own)) + np.arange(b - a)) % len(own)]
        chosen, inverse = np.unique(picks, return_inverse=True)
        inverse = inverse.reshape(picks.shape)
        rows, owner = features(data, starts[chosen], ends[chosen], hashes[chosen], lexicon, lexicon_lang)
        emission = scores(weights, rows, owner, len(chosen))[inverse]
        valid = np.ones(picks.shape, bool)
        gamma, expected = posteriors(emission, valid, transitions)
        truth = lang_of[picks]
        diff = -gamma
        diff[np.arange(batch)[:, None], np.arange(SEGMENT), truth] += 1
        word = np.stack([np.bincount(inverse.ravel(), diff[:, :, k].ravel(), len(chosen)) for k in range(n)], 1)
        grad = scores(word, owner, rows, ROWS)
        touched = np.flatnonzero(np.abs(grad).sum(1))
        step = grad[touched] / SEGMENT
        seen[touched] += (step**2).sum(1)
        weights[touched] += (rate * step / np.sqrt(seen[touched])[:, None]).astype(np.float32)
        moved = (np.bincount((truth[:, :-1] * n + truth[:, 1:]).ravel(), minlength=n * n).reshape(n, n) - expected) / (batch * SEGMENT)
        seen_move += moved**2
        transitions += rate * moved / np.sqrt(seen_move)
    return Model(langs, weights, transitions, lexicon, lexicon_lang)


def _sample_batches():
    """Task code: (id, text, lang, rate) to (lang, text) of the segments that the id and number choose."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                starts, ends, first = tokens(data, offsets, SPACED)
                begin, size = segments(first)
                if not len(begin):
                    continue
                doc = np.searchsorted(first, begin, "right") - 1
                seeds = batch.column("seed").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                rates = batch.column("rate").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                drawn = mix(seeds[doc] + np.arange(len(doc), dtype=np.uint64) - np.searchsorted(doc, doc).astype(np.uint64)) / 2.0**64
                keep = np.flatnonzero(drawn < rates[doc])
                langs = batch.column("lang")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[lo + int(doc[k])].as_py() for k in keep], pa.string()),
                     pa.array([data[starts[begin[k]] : ends[begin[k] + size[k] - 1]].tobytes().decode() for k in keep], pa.string())],
                    ["lang", "text"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", seed_col: str = "doc_id", bytes_per_language: int = 400_000) -> Model | None:
    """A model of the labelled rows of ``docs``, from a sample of segments of about ``bytes_per_language``.

    The sample is drawn by hash from all segments of all labelled rows, at a rate set by the
    language's total bytes, so its size has a bound and no text is favoured by its place.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(seed_col)).alias("seed")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n or 0 for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return None
    rates = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, bytes_per_language / max(n, 1)))))
    drawn = rows.withColumn("rate", F.element_at(rates, F.col("lang"))).mapInArrow(_sample_batches(), "lang string, text string")
    return train([(r.lang, r.text) for r in drawn.collect()])


def _label_batches(shared, spans: bool):
    """Task code: (row, text, letters) to (row, lang_pred, score, words, sure)."""

    def run(batches):
        model: Model | None = shared.value
        hasher = Hasher()
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text")):
                letters = np.array(batch.column("letters").slice(lo, hi - lo).to_pylist(), bool)
                data = LOWER[raw]
                starts, ends, first = tokens(data, offsets, SPACED)
                pred, score, sure = np.full(hi - lo, -1), np.zeros(hi - lo), np.zeros(hi - lo)
                words: list[list[dict]] = [[] for _ in range(hi - lo)]
                if model is not None and len(starts):
                    hashes = hasher.load(data).spans(starts, ends)
                    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                    rows, owner = features(data, starts[at], ends[at], hashes[at], model.lexicon, model.lexicon_lang)
                    emission = scores(model.weights, rows, owner, len(at))
                    begin, size = segments(first)
                    place = np.minimum(begin[:, None] + np.arange(SEGMENT), len(starts) - 1)
                    valid = np.arange(SEGMENT) < size[:, None]
                    gamma, _ = posteriors(np.where(valid[:, :, None], emission[inverse[place]], 0.0), valid, model.transitions)
                    gamma = gamma[valid]
                    lettered = np.add.reduceat(LETTER[data], starts) > 0
                    doc = np.repeat(np.arange(hi - lo), np.diff(first))
                    weight = np.where(lettered, 1.0, 1e-6)
                    total = np.bincount(doc, weight, hi - lo)
                    mean = np.stack([np.bincount(doc, weight * gamma[:, k], hi - lo) for k in range(len(model.langs))], 1) / np.maximum(total, 1e-300)[:, None]
                    good = letters & (total > 0)
                    pred[good] = mean[good].argmax(1)
                    score[good] = np.clip(mean[good].max(1), 0, 1)
                    sure[good] = np.clip(np.bincount(doc, weight * gamma.max(1), hi - lo)[good] / total[good], 0, 1)
                    if spans:
                        best = gamma.argmax(1)
                        cut = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]), [True])))
                        for a, b in zip(cut[:-1], cut[1:], strict=True):
                            words[doc[a]].append({"start": int(starts[a] - offsets[doc[a]]), "end": int(ends[b - 1] - offsets[doc[a]]), "lang": model.langs[best[a]], "n_words": int(b - a)})
                names = [model.langs[k] if k >= 0 else "und" for k in pred]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score),
                     pa.array(words, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64())]))), pa.array(sure)],
                    ["row", "lang_pred", "score", "words", "sure"])

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text", spans: bool = False) -> DataFrame:
    """(row, lang_pred, score, words, sure) of every row; ``row`` holds all columns of ``docs``.

    ``score`` is the largest mean posterior, near the share of the most common language; ``sure`` the
    mean of each word's largest posterior, whatever languages the words are in. ``words`` (with
    ``spans``) are the runs of words of one language, as byte ranges. Only the text
    is looked at. A null text, one without a letter, or no model gives ``und`` with score 0.
    Repeated rows get the same answer; an empty table is empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    added = StructType.fromDDL("lang_pred string, score double, words array<struct<start:long,end:long,lang:string,n_words:long>>, sure double")
    return rows.mapInArrow(_label_batches(shared, spans), StructType(rows.schema.fields[:1] + added.fields))


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 4) == 2


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is unknown or whose words are labelled less surely than ``least``.

    A text that switches languages stays if its words are labelled surely, each in its own. The model learns from the rows that are not held out. Where no row is labelled nothing is known
    and nothing is rejected.
    """
    model = fit(docs.where(~held_out(id_col)), text, lang, id_col)
    if model is None:
        return docs
    named = identify(docs, model, text).where((F.col("lang_pred") != "und") & (F.col("sure") >= least))
    return named.select(*(F.col("row")[c].alias(c) for c in docs.columns))
