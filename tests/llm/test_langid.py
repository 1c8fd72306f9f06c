from conftest import SF_DIR
from pyspark.sql import functions as F

from determina.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.identify(docs, model).select("row.doc_id", "row.lang", "lang_pred", "score").where(langid.held_out())
    right, n, low, high = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 30 and right > 0.97 and 0 <= low <= high <= 1


def test_switching_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs)
    part = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("n_chars > 600").dropDuplicates(["lang"]).collect()}
    mixed = part["en"] + " " + part["de"]
    (r,) = langid.identify(spark.createDataFrame([(mixed,)], "text string"), model, spans=True).collect()
    by_lang = {k: sum(w.n_words for w in r.words if w.lang == k) for k in ("en", "de")}
    assert min(by_lang.values()) >= 30 and len(r.words) <= 6
    assert r.words[0].start == 0 and r.words[-1].end == len(mixed.encode())


def test_gradient_is_that_of_the_likelihood():
    """Posteriors from forward-backward equal those summed over all label sequences."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    emission, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gamma, pairs = langid.posteriors(emission, np.ones((1, 4), bool), move)
    want, want_pairs, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=4):
        p = np.exp(sum(emission[0, t, y[t]] for t in range(4)) + sum(move[y[t], y[t + 1]] for t in range(3)))
        total += p
        for t in range(4):
            want[t, y[t]] += p
        for t in range(3):
            want_pairs[y[t], y[t + 1]] += p
    assert np.allclose(gamma[0], want / total) and np.allclose(pairs, want_pairs / total)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 30, "en", 1), (2, "der hund und die katze " * 30, "de", 1), (3, "x", None, 1), (4, None, "fr", 1)], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 34 -- …"), (4, "the dog " * 20_000), (4, "the dog"), (None, "und die katze"), (5, "é")]
    got = [(r.row.doc_id, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, got[6][1])] and got[6][1] in model.langs
    assert [g[2] for g in got[:3]] == [0, 0, 0]
    empty = docs.limit(0)
    assert langid.fit(empty) is None and langid.identify(empty, model).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.keep_known(docs.where("lang is null")).count() == 1
