import numpy as np
import itertools
import random

import pytest
from conftest import SF_DIR

from determina.llm import pieces as P


@pytest.fixture(scope="module")
def table():
    return P.load_pieces()


def best_paths(word: str, table: P.Pieces) -> set[tuple]:
    """All paths of the largest score, by trying every way to cut the word."""
    by_text = {t: k for k, (t, s) in enumerate(zip(table.text, table.score, strict=True)) if s is not None}
    found, top = set(), -1e18
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if any(x not in by_text and len(x) > 1 for x in parts):
            continue
        score = sum(table.score[by_text[x]] if x in by_text else -P.UNKNOWN * len(x.encode()) for x in parts)
        ids = tuple(i for x in parts for i in ([by_text[x]] if x in by_text else [table.first_byte + b for b in x.encode()]))
        if score > top + 1e-9:
            found, top = {ids}, score
        elif abs(score - top) <= 1e-9:
            found.add(ids)
    return found


def test_viterbi_against_all_paths(spark, table):
    rng = random.Random(8)
    words = ["▁", "a", "▁the", "▁▁▁", "☃", "▁a☃b", "\n", "ё́"] + ["▁" + "".join(rng.choice("abeinorst☃") for _ in range(rng.randrange(1, 11))) for _ in range(60)]
    df = spark.createDataFrame([(i, w.replace("▁", " ").encode()) for i, w in enumerate(words)], "word long, spelled binary")
    got = {r.word: tuple(r.ids) for r in P.encode_words(df, table).collect()}
    for i, w in enumerate(words):
        assert got[i] in best_paths(w, table), w


def plain_score(word: str, table: P.Pieces) -> float:
    """The largest sum of scores, place by place."""
    by_text = {t: s for t, s in zip(table.text, table.score, strict=True) if s is not None}
    best, longest = [0.0], table.longest
    for b in range(1, len(word) + 1):
        ways = [best[a] + by_text[word[a:b]] for a in range(max(0, b - longest), b) if word[a:b] in by_text]
        best.append(max(ways) if word[b - 1] in by_text else max([*ways, best[b - 1] - P.UNKNOWN * len(word[b - 1].encode())]))
    return best[-1]


def test_long_words_against_a_plain_dynamic_program(spark, table):
    rng = random.Random(9)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    url = "".join(rng.choice(["https://", "example", "the", "international", ".com/", "static", "\t", "é", "語"]) for _ in range(300))
    words = [draw("abeinorst", 1000), draw("的一是不了在人有我他这☃", 700), url, "x" * 513, draw("ABCDEFabcdef0123456789+/", 20_000), "i" * 255 + "nternational", "a" * 256, "▁" * 600]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    by_id = {k: (t, s) for k, (t, s) in enumerate(zip(table.text, table.score, strict=True)) if s is not None}
    for r in P.encode(docs, table).collect():
        word = P.SPACE + words[r.doc_id]
        score = sum(by_id[k][1] if k in by_id else -P.UNKNOWN for k in r.ids)
        assert r.decoded == words[r.doc_id].replace(P.SPACE, " ")
        # Spaces of a text and a literal piece mark are the same place in the lattice, but other words.
        if P.SPACE not in words[r.doc_id]:
            assert abs(score - plain_score(word, table)) < 1e-6, r.doc_id
    spaces = spark.createDataFrame([(0, b" " * 600)], "word long, spelled binary")
    (r,) = P.encode_words(spaces, table).collect()
    assert abs(sum(by_id[k][1] for k in r.ids) - plain_score(P.SPACE * 600, table)) < 1e-6


def test_round_trip_of_documents(spark, table):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    coded = P.encode(docs, table)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = coded.collect()
    assert {r.doc_id: r.decoded for r in got} == text
    again = {r.row.doc_id: r.decoded for r in P.decode(coded.drop("decoded"), table).collect()}
    assert again == text


def test_many_slices_give_the_same_ids(spark, table, monkeypatch):
    """Runs of a few words, several slices in a task, words and runs of a slice in several batches."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "y" * 65 + " " + "z" * 200 + " y"), (-2, None), (-3, "y" * 64)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    one = {r.doc_id: (r.ids, r.decoded) for r in P.encode(docs, table).collect()}
    monkeypatch.setattr(P, "WORDS_IN_SLICE", 300)
    monkeypatch.setattr(P, "SLICES_IN_TASK", 16)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        many = {r.doc_id: (r.ids, r.decoded) for r in P.encode(docs, table).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert many == one


def test_edge_cases(spark, table):
    odd = [(1, None), (2, ""), (3, " "), (4, "  a  b \n\n c\t"), (5, "x" * 5000 + "é" * 700), (6, "▁ already"), (7, "\x00\x01"), (None, "☃"), (8, "a"), (8, "a"), (9, "e\u0301 <0x0A> <s>")]
    got = P.encode(spark.createDataFrame([(k, t, "z", 1) for k, t in odd], "doc_id long, text string, ids string, block int"), table).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((k or 0, (t or "").replace("▁", " ")) for k, t in odd)
    assert all((len(r.ids) == 0) == (not r.decoded) for r in got)
    assert P.encode(spark.createDataFrame([], "doc_id long, text string"), table).collect() == []


def test_words_with_one_hash_stay_apart():
    """Words of a block whose hashes are equal, in one chunk or in two, keep their spelling."""
    from determina.llm.blocks import _told_apart

    words: dict = {}
    for text in ("aa bb aa c bb top aa", "dd aa bb c dd", "c"):
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.array([i for i in range(len(text)) if text[i] != " " and (i == 0 or text[i - 1] == " ")])
        ends = np.array([i + 1 for i in range(len(text)) if text[i] != " " and (i + 1 == len(text) or text[i + 1] == " ")])
        for hashes in (np.full(len(starts), 7, np.uint64), (ends - starts).astype(np.uint64), np.full(len(starts), (1 << 64) - 1, np.uint64)):
            keys = _told_apart(hashes, data, starts, ends, words)
            assert [words[k] for k in keys.tolist()] == text.encode().split()


def test_nothing_is_exchanged_or_written_between(spark, table):
    """Texts and words stay in the task that read them; the result alone takes disk."""
    import glob

    from determina.llm.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file:") + "/llm-*"
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = set(glob.glob(folder))
    coded = P.encode(docs, table)
    coded.collect()
    assert set(glob.glob(folder)) == before
    assert "hashpartitioning" not in coded._jdf.queryExecution().executedPlan().toString()


def test_words_forgotten_and_edges_in_small_parts(spark, table, monkeypatch):
    """A task that soon forgets its words, and folds a word or two at a time, gives the same ids."""
    rows = [(1, "aa bb aa"), (2, None), (3, "cc aa"), (4, ""), (5, "x" * 300 + " ☃ bb"), (6, "bb aa\n☃")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one = sorted((r.doc_id, r.ids, r.decoded) for r in P.encode(docs, table).collect())
    for name, value in (("WORDS_IN_SLICE", 1), ("SLICES_IN_TASK", 2), ("EDGES", 5)):
        monkeypatch.setattr(P, name, value)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        many = sorted((r.doc_id, r.ids, r.decoded) for r in P.encode(docs, table).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert many == one
    assert all(decoded == (text or "") for (_, text), (_, _, decoded) in zip(sorted(rows, key=lambda r: r[0]), many))
