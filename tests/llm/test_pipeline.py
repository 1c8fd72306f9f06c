"""The stages of the pipeline on planted documents."""

import random

import corpus_pipeline as pipeline
import pytest
from conftest import SF_DIR
from llm.brute_texts import classes, hits, shingles


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    items = [(1, "An item of the benchmark with just about thirteen words in it to find"), (2, "Short one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    rng = random.Random(4)
    real = [r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect() if 300 < r.n_chars < 4000][:40]
    vocabulary = {k: sorted({w for r in real if r.lang == k for w in r.text.lower().split() if w.isalpha()}) for k in {r.lang for r in real}}
    prose = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    langs = sorted(vocabulary)
    rows = [(i, prose(langs[i % len(langs)], 80), langs[i % len(langs)], "s", 0) for i in range(40)]
    passage = prose("en", 60)
    words = rows[1][1].split()
    words[40] = "changed"
    rows += [
        (100, rows[0][1], "en", "s", 0), (101, " ".join(words), rows[1][2], "s", 0), (102, prose("en", 40) + " " + passage, "en", "s", 0), (103, passage + " " + prose("en", 50), "en", "s", 0),
        (104, f"{prose('en', 40)} {items[0][1]} {prose('en', 40)}", "en", "s", 0), (105, items[0][1], "en", "s", 0), (106, "12 34 ...", "en", "s", 0), (107, None, None, None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return str(root)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = {"documents": docs}
    for name, stage in pipeline.STAGES:
        at[name] = docs = pipeline.staged(stage(spark, docs, sf_dir), name)
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {k: {r.doc_id: r.text for r in v.collect()} for k, v in at.items()}
    assert set(text["documents"]) - set(text["language"]) == {106, 107}
    sets = {d: shingles(t) for d, t in text["language"].items()}
    one = classes(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert set(text["minhash"]) == set(one.values()) and {100, 101} & set(text["minhash"]) == set()
    raw = text["minhash"]
    passage = text["documents"][103].split(" ")[:60]
    assert " ".join(passage[5:55]) not in text["repeats"][102] + text["repeats"][103]
    assert all(text["repeats"][k] == raw[k] for k in raw if k not in (102, 103))
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for k, t in text["repeats"].items():
        if hits(t, items, 10)[1] == 0:
            assert text["benchmark"][k] == t
    assert 105 not in text["benchmark"] and all(hits(t, items, 10)[1] == 0 for t in text["benchmark"].values())
    assert text["pieces"] == text["benchmark"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_of_repeated_ids(spark):
    """No text goes that has no near-duplicate left, whatever ids rows share."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (5, text(0)), (5, text(1)), (6, text(2)), (6, text(2)), (7, text(3)), (8, text(3)), (None, text(4)), (None, text(4)), (9, None), (9, "")]
    table = spark.createDataFrame([(*r, "en", "s", 0, k) for k, r in enumerate(rows)], DOCS + ", key int")
    kept = pipeline.near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text)
    assert got == sorted([(0, text(4)), (0, text(4)), (1, text(1)), (5, text(0)), (6, text(2)), (7, text(3))])
    assert {r.text for r in kept.where("doc_id = 9").collect()} == {None, ""}


def test_pieces_stage_keeps_marks_and_columns(spark):
    rows = [(1, "a \u2581b", "en", "s", 4, [7]), (2, "plain text", "en", "s", 10, None), (2, None, None, None, None, [1]), (None, "", "en", "s", 0, [])]
    table = spark.createDataFrame(rows, DOCS + ", ids array<int>")
    out = pipeline.piece_ids(spark, table, "")
    assert out.columns == [*table.columns, "ids_"]
    assert sorted((r.text, r.ids or [0], len(r.ids_) > 0) for r in out.collect()) == [("", [0], False), ("", [1], False), ("a \u2581b", [7], True), ("plain text", [0], True)]


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], DOCS + ", key int, ids int")
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.collect() == [] and out.columns[:7] == none.columns, name


def test_language_stage_keeps_documents_that_switch(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    part = {r.lang: r.text.split() for r in docs.where("n_chars > 900").dropDuplicates(["lang"]).collect()}
    mixed = lambda **n: " ".join(w for k, m in n.items() for w in part[k][:m])
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 10))) for _ in range(80))
    planted = [
        (-1, mixed(en=40, de=40)), (-2, mixed(en=24, de=21, fr=15)), (-3, mixed(de=25, en=25, es=25, fr=25)),
        (-4, noise), (-5, "Быстрая коричневая лиса прыгает через ленивую собаку " * 8), (-6, "12 34 ..."),
    ]
    added = spark.createDataFrame([(k, t, None, "s", 0) for k, t in planted], docs.schema)
    kept = pipeline.known_language(spark, docs.unionByName(added), SF_DIR)
    assert {r.doc_id for r in kept.where("doc_id < 0").select("doc_id").collect()} == {-1, -2, -3}


def test_run_on_whole_tables(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "minhash", "repeats", "benchmark", "pieces"]
    out = pipeline.run(spark, SF_DIR)
    assert 0 < out.count() <= spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert out.where("text is null or size(ids) = 0").count() == 0
