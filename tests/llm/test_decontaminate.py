import random

from llm.brute_texts import hits

from determina.llm import decontaminate


def test_against_all_windows(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = {str(k): " ".join(rng.choice(vocab) for _ in range(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 14, 20])}
    items |= {"10": None, "11": " ?! ", "12": items["5"]}
    docs = [(i, " ".join(rng.choice(vocab + ["x", "y"]) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(60 + i, "x " + items[str(i)] + " Y") for i in range(10)]
    table = spark.createDataFrame([(int(k), t) for k, t in items.items()], "item_id long, text string")
    for window in (3, 5):
        want = {d: hits(t, items, window) for d, t in docs}
        for shard in (1 << 20, 40):
            got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), table, window=window, shard_bytes=shard).collect()
            assert {r.row.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want


def test_cuts_and_drops(spark):
    passage = " ".join(f"Word{i}" for i in range(12))
    clean = "Quiet text, “with” signs & 1 number."
    rows = [(1, clean, 0), (2, f"{clean} {passage}. {clean} {clean} {clean}", 0), (3, passage, 0), (4, None, 0), (5, "", 0), (None, clean * 2000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(1, passage.upper()), (None, passage)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_hit) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (clean, 0), 2: (f"{clean} . {clean} {clean} {clean}", 0), 4: (None, 0), 5: ("", 0), None: (clean * 2000, 0)}
    found = {r.row.doc_id: r["items"] for r in decontaminate.contamination(docs, items).collect()}
    assert found[2] == ["", "1"] and found[1] == []


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(one, items).collect()] == [(2, 0)]
