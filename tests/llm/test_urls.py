from determina.llm import urls


def test_rules_and_hosts(spark):
    rows = [
        ("http://a.example.com/en/x?q", "block"), ("https://www.EXAMPLE.com/en/x#y", "allow"), ("http://x.www.example.com/en/", "allow"), ("http://notexample.com/en/", "allow"),
        ("http://q.net/es/1", "block"), ("http://net/fr/", "block"), ("http://q.net/de/1", "allow"), ("http://m.spam-farm.example.com?x", "block"), ("http://spam-farm.example.com/en", "allow"),
        ("no scheme", "allow"), (None, "allow"), ("", "allow"), ("http://", "allow"), ("a://b://c", "allow"), ("http://adult-x.example.net/de/", "block"), ("http://xadult-x.example.net/de/", "allow"), ("x://" + "a." * 3000 + "net/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, (u, _) in enumerate(rows)], "page_id long, url string, rule string")
    got = {r.row.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].verdict for i in range(len(rows))] == [v for _, v in rows]
    assert (got[0].host, got[0].path, got[0].rule) == ("a.example.com", "/en/x", "example.com/en/")
    assert got[1].rule == "www.example.com/en/" and got[4].rule == "net/es/" and got[8].rule == "com/"
    assert (got[9].host, got[9].path, got[9].rule) == ("", "", None) and (got[13].host, got[13].path) == ("b:", "//c")
    assert urls.judge(df.limit(0)).collect() == []
    assert {r.verdict for r in urls.judge(df, rules=[], blocked=[]).collect()} == {"allow"}


def test_colliding_keys(tmp_path):
    """Entries with the same key are told apart by their strings."""
    import numpy as np

    strings = [b"one", b"two", b"three"]
    body = np.int64(3).tobytes() + np.array([7, 7, 7], np.uint64).tobytes() + np.array([0, 1, 0], np.int64).tobytes() + np.cumsum([3, 3, 5]).astype(np.int64).tobytes() + b"".join(strings)
    path = tmp_path / "digests"
    path.write_bytes(body)
    found = urls.Digests(str(path)).find([b"two", b"four", b"three", b"one"], lambda t: 7)
    assert found.tolist() == [1, -1, 2, 0]
