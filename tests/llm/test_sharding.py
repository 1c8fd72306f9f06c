import numpy as np
import pytest
from pyspark.sql import functions as F

from determina.llm import sharding

NAMES = [f"s{i}" for i in range(7)]


def test_table_is_fair_and_stable():
    table = sharding.lookup_table(NAMES, 503)
    assert set(np.bincount(table).tolist()) <= {503 // 7, 503 // 7 + 1}
    fewer = sharding.lookup_table(NAMES[:-1], 503)
    assert (table[table < 6] == fewer[table < 6]).mean() > 0.6
    twice = np.bincount(sharding.lookup_table(NAMES, 503, weights=[2, 1, 1, 1, 1, 1, 1]))
    assert abs(twice[0] - 2 * 503 / 8) <= 2


def test_claims_follow_preferences():
    """Turn by turn, each shard has the first slot of its order that was still free."""
    import hashlib

    table, m, free = sharding.lookup_table(NAMES, 31), 31, set(range(31))
    orders = []
    for n in NAMES:
        d = hashlib.sha256(n.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % m, int.from_bytes(d[8:16], "big") % (m - 1) + 1
        orders.append([(a + j * b) % m for j in range(m)])
    turn = 0
    while free:
        slot = next(x for x in orders[turn % 7] if x in free)
        assert table[slot] == turn % 7
        free.remove(slot)
        turn += 1


def test_place(spark):
    rows = [(k, "t", "old", 5) for k in range(200)] + [(None, f"x{k}", "old", 5) for k in range(200)] + [(None, None, None, None), (3, "t", "old", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.place(df, NAMES, slots=503).collect()
    assert len(got) == 402 and {r.shard for r in got} == set(NAMES)
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    table = sharding.lookup_table(NAMES, 503)
    assert all(r.shard == NAMES[table[r.slot]] for r in got)
    assert sharding.place(df.limit(0), NAMES, slots=503).collect() == []


def test_bad_parameters():
    for names, slots in (([], 31), (["a", "a"], 31), (["a"], 32)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_slot_is_of_md5(spark):
    """The first 60 bits of the key's md5 modulo the slots, for texts of any kind."""
    import hashlib

    keys = ["", "0", "17", "-3", "é▁", "x" * 5000, *(str(k) for k in range(500))]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", sharding.slot_of(F.col("k")).alias("slot")).collect()
    assert {r.k: r.slot for r in got} == {k: (int(hashlib.md5(k.encode()).hexdigest(), 16) >> 68) % sharding.SLOTS for k in keys}
