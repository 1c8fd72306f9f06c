import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from determina.llm import queries, trie


def brute_trie(sequences: dict[int, list[tuple]]) -> set[tuple]:
    """Every node from its definition; sequences are lists of (token, bytes)."""
    members, ends, children = defaultdict(list), defaultdict(list), Counter()
    for seq, s in sorted(sequences.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(seq)
        ends[tuple(s)].append(seq)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * (node[-1][1] if node else 0)
    return {
        (own[0], len(node), members[node[:-1]][0] if node else None, len(own), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, own in members.items()
    }


def rows_of(nodes) -> list[tuple]:
    return sorted(tuple(r) for r in nodes.collect())


@pytest.mark.parametrize(("seed", "longest", "letters"), [(1, 0, 1), (2, 1, 2), (3, 7, 2), (4, 8, 2), (5, 40, 1), (6, 33, 2), (7, 150, 1)])
def test_against_brute_force(spark, seed, longest, letters):
    rng = random.Random(seed)
    common = [(rng.randrange(letters), 5) for _ in range(longest)]
    sequences = {}
    for seq in range(-10, 60):
        kept = common[: rng.randrange(longest + 1)]
        sequences[seq] = kept + [(rng.randrange(letters), 5) for _ in range(min(longest - len(kept), rng.randrange(4)))]
    items = [(seq, d, str(token).encode(), size) for seq, s in sequences.items() for d, (token, size) in enumerate(s, 1)]
    got = trie.prefix_trie(spark.createDataFrame(items, "seq long, d long, token binary, bytes int"), spark.createDataFrame([(x,) for x in sequences], "seq long"))
    assert rows_of(got) == sorted(brute_trie(sequences), key=lambda r: r[:2])


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            body = (role or "", text or "")
            token = hashlib.sha256(f"{len(body[0].encode())}:{''.join(body)}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, token, body))
    original = {c: [((body), len(body[1].encode())) for *_, body in sorted(t)] for c, t in turns.items()}
    out = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = original.get(c - c % 5, [])[:h] + original[c][h:]
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, 0, "user", "lost")]
    for conv in [*range(0, 40), 1000, 1003, 10**12]:
        for turn in rng.sample(range(30), rng.randrange(1, 14)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["é", "", None, "hello", "w " * 900])))
    rows += [(7, 5, "user", "same"), (7, 5, "user", "same")]
    rows += [(5, t, "user", "long") for t in range(100, 220)] + [(6, t, "user", "long") for t in range(100, 220)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, token string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op12_trie(spark, str(tmp_path))) == sorted(brute_trie(rebuilt(rows)), key=lambda r: r[:2])


def test_a_turn_is_role_and_text(spark):
    """The border between role and text counts."""
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, None, "abc"), (4, 0, "", "abc")]
    turns = trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    token = {r.conv: r.token for r in turns}
    assert len(set(token.values())) == 3 and token[3] == token[4]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string").where("false").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_trie(spark, str(tmp_path)).collect() == []


def test_many_ends_in_one_node(spark):
    """Members of one node come from many tasks."""
    table = spark.range(0, 50_000, numPartitions=7).selectExpr("2L as d", "0L as rep", "id * 3 - 600 as seq").union(spark.range(5).selectExpr("0L", "0L", "id"))
    got = {(r.d, r.rep): r.ends_sha256 for r in trie.member_digests(table).collect()}
    joined = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(2, 0): joined(range(-600, 149_400, 3)), (0, 0): joined(range(5))}
