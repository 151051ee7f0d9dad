"""Operator 13: the trie against plain prefixes, and against SQL on the tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from quillmill.llm import oracle, prefixtrie
from quillmill.llm.prefixtrie import ZFastTrie, prefix_digests, two_fattest
from quillmill.llm.queries import op13_prefix_trie


def plain_rebuilt(rows):
    """conv_id -> its rebuilt turns, of (conv_id, turn, role, text) rows."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: heads[c]] + own[heads[c] :] for c, own in convs.items()}


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(key[-1][1].encode().split()) if key else 0
        leaves[key] = sum(leaves[k] for k in children.get(key, [])) or 1
        saved[key] = own + sum(saved[k] for k in children.get(key, []))
    out = []
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def strings_of(spark, convs):
    rows = [(c, [(hashlib.sha256(repr(t).encode()).hexdigest()[:32], len(t[1].split())) for t in turns]) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "id long, turns array<struct<digest: string, words: int>>")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            assert two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda n: n & -n)


@pytest.mark.parametrize("seed", range(4))
def test_fat_binary_search_finds_exits(seed):
    rng = random.Random(seed)
    made = set()
    for _ in range(200):
        base = rng.choice(sorted(made)) if made and rng.random() < 0.7 else b""
        cut = rng.randrange(len(base) // 16 + 1) * 16
        made.add(base[:cut] + b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(12))))
    strings = [prefix_digests(s) for s in rng.sample(sorted(made), len(made))]
    trie, known = ZFastTrie(), []
    for a in range(0, len(strings), 16):
        batch = strings[a : a + 16]
        nodes = trie.insert_batch(batch)
        known += batch
        assert [trie.end[n] * 16 for n in nodes] == [len(s) for s in batch]
        prefixes = {s[:d] for s in known for d in range(0, len(s) + 1, 16)}
        for i, depth in enumerate(trie.end):
            assert trie.start(i) < depth or i == 0
            assert i == 0 or trie.handles[ZFastTrie.at(trie.string[i], two_fattest(trie.start(i), depth))] == i
        assert len(trie.handles) == len(trie.end) - 1
        for s in strings:  # what is in and what is not
            node, _ = trie.locate(s)
            ends = [trie.end[i] for i in range(len(trie.end)) if s[: trie.end[i] * 16] == trie.string[i][: trie.end[i] * 16] and trie.end[i] * 16 <= len(s)]
            assert trie.end[node] == max(ends) and s[: trie.end[node] * 16] in prefixes


@pytest.mark.parametrize(("seed", "shards"), [(0, 1), (1, 3), (2, 8), (3, 40)])
def test_shards_and_copies_against_plain_prefixes(spark, seed, shards):
    rng = random.Random(seed)
    pool = [("user", " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(5)))) for _ in range(3)]
    convs = {}
    for c in range(260):
        kind = rng.random()
        turns = [rng.choice(pool) for _ in range(rng.randrange(7))]
        convs[c * 3] = [pool[0]] * 5 if kind < 0.35 else [pool[0]] * rng.randrange(9) if kind < 0.5 else turns if kind < 0.95 else [pool[1]] * 30 + turns
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        assert found(prefixtrie.nodes(strings_of(spark, convs))) == plain_nodes(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spine_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BROADCAST_SPINE", 0)
    convs = {c: [("user", "a")] * (c % 4) + [("user", str(c // 3))] for c in range(90)}
    assert found(prefixtrie.nodes(strings_of(spark, convs), shard_turns=20)) == plain_nodes(convs)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_plain_prefixes(spark, folder):
    path = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    df = op13_prefix_trie(spark, path)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.oracle_sql()['op13_prefix_trie']})").fetchall()
    assert found(df) == sorted(expected, key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == plain_nodes(plain_rebuilt(rows))


def test_edge_cases(spark):
    rows = [(0, 1, "user", "b c"), (0, None, "user", "a"), (0, 1, "assistant", "tie"), (20, 0, None, None), (20, 1, "", ""), (21, 0, "user", "x " * 50_000), (None, 0, "user", "nobody"), (65, 0, "user", "lone")]
    rows += [(c, 0, "user", "gone") for c in range(100, 140) if c % 20] + [(7, 5, "user", "same"), (7, 5, "user", "same"), (-3, 0, "user", "negative")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")
    got = found(prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.conversations(df))))
    convs = plain_rebuilt([r for r in rows if r[0] != -3])
    convs[-3] = [("user", "gone")][:0] + [("user", "negative")][zlib.crc32(b"-3") % 4 :]  # ids below zero go up to their group's first: 0
    opening = plain_rebuilt([r for r in rows if r[0] == 0])[0]
    own = sorted([("user", "a"), ("assistant", "tie"), ("user", "b c")], key=lambda t: (t[1] != "a", t[0]))
    assert opening == own
    convs[-3] = own[: zlib.crc32(b"-3") % 4] + [("user", "negative")][zlib.crc32(b"-3") % 4 :]
    assert got == plain_nodes(convs) and any(not turns for turns in convs.values())
    assert prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.conversations(df.limit(0)))).collect() == []
