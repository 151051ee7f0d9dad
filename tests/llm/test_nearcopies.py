"""Operator 1 as a filter: near copies by sets of shingles."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import common, nearcopies


def plain_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_copies(ids, texts, similarity=0.8):
    """The smallest id that links reach, by comparing all pairs that share a shingle."""
    sets, label, by = [plain_set(t) for t in texts], list(range(len(ids))), {}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        near = set()
        for x in s or {None}:
            near.update(by.setdefault(x, []))
            by[x].append(i)
        for j in near:
            both = len(s & sets[j])
            if both >= similarity * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def edited(rng, words, share):
    return " ".join(rng.choice(["quill", "mill", "ink"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def test_tables_against_all_pairs(spark):
    for folder in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text").sort("doc_id").collect()
        ids = [r.doc_id for r in docs]
        expected = dict(zip(ids, plain_copies(ids, [r.text for r in docs])))
        found = {r.key: r.component for r in nearcopies.near_copies(spark.createDataFrame(docs), F.col("doc_id"), F.col("text")).collect()}
        assert found == expected and len(set(expected.values())) < len(ids)


def test_planted_copies_in_small_and_large_blocks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for n, copies in ((300, 1), (200, 6), (40, 30), (400, 400)):  # the last is one large group
        base = rng.choices(vocabulary, k=n)
        texts += [" ".join(base)] + [edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04, 0.1])) for _ in range(copies)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    texts += [f"{shared} {' '.join(rng.choices(vocabulary, k=200))}" for _ in range(150)]  # a passage is no copy
    ids = list(range(len(texts)))
    expected = plain_copies(ids, texts)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for tile in (1 << 14, 50):
        found = {r.key: r.component for r in nearcopies.near_copies(df, F.col("doc_id"), F.col("text"), tile=tile).collect()}
        assert all(found[i] == i for i in ids[-150:])
        assert found == dict(zip(ids, expected))


def test_forest_spans_what_all_pairs_link():
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 1 << 63, (8, nearcopies.WORDS), dtype=np.uint64)
    fps = np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, nearcopies.WORDS, 6), dtype=np.uint64), axis=2) for b in bases])
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= nearcopies.RADIUS
    for size in (2, 33, 64, 65, len(fps)):
        i, j = nearcopies.block_pairs(np.zeros(size, np.int64), fps[:size])
        assert all(near[x, y] and x < y for x, y in zip(i, j))
        if size <= 64:
            assert {*zip(i.tolist(), j.tolist())} == {(x, y) for x in range(size) for y in range(x + 1, size) if near[x, y]}
        label = list(range(size))
        for _ in range(size):
            for x, y in zip(i, j):
                label[x] = label[y] = min(label[x], label[y])
        assert all(label[x] == label[y] for x in range(size) for y in range(size) if near[x, y])
        assert size <= 64 or len(i) <= (nearcopies.NEAREST + 1) * size


def test_parts_of_a_large_block_are_closed(spark, monkeypatch):
    """A chain of texts, each similar to its neighbours only, in one block, where the closest ones are others' copies."""
    rng = random.Random(11)
    words, texts = [f"w{k}" for k in range(400)], []
    for n in range(120):  # neighbours share 0.83, others less and less; some are close below 0.8
        texts.append(" ".join(words))
        words = words[30 if n % 7 else 75 :] + [f"x{n}.{k}" for k in range(30 if n % 7 else 75)]
    texts += [" ".join(edited(rng, texts[0].split(), 0.02)) for _ in range(60)]
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    ids = list(range(len(texts)))
    expected = plain_copies(ids, texts)
    monkeypatch.setattr(nearcopies, "RADIUS", 256)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")

    def one_block(shingles, at_once=1 << 14):
        digest, fingerprint, keys = sketch(shingles, at_once)
        return digest, fingerprint, keys[:1] * np.uint64(0) + np.uint64(5)

    sketch = nearcopies.sketch
    found = {r.key: r.component for r in _with(monkeypatch, one_block, lambda: nearcopies.near_copies(df, F.col("doc_id"), F.col("text"), radius=256)).collect()}
    assert found == dict(zip(ids, expected)) and len(set(expected)) > 2


def _with(monkeypatch, sketch, run):
    monkeypatch.setattr(nearcopies, "sketch", sketch)
    return run()


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(500)}" for _ in range(80)) for x in "abcd")
    rows = [(1, a), (1, b), (1, c), (4, d), (2, a + " end"), (3, b + " end"), (1, a), (5, c + " one more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(r) for r in nearcopies.drop_near_copies(df).collect())
    assert kept == sorted([(1, a), (1, b), (1, c), (4, d)])


def test_rows_to_look_up_are_split_off(spark):
    df = spark.range(20_000).select("id", F.lit(1).alias("bucket"), F.lit(2).alias("own_bucket"))
    members = spark.range(0, 20_000, 50).select(F.col("id").alias("key"))
    maybe, surely = common.split_by(df, F.col("id"), members)
    assert maybe.columns == surely.columns == df.columns
    some = {r.id for r in maybe.collect()}
    assert some >= set(range(0, 20_000, 50)) and len(some) < 3000
    assert surely.count() + len(some) == 20_000
    assert [x.count() for x in common.split_by(df, F.col("id"), members.limit(0))] == [0, 20_000]


def test_edge_cases(spark):
    rows = [(None, None, 1), (3, None, 1), (2, "", 1), (5, " \n", 1), (7, "a b c d e", 2), (7, "a b c d e", 2), (9, "A B\tC D  E", 2), (None, "x", 3), (None, "yy zz", 3), (11, "solo", 4), (11, "solo", 4), (12, "other", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_key int")
    kept = nearcopies.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x"), (0, "yy zz"), (2, ""), (7, "a b c d e"), (11, "solo"), (12, "other")]
    assert nearcopies.drop_near_copies(df.filter(F.lit(False))).collect() == []
    whole = nearcopies.sketch(nearcopies.shingle_set("w x y z " * 50_000))
    small = nearcopies.sketch(nearcopies.shingle_set("w x y z " * 50_000), at_once=3)
    assert whole[0] == small[0] and (whole[1] == small[1]).all() and (whole[2] == small[2]).all()
