from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import simhash
from quillmill.llm.queries import op1_simhash

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    out = []
    for i in range(len(ids)):
        members = [x for x in groups[find(i)] if x is not None]
        out.append(min(members) if members else None)
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs]
    expected = {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, plain_components(ids, fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, SMALL).collect()}
    assert got == expected


def chain(rng, n, flips):
    x = int(rng.integers(0, 1 << 63))
    out = [x]
    for _ in range(n - 1):
        for b in rng.choice(64, flips, replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_blocks_agree_with_all_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 5, 63, 64, 65, 200, 700):
        fps = np.unique(np.array(chain(rng, n // 2 + 1, 3) + chain(rng, n // 2 + 1, 5), np.uint64))
        expected = plain_components(list(range(len(fps))), [int(x) for x in fps])
        a, b = simhash.link_blocks(np.zeros(len(fps), np.int64), fps)
        place = {int(x): i for i, x in enumerate(fps)}
        label = list(range(len(fps)))
        for _ in range(len(fps)):
            for x, y in zip(a, b):
                i, j = place[int(x)], place[int(y)]
                label[i] = label[j] = min(label[i], label[j])
        assert label == expected


def test_keys_tiles_and_components_lose_no_link(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([x for _ in range(12) for x in chain(rng, 40, 4)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    expected = plain_components(list(range(len(fps))), [int(x) for x in fps])
    for n, tile in ((10, 1 << 14), (1 << 24, 1 << 14), (10, 3)):
        keyed = simhash.tiled(simhash._keyed(df, n, 4), tile)
        roots = {r.node: r.root for r in simhash.components(simhash._links(keyed, 4)).collect()}
        seen = {}
        got = [seen.setdefault(roots.get(int(x), int(x)), i) for i, x in enumerate(fps.view(np.int64))]
        assert got == expected


def test_edge_cases(spark):
    rows = [(None, None, 1), (3, None, 1), (2, "", 1), (5, " \n", 1), (7, "a b c d e", 2), (7, "a b c d e", 2), (9, "A B\tC D  E", 2), (None, "x", 3), (None, "yy zz", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2), (3, 2), (2, 2), (5, 2), (7, 7), (7, 7), (9, 7), (None, None), (None, None)], key=str)
    assert simhash.near_duplicates(df.filter(F.lit(False))).collect() == []
    assert simhash.fingerprint_texts(["w " * 600_000], at_once=1000)[0] == plain_fingerprint("w w w w")
