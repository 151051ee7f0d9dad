from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing
from quillmill.llm.queries import op2_mixing

SMALL = "/root/testdata/sf0.01"


def reshared(sizes, weights, most):
    """Targets as the contract words it: cap, then share the excess again by weight."""
    total, capped = float(sum(sizes.values())), {}
    while True:
        left = total - sum(capped.values())
        weight = sum(w for s, w in weights.items() if s not in capped)
        targets = {s: capped.get(s, left * weights[s] / weight if weight else 0.0) for s in sizes}
        over = {s: most * float(sizes[s]) for s in sizes if s not in capped and targets[s] > most * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_targets_match_resharing():
    sizes = {"a": 10, "b": 500, "c": 3, "d": 90, None: 400, "e": 0}
    weights = mixing.cycle_weights(list(sizes))
    assert weights == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 1.0, "e": 2.0, None: 3.0}
    got, expected = mixing.share_out(sizes, weights, sum(sizes.values()), 3), reshared(sizes, weights, 3)
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_flow_is_a_cheapest_one():
    patterns, sizes, quotas = [("a",), ("a", "b"), ("b",)], [2, 3, 1], {"a": 5.0, "b": 4.0}

    def cost(flow):
        return sum(max(0.0, min(f - k * s, s)) * k for f, s in zip(flow, sizes) for k in range(3))

    flow = mixing.route(patterns, sizes, quotas, 3)
    best = min(cost((a, x + y, b)) for a, x, y, b in product(range(7), range(10), range(10), range(4)) if a + x == 5 and b + y == 4 and x + y <= 9)
    assert sum(flow) == pytest.approx(9) and cost(flow) == pytest.approx(best)


def test_one_flow_for_all_patterns(monkeypatch):
    """A pattern that shares no source goes through the flow too, and parts of the graph don't change the whole."""
    patterns, sizes = [("a",), ("b", "c"), ("c",), ("d",), (None, "e")], [5, 7, 2, 100, 9]
    quotas = {"a": 20.0, "b": 6.0, "c": 5.0, "d": 30.0, None: 4.0, "e": 1.5}
    assert mixing.route(patterns, sizes, quotas, 3) == pytest.approx(mixing._flow(patterns, sizes, quotas, 3))
    assert mixing.route(patterns, sizes, quotas, 3)[0] == 15.0
    monkeypatch.setattr(mixing, "_flow", lambda p, s, q, r: [1.0] * len(p))
    assert mixing.route(patterns, sizes, quotas, 3) == [1.0] * 5


def test_mix_of_overlapping_sources(spark):
    """Copies of one text in several sources: their words go where quotas ask for them, at the least cost of repetition."""
    rng = random.Random(8)
    members = [("x",), ("x", "y"), ("y",), ("y", "z"), ("z",)]
    rows = [(i, " ".join(["w"] * rng.randint(1, 4)), list(rng.choice(members))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    weights, total = {"x": 5.0, "y": 1.0, "z": 3.0}, 4500
    mixed = mixing.mix(df, F.regexp_count("text", F.lit("w")), F.col("sources"), F.col("doc_id"), weights=weights, total=total).collect()
    sizes, taken, first = Counter(), Counter(), Counter()
    for r in mixed:
        key = tuple(sorted(r.sources))
        sizes[key] += r.mix_size
        taken[key] += r.mix_size * r.mix_copies
        first[key] += r.mix_size * min(1, r.mix_copies)
        assert 0 <= r.mix_copies <= 3
    by_source = {s: sum(n for k, n in sizes.items() if s in k) for s in "xyz"}
    targets = reshared(by_source, weights, 3) if total == sum(by_source.values()) else mixing.share_out(by_source, weights, total, 3)
    keys = list(sizes)

    def cheapest():  # by a linear search over what the two shared patterns give to their first source
        best = None
        for to_x in range(0, 3 * sizes["x", "y"] + 1, 60):
            for to_y in range(0, 3 * sizes["y", "z"] + 1, 60):
                x, z = targets["x"] - to_x, targets["z"]
                for to_z in range(0, 3 * sizes["y", "z"] - to_y + 1, 60):
                    y = targets["y"] - to_y
                    xy_y = max(0.0, min(y, 3 * sizes["x", "y"] - to_x))
                    flow = {("x",): x, ("x", "y"): to_x + xy_y, ("y",): y - xy_y, ("y", "z"): to_y + to_z, ("z",): z - to_z}
                    if all(-1e-9 <= f <= 3 * sizes[k] for k, f in flow.items()):
                        c = cost_of(flow)
                        best = c if best is None or c < best else best
        return best

    def cost_of(flow):
        return sum(max(0.0, min(flow[k] - t * sizes[k], sizes[k])) * t for k in keys for t in range(3))

    flow = dict(zip(keys, mixing.route(keys, [sizes[k] for k in keys], targets, 3)))
    assert sum(flow.values()) == pytest.approx(sum(targets.values()))
    assert cost_of(flow) <= cheapest() + 1e-6
    assert abs(cost_of(taken) - cost_of(flow)) <= 2 * 4 * len(keys)  # a document's words at the seam of each pattern
    assert abs(sum(taken.values()) - sum(targets.values())) <= 4 * len(keys)


def test_query(spark):
    rows = op2_mixing(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken = {}, {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len((docs[r.doc_id].text or "").encode().split())
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
    targets = reshared(sizes, mixing.cycle_weights(list(sizes)), 3)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        assert abs(taken[source] - r.target) <= max(x.size for x in rows if docs[x.doc_id].source == source)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mixing(spark, SMALL).collect()))


def test_edge_cases(spark):
    rows = [(1, "a b c", "x", 7), (1, "a b c", "x", 7), (None, "d " * 50, None, 7), (3, None, None, 7), (4, "", "y", 7), (5, "e f", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    size = F.regexp_count("text", F.lit(r"\S+"))
    mixed = mixing.mix(df, size, F.array("source"), F.col("doc_id"))
    assert mixed.columns[:4] == df.columns and mixed.count() == 6
    assert all(r.mix_copies <= 3 for r in mixed.collect())
    assert mixing.mix(df.filter(F.lit(False)), size, F.array("source"), F.col("doc_id")).collect() == []


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equal_rows_are_taken_as_far_as_they_fit(spark, seed):
    """A third of all rows, and one source, are equal in every column."""
    rng = random.Random(seed)
    rows = [(7, "w " * 10, "a")] * 300 + [(i, "w " * rng.randint(1, 12), rng.choice("bc")) for i in range(600)] + [(9, "", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for weights in ({"a": 1.0, "b": 9.0, "c": 8.0}, {"a": 5.0, "b": 2.0, "c": 2.0}):
        mixed = mixing.mix(df, F.regexp_count("text", F.lit("w")), F.array("source"), F.col("doc_id"), weights=weights).collect()
        assert len(mixed) == len(rows)
        for source in "abc":
            own = [r for r in mixed if r.source == source]
            assert abs(sum(r.mix_size * r.mix_copies for r in own) - own[0].mix_target) <= 12
        assert {r.mix_copies for r in mixed if r.doc_id == 7} <= {0, 1, 2, 3}
