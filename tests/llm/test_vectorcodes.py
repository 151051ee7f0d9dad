"""Operator 11: product codes against a plain version, and a round trip by the codebooks."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import oracle, vectorcodes
from quillmill.llm.queries import op11_vector_codes

SMALL = "/root/testdata/sf0.01"


def plain(rows, parts, entries, rounds):
    """[(id, code, error)] and the codebooks of (id, vector) rows, in their order."""
    step = -(-max(len(v) for _, v in rows) // parts)
    vectors = [list(v) + [0] * (parts * step - len(v)) for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:entries]
    books = [[vectors[i][p * step : (p + 1) * step] for i in first] for p in range(parts)]

    def assigned():
        out = []
        for v in vectors:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p * step : (p + 1) * step], entry)), e) for e, entry in enumerate(books[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        best = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * step : (p + 1) * step] for v, b in zip(vectors, best) if b[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    best = assigned()
    return [(i, bytes(e for _, e in b), sum(d for d, _ in b)) for (i, _), b in zip(rows, best)], books


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    df = op11_vector_codes(spark, SMALL)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.oracle_sql()['op11_vector_codes']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected) and len(expected) == 500


@pytest.mark.parametrize(("parts", "entries", "rounds", "width", "block"), [(4, 8, 2, 8, 50), (3, 20, 3, 7, 4096), (2, 256, 1, 2, 64)])
def test_against_plain_version(spark, monkeypatch, parts, entries, rounds, width, block):
    monkeypatch.setattr(vectorcodes, "BLOCK", block)
    rng = np.random.default_rng(width)
    rows = [(int(i), rng.integers(-40, 40, width - i % 2).tolist()) for i in rng.permutation(300)] + [(1005, [1] * width), (1005, [1] * width), (None, [-9] * width)]
    df = spark.createDataFrame([(i, v, "x", 9) for i, v in rows], "vec_id long, v array<bigint>, row string, error int").repartition(5)
    coded, books = vectorcodes.compress(df, parts=parts, entries=entries, rounds=rounds)
    expected, plain_books = plain(rows, parts, entries, rounds)
    assert [books.of_part(p).tolist() for p in range(parts)] == plain_books
    assert books.digest() == hashlib.sha256(",".join(str(x) for part in plain_books for e in part for x in e).encode()).hexdigest()
    got = [(r.vec_id, bytes(r.codes), r.error) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and coded.columns == ["vec_id", "row", "codes", "error"]
    decoded = {r.vec_id: r.decoded for r in vectorcodes.decode(coded, books).collect()}
    for i, v in rows[:300]:
        error = next(e for j, _, e in expected if j == i)
        padded = v + [0] * (len(decoded[i]) - len(v))
        assert sum((a - b) ** 2 for a, b in zip(decoded[i], padded)) == error


def test_edge_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.001, 1.0], 1), (1, None, 1), (2, [nan, 1.0, 0.0], None), (4, [1.0, None, 0.0], 2), (5, [inf, 0.0, 0.0], 2), (None, [0.25, 0.0, 0.0], None), (6, [], None), (3, [0.5, -0.001, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("vec_id", "label", vectorcodes.quantized(F.col("embedding")).alias("v"))
    assert {tuple(r.v) for r in df.collect() if r.v is not None} == {(128, -1, 256), (64, 0, 0), ()}
    for most in (10, 0):  # sums broadcast or shuffled
        monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", most)
        coded, books = vectorcodes.compress(df, parts=2, entries=2, rounds=0)
        got = sorted(((r.vec_id, r.label, bytes(r.codes).hex(), r.error, r.label_error) for r in vectorcodes.with_label_error(coded).collect()), key=str)
        gone = 128**2 + 1 + 256**2
        near = 64**2 + 1 + 256**2
        assert got == sorted([(3, 1, "0000", 0, 0), (3, 1, "0000", 0, 0), (None, None, "0000", near, near + gone), (6, None, "0000", gone, near + gone)], key=str)
        assert books.entries.tolist() == [[128, -1, 256, 0]] * 2
    none, books = vectorcodes.compress(df.limit(0))
    assert vectorcodes.with_label_error(none).collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="may not fit"):
        vectorcodes.compress(spark.createDataFrame([(1, [1 << 40])], "vec_id long, v array<bigint>"))[0].collect()


