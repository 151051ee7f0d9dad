from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import secrets
from tests.llm.test_mixing import reshared
from tests.llm.test_nearcopies import plain_copies

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "src0", 8), (9002, None, None, None, None), (9003, "token=abcdef123 with some words", "en", None, 31)], docs.schema)
    table, rows = docs.unionByName(extra), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SMALL)
        assert out.columns == docs.columns
        before, rows = table.collect(), out.collect()
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} == {9001, 9002}
        elif name == "near_duplicates":
            ids = [r.doc_id for r in before]
            assert sorted(r.doc_id for r in rows) == sorted(set(plain_copies(ids, [r.text for r in before])))
        elif name == "secrets":
            texts = {r.doc_id: r.text for r in before}
            assert len(rows) == len(before) and "token" not in next(r.text for r in rows if r.doc_id == 9003)
            for r in rows:
                spans = secrets.find_spans([texts[r.doc_id]], secrets.BASE + secrets.ADDED)[0]
                assert (r.text == texts[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        else:
            sizes = Counter()
            for r in before:
                sizes[r.source] += len(r.text.split())
            ordered = sorted(sizes, key=lambda s: (s is None, s))
            targets = reshared(sizes, {s: k % 3 + 1 for k, s in enumerate(ordered)}, 3)
            taken = Counter()
            for r in rows:
                taken[r.source] += len(r.text.split())
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
            for s in sizes:
                assert abs(taken[s] - targets[s]) <= max(len(r.text.split()) for r in before if r.source == s)
        table = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.encode(spark, table, SMALL).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in last) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)


def test_run_and_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 100
    spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_that_clash_pass_through(spark):
    names = ["lang_pred", "score", "spans", "fp", "id", "component_id", "_own", "_key", "mix_copies", "mix_copy", "mix_size", "_mix_of", "n_tokens", "ids"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30).select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert rows
        if name != "bpe":
            assert out.columns == docs.columns and all(r[n] == n for r in rows for n in names)


def test_unlabelled_corpus_passes_the_language_stage(spark):
    rows = [(1, "some plain words"), (2, "12 34 !!"), (3, None), (4, ""), (5, "\u65e5\u672c 7"), (6, "7 \u00e9")]
    for label in (None, "und"):
        docs = spark.createDataFrame([(i, t, label, "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
        out = corpus_pipeline.identify_language(spark, docs, SMALL)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 5, 6]
