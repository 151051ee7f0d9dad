from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.llm import quality
from quillmill.llm.queries import op9_quality

SMALL = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def check(text, r):
    expected = plain(text or "")
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, text
    assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
    assert not (r.base_failed and r.kept)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op9_quality(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        check(docs[r.doc_id], r)
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()}
    judged = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(not r.kept for r in judged) <= quality.ALPHA * len(judged)


def test_query_verdicts_recomputed(spark):
    """Cutoffs and verdicts of the whole table, anew from its measures; some are certified, and they reject."""
    folder = "/root/testdata/sf0.1"
    rows = op9_quality(spark, folder).collect()
    langs = {r.doc_id: r.lang or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    values = {"symbols": lambda r: r.n_symbols, "repeats": lambda r: r.n_repeat_words, "dup_lines": lambda r: r.n_dup_lines, "long_words": lambda r: r.word_chars, "short_words": lambda r: -r.word_chars}

    def over(r, cutoffs):
        return any(values[rule](r) / r.n_words > c for rule, c in cutoffs.items())

    steps, cutoffs = [], {}
    for place in range(9):  # one cutoff tighter at a time, rule by rule
        for rule, (_, grid) in quality.RULES.items():
            if place < len(grid):
                cutoffs = cutoffs | {rule: grid[place]}
                steps.append(cutoffs)
    judged = {}
    for r in rows:
        if r.doc_id in good and not r.base_failed:
            judged.setdefault(langs[r.doc_id], []).append(r)
    certified = {}
    for lang, own in judged.items():
        for cutoffs in steps:
            k, n = sum(over(r, cutoffs) for r in own), len(own)
            p = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k <= 0.01 * n else 1.0
            if p > 0.05 / len(judged):
                break
            certified[lang] = cutoffs
    assert certified
    for r in rows:
        assert r.kept == (not r.base_failed and not over(r, certified.get(langs[r.doc_id], {}))), r
    assert sum(not r.kept and not r.base_failed for r in rows) > 50


def test_binomial(spark):
    cases = [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.3), (5, 2000, 0.01), (0, 50_000, 0.002), (70, 50_000, 0.002)]
    for k, n, p in cases:
        got = spark.createDataFrame([(k, n)], "k long, n long").select(quality.binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert got == pytest.approx(1.0 if k > n * p else exact, rel=1e-6)


def test_certified_cutoffs_and_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    marked = " ".join(f"word{i}###" for i in range(60))
    docs = [(i, clean, "en") for i in range(9000)] + [(9000 + i, marked, "en") for i in range(40)] + [(20_000 + i, marked, "fr") for i in range(30)]
    labels = [(i, 1) for i in range(9000)] + [(9000 + i, 0) for i in range(40)] + [(20_000 + i, 1) for i in range(30)]
    rows = quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i in range(9000)) and not any(kept[9000 + i] for i in range(40))
    assert all(kept[20_000 + i] for i in range(30))  # too few labels to certify anything there


def test_edge_cases(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "l\nl\n\nl\n m\n m", "é 日本 x | <b>", "w\x0bv\x0cu\r\nt", ("same words again " * 20_000), "a b c d\n" * 3]
    df = spark.createDataFrame([(None if i % 4 == 0 else 1, t, None if i % 3 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("n_words", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.judge(df.coalesce(1), labels).collect()
    assert sorted(map(plain, (t or "" for t in texts))) == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert quality.judge(df.limit(0), labels).collect() == []
    assert len(quality.judge(df, labels.limit(0)).collect()) == len(texts)


def test_joint_certificate_with_few_labels(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    marked = " ".join(f"word{i}###" for i in range(60))
    docs, labels = [], []
    for s, (stratum, n_good) in enumerate([("a", 437), ("b", 436), ("c", 700), ("d", 10)]):  # 0.99 ** 437 <= 0.05 / 4 < 0.99 ** 436
        texts = [clean] * n_good + [marked] * 5
        if stratum == "c":  # one false rejection in 700 still is certified, 0.99 ** 700 * (1 + 700 / 99) <= 0.05 / 4
            texts[0] = marked
        docs += [(1000 * s + i, t, stratum) for i, t in enumerate(texts)]
        labels += [(1000 * s + i, int(i < n_good)) for i in range(len(texts))]
    tables = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {(r.lang, r.text == clean): r.n for r in quality.judge(*tables).join(tables[0], "doc_id").filter("kept").groupBy("lang", "text").agg(F.count("*").alias("n")).collect()}
    assert kept == {("a", True): 437, ("b", True): 436, ("b", False): 5, ("c", True): 699, ("d", True): 10, ("d", False): 5}
    active = {r.stratum: (r.n_good, r.n_active > 0) for r in quality.active_cutoffs(*tables).collect()}
    assert active == {"a": (437, True), "b": (436, False), "c": (700, True), "d": (10, False)}
