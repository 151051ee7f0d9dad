from __future__ import annotations

import math
import zlib
from collections import Counter


import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import langid
from quillmill.llm.queries import op5_langid

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op5_langid(spark, SMALL).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.97, np.mean(right)


def test_viterbi_is_best_path():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(0, 3, (15, 3)).astype(np.float32)
    labels = langid.viterbi(scores, sizes, 2.0)

    def value(path, s):
        return sum(s[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    at = 0
    for n in sizes:
        own = scores[at : at + n].astype(float)
        best = max((value(p, own) for p in np.ndindex(*[3] * n)), default=0)
        assert abs(value(labels[at : at + n], own) - best) < 1e-6
        at += n


def test_spans_of_mixed_text_and_scripts(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs away", "en") for i in range(20)]
    rows += [(100 + i, "быстрая лиса прыгает через собаку и бежит", "ru") for i in range(20)]
    rows += [(200 + i, "der schnelle braune fuchs springt über den faulen hund", "de") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    english, german = "the brown dog jumps over the lazy fox and runs", "der faule hund springt über den braunen fuchs"
    mixed = spark.createDataFrame([(1, f"{english} {german}. 12 собака бежит", "x"), (2, "123 !!", "x"), (3, None, None), (3, "", None), (None, "Лиса", "x")], "doc_id long, text string, lang_pred string")
    got = langid.identify(mixed, model).collect()
    text = f"{english} {german}. 12 собака бежит"
    assert [(s.lang, text[s.start : s.end]) for s in got[0].spans] == [("en", english), ("de", german), ("ru", "собака бежит")]
    assert [(r.lang_pred, r.score) for r in got[1:]] == [("und", 0.0)] * 3 + [("ru", 1.0)]
    assert langid.identify(mixed.filter(F.lit(False)), model).collect() == []
    none = langid.fit(spark.createDataFrame([], "id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(mixed, none).collect()} == {"und"}


def test_long_and_short_texts_agree():
    model = langid.Model(["a", "b"], {k: np.random.default_rng(k).normal(0, 1, (1 << b, 2)).astype(np.float32) for k, b in langid.BITS.items()}, np.ones((len(langid.SCRIPT_NAMES), 2), bool))
    texts = ["one two three " * 40_000, "one two three", "", "four"]
    together = langid.identify_texts(texts, model)
    alone = [langid.identify_texts([t], model) for t in texts]
    assert together[0] == [x[0][0] for x in alone] and together[1] == [x[1][0] for x in alone]


def plain_grams(word):
    """Buckets of two and of three characters at each place of a word and behind it."""
    out = []
    for i in range(len(word) + 1):
        a, b, c = (word[j] if 0 <= j < len(word) else 0 for j in (i - 2, i - 1, i))
        two = (b * 0x9E3779B1 + c * 0x85EBCA6B) % 2**32 >> 32 - 13
        three = (a * 0xC2B2AE35 + b * 0x9E3779B1 + c * 0x27D4EB2F) % 2**32 >> 32 - 16
        out.append((two, three))
    return out


def plain_words(text):
    words, run = [], []
    for c in [*(text or ""), "."]:
        if c.isalpha():
            low = c.lower()
            run.append(ord(low) if len(low) == 1 else ord(c))
        elif run:
            words.append(run)
            run = []
    return words


def test_query_by_brute_force(spark):
    """Counts, scores, Viterbi and shares of the whole table, one word at a time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    labels = sorted({r.lang for r in docs if r.lang and r.lang != "und" and not out[r.doc_id]})
    counts = {n: {x: Counter() for x in labels} for n in (2, 3)}
    latin = Counter()
    for r in docs:
        if r.lang in labels and r.text is not None and not out[r.doc_id]:
            for word in plain_words(r.text):
                latin[r.lang] += 1
                for two, three in plain_grams(word):
                    counts[2][r.lang][two] += 1
                    counts[3][r.lang][three] += 1
    assert all(latin[x] for x in labels)  # one script: no candidate is narrowed out
    total = {n: {x: sum(counts[n][x].values()) + 0.5 * 2 ** (13 if n == 2 else 16) for x in labels} for n in counts}
    logs = {n: {x: {g: math.log((k + 0.5) / total[n][x]) for g, k in counts[n][x].items()} for x in labels} for n in counts}
    none = {n: {x: math.log(0.5 / total[n][x]) for x in labels} for n in counts}
    rows = {r.doc_id: r for r in op5_langid(spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        words, held, came = plain_words(r.text), None, []
        for word in words:
            own = [sum(logs[2][x].get(two, none[2][x]) + logs[3][x].get(three, none[3][x]) for two, three in plain_grams(word)) for x in labels]
            if held is None:
                held = own
                continue
            best = max(range(len(labels)), key=lambda k: held[k])
            came.append([k if held[k] >= held[best] - langid.PENALTY else best for k in range(len(labels))])
            held = [max(held[k], held[best] - langid.PENALTY) + own[k] for k in range(len(labels))]
        letters = [0] * len(labels)
        if words:
            at = max(range(len(labels)), key=lambda k: held[k])
            for word, before in zip(reversed(words), [*reversed(came), None]):
                letters[at] += len(word)
                at = before[at] if before else at
        got = rows[r.doc_id]
        assert got.held_out == out[r.doc_id]
        if not words:
            assert (got.lang_pred, got.score) == ("und", 0.0)
        else:
            assert got.lang_pred == labels[letters.index(max(letters))] and abs(got.score - max(letters) / sum(letters)) < 1e-3, r.doc_id
