from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from quillmill.llm import secrets
from quillmill.llm.queries import op8_secrets

SMALL = "/root/testdata/sf0.01"


def plain(text):
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(out)]


def check(text, r):
    expected = plain(text or "")
    assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in expected) for k in ("assign", "access", "hex"))
    assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
    assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == expected


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op8_secrets(spark, SMALL).collect()
    assert len(rows) == len(docs) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        check(docs[r.doc_id], r)


TEXTS = ["Api_Key: 'abcdef1' apikey=\"zzzzzz\" TOKEN = short token=longer", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "0" * 24 + "g" + "f" * 23 + " é" + "a" * 40, "ſecret=abcdefg passwd='/x/y.z='", "toKen=abcdef", "tokenpassword=123456", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", None, "", "password=a password=bcdefgh", "x" * 200_000 + "secret:0123456789abcdef01234567"]


def test_edge_cases(spark):
    ids = [None, *range(1, 8), 8, 8, *range(10, len(TEXTS))]  # texts 8 and 9 have nothing to find
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS)], "doc_id long, text string, spans string")
    rows = secrets.digests(df).collect()
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
    for r in rows:
        check(TEXTS[ids.index(r.doc_id)], r)
    kinds = {s.kind for r in secrets.scan(df).collect() for s in r.spans}
    assert {"github", "private_key"} <= kinds
    cleaned = secrets.redact(df)
    assert cleaned.columns == df.columns
    out = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert (None, "[secret]' [secret]\" TOKEN = short [secret]") in out and {t for i, t in out if i == 8} == {None, ""} and len(out) == len(TEXTS)
    assert secrets.digests(df.limit(0)).collect() == []


def test_stored_postings_answer_and_only_candidates_are_verified(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001 + i, t) for i, t in enumerate(TEXTS)], docs.schema)
    table, index = docs.unionByName(extra).repartition(3), str(tmp_path / "index")
    secrets.write_index(table, index)
    texts = {r.of_text: r.text or "" for r in table.select(secrets.text_hash("text").alias("of_text"), "text").collect()}
    rules = (secrets.Rule("key", "AKIA[A-Z0-9]+"), secrets.Rule("either", "(?:zz|qq)[a-z]+", any_case=True), secrets.Rule("word", "pass(?:word|wd)", any_case=True))
    found = {r.of_text: r.rules for r in secrets.candidates(spark, index, rules).collect()}
    for of_text, text in texts.items():
        low, bits = text.lower(), found.get(of_text, 0)
        assert (bits & 1 > 0) == ("aki" in low and "kia" in low) and not bits & 2
        assert (bits & 4 > 0) == all(x in low for x in ("pas", "ass", "ssw")) & (all(x in low for x in ("swo", "wor", "ord")) or "swd" in low)
    assert len(found) < len(texts) / 2
    with_it, without = (sorted(map(str, secrets.scan(table, rules=rules, index=x).collect())) for x in (index, None))
    assert with_it == without
    empty = str(tmp_path / "empty")  # what the postings don't name is not verified
    secrets.write_index(table.limit(0), empty)
    assert {s.kind for r in secrets.scan(table, index=empty).collect() for s in r.spans} == {"hex"}


@pytest.mark.parametrize("pattern", ["abcd", "ab?cde", "(foo|barn)x", "[ab]cde+f", "x{3}yz", "a.*bcd", "(?:ab|cd)[0-9]+xyz", "a|", "[a-f]+", "(abc){2,}", "q(abcd|efgh[0-9]*ijk)z"])
def test_trigram_queries_lose_no_match(pattern):
    import itertools
    import random

    query, rng = secrets.trigram_query(pattern), random.Random(1)
    letters = sorted(set(re.sub(r"[^a-z0-9]", "", pattern)) | {"0"})
    texts = ["".join(rng.choices(letters, k=12)) for _ in range(3000)] + ["".join(x) for x in itertools.product(["foo", "barn", "abcd", "abc", "abcde", "acde", "efgh", "ijk", "xyz", "x", "q", "z", "3"], repeat=3)]
    numbers, cuts, places = secrets.postings(texts)
    by_number = {n: places[a:b] for n, a, b in zip(numbers.tolist(), cuts, cuts[1:])}
    found = {t: np.isin(np.arange(len(texts)), by_number.get(secrets.number_of(t), [])) for t in secrets.trigrams(query)}
    for t, own in found.items():
        assert own.tolist() == [t in x.lower().encode() for x in texts]
    may = secrets.holds(query, found, len(texts))
    for i, t in enumerate(texts):
        if re.search(pattern, t):
            assert may[i]


def test_rules_without_trigrams_scan_fully():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert b"pas" in secrets.trigrams(secrets.trigram_query(secrets.BASE[0].pattern))
