"""Operator 12: base phrases against the contract, fuzzy notices against edit distances of all runs of words."""

from __future__ import annotations

import random
import re

import pytest

from quillmill.llm import licenses
from quillmill.llm.licenses import BASE, NOTICES, Notice
from quillmill.llm.queries import op12_licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_base(text):
    """(n_words, n_base, first, last, labels) by comparing words."""
    words = re.findall(WORD, lowered(text))
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_best(text, notice):
    """The fewest edits of any run of whole words that is close enough, or None."""
    words, best = re.findall(WORD, lowered(text)), None
    head = notice.phrase.split(" ")[: notice.fixed]
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            run = " ".join(words[i:j])
            if len(run) > len(notice.phrase) + notice.errors:
                break
            if words[i : i + len(head)] == head and len(run) >= len(notice.phrase) - notice.errors:
                d = distance(" ".join(run.split(" ")[len(head) :]), " ".join(notice.phrase.split(" ")[len(head) :]))
                best = d if d <= notice.errors and (best is None or d < best) else best
    return best


def edited(rng, phrase, edits):
    for _ in range(edits):
        i = rng.randrange(len(phrase))
        phrase = rng.choice((phrase[:i] + phrase[i + 1 :], phrase[:i] + rng.choice("abz é") + phrase[i:], phrase[:i] + rng.choice("xyß") + phrase[i + 1 :]))
    return phrase


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_matches_against_all_runs_of_words(seed):
    rng = random.Random(seed)
    fill = ["und", "mit", "the", "license", "gnu", "cc", "free", "of", "général", "public", "copy", "apache", "x1"]
    for _ in range(60):
        notice = rng.choice(NOTICES)
        parts = [" ".join(rng.choices(fill, k=rng.randrange(6))), edited(rng, notice.phrase, rng.randrange(notice.errors + 3)), "\n-- ".join(rng.choices(fill, k=rng.randrange(4)))]
        text = rng.choice((" ", ".\n", " ("))  # parts meet at what is no word
        text = text.join(p.title() if rng.random() < 0.2 else p for p in parts)
        _, joined = licenses.spaced(text)
        found = {}
        for k, a, b, edits in licenses.find_notices(joined):
            head = len("".join(w + " " for w in NOTICES[k].phrase.split(" ")[: NOTICES[k].fixed]))
            assert distance(joined[a + head : b], NOTICES[k].phrase[head:]) == edits <= NOTICES[k].errors
            assert (not a or joined[a - 1] == " ") and (b == len(joined) or joined[b] == " ")
            found[k] = min(edits, found.get(k, edits))
        assert found == {k: d for k, n in enumerate(NOTICES) if (d := plain_best(text, n)) is not None}, text


def test_many_close_notices_take_linear_time():
    text = "Apache Licence, mit licence; GNU Genral Public License\n" * 5000
    found = licenses.scan_text(text)
    assert found.labels == ["apache", "gpl", "mit"] and len(found.spans) == 15_000 and found.base_labels == [] and 0.9 < found.score < 1


def test_notices_need_room():
    with pytest.raises(ValueError):
        Notice("x", "mit", 1)


def test_query_over_the_tables(spark):
    for folder in ("sf0.001", "sf0.01"):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").collect()}
        rows = op12_licenses(spark, f"/root/testdata/{folder}").collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(docs[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1.0) >= (r.n_base > 0)
            for span in filter(None, r.spans.split(",")):
                label, a, b, edits = span.rsplit(":", 3)
                assert label in r.labels and re.fullmatch(rf"(?s){WORD}(.*{WORD})?", lowered(docs[r.doc_id])[int(a) : int(b)])
        assert sum(r.n_base > 0 for r in rows) and {r.labels for r in rows if not r.n_base} == {""}


def test_edge_cases(spark):
    long = "wörd " * 200_000 + "MIT  License" + " x" * 10
    rows = [(1, None, "a", 1), (2, "", "b", 1), (None, "Licensed: CC-BY, CC BY cc by!", "c", 1), (3, long, None, 1), (3, long, None, 1), (4, "x" * 500_000, "", 2), (5, "apache licens", "", 2), (6, "The GNU\tGeneral PUBLIC licenses", "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score int")
    got = [tuple(r) for r in licenses.digests(df).collect()]
    assert got[:3] == [(1, 0, 0, None, None, "", "", 0.0, ""), (2, 0, 0, None, None, "", "", 0.0, ""), (None, 7, 3, 1, 5, "cc-by", "cc-by", 1.0, "cc-by:10:15:0,cc-by:17:22:0,cc-by:23:28:0")]
    assert got[3] == got[4] == (3, 200_012, 1, 200_000, 200_000, "mit", "mit", 1.0, "mit:1000000:1000012:0")
    assert got[5][1:8] == (1, 0, None, None, "", "", 0.0)
    assert got[6][5:] == ("", "apache", 1 - 1 / 14, "apache:0:13:1") and got[7][5:] == ("", "gpl", 1 - 1 / 26, "gpl:4:31:1")
    assert [tuple(r) for r in licenses.scan(df).select("labels", "score").collect()][2] == (["cc-by"], 1.0)
    assert licenses.digests(df.limit(0)).collect() == []
