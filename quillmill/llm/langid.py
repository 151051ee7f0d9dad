"""Language identification with spans (operator 5).

Script ranges narrow a word's candidate languages to those seen in its script. Each word has a
score per language, the sum of log probabilities of its hashed character n-grams; Viterbi with
a switching penalty then labels the words, so that text of several languages falls into spans.
A document's language is the one with the most letters.

The model is fitted on a bounded sample of labelled rows; counts are summed by Spark, and only
languages x buckets numbers reach the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import by_arrow, texts_of

#: Labelled rows that the model is fitted on, about; all if there are fewer.
SAMPLE_ROWS = 20_000
#: Hashed n-grams of two and of three characters.
BITS = {2: 13, 3: 16}
#: Cost of changing the language between two words, in nats.
PENALTY = 12.0
#: Characters scored at once, and words x languages decoded at once.
AT_ONCE, CELLS = 500_000, 8_000_000
UNDETERMINED = "und"
#: First and last code point of scripts; other letters count as Latin.
SCRIPTS = (
    ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("hangul", 0x3130, 0x318F), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF),
    ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ["latin", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
_tables: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case if it is a letter, else 0; its script."""
    if not _tables:
        lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for c in [*range(0xD800), *range(0xE000, 0x20000)]:
            if (x := chr(c)).isalpha():
                small = x.lower()
                lower[c] = ord(small) if len(small) == 1 else c
        lower[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = SCRIPT_NAMES.index(name)
        _tables.extend((lower, script))
    return _tables[0], _tables[1]


@dataclass
class Words:
    """Words (runs of letters) of joined texts, and the n-gram buckets at each of their positions."""

    starts: np.ndarray  # in characters of the joined texts
    lengths: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    cuts: np.ndarray  # first feature of each word
    grams: dict[int, np.ndarray]
    begins: np.ndarray  # of the texts


def words_of(texts: list[str]) -> Words:
    lower, script = _characters()
    points = np.frombuffer("\n\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum([2, *(len(t) + 2 for t in texts)])[:-1]
    small = lower[points]
    letter = small != 0
    before = np.r_[False, letter[:-1]]
    first = np.flatnonzero(letter & ~before)
    lengths = np.flatnonzero(~letter & before) - first
    at = np.flatnonzero(letter | before)  # letters, and the place after each word
    c, b = small[at], small[at - 1]
    a = np.where(b == 0, np.uint32(0), small[at - 2])
    grams = {
        2: (b * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS[2]),
        3: (a * np.uint32(0xC2B2AE35) + b * np.uint32(0x9E3779B1) + c * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS[3]),
    }
    cuts = np.cumsum(lengths + 1) - lengths - 1
    doc = np.searchsorted(begins, first, side="right") - 1
    return Words(first, lengths, doc, script[points[first]], cuts, grams, begins)


@dataclass
class Model:
    languages: list[str]
    tables: dict[int, np.ndarray]  # n -> buckets x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def _blocks(texts: list[str], at_once: int) -> Iterator[tuple[int, int]]:
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= at_once or i == len(texts) - 1:
            yield a, i + 1
            a, held = i + 1, 0


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of (id, text, lang) rows; those with a null label, a null text or the label ``und`` are left out.

    About ``sample_rows`` of them are drawn by a hash of the id: the documented bound of the fit.
    """
    labelled = labelled.filter((F.col("lang") != UNDETERMINED) & F.col("text").isNotNull())
    n = labelled.count()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list[np.ndarray]] = {"lang": [], "kind": [], "bucket": [], "n": []}
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs) if x == lang]
            counts = {k: np.zeros(1 << b, np.int64) for k, b in BITS.items()} | {0: np.zeros(len(SCRIPT_NAMES), np.int64)}
            for a, b in _blocks(own, AT_ONCE):
                words = words_of(own[a:b])
                for k in BITS:
                    counts[k] += np.bincount(words.grams[k], minlength=1 << BITS[k])
                counts[0] += np.bincount(words.script, minlength=len(SCRIPT_NAMES))
            for kind, x in counts.items():
                there = np.flatnonzero(x)
                for name, value in (("lang", np.full(len(there), lang, object)), ("kind", np.full(len(there), kind)), ("bucket", there), ("n", x[there])):
                    out[name].append(value)
        yield {"lang": pa.array(np.concatenate(out["lang"]), pa.string())} | {c: pa.array(np.concatenate(out[c]), pa.int64()) for c in ("kind", "bucket", "n")}

    counted = by_arrow(labelled.filter(drawn).select("text", "lang"), "lang string, kind long, bucket long, n long", run, text=0, at_once=16_000_000)
    summed = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique())
    tables = {k: np.full((1 << b, len(languages)), 0.5) for k, b in BITS.items()}
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for (lang, kind), own in summed.groupby(["lang", "kind"]):
        (tables[kind] if kind else scripts)[own["bucket"].to_numpy(), languages.index(lang)] += own["n"].to_numpy()
    logs = {k: np.log(x / x.sum(axis=0)).astype(np.float32) for k, x in tables.items()}
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(languages, logs, share >= 0.01)


def scores_of(words: Words, model: Model) -> np.ndarray:
    """Words x languages; a language not seen in a word's script is out, unless that holds for all."""
    if not len(words.cuts):
        return np.zeros((0, len(model.languages)), np.float32)
    each = sum(model.tables[k][words.grams[k]] for k in BITS)
    scores = np.add.reduceat(each, words.cuts, axis=0)
    allowed = model.allowed | ~model.allowed.any(axis=1, keepdims=True)
    return np.where(allowed[words.script], scores, np.float32(-1e9))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word, for documents of ``sizes`` words side by side; ties take the first language."""
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents with over t words
    stay = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int16)
    held = np.zeros((len(lengths), scores.shape[1]), np.float64)
    for t in range(longest):
        n = active[t]
        at, own = starts[:n] + t, held[:n]
        if t:
            best = own.max(axis=1) - penalty
            came[at] = own.argmax(axis=1)
            stay[at] = own >= best[:, None]
            own = np.maximum(own, best[:, None])
        held[:n] = own + scores[at]
    labels = np.zeros(len(scores), np.int16)
    now = held.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], came[at])
    return labels


def identify_texts(texts: list[str], model: Model, penalty: float = PENALTY, spans: bool = True) -> tuple[list[str], list[float], list[list[dict[str, object]] | None]]:
    """Language, share of letters in it, and spans of each text."""
    langs, shares, found = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] if spans else None for _ in texts]
    n_langs = len(model.languages)
    if not n_langs:
        return langs, shares, found
    for a, b in _blocks(texts, max(AT_ONCE, CELLS // n_langs * 4)):
        parts = []  # without the n-grams, which are by far the largest
        for i, j in _blocks(texts[a:b], AT_ONCE):
            w = words_of(texts[a + i : a + j])
            parts.append((scores_of(w, model), (w.doc + i).astype(np.int32), w.lengths.astype(np.int32), (w.starts - w.begins[w.doc]).astype(np.int32) if spans else None))
        scores, doc, lengths = (np.concatenate([p[k] for p in parts]) for k in range(3))
        labels = viterbi(scores, np.bincount(doc, minlength=b - a), penalty)
        letters = np.bincount(doc.astype(np.int64) * n_langs + labels, lengths, minlength=(b - a) * n_langs).reshape(b - a, n_langs)
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        for i in np.flatnonzero(total):
            langs[a + i], shares[a + i] = model.languages[best[i]], float(letters[i, best[i]] / total[i])
        if spans:
            place = np.concatenate([p[3] for p in parts])
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])]) if len(doc) else []
            for k, stop in zip(new, [*new[1:], len(doc)]):
                found[a + doc[k]].append({"start": int(place[k]), "end": int(place[stop - 1] + lengths[stop - 1]), "lang": model.languages[labels[k]]})
    return langs, shares, found


def lettered(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a letter, as ``words_of`` knows them; a null text has none."""

    @F.pandas_udf("boolean")
    def any_letter(texts: pd.Series) -> pd.Series:
        lower, _ = _characters()
        return texts.map(lambda t: bool(lower[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")].any()))

    return df.filter(any_letter(text_col))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, penalty: float = PENALTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score, spans) of each row; spans are code points, end exclusive, of equal labels.

    A null text or one without a letter is ``und`` with score 0 and no span; so is every text if
    the model knows no language. Rows are independent of each other.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    passed = (id_col, *keep)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        langs, scores, found = identify_texts(texts_of(batch.column(len(passed))), shipped.value, penalty, spans)
        own = {c: batch.column(i) for i, c in enumerate(passed)}
        yield own | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(found, span)}

    schema = f"{kinds}, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
    return by_arrow(df.select(*[f"`{c}`" for c in passed], f"`{text_col}`"), schema, run, text=len(passed))
