"""License scans by fuzzy search of short notices (operator 12).

A notice is a short phrase that may stand in a text with up to ``errors`` edits (characters inserted,
dropped or changed), from the beginning of a word to the end of one. By the pigeonhole
principle, a notice cut into ``errors + 1`` pieces has at least one piece there unchanged: an
automaton of all pieces finds these seeds in one pass. Around each seed lies the only stretch in
which its notice can be; the regex library's matching with a bounded number of errors verifies it
and says where the best match is, and how many edits it has.

Texts are compared as words in ASCII lower case, joined by single spaces; spans are those of the text
itself. Each text is searched whole, by the task that reads it: nothing is shuffled or gathered.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillmill.llm.common import by_arrow, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}
#: The bytes that part words once letters are small: any ASCII but letters and digits.
_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Phrases that the base rule takes, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Notice:
    """A phrase of a license, and the edits in which a text may differ from it; its first ``fixed`` words may not."""

    label: str
    phrase: str
    errors: int
    fixed: int = 0

    def __post_init__(self) -> None:
        if len(self.phrase) <= 4 * self.errors:
            raise ValueError(f"{self.errors} edits are too many for {self.phrase!r}: two matches would fit one's place")

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """(place, piece): ``errors + 1`` pieces of the phrase, of which a match holds at least one unchanged; with fixed words, these."""
        if self.fixed:
            return [(0, " ".join(self.phrase.split(" ")[: self.fixed]) + " ")]
        cuts = [len(self.phrase) * k // (self.errors + 1) for k in range(self.errors + 2)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]

    def compiled(self) -> regex.Pattern[str]:
        words = self.phrase.split(" ")
        fixed, rest = "".join(w + " " for w in words[: self.fixed]), " ".join(words[self.fixed :])
        return regex.compile(rf"(?b){regex.escape(fixed)}(?:{regex.escape(rest)}){{e<={self.errors}}}(?![^ ])")


#: Notices that the scan adds to the base phrases: the same with edits, and others.
NOTICES = (
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "apache license", 2),
    Notice("mit", "mit license", 1, fixed=1),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc0", "creative commons zero", 2),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("isc", "permission to use copy modify and or distribute this software", 4),
)

Match = tuple[str, int, int, int, int]


@cache
def _seeds(notices: tuple[Notice, ...]) -> tuple[ahocorasick.Automaton, list[regex.Pattern[str]]]:
    by_piece: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, notice in enumerate(notices):
        for place, piece in notice.pieces:
            by_piece[piece].append((k, place))
    automaton = ahocorasick.Automaton()
    for piece, owners in by_piece.items():
        automaton.add_word(piece, (len(piece), owners))
    automaton.make_automaton()
    return automaton, [n.compiled() for n in notices]


def windows(text: str, notices: tuple[Notice, ...] = NOTICES) -> dict[int, set[tuple[int, int]]]:
    """For each notice with a seed, where it can be in a text of spaced words: beginnings of words near the seed's, each with the last end of a word in reach."""
    automaton, _ = _seeds(notices)
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for last, (length, owners) in automaton.iter(text):
        for k, place in owners:
            n, errors = len(notices[k].phrase), notices[k].errors
            begin = last + 1 - length - place
            for a in range(max(0, begin - errors), max(0, begin + errors + 1)):
                if a == 0 or text[a - 1] == " ":
                    b = min(len(text), a + n + errors)
                    b = b if b == len(text) or text[b] == " " else text.rfind(" ", a, b)
                    if b - a >= n - errors:
                        found[k].add((a, b))
    return found


def find_notices(text: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in a text of spaced words, by place; of overlapping matches of a notice, the one of fewest edits."""
    _, patterns = _seeds(notices)
    out = []
    for k, own in windows(text, notices).items():
        matches = [(m, a) for a, b in own if (m := patterns[k].match(text[a:b]))]
        chosen: list[tuple[int, int]] = []
        for edits, start, end in sorted({(sum(m.fuzzy_counts), a + m.start(), a + m.end()) for m, a in matches}):
            at = bisect_right(chosen, (start, end))
            if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or end <= chosen[at][0]):
                insort(chosen, (start, end))
                out.append((k, start, end, edits))
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def spaced(text: str) -> tuple[int, str]:
    """Number of words of a text, and the words in ASCII lower case, joined by single spaces."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
    return len(words), b" ".join(words).decode("utf-8", "surrogatepass")


def base_places(text: str, phrases: tuple[tuple[str, str], ...] = BASE) -> list[tuple[int, int, str]]:
    """(start, end, label) of all places in a text of spaced words where a phrase's words stand one after the other."""
    padded, out = f" {text} ", []
    for phrase, label in phrases:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, at + len(phrase), label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


@dataclass(frozen=True)
class Found:
    """What one text has; spans are (label, start, end, edits) in its own code points."""

    n_words: int
    first_words: list[int]
    base_labels: list[str]
    labels: list[str]
    score: float
    spans: list[Match]


def scan_text(text: str, notices: tuple[Notice, ...] = NOTICES) -> Found:
    n_words, joined = spaced(text)
    base = base_places(joined)
    fuzzy = find_notices(joined, notices)
    if not base and not fuzzy:
        return Found(n_words, [], [], [], 0.0, [])
    matches = {(a, b, label): 0 for a, b, label in base}
    for k, a, b, edits in fuzzy:
        key = (a, b, notices[k].label)
        matches[key] = min(edits, matches.get(key, edits))
    places = [m.span() for m in WORD.finditer(text.translate(SMALL))]
    spans = []
    for (a, b, label), edits in sorted(matches.items()):
        first = joined.count(" ", 0, a)
        spans.append((label, places[first][0], places[first + joined.count(" ", a, b)][1], edits))
    score = 1.0 if base else max(1 - edits / len(notices[k].phrase) for k, _, _, edits in fuzzy)
    starts = sorted(joined.count(" ", 0, a) for a, _, _ in base[:: max(1, len(base) - 1)])
    base_labels = {label for _, _, label in base}
    return Found(n_words, [starts[0], starts[-1], len(base)] if base else [], sorted(base_labels), sorted(base_labels | {m[2] for m in matches}), score, spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(id, labels array<string>, score, spans array<struct<label, start, end, edits>>) of each row.

    Spans are in code points, by place; the base phrases' are among them. ``score`` is one for a base phrase, else the
    share of the best match's characters that need no edit, or zero. Null and empty texts have
    nothing; rows are independent, and repeated rows stay.
    """
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        found = [scan_text(t, notices) for t in texts_of(batch.column(1))]
        spans = [[dict(zip(("label", "start", "end", "edits"), s)) for s in f.spans] for f in found]
        yield {id_col: batch.column(0), "labels": pa.array([f.labels for f in found], pa.list_(pa.string())), "score": pa.array([f.score for f in found], pa.float64()), "spans": pa.array(spans, span)}

    schema = f"`{id_col}` {kind}, labels array<string>, score double, spans array<struct<label: string, start: int, end: int, edits: int>>"
    return by_arrow(df.select(f"`{id_col}`", f"`{text_col}`"), schema, run, text=1)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row; labels are joined by commas."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        found = [scan_text(t, notices) for t in texts_of(batch.column(1))]
        first, last, n = ([f.first_words[k] if f.first_words else None for f in found] for k in range(3))
        yield {
            id_col: batch.column(0),
            "n_words": pa.array([f.n_words for f in found], pa.int64()),
            "n_base": pa.array([x or 0 for x in n], pa.int64()),
            "first_word": pa.array(first, pa.int64()),
            "last_word": pa.array(last, pa.int64()),
            "base_labels": pa.array([",".join(f.base_labels) for f in found], pa.string()),
            "labels": pa.array([",".join(f.labels) for f in found], pa.string()),
            "score": pa.array([f.score for f in found], pa.float64()),
            "spans": pa.array([",".join(f"{label}:{a}:{b}:{edits}" for label, a, b, edits in f.spans) for f in found], pa.string()),
        }

    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return by_arrow(df.select(f"`{id_col}`", f"`{text_col}`"), schema, run, text=1)
