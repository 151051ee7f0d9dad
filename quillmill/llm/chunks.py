"""Encoding by chunks between single spaces, with a bounded cache of what a chunk encodes to.

The pre-token pattern never lets a space be inside or at the end of a token that starts with
something else, and a run of white space is split only before its last character. So a space
with no white space on either side always starts a token, and what lies between two such
spaces is encoded on its own. Most chunks are words seen before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: At least what Python takes for white space, in the regular expressions of Arrow.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
#: Texts with white space beside a space or at the end, which a split at each space would cut wrongly.
OPEN = f"{BLANK} | {BLANK}|{BLANK}$"
#: Bytes of a cache, what an entry takes besides its characters, and characters of the longest one.
ROOM, ENTRY, LONGEST = 40_000_000, 200, 200

_built: dict[tuple[object, ...], object] = {}


def ship(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """A vocabulary file (a few MB at most) for the tasks, so that executors need not have it; and its digest."""
    data = Path(path).read_bytes()
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def once(key: tuple[object, ...], build: Callable[[], object]) -> object:
    """What ``build`` makes, kept for later tasks of this Python worker."""
    if key not in _built:
        _built[key] = build()
    return _built[key]


class _OpenEnded(Exception):
    """A chunk with white space at an end: the text needs more than a split at single spaces."""


class _Known(dict[str, bytes]):
    """Chunk -> code of a space and the chunk; what is missing is encoded.

    About ``room`` bytes are held. Frequent chunks are met early, so a full cache stays as it is;
    once it has missed three times what it holds, it starts anew.
    """

    def __init__(self, encode_one: Callable[[str], bytes], room: int) -> None:
        super().__init__()
        self.encode_one, self.room = encode_one, room
        self.held = self.missed = 0

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _OpenEnded
        code = self.encode_one(" " + chunk)
        if self.held < self.room:
            if len(chunk) <= LONGEST:
                self.held += len(chunk) + len(code) + ENTRY
                self[chunk] = code
        else:
            self.missed += 1
            if self.missed > 3 * len(self):
                self.clear()
                self.held = self.missed = 0
        return code


class ChunkEncoder:
    """Each text's bytes (its ids, say), where ``encode_one`` gives those of a part of it."""

    def __init__(self, encode_one: Callable[[str], bytes], room: int = ROOM) -> None:
        self.encode_one, self.known = encode_one, _Known(encode_one, room)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and first and first[-1].isspace():
            return self._spaced(text)
        try:
            return self.encode_one(first) + b"".join(map(self.known.__getitem__, rest))
        except _OpenEnded:
            return self._spaced(text)

    def _spaced(self, text: str) -> bytes:
        first, *rest = SAFE_SPACE.split(text)
        if not rest:
            return self.encode_one(first)
        last = rest.pop()
        return self.encode_one(first) + b"".join(map(self.known.__getitem__, rest)) + self.encode_one(" " + last)


class Codes:
    """Codes of texts, many at a time; those that are not known are encoded, together and once.

    About ``room`` bytes are held; a full cache is treated like that of ``ChunkEncoder``.
    """

    def __init__(self, room: int = ROOM) -> None:
        self.room = room
        self.known: dict[str, bytes] = {}
        self.held = self.missed = 0

    def of(self, distinct: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Codes of distinct texts."""
        texts = distinct.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        codes = list(map(self.known.get, texts))
        new = [i for i, code in enumerate(codes) if code is None]
        for i, code in zip(new, encode([texts[i] for i in new]), strict=True):
            codes[i] = code
            if self.held < self.room and len(texts[i]) <= LONGEST:
                self.held += len(texts[i]) + len(code) + ENTRY
                self.known[texts[i]] = code
        if self.held >= self.room:
            self.missed += len(new)
            if self.missed > 3 * len(self.known):
                self.known.clear()
                self.held = self.missed = 0
        return codes


def joined_runs(codes: pa.Array, places: pa.Array, ends: np.ndarray) -> pa.Array:
    """A code for each run of places, from those at them; ``ends`` are the ends of runs, 0 before the first."""
    if not len(places):
        return pa.array([b""] * (len(ends) - 1), pa.large_binary())
    taken = codes.take(places)
    _, offsets, data = taken.buffers()
    own = np.frombuffer(offsets, np.int64)[ends]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(own), data])


def encode_all(texts: pa.Array, encode: Callable[[pa.Array], pa.Array], end: bytes = b"") -> pa.Array:
    """Each text's bytes, and ``end`` after them, for many texts at once; null texts are empty.

    ``encode`` gives those of an array of parts of texts; it gets each distinct chunk once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    opened = pc.match_substring_regex(texts, OPEN)
    split = pc.split_pattern(texts.filter(pc.invert(opened)), " ")
    cuts = split.offsets.to_numpy()
    inner = np.ones(len(split.values), bool)
    inner[cuts[:-1]] = False
    firsts, chunks, lasts, counts = [], [], [""] * len(split), (np.diff(cuts) - 1).tolist()
    for text in texts.filter(opened).to_pylist():
        first, *rest = SAFE_SPACE.split(text)
        lasts.append(" " + rest.pop() if rest else "")
        firsts.append(first)
        chunks += rest
        counts.append(len(rest))
    all_firsts = pa.concat_arrays([split.values.take(pa.array(cuts[:-1])), pa.array(firsts, pa.large_string())])
    distinct = pa.concat_arrays([split.values.filter(pa.array(inner)), pa.array(chunks, pa.large_string())]).dictionary_encode()
    nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    spaced = pc.binary_join_element_wise(nothing, distinct.dictionary, space)
    codes = encode(pa.concat_arrays([spaced, all_firsts, pa.array(lasts, pa.large_string())]))

    n, m, count = len(texts), len(spaced), np.array(counts, np.int64)
    is_open = opened.to_numpy(zero_copy_only=False)
    order = np.r_[np.flatnonzero(~is_open), np.flatnonzero(is_open)]  # of firsts, chunks and lasts
    size = np.empty(n, np.int64)
    size[order] = count + 3
    ends = np.r_[0, np.cumsum(size)]
    start, places = ends[order], np.empty(ends[-1], np.int64)
    places[np.repeat(start + 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())] = distinct.indices.to_numpy()
    places[start] = m + np.arange(n)
    places[start + count + 1] = m + n + np.arange(n)
    places[start + count + 2] = m + 2 * n
    return joined_runs(pa.concat_arrays([codes, pa.array([end], pa.large_binary())]), pa.array(places), ends)
