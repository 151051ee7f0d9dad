"""Byte-level BPE by a serialised sentencepiece model (operator 7).

A vocabulary of byte strings with ranks becomes a sentencepiece BPE model without any
training: every byte is mapped to a printable character, each piece is the mapped string and
its score the negative rank, so that the merge of lowest rank goes first; the normalisation is
the identity. Texts are cut into pre-tokens, the mapped pre-tokens are encoded, and ids are
decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame

from quillmill.llm.chunks import ChunkEncoder, once, ship
from quillmill.llm.common import by_arrow, texts_of

#: Columns that can be asked for, with their types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_characters() -> list[str]:
    """The printable character of each byte: its own if that is visible, else the next from U+0100 on."""
    visible = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if visible[b] else chr(256 + visible[:b].count(False)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value & 0xFFFFFFFFFFFFFFFF)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes last.

    Field numbers are those of the public sentencepiece_model.proto.
    """
    of_byte = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, "".join([of_byte[b] for b in t]).encode()) + _field(2, -float(r))) for r, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(tokens)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of a rank file and a pre-token pattern."""

    def __init__(self, data: bytes, pattern: str) -> None:
        ranks = read_ranks(data)
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        # white space as Unicode has it, without the four separators that Python adds
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.mapped = dict(enumerate(byte_characters()))
        self.chunks = ChunkEncoder(self._code)

    def _code(self, text: str) -> bytes:
        parts = [text] if text[text[:1] == " " :].isalpha() else self.pattern.findall(text)
        ids = array("I")
        for part in parts:
            ids.extend(self.pieces.EncodeAsIds(part.encode("utf-8", "replace").decode("latin-1").translate(self.mapped)))
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.chunks.encode(text), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, outputs...) of each row: see ``OUTPUTS``. ``decoded`` comes from the ids alone.

    A null text is encoded as the empty one: no ids, the digest of nothing. Texts are taken
    whole; rows are independent, so repeated ones give repeated results. ``keep`` names columns
    to pass through.
    """
    digest, shipped = ship(df.sparkSession, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    passed = (id_col, *keep)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed), *(f"{o} {OUTPUTS[o]}" for o in outputs)])

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        bpe = once(("bpe", digest, pattern), lambda: ByteBpe(shipped.value, pattern))
        columns: dict[str, list[object]] = {o: [] for o in outputs}
        for text in texts_of(batch.column(len(passed))):
            ids = bpe.encode(text)
            listed = ids.tolist()
            decoded = bpe.decode(listed) if "decoded" in columns or "decoded_sha256" in columns else b""
            for o, out in columns.items():
                if o == "n_tokens":
                    out.append(len(listed))
                elif o == "ids":
                    out.append(ids.view("<i4"))
                elif o == "decoded":
                    out.append(decoded)
                elif o == "ids_sha256":
                    out.append(hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest())
                else:
                    out.append(hashlib.sha256(decoded).hexdigest())
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
        yield {c: batch.column(k) for k, c in enumerate(passed)} | {o: pa.array(v, types.get(o, pa.string())) for o, v in columns.items()}

    return by_arrow(df.select(*[f"`{c}`" for c in passed], f"`{text_col}`"), schema, run, text=len(passed))
