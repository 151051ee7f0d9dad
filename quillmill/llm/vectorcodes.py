"""Vector code compression by product codes over value dictionaries (operator 11).

Integer vectors are cut into equal parts, each with a codebook of entries, and a vector's code names
the nearest entry of each part. Vectors are stored once as blocks: for every dimension of a
block, the dictionary of its distinct integers, and each vector's places in it. Against a
codebook, the squared differences of every distinct integer to all entries are tabulated once a
block; the distances of a part are then rows gathered from its dimensions' tables and added.

A block has at most ``BLOCK`` vectors, and so its dictionaries are bounded whatever the values
are. Codebooks have ``entries`` x width integers whatever the input is; they alone, and the sums
and counts of their members, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.names import fresh
from quillmill.llm.common import materialize

BLOCK = 4096
#: Labels whose sums are broadcast at most; more are joined by a shuffle, where large ones are split.
BROADCAST_LABELS = 100_000
#: Magnitude of a component at most, so that sums of squared differences fit 64 bits.
LARGEST = 1 << 26
STORED = "ids binary, n int, values array<binary>, places array<binary>"


@dataclass(frozen=True)
class Codebooks:
    """``entries``: an integer matrix of entries x padded width; columns of part ``p`` are ``p * step`` to ``(p + 1) * step``."""

    entries: np.ndarray
    parts: int

    @property
    def step(self) -> int:
        return self.entries.shape[1] // self.parts

    def of_part(self, part: int) -> np.ndarray:
        return self.entries[:, part * self.step : (part + 1) * self.step]

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and position, joined by commas."""
        numbers = [str(x) for p in range(self.parts) for x in self.of_part(p).reshape(-1).tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; null if the vector is null or a component is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("bigint")))


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Integer rows of ``width`` components; what a shorter vector lacks is zero."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def dictionaries(vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each dimension its distinct values, sorted, and the vectors' places in them."""
    found = [np.unique(column, return_inverse=True) for column in vectors.T]
    return [values for values, _ in found], [places.astype("<u2") for _, places in found]


def nearest(values: list[np.ndarray], places: list[np.ndarray], books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both vectors x parts, by gathers from tables over the dictionaries; ties to the lower entry."""
    n = len(places[0]) if places else 0
    codes, errors = np.zeros((n, books.parts), np.uint8), np.zeros((n, books.parts), np.int64)
    for part in range(books.parts):
        distance = np.zeros((n, len(books.entries)), np.int64)
        for d in range(part * books.step, (part + 1) * books.step):
            table = (values[d][:, None] - books.entries[:, d]) ** 2
            distance += table[places[d]]
        codes[:, part] = distance.argmin(axis=1)
        errors[:, part] = distance[np.arange(n), codes[:, part]]
    return codes, errors


def _unpacked(values: list[bytes], places: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(v, "<i8") for v in values], [np.frombuffer(p, "<u2") for p in places]


class Blocks:
    """Vectors written once as blocks of dictionaries and places: ids are row numbers of ``rows``."""

    def __init__(self, rows: DataFrame, parts: int) -> None:
        width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        self.width = width = max(parts, -(-width // parts) * parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(a, BLOCK)
                    vectors = padded(some.column(1).to_numpy(zero_copy_only=False), width)
                    if len(vectors) and np.abs(vectors).max() > LARGEST:
                        raise ValueError(f"components over {LARGEST} after scaling: their squared distances may not fit 64 bits")
                    values, places = dictionaries(vectors)
                    columns = [[some.column(0).to_numpy().astype("<i8").tobytes()], [len(vectors)], [[v.astype("<i8").tobytes() for v in values]], [[p.tobytes() for p in places]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())))], ["ids", "n", "values", "places"])

        self.table = materialize(rows.select("row", "v").mapInArrow(run, STORED), "vector-blocks")

    def moved(self, books: Codebooks) -> Codebooks:
        """One round: each entry becomes the floor of its members' mean, by component; an entry without members stays."""
        step, size = books.step, books.entries.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(size, np.int64), np.zeros((books.parts, size[0]), np.int64)
            for batch in batches:
                for packed in batch.to_pylist():
                    values, places = _unpacked(packed["values"], packed["places"])
                    codes, _ = nearest(values, places, books)
                    for part in range(books.parts):
                        counts[part] += np.bincount(codes[:, part], minlength=size[0])
                        for d in range(part * step, (part + 1) * step):
                            sums[:, d] += np.bincount(codes[:, part], values[d][places[d]], size[0]).astype(np.int64)  # exact: below 2 ** 53
            entry, dim = np.nonzero(np.repeat(counts.T, step, axis=1))
            yield pa.RecordBatch.from_pydict({"dim": pa.array(dim, pa.int32()), "entry": pa.array(entry, pa.int32()), "total": pa.array(sums[entry, dim]), "n": pa.array(counts[dim // step, entry])})

        members = self.table.mapInArrow(run, "dim int, entry int, total long, n long")
        sums = members.groupBy("dim", "entry").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        entries = books.entries.copy()
        for r in sums.collect():  # a row for each component of the codebooks
            entries[r.entry, r.dim] = int(r.total) // r.n
        return Codebooks(entries, books.parts)

    def coded(self, books: Codebooks) -> DataFrame:
        """(row, codes binary, error) of each vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.to_pylist():
                    codes, errors = nearest(*_unpacked(packed["values"], packed["places"]), books)
                    yield pa.RecordBatch.from_pydict({"row": pa.array(np.frombuffer(packed["ids"], "<i8")), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(errors.sum(axis=1))})

        return self.table.mapInArrow(run, "row long, codes binary, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "v", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks]:
    """``df`` without its vectors, with codes (a byte a part) and error (squared distance), and the codebooks.

    ``vector_col`` is array<bigint>; rows whose vector is null or holds a null take no part. The first
    ``entries`` (256 at most) rows by id, null ids last, then by vector, are the first codebooks; with fewer
    rows there are fewer entries. Rows that repeat an id are rows of their own. The width is the longest
    vector's, up to a multiple of ``parts``: what a vector lacks is zero. Components must not
    exceed ``LARGEST``. An empty table gives no rows. Columns named codes or error are replaced.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    row = fresh(df, "row")
    kept = df.filter(F.col(vector_col).isNotNull() & ~F.exists(vector_col, F.isnull))
    rows = materialize(kept.withColumn(row, F.monotonically_increasing_id()), "vector-rows")
    blocks = Blocks(rows.select(F.col(row).alias("row"), F.col(vector_col).alias("v")), parts)
    first = rows.orderBy(F.asc_nulls_last(id_col), vector_col).select(vector_col).limit(entries).collect()
    books = Codebooks(padded([r[0] for r in first], blocks.width), parts)
    if first:
        for _ in range(rounds):
            books = blocks.moved(books)
    others = [f"`{c}`" for c in df.columns if c.lower() not in (vector_col.lower(), "codes", "error")]
    coded = blocks.coded(books).withColumnRenamed("row", row)
    return rows.select(row, *others).join(coded, row).select(*others, "codes", "error"), books


def decode(df: DataFrame, books: Codebooks, codes_col: str = "codes") -> DataFrame:
    """``df`` with decoded, array<bigint>: the codebooks' entries that its codes name. Null codes give null."""
    name, names = fresh(df, "decoded"), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(names.index(codes_col)).to_pylist()
            vectors = [None if c is None else np.concatenate([books.of_part(p)[e] for p, e in enumerate(c)]) for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.int64()))], [*names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast("array<bigint>")).schema)


def with_label_error(df: DataFrame, label_col: str = "label", name: str = "label_error") -> DataFrame:
    """``df`` with the errors summed over rows of an equal label, nulls being one; sums are made before rows meet them."""
    other = fresh(df, "of_label")
    sums = materialize(df.groupBy(F.col(label_col).alias(other)).agg(F.sum("error").alias(name)), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return df.join(sums, F.col(label_col).eqNullSafe(F.col(other))).drop(other)


def hex_codes(codes: Column) -> Column:
    return F.lower(F.hex(codes))
