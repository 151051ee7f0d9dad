"""Helpers that the llm operators share: scratch tables, ranges of words and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.names import fresh
from quillmill.sources.scratch import discard, scratch_path, until_exit  # noqa: F401  operators take them from here

#: A word is a run of anything but ASCII white space, as in ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space, for ``translate``.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Bytes of text that Python functions take at once.
AT_ONCE = 2_000_000
#: Bytes of an Arrow batch of texts, where the session keeps Spark's own limit of 64 MB.
BATCH_BYTES = 8_000_000
#: Bits of the filter for rows to be looked up, as powers of two: 16 for each, and at most 16 MB.
LEAST_BITS, MOST_BITS = 15, 27


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(column: pa.Array) -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def give_back() -> None:
    """At a task's end: what this Python worker holds without need goes back, where the C library can do that."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about so many bytes of text, so that Python only holds few texts at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    run = (np.cumsum(sizes) - sizes) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches get a limit of ``BATCH_BYTES`` in this session, unless it has set one of its own.

    Texts are taken in slices of ``AT_ONCE`` bytes anyhow; larger batches only fill executors, once in
    the JVM and once in Python for each task. The setting stays, as results are computed later.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == f"{64 << 20}b":
        spark.conf.set(limit, f"{BATCH_BYTES}b")


def by_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterable[dict[str, object]]], text: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``mapInArrow`` over batches, where ``fn`` yields columns by name in the order of ``schema``.

    With ``text``, the place of a column of texts, ``fn`` gets slices of about ``at_once`` bytes of it.
    """
    if text is not None:
        bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in [batch] if text is None else slices(batch, text, at_once):
                    for columns in fn(part):
                        yield pa.RecordBatch.from_pydict(columns)
                pa.default_memory_pool().release_unused()  # the worker goes on, and shares its executor's memory
        give_back()

    return df.mapInArrow(run, schema)


def split_by(df: DataFrame, key: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of ``members``, rows that surely have none), without a shuffle of ``df``.

    ``members`` is a written table with a column key. A Bloom filter of one hash, 16 bits a
    member and 16 MB at most, is broadcast; beyond, more rows may be among the former.
    """
    bits = min(max(LEAST_BITS, (16 * max(1, members.count()) - 1).bit_length()), MOST_BITS)

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << bits))

    of_member = members.select(place(F.col("key")).alias("place"))
    bucket, map_, own_bucket = (fresh(df, x) for x in ("bucket", "bit_map", "own_bucket"))
    maps = of_member.groupBy(F.bitmap_bucket_number("place").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(map_))
    own = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(map_), (F.floor(own / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte.cast("long"), (own % 8).cast("int")) == 1, F.lit(False))
    joined = df.withColumn(own_bucket, F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), F.col(own_bucket) == F.col(bucket), "left")
    return tuple(joined.filter(x).select(*[f"`{c}`" for c in df.columns]) for x in (there, ~there))
