"""Near duplicates by SimHash (operator 1).

Every text becomes a 64-bit fingerprint; texts whose fingerprints differ in at most
``radius`` bits are linked, and components of links are groups of near duplicates.

Comparison is bit-sliced. The fingerprints of a candidate block are stored as 64 vertical bit
planes, so that one machine word holds one bit of 64 fingerprints. A query is compared with
64 of them at a time: XOR with each plane in turn, carry-save addition into bitwise counters,
and a word is abandoned once all its 64 distances exceed the radius.

Candidate blocks come from the pigeonhole principle: of ``radius + m`` bit ranges, two
fingerprints within the radius agree in at least ``m``. All ``C(radius + m, m)`` choices are
keys, so no link is lost; ``m`` follows the number of distinct fingerprints and only changes
the size of the blocks. A block over ``TILE`` fingerprints is cut into tiles, and each pair
of tiles is a block. Tasks return spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import by_arrow, discard, materialize, scratch_path

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a block that one task compares at once, and the mean that block keys aim at.
TILE, MEAN_BLOCK = 16_384, 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of ``size`` lower-cased words, repeats included; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts[size - 1 :] + lengths[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]


def fingerprint_texts(texts: list[str | None], size: int = SHINGLE, at_once: int = 1 << 14) -> np.ndarray:
    """Fingerprints (uint64): a bit is set if it is set in over half of a text's shingle hashes."""
    ones = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            held.clear()
            owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, size), "<u8")
        totals[i] = len(hashes)
        for a in range(0, len(hashes), at_once):
            held.append(hashes[a : a + at_once])
            owners.append(i)
            waiting += len(held[-1])
            if waiting >= at_once:
                flush()
                waiting = 0
    flush()
    return np.packbits(ones * 2 > totals[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def bit_planes(fingerprints: np.ndarray) -> np.ndarray:
    """A plane of ceil(n / 64) words for each bit of n fingerprints of one or more words; lane ``i`` is fingerprint ``i``."""
    words = fingerprints.reshape(len(fingerprints), -1)
    padded = np.zeros((-(-len(words) // 64) * 64, words.shape[1]), "<u8")
    padded[: len(words)] = words
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_within(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For pair ``k``, the lanes of plane word ``words[k]`` within ``radius`` bits of ``queries[k]``, as a bit mask."""
    queries = queries.reshape(len(queries), -1)
    out = np.zeros(len(queries), np.uint64)
    alive = np.arange(len(queries))
    counters = [np.zeros(len(queries), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(queries), np.uint64)
    for bit in range(len(planes)):
        carry = planes[bit][words] ^ (np.uint64(0) - ((queries[:, bit >> 6] >> np.uint64(bit & 63)) & ONE))
        for counter in counters:  # carry-save: each counter holds one binary digit of 64 distances
            both = counter & carry
            counter ^= carry
            carry = both
        reached = np.full(len(queries), ALL)
        for digit, counter in enumerate(counters):
            reached &= counter if (radius + 1) >> digit & 1 else ~counter
        over |= reached
        if bit >= radius and bit % 4 == 3:
            live = over != ALL
            if live.mean() < 0.75:
                alive, queries, words, over = alive[live], queries[live], words[live], over[live]
                counters = [c[live] for c in counters]
                if not len(alive):
                    return out
    out[alive] = ~over
    return out


def _small_blocks(fingerprints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of many blocks of 2 to 64 fingerprints; each block fills one plane word."""
    block = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    members = fingerprints[np.repeat(starts, sizes) + place]
    lanes = block * 64 + place
    laid = np.zeros(len(starts) * 64, "<u8")
    laid[lanes] = members
    valid = np.where(sizes == 64, ALL, (ONE << (sizes.astype(np.uint64) & np.uint64(63))) - ONE)
    near = np.zeros(len(laid), np.uint64)
    near[lanes] = lanes_within(members, block, bit_planes(laid), radius) & valid[block]
    linked = np.flatnonzero(np.bitwise_count(near) > 1)
    changed = len(linked) > 0
    while changed:  # closure: a lane takes over what its neighbours reach
        reach = near.copy()
        for lane in range(64):
            have = linked[(near[linked] >> np.uint64(lane)) & ONE == ONE]
            reach[have] |= near[(have & ~63) + lane]
        changed = not np.array_equal(reach, near)
        near = reach
    lowest = np.bitwise_count((near[linked] & (np.uint64(0) - near[linked])) - ONE).astype(np.int64)
    roots = (linked & ~63) + lowest
    away = roots != linked
    return laid[linked[away]], laid[roots[away]]


def _large_block(fingerprints: np.ndarray, radius: int, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of one block of more than 64 fingerprints; each query meets the words from its own on."""
    n = len(fingerprints)
    planes = bit_planes(fingerprints)
    width = planes.shape[1]
    label = np.arange(n)
    for a in range(0, n, at_once):
        queries = fingerprints[a : a + at_once]
        words = np.arange(a // 64, width)
        near = lanes_within(np.repeat(queries, len(words)), np.tile(words, len(queries)), planes, radius).reshape(len(queries), -1)
        for i in np.flatnonzero(np.bitwise_count(near).sum(axis=1) > 1):
            lanes = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little")) + words[0] * 64
            classes = np.unique(label[lanes[lanes < n]])
            if len(classes) > 1:
                label[np.isin(label, classes)] = classes[0]
    away = np.flatnonzero(label != np.arange(n))
    return fingerprints[away], fingerprints[label[away]]


def link_blocks(keys: np.ndarray, fingerprints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges within runs of equal ``keys`` (sorted)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    found = [_small_blocks(fingerprints, starts[part], sizes[part], radius) for part in np.array_split(small, -(-len(small) // 4096) or 1) if len(part)]
    found += [_large_block(fingerprints[starts[i] : starts[i] + sizes[i]], radius) for i in np.flatnonzero(sizes > 64)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp long) of each row. Null, empty and blank texts have fingerprint zero; repeated rows stay."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        yield {"id": batch.column(0), "fp": pa.array(fingerprint_texts(batch.column(1).to_pylist(), size).view("<i8"))}

    return by_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {id_type}, fp long", run, text=1)


def _block_masks(m: int, radius: int) -> list[int]:
    """A mask of kept bits for each choice of ``m`` of ``radius + m`` bit ranges."""
    cuts = [64 * i // (radius + m) for i in range(radius + m + 1)]
    ranges = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(choice) for choice in combinations(ranges, m)]


def _keyed(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """(key, fp) rows; fingerprints within the radius share a key at least once."""
    m = next(m for m in range(1, 60) if n <= MEAN_BLOCK * 2 ** (64 * m / (radius + m)))
    signed = [x - (1 << 64) if x >> 63 else x for x in _block_masks(m, radius)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(signed)])
    return distinct.select(F.explode(keys).alias("key"), "fp")


def tiled(keyed: DataFrame, tile: int = TILE) -> DataFrame:
    """The same (key, ...) rows with each key's block bounded: blocks over ``tile`` become pairs of hashed tiles."""
    large = materialize(keyed.groupBy("key").count().filter(F.col("count") > tile), "simhash-large")
    if large.isEmpty():
        return keyed
    others = [c for c in keyed.columns if c != "key"]
    joined = keyed.join(large, "key", "left")
    tiles = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1))
    own = F.pmod(F.xxhash64(*others, F.lit(1)), tiles)
    other = F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other")
    pairs = joined.select("key", *others, tiles.alias("tiles"), own.alias("own"), other)
    split = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(F.when(F.col("tiles") == 1, F.col("key")).otherwise(split).alias("key"), *others)


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) forest edges between fingerprints within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def linked(last: bool) -> Iterator[pa.RecordBatch]:
            keys, fps = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            held[:] = [(keys[cut:], fps[cut:])]
            if cut:
                a, b = link_blocks(keys[:cut], fps[:cut], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(x[0]) for x in held) >= 1 << 18:
                yield from linked(last=False)
        if held:
            yield from linked(last=True)

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): alternating large and small stars.

    Each round is a handful of equi-joins; a node with very many neighbours only meets its
    minimum, so skewed joins can be split. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = scratch_path(spark, "stars")
    edges, before = materialize(edges, "", path), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        old, before, path = path, state, scratch_path(spark, "stars")
        edges = materialize(small, "", path)
        discard(spark, old)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) of every row; the component is the smallest id that links reach, the row's own included.

    Equal texts have equal fingerprints and meet only once, as one distinct fingerprint. Null
    and empty texts share fingerprint zero and are linked like any other. A null id never is a
    component's id unless all of its ids are null. Repeated rows stay. An empty table gives none.
    """
    rows = materialize(fingerprints(df, id_col, text_col, size), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    keyed = tiled(_keyed(distinct.select("fp"), distinct.count(), radius), tile)
    roots = components(_links(keyed, radius))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = classes.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


