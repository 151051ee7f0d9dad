"""Near copies by shingles, for filtering a corpus (operator 1).

Texts are near copies if their sets of ``SIZE`` lower-cased words in a row have a Jaccard similarity
of ``SIMILARITY`` or more. SimHash finds them: wide fingerprints of the sets are compared bit-sliced,
as in ``simhash``, and what lies within ``RADIUS`` bits is verified by the sets themselves.

At 0.8, fingerprints differ in about 15 % of their bits, far too many for blocks by pigeonhole keys
(ten of 64 bits take 1,001 keys a text). Blocks come from the sets instead: a key is the least
of ``ROWS`` hashings each, of which ``BANDS`` are taken, so that a pair at 0.8 shares a block
with a probability of 0.999. Fingerprints within 54 of 256 bits miss a pair at 0.8 in 3 of 1,000 cases.

Blocks of up to 64 texts give all pairs within the radius. Larger ones are not expanded into all
their pairs: they give each text's ``NEAREST`` closest ones, and what a spanning forest needs
beside them. After these are verified, closing rounds go back to the large blocks with parts that are
still apart. Their texts get fingerprints of ``WIDE`` words, which tell 0.7 from 0.8 as 256 bits can't and miss a
pair at 0.8 in one of 2,000 cases; each text is paired with ever more of the closest texts of other
parts, until no untried pair within that radius leads from one part to another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.names import fresh
from quillmill.llm.common import by_arrow, discard, materialize, scratch_path, split_by
from quillmill.llm.simhash import ALL, ONE, TILE, bit_planes, components, lanes_within, shingle_hashes, tiled

SIZE, SIMILARITY = 5, 0.8
WORDS, RADIUS = 4, 54
#: Closest texts that each text of a large block is paired with.
NEAREST = 8
BANDS, ROWS = 10, 3
#: Words of the fingerprints of closing rounds.
WIDE = 64
#: Keys of large blocks that are broadcast at most.
BROADCAST_KEYS = 500_000
_GOLDEN = 0x9E3779B97F4A7C15


def mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = hashes ^ np.uint64(_GOLDEN * (turn + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def sketch(shingles: np.ndarray, at_once: int = 1 << 14) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Digest of a set, its fingerprint of ``WORDS`` words and its ``BANDS`` block keys; an empty set has no keys."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    ones = np.zeros((WORDS, 64), np.int64)
    least = np.full(BANDS * ROWS, ALL)
    for a in range(0, len(shingles), at_once):
        part = shingles[a : a + at_once]
        for w in range(WORDS):
            ones[w] += np.unpackbits(mixed(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], mixed(part, WORDS + k).min())
    fingerprint = np.packbits(ones * 2 > len(shingles), axis=1, bitorder="little").view("<u8").reshape(-1)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ row, 99)
    return digest, fingerprint, mixed(keys + np.arange(BANDS, dtype=np.uint64), 98)[: BANDS if len(shingles) else 0]


def wide_fingerprint(shingles: np.ndarray, at_once: int = 1 << 12) -> bytes:
    """The fingerprint of a set of ``WIDE`` words."""
    ones = np.zeros((WIDE, 64), np.int64)
    for a in range(0, len(shingles), at_once):
        part = shingles[a : a + at_once]
        for w in range(WIDE):
            ones[w] += np.unpackbits(mixed(part, 1000 + w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), axis=1, bitorder="little").tobytes()


def wide_radius(similarity: float) -> int:
    """Bits in which wide fingerprints of sets of this similarity differ at most, but for one pair of 2,000."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return math.ceil(bits * share + 3.3 * math.sqrt(bits * share * (1 - share)))


def _small_pairs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius in many blocks of 2 to 64 fingerprints; each block fills one plane word."""
    block = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(starts, sizes) + place
    laid = np.zeros((len(starts) * 64, fps.shape[1]), "<u8")
    laid[block * 64 + place] = fps[rows]
    later = ~((ONE << place.astype(np.uint64)) * np.uint64(2) - ONE)  # each pair once
    valid = np.where(sizes == 64, ALL, (ONE << (sizes.astype(np.uint64) & np.uint64(63))) - ONE)
    near = lanes_within(fps[rows], block, bit_planes(laid), radius) & valid[block] & later
    hits = np.flatnonzero(near)
    which, lane = np.nonzero(np.unpackbits(near[hits].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return rows[hits[which]], starts[block[hits[which]]] + lane


def _large_pairs(fps: np.ndarray, radius: int, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius in a large block: the closest of each fingerprint, and a forest that spans the rest."""
    n, planes = len(fps), bit_planes(fps)
    label = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = int(label[i])
        return i

    def joined(i: int, j: int) -> bool:
        x, y = root(i), root(j)
        label[max(x, y)] = min(x, y)
        return x != y

    words = np.arange(planes.shape[1])
    for a in range(0, n, at_once):
        queries = fps[a : a + at_once]
        near = lanes_within(np.repeat(queries, len(words), axis=0), np.tile(words, len(queries)), planes, radius)
        i, j = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n])
        i, j = i[i + a != j] + a, j[i + a != j]
        order = np.lexsort((np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1), i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        own = rank < NEAREST
        for x, y in zip(i[own].tolist(), j[own].tolist()):
            joined(x, y)
        found.append((i[own], j[own]))
        while True:
            while (label[label] != label).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            chosen = [k for k in np.sort(np.unique(label[i], return_index=True)[1]).tolist() if joined(int(i[k]), int(j[k]))]
            found.append((i[chosen], j[chosen]))
    i, j = (np.concatenate([x[side] for x in found]) for side in (0, 1))
    return np.minimum(i, j), np.maximum(i, j)


def apart_pairs(fps: np.ndarray, wide: np.ndarray, labels: np.ndarray, radius: int, reach: int, most: int, at_once: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, more): each text of a block with the ``most`` closest ones of other labels within the radius, and within
    ``reach`` by ``wide``; ``more`` if it has further ones."""
    n, planes = len(fps), bit_planes(fps)
    words = np.arange(planes.shape[1])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for a in range(0, n, at_once):
        queries = fps[a : a + at_once]
        near = lanes_within(np.repeat(queries, len(words), axis=0), np.tile(words, len(queries)), planes, radius)
        i, j = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n])
        other = labels[i + a] != labels[j]
        i, j = i[other] + a, j[other]
        far = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(wide[i[b : b + 8192]] ^ wide[j[b : b + 8192]]).sum(axis=1, dtype=np.int64) for b in range(0, len(i), 8192))])
        i, j, far = i[far <= reach], j[far <= reach], far[far <= reach]
        order = np.lexsort((j, far, i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        own = rank < most
        found.append((i[own], j[own], np.isin(i[own], i[rank == most])))
    return tuple(np.concatenate([x[side] for x in found]) for side in range(3))


def block_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs within runs of equal ``keys`` (sorted)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    found = [_small_pairs(fps, starts[part], sizes[part], radius) for part in np.array_split(small, -(-len(small) // 2048) or 1) if len(part)]
    for b in np.flatnonzero(sizes > 64):
        i, j = _large_pairs(fps[starts[b] : starts[b] + sizes[b]], radius)
        found.append((i + starts[b], j + starts[b]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[side] for x in found)]) for side in (0, 1))


def _in_blocks(keyed: DataFrame, schema: str, solve: Callable[[pa.Table], pa.RecordBatch], at_once: int = 1 << 17) -> DataFrame:
    """``solve`` on tables of whole blocks, sorted by the column key; a task holds few blocks, or one large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.concat_tables([x for x in (held, pa.Table.from_batches([batch])) if x is not None])
            if held.num_rows >= at_once:
                keys = held["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held)

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def _fingerprints(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["fp"].to_pylist()), "<u8").reshape(-1, WORDS)


def _candidates(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) pairs of nodes within the radius in a block of (key, fp, node) rows."""

    def paired(table: pa.Table) -> pa.RecordBatch:
        pairs = block_pairs(table["key"].to_numpy(), _fingerprints(table), radius)
        return pa.RecordBatch.from_arrays([table["node"].take(pa.array(side)).combine_chunks() for side in pairs], ["a", "b"])

    found = _in_blocks(keyed.select("key", "fp", "node"), "a binary, b binary", paired)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """``keyed`` with labels of parts, without blocks of one part only."""
    labelled = keyed.join(roots, "node", "left").select(*keyed.columns, F.xxhash64(F.coalesce("root", "node")).alias("label"))
    blocks = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return labelled.join(blocks, "key", "left_semi")


def _untried(keyed: DataFrame, roots: DataFrame, tried: DataFrame, radius: int, reach: int, most: int) -> DataFrame:
    """(a, b, more): pairs of large blocks that lead from one part to another and were not tried yet."""

    def paired(table: pa.Table) -> pa.RecordBatch:
        keys, fps, labels = table["key"].to_numpy(), _fingerprints(table), table["label"].to_numpy()
        wide = np.frombuffer(b"".join(table["wide"].to_pylist()), "<u8").reshape(-1, WIDE)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        found = [(i + a, j + a, more) for a, b in zip(starts, np.r_[starts[1:], len(keys)]) for i, j, more in [apart_pairs(fps[a:b], wide[a:b], labels[a:b], radius, reach, most)]]
        i, j, more = (np.concatenate([x[side] for x in found]) for side in range(3))
        nodes = table["node"]
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(i)).combine_chunks(), nodes.take(pa.array(j)).combine_chunks(), pa.array(more)], ["a", "b", "more"])

    found = _in_blocks(_apart(keyed, roots), "a binary, b binary, more boolean", paired, 1 << 14)
    each = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_or("more").alias("more"))
    return each.join(tried.select("a", "b", F.lit(True).alias("known")), ["a", "b"], "left").filter("known is null or more").select("a", "b", "more", F.col("known").isNull().alias("new"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (node, shingles) are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        keep = []
        for x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield {c: batch.column(k).filter(pa.array(keep, pa.bool_())) for k, c in enumerate("ab")}

    joined = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b")
    return by_arrow(joined, "a binary, b binary", run, text=2)


def near_copies(df: DataFrame, key: Column, text: Column, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(key, component) of each row of ``df``: the smallest key that links of similar texts reach, the row's own included.

    Texts with the same set of shingles are one from the start. Null, empty and blank texts have
    none and are copies of each other; shorter texts than ``size`` words are one shingle.
    Repeated rows stay. An empty table gives none.
    """
    spark = df.sparkSession
    texts = df.select(key.alias("key"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("of_text"))
    kind = texts.schema["key"].dataType.simpleString()

    def sketches(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        found = [sketch(shingle_set(t, size)) for t in batch.column(1).to_pylist()]
        own = {"key": batch.column(0), "of_text": batch.column(2), "node": pa.array([x[0] for x in found], pa.binary())}
        yield own | {"fp": pa.array([x[1].tobytes() for x in found], pa.binary()), "keys": pa.array([x[2].view(np.int64) for x in found], pa.list_(pa.int64()))}

    rows = materialize(by_arrow(texts, f"key {kind}, of_text long, node binary, fp binary, keys array<bigint>", sketches, text=1), "near-rows")
    first = F.min(F.struct("key", "of_text"))  # a key may stand for several texts
    nodes = materialize(rows.groupBy("node").agg(first.alias("first"), F.min("key").alias("least"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "near-nodes")
    keyed = tiled(nodes.select(F.explode("keys").alias("key"), "fp", "node"), tile)
    spent = []

    def kept(table: DataFrame, name: str) -> DataFrame:
        spent.append(scratch_path(spark, name))
        return materialize(table, "", spent[-1])

    def sets_of(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        yield {"node": batch.column(0), "shingles": pa.array([shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())}

    def made(members: DataFrame, name: str, schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict[str, object]]]) -> DataFrame:
        """What ``fn`` makes of the texts of some nodes, written."""
        wanted = kept(nodes.join(members, "node").select(F.col("first").alias("key"), "node"), "near-wanted")
        own = texts.select(F.struct("key", "of_text").alias("spot"), "text")
        some = split_by(own, F.col("spot"), wanted)[0].join(wanted, F.col("spot") == F.col("key")).select("node", "text").dropDuplicates(["node"])
        return kept(by_arrow(some, schema, fn, text=1), name)

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of written pairs whose sets are similar enough; sets are made again from the texts concerned."""
        members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return kept(_verified(pairs, made(members, "near-sets", "node binary, shingles binary", sets_of), similarity), "near-links")

    def wide_of(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        yield {"node": batch.column(0), "wide": pa.array([wide_fingerprint(shingle_set(t, size)) for t in batch.column(1).to_pylist()], pa.binary())}

    tried = kept(_candidates(keyed, radius), "near-pairs")
    links = similar(tried)
    roots = components(links)
    sizes = kept(keyed.groupBy("key").count().filter("count > 64").select("key"), "near-sizes")
    n_large, most = sizes.count(), NEAREST
    if n_large:
        large = kept(keyed.join(F.broadcast(sizes) if n_large <= BROADCAST_KEYS else sizes, "key", "left_semi"), "near-large")
        wide = made(_apart(large, roots).select("node").distinct(), "near-wide", "node binary, wide binary", wide_of)
        large = kept(large.join(wide, "node"), "near-wide-blocks")
    while n_large:
        found = kept(_untried(large, roots, tried, radius, wide_radius(similarity), most), "near-untried")
        new = found.filter("new").select("a", "b")
        if new.isEmpty():
            if found.isEmpty():  # neither untried pairs nor texts with more of them
                break
        else:
            tried, links = tried.unionByName(new), links.unionByName(similar(new))
            roots = components(links)
        most *= 8
    classes = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    result = rows.select("key", "node").join(classes.join(least, "root").select("node", "component"), "node").select("key", "component")
    for path in spent:
        discard(spark, path)
    return result


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, null ids last.

    Rows that share an id, or have none, are told apart by their texts: two texts under one id are two
    documents. Rows that repeat both are copies, and one of them stays. Only rows that may go are shuffled.
    """
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("of_text"))
    found = near_copies(df, key, F.col(text_col), size, similarity)
    counts = found.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(F.col("key") == F.col("component")).alias("stays"))
    settled = materialize(counts.filter("n > 1 or not stays"), "near-settled")
    own, other = fresh(df, "near_own"), fresh(df, "near_key")
    maybe, surely = split_by(df.withColumn(own, key), F.col(own), settled)
    gone = settled.select(F.col("key").alias(other), "stays")
    others = maybe.join(gone, F.col(own) == F.col(other), "left_anti")
    repeated = maybe.join(gone.filter("stays"), F.col(own) == F.col(other), "left_semi").dropDuplicates([own])
    return surely.unionByName(others).unionByName(repeated).drop(own)
