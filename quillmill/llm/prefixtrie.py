"""Conversation prefix trie as a z-fast trie (operator 13).

A string is a sequence of turns, each known by a digest. In a compacted trie a node stands for an
edge: the depths from below its parent's end to its own end. A node's handle is the depth among
these that is divisible by the highest power of two (the two-fattest), and a dictionary leads
from the digest of the prefix of that depth to the node. The node where a string leaves the
trie is found by fat binary search: a logarithm of its length in lookups. Strings are inserted in
batches: all are located first, and then each goes on from where it was located, splitting an
edge or adding a leaf. At the end edges are expanded to a row for each depth.

The trie is cut into shards by ranges of the sorted strings, and each shard is built by one task. A
string with very many copies is one string, and its copies may lie in several shards. Two
shards only share prefixes of the last string of one and the first of the next: the spine. Its
few rows are corrected for what neighbours count twice, then merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import materialize, word_count

DIGEST = 16
#: Turns of a shard, about, and rows of the spine that are broadcast at most.
SHARD_TURNS, BROADCAST_SPINE = 400_000, 200_000
NODE = (
    "shard int, key binary, parent binary, depth long, n_convs long, least long, n_children long, n_leaves long, saved_tokens long, words long, "
    "ends_sha256 string, ids string, parent_least long, on_first boolean, on_last boolean, below_spine boolean"
)
NODE_COLUMNS = [part.split()[0] for part in NODE.split(", ")]
#: SHA-256 of nothing: where no string ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def prefix_digests(path: bytes) -> bytes:
    """Digests of all prefixes of a sequence of turn digests, one after the other."""
    out, last = [], b""
    for a in range(0, len(path), DIGEST):
        last = hashlib.blake2b(last + path[a : a + DIGEST], digest_size=DIGEST).digest()
        out.append(last)
    return b"".join(out)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & -(1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of strings given by the digests of their prefixes; node 0 is the root, of depth 0."""

    def __init__(self) -> None:
        self.parent, self.end, self.string = [-1], [0], [b""]  # ``string``: some string below the node
        self.children: list[dict[bytes, int]] = [{}]
        self.handles: dict[bytes, int] = {}

    @staticmethod
    def at(string: bytes, depth: int) -> bytes:
        return string[(depth - 1) * DIGEST : depth * DIGEST]

    def start(self, node: int) -> int:
        return self.end[self.parent[node]] if node else 0

    def locate(self, string: bytes, node: int = 0) -> tuple[int, int | None]:
        """(deepest node whose end the string passes, the edge it leaves inside, if known), by fat binary search from ``node`` on."""
        low, high = self.end[node], len(string) // DIGEST
        longest = high
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get(self.at(string, depth))
            if found is None:
                high = depth - 1
            elif self.end[found] <= longest and self.at(string, self.end[found]) == self.at(self.string[found], self.end[found]):
                node, low = found, self.end[found]
            else:
                return self.parent[found], found
        return node, None

    def _add(self, parent: int, end: int, string: bytes) -> int:
        self.parent.append(parent)
        self.end.append(end)
        self.string.append(string)
        self.children.append({})
        node = len(self.end) - 1
        self.children[parent][self.at(string, self.end[parent] + 1)] = node
        self._handle(node)
        return node

    def _handle(self, node: int) -> None:
        self.handles[self.at(self.string[node], two_fattest(self.start(node), self.end[node]))] = node

    def insert(self, string: bytes, node: int = 0) -> int:
        """The node at whose end the string ends, made if needed; ``node`` is where it was located before."""
        length = len(string) // DIGEST
        node, edge = self.locate(string, node)
        if length == self.end[node]:
            return node
        edge = self.children[node].get(self.at(string, self.end[node] + 1)) if edge is None else edge
        if edge is None:
            return self._add(node, length, string)
        low, high = self.end[node] + 1, min(length, self.end[edge])  # agrees at ``low``
        while low < high:
            middle = (low + high + 1) // 2
            same = self.at(string, middle) == self.at(self.string[edge], middle)
            low, high = (middle, high) if same else (low, middle - 1)
        fork = self._add(node, low, self.string[edge])  # takes the edge's place below its parent, and its handle or a new one
        self.children[fork][self.at(self.string[edge], low + 1)] = edge
        self.parent[edge] = fork
        self._handle(edge)
        return fork if length == low else self._add(fork, length, string)

    def insert_batch(self, strings: list[bytes]) -> list[int]:
        """The nodes of the strings: all are located, then inserted from there on; splits leave what was located above them."""
        exits = [self.locate(s)[0] for s in strings]
        return [self.insert(s, node) for s, node in zip(strings, exits)]


class Shard:
    """The strings of one range, in order, with their ids ascending; then their nodes by depth."""

    def __init__(self) -> None:
        self.trie = ZFastTrie()
        self.copies: dict[int, int] = {}
        self.least: dict[int, int] = {}
        self.ends: dict[int, str] = {}
        self.words: dict[bytes, np.ndarray] = {}
        self.first = self.last = None
        self.texts: dict[int, str] = {}  # ids of the first and the last string, which other shards may have too
        self.ids: list[np.ndarray] = []

    def close(self, final: bool) -> None:
        """The last string is complete."""
        if self.last is None:
            return
        ids, (path, string, node) = np.concatenate(self.ids), self.last
        said = ",".join(map(str, ids.tolist()))
        self.copies[node], self.least[node] = len(ids), int(ids[0])
        if final or self.first is None:
            self.texts[node] = said
        else:
            self.ends[node] = hashlib.sha256(said.encode()).hexdigest()
        self.first = self.first or self.last
        self.ids = []

    def take(self, paths: list[bytes], words: pa.Array, ids: np.ndarray) -> None:
        """A batch of sorted rows."""
        starts = [i for i, p in enumerate(paths) if p != (paths[i - 1] if i else self.last and self.last[0])]
        strings = [prefix_digests(paths[i]) for i in starts]
        nodes = self.trie.insert_batch(strings)
        if not starts or starts[0]:
            self.ids.append(ids[: starts[0] if starts else len(ids)])
        for k, (i, string, node) in enumerate(zip(starts, strings, nodes)):
            self.close(final=False)
            self.last = (paths[i], string, node)
            self.words[string] = np.array(words[i].as_py(), np.int64)
            self.ids.append(ids[i : starts[k + 1] if k + 1 < len(starts) else len(ids)])

    def rows(self, shard: int) -> Iterator[tuple]:
        """A row for each node and depth of its edge, in the order of ``NODE``."""
        self.close(final=True)
        trie, at = self.trie, ZFastTrie.at
        spine = [{at(s[1], d + 1) for d in range(len(s[1]) // DIGEST)} | {b""} for s in (self.first, self.last)]
        size = len(trie.end)
        count, leaves, below = [0] * size, [0] * size, [0] * size
        least = [self.least.get(i) for i in range(size)]
        order = sorted(range(size), key=lambda i: -trie.end[i])
        own_words = [self.words_of(i) for i in range(size)]
        for i in order:
            count[i] += self.copies.get(i, 0)
            leaves[i] += not trie.children[i]
            up = trie.parent[i]
            if i:
                count[up] += count[i]
                leaves[up] += leaves[i]
                below[up] += below[i] + (count[i] - 1) * int(own_words[i].sum())
                least[up] = least[i] if least[up] is None else min(least[up], least[i])
        for i in range(size):
            start, end, string = trie.start(i), trie.end[i], trie.string[i]
            saved = below[i] + (count[i] - 1) * np.cumsum(own_words[i][::-1])[::-1]
            for d in range(start + 1, end + 1) if i else [0]:
                key, parent = (at(string, d), at(string, d - 1) if d > 1 else b"") if d else (b"", None)
                here = d == end
                yield (
                    shard, key, parent, d, count[i], least[i], len(trie.children[i]) if here else 1, leaves[i], int(saved[d - start - 1]) if d else below[i], int(own_words[i][d - start - 1]) if d else 0,
                    self.ends.get(i) if here else None, self.texts.get(i) if here else None, None if not d else least[i] if d > start + 1 else least[trie.parent[i]], key in spine[0], key in spine[1], parent in spine[0] or parent in spine[1],
                )

    def words_of(self, node: int) -> np.ndarray:
        return self.words[self.trie.string[node]][self.trie.start(node) : self.trie.end[node]] if node else np.zeros(0, np.int64)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, some = Shard(), False
    for batch in batches:
        if batch.num_rows:
            some = True
            shard.take(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy())
    if not some:
        return
    types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds, held = [types[part.split()[1]] for part in NODE.split(", ")], []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], NODE_COLUMNS)

    for row in shard.rows(TaskContext.get().partitionId()):
        held.append(row)
        if len(held) == 1 << 14:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)


def _hashed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of (key, ids) rows, sorted by key and shard: parts of one list are hashed one after the other."""
    key, state = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.binary()), "ends": pa.array([s for _, s in out], pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": pa.array([state.hexdigest()])})


def _merged(spine: DataFrame) -> DataFrame:
    """The rows of the spine as one for each node.

    A shard's first strings share ``before`` turns with the shard before, its last ``after`` with the next. What a
    shard counted as its own on these belongs to the shard before, a last string that the next one
    repeats or goes on with is no leaf here.
    """
    in_turn = Window.orderBy("shard")  # a row for each shard
    turns = spine.filter("depth = 0").select("shard", F.lead("shard").over(in_turn).alias("next"))
    ends = spine.filter("on_last").join(F.broadcast(turns), "shard").filter("next is not null").select("key", F.col("shard").alias("prior"), F.col("next").alias("shard"))
    shared = spine.filter("on_first").select("key", "shard").join(ends, ["key", "shard"]).groupBy("shard", "prior").agg((F.count("*") - 1).alias("common"))  # the root is one
    length = F.max(F.when(F.col("on_last"), F.col("depth"))).alias("length")
    facts = spine.groupBy("shard").agg(length)
    facts = facts.join(shared.select("shard", F.col("common").alias("before")), "shard", "left").join(shared.select(F.col("prior").alias("shard"), F.col("common").alias("after")), "shard", "left")
    facts = materialize(facts.select("shard", "length", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after")), "trie-shards")
    known = spine.join(F.broadcast(facts), "shard")
    not_own = F.col("on_first") & (F.col("depth") <= F.col("before"))
    deeper = Window.partitionBy("shard").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    again = F.when(not_own, F.sum(F.when(not_own, F.col("words")).otherwise(0)).over(deeper)).otherwise(0)
    no_leaf = (F.col("on_last") & (F.col("after") >= F.col("length"))).cast("long")
    right = known.select(
        "key", "parent", "depth", "n_convs", "least", "ends_sha256",
        (F.col("n_children") - (F.col("on_first") & (F.col("depth") < F.col("before"))).cast("long")).alias("n_children"),
        (F.col("n_leaves") - no_leaf).alias("n_leaves"),
        (F.col("saved_tokens") + again).alias("saved_tokens"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = right.groupBy("key").agg(F.min("parent").alias("parent"), F.max("depth").alias("depth"), F.min("least").alias("least"), F.max("ends_sha256").alias("ends_sha256"), *sums)
    parts = spine.filter("ids is not null").select("key", "ids", "shard").repartition("key").sortWithinPartitions("key", "shard").select("key", "ids").mapInArrow(_hashed_parts, "key binary, ends string")
    return merged.join(parts, "key", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256")).drop("ends")


def nodes(strings: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes of (id long, turns array<struct<digest: string, words: ...>>) rows; ``digest`` has 32 hex digits.

    A row for each distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as in
    ``conversation_nodes``. Rows without turns are members of the root; without any row there is no
    root. Ids should be distinct; a repeated one counts again. A string is one row, of 16 bytes a turn.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    laid = materialize(strings.select(path.alias("path"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"), F.col("id").cast("long").alias("id")), "trie-strings")
    turns = laid.agg(F.sum(F.octet_length("path")) / DIGEST).first()[0] or 0
    parts = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(turns // shard_turns) + 1)
    ordered = laid.repartitionByRange(parts, "path", "id").sortWithinPartitions("path", "id").select("path", "words", "id")
    table = materialize(ordered.mapInArrow(_built, NODE), "trie-nodes")
    on_spine = F.col("on_first") | F.col("on_last")
    merged = materialize(_merged(table.filter(on_spine)), "trie-spine")
    shown = ["key", "parent", "depth", "least", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hanging = table.filter(~on_spine & F.col("below_spine")).select(*shown).unionByName(merged.select(*shown))
    above = merged.select(F.col("key").alias("parent"), F.col("least").alias("parent_least"))
    above = F.broadcast(above) if merged.count() <= BROADCAST_SPINE else above
    every = hanging.join(above, "parent", "left").select(*shown, "parent_least").unionByName(table.filter(~on_spine & ~F.col("below_spine")).select(*shown, "parent_least"))
    numbers = [F.col(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return every.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), *numbers, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversations(df: DataFrame) -> DataFrame:
    """(id, turns array<struct<digest, words>>) of (conv_id, turn, role, text) rows, in the order of turns, null first.

    Null roles and texts are empty; turns of one number go by role, then by digest. Rows without a
    conv_id belong to no conversation and take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), F.lit(2 * DIGEST))
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), word_count(text).alias("words"))
    kept = df.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("id"), turn.alias("turn"))
    ordered = kept.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share openings: the first h turns of the group's first one, then their own after the h-th; h is crc32(id) % most."""
    h = (F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % most).cast("int")
    first: Column = F.col("id") - F.col("id") % group
    base = convs.filter(F.col("id") % group == 0).select(F.col("id").alias("first"), F.slice("turns", 1, most - 1).alias("opening"))
    joined = convs.withColumn("first", first).join(base, "first", "left")
    opening = F.coalesce(F.slice("opening", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("id", F.concat(opening, own).alias("turns"))
