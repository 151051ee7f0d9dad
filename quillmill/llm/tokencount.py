"""Token counts that follow edits (operator 6).

A document is cut before single spaces into leaves of whole pre-tokens, and a segment tree
holds the token counts of its leaves. An edit makes dirty the leaves it touches, and a
neighbour too if the edit undid the space between them; only dirty regions are encoded again,
and the tree's sums on their paths are updated. The result equals a count from scratch. A region
is cut anew where it was edited: what exceeds its leaves is put between them, so that a place that
is edited again and again stays one of small leaves. Only then, and where half of the leaves are
empty, is the tree built anew from the counts of its leaves, without encoding.

Trees are kept in a folder, a Parquet table for each version: the first has all documents, a later
one those that its edits changed. Edits are applied to the latest version, again and again,
and no document is counted whole but for the first version. Only documents with edits are
shuffled, if the edits come as a table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.bpe import read_ranks
from quillmill.llm.chunks import once, ship
from quillmill.llm.common import by_arrow, materialize, scratch_path, split_by, texts_of, until_exit

#: Characters of a leaf at least, if a safe space follows.
LEAF = 512
#: Start and end in code points, end exclusive, and what replaces them.
Edit = tuple[int, int, str]


def leaf_starts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of leaves; all but the first are spaces between two characters that aren't white space."""
    starts, at = [0], leaf
    while 0 < (at := text.find(" ", at)) < len(text) - 1:
        if text[at - 1].isspace() or text[at + 1].isspace():
            at += 1
        else:
            starts.append(at)
            at += leaf
    return starts


def leaf_pieces(text: str, leaf: int) -> list[str]:
    """An edited region in leaves; a last one shorter than ``leaf`` stays with the one before, so a leaf is cut when twice as long."""
    starts = leaf_starts(text, leaf)
    if len(starts) > 1 and len(text) - starts[-1] < leaf:
        starts.pop()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


class SegmentTree:
    """Sums over leaves; node 1 is the root."""

    def __init__(self, counts: list[int]) -> None:
        self.size = 1 << max(0, len(counts) - 1).bit_length()
        self.sums = np.zeros(2 * self.size, np.int64)
        self.sums[self.size : self.size + len(counts)] = counts
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    def total(self) -> int:
        return int(self.sums[1])

    def update(self, leaf: int, count: int) -> None:
        node = leaf + self.size
        change = count - self.sums[node]
        while node and change:
            self.sums[node] += change
            node //= 2


class CountedText:
    """A text with its tree of counts; ``starts`` and ``sums`` are those of a stored tree of the text, if there is one."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF, starts: list[int] | None = None, sums: list[int] | None = None) -> None:
        self.count, self.leaf, self.starts = count, leaf, leaf_starts(text, leaf) if starts is None else starts
        self.leaves = [text[a:b] for a, b in zip(self.starts, [*self.starts[1:], len(text)])]
        self.length = len(text)
        if sums is None:
            self.tree = SegmentTree([count(x) for x in self.leaves])
        else:
            self.tree = SegmentTree.__new__(SegmentTree)
            self.tree.size, self.tree.sums = len(sums) // 2, np.array(sums, np.int64)

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, edits: list[Edit]) -> tuple[int, int]:
        """Apply edits in the text's coordinates; (edits applied, characters encoded again).

        Edits out of range or overlapping an earlier one are left out. A region that is encoded
        again is cut anew into its leaves; those left over are empty, and those lacking are added.
        """
        applied: list[Edit] = []
        for a, b, new in sorted(edits):
            if 0 <= a <= b <= self.length and a >= (applied[-1][1] if applied else 0):
                applied.append((a, b, new))
        dirty: set[int] = set()
        for a, b, _ in applied:
            dirty.update(range(bisect_right(self.starts, a) - 1, bisect_right(self.starts, max(a, b - 1))))
        last, regions = len(self.leaves) - 1, []
        grown = True
        while grown:
            grown, regions = False, []
            for first in sorted(k for k in dirty if k - 1 not in dirty):
                end = first
                while end + 1 in dirty:
                    end += 1
                text = self._edited(first, end, applied)
                regions.append((first, end, text))
                if text and first and not (text[0] == " " and not text[1:2].isspace() and len(text) > 1):
                    dirty.add(first - 1)
                    grown = True
                if text and end < last and text[-1].isspace():
                    dirty.add(end + 1)
                    grown = True
        more: dict[int, list[tuple[str, int]]] = {}
        for first, end, text in regions:
            pieces = [(x, self.count(x)) for x in leaf_pieces(text, self.leaf)]
            own = end + 1 - first
            for k, (piece, n) in enumerate([*pieces[:own], *[("", 0)] * (own - len(pieces))], first):
                self.tree.update(k, n)
                self.leaves[k] = piece
            if len(pieces) > own:
                more[end] = pieces[own:]
        if more or 2 * self.leaves.count("") > len(self.leaves):
            self._rebuild(more)
        self.starts = [0, *accumulate(map(len, self.leaves[:-1]))]
        self.length = self.starts[-1] + len(self.leaves[-1])
        return len(applied), sum(len(text) for _, _, text in regions)

    def _rebuild(self, more: dict[int, list[tuple[str, int]]]) -> None:
        """A tree of the leaves that hold text, with ``more`` after theirs, from counts that are known."""
        counted = zip(self.leaves, self.tree.sums[self.tree.size :].tolist())
        kept = [(x, n) for k, own in enumerate(counted) for x, n in [own, *more.get(k, [])] if x] or [("", 0)]
        self.leaves = [x for x, _ in kept]
        self.tree = SegmentTree([n for _, n in kept])

    def _edited(self, first: int, end: int, edits: list[Edit]) -> str:
        start = self.starts[first]
        stop = self.starts[end] + len(self.leaves[end])
        old, out, at = "".join(self.leaves[first : end + 1]), [], start
        near = slice(bisect_left(edits, start, key=itemgetter(0)), bisect_right(edits, stop, key=itemgetter(0)))
        for a, b, new in edits[near]:
            if start <= a and b <= stop and (a < stop or stop == self.length):
                out += [old[at - start : a - start], new]
                at = b
        return "".join([*out, old[at - start :]])


#: Fixed patterns: mail addresses, from the start of their run of characters on; long hexadecimal
#: keys; access keys. A run is tried at its start only and never again, so the time is linear in it.
REDACTED = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.-]+|[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}")


def curation_edits(text: str) -> list[Edit]:
    """Edits that a curation step would make: lines that repeat an earlier one go, keys and addresses are masked."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((max(0, at - 1), at + len(line), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "[redacted]") for m in REDACTED.finditer(line)]
        at += len(line) + 1
    return edits


def sound_edits(asked: list[dict[str, object] | None] | None) -> list[Edit]:
    """Edits of a column: null ones and those with a null start or end are none, a null replacement is empty."""
    whole = (tuple(e.values()) for e in asked or () if e is not None)
    return [(a, b, new or "") for a, b, new in whole if a is not None and b is not None]


STORED = "row long, id {}, text string, starts array<int>, sums array<bigint>, n_edits long, n_chars_again long"
EDITS = "array<struct<start: int, end: int, text: string>>"


def _counter(df: DataFrame, path: str | None, pattern: str) -> Callable[[], Callable[[str], int]]:
    """For tasks: what counts the tokens of a text."""
    digest, shipped = ship(df.sparkSession, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def build() -> Callable[[str], int]:
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(shipped.value), special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return lambda: once(("count", digest, pattern), build)


def _stored(rows: list[tuple[CountedText, int, int]]) -> dict[str, object]:
    return {
        "text": pa.array([c.text() for c, _, _ in rows], pa.string()),
        "starts": pa.array([c.starts for c, _, _ in rows], pa.list_(pa.int32())),
        "sums": pa.array([c.tree.sums for c, _, _ in rows], pa.list_(pa.int64())),
        "n_edits": pa.array([n for _, n, _ in rows], pa.int64()),
        "n_chars_again": pa.array([again for _, _, again in rows], pa.int64()),
    }


def write_trees(df: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF) -> None:
    """Count all texts and write their trees as version 1 of ``store``. A null text is the empty one; repeated rows have a tree each."""
    counter = _counter(df, path, pattern)

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        count = counter()
        yield {"row": batch.column(0), "id": batch.column(1)} | _stored([(CountedText(t, count, leaf), 0, len(t)) for t in texts_of(batch.column(2))])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_arrow(rows, STORED.format(df.schema[id_col].dataType.simpleString()), run, text=2).write.parquet(f"{store}/version=1")


def versions(spark: SparkSession, store: str) -> int:
    """The latest version of a store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return max(int(f.getPath().getName().removeprefix("version=")) for f in found)


def read_trees(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(row, id, text, starts, sums, n_edits, n_chars_again) of all documents as of a version, by default the latest.

    What edits and encoding again are told of is the version in which a document changed last.
    """
    out = None
    for k in range(version or versions(spark, store), 0, -1):
        own = spark.read.parquet(f"{store}/version={k}")
        if out is not None:
            changed = out.select(F.col("row").alias("key"))
            maybe, surely = split_by(own, F.col("row"), changed)
            own = maybe.join(changed, F.col("row") == F.col("key"), "left_anti").unionByName(surely)
        out = own if out is None else out.unionByName(own)
    return out


def edit_trees(spark: SparkSession, store: str, edits: DataFrame | Callable[[str], list[Edit]], path: str | None = None, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF) -> int:
    """Apply edits to the latest version of ``store`` and write those documents that change as the next; its number.

    ``edits`` is a table (row, start, end, text) or (id, start, end, text) in the coordinates of the latest texts, or a
    rule that gives a text's edits. Null rows, starts and ends make an edit none, and a null replacement is empty.
    """
    version = versions(spark, store)
    trees = read_trees(spark, store, version)
    if isinstance(edits, DataFrame):
        by = edits.columns[0]
        asked = materialize(edits.dropna(subset=edits.columns[:3]).groupBy(F.col(by).alias("key")).agg(F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in zip(edits.columns[1:], ("start", "end", "text"))])).cast(EDITS).alias("edits")), "edits")
        trees = split_by(trees, F.col(by), asked)[0].join(asked, F.col(by) == F.col("key"))
    else:
        trees = trees.withColumn("edits", F.lit(None).cast(EDITS))
    counter = _counter(trees, path, pattern)
    rule = None if isinstance(edits, DataFrame) else edits

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        count, rows, kept = counter(), [], []
        for i, (text, starts, sums, listed) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))):
            wanted = sound_edits(listed) if rule is None else rule(text)
            if wanted:
                counted = CountedText(text, count, leaf, starts, sums)
                n, again = counted.edit(wanted)
                if n:
                    kept.append(i)
                    rows.append((counted, n, again))
        own = batch.take(pa.array(kept, pa.int64()))
        yield {"row": own.column(0), "id": own.column(1)} | _stored(rows)

    schema = STORED.format(trees.schema["id"].dataType.simpleString())
    by_arrow(trees.select("row", "id", "text", "starts", "sums", "edits"), schema, run, text=2).write.parquet(f"{store}/version={version + 1}")
    return version + 1


def counts(trees: DataFrame) -> DataFrame:
    """(row, id, n_tokens, n_leaves) of stored trees: the sums at their roots, and no text is read."""
    return trees.select("row", "id", F.col("sums")[1].alias("n_tokens"), F.size("starts").cast("long").alias("n_leaves"))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: str | Callable[[str], list[Edit]] = curation_edits, path: str | None = None, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, store: str | None = None) -> DataFrame:
    """(id, n_tokens, n_leaves, n_edits, n_tokens_edited, n_chars_again) of each row, from a store of trees before and after edits.

    ``edits`` names a column of array<struct<start, end, text>>, or is a rule that gives a text's
    edits. A null text is the empty one; null edits are none, and so are those with a null start
    or end; a null replacement is empty. ``store`` is where the trees stay, by default a scratch folder.
    """
    spark = df.sparkSession
    passing = store is None
    store = store or scratch_path(spark, "trees")
    if isinstance(edits, str):  # by their documents' rows, which alone tell equal ids apart
        keyed = materialize(df.select(F.struct(F.col(id_col).alias("id"), F.col(edits).cast(EDITS).alias("edits")).alias("both"), F.col(text_col).alias("text")), "edited")
        write_trees(keyed, store, "both", "text", path, pattern, leaf)
        first = spark.read.parquet(f"{store}/version=1")
        edit_trees(spark, store, first.select("row", F.inline("id.edits")), path, pattern, leaf)
    else:
        write_trees(df, store, id_col, text_col, path, pattern, leaf)
        edit_trees(spark, store, edits, path, pattern, leaf)
    if passing:
        until_exit(spark, store)
    before, after = (spark.read.parquet(f"{store}/version={k}") for k in (1, 2))
    changed = after.select("row", F.col("sums")[1].alias("after"), "n_edits", "n_chars_again")
    joined = counts(before).join(changed, "row", "left")
    own_id = F.col("id.id") if isinstance(edits, str) else F.col("id")
    return joined.select(own_id.alias(id_col), "n_tokens", "n_leaves", F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.coalesce("after", "n_tokens").alias("n_tokens_edited"), F.coalesce("n_chars_again", F.lit(0)).alias("n_chars_again"))
