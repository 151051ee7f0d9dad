"""Token ids in a content-addressed store (operator 4).

A store is a folder of three Parquet tables:

- ``chunks/``: (key, hash, width, payload), each distinct chunk once; a payload holds little-endian
  ids of ``width`` bytes, ``hash`` is BLAKE2b of it, ``key`` its first bytes;
- ``recipes/``: (row, rank, doc_id, start, n_tokens, hashes, ends, root), files and rows in ascending
  doc_id order; ``ends`` are the chunk ends in the document, ``root`` hashes the chunk hashes;
- ``manifest/``: (level, node, hash), a Merkle tree over the roots in that order.

A rolling hash over the last ``WINDOW`` ids cuts each document's stream where its low bits are
zero, so equal passages give equal chunks wherever they stand. Payloads are shuffled once, on
their way into the store; equal chunks of one task travel once, however often they occur.

What is read is verified: chunks against their hashes, documents against the ids that their
recipes count, and all recipes against the manifest. Any difference is an error.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quillmill.llm.bpe import byte_characters
from quillmill.llm.chunks import Codes, encode_all, joined_runs, once, ship
from quillmill.llm.common import BATCH_BYTES, bounded_batches, by_arrow, discard, materialize, scratch_path, slices

WINDOW, MEAN, LONGEST = 16, 512, 4096
#: Children of a node of the Merkle tree.
FAN_OUT = 1024
POLYNOMIAL = np.uint32(0xEDB88320)


def chunk_ends(ids: np.ndarray, doc_ends: np.ndarray, mean: int = MEAN, longest: int = LONGEST) -> np.ndarray:
    """Ends of chunks in the joined streams of documents; ``doc_ends`` are ends of theirs.

    A cut depends on the ``WINDOW`` ids before it alone; none is made before so many ids of a
    document, and chunks over ``longest`` ids are cut evenly.
    """
    if not len(ids):
        return doc_ends[:0]
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, span = np.array([0xD6E8FEB86659FD93], np.uint64), 1
    while span < WINDOW:  # sums over 1, 2, 4, 8, 16 ids
        h[span:] += h[:-span].copy() * factor
        factor, span = factor * factor, span * 2
    starts = np.r_[0, doc_ends[:-1]]
    cut = (h >> np.uint64(40)) & np.uint64(mean - 1) == 0
    place = np.arange(len(ids)) - np.repeat(starts, doc_ends - starts)
    ends = np.unique(np.r_[np.flatnonzero(cut & (place >= WINDOW - 1)) + 1, doc_ends[doc_ends > starts]])
    sizes = np.diff(np.r_[0, ends])
    if sizes.max() > longest:
        ends = np.unique(np.concatenate([ends, *(np.arange(e - s + longest, e, longest) for e, s in zip(ends, sizes) if s > longest)]))
    return ends


#: Bytes of the cache of encoded pieces.
CACHE_BYTES = 120_000_000
#: Letters below U+0250, and ASCII marks that may follow a word; runs of marks are a pre-token of their own.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = re.escape(".,;:!?|&$%#*()[]{}<>\"'-_/\\+=@~^`")
#: Lines of a word each, with or without marks after it.
SIMPLE = f"^ ?[{LETTERS}]+[{MARKS}]*(\n[{LETTERS}]+[{MARKS}]*)*$"
TOKEN_ID = attrgetter("id")


class TokenIds:
    """Ids of the tokenizers library without added special tokens, as little-endian unsigned 32-bit integers.

    A run of Latin letters, with or without a space before it, is one pre-token, which the
    library's BPE model takes as it is; marks at its end are the next, and so is a single line
    feed between two such words. Anything else, strings of special tokens included, goes through
    the library whole. A piece goes to the library once, whatever stands beside it, while the
    cache has room.
    """

    def __init__(self, data: bytes) -> None:
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model = self.tokenizer.model
        self.mapped = dict(enumerate(byte_characters())) | {0: 0}  # which stands between pieces
        self.known = Codes(CACHE_BYTES)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.large_string()))[0].as_py()

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, with ``end`` after them."""
        return encode_all(texts, self._parts, end)

    def _parts(self, parts: pa.Array) -> pa.Array:
        simple = pc.match_substring_regex(parts, SIMPLE)
        lines = pc.replace_substring(parts.filter(simple), "\n", "\0\n\0")
        pieces = pc.split_pattern(pc.replace_substring_regex(lines, f"([{MARKS}]+)", "\0\\1"), "\0")
        distinct = pieces.values.dictionary_encode()
        of_piece = pa.array(self.known.of(distinct.dictionary, self._pre_tokens), pa.large_binary())
        codes = joined_runs(of_piece, distinct.indices, pieces.offsets.to_numpy())
        others = parts.filter(pc.invert(simple)).dictionary_encode()
        of_other = pa.array(self.known.of(others.dictionary, self._library), pa.large_binary())
        places = np.empty(len(parts), np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        places[is_simple] = np.arange(len(codes))
        places[~is_simple] = len(codes) + others.indices.to_numpy()
        return pa.concat_arrays([codes, of_other]).take(pa.array(places))

    def _pre_tokens(self, pieces: list[str]) -> list[bytes]:
        mapped = "\0".join(pieces).encode().decode("latin-1").translate(self.mapped).split("\0") if pieces else []
        return [array("I", map(TOKEN_ID, self.model.tokenize(piece))).tobytes() for piece in mapped]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() for text in texts]


CHUNK = "key long, hash binary, width int, payload binary"
RECIPE_COLUMNS = ["row", "doc_id", "n_tokens", "hashes", "ends", "root"]


def _recipe(id_type: str) -> str:
    return f"row: bigint, doc_id: {id_type}, n_tokens: bigint, hashes: array<binary>, ends: array<bigint>, root: binary"


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, width: int) -> DataFrame:
    """Rows of both kinds: a recipe for each document, and the chunks, each once per task."""
    bounded_batches(df.sparkSession)
    digest, shipped = ship(df.sparkSession, path)
    id_type = df.schema[id_col].dataType
    schema = f"kind string, {CHUNK}, recipe struct<{_recipe(id_type.simpleString())}>"
    end = np.uint32(end_id).tobytes()

    def columns(doc_ids: pa.Array, numbers: pa.Array, codes: pa.Array, seen: set[bytes]) -> Iterator[dict[str, object]]:
        _, offsets, data = codes.buffers()
        doc_ends = np.frombuffer(offsets, np.int64)[1:] // 4
        lengths = np.diff(doc_ends, prepend=0)
        ids = np.frombuffer(data, "<u4", int(doc_ends[-1]))
        if width == 2 and ids.max() >> 16:
            raise ValueError("ids over 65,535 need a larger vocabulary")
        ends = chunk_ends(ids, doc_ends)
        data = ids.astype(f"<u{width}").tobytes()
        bounds = (np.r_[0, ends] * width).tolist()
        hashes = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:])]
        cuts = np.searchsorted(ends, np.r_[0, doc_ends], side="right").tolist()
        of_doc = [hashes[a:b] for a, b in zip(cuts, cuts[1:])]
        n = len(lengths)
        recipe_ends = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ends - np.repeat(doc_ends - lengths, np.diff(cuts)), pa.int64()))
        roots = [hashlib.sha256(b"".join(x)).digest() for x in of_doc]
        recipe = pa.StructArray.from_arrays([numbers, doc_ids, pa.array(lengths), pa.array(of_doc, pa.list_(pa.binary())), recipe_ends, pa.array(roots, pa.binary())], RECIPE_COLUMNS)
        yield {"kind": pa.array(["recipe"] * n), "key": numbers, "hash": pa.nulls(n, pa.binary()), "width": pa.nulls(n, pa.int32()), "payload": pa.nulls(n, pa.binary()), "recipe": recipe}
        fresh = {}
        for i, x in enumerate(hashes):
            if x not in seen:
                seen.add(x)
                fresh[x] = i
        m = len(fresh)
        keys = [int.from_bytes(x[:8], "little", signed=True) for x in fresh]
        payloads = [data[bounds[i] : bounds[i + 1]] for i in fresh.values()]
        yield {"kind": pa.array(["chunk"] * m), "key": pa.array(keys, pa.int64()), "hash": pa.array(list(fresh), pa.binary()), "width": pa.array([width] * m, pa.int32()), "payload": pa.array(payloads, pa.binary()), "recipe": pa.nulls(m, recipe.type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("ids", digest), lambda: TokenIds(shipped.value))
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES) if batch.num_rows else ():
                for x in columns(part.column(1), part.column(0), encoder.encode_all(part.column(2), end), seen):
                    yield pa.RecordBatch.from_pydict(x)

    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)


def write_store(df: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, vocabulary: int = 50257) -> None:
    """Encode all texts and write the store. Null texts are empty: their stream is the end id alone.

    Repeated rows and ids each have a recipe of their own; null ids come first.
    """
    spark = df.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = _encoded(df, id_col, text_col, path or public_tokenizers.path("byte_bpe_50k.json"), end_id, width)
    copy = F.row_number().over(Window.partitionBy("key", "hash").orderBy("kind"))
    rows.withColumn("copy", copy).filter("copy = 1 or kind = 'recipe'").drop("copy").write.partitionBy("kind").parquet(f"{store}/staged")
    staged = spark.read.schema(f"recipe struct<{_recipe(df.schema[id_col].dataType.simpleString())}>, kind string").parquet(f"{store}/staged")
    _move(spark, f"{store}/staged/kind=chunk", f"{store}/chunks")

    recipes = staged.filter("kind = 'recipe'").select("recipe.*")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = recipes.repartitionByRange(parts, "doc_id", "row").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "", f"{store}/ranged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("rows"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"))
    within = Window.partitionBy("part").orderBy("doc_id", "row")
    start = F.col("ids") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("start", start).withColumn("rank", F.col("rows") + F.row_number().over(within) - 1)
    ordered = placed.select("row", "rank", "doc_id", "start", "n_tokens", "hashes", "ends", "root").repartitionByRange(parts, "start").sortWithinPartitions("start")
    ordered.write.parquet(f"{store}/recipes")
    merkle(spark.read.parquet(f"{store}/recipes"), f"{store}/manifest")
    for name in ("staged", "ranged"):
        discard(spark, f"{store}/{name}")


def _move(spark: SparkSession, old: str, new: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    files = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(a):
        files.rename(a, b)
    else:
        spark.createDataFrame([], CHUNK).write.parquet(new)


def merkle(recipes: DataFrame, path: str) -> None:
    """Write (level, node, hash) over (rank, root): each level has a node for ``FAN_OUT`` below it."""
    level = recipes.select(F.lit(0).alias("level"), F.col("rank").alias("node"), F.col("root").alias("hash"))
    number = 0
    while True:
        number += 1
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", F.hex("hash").alias("hash")))), lambda x: x.hash)
        level = level.groupBy(F.floor(F.col("node") / FAN_OUT).alias("parent")).agg(F.unhex(F.sha2(F.array_join(ordered, ""), 256)).alias("hash"))
        level.select(F.lit(number).alias("level"), F.col("parent").alias("node"), "hash").write.mode("append").parquet(path)
        level = recipes.sparkSession.read.parquet(path).filter(F.col("level") == number)
        if level.count() <= 1:
            return


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements modulo that of CRC-32, highest power in the lowest bit."""
    a, b, out = a.copy(), b.copy(), np.zeros_like(b)
    for _ in range(32):
        out ^= np.where(a >> np.uint32(31) != 0, b, np.uint32(0))
        a <<= np.uint32(1)
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1) != 0, POLYNOMIAL, np.uint32(0))
    return out


def crc_before(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each part's CRC-32 adds (by XOR) to that of the whole, with so many bytes after the part."""
    out, power = crcs.astype(np.uint32), np.array([1 << 23], np.uint32)  # x to the 8: one byte
    after = after.astype(np.int64)
    while after.any():
        odd = after & 1 == 1
        out[odd] = _times(np.broadcast_to(power, int(odd.sum())), out[odd])
        after >>= 1
        power = _times(power, power)
    return out


def read_chunks(spark: SparkSession, store: str) -> DataFrame:
    """(hash, n, crc, sound) of each stored chunk; ``sound`` if its payload has that hash, crc is of 32-bit ids."""

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        counts, crcs, sound = [], [], []
        for own, width, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ids = np.frombuffer(payload[: len(payload) // width * width], f"<u{width}")
            sound.append(hashlib.blake2b(payload, digest_size=16).digest() == own)
            counts.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield {"hash": batch.column(0), "n": pa.array(counts, pa.int64()), "crc": pa.array(crcs, pa.int64()), "sound": pa.array(sound)}

    return by_arrow(spark.read.parquet(f"{store}/chunks").select("hash", "width", "payload"), "hash binary, n long, crc long, sound boolean", run, text=2)


def _pieces(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document."""
    piece = F.posexplode(F.arrays_zip("hashes", "ends")).alias("place", "piece")
    pieces = recipes.select("row", "doc_id", "start", "n_tokens", piece)
    return pieces.select("row", "doc_id", "start", "n_tokens", "place", F.col("piece.hashes").alias("hash"), (F.col("n_tokens") - F.col("piece.ends")).alias("after"))


def _failed(what: str, then: str) -> Column:
    return F.raise_error(F.concat(F.lit(what), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(then)))


def document_digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the files.

    A document's CRC is put together from those of its chunks, so that no payload is shuffled. A
    chunk that is missing or damaged, a recipe that counts other ids than its chunks hold, and
    recipes that don't lead to the manifest raise an error.
    """
    if not broken_nodes(spark, store).isEmpty():
        raise ValueError(f"the recipes in {store} don't lead to its manifest")

    def shifted(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        own = {c: batch.column(i) for i, c in enumerate(("row", "doc_id", "start", "said", "n"))}
        crc = crc_before(batch.column(5).to_numpy().astype(np.uint32), batch.column(6).to_numpy() * 4)
        yield own | {"crc": pa.array(crc.astype(np.int64))}

    recipes = spark.read.parquet(f"{store}/recipes")
    joined = _pieces(recipes).join(read_chunks(spark, store), "hash", "left")
    n = F.when(F.col("sound"), F.col("n")).otherwise(_failed("a chunk of document ", " is missing or damaged"))
    parts = joined.select("row", "doc_id", "start", F.col("n_tokens").alias("said"), n.alias("n"), "crc", "after")
    id_type = recipes.schema["doc_id"].dataType.simpleString()
    own = by_arrow(parts, f"row long, doc_id {id_type}, start long, said long, n long, crc long", shifted)
    sums = own.groupBy("row", "doc_id", "start", "said").agg(F.sum("n").alias("n"), F.expr("bit_xor(crc)").alias("ids_crc32"))
    counted = F.when(F.col("n") == F.col("said"), F.col("n")).otherwise(_failed("the chunks of document ", " hold another number of ids than its recipe says"))
    return sums.select("doc_id", "start", counted.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, width, payload) with each document's whole stream, rebuilt from its chunks."""
    pieces = _pieces(spark.read.parquet(f"{store}/recipes")).join(spark.read.parquet(f"{store}/chunks").select("hash", "width", "payload"), "hash")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("payload").alias("part")))), lambda x: x.part)
    return pieces.groupBy("row", "doc_id", "start").agg(F.max("width").alias("width"), F.unhex(F.array_join(parts, "")).alias("payload")).drop("row")


def broken_nodes(spark: SparkSession, store: str) -> DataFrame:
    """(level, node) of the manifest that the chunk hashes of the recipes, hashed anew, don't lead to, or that lack."""
    recipes = spark.read.parquet(f"{store}/recipes")
    anew = scratch_path(spark, "merkle")
    merkle(recipes.withColumn("root", F.unhex(F.sha2(F.unhex(F.array_join(F.transform("hashes", F.hex), "")), 256))), anew)
    found, told = spark.read.parquet(anew), spark.read.parquet(f"{store}/manifest")
    wrong = found.select("level", "node", F.col("hash").alias("found")).join(told, ["level", "node"], "full_outer")
    wrong = materialize(wrong.filter(~F.col("found").eqNullSafe(F.col("hash"))).select("level", "node"), "merkle-wrong")
    discard(spark, anew)
    return wrong


def broken(spark: SparkSession, store: str) -> DataFrame:
    """(rank, doc_id) of documents whose stored chunks don't lead to the manifest's hashes; none in a sound store."""
    recipes = spark.read.parquet(f"{store}/recipes")
    there = read_chunks(spark, store).filter("sound").select("hash").distinct()
    lost = _pieces(recipes).join(there, "hash", "left_anti").select("row")
    wrong = broken_nodes(spark, store).filter("level = 1").select("node")
    first = F.floor(F.col("rank") / FAN_OUT)
    return recipes.join(lost, "row", "left_semi").unionByName(recipes.join(wrong, first == F.col("node"), "left_semi")).select("rank", "doc_id").distinct()
