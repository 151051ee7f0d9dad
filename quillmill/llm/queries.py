"""The registered queries of the llm operators: thin wrappers that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, langid, licenses, mixing, prefixtrie, quality, secrets, sharding, simhash, tokencount, tokenstore, topk, vectorcodes
from quillmill.llm.common import materialize, scratch_path, until_exit, word_count


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of links at 4 or fewer differing bits.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows stay.
    """
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, weights 1, 2, 3 in cycles, at most three passes."""
    counted = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(materialize(counted, "mix-counted"), F.col("words"), F.array("source"), F.col("doc_id"))
    taken = (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken)


#: A shard's bytes over the mean at most, if slots are small enough.
SLACK = 0.0005


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes: the stored slot map's version 2, which rebalances the even version 1.

    A null text has no bytes, like an empty one. Rows are hashed with a number of their own, so that
    equal ones lie in different virtual slots; it is written with them before any is placed.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("number"),
    )
    slot = sharding.slot_of(F.col("doc_id"), F.col("text_hash"), F.col("number")).alias("slot")
    records = materialize(narrow, "shard-records").select("doc_id", "size", "text_crc32", slot)
    sizes, rows = sharding.slot_totals(records.select("slot", "size"))
    path = scratch_path(spark, "slot-map")
    first = sharding.even_slots(shards)
    for version in (first, sharding.rebalance(first, sizes, slack=SLACK)):
        sharding.write_map(spark, version, path)
    until_exit(spark, path)
    placed = sharding.place(records, sharding.read_map(spark, path), rows, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot")
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into a content-addressed store, and what its files say of each."""
    store = scratch_path(spark, "token-store")
    tokenstore.write_store(documents(spark, sf_dir), store)
    until_exit(spark, store)
    return tokenstore.document_digests(spark, store)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that the language model must not learn from; a null id is not one of them."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that are not held out.

    A null text or one without a letter is ``und`` with score 0; rows are independent.
    """
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after curation edits; only what edits touch is encoded again."""
    return tokencount.count_tokens(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding for all documents, as digests.

    A null text is encoded as the empty one; repeated rows give repeated results.
    """
    return bpe.encode_decode(documents(spark, sf_dir), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents by the base rules and the added ones.

    Null and empty texts have none; rows are independent.
    """
    return secrets.digests(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, with cutoffs certified on the labels.

    Rows that repeat an id are judged each; without labels the base rules alone decide.
    """
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of highest product for each vector whose id is divisible by 100.

    Ties go to the smaller id; vectors null or with null or non-finite components take no part.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings that are whole: 16 parts of 64 entries, two rounds, components as floor(256 x).

    A null vector, or one with a null or non-finite component, is left out; a null label is a label; rows that repeat
    an id are coded each; an empty table gives none.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", vectorcodes.quantized(F.col("embedding")).alias("v"))
    coded, books = vectorcodes.compress(rows)
    summed = vectorcodes.with_label_error(coded)
    return summed.select("vec_id", vectorcodes.hex_codes(F.col("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents: exact phrases, and notices with a bounded number of edits.

    A null text is empty and has neither words nor labels; repeated rows stay; an empty table gives none.
    """
    return licenses.digests(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that groups of twenty share openings; a row for each distinct sequence of first turns.

    Null roles and texts are empty, a null turn is the first; rows without a conv_id take no part; an empty table gives none.
    """
    return prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_simhash, op2_mixing, op3_sharding, op4_token_store, op5_langid, op6_token_counts, op7_bpe, op8_secrets, op9_quality, op10_topk, op11_vector_codes, op12_licenses, op13_prefix_trie)
    return {f.__name__: f for f in named}
