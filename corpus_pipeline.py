"""The corpus pipeline: five stages over the table documents, each one of the llm operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of documents. Nothing in a stage depends on the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, langid, mixing, nearcopies, secrets
from quillmill.llm.common import materialize, word_count
from quillmill.sources.scratch import discard, scope, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns that stages know; others pass through.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage: Stage) -> Stage:
    """``stage`` with all unknown columns under other names, so that they can't clash with an operator's own."""

    @wraps(stage)
    def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
        back = {b: a for a, b in aside.items()}
        out = stage(spark, docs.toDF(*[aside.get(c, c) for c in docs.columns]), sf_dir)
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return apart


@shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letter at all) go; null texts are among them.

    A model without any language calls every text undetermined, so the letters alone decide then.
    """
    model = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    if not model.languages:
        return langid.lettered(docs)
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = langid.identify(docs, model, spans=False, keep=others)
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


@shielded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: five words, a similarity of 0.8."""
    return nearcopies.drop_near_copies(docs)


@shielded
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; no document goes."""
    cleaned = secrets.redact(docs)
    changed = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights: a document is repeated or left out as the mix says."""
    mixed = mixing.mix(docs, word_count(F.col("text")), F.array("source"), F.col("doc_id"))
    copies = mixed.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return copies.select(*docs.columns)


@shielded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): token ids, checked by decoding them."""
    return bpe.encode_decode(docs, outputs=("n_tokens", "ids", "decoded_sha256"), keep=("lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the fitted language model, the SimHash components nor the ids.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written as Parquet and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scope(spark):  # what the stage made on its way
            docs = materialize(stage(spark, docs, sf_dir), "", path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
