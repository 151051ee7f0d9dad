"""Schemas and table IO of the five mail tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmill.sources.scratch import scratch_path, until_exit

SCHEMAS = {
    "accounts": "id bigint, name string, username string, imap_host string, filter_sender string, check_interval int, download_attachments boolean, enabled boolean",
    "mail_log": "id bigint, account_id bigint, message_id string, subject string, sender string, recipient string, received_at timestamp_ntz, body_text string, doc_type string, doc_types string, case_summary string, ai_interpretation string, urgency string, key_date string, case_number string, involved_parties string, target_email string, status string, llm_raw_response string, error_message string, created_at timestamp_ntz",
    "attachments": "id bigint, log_id bigint, filename string, file_path string, file_size bigint, created_at timestamp_ntz",
    "ledger": "id bigint, log_id bigint, target_email string, target_name string, doc_type string, doc_types string, subject string, success boolean, created_at timestamp_ntz",
    "rules": "id bigint, rule_type string, account_ids string, doc_type string, target_email string, target_name string, enabled boolean",
}


def read_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for name in names}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_history(known: DataFrame, path: str | None = None, table: str | None = None, buckets: int = 64) -> str:
    """Known message ids, each once, as a table bucketed by message_id and sorted within; its name in the session's catalogue.

    A join on message_id reads it as it lies: only the other side is shuffled, to as many partitions.
    Without a path it is a scratch table. A later session finds it by ``attach_history``.
    """
    spark = known.sparkSession
    scratch = path is None
    path, table = path or scratch_path(spark, "history"), table or f"history_{uuid.uuid4().hex}"
    ids = known.select("message_id").filter("message_id <> ''").distinct()
    ids.write.bucketBy(buckets, "message_id").sortBy("message_id").option("path", path).saveAsTable(table)
    if scratch:
        until_exit(spark, path)
    return table


def attach_history(spark: SparkSession, table: str, path: str, buckets: int = 64) -> None:
    """Names a bucketed history written before; ``buckets`` as it was written."""
    spark.sql(f"CREATE TABLE {table} (message_id STRING) USING parquet CLUSTERED BY (message_id) SORTED BY (message_id) INTO {buckets} BUCKETS LOCATION '{path}'")


def read_history(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
