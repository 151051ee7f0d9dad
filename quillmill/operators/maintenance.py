"""Deletes, retention, upserts and schema upgrades of the mail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.names import fresh

KEEP_DAYS = 90


def delete_mails(log: DataFrame, attachments: DataFrame, ledger: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of the three tables without the mails of ``ids`` (column id)."""
    gone = ids.select("id").distinct()
    return tuple(t.join(gone.withColumnRenamed("id", key), key, "left_anti").select(t.columns) for t, key in ((log, "id"), (attachments, "log_id"), (ledger, "log_id")))


def clear_all(log: DataFrame, attachments: DataFrame, ledger: DataFrame) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The three tables without rows, and (file_path) of the files that go with them, each once."""
    files = attachments.filter("file_path <> ''").select("file_path").distinct()
    return tuple(t.filter(F.lit(False)) for t in (log, attachments, ledger)), files


def retention_days(setting: int | None) -> int | None:
    """Days to keep: 90 if unset or negative, None for ever if exactly 0."""
    if setting is None or setting < 0:
        return KEEP_DAYS
    return setting or None


def expired(log: DataFrame, as_of: str, setting: int | None) -> DataFrame:
    """(id) of mails older than the retention; none if they are kept for ever."""
    days = retention_days(setting)
    old = F.lit(False) if days is None else F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return log.filter(old).select("id")


def files_to_remove(attachments: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("id").alias("log_id"))
    return attachments.join(gone, "log_id", "left_semi").filter("file_path <> ''").select("file_path").distinct()


def stuck(log: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """(id) of mails that a failed run left pending."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return log.filter((F.col("status") == "pending") & (F.col("created_at") < limit)).select("id")


def upsert(current: DataFrame, snapshot: DataFrame, key: list[str], skip: str | None = None) -> DataFrame:
    """Rows of both by natural key; the snapshot's columns win, but for values equal to ``skip``."""
    old = current.alias("old")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key]
    there = F.lit(True)
    flag = fresh(snapshot, "is_new")
    new = snapshot.withColumn(flag, there).alias("new")
    joined = old.join(new, on, "full_outer")

    def merged(c: str):
        if c not in snapshot.columns:
            return F.col(f"old.{c}").alias(c)
        value = F.col(f"new.{c}")
        use = F.coalesce(F.col(f"new.{flag}"), F.lit(False)) & (F.lit(True) if skip is None or c in key else ~value.cast("string").eqNullSafe(F.lit(skip)))
        return F.when(use, value).otherwise(F.col(f"old.{c}")).alias(c)

    return joined.select(*[merged(c) for c in current.columns])


#: Columns that later versions added to a table, with their types and defaults.
ADDED_COLUMNS = {
    "accounts": (("forward_to", "string", ""),),
    "mail_log": (("doc_types", "string", None), ("revision_instructions", "string", None), ("recipient", "string", None)),
    "rules": (("account_ids", "string", ""), ("rule_type", "string", "account"), ("doc_type", "string", ""), ("target_name", "string", ""), ("enabled", "boolean", True)),
    "ocr_config": (("connectivity_ok", "boolean", None), ("pdf_capable", "boolean", None)),
    "llm_config": (("model_type_locked", "boolean", False), ("config_role", "string", "analyzer")),
}


def upgrade_schema(df: DataFrame, table: str) -> DataFrame:
    """A snapshot of an older version with the columns of today; ``table`` is a key of ``ADDED_COLUMNS`` or has no new ones.

    Rules' account_id becomes account_ids, and their blank kinds are account rules.
    """
    out = df
    if table == "rules" and "account_ids" not in df.columns and "account_id" in df.columns:
        out = out.withColumn("account_ids", F.coalesce(F.col("account_id").cast("string"), F.lit("")))
    for name, kind, default in ADDED_COLUMNS.get(table, ()):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default).cast(kind))
    if table != "rules":
        return out
    return out.withColumn("rule_type", F.coalesce(F.nullif("rule_type", F.lit("")), F.lit("account"))).drop("account_id")


def upgrade_rules(rules: DataFrame) -> DataFrame:
    return upgrade_schema(rules, "rules")
