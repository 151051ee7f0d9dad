"""Queries of tables as files: exports, outbox, retention by day, versions, changes; each next to its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import maintenance, reports
from quillmill.plans import registry
from quillmill.plans.catalogue import oracle_of, query
from quillmill.plans.registry import AS_OF
from quillmill.plans.texts import outbox_of
from quillmill.plans.views import view
from quillmill.sources import stores
from quillmill.sources.scratch import discard, scratch_path, until_exit, written

CELLS = "created_at string, sender_name string, sender_addr string, subject string, doc_type string, urgency string, status string, case_summary string, key_date string, case_number string, involved_parties string, targets string, attachments string"


@query(oracle_of(registry.export_rows))
def exported_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as it lies in its parts, read back without its header (A10)."""
    path = scratch_path(spark, "export")
    reports.export_log_csv(view(spark, sf_dir, "mail_log"), view(spark, sf_dir, "attachments"), path)
    until_exit(spark, path)
    header = ",".join(c.split()[0] for c in CELLS.split(", "))
    lines = spark.read.option("lineSep", "\r\n").text(path).filter(~F.col("value").isin(header, f"{reports.BOM}{header}"))
    cells = F.from_csv("value", F.lit(CELLS), reports.CSV)
    return lines.select(cells.alias("c")).select(*[F.coalesce(f"c.{c.split()[0]}", F.lit("")).alias(c.split()[0]) for c in CELLS.split(", ")])


@query("SELECT trim(t) AS target_email, count(*) AS mails, count(*) AS listed FROM (SELECT unnest(string_split(target_email, ',')) AS t FROM mail_log) GROUP BY 1", "mail_log")
def stored_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox in sixteen parts, and what its manifest says of each target."""
    path = scratch_path(spark, "outbox")
    mails = outbox_of(spark, sf_dir, brief=True)
    stores.write_outbox(mails, path, 16, "gzip")
    until_exit(spark, path)
    stored = spark.read.schema("mail_id long, target_email string, subject string, body string").json(f"{path}/mails").filter("body like '您好%'")
    listed = spark.read.parquet(f"{path}/manifest").groupBy("target_email").agg(F.sum("n").alias("listed"))
    return stored.groupBy("target_email").agg(F.count("*").alias("mails")).join(listed, "target_email")


@query(f"SELECT id, status FROM mail_log WHERE created_at IS NULL OR created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY", "mail_log")
def retained_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention over a log by day: whole days are dropped unread, the day of the limit is written anew (K1)."""
    path, schema = scratch_path(spark, "by-day"), "id long, status string, created_at timestamp_ntz"
    log = view(spark, sf_dir, "mail_log").select("id", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    near = F.col("created_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 430 days")
    month = F.when(near, F.col("created_at")).otherwise(F.date_trunc("month", "created_at").cast("timestamp_ntz"))  # fewer folders
    stores.write_by_day(log.withColumn("created_at", month), path)
    stores.drop_expired(spark, path, schema, AS_OF, 400)
    until_exit(spark, path)
    return stores.read_by_day(spark, path, schema).select("id", "status")


@query("SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(id % 5 AS VARCHAR) ELSE account_ids END AS account_ids, CASE WHEN id % 3 = 0 THEN 'account' ELSE coalesce(nullif(rule_type, ''), 'account') END AS rule_type, CASE id % 3 WHEN 2 THEN id % 2 = 0 ELSE TRUE END AS enabled, CASE id % 3 WHEN 2 THEN NULL ELSE '' END AS target_name, CAST(id % 3 AS VARCHAR) AS version FROM rule_forms", "rule_forms")
def rules_of_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of three versions in one folder, read as one table of today's columns."""
    path = scratch_path(spark, "versions")
    rows = view(spark, sf_dir, "rule_forms")
    own = ("id, target_email", "id, target_email, rule_type, CAST(id % 5 AS INT) AS account_id", "id, target_email, rule_type, account_ids, doc_type, CAST(NULL AS STRING) AS target_name, id % 2 = 0 AS enabled")
    for version, columns in enumerate(own):
        rows.filter(f"id % 3 = {version}").selectExpr(*columns.replace("CAST(id % 5 AS INT)", "cast(id % 5 as int)").split(", ")).write.parquet(f"{path}/version={version}")
    until_exit(spark, path)
    return stores.read_versions(spark, path, "rules").select("id", "account_ids", "rule_type", "enabled", "target_name", "version")


@query("WITH c AS (SELECT id, name, imap_host, username FROM accounts), s1 AS (SELECT name, CASE WHEN id % 3 = 0 THEN '***' ELSE 'one' || id END AS imap_host FROM c WHERE id % 2 = 0), s2 AS (SELECT CASE WHEN id % 4 = 0 THEN 'new ' || id ELSE name END AS name, 'two' || id AS imap_host, 'u' || id AS username FROM c WHERE id % 5 = 0), s3 AS (SELECT name, CAST(NULL AS VARCHAR) AS username FROM c WHERE id % 7 = 0), k AS (SELECT name FROM c UNION SELECT name FROM s2) SELECT k.name, c.id, CASE WHEN s2.name IS NOT NULL THEN s2.imap_host WHEN s1.imap_host <> '***' THEN s1.imap_host ELSE c.imap_host END AS imap_host, CASE WHEN s3.name IS NOT NULL THEN s3.username WHEN s2.name IS NOT NULL THEN s2.username ELSE c.username END AS username, TRUE AS same FROM k LEFT JOIN c USING (name) LEFT JOIN s1 USING (name) LEFT JOIN s2 USING (name) LEFT JOIN s3 USING (name)", "accounts")
def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots in turn over a base, merged when read, before and after the second is compacted."""
    path, key, columns = scratch_path(spark, "merged"), ["name"], ["id", "name", "imap_host", "username"]
    rows = view(spark, sf_dir, "accounts").select(*columns)
    stores.write_base(rows, path)
    stores.write_change(rows.filter("id % 2 = 0").selectExpr("name", "CASE WHEN id % 3 = 0 THEN '***' ELSE concat('one', id) END AS imap_host"), path, 1, columns)
    stores.write_change(rows.filter("id % 5 = 0").selectExpr("CASE WHEN id % 4 = 0 THEN concat('new ', id) ELSE name END AS name", "concat('two', id) AS imap_host", "concat('u', id) AS username"), path, 2, columns)
    third = rows.filter("id % 7 = 0").selectExpr("name", "CAST(NULL AS STRING) AS username")
    stores.write_change(third, path, 3, columns)
    before = written(stores.read_merged(spark, path, key, "***"), "merged-before")
    discard(spark, f"{path}/changes/seq={3:012d}")
    stores.compact(spark, path, key, "***")
    stores.write_change(third, path, 3, columns)
    until_exit(spark, path)
    after = stores.read_merged(spark, path, key, "***")
    counted = before.unionByName(after).groupBy(*columns).agg(F.count("*").alias("n"))
    return counted.select("name", "id", "imap_host", "username", (F.col("n") == 2).alias("same"))


@query("SELECT (SELECT count(DISTINCT file_path) FROM attachments WHERE file_path <> '') AS files, CAST(0 AS BIGINT) AS rows", "attachments")
def cleared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the tables once all is cleared, and the files that go (K2)."""
    kept, files = maintenance.clear_all(*(view(spark, sf_dir, n) for n in ("mail_log", "attachments", "ledger")))
    left = kept[0].select("id").unionByName(kept[1].select("id")).unionByName(kept[2].select("id"))
    return files.agg(F.count("*").alias("files")).join(left.agg(F.count("*").alias("rows")))
