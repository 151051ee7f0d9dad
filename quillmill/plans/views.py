"""The driver's star schema as mail tables; the same expressions serve Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (table, columns in SQL that both engines read alike)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "accounts": ("customer", (
        "c_custkey AS id", "c_name AS name", "concat(lower(c_name), '@example.com') AS username",
        "CASE c_custkey % 4 WHEN 0 THEN 'imap.qq.com' WHEN 1 THEN 'imap.gmail.com' WHEN 2 THEN concat('imap.', lower(c_mktsegment), '.example.org') ELSE 'mail.example.org' END AS imap_host",
        "CASE WHEN c_custkey % 10 = 0 THEN 'src1, SRC3' ELSE '' END AS filter_sender", "c_acctbal > 0 AS enabled")),
    "mail_log": ("orders", (
        "o_orderkey AS id", "o_custkey AS account_id", "concat('m', CAST(o_orderkey % 9000 AS STRING)) AS message_id",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('Order ', CAST(o_orderkey AS STRING), ' ', o_orderpriority) END AS subject",
        "concat('\"Clerk ', CAST(o_custkey % 50 AS STRING), '\" <c', CAST(o_custkey AS STRING), '@example.com>') AS sender",
        "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 11 = 0 THEN 'analyzed' WHEN o_orderstatus = 'F' THEN 'forwarded' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'pending' END AS status",
        "CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS urgency",
        "CASE o_orderkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN '' ELSE NULL END AS doc_type",
        "CASE WHEN o_orderkey % 5 = 0 THEN concat('=sum of ', CAST(o_custkey AS STRING)) ELSE o_orderpriority END AS case_summary",
        "concat('s', CAST(o_custkey % 100 AS STRING), '@example.com, s', CAST(o_orderkey % 100 AS STRING), '@example.com ') AS target_email",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('error ', CAST(o_orderkey AS STRING)) ELSE NULL END AS error_message",
        "CAST(NULL AS STRING) AS key_date", "CAST(NULL AS STRING) AS case_number", "CAST(NULL AS STRING) AS involved_parties")),
    "ledger": ("lineitem", (
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS log_id", "concat(' s', CAST(l_suppkey AS STRING), '@example.com') AS target_email",
        "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('Desk ', CAST(l_suppkey % 9 AS STRING)) END AS target_name",
        "CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END AS doc_type",
        "CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE concat(l_returnflag, ', ', l_linestatus, ',', l_returnflag) END AS doc_types",
        "CASE WHEN l_linenumber = 2 THEN '' ELSE concat('Delivery of part ', CAST(l_partkey AS STRING), ' by supplier ', CAST(l_suppkey AS STRING), ' to somewhere or other and back') END AS subject",
        "l_discount < 0.08 AS success", "l_shipdate AS created_at")),
    "attachments": ("lineitem", (
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS log_id", "concat('part ', CAST(l_partkey AS STRING), CASE l_linenumber % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' ELSE '' END) AS filename",
        "CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN '../out.txt' ELSE concat('attachments/', CAST(l_orderkey AS STRING)) END AS file_path",
        "CAST(l_quantity AS BIGINT) AS file_size")),
    "analyses": ("events", (
        "user_id AS mail_id", "event_id AS group_idx", "CASE WHEN event_id % 9 = 0 THEN '其他法律文书' ELSE event_type END AS doc_type",
        "least(value / 100, 1.0) AS confidence", "event_id % 8 = 0 AS classify_failed", "event_id % 5 = 0 AS llm_failed",
        "concat('summary ', CAST(event_id AS STRING)) AS case_summary", "concat('reading ', CAST(event_id AS STRING)) AS ai_interpretation", "CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS urgency",
        "CAST(NULL AS STRING) AS key_date", "CAST(NULL AS STRING) AS case_number", "concat('user ', CAST(user_id AS STRING)) AS involved_parties")),
    "rule_forms": ("customer", (
        "c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN 'doc_type' WHEN 1 THEN 'account' WHEN 2 THEN 'weird' ELSE NULL END AS rule_type",
        "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(CAST(c_custkey % 60 % 7 AS STRING), ', ', CAST(c_custkey % 3 AS STRING)) END AS account_ids",
        "CASE c_custkey % 6 WHEN 0 THEN ' , ' WHEN 1 THEN 'click, view,click' ELSE c_mktsegment END AS doc_type", "concat(' s', CAST(c_custkey % 60 % 11 AS STRING), '@example.com ') AS target_email", "'' AS target_name",
        "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(c_name, ' , ', c_name) ELSE concat(c_name, ',nobody') END AS account_names", "TRUE AS enabled")),
    "bodies": ("documents", ("doc_id AS mail_id", "doc_id % 40 AS account_id", "source AS sender", "text", "lang")),
    "parts": ("conversations", ("conv_id AS mail_id", "CAST(turn AS INT) AS att_idx", "concat(role, CAST(turn AS STRING), '.txt') AS filename", "text")),
}

#: Rules as rows: id, rule_type, account_ids, doc_type, target_email, target_name, enabled.
RULES = (
    (1, "account", "", "", " all@example.com , ops@example.com", "", True),
    (2, "account", "3,4, 5", "", "three@example.com", "Three", True),
    (3, "doc_type", "", "click, purchase", "shop@example.com,ops@example.com", "Shop", True),
    (4, "doc_type", "7,8,9", "view", "seven@example.com", " ", True),
    (5, None, "x", "", "never@example.com", "Never", True),
    (6, "doc_type", "", "error", "late@example.com", "Late", False),
    (7, "doc_type", "", "", "typeless@example.com", "", True),
    (8, "account", "", "", "  ", "Blank", True),
    (9, "account", "3,4, 5", "", "three@example.com ", "Again", True),
)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "id bigint, rule_type string, account_ids string, doc_type string, target_email string, target_name string, enabled boolean")


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, str) else str(x)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it reads in front."""
    if not names:
        return sql
    parts = []
    for name in names:
        if name == "rules":
            rows = ", ".join(f"({', '.join(map(_literal, r))})" for r in RULES)
            parts.append(f"rules AS (SELECT * FROM (VALUES {rows}) AS r(id, rule_type, account_ids, doc_type, target_email, target_name, enabled))")
        else:
            table, columns = VIEWS[name]
            parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table})")
    start = f"WITH {', '.join(parts)}"
    return f"{start}, {sql[5:]}" if sql.startswith("WITH ") else f"{start} {sql}"
