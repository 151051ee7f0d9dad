"""Queries of reports, routing, the ledger and differences, each next to its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as fn
from quillmill.operators import ledger, maintenance, modelio, reports, revision, routing
from quillmill.plans.catalogue import query
from quillmill.plans.views import rules, view
from quillmill.sources import mail
from quillmill.streaming import polls

FLAGSHIP = "target_summary"
AS_OF, SINCE = "2000-06-15 12:00:00", "1999-01-01 00:00:00"


LISTED = "list_filter(list_transform(string_split({}, ','), lambda x: trim(x)), lambda x: x <> '')"
TYPES = f"CASE WHEN trim(doc_types) = '' THEN {LISTED.format('doc_type')} ELSE {LISTED.format('doc_types')} END"
TOTALS = f"SELECT trim(target_email) AS target, count(*) FILTER (WHERE success) AS total, count(*) FILTER (WHERE NOT success) AS failed FROM ledger WHERE created_at >= TIMESTAMP '{SINCE}' AND trim(target_email) <> '' GROUP BY 1"
TYPE_COUNTS = f"SELECT target, type, count(*) AS n FROM (SELECT trim(target_email) AS target, unnest(CASE WHEN len({TYPES}) = 0 THEN ['未识别'] ELSE list_distinct({TYPES}) END) AS type FROM ledger WHERE success AND created_at >= TIMESTAMP '{SINCE}' AND trim(target_email) <> '') GROUP BY 1, 2"


@query(f"WITH totals AS ({TOTALS}), kinds AS ({TYPE_COUNTS}) SELECT t.target, t.total, t.failed, k.type, k.n, round(k.n * 100.0 / t.total, 1) AS share FROM totals t LEFT JOIN kinds k USING (target)", "ledger")
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was forwarded to each target since a time, by type."""
    return reports.target_summary(view(spark, sf_dir, "ledger"), SINCE)


@query(f"SELECT trim(target_email) AS target, count(*) FILTER (WHERE success) AS total, count(*) FILTER (WHERE NOT success) AS failed, coalesce((min(struct_pack(a := created_at, b := target_name)) FILTER (WHERE trim(target_name) <> '')).b, '') AS name FROM ledger WHERE created_at >= TIMESTAMP '{SINCE}' GROUP BY 1", "ledger")
def target_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.target_totals(view(spark, sf_dir, "ledger"), SINCE)


@query(f"SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'forwarded') AS forwarded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE urgency = 'high') AS urgent, count(*) FILTER (WHERE doc_type <> '') AS analyzed FROM mail_log WHERE created_at >= date_trunc('day', TIMESTAMP '{AS_OF}')", "mail_log")
def day_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.day_overview(view(spark, sf_dir, "mail_log"), AS_OF)


@query(f"WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'forwarded') AS forwarded, count(*) FILTER (WHERE created_at >= DATE '{AS_OF[:10]}') AS today_total, count(*) FILTER (WHERE status = 'forwarded' AND created_at >= DATE '{AS_OF[:10]}') AS today_forwarded FROM mail_log) SELECT *, printf('%.1f', forwarded * 100.0 / total) || '%' AS rate, printf('%.1f', today_forwarded * 100.0 / today_total) || '%' AS today_rate FROM s", "mail_log")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cumulative(view(spark, sf_dir, "mail_log"), AS_OF)


@query("SELECT status, count(*) AS n FROM mail_log GROUP BY 1", "mail_log")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(view(spark, sf_dir, "mail_log"))


@query("SELECT CAST(created_at AS DATE) AS day, status, account_id, count(*) AS n, CAST(grouping(CAST(created_at AS DATE), status, account_id) AS INTEGER) AS level FROM mail_log GROUP BY GROUPING SETS ((CAST(created_at AS DATE), status), (account_id, CAST(created_at AS DATE)), (status), ())", "mail_log")
def report_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_cube(view(spark, sf_dir, "mail_log"))


@query(f"SELECT a.id, a.name, coalesce(s.today, 0) AS today, s.latest, CASE WHEN s.latest IS NULL THEN '暂无记录' ELSE '' END AS note FROM accounts a LEFT JOIN (SELECT account_id, count(*) FILTER (WHERE created_at >= DATE '{AS_OF[:10]}') AS today, max(created_at) AS latest FROM mail_log GROUP BY 1) s ON s.account_id = a.id WHERE a.enabled", "accounts", "mail_log")
def account_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.account_activity(view(spark, sf_dir, "accounts"), view(spark, sf_dir, "mail_log"), AS_OF)


CLIP = "CASE WHEN length({0}) > 60 THEN left({0}, 57) || '...' ELSE {0} END"
SUBJECT = "CASE WHEN trim(coalesce(subject, '')) = '' THEN '(无主题)' ELSE subject END"


@query(f"SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY created_at, id) AS INTEGER) AS seq, {CLIP.format('s')} AS subject, type FROM (SELECT trim(target_email) AS target, created_at, id, {SUBJECT} AS s, CASE WHEN trim(doc_type) = '' THEN '未识别' ELSE doc_type END AS type FROM ledger WHERE success AND created_at >= TIMESTAMP '{SINCE}')", "ledger")
def subject_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects per target by time, then id."""
    return reports.subject_lists(view(spark, sf_dir, "ledger"), SINCE)


@query("SELECT id, status FROM mail_log WHERE status = 'failed' AND (subject ILIKE '%1-u_gent%' OR sender ILIKE '%1-u_gent%' OR case_summary ILIKE '%1-u_gent%')", "mail_log")
def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search_log(view(spark, sf_dir, "mail_log"), "failed", "1-u_gent").select("id", "status")


@query("SELECT id, created_at FROM mail_log WHERE created_at >= TIMESTAMP '1999-02-01' AND created_at <= TIMESTAMP '1999-02-10 23:59:59'", "mail_log")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.date_range(view(spark, sf_dir, "mail_log"), "1999-02-01", "1999-02-10").select("id", "created_at")


@query("SELECT id, created_at FROM mail_log ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40", "mail_log")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page(view(spark, sf_dir, "mail_log"), 3).select("id", "created_at")


@query(f"SELECT id, {SUBJECT} AS subject, left(CASE WHEN trim(coalesce(error_message, '')) = '' THEN '未知错误' ELSE error_message END, 120) AS error FROM mail_log WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 5", "mail_log")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_failures(view(spark, sf_dir, "mail_log"))


@query("SELECT doc_type, count(*) AS n FROM mail_log WHERE trim(doc_type) <> '' GROUP BY 1", "mail_log")
def types_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.types_by_count(view(spark, sf_dir, "mail_log"))


@query("SELECT l.id, coalesce(a.names, '') AS attachment_names FROM mail_log l LEFT JOIN (SELECT log_id, string_agg(filename, '; ' ORDER BY id, filename) AS names FROM attachments GROUP BY 1) a ON a.log_id = l.id", "mail_log", "attachments")
def log_with_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_attachments(view(spark, sf_dir, "mail_log"), view(spark, sf_dir, "attachments")).select("id", "attachment_names")


@query("SELECT log_id, filename, file_path, file_size FROM attachments WHERE file_path LIKE 'attachments/%' AND log_id IN (SELECT id FROM mail_log WHERE created_at >= TIMESTAMP '1999-02-01' AND created_at <= TIMESTAMP '1999-03-10 23:59:59')", "mail_log", "attachments")
def attachment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attachment_manifest(view(spark, sf_dir, "attachments"), view(spark, sf_dir, "mail_log"), "attachments", "1999-02-01", "1999-03-10")


SAFE = r"CASE WHEN regexp_matches({0}, '^\s*[=+@-]') THEN chr(39) || {0} ELSE {0} END AS {0}"
EXPORTED = """
t AS (SELECT strftime(l.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, regexp_extract(sender, '"(.*)"', 1) AS sender_name, regexp_extract(sender, '<(.*)>', 1) AS sender_addr, coalesce(subject, '') AS subject, coalesce(doc_type, '') AS doc_type,
    CASE urgency WHEN 'high' THEN '紧急' WHEN 'low' THEN '普通' ELSE '一般' END AS urgency, CASE status WHEN 'pending' THEN '待处理' WHEN 'analyzed' THEN '已分析' WHEN 'forwarded' THEN '已转发' WHEN 'failed' THEN '失败' ELSE '已跳过' END AS status,
    case_summary, coalesce(key_date, '') AS key_date, coalesce(case_number, '') AS case_number, coalesce(involved_parties, '') AS involved_parties, target_email AS targets, coalesce(a.names, '') AS attachments
    FROM mail_log l LEFT JOIN (SELECT log_id, string_agg(filename, '; ' ORDER BY id, filename) AS names FROM attachments GROUP BY 1) a ON a.log_id = l.id)
"""


@query(f"WITH {EXPORTED.strip()} SELECT {', '.join(map(SAFE.format, ('created_at', 'sender_name', 'sender_addr', 'subject', 'doc_type', 'urgency', 'status', 'case_summary', 'key_date', 'case_number', 'involved_parties', 'targets', 'attachments')))} FROM t", "mail_log", "attachments")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 columns of the export (A10)."""
    return reports.export_rows(view(spark, sf_dir, "mail_log"), view(spark, sf_dir, "attachments"))


MATCH = """
r AS (SELECT id AS rule_id, rule_type, trim(account_ids) AS ids, target_email, trim(target_name) AS name,
        list_transform(list_filter(list_transform(string_split(account_ids, ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS BIGINT)) AS accounts,
        list_filter(list_transform(string_split(doc_type, ','), lambda x: trim(x)), lambda x: x <> '') AS types
      FROM rules WHERE enabled AND trim(target_email) <> ''),
m AS (SELECT id AS mail_id, account_id, CASE WHEN doc_type <> '' THEN [doc_type] ELSE [] END AS types FROM mail_log),
hits AS (SELECT m.mail_id, r.rule_id, r.name, unnest(string_split(r.target_email, ',')) AS raw, generate_subscripts(string_split(r.target_email, ','), 1) AS pos
      FROM m JOIN r ON (r.ids = '' OR list_contains(r.accounts, m.account_id)) AND (coalesce(r.rule_type, '') <> 'doc_type' OR list_has_any(r.types, m.types))),
t AS (SELECT mail_id, trim(raw) AS target, min(rule_id * 1000 + pos) AS o, coalesce(arg_min(name, rule_id * 1000 + pos) FILTER (WHERE name <> ''), '') AS name FROM hits WHERE trim(raw) <> '' GROUP BY 1, 2)
"""


@query(f"WITH {MATCH.strip()} SELECT mail_id, target, name, CAST(row_number() OVER (PARTITION BY mail_id ORDER BY o) AS INTEGER) AS place FROM t", "mail_log", "rules")
def matched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules against mails: scopes, types, order and names of targets."""
    from pyspark.sql.window import Window

    log = view(spark, sf_dir, "mail_log")
    mails = log.select(F.col("id").alias("mail_id"), "account_id", F.when(F.col("doc_type") != "", F.array("doc_type")).otherwise(F.array().cast("array<string>")).alias("doc_types"))
    found = routing.ordered_targets(routing.match_rules(mails, rules(spark)))
    return found.select("mail_id", "target", "name", F.row_number().over(Window.partitionBy("mail_id").orderBy("first")).alias("place"))


ASSEMBLED = """
g AS (SELECT mail_id, arg_min(doc_type, group_idx) AS doc_type, arg_min(case_summary, group_idx) AS case_summary, string_agg(doc_type, ',' ORDER BY group_idx) AS doc_types,
        list(doc_type ORDER BY group_idx) AS types, coalesce(list(DISTINCT doc_type) FILTER (WHERE classify_failed), []) AS unsure,
        bool_or(llm_failed) AS any_failed, bool_and(llm_failed) AS all_failed, bool_and(classify_failed) AS no_basis FROM analyses GROUP BY 1),
p AS (SELECT mail_id, doc_type AS pick_type, confidence AS pick_confidence FROM (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY llm_failed, CASE WHEN llm_failed THEN 0 ELSE confidence END DESC, group_idx) AS n FROM analyses) WHERE n = 1)
"""


@query(f"WITH {ASSEMBLED.strip()} SELECT mail_id, doc_type, case_summary, doc_types, pick_type, pick_confidence, array_to_string(list_sort(list_filter(list_distinct(types), lambda x: NOT list_contains(unsure, x))), ',') AS route_types, any_failed, all_failed, no_basis FROM g JOIN p USING (mail_id)", "analyses")
def assembled_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups to mails: first fields, types, pick and verdicts."""
    rows = routing.assemble_mail(view(spark, sf_dir, "analyses"))
    return rows.select("mail_id", "doc_type", "case_summary", "doc_types", "pick_type", "pick_confidence", F.array_join(F.array_sort("route_types"), ",").alias("route_types"), "any_failed", "all_failed", "no_basis")


@query("WITH t AS (SELECT id AS log_id, unnest(string_split(target_email, ',')) AS raw, generate_subscripts(string_split(target_email, ','), 1) - 1 AS pos FROM mail_log WHERE status = 'failed') SELECT log_id, CAST(pos AS INTEGER) AS pos, trim(raw) AS target FROM t WHERE trim(raw) <> '' AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.success AND l.log_id = t.log_id AND trim(l.target_email) = trim(t.raw))", "mail_log", "ledger")
def pending_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending_targets(view(spark, sf_dir, "mail_log"), view(spark, sf_dir, "ledger"))


@query("SELECT log_id, CASE WHEN bool_and(success) THEN 'forwarded' ELSE 'failed' END AS status, max(subject) FILTER (WHERE NOT success AND created_at = last_bad) AS error FROM (SELECT *, max(created_at) FILTER (WHERE NOT success) OVER (PARTITION BY log_id) AS last_bad FROM ledger) GROUP BY 1", "ledger")
def delivery_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = view(spark, sf_dir, "ledger").select("log_id", "success", F.col("subject").alias("error"), F.struct("created_at", "subject").alias("seq"))
    return ledger.delivery_outcome(attempts)


@query("WITH f AS (SELECT mail_id, bool_or(llm_failed) AS failed FROM analyses GROUP BY 1), d AS (SELECT mail_id, string_agg(doc_type, ' / ' ORDER BY o) AS types FROM (SELECT mail_id, doc_type, min(group_idx) AS o FROM analyses GROUP BY 1, 2) GROUP BY 1) SELECT l.id AS mail_id, '【' || CASE WHEN f.failed THEN '大模型分析失败' WHEN d.types IS NOT NULL THEN d.types ELSE '法律文书' END || '】' || coalesce(l.subject, '') AS subject FROM mail_log l LEFT JOIN f ON f.mail_id = l.id LEFT JOIN d ON d.mail_id = l.id", "mail_log", "analyses")
def outgoing_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = view(spark, sf_dir, "mail_log").select(F.col("id").alias("mail_id"), "subject")
    return ledger.compose_subjects(view(spark, sf_dir, "analyses"), mails)


@query(f"SELECT id FROM mail_log WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY", "mail_log")
def expired_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.expired(view(spark, sf_dir, "mail_log"), AS_OF, -1)


@query(f"SELECT count(*) AS n, sum(file_size)::BIGINT AS bytes FROM attachments WHERE log_id NOT IN (SELECT id FROM mail_log WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)", "mail_log", "attachments")
def retained_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention run keeps of the children."""
    log, att, rows = (view(spark, sf_dir, n) for n in ("mail_log", "attachments", "ledger"))
    _, kept, _ = maintenance.delete_mails(log, att, rows, maintenance.expired(log, AS_OF, None))
    return kept.agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query("SELECT message_id, min(id) AS id FROM mail_log WHERE id > 5000 AND message_id NOT IN (SELECT message_id FROM mail_log WHERE id <= 5000) GROUP BY 1", "mail_log")
def new_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication within a batch and against the history."""
    log = view(spark, sf_dir, "mail_log")
    return mail.drop_known(mail.dedup_batch(log.filter("id > 5000"), ["id"]), log.filter("id <= 5000")).select("message_id", "id")


@query("SELECT b.mail_id, b.sender FROM bodies b LEFT JOIN accounts a ON a.id = b.account_id WHERE NOT (contains(lower(b.sender), 'src17') OR (coalesce(a.filter_sender, '') <> '' AND (contains(lower(b.sender), 'src1') OR contains(lower(b.sender), 'src3'))))", "bodies", "accounts")
def allowed_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.filter_senders(view(spark, sf_dir, "bodies"), view(spark, sf_dir, "accounts"), ["SRC17 ", ""]).select("mail_id", "sender")


@query("SELECT id, CASE WHEN imap_host = 'imap.qq.com' THEN 'smtp.qq.com' WHEN imap_host = 'imap.gmail.com' THEN 'smtp.gmail.com' WHEN imap_host LIKE 'imap.%' THEN 'smtp.' || substr(imap_host, 6) END AS host, CASE WHEN imap_host = 'imap.qq.com' THEN 465 WHEN imap_host LIKE 'imap.%' THEN 587 END AS port FROM accounts", "accounts")
def sender_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "accounts").select("id", fn.infer_endpoint(F.col("imap_host")).alias("e"))
    return found.select("id", "e.host", "e.port")


@query("SELECT mail_id, greatest(CAST(floor(length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')) / 0.85 + length(regexp_replace(text, '[一-鿿㐀-䶿]', '', 'g')) / 4) AS BIGINT), CAST(floor(length(text) / 10) AS BIGINT)) AS tokens FROM bodies", "bodies")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bodies").select("mail_id", fn.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT mail_id, string_agg('=== 附件: ' || filename || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY att_idx) AS text FROM parts GROUP BY 1", "parts")
def combined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelio.combine_texts(view(spark, sf_dir, "parts"), ["mail_id"])


@query("SELECT mail_id, max(att_idx) AS last FROM (SELECT mail_id, att_idx, sum(length(text)) OVER w + 2 * (count(*) OVER w - 1) AS chars FROM parts WINDOW w AS (PARTITION BY mail_id ORDER BY att_idx ROWS UNBOUNDED PRECEDING)) WHERE greatest(floor(chars / 4), floor(chars / 10)) <= 120 GROUP BY 1", "parts")
def fitted_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prefix of parts within a token budget (E5)."""
    return modelio.fit_attachments(view(spark, sf_dir, "parts"), F.lit(120)).groupBy("mail_id").agg(F.max("att_idx").alias("last"))


@query("SELECT mail_id, string_agg(CAST(att_idx AS VARCHAR) || '. ' || filename || ' ' || trim(translate(left(text, 150), chr(13) || chr(10), '  ')), chr(10) ORDER BY att_idx) AS listing FROM parts GROUP BY 1", "parts")
def group_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelio.group_listing(view(spark, sf_dir, "parts"))


@query("SELECT page_id, length(html) AS n_html, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(regexp_replace(html, '\\s+', '', 'g')) AS n_solid FROM pages")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without white space of the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.length("html").cast("long").alias("n_html"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length(fn.squash_ws(F.col("html"))).cast("long").alias("n_solid"))


@query("""WITH t AS (SELECT page_id, string_split(regexp_replace(regexp_replace(replace(html, '"</p>"', chr(3)), '<!--.*?-->', chr(1), 'g'), '<[^>]*>', chr(1), 'g'), chr(1)) AS s FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(s, lambda x: trim(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(3), '"</p>"'), ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS text FROM t""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", mail.html_to_text(F.col("html")).alias("text"))


@query("SELECT id, filename, CASE WHEN filename LIKE '%.zip' THEN 'zip' END AS kind, lower(regexp_extract(filename, '\\.([a-zA-Z]+)$', 1)) AS ext FROM attachments", "attachments")
def attachment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "attachments").select("id", "filename", fn.archive_kind(F.col("filename")).alias("kind"), fn.extension(F.col("filename")).alias("ext"))


@query(f"SELECT CAST(created_at AS DATE) AS day, trim(target_email) AS target, count(*) FILTER (WHERE success) AS total, count(*) FILTER (WHERE NOT success) AS failed FROM ledger GROUP BY 1, 2", "ledger")
def daily_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries; the streaming job shares the code (I4)."""
    return polls.daily_targets(view(spark, sf_dir, "ledger"))


@query()
def text_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between each turn and itself with words replaced (H20), then the guard."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat_ws("-", "conv_id", "turn")
    pairs = turns.select(key.alias("pair_id"), F.split("text", r"(?<=\.) ").alias("original"), F.regexp_replace(F.regexp_replace("text", r"(?<=\.) ", "\n"), r"\b(the|de|la|der)\b", "【修改】x【/修改】").alias("revised"))
    return revision.revision_guard(revision.diff_pairs(pairs))
