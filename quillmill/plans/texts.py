"""Queries of texts, rules, outgoing mails, summaries and table upkeep; each next to its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as fn
from quillmill.operators import ledger, maintenance, reports, revision, routing
from quillmill.plans.catalogue import query
from quillmill.plans.registry import AS_OF, SINCE, TOTALS, TYPE_COUNTS
from quillmill.plans.views import view
from quillmill.sources import tables
from quillmill.sources.scratch import scratch_path, until_exit
from quillmill.streaming import polls

MARKED = "concat('开头', CAST(id AS STRING), '【新增】', case_summary, '【修改】内【/修改】', '【/新增】 【删除】', CASE WHEN id % 2 = 0 THEN '' ELSE status END, '【/删除】【/修改】完【新增】尾')"


@query("""WITH s AS (SELECT id, list_filter([{'kind': 'normal', 'text': '开头' || id}, {'kind': 'add', 'text': case_summary}, {'kind': 'modify', 'text': '内'}, {'kind': 'delete', 'text': CASE WHEN id % 2 = 0 THEN '' ELSE status END}, {'kind': 'normal', 'text': '完'}, {'kind': 'add', 'text': '尾'}], lambda x: x.text <> '') AS pieces FROM mail_log),
e AS (SELECT id, unnest(pieces) AS p, generate_subscripts(pieces, 1) - 1 AS seq FROM s) SELECT id, CAST(seq AS INTEGER) AS seq, p.kind AS kind, p.text AS text FROM e""", "mail_log")
def marked_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by revision marks."""
    rows = view(spark, sf_dir, "mail_log").select("id", F.expr(MARKED).alias("text"))
    return revision.marked_segments(rows, "id", "text")


LONG = ("甲方应当在合理的期限之内向乙方支付全部价款并且承担相应费用", "乙方收到价款之后应当在三十日之内按照约定交付全部货物")


@query(f"""WITH s AS (SELECT id, [['normal', '标题' || id], ['normal', '{LONG[0]}，' || chr(10) || '{LONG[1]}。'], ['delete', status || '尾'], ['normal', '{LONG[1]}。' || chr(10) || '{LONG[0]}。'], ['add', '第' || id || '条 ' || case_summary]] AS ps FROM mail_log),
e AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS seq FROM s) SELECT id, CAST(seq AS INTEGER) AS seq, p[1] AS kind, p[2] AS text FROM e""", "mail_log")
def revised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of marked texts."""
    n = F.col("id").cast("string")
    text = F.concat(F.lit("标题"), n, F.lit(f"\n{LONG[0]}，\n{LONG[1]}。\n\n【删除】"), "status", F.lit(f"【/删除】尾\n \n{LONG[1]}。\r\n{LONG[0]}。\n【新增】第"), n, F.lit("条 "), "case_summary", F.lit("【/新增】"))
    return revision.marked_paragraphs(view(spark, sf_dir, "mail_log").select("id", text.alias("text")), "id", "text")


UNFINISHED = f"regexp_matches({{0}}, '{revision.GOES_ON}')"
STANDALONE = f"({{0}} <> '' AND NOT {UNFINISHED} AND (regexp_matches({{0}}, '{revision.PARAGRAPH_HEAD.replace('{', '{{').replace('}', '}}')}') OR (length({{0}}) <= {revision.SHORT_LINE} AND NOT regexp_matches({{0}}, '{revision.INNER_MARK}'))))"


@query(f"""WITH t AS (SELECT mail_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM bodies),
l AS (SELECT mail_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS n FROM t), s AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12)) AS s FROM l),
p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY mail_id ORDER BY n), '') AS prev FROM s),
b AS (SELECT *, sum(CASE WHEN s <> '' AND (prev = '' OR NOT ({UNFINISHED.format('prev')} OR NOT ({STANDALONE.format('prev')} OR {STANDALONE.format('s')}))) THEN 1 ELSE 0 END) OVER (PARTITION BY mail_id ORDER BY n) AS para FROM p),
g AS (SELECT mail_id, para, CASE WHEN bool_or(contains(raw, ' the ')) THEN 'delete' ELSE 'normal' END AS kind, sum(length(raw)) + count(*) - 1 AS chars FROM b WHERE s <> '' GROUP BY 1, 2)
SELECT mail_id, kind, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM g GROUP BY 1, 2""", "bodies")
def marked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document with some words marked as deleted."""
    marked = view(spark, sf_dir, "bodies").select("mail_id", F.replace("text", F.lit(" the "), F.lit(" 【删除】the【/删除】 ")).alias("text"))
    return revision.marked_paragraphs(marked, "mail_id", "text").groupBy("mail_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT id, '{LONG[0]}。' || chr(10) || '{LONG[1]}。' || '|' || id || '、' || status || '|' || CASE WHEN id % 2 = 0 THEN '甲方：某某，' || chr(10) || '{LONG[1]}。' ELSE '短行|{LONG[1]}。' END AS paragraphs FROM mail_log", "mail_log")
def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of plain texts."""
    n = F.col("id").cast("string")
    text = F.concat(F.lit(f"\n{LONG[0]}。\n{LONG[1]}。\n\n\n"), n, F.lit("、"), "status", F.when(F.col("id") % 2 == 0, "\n甲方：某某，\n").otherwise("\n短行\n"), F.lit(f"{LONG[1]}。\n"))
    return view(spark, sf_dir, "mail_log").select("id", F.array_join(revision.split_paragraphs(text), "|").alias("paragraphs"))


@query("""WITH p AS (SELECT mail_id, length((i - 1) || ': ' || s[i]) AS n, ((i - 1) * 7 + mail_id) % 10 < mail_id % 10 AS gone FROM (SELECT mail_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM bodies WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(i)),
g AS (SELECT mail_id AS pair_id, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS deleted, CAST(sum(n) AS BIGINT) AS whole FROM p GROUP BY 1)
SELECT pair_id, deleted, deleted / whole AS share, deleted >= 800 AND deleted / whole > 0.6 AS rejected FROM g""", "bodies")
def revision_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves without some of their lines, up to all but one in ten of them, and the guard's verdict."""
    n, rows = F.col("mail_id"), view(spark, sf_dir, "bodies")
    lines = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), lambda x, k: F.concat(k.cast("string"), F.lit(": "), x))
    stay = F.filter(lines, lambda _, k: (k * 7 + n) % 10 >= n % 10)
    pairs = rows.select(n.alias("pair_id"), lines.alias("original"), F.array_join(stay, "\n\n").alias("revised"))
    return revision.revision_guard(revision.diff_pairs(pairs))


@query("SELECT id, CASE id % 4 WHEN 0 THEN '修订,审查' WHEN 1 THEN '合同' ELSE '' END AS caps FROM mail_log", "mail_log")
def type_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities in header blocks."""
    text = F.expr("CASE id % 4 WHEN 0 THEN concat('\n---\nname: ', status, '\n Caps : 修订、审查;', status, '\n---\n', case_summary) WHEN 1 THEN '---\ncaps:合同 合同\n---' WHEN 2 THEN concat('---\ncaps: 合同\n----\n', status) ELSE concat(status, '\n---\ncaps: 合同\n---') END")
    return view(spark, sf_dir, "mail_log").select("id", F.array_join(fn.parse_caps(text), ",").alias("caps"))


@query("SELECT p_partkey AS id, p_name || chr(10) || p_brand || ' ' || p_type || ' ' || p_size || chr(10) || chr(10) || 'end' AS text FROM part")
def bare_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without Markdown."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("## "), "p_name", F.lit("\n```sql\nselect 1\n```> **"), "p_brand", F.lit("** _"), "p_type", F.lit("_ `"), F.col("p_size").cast("string"), F.lit("`\n-----\n\n\n\nend  "))
    return part.select(F.col("p_partkey").alias("id"), fn.strip_markdown(text).alias("text"))


@query("SELECT id, case_summary || CASE WHEN id % 3 = 0 THEN chr(10) ELSE '' END AS body, CASE WHEN id % 3 = 0 THEN '【引用依据】：' || status || chr(10) || 'x' ELSE '' END AS citations, CASE WHEN id % 2 = 0 THEN 'see http://a.b/c' ELSE case_summary || chr(10) || chr(10) || '引用依据：' || chr(10) || 'http://a.b/c' || chr(10) || 'http://d' END AS cited FROM mail_log", "mail_log")
def cited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations cut off and appended."""
    rows = view(spark, sf_dir, "mail_log")
    text = F.concat("case_summary", F.when(F.col("id") % 3 == 0, F.concat(F.lit("\n\n【引用依据】："), "status", F.lit("\nx"))).otherwise(""))
    cited = fn.append_citations(F.when(F.col("id") % 2 == 0, "see http://a.b/c").otherwise(F.col("case_summary")), F.array(F.lit("http://a.b/c"), F.lit("http://d")))
    return rows.select("id", fn.split_citations(text).alias("s"), cited.alias("cited")).select("id", "s.body", "s.citations", "cited")


@query("SELECT id, '甲' || CASE WHEN id % 3 = 0 THEN '（待确认）' ELSE case_summary END || '于' || CASE WHEN id % 2 = 0 THEN '2000年1月2日，xxx年xx月' ELSE '2000年1月2日' END || '【其他】' AS text, CASE WHEN id % 2 = 0 THEN '其他,xxxx年x月x日,xxx' ELSE '其他' END AS left_over FROM mail_log", "mail_log")
def filled_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of a document and what is left of them."""
    said = fn.placeholder_value(F.when(F.col("id") % 3 == 0, " None ").otherwise(F.col("case_summary")), F.lit("未知"))
    text = F.concat(F.lit("甲【名】于"), F.when(F.col("id") % 2 == 0, "xxxx年xx月x日，xxx年xx月").otherwise("xxx年xx月"), F.lit("【其他】"))
    filled = fn.fill_placeholders(text, {"名": said}, F.lit("2000年1月2日"))
    return view(spark, sf_dir, "mail_log").select("id", filled.alias("text"), F.array_join(fn.leftovers(filled), ",").alias("left_over"))


@query("SELECT id, CAST(8 + length(status) AS INTEGER) AS width, '合同' || status || '、' || repeat(' ', 12 - length(status)) || '2' AS line, CASE WHEN id % 5 > 0 THEN printf('%.1f', id % 3 * 100.0 / (id % 5)) || '%' ELSE '暂无数据' END AS share FROM (SELECT id, status || 'é ' AS status FROM mail_log)", "mail_log")
def display_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths on a terminal, padding, shares."""
    text = F.concat(F.lit("合同"), "status", F.lit("é 、"))
    return view(spark, sf_dir, "mail_log").select("id", (fn.display_width(text) + 2).alias("width"), F.concat(fn.padded(text, F.lit(16)), F.lit("2")).alias("line"), fn.percent(F.col("id") % 3, F.col("id") % 5).alias("share"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.ms-excel' WHEN 2 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, strftime(created_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown, CASE WHEN id % 2 = 0 THEN '' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS exported FROM ledger", "ledger")
def shown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content types by name and dates as they are shown."""
    name = F.expr("CASE id % 4 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.tar.xls' WHEN 2 THEN 'c.jpeg' ELSE 'none.zip' END")
    at = F.when(F.col("id") % 2 == 1, F.col("created_at"))
    return view(spark, sf_dir, "ledger").select("id", fn.mime_for(name).alias("mime"), fn.format_date(F.col("created_at"), "Asia/Shanghai").alias("shown"), fn.format_date(at, export=True).alias("exported"))


SUMMARY_LINES = "list_aggregate(list_filter([{}], lambda x: x IS NOT NULL), 'string_agg', chr(10))"
SUMMARY_HEAD = "CASE WHEN name <> '' THEN name || ' ' ELSE '' END || '您好，', '', '以下是 S 统计的、D 当天转发给 ' || target || ' 的文书汇总（N）：', ''"
SUMMARY_FAILED = "CASE WHEN failed > 0 THEN '  转发失败：' || failed || ' 封（已记录，需人工关注）' END"


@query(f"""WITH totals AS ({TOTALS}), kinds AS ({TYPE_COUNTS}),
names AS (SELECT trim(target_email) AS target, coalesce(arg_min(trim(target_name), struct_pack(a := created_at, b := target_name)) FILTER (WHERE trim(target_name) <> ''), '') AS name FROM ledger WHERE created_at >= TIMESTAMP '{SINCE}' GROUP BY 1),
k AS (SELECT target, string_agg(type, '、' ORDER BY n DESC, type) AS types, string_agg('  ' || type || repeat(' ', CAST(w - length(type) AS BIGINT) + 2) || printf('%3d', n) || ' 封  (' || printf('%5.1f', CASE WHEN total > 0 THEN n * 100.0 / total ELSE 0 END) || '%)', chr(10) ORDER BY n DESC, type) AS bars, count(*) > 1 AND sum(n) <> max(total) AS note FROM (SELECT k.*, total, max(length(type)) OVER (PARTITION BY target) AS w FROM kinds k JOIN totals USING (target)) GROUP BY 1)
SELECT target, {SUMMARY_LINES.format(SUMMARY_HEAD + ", '📊 转发总数：' || total || ' 封', " + SUMMARY_FAILED + ", '📁 涉及类型：' || types, '', '此为自动生成的每日汇总，请勿回复。', '如需调整接收邮箱或发送时间，请前往系统设置页面配置。'")} AS brief,
{SUMMARY_LINES.format(SUMMARY_HEAD + f", '{reports.RULE}', '📊 今日转发概况', '{reports.RULE}', '  转发总数：' || total || ' 封', " + SUMMARY_FAILED + f", '', '{reports.RULE}', '📁 文书类型分布', '{reports.RULE}', coalesce(bars, '  （今日无转发记录）'), CASE WHEN note THEN chr(10) || '  说明：一封邮件含多份不同类型文书时会按类型分别计数，' || chr(10) || '        因此各类型数量之和可能大于转发总数。' END, '', '{reports.RULE}', '', '此为自动生成的每日汇总，请勿回复。', '如需调整接收邮箱或发送时间，请前往系统设置页面配置。'")} AS whole FROM totals JOIN names USING (target) LEFT JOIN k USING (target)""", "ledger")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's summaries as texts, brief and whole."""
    rows = view(spark, sf_dir, "ledger")
    totals, types = reports.target_totals(rows, SINCE), reports.target_types(rows, SINCE)
    brief, whole = (reports.render_summary(totals, types, "D", brief=b, system="S", now="N").withColumnRenamed("text", name) for b, name in ((True, "brief"), (False, "whole")))
    return brief.join(whole, "target")


#: The body of an outgoing mail, line by line, as its readers know it.
OUTGOING = """WITH a AS (
    SELECT mail_id, group_idx, llm_failed, doc_type, count(*) OVER (PARTITION BY mail_id) AS n, row_number() OVER (PARTITION BY mail_id ORDER BY group_idx) AS i,
        doc_type || CASE WHEN classify_failed THEN '（⚠️类型未识别，请人工复核）' ELSE '' END AS kind, urgency, case_summary, involved_parties, key_date, case_number, confidence, ai_interpretation
    FROM analyses
), s AS (
    SELECT *, CASE WHEN n > 1 THEN printf(chr(10) || '── 第 %d 组：', i) || kind || ' ──' || chr(10) ELSE '' END
        || '📋 文书类型：' || kind || chr(10) || '⚡ 紧急程度：' || CASE urgency WHEN 'high' THEN '🔴 紧急' WHEN 'low' THEN '🟢 普通' ELSE '🟡 一般' END || chr(10)
        || '📝 案件摘要：' || coalesce(case_summary, '无') || chr(10) || '🏛️ 涉及方：' || coalesce(involved_parties, '无') || chr(10) || '📅 关键日期：' || coalesce(key_date, '无') || chr(10)
        || '📎 案号：' || coalesce(case_number, '无') || chr(10) || '📊 分析置信度：' || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%' || chr(10) AS text
    FROM a
), g AS (
    SELECT mail_id, max(n) AS n, bool_or(llm_failed) AS failed, string_agg(text || chr(10) || '🤖 AI 初步审核解读：' || chr(10) || ai_interpretation || chr(10), chr(10) || repeat('━', 40) || chr(10) ORDER BY group_idx) AS whole, string_agg(text, chr(10) ORDER BY group_idx) AS short
    FROM s GROUP BY 1
), d AS (
    SELECT mail_id, string_agg(doc_type, ' / ' ORDER BY o) AS types FROM (SELECT mail_id, doc_type, min(group_idx) AS o FROM analyses GROUP BY 1, 2) GROUP BY 1
), m AS (
    SELECT id AS mail_id, coalesce(subject, '') AS subject, sender, string_split(target_email, ',') AS targets, case_summary AS body FROM mail_log
), o AS (
    SELECT *, repeat('━', 20) || chr(10) || chr(10) || '原发件人：' || sender || chr(10) || '原邮件主题：' || subject || chr(10) || chr(10) || '📧 原邮件正文：' || chr(10)
        || CASE WHEN length(body) > 12 THEN left(body, 12) || chr(10) || '... (原文过长已截断，请登录监控邮箱查看完整内容)' ELSE body END || chr(10) || repeat('━', 20) || chr(10) || chr(10)
        || '此为自动转发，如需查看完整原始邮件请登录监控邮箱。' || chr(10) || chr(10) || '---' || chr(10) || '|S' || chr(10) AS foot
    FROM m
)
SELECT mail_id, trim(t) AS target_email, '【' || CASE WHEN failed THEN '大模型分析失败' WHEN types IS NOT NULL THEN types ELSE '法律文书' END || '】' || subject AS subject,
    '您好 ' || CASE WHEN trim(t) LIKE 's1%' THEN 'N' || substr(trim(t), 2, 1) ELSE '' END || '，' || chr(10) || chr(10) || '系统收到一封法律文书邮件，' || {middle} || foot AS body
FROM o LEFT JOIN g USING (mail_id) LEFT JOIN d USING (mail_id), unnest(targets) AS u(t)"""
WHOLE = "CASE WHEN n > 1 THEN '共分析 ' || n || ' 份文书。' ELSE '' END || 'AI 分析结果如下：' || chr(10) || chr(10) || coalesce(whole, '') || chr(10) || chr(10)"
SHORT = "'共分析 ' || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END || ' 份文书。' || chr(10) || chr(10) || coalesce(short, '') || chr(10) || '📎 AI 初步审核解读详见附件《AI分析报告.docx》—— 请下载查阅完整解读内容。' || chr(10)"


def outbox_of(spark: SparkSession, sf_dir: str, brief: bool) -> DataFrame:
    log = view(spark, sf_dir, "mail_log")
    routed = log.select(F.col("id").alias("mail_id"), F.lit("routable").alias("status"), F.col("target_email").alias("targets"))
    mails = log.select(F.col("id").alias("mail_id"), "subject", "sender", F.lit("").alias("recipient"), F.lit(None).cast("string").alias("received"), F.col("case_summary").alias("body_text"))
    targets = routed.select(F.explode(fn.csv_list(F.col("targets"))).alias("target_email")).distinct()
    names = targets.filter("target_email like 's1%'").withColumn("target_name", F.concat(F.lit("N"), F.substring("target_email", 2, 1)))
    return ledger.build_outbox(routed, view(spark, sf_dir, "analyses"), mails, brief, cut=12, system="S", names=names)


@query(OUTGOING.replace("{middle}", SHORT), "mail_log", "analyses")
def brief_outgoing_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox in its brief form."""
    return outbox_of(spark, sf_dir, brief=True)


@query(OUTGOING.replace("{middle}", WHOLE), "mail_log", "analyses")
def outgoing_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox: a mail for each target, with subject and body."""
    return outbox_of(spark, sf_dir, brief=False)


@query("SELECT l.log_id, trim(l.target_email) AS target_email, trim(coalesce(l.target_name, '')) AS target_name, coalesce(a.first_type, m.doc_type) AS doc_type, coalesce(a.types, m.doc_type || '!') AS doc_types, m.subject, l.success, l.created_at FROM ledger l JOIN mail_log m ON m.id = l.log_id LEFT JOIN (SELECT mail_id, arg_min(doc_type, group_idx) AS first_type, string_agg(doc_type, ',' ORDER BY group_idx) AS types FROM analyses GROUP BY 1) a ON a.mail_id = l.log_id", "ledger", "mail_log", "analyses")
def built_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of attempts."""
    attempts = view(spark, sf_dir, "ledger").select("log_id", "target_email", "target_name", "success", "created_at")
    log = view(spark, sf_dir, "mail_log").withColumn("doc_types", F.concat("doc_type", F.lit("!")))
    return ledger.ledger_rows(attempts, view(spark, sf_dir, "analyses"), log)


@query("WITH f AS (SELECT log_id AS mail_id, id % 2 AS group_idx, id AS att_idx, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS r FROM ledger) SELECT mail_id, group_idx, arg_min(att_idx, r * 100000000000 + att_idx) AS att_idx FROM f WHERE r IS NOT NULL GROUP BY 1, 2", "ledger")
def base_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each group that a revision starts from."""
    rows = view(spark, sf_dir, "ledger").selectExpr("log_id AS mail_id", "id % 2 AS group_idx", "id AS att_idx", "CASE id % 5 WHEN 0 THEN 'a.DOCX' WHEN 1 THEN 'b.doc' WHEN 2 THEN 'docx' ELSE 'c.pdf' END AS filename")
    return revision.base_document(rows.select("mail_id", "att_idx", "filename"), rows.select("mail_id", "group_idx", "att_idx"))


@query("SELECT id, created_at, (SELECT greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) FROM mail_log) AS total_pages FROM mail_log ORDER BY created_at DESC, id DESC LIMIT 10", "mail_log")
def recent_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most recent mails (F2), and the pages there are (F1)."""
    log = view(spark, sf_dir, "mail_log")
    return reports.recent(log).select("id", "created_at", reports.total_pages(log).scalar().alias("total_pages"))


@query(f"SELECT id FROM mail_log WHERE NOT (status = 'pending' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE)", "mail_log")
def unstuck_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without mails that a failed run left behind."""
    log = view(spark, sf_dir, "mail_log")
    kept, _, _ = maintenance.delete_mails(log, view(spark, sf_dir, "attachments"), view(spark, sf_dir, "ledger"), maintenance.stuck(log, AS_OF))
    return kept.select("id")


@query("SELECT id, coalesce(n.name, a.name) AS name, CASE WHEN n.name IS NULL OR n.host = '***' THEN a.imap_host ELSE n.host END AS imap_host, coalesce(a.enabled, FALSE) AS old FROM accounts a FULL JOIN (SELECT CASE WHEN id % 4 = 0 THEN 'new ' || id ELSE name END AS name, CASE WHEN id % 3 = 0 THEN '***' ELSE 'host' || id END AS host FROM accounts WHERE id % 2 = 0) n ON n.name = a.name", "accounts")
def upserted_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with those of a snapshot; redacted values don't count."""
    rows = view(spark, sf_dir, "accounts")
    snapshot = rows.filter("id % 2 = 0").selectExpr("CASE WHEN id % 4 = 0 THEN concat('new ', id) ELSE name END AS name", "CASE WHEN id % 3 = 0 THEN '***' ELSE concat('host', id) END AS imap_host")
    merged = maintenance.upsert(rows.select("id", "name", "imap_host", "enabled"), snapshot, ["name"], skip="***")
    return merged.select("id", "name", "imap_host", F.coalesce("enabled", F.lit(False)).alias("old"))


@query("SELECT id, CASE WHEN rule_type = 'doc_type' THEN 'doc_type' ELSE 'account' END AS rule_type, CASE WHEN rule_type <> 'doc_type' OR rule_type IS NULL THEN '' WHEN id % 6 = 0 THEN '' WHEN id % 6 = 1 THEN 'click,view' ELSE doc_type END AS doc_type, coalesce(rule_type, '') = 'doc_type' AND id % 6 = 0 AS rejected FROM rule_forms", "rule_forms")
def checked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as they are stored, and those that can't be."""
    ok, bad = routing.validate_rules(routing.enabled(view(spark, sf_dir, "rule_forms")))
    both = ok.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
    return both.select("id", "rule_type", "doc_type", "rejected")


@query("SELECT rule_type, doc_type, account_ids, trim(target_email) AS target_email, count(*) AS n FROM rule_forms GROUP BY 1, 2, 3, 4 HAVING count(*) > 1", "rule_forms")
def repeated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are there twice."""
    return routing.duplicate_rules(view(spark, sf_dir, "rule_forms"))


@query("WITH i AS (SELECT id, trim(unnest(string_split(account_ids, ','))) AS account, generate_subscripts(string_split(account_ids, ','), 1) AS pos FROM rule_forms), n AS (SELECT i.id, string_agg(a.name, ', ' ORDER BY pos) AS names FROM i JOIN accounts a ON CAST(a.id AS VARCHAR) = i.account GROUP BY 1) SELECT r.id, coalesce(names, '') AS account_names FROM rule_forms r LEFT JOIN n USING (id)", "rule_forms", "accounts")
def named_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the accounts of rules."""
    return routing.rule_account_names(view(spark, sf_dir, "rule_forms"), view(spark, sf_dir, "accounts").filter("id is not null"))


@query("WITH i AS (SELECT id, trim(unnest(string_split(names, ';'))) AS name, generate_subscripts(string_split(names, ';'), 1) AS pos FROM (SELECT id, replace(account_names, ',', ';') AS names FROM rule_forms WHERE account_names <> '')), n AS (SELECT i.id, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY pos) AS ids, bool_and(a.id IS NOT NULL) AS known FROM i LEFT JOIN (SELECT name, min(id) AS id FROM accounts GROUP BY 1) a USING (name) GROUP BY 1) SELECT r.id, CASE WHEN coalesce(known, TRUE) THEN coalesce(ids, '') END AS account_ids, NOT coalesce(known, TRUE) AS rejected FROM rule_forms r LEFT JOIN n USING (id)", "rule_forms", "accounts")
def imported_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a backup by account names, all or nothing (C11)."""
    rows = view(spark, sf_dir, "rule_forms").withColumnRenamed("id", "rule_key").drop("account_ids")
    ok, bad = routing.resolve_rule_accounts(rows, view(spark, sf_dir, "accounts"))
    both = ok.select("rule_key", "account_ids", F.lit(False).alias("rejected")).unionByName(bad.select("rule_key", F.lit(None).cast("string").alias("account_ids"), F.lit(True).alias("rejected")))
    return both.withColumnRenamed("rule_key", "id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 5 AS VARCHAR) END AS account_ids, CASE WHEN rule_type IS NULL OR id % 7 = 0 THEN 'account' ELSE rule_type END AS rule_type, TRUE AS enabled, '' AS doc_type FROM rule_forms", "rule_forms")
def upgraded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of an older version with the columns of today."""
    old = view(spark, sf_dir, "rule_forms").selectExpr("id", "CASE WHEN id % 3 <> 0 THEN CAST(id % 5 AS INT) END AS account_id", "CASE WHEN id % 7 = 0 THEN '' ELSE rule_type END AS rule_type", "target_email")
    return maintenance.upgrade_schema(old, "rules").select("id", "account_ids", "rule_type", "enabled", "doc_type")


@query("SELECT id, name, '' AS forward_to, imap_host, enabled FROM accounts", "accounts")
def stored_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written and read again, upgraded on the way."""
    rows = view(spark, sf_dir, "accounts").select("id", "name", "username", "imap_host", "filter_sender", F.lit(30).alias("check_interval"), F.lit(True).alias("download_attachments"), "enabled")
    folder = scratch_path(spark, "mail-tables")
    tables.write_tables({"accounts": rows}, folder)
    until_exit(spark, folder)
    return maintenance.upgrade_schema(tables.read_tables(spark, folder, ("accounts",))["accounts"], "accounts").select("id", "name", "forward_to", "imap_host", "enabled")


@query("SELECT id, CASE WHEN id % 2 = account_id % 2 THEN 'h' || id % 2 || ':25 x:587' ELSE 'h' || id % 2 || ':25 x:587 h' || account_id % 2 || ':25' END AS endpoints FROM mail_log", "mail_log")
def endpoint_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints to send through, each once."""
    one = "named_struct('host', {0}, 'port', {1}, 'username', 'u', 'password_encrypted', CAST(NULL AS STRING))"
    own, other, fixed = one.format("concat('h', id % 2)", 25), one.format("concat('h', account_id % 2)", 25), one.format("'x'", 587)
    rows = view(spark, sf_dir, "mail_log").selectExpr("id", "account_id", f"array({own}, {fixed}, NULL, {other}, {fixed}) AS e")
    kept = ledger.distinct_endpoints(F.col("e"))
    shown = F.array_join(F.transform(kept, lambda x: F.concat(x["host"], F.lit(":"), x["port"].cast("string"))), " ")
    return rows.select("id", shown.alias("endpoints"))


#: Attempts of a key folded one after the other.
THROTTLED = """WITH RECURSIVE a AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(ts AS TIMESTAMP) AS ts, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase') AS n FROM events WHERE event_type IN ('error', 'purchase')),
f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, CAST([] AS TIMESTAMP[]) AS held, FALSE AS blocked, CAST(0 AS BIGINT) AS wait FROM (SELECT DISTINCT key FROM a)
UNION ALL SELECT s.key, s.n, s.ts, CASE WHEN len(s.live) >= 3 THEN s.live WHEN s.ok THEN CAST([] AS TIMESTAMP[]) ELSE list_append(s.live, s.ts) END, len(s.live) >= 3, CASE WHEN len(s.live) >= 3 THEN CAST(floor(epoch(s.live[1]) + 3456000 - epoch(s.ts)) AS BIGINT) ELSE 0 END
FROM (SELECT a.*, list_filter(f.held, lambda x: epoch(a.ts) - epoch(x) < 3456000) AS live FROM f JOIN a ON a.key = f.key AND a.n = f.n + 1) s)
SELECT key, ts, blocked, CAST(wait AS INTEGER) AS retry_after FROM f WHERE n > 0"""


def attempts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type in ('error', 'purchase')")
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))


@query(THROTTLED)
def throttled_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a trailing window block an attempt (E7); events are sparse, so the window is wide."""
    return polls.throttle(attempts_of(spark, sf_dir), 40 * 86_400, 3).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(THROTTLED)
def throttled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, with list state and timers."""
    out, provider = scratch_path(spark, "throttled"), "spark.sql.streaming.stateStore.providerClass"
    attempts = attempts_of(spark, sf_dir)
    attempts.coalesce(1).sortWithinPartitions("ts", "ok").write.parquet(f"{out}/landing")
    before = spark.conf.get(provider)
    spark.conf.set(provider, polls.STATE_STORE)
    try:
        stream = polls.throttle_stream(spark.readStream.schema(attempts.schema).parquet(f"{out}/landing"), 40 * 86_400, 3)
        polls.run_polls(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/found/batch={n}"), f"{out}/state").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    until_exit(spark, out)
    return spark.read.schema(polls.THROTTLE).parquet(f"{out}/found").select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "blocked", "retry_after")
