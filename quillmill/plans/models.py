"""Queries of budgets, prompts, replies, analyses and routes; each next to its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as fn
from quillmill.operators import modelio, routing
from quillmill.plans.catalogue import query
from quillmill.plans.registry import ASSEMBLED, MATCH
from quillmill.plans.views import rules, view

WINDOW = "CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 4096 WHEN 2 THEN 131072 ELSE id * 37 END"


@query(f"""WITH w AS (SELECT id, account_id, {WINDOW} AS w FROM mail_log),
b AS (SELECT *, greatest(CAST(floor(w * 0.5) AS BIGINT) - 2000 - (500 + CAST(floor(account_id / 0.85) AS BIGINT) + 500), 0) AS rest, greatest(CAST(floor(w * 0.5) AS BIGINT) - 2500 - 500, 1024) AS most FROM w),
s AS (SELECT *, CAST(floor(most * 0.15) AS BIGINT) AS body FROM b)
SELECT id, CASE WHEN w <= 0 THEN 6000 ELSE least(greatest(CAST(floor(rest * 0.85) AS BIGINT), 1024), 500000) END AS attachment, CASE WHEN w <= 0 THEN 8000 ELSE CAST(floor(body * 0.85) AS BIGINT) END AS body, CASE WHEN w <= 0 THEN 6000 ELSE least(CAST(floor(greatest(most - body, 1024) * 0.85) AS BIGINT), 500000) END AS attachments FROM s""", "mail_log")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of characters by window (H2, H3)."""
    rows = view(spark, sf_dir, "mail_log").selectExpr("id", "account_id", f"{WINDOW} AS w")
    w, ratio, out, template = F.col("w"), F.lit(0.5), F.lit(2000), F.lit(500)
    split = fn.split_budget(w, ratio, F.lit(2000), F.lit(500))
    return rows.select("id", fn.attachment_budget(w, ratio, out, template, F.col("account_id")).alias("attachment"), split.alias("s")).select("id", "attachment", "s.body", "s.attachments")


MODELS = (("GPT-4-32K", 8192), ("my-qwen3-8b", 131_072), ("unknown-32k", 32_768), ("big 1M", 1_048_576), ("none", 131_072), ("gpt-4o-mini", 128_000), ("x-96 k", 98_304), ("Kimi", 131_072))


def cases(n: str, values: list[str]) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"WITH w AS (SELECT id, CASE WHEN id % 9 = 0 AND id > 0 THEN id ELSE {cases('id', [str(w) for _, w in MODELS])} END AS w FROM mail_log) SELECT id, w AS context, CASE WHEN w >= 1000000 THEN 64000 WHEN w >= 200000 THEN 32000 WHEN w >= 128000 THEN 16000 WHEN w >= 64000 THEN 8192 ELSE 4096 END AS output FROM w", "mail_log")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by a model's name, and what to ask for (H4, H5)."""
    name = cases("id", [f"'{m}'" for m, _ in MODELS])
    rows = view(spark, sf_dir, "mail_log").selectExpr("id", f"{name} AS model", "CASE WHEN id % 9 = 0 THEN id WHEN id % 9 = 1 THEN 0 END AS own")
    context = fn.context_window(F.col("model"), F.col("own"))
    return rows.select("id", context.alias("context"), fn.recommended_tokens(context).alias("output"))


@query("SELECT mail_id, length(CASE WHEN mail_id % 3 = 0 THEN text ELSE left(text, least(900, 40 * (mail_id % 50 + 1))) END) AS n_chars FROM bodies", "bodies")
def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies at most as long as a cap, which 0 lifts (H6)."""
    rows = view(spark, sf_dir, "bodies")
    cap = F.least(F.lit(900), 40 * (F.col("mail_id") % 50 + 1))
    capped = F.when(F.col("mail_id") % 3 == 0, fn.cap_text(F.col("text"), 0)).otherwise(F.left(fn.cap_text(F.col("text"), 900), cap))
    return rows.select("mail_id", F.length(capped).cast("long").alias("n_chars"))


PIECES = """
p AS (SELECT CAST(floor(mail_id / 5) AS BIGINT) AS id, mail_id % 5 AS n, '=== 附件: ' || mail_id || ' ===' || chr(10) || text AS part FROM bodies),
c AS (SELECT *, length(regexp_replace(part, '[^一-鿿㐀-䶿]', '', 'g')) AS cn FROM p),
u AS (SELECT id, n, sum(cn) OVER w + 4 + 0 AS cn, sum(length(part)) OVER w + 2 * (count(*) OVER w - 1) + 29 + 10 AS chars, sum(length(part)) OVER w + 2 * (count(*) OVER w - 1) AS own, count(*) OVER w AS k, count(*) OVER (PARTITION BY id) AS parts FROM c WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, greatest(floor(cn / 0.85 + (chars - cn) / 4), floor(chars / 10)) <= 1400 AS fits FROM u)
"""


@query(f"WITH {PIECES.strip()} SELECT id, CAST(coalesce(max(own) FILTER (WHERE fits), 0) AS BIGINT) AS n_chars, count(*) FILTER (WHERE fits) > 0 AND max(k) FILTER (WHERE fits) = max(parts) AS whole FROM f GROUP BY 1", "bodies")
def fitted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that lose attachments from the last on until they fit."""
    parts = view(spark, sf_dir, "bodies").select(F.floor(F.col("mail_id") / 5).alias("id"), (F.col("mail_id") % 5).alias("att_idx"), F.col("mail_id").cast("string").alias("filename"), fn.py_strip(F.col("text")).alias("text"))
    whole = modelio.combine_texts(parts, ["id"])
    prompts = whole.select("id", F.lit("## Input\nshort\n## Output\njson").alias("template"), F.col("text").alias("attachments"), F.lit(4000).alias("window"), F.lit(0.5).alias("ratio"), F.lit(600).alias("output"), F.col("text").alias("all"))
    cut = modelio.truncate_prompt(prompts)
    return cut.select("id", F.length("attachments").cast("long").alias("n_chars"), (F.col("attachments") == F.col("all")).alias("whole"))


@query("SELECT id, 'To ' || coalesce(subject, '') || ' {x} ' || case_summary || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || '附件列表：' || chr(10) || '0. {subject} ' || id ELSE '' END AS prompt FROM mail_log", "mail_log")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders filled in one pass; a list without a place goes to the end (H8)."""
    files = F.when(F.col("id") % 2 == 0, F.concat(F.lit("0. {subject} "), F.col("id").cast("string"))).otherwise("")
    values = {"subject": F.coalesce("subject", F.lit("")), "summary": F.col("case_summary"), "file_list": files}
    return view(spark, sf_dir, "mail_log").select("id", modelio.fill_template("To {subject} {x} {summary}", values, {"file_list": "附件列表："}).alias("prompt"))


REPLY_FIELDS = "concat('\"doc_type\": \"', doc_type, '\", \"urgency\": \" ', upper(urgency), '\", \"confidence\": ', CASE WHEN group_idx % 7 = 0 THEN '\"very\"' WHEN group_idx % 7 = 1 THEN '3' ELSE '0.25' END, ', \"case_summary\": \"', case_summary, '\"')"
REPLIES = f"CASE group_idx % 6 WHEN 0 THEN concat('{{', {REPLY_FIELDS}, '}}') WHEN 1 THEN concat('```json\n{{', {REPLY_FIELDS}, '}}\n```') WHEN 2 THEN concat('{{', {REPLY_FIELDS}, ',}}') WHEN 3 THEN replace(concat('{{', {REPLY_FIELDS}, ', \"x\": None}}'), '\"', '''') WHEN 4 THEN concat('so: {{{{', {REPLY_FIELDS}, '}}}} ok') ELSE 'no answer' END"


@query("SELECT mail_id, group_idx, group_idx % 6 < 5 AS parsed, CASE WHEN group_idx % 6 = 5 THEN '其他法律文书' ELSE doc_type END AS doc_type, CASE WHEN group_idx % 6 = 5 THEN 'medium' ELSE urgency END AS urgency, CASE WHEN group_idx % 6 = 5 OR group_idx % 7 = 0 THEN 0.5 WHEN group_idx % 7 = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence, CASE WHEN group_idx % 6 = 5 THEN '' ELSE case_summary END AS case_summary FROM analyses", "analyses")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in fences, with errors or around other text, as validated analyses."""
    replies = view(spark, sf_dir, "analyses").select("mail_id", "group_idx", fn.strip_fence(F.expr(REPLIES)).alias("content"))
    parsed = modelio.parse_replies(replies).select("mail_id", "group_idx", "parsed", modelio.validate_analysis(F.col("analysis")).alias("a"))
    return parsed.select("mail_id", "group_idx", "parsed", "a.doc_type", "a.urgency", "a.confidence", "a.case_summary")


KNOWN = ("click", "view", "signup")


@query(f"SELECT mail_id, group_idx, CASE WHEN group_idx % 5 <> 0 AND doc_type IN {KNOWN} THEN doc_type ELSE '其他法律文书' END AS doc_type, CASE WHEN group_idx % 5 = 0 THEN 0.5 ELSE least(greatest(confidence * 2 - 0.1, 0.0), 1.0) END AS confidence, group_idx % 5 = 0 AS classify_failed FROM analyses", "analyses")
def checked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that are known, confidences that are shares."""
    dim = spark.createDataFrame([(k, []) for k in KNOWN], "doc_type string, caps array<string>")
    rows = view(spark, sf_dir, "analyses").selectExpr("mail_id", "group_idx", "doc_type", "confidence * 2 - 0.1 AS confidence", "group_idx % 5 <> 0 AS parsed")
    return modelio.validate_classes(rows, dim).select("mail_id", "group_idx", "doc_type", "confidence", "classify_failed")


@query("SELECT id, CAST(i AS INTEGER) AS group_idx, CASE WHEN id % 3 = 0 AND i = 1 THEN 'second' ELSE coalesce(doc_type, '') END AS doc_type FROM mail_log, (SELECT unnest([0, 1]) AS i) WHERE id % 3 = 0 OR (id % 3 = 1 AND i = 0)", "mail_log")
def unpacked_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses as groups."""
    one = "concat('{\"doc_type\": \"', coalesce(doc_type, ''), '\"}')"
    rows = view(spark, sf_dir, "mail_log").selectExpr("id", f"CASE id % 3 WHEN 0 THEN concat(' [', {one}, ', {{\"doc_type\": \"second\"}}]') WHEN 1 THEN {one} ELSE 'plain text' END AS llm_raw_response")
    return modelio.unpack_analyses(rows).select("id", "group_idx", "analysis.doc_type")


@query("SELECT mail_id, group_idx FROM analyses WHERE NOT llm_failed AND confidence < 0.3 AND doc_type IN ('其他法律文书', '非法律文书')", "analyses")
def junk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that are junk."""
    return view(spark, sf_dir, "analyses").filter(routing.is_junk(F.col("doc_type"), F.col("confidence"), F.col("llm_failed"))).select("mail_id", "group_idx")


CLASSIFIED = "CASE WHEN group_idx % 4 = 0 THEN '非法律文书' ELSE doc_type END"


@query(f"SELECT mail_id, group_idx, {CLASSIFIED} AS doc_type, confidence, CASE WHEN n THEN 'low' END AS urgency, CASE WHEN n THEN '非法律文书，无需法律分析' END AS case_summary, CASE WHEN n THEN '' END AS agency_name, CAST(NULL AS VARCHAR) AS case_number, NOT n AS to_analyse FROM (SELECT *, group_idx % 4 = 0 AND NOT classify_failed AS n FROM analyses)", "analyses")
def minimal_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not legal skips the second stage."""
    rows = view(spark, sf_dir, "analyses").selectExpr("mail_id", "group_idx", f"{CLASSIFIED} AS doc_type", "confidence", "classify_failed")
    legal, done = modelio.split_non_legal(rows)
    both = legal.withColumn("to_analyse", F.lit(True)).unionByName(done.withColumn("to_analyse", F.lit(False)), allowMissingColumns=True)
    return both.select("mail_id", "group_idx", "doc_type", "confidence", "urgency", "case_summary", "agency_name", "case_number", "to_analyse")


@query("SELECT mail_id, group_idx, doc_type IN ('click', 'view') AND NOT llm_failed AND group_idx % 3 <> 0 AS do_revision, doc_type IN ('click', 'signup') AS do_review FROM analyses", "analyses")
def gated_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a type's capabilities allow."""
    dim = spark.createDataFrame([("click", ["修订", "审查"]), ("view", ["修订"]), ("signup", ["审查", "合同"])], "doc_type string, caps array<string>")
    rows = view(spark, sf_dir, "analyses").withColumn("revised_document", F.when(F.col("group_idx") % 3 == 0, " ").otherwise("text"))
    return modelio.gate_capabilities(rows, dim).select("mail_id", "group_idx", "do_revision", "do_review")


@query("SELECT mail_id, group_idx, doc_type, confidence, classify_failed, group_idx % 3 = 0 AS disagrees, case_summary FROM analyses WHERE NOT llm_failed", "analyses")
def merged_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage two under the type and confidence of stage one."""
    rows = view(spark, sf_dir, "analyses")
    second = rows.filter("not llm_failed").select("mail_id", "group_idx", F.when(F.col("group_idx") % 3 == 0, F.concat("doc_type", F.lit("?"))).otherwise(F.col("doc_type")).alias("doc_type"), F.lit(0.1).alias("confidence"), "case_summary")
    return modelio.merge_stages(rows.select("mail_id", "group_idx", "doc_type", "confidence", "classify_failed"), second)


@query("SELECT id AS mail_id, CASE WHEN id % 5 <= 1 OR id % 7 = 0 THEN CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0+1' WHEN 3 THEN '0+1+2' ELSE '0+1+2+3' END WHEN id % 5 = 3 AND id % 2 = 0 THEN '0+2;1;' WHEN id % 5 = 2 THEN '0;1' WHEN id % 5 = 3 THEN '0;1;2' ELSE '0;1;2;3' END AS groups FROM mail_log", "mail_log")
def valid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groupings that cover all attachments, else one group for each."""
    proposed = "CASE WHEN id % 2 = 0 THEN array(array(0, 2), array(1), CAST(array() AS ARRAY<INT>)) WHEN id % 3 = 0 THEN array(array(0, 9)) END"
    rows = view(spark, sf_dir, "mail_log").selectExpr("id AS mail_id", "CAST(id % 5 AS INT) AS n", f"{proposed} AS groups", "id % 7 <> 0 AS grouping")
    shown = F.array_join(F.transform("groups", lambda g: F.array_join(F.transform(g, lambda i: i.cast("string")), "+")), ";")
    return modelio.validate_groups(rows).select("mail_id", shown.alias("groups"))


@query("WITH t AS (SELECT page_id % 20 AS mail_id, page_id AS seq, unnest([url, 'https://law.example/' || page_id % 8]) AS url, unnest([1, 2]) AS pos FROM pages), f AS (SELECT mail_id, url, min(seq * 10 + pos) AS o FROM t GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY o) AS n FROM f) SELECT mail_id, string_agg(url, ' ' ORDER BY n) AS links FROM n WHERE n <= 10 GROUP BY 1")
def cited_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten links of what a mail's searches found."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.concat(F.lit("see "), "url", F.lit(" 或 [https://law.example/"), (F.col("page_id") % 8).cast("string"), F.lit("]。"))
    results = pages.select((F.col("page_id") % 20).alias("mail_id"), F.col("page_id").alias("seq"), text.alias("text"))
    return modelio.citation_links(results).select("mail_id", F.array_join("links", " ").alias("links"))


ROUTED_MATCH = MATCH.replace("SELECT id AS mail_id, account_id, CASE WHEN doc_type <> '' THEN [doc_type] ELSE [] END AS types FROM mail_log", "SELECT mail_id, mail_id % 12 AS account_id, route_types AS types FROM a WHERE NOT no_basis")


@query(f"""WITH {ASSEMBLED.strip()},
a AS (SELECT g.*, pick_type, pick_confidence, list_filter(list_distinct(list_concat(types, [pick_type])), lambda x: NOT list_contains(unsure, x)) AS route_types FROM g JOIN p USING (mail_id)), {ROUTED_MATCH.strip()},
l AS (SELECT mail_id, string_agg(target, ',' ORDER BY o) AS targets FROM t GROUP BY 1),
v AS (SELECT a.mail_id, no_basis OR all_failed AS dead, NOT all_failed AND pick_confidence < 0.3 AND pick_type IN ('其他法律文书', '非法律文书') AS junk, CASE WHEN no_basis THEN '' ELSE coalesce(targets, 'default@example.com') END AS targets FROM a LEFT JOIN l USING (mail_id))
SELECT mail_id, CASE WHEN dead THEN 'failed' WHEN junk THEN 'skipped' WHEN targets = '' THEN 'failed' ELSE 'routable' END AS status, CASE WHEN dead THEN 'no group could be analysed' WHEN junk THEN 'junk' WHEN targets = '' THEN 'no target' ELSE '' END AS reason, CASE WHEN dead OR junk THEN '' ELSE targets END AS targets FROM v""", "analyses", "rules")
def routed_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each mail with its ordered targets."""
    rows = routing.assemble_mail(view(spark, sf_dir, "analyses")).withColumn("account_id", F.col("mail_id") % 12)
    return routing.route(rows, rules(spark), "default@example.com")
