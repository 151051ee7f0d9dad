"""The delivery ledger: pending targets, outcomes, ledger rows, outgoing mails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import blank, csv_list, py_strip, sanitize_header


def pending_targets(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """(log_id, pos, target): targets of failed mails that have no successful delivery yet, in order."""
    wanted = log.filter("status = 'failed'").select(F.col("id").alias("log_id"), F.posexplode(csv_list(F.col("target_email"))).alias("pos", "target"))
    done = ledger.filter("success").select("log_id", py_strip(F.col("target_email")).alias("target")).distinct()
    return wanted.join(done, ["log_id", "target"], "left_anti").select("log_id", "pos", "target")


def delivery_outcome(attempts: DataFrame) -> DataFrame:
    """(log_id, status, error): forwarded if all went, else failed with the last failing target's error."""
    bad = ~F.col("success")
    return attempts.groupBy("log_id").agg(
        F.when(F.bool_and("success"), "forwarded").otherwise("failed").alias("status"),
        F.max_by(F.when(bad, F.col("error")), F.when(bad, F.col("seq"))).alias("error"),
    )


def ledger_rows(attempts: DataFrame, analyses: DataFrame, log: DataFrame) -> DataFrame:
    """A ledger row per attempt; types come from the analyses, else from the log."""
    ordered = F.array_sort(F.collect_list(F.struct("group_idx", "doc_type")))
    types = analyses.filter(~blank(F.col("doc_type"))).groupBy(F.col("mail_id").alias("log_id")).agg(ordered.alias("g"))
    found = types.select("log_id", F.col("g")[0]["doc_type"].alias("first_type"), F.array_join(F.transform("g", lambda x: x.doc_type), ",").alias("all_types"))
    own = log.select(F.col("id").alias("log_id"), F.col("doc_type").alias("log_type"), F.col("doc_types").alias("log_types"), F.col("subject"))
    joined = attempts.join(own, "log_id").join(found, "log_id", "left")
    return joined.select(
        "log_id", py_strip(F.col("target_email")).alias("target_email"), py_strip(F.coalesce("target_name", F.lit(""))).alias("target_name"),
        F.coalesce("first_type", "log_type").alias("doc_type"), F.coalesce("all_types", "log_types").alias("doc_types"), "subject", "success", "created_at",
    )


def compose_subjects(analyses: DataFrame, mails: DataFrame) -> DataFrame:
    """(mail_id, subject): prefix by failure, by types in order, or the general one."""
    ordered = F.array_sort(F.collect_list(F.struct("group_idx", sanitize_header(F.coalesce("doc_type", F.lit(""))).alias("t"))))
    groups = analyses.groupBy("mail_id").agg(F.bool_or(F.coalesce("llm_failed", F.lit(False))).alias("failed"), ordered.alias("g"))
    types = F.array_join(F.array_distinct(F.filter(F.transform("g", lambda x: x.t), lambda t: t != "")), " / ")
    clean = sanitize_header(F.coalesce("subject", F.lit("")))
    prefix = F.when(F.col("failed"), "大模型分析失败").when(types != "", types).otherwise("法律文书")
    return mails.select("mail_id", "subject").join(groups, "mail_id", "left").select("mail_id", F.concat(F.lit("【"), prefix, F.lit("】"), clean).alias("subject"))


#: Labels of urgency in a mail, the first for all others too; rules between sections and between groups; where the text is cut.
URGENCY = {"medium": "🟡 一般", "high": "🔴 紧急", "low": "🟢 普通"}
RULE, GROUP_RULE, BODY_CHARS = "━" * 20, "━" * 40, 3000
NO_BODY, BODY_CUT = "（无正文）", "\n... (原文过长已截断，请登录监控邮箱查看完整内容)"


def _sections(analyses: DataFrame, brief: bool) -> DataFrame:
    """(mail_id, groups, sections): how many groups a mail has, and a section for each in order; headed if there are several."""
    none = F.lit("无")
    named = F.when(F.coalesce("doc_type", F.lit("")) == "", "未知").otherwise(F.col("doc_type"))
    kind = F.when(F.coalesce("classify_failed", F.lit(False)), F.concat(named, F.lit("（⚠️类型未识别，请人工复核）"))).otherwise(named)
    urgency = F.coalesce(*[F.when(F.col("urgency") == k, v) for k, v in URGENCY.items()], F.lit(URGENCY["medium"]))
    share = F.format_string("%d%%", F.bround(F.coalesce("confidence", F.lit(0.0)) * 100, 0).cast("int"))
    lines = [("📋 文书类型：", kind), ("⚡ 紧急程度：", urgency), ("📝 案件摘要：", F.coalesce("case_summary", none)), ("🏛️ 涉及方：", F.coalesce("involved_parties", none)), ("📅 关键日期：", F.coalesce("key_date", none)), ("📎 案号：", F.coalesce("case_number", none)), ("📊 分析置信度：", share)]
    text = F.concat(*[F.concat(F.lit(k), v, F.lit("\n")) for k, v in lines])
    if not brief:
        reading = F.when(F.coalesce("ai_interpretation", F.lit("")) == "", "（暂无AI解读，请人工审核）").otherwise(F.col("ai_interpretation"))
        text = F.concat(text, F.lit("\n🤖 AI 初步审核解读：\n"), reading, F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("group_idx", kind.alias("kind"), text.alias("text"))))
    groups = analyses.groupBy("mail_id").agg(ordered.alias("g")).withColumn("groups", F.size("g"))
    headed = F.transform("g", lambda x, i: F.concat(F.when(F.col("groups") > 1, F.format_string("\n── 第 %d 组：%s ──\n", i + 1, x["kind"])).otherwise(""), x["text"]))
    return groups.select("mail_id", "groups", F.array_join(headed, "\n" if brief else f"\n{GROUP_RULE}\n").alias("sections"))


def compose_bodies(analyses: DataFrame, mails: DataFrame, brief: bool = False, cut: int = BODY_CHARS, system: str = "", report: str = "AI分析报告.docx") -> DataFrame:
    """(mail_id, body): how many documents a mail has, a section for each group, where the mail came from, and its own text.

    The brief form leaves the readings to the attachment ``report``. Lines about the origin are left out if
    blank, but for the subject. What greets the target by name is put before it by ``build_outbox``.
    """
    meta = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}："), F.col(c))) for c, name in (("sender", "原发件人"), ("recipient", "原收件人"), ("received", "原收件日期"))]
    origin = F.concat_ws("\n", *meta, F.concat(F.lit("原邮件主题："), F.coalesce("subject", F.lit(""))))
    own = F.when(F.coalesce("body_text", F.lit("")) == "", NO_BODY).otherwise(F.col("body_text"))
    text = F.when(F.length(own) > cut, F.concat(F.left(own, F.lit(cut)), F.lit(BODY_CUT))).otherwise(own)
    groups = F.coalesce("groups", F.lit(0))
    counted = F.when(groups > 1, F.concat(F.lit("共分析 "), groups.cast("string"), F.lit(" 份文书。")))
    sections = F.coalesce("sections", F.lit(""))
    if brief:
        head = [F.lit("系统收到一封法律文书邮件，"), F.coalesce(counted, F.lit("共分析  份文书。")), F.lit("\n\n"), sections, F.lit(f"\n📎 AI 初步审核解读详见附件《{report}》—— 请下载查阅完整解读内容。\n")]
    else:
        head = [F.lit("系统收到一封法律文书邮件，"), F.coalesce(counted, F.lit("")), F.lit("AI 分析结果如下：\n\n"), sections, F.lit("\n\n")]
    foot = f"\n{RULE}\n\n此为自动转发，如需查看完整原始邮件请登录监控邮箱。\n\n---\n|{system}\n"
    body = F.concat(*head, F.lit(f"{RULE}\n\n"), origin, F.lit("\n\n📧 原邮件正文：\n"), text, F.lit(foot))
    return mails.join(_sections(analyses, brief), "mail_id", "left").select("mail_id", body.alias("body"))


def distinct_endpoints(endpoints: Column) -> Column:
    """Sender endpoints to try, each (host, port, username, password_encrypted) once, in order; null ones are none.

    ``endpoints`` is an array of structs, of which other fields are those of the first alike.
    """
    key = ("host", "port", "username", "password_encrypted")

    def add(kept: Column, one: Column) -> Column:
        known = F.exists(kept, lambda x: reduce(lambda a, b: a & b, [x[k].eqNullSafe(one[k]) for k in key]))
        return F.when(one.isNull() | known, kept).otherwise(F.array_append(kept, one))

    return F.aggregate(endpoints, F.slice(endpoints, 1, 0), add)


def build_outbox(routed: DataFrame, analyses: DataFrame, mails: DataFrame, brief: bool = False, cut: int = BODY_CHARS, system: str = "", names: DataFrame | None = None) -> DataFrame:
    """(mail_id, target_email, subject, body): a row per routable mail and target; ``names`` has a target_name for each target_email, once."""
    rows = routed.filter("status = 'routable'").select("mail_id", F.explode(csv_list(F.col("targets"))).alias("target_email"))
    composed = compose_subjects(analyses, mails).join(compose_bodies(analyses, mails, brief, cut, system), "mail_id")
    rows = rows.withColumn("target_name", F.lit("")) if names is None else rows.join(names.select("target_email", "target_name"), "target_email", "left")
    greeting = F.concat(F.lit("您好 "), F.coalesce("target_name", F.lit("")), F.lit("，\n\n"))
    return rows.join(composed, "mail_id").select("mail_id", "target_email", "subject", F.concat(greeting, F.col("body")).alias("body"))
