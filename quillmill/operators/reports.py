"""Reports over the mail log and the delivery ledger, pages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.text import blank, clipped, csv_list, display_width, label, padded, percent, py_strip, safe_cell, split_sender, tenths
from quillmill.sources.ranks import ranked

NO_SUBJECT, UNRECOGNISED, UNKNOWN_ERROR = "(无主题)", "未识别", "未知错误"


def since_midnight(as_of: str) -> Column:
    return F.col("created_at") >= F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz"))


def day_overview(log: DataFrame, as_of: str) -> DataFrame:
    """Counts of the day in one pass."""
    day = log.filter(since_midnight(as_of))
    analysed = F.col("doc_type").isNotNull() & (F.col("doc_type") != "")
    counts = {"forwarded": F.col("status") == "forwarded", "failed": F.col("status") == "failed", "skipped": F.col("status") == "skipped", "urgent": F.col("urgency") == "high", "analyzed": analysed}
    return day.agg(F.count("*").alias("processed"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def cumulative(log: DataFrame, as_of: str) -> DataFrame:
    """Totals and success rates, of all time and of the day."""
    ok, today = F.col("status") == "forwarded", since_midnight(as_of)
    sums = log.agg(F.count("*").alias("total"), F.count_if(ok).alias("forwarded"), F.count_if(today).alias("today_total"), F.count_if(ok & today).alias("today_forwarded"))
    return sums.withColumns({"rate": percent(F.col("forwarded"), F.col("total")), "today_rate": percent(F.col("today_forwarded"), F.col("today_total"))})


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


def report_cube(log: DataFrame) -> DataFrame:
    """Counts by (day, status), (account, day), status and in all, in one scan."""
    day = log.select("account_id", "status", F.to_date("created_at").alias("day"))
    sets = [["day", "status"], ["account_id", "day"], ["status"], []]
    columns = ["day", "status", "account_id"]
    return day.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).cast("int").alias("level"))


def account_activity(accounts: DataFrame, log: DataFrame, as_of: str, none: str = "暂无记录") -> DataFrame:
    """(id, name, today, latest, note) of each enabled account."""
    stats = log.groupBy("account_id").agg(F.count_if(since_midnight(as_of)).alias("today"), F.max("created_at").alias("latest"))
    joined = accounts.filter("enabled").join(stats, accounts["id"] == stats["account_id"], "left")
    return joined.select("id", "name", F.coalesce("today", F.lit(0)).alias("today"), "latest", F.when(F.col("latest").isNull(), none).otherwise("").alias("note"))


def target_totals(ledger: DataFrame, since: str, until: str | None = None) -> DataFrame:
    """(target, total, failed, name) since a time; targets with failures only are there too."""
    rows = ledger.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).filter(~blank(F.col("target_email")))
    rows = rows.filter(F.col("created_at") < F.lit(until).cast("timestamp_ntz")) if until else rows
    name = py_strip(F.col("target_name"))
    first = F.min_by(F.when(name != "", name), F.when(name != "", F.struct("created_at", "target_name")))
    return rows.groupBy(py_strip(F.col("target_email")).alias("target")).agg(F.count_if("success").alias("total"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(first, F.lit("")).alias("name"))


def target_types(ledger: DataFrame, since: str) -> DataFrame:
    """(target, type, n, share, note): successes by type, each type once per record. The ledger is read once."""
    per = Window.partitionBy("target")
    note = (F.count("*").over(per) > 1) & (F.sum("n").over(per) != F.col("total"))
    rows = target_summary(ledger, since).filter(F.col("type").isNotNull())
    return rows.select("target", "type", "n", "share", note.alias("note"))


def target_summary(ledger: DataFrame, since: str) -> DataFrame:
    """(target, total, failed, type, n, share) of each target by type, in one pass; one row without a type if nothing succeeded.

    A record is counted in the target's totals once and by each of its types; both are summed
    by one aggregation over (target, type), where the totals have the null type.
    """
    rows = ledger.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).filter(~blank(F.col("target_email")))
    named = F.array_distinct(csv_list(F.when(blank(F.col("doc_types")), F.col("doc_type")).otherwise(F.col("doc_types"))))
    types = F.when(~F.col("success"), F.array().cast("array<string>")).when(F.size(named) == 0, F.array(F.lit(UNRECOGNISED))).otherwise(named)
    each = rows.select(py_strip(F.col("target_email")).alias("target"), "success", F.explode(F.array_append(types, F.lit(None).cast("string"))).alias("type"))
    counts = each.groupBy("target", "type").agg(F.count_if("success").alias("n"), F.count_if(~F.col("success")).alias("bad"))
    per = Window.partitionBy("target")
    whole = F.col("type").isNull()
    summed = counts.withColumns({"total": F.max(F.when(whole, F.col("n"))).over(per), "failed": F.max(F.when(whole, F.col("bad"))).over(per), "kinds": F.count("type").over(per)})
    shown = summed.filter(~whole | (F.col("kinds") == 0))
    return shown.select("target", "total", "failed", "type", F.when(~whole, F.col("n")).alias("n"), F.when(~whole, F.round(F.col("n") * 100.0 / F.col("total"), 1)).alias("share"))


def subject_lists(ledger: DataFrame, since: str) -> DataFrame:
    """(target, seq, subject, type): successes of a target by time; a target may have a large share of all."""
    rows = ledger.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).filter(~blank(F.col("target_email")) & F.col("success"))
    subject = F.when(blank(F.col("subject")), NO_SUBJECT).otherwise(F.col("subject"))
    kind = F.when(blank(F.col("doc_type")), UNRECOGNISED).otherwise(F.col("doc_type"))
    listed = rows.select(py_strip(F.col("target_email")).alias("target"), "created_at", "id", clipped(subject).alias("subject"), kind.alias("type"))
    return ranked(listed, ["target"], ["created_at", "id"], "seq").select("target", "seq", "subject", "type")


#: The rule between sections of a summary, and its last lines.
RULE = "━" * 23
FOOT = ("此为自动生成的每日汇总，请勿回复。", "如需调整接收邮箱或发送时间，请前往系统设置页面配置。")


def _type_bars(types: DataFrame) -> DataFrame:
    """(target, rows, width, n, names): types by count, then name; the width of the widest."""
    row = F.struct((-F.col("n")).alias("order"), "type", "n")
    listed = types.groupBy("target").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max(display_width(F.col("type"))).alias("width"), F.sum("n").alias("n"))
    return listed.select("target", "rows", "width", "n", F.array_join(F.transform("rows", lambda x: x.type), "、").alias("names"))


def render_summary(totals: DataFrame, types: DataFrame, day: str, brief: bool = True, subjects: DataFrame | None = None, system: str = "", now: str = "", attachment: str = "") -> DataFrame:
    """(target, text): the day's summary for each target.

    Types go by count, then name. The full text has them as aligned lines and lists the subjects of
    ``subject_lists``; the brief one only names them, and the ``attachment`` that has the rest.
    """
    hello = F.when(F.col("name") != "", F.concat("name", F.lit(" 您好，"))).otherwise("您好，")
    head = F.concat(F.lit(f"以下是 {system} 统计的、{day} 当天转发给 "), "target", F.lit(f" 的文书汇总（{now}）："))
    failed = F.when(F.col("failed") > 0, F.format_string("  转发失败：%d 封（已记录，需人工关注）", "failed"))
    joined = totals.join(_type_bars(types), "target", "left")

    def section(*lines: Column | str) -> Column:
        return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])

    if brief:
        named = F.when(F.col("names") != "", F.concat(F.lit("📁 涉及类型："), "names"))
        place = ("", RULE, "", f"📎 文书类型分布与今日转发清单已按表格整理在附件《{attachment}》中，", "   请下载查阅。", "", RULE) if attachment else ()
        return joined.select("target", section(hello, "", head, "", F.format_string("📊 转发总数：%d 封", "total"), failed, named, *place, "", *FOOT).alias("text"))

    def bar(x: Column) -> Column:
        share = F.when(F.col("total") > 0, x["n"] * 100.0 / F.col("total")).otherwise(0.0)
        return F.concat(F.lit("  "), padded(x["type"], F.col("width")), F.format_string("%3d 封  (%5.1f%%)", x["n"], tenths(share)))

    note = F.when((F.size("rows") > 1) & (F.col("n") != F.col("total")), "\n  说明：一封邮件含多份不同类型文书时会按类型分别计数，\n        因此各类型数量之和可能大于转发总数。")
    bars = F.coalesce(F.array_join(F.transform("rows", bar), "\n"), F.lit("  （今日无转发记录）"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "subject"))), lambda x: F.concat(F.lit("  · ["), x["type"], F.lit("] "), x["subject"]))
    if subjects is not None:
        joined = joined.join(subjects.groupBy("target").agg(F.array_join(ordered, "\n").alias("listed")), "target", "left")
    listed = F.lit(None).cast("string") if subjects is None else F.col("listed")
    shown = F.when(listed.isNotNull(), section("", RULE, "📋 今日转发清单", RULE, listed))
    top = section(hello, "", head, "", RULE, "📊 今日转发概况", RULE, F.format_string("  转发总数：%d 封", "total"), failed, "", RULE, "📁 文书类型分布", RULE)
    return joined.select("target", section(top, bars, note, shown, "", RULE, "", *FOOT).alias("text"))


def search_log(log: DataFrame, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """Rows of a status with a keyword in subject, sender or summary; % and _ stay wildcards."""
    out = log.filter(F.col("status") == status) if status else log
    if keyword:
        hit = [F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False)) for c in ("subject", "sender", "case_summary")]
        out = out.filter(hit[0] | hit[1] | hit[2])
    return out


def date_range(df: DataFrame, start: str | None, end: str | None, column: str = "created_at") -> DataFrame:
    """Rows from the start of one day to 23:59:59 of another; bounds that aren't dates are ignored."""
    c = F.col(column)
    low, high = (F.lit(x or None).cast("string").try_cast("date") for x in (start, end))
    after = low.isNull() | (c >= low.cast("timestamp_ntz"))
    before = high.isNull() | (c <= high.cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second"))
    return df.filter(after & before)


def page(log: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    return log.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def page_after(log: DataFrame, created_at: str, last_id: int, size: int = 20) -> DataFrame:
    """The page after a row: no deep offset."""
    at = F.lit(created_at).cast("timestamp_ntz")
    older = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last_id))
    return page(log.filter(older), 1, size)


def total_pages(log: DataFrame, size: int = 20) -> DataFrame:
    return log.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("bigint").alias("total_pages"))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    return page(log, 1, n)


def recent_failures(log: DataFrame, n: int = 5) -> DataFrame:
    subject = F.when(blank(F.col("subject")), NO_SUBJECT).otherwise(F.col("subject"))
    error = F.left(F.when(blank(F.col("error_message")), UNKNOWN_ERROR).otherwise(F.col("error_message")), F.lit(120))
    return page(log.filter("status = 'failed'"), 1, n).select("id", subject.alias("subject"), error.alias("error"))


def types_by_count(log: DataFrame) -> DataFrame:
    return log.filter(~blank(F.col("doc_type"))).groupBy("doc_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_type")


def with_attachments(log: DataFrame, attachments: DataFrame) -> DataFrame:
    """``log`` with attachment_names, joined in order of id; names are gathered before the join."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "filename"))), lambda x: x.filename)
    names = attachments.groupBy("log_id").agg(F.array_join(ordered, "; ").alias("attachment_names"))
    return log.join(names, log["id"] == names["log_id"], "left").drop("log_id").fillna("", ["attachment_names"])


def attachments_between(attachments: DataFrame, log: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Attachments of the mails of a date range, newest mail first."""
    mails = date_range(log, start, end).select(F.col("id").alias("mail"), F.col("created_at").alias("mail_at"))
    return attachments.join(mails, F.col("log_id") == F.col("mail")).drop("mail").orderBy(F.desc("mail_at"), F.desc("log_id"), "id")


def export_rows(log: DataFrame, attachments: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The 13 columns of the export, newest first; every text is safe in a spreadsheet."""
    return _exported(log, attachments, start, end).drop("_at", "_id")


def _exported(log: DataFrame, attachments: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The export's columns with _at and _id, by which it is in order."""
    rows = with_attachments(date_range(log, start, end), attachments)
    sender = split_sender(F.col("sender"))
    name = F.when((sender["name"] == "") & ~F.col("sender").contains("<"), F.col("sender")).otherwise(sender["name"])
    when = F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("subject", "doc_type", "case_summary", "key_date", "case_number", "involved_parties", "target_email", "error_message", "attachment_names")}
    columns = {"created_at": when, "sender_name": name, "sender_addr": sender["addr"], "subject": text["subject"], "doc_type": text["doc_type"], "urgency": label(F.col("urgency"), "urgency"), "status": label(F.col("status"), "status"), "case_summary": text["case_summary"], "key_date": text["key_date"], "case_number": text["case_number"], "involved_parties": text["involved_parties"], "targets": text["target_email"], "attachments": text["attachment_names"]}
    return rows.orderBy(F.desc("created_at"), F.desc("id")).select(*[safe_cell(c).alias(k) for k, c in columns.items()], F.col("created_at").alias("_at"), F.col("id").alias("_id"))


#: How cells are written: quoted only where they must be, blanks kept, nothing for an empty one.
CSV = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
BOM = "\ufeff"


def export_log_csv(log: DataFrame, attachments: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
    """The export as text parts that are one CSV file if joined in order of their names, with one BOM and one header at its start.

    Parts are ranges of the order, so no task writes it all. The first row brings the header; without any row there is it alone.
    """
    rows = _exported(log, attachments, start, end)
    cells = [c for c in rows.columns if c not in ("_at", "_id")]
    header = f"{BOM}{','.join(cells)}"
    first = date_range(log, start, end).orderBy(F.desc("created_at"), F.desc("id")).select("id").first()
    if first is None:
        lines = rows.sparkSession.createDataFrame([(header,)], "line string").coalesce(1)
    else:
        line = F.to_csv(F.struct(*cells), CSV)
        lines = rows.select(F.when(F.col("_id") == first.id, F.concat(F.lit(f"{header}\r\n"), line)).otherwise(line).alias("line"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_parts(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an export: (name, length) of its parts; by name, they are in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length").orderBy("name")


def attachment_manifest(attachments: DataFrame, log: DataFrame, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    from quillmill.functions.text import in_sandbox

    rows = attachments_between(attachments, log, start, end)
    return rows.filter(~blank(F.col("file_path")) & in_sandbox(F.col("file_path"), root)).select("log_id", "filename", "file_path", "file_size")
