"""Model input and output: groups, prompts within a budget, tolerant JSON, validated analyses."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmill.functions.arrays import let
from quillmill.functions.names import fresh
from quillmill.functions.text import NON_LEGAL, OTHER, chinese_chars, estimate_tokens, parse_caps, py_strip, tokens_of_counts, urls

ANALYSIS = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_type", "case_summary", "ai_interpretation", "urgency", "key_date", "case_number", "involved_parties", "confidence", "revised_document", "contract_party_a", "contract_party_b", "contract_name", "contract_content", "contract_amount", "agency_name", "document_title_no")])


def capability_dim(spark, path: str) -> DataFrame:
    """(doc_type, caps, ord) from type files; the two system types are always there, and last."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("doc_type"), parse_caps(F.col("value")).alias("caps"))
    system = spark.createDataFrame([(OTHER, [], 1), (NON_LEGAL, [], 2)], "doc_type string, none array<string>, place int")
    own = files.filter(~F.col("doc_type").isin(OTHER, NON_LEGAL)).withColumn("place", F.lit(0))
    last = system.join(files, "doc_type", "left").select("doc_type", F.coalesce("caps", "none").alias("caps"), "place")
    order = F.row_number().over(Window.orderBy("place", "doc_type")) - 1  # a handful of types
    return own.unionByName(last).select("doc_type", "caps", order.cast("int").alias("ord"))


def validate_groups(mails: DataFrame) -> DataFrame:
    """(mail_id, groups): proposed groups of attachments if they cover all indices, else one each; one group for one attachment."""
    n = F.col("n")
    flat = F.array_distinct(F.flatten(F.coalesce("groups", F.array().cast("array<array<int>>"))))
    valid = F.forall(flat, lambda i: (i >= 0) & (i < n)) & (F.size(flat) == n)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(i))
    one = F.array(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")))
    return mails.select("mail_id", F.when((n <= 1) | ~F.coalesce("grouping", F.lit(True)), one).when(valid, F.col("groups")).otherwise(each).alias("groups"))


def combine_texts(texts: DataFrame, keys: list[str], cap: int = 0) -> DataFrame:
    """(keys, text): attachments under their names in order; cut with a notice beyond ``cap``."""
    part = F.concat(F.lit("=== 附件: "), "filename", F.lit(" ===\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("att_idx", part.alias("part"))))
    joined = texts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x.part), "\n\n").alias("text"))
    cut = F.concat(F.left("text", F.lit(cap)), F.lit("\n（内容过长，已截断）"))
    return joined.withColumn("text", F.when(F.length("text") > cap, cut).otherwise(F.col("text"))) if cap else joined


def group_listing(texts: DataFrame) -> DataFrame:
    """(mail_id, listing): numbered names with the start of each text."""
    start = py_strip(F.translate(F.left(F.coalesce("text", F.lit("")), F.lit(150)), "\r\n", "  "))
    line = F.concat(F.col("att_idx").cast("string"), F.lit(". "), "filename", F.lit(" "), F.when(start == "", "（无文本内容）").otherwise(start))
    ordered = F.array_sort(F.collect_list(F.struct("att_idx", line.alias("line"))))
    return texts.groupBy("mail_id").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("listing"))


def fit_attachments(parts: DataFrame, budget: Column, fixed_chinese: Column | None = None, fixed_other: Column | None = None) -> DataFrame:
    """Parts (mail_id, att_idx, text) of the longest prefix within the token budget, by running sums; no text is counted twice."""
    chinese = chinese_chars(F.col("text"))
    upto = Window.partitionBy("mail_id").orderBy("att_idx").rowsBetween(Window.unboundedPreceding, 0)
    c, o = (fresh(parts, x) for x in ("n_chinese", "n_other"))
    counted = parts.withColumns({c: chinese, o: F.length("text") - chinese})
    separators = 2 * (F.count("*").over(upto) - 1)
    used = tokens_of_counts(F.sum(c).over(upto) + (F.lit(0) if fixed_chinese is None else fixed_chinese), F.sum(o).over(upto) + separators + (F.lit(0) if fixed_other is None else fixed_other))
    return counted.withColumn("used", used).filter(F.col("used") <= budget).drop(c, o)


#: Heads of the regions of a prompt, what stands before attachments, what stays of a body that can't be kept.
INPUT, OUTPUT, ATTACHED, CUT_BODY = "## Input", "## Output", "\n\n## 附件内容\n", "(body truncated due to length)"


def _counts(c: Column) -> Column:
    """struct(chinese, other) characters of a text."""
    return let(chinese_chars(c).cast("bigint"), lambda chinese: F.struct(chinese.alias("chinese"), (F.length(c) - chinese).alias("other")))


def kept_attachments(template: Column, attachments: Column, budget: Column) -> Column:
    """struct(text, fits): the longest list of whole attachments that fits beside the template; at least the last one goes. Each is counted once."""
    split = F.transform(F.filter(F.transform(F.split(attachments, "=== "), py_strip), lambda x: x != ""), lambda x: F.concat(F.lit("=== "), x))
    fixed, label = _counts(template), _counts(F.lit(ATTACHED))
    sums = let(fixed, lambda x: F.struct(x["chinese"].alias("chinese"), x["other"].alias("other"), F.lit(0).alias("n"), F.lit(0).alias("best"), (tokens_of_counts(x["chinese"], x["other"]) <= budget).alias("fits")))

    def longer(acc: Column, own: Column) -> Column:
        before = F.when(acc["n"] == 0, label).otherwise(F.struct(F.lit(0).cast("bigint").alias("chinese"), F.lit(2).cast("bigint").alias("other")))
        chinese, other, n = acc["chinese"] + own["chinese"] + before["chinese"], acc["other"] + own["other"] + before["other"], acc["n"] + 1
        fits = tokens_of_counts(chinese, other) <= budget
        return F.struct(chinese.alias("chinese"), other.alias("other"), n.alias("n"), F.when(fits, n).otherwise(acc["best"]).alias("best"), (acc["fits"] | fits).alias("fits"))

    def kept(parts: Column) -> Column:
        counts = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), _counts)
        return let(F.aggregate(counts, sums, longer), lambda found: F.struct(F.array_join(F.slice(parts, F.lit(1), found["best"]), "\n\n").alias("text"), found["fits"].alias("fits")))

    return let(split, kept)


def truncate_prompt(prompts: DataFrame) -> DataFrame:
    """(id, template, attachments, other columns) within the budget of tokens; ``prompts``: id, template, attachments, window, ratio, output, others.

    The budget is what the window's share leaves beside the output, 1,024 at least. Without
    attachments a prompt stays as it is. Then attachments go from the last on, and if the template
    alone is over the budget, its region from ``INPUT`` to ``OUTPUT`` is cut by 15 % while over 100
    characters. If that does not help, the region only says so; a template without the regions is cut
    at two characters a token. Only those few templates are given to Python. Each prompt is counted once, in one pass.
    """

    def tokens(text: str) -> int:
        chinese = len(re.findall(r"[一-鿿㐀-䶿]", text))
        return max(int(chinese / 0.85 + (len(text) - chinese) / 4), len(text) // 10)

    def shortened(text: str, most: int) -> str:
        a, b = text.find(INPUT), text.find(OUTPUT)
        if a < 0 or b <= a:
            return text[: most * 2]
        head, region, tail = text[:a], text[a:b], text[b:]
        while (over := tokens(head + region + tail) > most) and len(region) > 100:
            region = region[: -max(1, int(len(region) * 0.15))]
        return head + (f"{INPUT}\n{CUT_BODY}\n{OUTPUT}\n" if over else region) + tail

    @F.pandas_udf("string")
    def cut(template: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else shortened(text, int(most)) for text, most in zip(template, budget)], dtype="object")

    budget = F.greatest((F.col("window") * F.col("ratio")).cast("bigint") - F.col("output"), F.lit(1024))
    others = [c for c in prompts.columns if c not in ("id", "template", "attachments", "window", "ratio", "output")]
    limit, kept, short = (fresh(prompts, x) for x in ("budget", "kept", "short_template"))
    texts = prompts.select("id", F.coalesce("template", F.lit("")).alias("template"), F.coalesce("attachments", F.lit("")).alias("attachments"), budget.alias(limit), *[f"`{c}`" for c in others])
    whole = F.concat("template", F.lit(ATTACHED), "attachments")
    over = (F.col("attachments") != "") & (estimate_tokens(whole) > F.col(limit))
    tried = texts.withColumn(kept, F.when(over, kept_attachments(F.col("template"), F.col("attachments"), F.col(limit))))  # null: all stays
    bare = ~F.col(f"{kept}.fits")
    done = tried.withColumn(short, cut(F.when(bare, F.col("template")), F.when(bare, F.col(limit))))
    attachments = F.when(F.col(kept).isNull(), F.col("attachments")).when(bare, "").otherwise(F.col(f"{kept}.text"))
    return done.select("id", F.when(bare, F.col(short)).otherwise(F.col("template")).alias("template"), attachments.alias("attachments"), *[f"`{c}`" for c in others])


def fill_template(template: str, values: dict[str, Column], appended: dict[str, str] | None = None) -> Column:
    """``{name}`` of known names replaced in one pass; values and other braces are literal.

    A value named in ``appended`` that the template has no place for goes to the end, under its heading
    there, unless it is empty.
    """
    parts = re.split("(" + "|".join(re.escape("{%s}" % k) for k in values) + ")", template) if values else [template]
    filled = F.concat(*[values[p[1:-1]] if p[1:-1] in values and p[:1] == "{" else F.lit(p) for p in parts])
    for name, heading in (appended or {}).items():
        if f"{{{name}}}" not in template:
            said = F.coalesce(values[name], F.lit(""))
            filled = F.concat(filled, F.when(said != "", F.concat(F.lit(f"\n\n{heading}\n" if heading else "\n\n"), said)).otherwise(""))
    return filled


def tolerant_json(text: str | None) -> str | None:
    """A JSON object out of a model's reply, as strict JSON; null if there is none."""
    raw = (text or "").strip()
    mended = re.sub(r",(\s*[}\]])", r"\1", re.sub(r'(:\s*")((?:[^"\\]|\\.)*)(")', lambda m: m[1] + m[2].replace("\n", "\\n") + m[3], raw))
    a, b = raw.find("{"), raw.rfind("}")
    candidates = [raw, mended, *([raw[a : b + 1], mended[mended.find("{") : mended.rfind("}") + 1]] if 0 <= a < b else [])]
    candidates += [c[1:-1].strip() for c in candidates if c.startswith("{{") and c.endswith("}}")]
    for read in (json.loads, ast.literal_eval):
        for c in candidates:
            try:
                value = read(c)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
            if isinstance(value, dict):
                return json.dumps({str(k): v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v) for k, v in value.items()}, ensure_ascii=False, default=str)
    return None


def parse_replies(replies: DataFrame, content: str = "content") -> DataFrame:
    """``replies`` with analysis (struct) and parsed; Python only sees the replies that built-in JSON cannot read."""
    strict = F.from_json(content, ANALYSIS)
    readable = F.try_parse_json(content).isNotNull() & F.ltrim(content).startswith("{")

    @F.pandas_udf("string")
    def repaired(text: pd.Series) -> pd.Series:
        return text.map(tolerant_json)

    good = replies.filter(F.coalesce(readable, F.lit(False))).withColumns({"analysis": strict, "parsed": F.lit(True)})
    mend = fresh(replies, "mended")
    rest = replies.filter(~F.coalesce(readable, F.lit(False))).withColumn(mend, repaired(content))
    mended = rest.withColumns({"analysis": F.from_json(mend, ANALYSIS), "parsed": F.col(mend).isNotNull()}).drop(mend)
    return good.unionByName(mended)


def confidence_of(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).otherwise(0.5)


def validate_analysis(a: Column) -> Column:
    """The struct with defaults: type, urgency, confidence, texts never null, absent facts null."""
    kind = F.when(F.coalesce(py_strip(a["doc_type"]), F.lit("")) == "", OTHER).otherwise(py_strip(a["doc_type"]))
    urgency = F.lower(py_strip(a["urgency"]))
    said = {"doc_type": kind, "urgency": F.when(urgency.isin("high", "medium", "low"), urgency).otherwise("medium"), "confidence": confidence_of(a["confidence"])}
    for c in ("key_date", "case_number", "revised_document"):
        said[c] = F.nullif(a[c], F.lit(""))
    return F.struct(*[said.get(f.name, F.coalesce(a[f.name], F.lit(""))).alias(f.name) for f in ANALYSIS])


def validate_classes(classified: DataFrame, dim: DataFrame) -> DataFrame:
    """``classified`` (doc_type, confidence, parsed) checked against the known types."""
    name = fresh(classified, "known_type")
    known = dim.select(F.col("doc_type").alias(name)).distinct()
    joined = classified.join(F.broadcast(known) if known.limit(100_001).count() <= 100_000 else known, F.col("doc_type") == F.col(name), "left")
    ok = F.coalesce("parsed", F.lit(False))
    return joined.withColumns({"doc_type": F.when(ok, F.coalesce(name, F.lit(OTHER))).otherwise(OTHER), "confidence": F.when(ok, confidence_of(F.col("confidence"))).otherwise(0.5), "classify_failed": ~ok}).drop(name)


#: The analysis of a mail that is not legal.
MINIMAL = {"case_summary": "非法律文书，无需法律分析", "ai_interpretation": "该邮件在文书类型识别阶段被判定为非法律文书，无需法律审核，仅归档即可。", "urgency": "low"}


def split_non_legal(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to analyse, analysed): what is not legal gets a constant minimal analysis and skips the second stage.

    Its facts are null, its other texts empty; confidence and failure stay those of the first stage.
    """
    out = F.coalesce((F.col("doc_type") == NON_LEGAL) & ~F.col("classify_failed"), F.lit(False))
    facts = ("key_date", "case_number", "revised_document")
    said = {f.name: F.lit(MINIMAL.get(f.name, None if f.name in facts else "")).cast("string") for f in ANALYSIS if f.name not in ("doc_type", "confidence")}
    return classified.filter(~out), classified.filter(out).withColumns(said)


def merge_stages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stage two with type, confidence and failure of stage one; ``disagrees`` tells where the types differ."""
    kind, sure, failed = (fresh(second, x) for x in ("first_type", "first_confidence", "first_failed"))
    own = first.select("mail_id", "group_idx", F.col("doc_type").alias(kind), F.col("confidence").alias(sure), F.col("classify_failed").alias(failed))
    joined = second.join(own, ["mail_id", "group_idx"])
    return joined.withColumns({"disagrees": ~F.col("doc_type").eqNullSafe(F.col(kind)), "doc_type": F.col(kind), "confidence": F.col(sure), "classify_failed": F.col(failed)}).drop(kind, sure, failed)


def gate_capabilities(analyses: DataFrame, dim: DataFrame) -> DataFrame:
    """``analyses`` with do_revision and do_review by their type's capabilities."""
    kind, own = (fresh(analyses, x) for x in ("caps_type", "caps"))
    caps = dim.select(F.col("doc_type").alias(kind), F.col("caps").alias(own))
    joined = analyses.join(caps, F.col("doc_type") == F.col(kind), "left")
    ok = ~F.coalesce("llm_failed", F.lit(False)) & (F.coalesce(py_strip(F.col("revised_document")), F.lit("")) != "")
    revise = F.coalesce(F.array_contains(own, "修订"), F.lit(False)) & ok
    return joined.withColumns({"do_revision": revise, "do_review": F.coalesce(F.array_contains(own, "审查"), F.lit(False))}).drop(kind, own)


def unpack_analyses(log: DataFrame, column: str = "llm_raw_response") -> DataFrame:
    """(id, group_idx, analysis): an array gives groups, an object one, anything else none."""
    text = F.ltrim(column)
    wrapped = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    groups = F.from_json(wrapped, T.ArrayType(ANALYSIS))
    return log.select("id", F.posexplode(groups).alias("group_idx", "analysis"))


def citation_links(results: DataFrame, most: int = 10) -> DataFrame:
    """(mail_id, links): distinct URLs in the order of their first place, ten at most."""
    found = results.select("mail_id", "seq", F.posexplode(urls(F.col("text"))).alias("pos", "url"))
    first = found.groupBy("mail_id", "url").agg(F.min(F.struct("seq", "pos")).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x.url)
    return first.groupBy("mail_id").agg(F.slice(ordered, 1, most).alias("links"))
