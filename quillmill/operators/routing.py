"""From analyses and rules to targets: rule matching, group verdicts and the route of each mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import NON_LEGAL, OTHER, blank, csv_list, py_strip

#: Rules up to this many are broadcast; more go through ordinary joins.
BROADCAST_RULES = 100_000


def enabled(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("enabled", F.lit(False)))


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rules, rejects): unknown kinds are account rules, these have no types; type rules need one."""
    kind = F.when(F.col("rule_type") == "doc_type", "doc_type").otherwise("account")
    types = F.when(kind == "doc_type", F.array_join(F.array_distinct(csv_list(F.col("doc_type"))), ",")).otherwise("")
    checked = rules.withColumns({"rule_type": kind, "doc_type": types})
    bad = (F.col("rule_type") == "doc_type") & (F.col("doc_type") == "")
    return checked.filter(~bad), checked.filter(bad)


def duplicate_rules(rules: DataFrame) -> DataFrame:
    key = ["rule_type", "doc_type", "account_ids", py_strip(F.col("target_email")).alias("target_email")]
    return rules.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def match_rules(mails: DataFrame, rules: DataFrame) -> DataFrame:
    """(mail_id, rule_id, target, pos, name): every target of every rule that a mail hits.

    ``mails``: mail_id, account_id, doc_types (array). A rule without account ids holds for all
    accounts; a list without a valid id for none. Type rules need a common type. Rules for all
    accounts meet mails by type. Account rules for all accounts hold for every mail alike: they are
    gathered into one list first, one row for each of their targets, which is attached to the mails.
    A rule that a mail hits in several ways is there as often; ``ordered_targets`` does not mind.
    """
    rules = enabled(rules).filter(~blank(F.col("target_email")))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    few = F.broadcast if small else lambda df: df
    ids = F.filter(csv_list(F.col("account_ids")), lambda x: x.rlike("^[0-9]+$"))
    typed = F.coalesce(F.col("rule_type") == "doc_type", F.lit(False))
    shaped = rules.select(
        F.col("id").alias("rule_id"), "target_email", "target_name", typed.alias("typed"), blank(F.col("account_ids")).alias("for_all"),
        F.transform(ids, lambda x: x.cast("bigint")).alias("accounts"), F.array_distinct(csv_list(F.col("doc_type"))).alias("types"),
    )
    each_account = shaped.filter(~F.col("for_all")).withColumn("account_id", F.explode(F.array_distinct("accounts")))
    each_type = shaped.filter("typed").withColumn("type", F.explode("types"))
    mail_types = mails.select("mail_id", "account_id", F.explode(F.array_distinct("doc_types")).alias("type"))
    keep = ["mail_id", "rule_id", "target_email", "target_name"]
    hits = [
        mails.join(few(each_account.filter("not typed")), "account_id").select(*keep),
        mail_types.join(few(each_type.filter("for_all")), "type").select(*keep),
        mail_types.join(few(each_type.filter("not for_all").withColumn("account_id", F.explode(F.array_distinct("accounts")))), ["type", "account_id"]).select(*keep),
    ]
    union = hits[0].union(hits[1]).union(hits[2])
    spread = union.select("mail_id", "rule_id", F.posexplode(csv_list(F.col("target_email"))).alias("pos", "target"), py_strip(F.col("target_name")).alias("name"))
    every = shaped.filter("for_all and not typed").select("rule_id", F.posexplode(csv_list(F.col("target_email"))).alias("pos", "target"), py_strip(F.col("target_name")).alias("name"))
    firsts = first_of_targets(every, "target")
    listed = firsts.agg(F.collect_list(F.struct("*"))).scalar()  # one value, whatever the number of mails
    return spread.unionByName(mails.select("mail_id", listed.alias("listed")).select("mail_id", F.inline("listed")).select(*spread.columns))


def first_of_targets(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule_id, pos, name): the first rule and place of each target, and under them its first name, as rows of matches."""
    named = F.col("name") != ""
    least = F.min(F.struct("rule_id", "pos", "name")).alias("first")
    by_name = F.min(F.when(named, F.struct("rule_id", "pos", "name"))).alias("by_name")
    both = matches.groupBy(*keys).agg(least, by_name)
    return both.select(*keys, F.explode(F.array_distinct(F.array_compact(F.array("first", "by_name")))).alias("m")).select(*keys, "m.*")


def ordered_targets(matches: DataFrame) -> DataFrame:
    """(mail_id, target, name, first): one row per target, in order of its first rule and place; first non-blank name."""
    first = F.min(F.struct("rule_id", "pos")).alias("first")
    named = F.min_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.struct("rule_id", "pos")))
    return matches.groupBy("mail_id", "target").agg(first, F.coalesce(named, F.lit("")).alias("name"))


def target_lists(targets: DataFrame) -> DataFrame:
    """(mail_id, targets): targets of a mail joined in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "target"))), lambda x: x.target)
    return targets.groupBy("mail_id").agg(F.array_join(ordered, ",").alias("targets"))


def is_junk(doc_type: Column, confidence: Column, llm_failed: Column) -> Column:
    return F.coalesce(~F.coalesce(llm_failed, F.lit(False)) & (confidence < 0.3) & doc_type.isin(OTHER, NON_LEGAL), F.lit(False))


def assemble_mail(analyses: DataFrame) -> DataFrame:
    """One row per mail from its groups: fields of the first, all types and interpretations, verdicts, the route's pick.

    The pick is the most confident group whose model call did not fail, the earliest of equals;
    the first group if all failed. Types that a badly classified group fell back to are taken out
    of ``route_types``, even where a good group has them.
    """
    failed, unclassified = F.coalesce("llm_failed", F.lit(False)), F.coalesce("classify_failed", F.lit(False))
    fields = F.struct("doc_type", "case_summary", "urgency", "key_date", "case_number", "involved_parties")
    ordered = F.array_sort(F.collect_list(F.struct("group_idx", "doc_type", "ai_interpretation")))
    pick = F.struct("doc_type", "confidence", failed.alias("llm_failed"))
    rank = F.struct(F.col("confidence"), -F.col("group_idx"))
    grouped = analyses.groupBy("mail_id").agg(
        F.min_by(fields, "group_idx").alias("head"),
        ordered.alias("groups"),
        F.coalesce(F.max_by(F.when(~failed, pick), F.when(~failed, rank)), F.min_by(pick, "group_idx")).alias("pick"),
        F.collect_set(F.when(unclassified, F.col("doc_type"))).alias("unsure"),
        F.bool_or(failed).alias("any_failed"),
        F.bool_and(failed).alias("all_failed"),
        F.bool_and(unclassified).alias("no_basis"),
    )
    types = F.filter(F.transform("groups", lambda g: g.doc_type), lambda t: F.coalesce(t != "", F.lit(False)))
    many = F.size("groups") > 1
    said = F.transform("groups", lambda g, i: F.when(many, F.concat(F.lit("【第"), (i + 1).cast("string"), F.lit("组】\n"), F.coalesce(g.ai_interpretation, F.lit("")))).otherwise(F.coalesce(g.ai_interpretation, F.lit(""))))
    return grouped.select(
        "mail_id", "head.*", F.array_join(types, ",").alias("doc_types"), F.array_join(said, "\n\n---\n\n").alias("interpretation"),
        F.col("pick.doc_type").alias("pick_type"), F.col("pick.confidence").alias("pick_confidence"), F.col("pick.llm_failed").alias("pick_failed"),
        F.array_except(F.array_union(types, F.array_compact(F.array("pick.doc_type"))), F.col("unsure")).alias("route_types"),
        "any_failed", "all_failed", "no_basis",
    ).withColumn("involved_parties", F.left("involved_parties", F.lit(500)))


def route(assembled: DataFrame, rules: DataFrame, default_target: str | None = None, has_endpoint: Column | None = None) -> DataFrame:
    """(mail_id, status, reason, targets): the verdict on each mail, in the order of the checks.

    ``assembled``: the rows of ``assemble_mail`` with account_id. A default target is one target,
    as it is; blanks are none. Mails without any basis get no target.
    """
    mails = assembled.select("mail_id", "account_id", F.when(F.col("no_basis"), F.array().cast("array<string>")).otherwise(F.col("route_types")).alias("doc_types"), "no_basis")
    found = target_lists(ordered_targets(match_rules(mails.filter(~F.col("no_basis")), rules)))
    fallback = F.lit((default_target or "").strip())
    targets = F.when(F.col("no_basis"), "").otherwise(F.coalesce("targets", fallback))
    junk = is_junk(F.col("pick_type"), F.col("pick_confidence"), F.col("pick_failed"))
    endpoint = F.lit(True) if has_endpoint is None else F.coalesce(has_endpoint, F.lit(False))
    checks = [(F.col("no_basis") | F.col("all_failed"), "failed", "no group could be analysed"), (junk, "skipped", "junk"), (targets == "", "failed", "no target"), (~endpoint, "failed", "no sender endpoint")]
    status, reason = F.lit("routable"), F.lit("")
    for test, value, text in reversed(checks):
        status, reason = F.when(test, value).otherwise(status), F.when(test, text).otherwise(reason)
    joined = assembled.join(found, "mail_id", "left")
    return joined.select("mail_id", status.alias("status"), reason.alias("reason"), F.when(status == "routable", targets).otherwise("").alias("targets"))


def rule_account_names(rules: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, account_names): names in list order; unknown ids go."""
    ids = rules.select("id", F.posexplode(csv_list(F.col("account_ids"))).alias("pos", "account"))
    named = ids.join(accounts.select(F.col("id").cast("string").alias("account"), "name"), "account")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return rules.select("id").join(named.groupBy("id").agg(F.array_join(ordered, ", ").alias("account_names")), "id", "left").fillna("", ["account_names"])


def resolve_rule_accounts(rules: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with account_ids, rejects): an unknown name rejects its rule rather than make it global."""
    names = rules.select("rule_key", F.posexplode(csv_list(F.col("account_names"))).alias("pos", "name"))
    found = names.join(accounts.groupBy("name").agg(F.min("id").alias("account")), "name", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "account"))), lambda x: x.account.cast("string"))
    by_rule = found.groupBy("rule_key").agg(F.array_join(ordered, ",").alias("account_ids"), F.bool_and(F.col("account").isNotNull()).alias("known"))
    joined = rules.join(by_rule, "rule_key", "left").fillna("", ["account_ids"]).fillna(True, ["known"])
    return joined.filter("known").drop("known"), joined.filter("not known").drop("known", "account_ids")
