from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.functions.text import NON_LEGAL, OTHER
from quillmill.operators import ledger, routing
from quillmill.plans.views import RULES, rules

RULE = "id bigint, rule_type string, account_ids string, doc_type string, target_email string, target_name string, enabled boolean"
ANALYSIS = "mail_id bigint, group_idx bigint, doc_type string, confidence double, classify_failed boolean, llm_failed boolean, case_summary string, ai_interpretation string, urgency string, key_date string, case_number string, involved_parties string"


def analyses(spark, *groups):
    """Groups of mail 1: (type, confidence, classify_failed, llm_failed)."""
    return spark.createDataFrame([(1, n, t, c, bad, dead, "s", f"read {n}", "low", None, None, "p") for n, (t, c, bad, dead) in enumerate(groups)], ANALYSIS)


def routed(spark, groups, rows, account=1, default=None):
    mails = routing.assemble_mail(analyses(spark, *groups)).withColumn("account_id", F.lit(account).cast("bigint"))
    r = routing.route(mails, spark.createDataFrame([(n, *x) for n, x in enumerate(rows)], RULE), default).first()
    return r.status, r.targets


GOOD = [("判决书", 0.9, False, False)]


@pytest.mark.parametrize(("groups", "rows", "account", "default", "expected"), [
    (GOOD, [("account", "", "", "a@x.com", "", True)], 7, None, ("routable", "a@x.com")),
    (GOOD, [("account", "3,4", "", "a@x.com", "", True)], 3, None, ("routable", "a@x.com")),
    (GOOD, [("account", "3,4", "", "a@x.com", "", True)], 9, None, ("failed", "")),
    (GOOD, [(None, "", "", "a@x.com", "", True)], 1, None, ("routable", "a@x.com")),
    (GOOD, [("account", "", "", " a@x.com , b@x.com ", "", True)], 1, None, ("routable", "a@x.com,b@x.com")),
    (GOOD, [("doc_type", "", "起诉状,判决书", "a@x.com", "", True)], 1, None, ("routable", "a@x.com")),
    ([("合同协议", 0.5, False, False), ("起诉状", 0.9, False, False)], [("doc_type", "", "起诉状", "b@x.com", "", True), ("doc_type", "", "合同协议", "a@x.com,b@x.com", "", True)], 1, None, ("routable", "b@x.com,a@x.com")),
    (GOOD, [("doc_type", "", "起诉状", "a@x.com", "", True)], 1, " d@x.com ", ("routable", "d@x.com")),
    (GOOD, [("doc_type", "", "判决书", "a@x.com", "", False)], 1, "  ", ("failed", "")),
    (GOOD, [("doc_type", "2", "判决书", "a@x.com", "", True)], 5, None, ("failed", "")),
    ([(NON_LEGAL, 0.1, False, False)], [("account", "", "", "a@x.com", "", True)], 1, None, ("skipped", "")),
    ([(OTHER, 0.5, True, False), ("合同协议", 0.8, False, False)], [("doc_type", "", OTHER, "o@x.com", "", True), ("doc_type", "", "合同协议", "c@x.com", "", True)], 1, None, ("routable", "c@x.com")),
    ([(OTHER, 0.5, True, False)], [("account", "", "", "a@x.com", "", True)], 1, "d@x.com", ("failed", "")),
    (GOOD, [("account", "x", "", "a@x.com", "", True)], 1, None, ("failed", "")),
])
def test_routes(spark, groups, rows, account, default, expected):
    assert routed(spark, groups, rows, account, default) == expected


def test_assembly(spark):
    r = routing.assemble_mail(analyses(spark, ("a", 0.4, False, True), ("b", 0.7, False, False), ("", 0.7, False, False))).first()
    assert (r.doc_type, r.doc_types, r.pick_type, r.any_failed, r.all_failed) == ("a", "a,b", "b", True, False)
    assert r.interpretation == "【第1组】\nread 0\n\n---\n\n【第2组】\nread 1\n\n---\n\n【第3组】\nread 2"
    assert routing.assemble_mail(analyses(spark, ("a", 0.4, False, True), ("b", 0.9, False, True))).first().pick_type == "a"


def test_rule_tables(spark):
    ok, bad = routing.validate_rules(spark.createDataFrame([(1, "weird", "", "x", "t", "", True), (2, "doc_type", "", " , ", "t", "", True), (3, "doc_type", "", "a,b,a", "t", "", True)], RULE))
    assert [(r.id, r.rule_type, r.doc_type) for r in ok.collect()] == [(1, "account", ""), (3, "doc_type", "a,b")] and [r.id for r in bad.collect()] == [2]
    assert [(r.account_ids, r.n) for r in routing.duplicate_rules(rules(spark)).collect()] == [("3,4, 5", 2)] and len(RULES) == 9
    accounts = spark.createDataFrame([(3, "three"), (4, "four")], "id bigint, name string")
    assert {r.id: r.account_names for r in routing.rule_account_names(rules(spark), accounts).collect()}[2] == "three, four"
    named = spark.createDataFrame([(1, "four,three"), (2, "four,none"), (3, "")], "rule_key bigint, account_names string")
    good, rejects = routing.resolve_rule_accounts(named, accounts)
    assert {r.rule_key: r.account_ids for r in good.collect()} == {1: "4,3", 3: ""} and [r.rule_key for r in rejects.collect()] == [2]


@pytest.mark.parametrize(("status", "delivered", "expected"), [("failed", [("a@x.com", True)], ["b@x.com"]), ("failed", [("a@x.com", True), (" b@x.com", True)], []), ("failed", [], ["a@x.com", "b@x.com"]), ("failed", [("a@x.com", False)], ["a@x.com", "b@x.com"]), ("forwarded", [], [])])
def test_pending(spark, status, delivered, expected):
    log = spark.createDataFrame([(1, status, "a@x.com,b@x.com")], "id bigint, status string, target_email string")
    rows = spark.createDataFrame([(1, t, ok) for t, ok in delivered], "log_id bigint, target_email string, success boolean")
    assert [r.target for r in ledger.pending_targets(log, rows).orderBy("pos").collect()] == expected


def test_outgoing(spark):
    groups = analyses(spark, ("a\r\n", 0.9, True, False), ("b", 0.9, False, False), ("b", 0.1, False, False))
    mails = spark.createDataFrame([(1, "Hi\nthere", "s@x", None, "2020", "x" * 4000), (2, None, "s", None, None, None)], "mail_id bigint, subject string, sender string, recipient string, received string, body_text string")
    assert {r.mail_id: r.subject for r in ledger.compose_subjects(groups, mails).collect()} == {1: "【a   / b】Hi there", 2: "【法律文书】"}
    body = {r.mail_id: r.body for r in ledger.compose_bodies(groups, mails).collect()}[1]
    assert body.startswith("系统收到一封法律文书邮件，共分析 3 份文书。AI 分析结果如下：") and "── 第 2 组：b ──" in body and "📊 分析置信度：90%" in body
    assert "（⚠️类型未识别，请人工复核）" in body and "已截断" in body and "原收件人" not in body and "原发件人：s@x\n原收件日期：2020\n原邮件主题：Hi" in body
    assert "（无正文）" in {r.mail_id: r.body for r in ledger.compose_bodies(groups, mails).collect()}[2]
    out = ledger.build_outbox(spark.createDataFrame([(1, "routable", "p@x,q@x"), (2, "failed", "z")], "mail_id bigint, status string, targets string"), groups, mails, brief=True)
    assert sorted(r.target_email for r in out.collect()) == ["p@x", "q@x"]
    attempts = spark.createDataFrame([(1, " t ", None, True, "2020")], "log_id bigint, target_email string, target_name string, success boolean, created_at string")
    log = spark.createDataFrame([(1, "old", "old,er", "s")], "id bigint, doc_type string, doc_types string, subject string")
    row = ledger.ledger_rows(attempts, groups, log).first()
    assert (row.target_email, row.target_name, row.doc_types) == ("t", "", "a\r\n,b,b")
    assert ledger.ledger_rows(attempts, groups.limit(0), log).first().doc_types == "old,er"
