from __future__ import annotations

import difflib
import gzip
import io
import random
import re
import tarfile
import time
import zipfile
from collections import Counter
from email.header import Header
from email.message import EmailMessage

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.operators import ledger, maintenance, modelio, reports, revision
from quillmill.plans import intake
from quillmill.plans.views import view
from quillmill.sources import archives, mail, ranks, tables
from quillmill.streaming import polls


def raw(spark, *contents):
    return spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(contents)], "path string, content binary")


def test_parse(spark):
    m = EmailMessage()
    m["Message-ID"], m["Subject"], m["From"], m["To"], m["Cc"], m["Date"] = "<1@x>", "Hé", "A <a@x>", "b@x", "c@x", "Mon, 01 Jan 2024 10:00:00 +0800"
    m.set_content("plain text")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"data", maintype="application", subtype="pdf", filename="f.pdf")
    html = EmailMessage()
    html["Delivered-To"], html["X-Forwarded-By"] = "d@x", Header("标记", "utf-8").encode()
    html.add_alternative("<style>x</style><!-- no --><b>seen</b>", subtype="html")
    rows = {r.path: r for r in mail.parse_mail(raw(spark, m.as_bytes(), html.as_bytes(), b"no headers"), "2024-02-02 00:00:00").collect()}
    a, b = rows["p0"], rows["p1"]
    assert (a.message_id, a.subject, a.recipient, str(a.received_at), a.body_text.strip()) == ("<1@x>", "Hé", "b@x, c@x", "2024-01-01 02:00:00", "plain text")
    assert [(x.filename, bytes(x.content)) for x in a.attachments] == [("f.pdf", b"data")]
    assert b.message_id.startswith("synth-") and b.recipient == "d@x" and "seen" in b.body_text and "no" not in b.body_text and str(b.received_at) == "2024-02-02 00:00:00"
    parsed = mail.parse_mail(raw(spark, m.as_bytes(), html.as_bytes()), "2024-02-02 00:00:00")
    assert [r.path for r in mail.drop_forwarded_copies(parsed, ["标记"]).collect()] == ["p0"]
    assert [r.path for r in mail.within_lookback(parsed, "2024-02-03").collect()] == ["p1"]
    assert mail.explode_attachments(parsed).count() == 1


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def nested(depth):
    data = zipped({"leaf.txt": b"x"})
    for n in range(depth - 1):
        data = zipped({f"n{n}.zip": data})
    return data


@pytest.mark.parametrize(("name", "data", "options", "expected"), [
    ("a.zip", zipped({"x.txt": b"1", "d/y.txt": b"2"}), {}, ["x.txt", "y.txt"]),
    ("a.zip", zipped({"../evil.txt": b"1", "ok.txt": b"2"}), {}, ["ok.txt"]),
    ("a.zip", nested(2), {}, ["leaf.txt"]),
    ("a.zip", nested(5), {}, ["n1.zip"]),
    ("a.zip", zipped({f"f{i}": b"x" for i in range(150)}), {"max_files": 50}, [f"f{i}" for i in range(50)]),
    ("a.zip", zipped({"big": b"0" * 1_000_000, "small": b"1"}), {"max_file": 1024}, ["small"]),
    ("a.zip", b"PK\x03\x04broken", {}, ["a.zip"]),
    ("a.tar.gz", tarred({"t.txt": b"1"}), {}, ["t.txt"]),
    ("a.gz", gzip.compress(b"text"), {}, ["a"]),
    ("blob", gzip.compress(b"text"), {}, ["blob.out"]),
    ("a.gz", gzip.compress(b"0" * 5_000_000), {"max_file": 1000}, ["a.gz"]),
    ("a.docx", zipped({"word/document.xml": b"<x/>"}), {}, ["a.docx"]),
])
def test_archives(spark, name, data, options, expected):
    df = spark.createDataFrame([(1, 0, name, data), (1, 1, "b.pdf", b"p"), (2, 0, "c.txt", b"q")], "mail_id bigint, att_idx int, filename string, content binary")
    rows = archives.expand_archives(df, **options).orderBy("mail_id", "att_idx", "member").collect()
    assert [r.filename for r in rows if (r.mail_id, r.att_idx) == (1, 0)] == expected and len(rows) == len(expected) + 2
    stats = {r.mail_id: r for r in archives.archive_stats(archives.expand_archives(df, **options)).collect()}
    assert not stats[2].expanded


def test_texts_and_paths(spark):
    docx = zipped({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:body></w:document>'.encode()})
    df = spark.createDataFrame([(1, 0, "a.txt", "  é\n".encode() + b"\xff"), (1, 1, "a.docx", docx), (1, 2, "a.xls", b"x"), (1, 3, "a.txt", None)], "mail_id bigint, att_idx int, filename string, content binary")
    texts = {r.att_idx: r.text for r in mail.extract_text(df).collect()}
    assert texts[0] == "é\n�" and texts[1] == "one\ntwo" and texts[2] == ""
    paths = mail.storage_path(df.select("mail_id", "att_idx", "filename", F.lit("a/b").alias("account"), F.lit(None).cast("timestamp_ntz").alias("received_at"))).orderBy("att_idx").collect()
    assert [r.path for r in paths] == ["attachments/a_b/unknown/a.txt", "attachments/a_b/unknown/a.docx", "attachments/a_b/unknown/a.xls", "attachments/a_b/unknown/a_1.txt"]


@pytest.mark.parametrize(("text", "expected"), [
    ('{"doc_type": "a", "confidence": 2}', ("a", 1.0)), ("{'doc_type': 'a', 'x': None, 'confidence': '0.2'}", ("a", 0.2)), ('{{"doc_type": "a"}}', ("a", 0.5)), ('see {{"doc_type": "a"}} ok', ("a", 0.5)), ('{"doc_type": "a",}', ("a", 0.5)),
    ('text {"doc_type": "a"} more', ("a", 0.5)), ('{"doc_type": "a", "case_summary": "l1\nl2"}', ("a", 0.5)), ('{"doc_type": "a', None), ("[1]", None), ("", None), (None, None),
])
def test_replies(spark, text, expected):
    df = modelio.parse_replies(spark.createDataFrame([(1, text)], "mail_id bigint, content string"))
    r = df.select("parsed", modelio.validate_analysis(F.col("analysis")).alias("a")).first()
    assert (None if not r.parsed else (r.a.doc_type, r.a.confidence)) == expected


def test_groups_prompts_and_stages(spark):
    rows = [(1, 3, [[0, 1], [2]], True), (2, 3, [[0], [1]], True), (3, 2, [[0], [5]], True), (4, 1, None, True), (5, 3, [[0], [1], [2]], False)]
    got = {r.mail_id: r.groups for r in modelio.validate_groups(spark.createDataFrame(rows, "mail_id int, n int, groups array<array<int>>, grouping boolean")).collect()}
    assert got == {1: [[0, 1], [2]], 2: [[0], [1], [2]], 3: [[0], [1]], 4: [[0]], 5: [[0, 1, 2]]}
    filled = spark.range(1).select(modelio.fill_template("{a} {b} {c}", {"a": F.lit("{b}"), "b": F.lit("x")}).alias("v")).first().v
    assert filled == "{b} x {c}"
    values = {"file_list": F.lit("0. a"), "hint": F.lit("more"), "none": F.lit("")}
    filled = spark.range(1).select(modelio.fill_template("ask {x}", values, {"file_list": "附件列表：", "hint": "", "none": "?"}).alias("v")).first().v
    assert filled == "ask {x}\n\n附件列表：\n0. a\n\nmore"
    assert spark.range(1).select(modelio.fill_template("{file_list}!", values, {"file_list": "附件列表："}).alias("v")).first().v == "0. a!"
    legal, done = modelio.split_non_legal(spark.createDataFrame([(1, "非法律文书", 0.4, False), (2, "非法律文书", 0.5, True), (3, "t", 0.9, False)], "mail_id int, doc_type string, confidence double, classify_failed boolean"))
    r = done.first()
    assert sorted(x.mail_id for x in legal.collect()) == [2, 3] and (r.urgency, r.confidence, r.key_date, r.agency_name, r.case_summary) == ("low", 0.4, None, "", "非法律文书，无需法律分析")
    first = spark.createDataFrame([(1, 0, "t", 0.9, False)], "mail_id int, group_idx int, doc_type string, confidence double, classify_failed boolean")
    second = spark.createDataFrame([(1, 0, "u", 0.1, "s")], "mail_id int, group_idx int, doc_type string, confidence double, case_summary string")
    merged = modelio.merge_stages(first, second).first()
    assert (merged.doc_type, merged.confidence, merged.disagrees) == ("t", 0.9, True)
    dim = spark.createDataFrame([("t", ["修订"])], "doc_type string, caps array<string>")
    known = modelio.validate_classes(first.withColumn("parsed", F.lit(True)), dim).first()
    assert (known.doc_type, known.classify_failed) == ("t", False)
    gated = modelio.gate_capabilities(merged and modelio.merge_stages(first, second).withColumns({"llm_failed": F.lit(None).cast("boolean"), "revised_document": F.lit("x")}), dim).first()
    assert gated.do_revision and not gated.do_review
    logs = spark.createDataFrame([(1, '[{"doc_type":"a"},{"doc_type":"b"}]'), (2, '{"doc_type":"c"}'), (3, "text")], "id int, llm_raw_response string")
    assert [(r.id, r.group_idx, r.analysis.doc_type) for r in modelio.unpack_analyses(logs).orderBy("id", "group_idx").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    links = modelio.citation_links(spark.createDataFrame([(1, 0, "http://b x http://a"), (1, 1, "http://a http://c")], "mail_id int, seq int, text string")).first()
    assert links.links == ["http://b", "http://a", "http://c"]


def plain_prompt(template, attachments, window, ratio, output):
    def tokens(text):
        chinese = sum("\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf" for c in text)
        return max(int(chinese / 0.85 + (len(text) - chinese) / 4), len(text) // 10)

    def whole(a):
        return template + (f"\n\n## 附件内容\n{a}" if a else "")

    most = max(1024, int(window * ratio) - output)
    if not attachments or tokens(whole(attachments)) <= most:
        return template, attachments
    parts = ["=== " + x.strip() for x in attachments.split("=== ") if x.strip()]
    for n in range(len(parts) - 1, -1, -1):
        if tokens(whole("\n\n".join(parts[:n]))) <= most:
            return template, "\n\n".join(parts[:n])
    a, b = template.find("## Input"), template.find("## Output")
    if not 0 <= a < b:
        return template[: most * 2], ""
    region = template[a:b]
    while len(region) > 100 and tokens(template[:a] + region + template[b:]) > most:
        region = region[: len(region) - max(1, int(len(region) * 0.15))]
    if tokens(template[:a] + region + template[b:]) > most:
        region = "## Input\n(body truncated due to length)\n## Output\n"
    return template[:a] + region + template[b:], ""


def test_prompts_within_a_budget(spark):
    lists = ["", "条款。" * 5000, "=== 附件: a ===\n" + "x" * 900 + "\n\n=== 附件: b ===\n" + "条" * 400 + "\n\n=== 附件: c ===\nlast"]
    templates = ["head\n## Input\n正文。\n## Output\njson", "head\n## Input\n" + "正文。" * 3000 + "\n## Output\njson", "no region " * 2000, "## Output first ## Input " + "正" * 3000, "标" * 4000 + "## Input\nx\n## Output\n"]
    rows = [(n, t, a, w, r, o) for n, (t, a, (w, r, o)) in enumerate((t, a, s) for t in templates for a in lists for s in ((8192, 0.5, 100), (0, 0.5, 0), (131072, 0.5, 2000), (5000, 0.5, 1000)))]
    rows += [(len(rows), None, None, 0, 0.5, 0)]
    got = {r.id: (r.template, r.attachments) for r in modelio.truncate_prompt(spark.createDataFrame(rows, "id int, template string, attachments string, window int, ratio double, output int")).collect()}
    for n, t, a, w, r, o in rows:
        assert got[n] == plain_prompt(t or "", a or "", w, r, o), (n, t[:30], a[:30], w)


def test_prompts_are_cut_in_one_pass(spark):
    rows = [(1, "## Input\nx\n## Output\n", "=== a ===\n" + "条" * 3000 + "\n\n=== b ===\nlast", 4000, 0.5, 600, "own"), (2, "t " * 9000, "=== a", 4000, 0.5, 600, None), (3, "t", "", 0, 0.5, 0, "")]
    cut = modelio.truncate_prompt(spark.createDataFrame(rows, "id int, template string, attachments string, window int, ratio double, output int, mark string"))
    assert {r.id: (r.template, r.attachments, r.mark) for r in cut.collect()} == {x[0]: (*plain_prompt(*x[1:6]), x[6]) for x in rows}
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Union" not in plan


def test_capabilities(spark, tmp_path):
    for name, text in (("合同", "---\ncaps: 修订 #审查\n---\nbody"), ("起诉状", "no header"), ("非法律文书", "x")):
        (tmp_path / f"{name}.md").write_text(text)
    assert [(r.doc_type, r.caps, r.ord) for r in modelio.capability_dim(spark, str(tmp_path)).orderBy("ord").collect()] == [("合同", ["修订", "审查"], 0), ("起诉状", [], 1), ("其他法律文书", [], 2), ("非法律文书", [], 3)]


def test_page_text(spark):
    pages = ["<p>a &amp; b</p><!-- c -->d", "<script>if (a<b && c) x('</p>&amp;')</script>t", "<a title='x > y'>l</a>", "&#65;&#x1F642;&copy;&nope;&#0; &lt;b&gt;", "a < b", "", None, " \n <br/> \u3000", "<P>one\ntwo</P><style>p{}</style>", "&nbsp;x&nbsp;"]
    assert cells(spark, mail.html_to_text(F.col("t")), pages) == ["a & b\nd", "if (a<b && c) x('</p>&amp;')\nt", "l", "A🙂©&nope;&#0; <b>", "a < b", "", "", "", "one\ntwo\np{}", "x"]


def cells(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", column.alias("v")).orderBy("n").collect()
    return [r.v for r in rows]


def test_marks(spark):
    texts = ["a【新增】b【/新增】c", "x【删除】y", "【新增】a【/新增】【新增】b【/新增】", "【新增】a【/删除】b", "【待确认】", "", None, "【修改】a【新增】b【/新增】c【/修改】d", " 【新增】 【/新增】z"]
    found = [[tuple(p) for p in x] for x in cells(spark, revision.parse_markers(F.col("t")), texts)]
    assert found == [
        [("normal", "a"), ("add", "b"), ("normal", "c")], [("normal", "x"), ("delete", "y")], [("add", "ab")], [("add", "ab")], [("normal", "【待确认】")],
        [("normal", "")], [("normal", "")], [("modify", "a"), ("add", "b"), ("modify", "c"), ("normal", "d")], [("normal", "z")],
    ]
    kept = [[tuple(p) for p in x] for x in cells(spark, revision.parse_markers(F.col("t"), keep_blank=True), ["", " 【新增】 【/新增】z"])]
    assert kept == [[], [("normal", " "), ("add", " "), ("normal", "z")]]


@pytest.mark.parametrize(("yes", "no"), [
    ("第三十条 " + "甲" * 20, "第三方 " + "甲" * 20), ("十二、" + "甲" * 20, "十二 " + "甲" * 20), ("（ 12 ）" + "甲" * 20, "（甲）12" + "甲" * 20),
    ("3 . " + "甲" * 20, "3 甲" + "甲" * 20), ("工程名称：" + "甲" * 20, "一二三四五六七八九十一二三：" + "甲" * 9), ("天津市", "天津市，甲"), ("第一条 甲", "第一条 甲，"), ("甲" * 20, "甲" * 21),
])
def test_lines_that_stand_alone(spark, yes, no):
    assert cells(spark, revision.standalone(F.col("t")), [yes, no, ""]) == [True, False, False]


def plain_marks(text):
    """Pieces by a stack, for all texts."""
    kinds, out, stack, at = {"新增": "add", "修改": "modify", "删除": "delete"}, [], [], 0
    for m in [*re.finditer("【(/?)(新增|修改|删除)】", text), None]:
        said = text[at : m.start() if m else len(text)]
        kind = stack[-1] if stack else "normal"
        if said and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + said)
        elif said:
            out.append((kind, said))
        if m and not m.group(1):
            stack.append(kinds[m.group(2)])
        elif m and stack and stack[-1] == kinds[m.group(2)]:
            stack.pop()
        at = m.end() if m else at
    return out


def test_marks_against_a_stack(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["【新增】", "【/新增】", "【修改】", "【/修改】", "【删除】", "【/删除】", "甲", "乙\n", " "]) for _ in range(rng.randrange(40))) for _ in range(150)]
    for chunk in (1, 7, 256):
        monkeypatch.setattr(revision, "CHUNK", chunk)
        assert [[tuple(p) for p in x] for x in cells(spark, revision.parse_markers(F.col("t"), keep_blank=True), texts)] == [plain_marks(t) for t in texts]


def test_long_texts_take_linear_time(spark):
    line = "甲方应当在合理的期限之内向乙方支付全部价款并且承担【修改】相应【/修改】费用。\n"
    began, took = time.time(), []
    for n in (50_000, 100_000):
        df = spark.createDataFrame([(1, line * n + "【新增】\n标题【/新增】")], "id int, t string")
        rows = revision.marked_paragraphs(df, "id", "t").select("seq", "kind", F.length("text").alias("n")).collect()
        assert [tuple(r) for r in rows] == [(0, "modify", (len(line) - 9) * n - 1), (1, "add", 2)]
        took.append(time.time() - began)
        began = time.time()
    assert took[1] < 60


def test_paragraphs(spark):
    long = "甲方应当在合理的期限之内向乙方支付全部价款并且承担费用"
    texts = [
        "第一条 甲方应当。\n第二条 乙方应当。", f"{long}，\n第二条 承担费用。", f"{long}。\n{long}。", f"{long}。\n\n\n{long}。", f"{long}。\r\n标题\r{long}。", "", " \n ", None,
    ]
    assert cells(spark, revision.split_paragraphs(F.col("t")), texts) == [
        ["第一条 甲方应当。", "第二条 乙方应当。"], [f"{long}，\n第二条 承担费用。"], [f"{long}。\n{long}。"], [f"{long}。", f"{long}。"], [f"{long}。", "标题", f"{long}。"], [], [], [],
    ]
    found = cells(spark, revision.revised_paragraphs(F.col("t")), ["工程名称：专项【修改】维修工程【/修改】\n\n【删除】去掉【/删除】【新增】加上【/新增】"])[0]
    assert [tuple(p) for p in found] == [("modify", "工程名称：专项维修工程", "工程名称：专项维修工程"), ("delete", "去掉加上", "加上")]
    rows = revision.marked_paragraphs(spark.createDataFrame([(1, "标题\n【新增】加上【/新增】"), (2, None)], "id int, t string"), "id", "t")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "normal", "标题"), (1, 1, "add", "加上")]


def test_revision(spark):
    assert revision.inline_diff("abcdef", "abXYef") == [("equal", "ab"), ("del", "cd"), ("ins", "XY"), ("equal", "ef")]
    assert revision.inline_diff("a", "a") is None and revision.inline_diff("", "a") is None and revision.inline_diff("abc", "xyz") is None
    pairs = [(1, ["第一条 期限为30日内支付。", "第二条 不变的条款内容。"], "第一条 期限为【修改】60【/修改】日内支付。\n\n第二条 不变的条款内容。\n\n【新增】第三条 新加的。【/新增】")]
    rows = revision.diff_pairs(spark.createDataFrame(pairs, "pair_id int, original array<string>, revised string")).orderBy("seq").collect()
    assert [r.op for r in rows if r.piece_kind != "equal"] == ["edit", "edit", "insert"] and rows[-2].op == "equal"
    assert "".join(r.text for r in rows if r.old_idx == 0 and r.piece_kind in ("equal", "del")) == "第一条 期限为30日内支付。"


def test_differences_lead_from_one_text_to_the_other(spark):
    """Equal and deleted pieces are the original, equal and inserted ones the revision, for all turns of the registered query."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    key = F.concat_ws("-", "conv_id", "turn")
    pairs = turns.select(key.alias("pair_id"), F.split("text", r"(?<=\.) ").alias("original"), F.regexp_replace(F.regexp_replace("text", r"(?<=\.) ", "\n"), r"\b(the|de|la|der)\b", "【修改】x【/修改】").alias("revised"))
    rows = {}
    for r in revision.diff_pairs(pairs).orderBy("pair_id", "seq").collect():
        rows.setdefault(r.pair_id, []).append(r)
    guard = {r.pair_id: r for r in revision.revision_guard(revision.diff_pairs(pairs)).collect()}
    seen = Counter()
    for p in pairs.collect():
        own = rows[p.pair_id]
        old, new = ("".join("".join(r.text for r in own if r.piece_kind in kinds).split()) for kinds in (("equal", "del"), ("equal", "ins")))
        assert old == "".join("".join(p.original).split()) and new == "".join(p.revised.replace("【修改】", "").replace("【/修改】", "").split())
        deleted, kept = (sum(len(r.text) for r in own if r.piece_kind == k) for k in ("del", "equal"))
        assert (guard[p.pair_id].deleted, guard[p.pair_id].rejected) == (deleted, deleted >= 800 and deleted / (deleted + kept) > 0.6)
        seen.update(r.op for r in own)
    assert seen["equal"] and seen["edit"]


def test_guard_and_base(spark):
    pairs = spark.createDataFrame([(1, ["很长的" * 400, "短"], "短"), (2, ["同"], "同")], "pair_id bigint, original array<string>, revised string")
    assert {r.pair_id: r.rejected for r in revision.revision_guard(revision.diff_pairs(pairs)).collect()} == {1: True, 2: False}
    att = spark.createDataFrame([(1, 0, "a.DOC"), (1, 1, "b.docx"), (1, 2, "c.pdf")], "mail_id int, att_idx int, filename string")
    members = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2)], "mail_id int, group_idx int, att_idx int")
    assert [tuple(r) for r in revision.base_document(att, members).collect()] == [(1, 0, 1)]


def test_target_summary(spark):
    rows = [(1, "a@x.com", "", "合同协议,政府信息公开", "合同协议", True, "2024-01-02 09:00:00"), (2, " a@x.com", "A", "起诉状", "起诉状", True, "2024-01-02 10:00:00"), (3, "a@x.com", "B", "", "证据材料", True, "2024-01-02 11:00:00"), (4, "b@x.com", "", "合同协议,合同协议", "", True, "2024-01-02 12:00:00"), (5, "b@x.com", "", "合同协议", "", False, "2024-01-02 13:00:00"), (6, "a@x.com", "", "合同协议", "", True, "2024-01-01 23:00:00")]
    df = spark.createDataFrame(rows, "id int, target_email string, target_name string, doc_types string, doc_type string, success boolean, at string").withColumns({"created_at": F.col("at").cast("timestamp_ntz"), "subject": F.lit(None).cast("string")})
    since = "2024-01-02"
    totals, types = reports.target_totals(df, since), reports.target_types(df, since)
    assert {(r.target, r.total, r.failed, r.name) for r in totals.collect()} == {("a@x.com", 3, 0, "A"), ("b@x.com", 1, 1, "")}
    assert {(r.target, r.type, r.n) for r in types.collect()} == {("a@x.com", t, 1) for t in ("合同协议", "政府信息公开", "起诉状", "证据材料")} | {("b@x.com", "合同协议", 1)}
    text = {r.target: r.text for r in reports.render_summary(totals, types, since, attachment="表").collect()}
    assert "转发失败：1 封" in text["b@x.com"] and "转发失败" not in text["a@x.com"] and text["a@x.com"].startswith("A 您好，")
    assert "📁 涉及类型：合同协议、政府信息公开、证据材料、起诉状" in text["a@x.com"].split("\n") and "附件《表》中" in text["a@x.com"]
    text = {r.target: r.text.split("\n") for r in reports.render_summary(totals, types, since, brief=False, subjects=reports.subject_lists(df, since), system="系统", now="18:00").collect()}
    assert text["a@x.com"][2] == f"以下是 系统 统计的、{since} 当天转发给 a@x.com 的文书汇总（18:00）："
    assert "  合同协议        1 封  ( 33.3%)" in text["a@x.com"] and "  政府信息公开    1 封  ( 33.3%)" in text["a@x.com"]
    assert "  说明：一封邮件含多份不同类型文书时会按类型分别计数，" in text["a@x.com"] and not any("说明" in x for x in text["b@x.com"])
    assert sum(x.startswith("  · [") for x in text["a@x.com"]) == 3 and text["a@x.com"][-1].startswith("如需调整")
    assert reports.subject_lists(df, since).filter("target = 'a@x.com'").orderBy("seq").first().subject == reports.NO_SUBJECT
    assert reports.target_totals(df, "2025-01-01").collect() == []


def test_images_and_endpoints(spark):
    row = [("h", 1, "u", "p", 1), ("h", 1, "u", "p", 2), None, ("h", 1, None, "p", 3), ("h", 1, None, "p", 4)]
    df = spark.createDataFrame([(row, list("abcdefg"))], "e array<struct<host: string, port: int, username: string, password_encrypted: string, n: int>>, i array<string>")
    got = df.select(ledger.distinct_endpoints(F.col("e")).alias("e"), mail.first_images(F.col("i")).alias("i")).first()
    assert [x.n for x in got.e] == [1, 3] and got.i == list("abcde")


def test_rejects(spark):
    raw = spark.createDataFrame([("good", b"Subject: s\nX-Forwarded-By: one\nX-Forwarded-By: two\nList-Id: l\nReply-To: r\n\nbody"), ("bad", None)], "path string, content binary")
    parsed = mail.parse_or_reject(raw, "2024-01-01 00:00:00")
    assert [(r.path, r.error is not None) for r in mail.rejects(parsed).collect()] == [("bad", True)]
    good = mail.parse_mail(raw, "2024-01-01 00:00:00").collect()
    assert [(r.path, r.headers) for r in good] == [("good", {"x-forwarded-by": "one", "list-id": "l"})]


def test_maintenance_and_exports(spark, tmp_path):
    log = spark.createDataFrame([(1, "pending", "2024-01-01"), (2, "failed", "2024-05-01")], "id bigint, status string, at string").select("id", "status", F.col("at").cast("timestamp_ntz").alias("created_at"))
    child = spark.createDataFrame([(10, 1, "f1"), (20, 2, "")], "id bigint, log_id bigint, file_path string")
    as_of = "2024-05-02 00:00:00"
    assert [[r.id for r in maintenance.expired(log, as_of, n).collect()] for n in (None, -5, 0, 1000)] == [[1], [1], [], []]
    kept = maintenance.delete_mails(log, child, child, maintenance.stuck(log, as_of))
    assert [t.count() for t in kept] == [1, 1, 1] and [r.file_path for r in maintenance.files_to_remove(child, maintenance.expired(log, as_of, None)).collect()] == ["f1"]
    now, snap = (spark.createDataFrame(x, "k string, v string, w int") for x in ([("a", "1", 1), ("b", "2", 2)], [("b", "***", 9), ("c", "3", 3)]))
    assert sorted(map(tuple, maintenance.upsert(now, snap, ["k"], skip="***").collect())) == [("a", "1", 1), ("b", "2", 9), ("c", "3", 3)]
    old = maintenance.upgrade_rules(spark.createDataFrame([(1, None, 7), (2, "", None)], "id int, rule_type string, account_id int"))
    assert [(r.rule_type, r.account_ids, r.enabled) for r in old.collect()] == [("account", "7", True), ("account", "", True)]
    for table, added in maintenance.ADDED_COLUMNS.items():
        up = maintenance.upgrade_schema(spark.range(1).withColumn("rule_type", F.lit("")), table)
        assert {n for n, _, _ in added} <= set(up.columns) and maintenance.upgrade_schema(up, table).columns == up.columns


def test_streams_equal_batches(spark, tmp_path):
    events = [("k", f"2024-01-01 00:{m:02d}:00", False) for m in range(7)] + [("k", "2024-01-01 00:30:00", False), ("j", "2024-01-01 00:00:00", False), ("j", "2024-01-01 00:01:00", True)]
    df = spark.createDataFrame(events, "key string, at string, ok boolean").select("key", F.col("at").cast("timestamp").alias("ts"), "ok")
    batch = sorted(map(tuple, polls.throttle(df).collect()))
    assert [b for k, _, b, _ in batch if k == "k"] == [False] * 5 + [True] * 2 + [False]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", polls.STATE_STORE)
    try:
        q = polls.throttle_stream(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.table("throttled").collect())) == batch
    mails = spark.createDataFrame([("m1", "2024-01-01 00:00:00"), ("m1", "2024-01-01 01:00:00"), ("m2", "2024-01-02 00:00:00")], "message_id string, at string").select("message_id", F.col("at").cast("timestamp").alias("received_at"))
    mails.write.parquet(str(tmp_path / "mails"))
    got = []
    q = polls.run_polls(polls.exactly_once(spark.readStream.schema(mails.schema).parquet(str(tmp_path / "mails"))), lambda b, _: got.extend(b.collect()), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert sorted(r.message_id for r in got) == ["m1", "m2"]


def test_poll_reads_message_files(spark, tmp_path):
    for n in (1, 2):
        m = EmailMessage()
        m["Message-ID"], m["Subject"] = "<same@x>", f"s{n}"
        m.set_content("body")
        (tmp_path / f"{n}.eml").write_bytes(m.as_bytes())
    got = []
    stream = polls.exactly_once(polls.poll(spark, str(tmp_path), "2024-01-01 00:00:00"))
    polls.run_polls(stream, lambda b, _: got.extend(b.select("message_id", "body_text").collect()), str(tmp_path / "check")).awaitTermination(120)
    assert [r.message_id for r in got] == ["<same@x>"]
    assert mail.read_raw_mail(spark, f"{tmp_path}/*.eml").count() == 2


def test_long_revisions_are_compared(spark):
    paragraphs = [f"{i}. paragraph {i * 7919 % 10007} of a long turn, with words enough to be one." for i in range(7000)]
    whole = " ".join(f"{i:x}" for i in range(95_000))
    pairs = [
        (1, paragraphs, "\n\n".join(paragraphs[:1000])),
        (2, paragraphs, "\n\n".join(p.replace("7 of", "seven of") for p in paragraphs)),
        (3, [whole], whole[:200_000] + whole[200_300:]),
    ]
    assert all(sum(map(len, old)) + len(new) > 400_000 for _, old, new in pairs)
    rows = revision.diff_pairs(spark.createDataFrame(pairs, "pair_id int, original array<string>, revised string")).collect()
    assert {r.op for r in rows if r.pair_id == 1} == {"equal", "delete"} and {r.op for r in rows if r.pair_id == 2} == {"equal", "edit"}
    guard = {r.pair_id: r for r in revision.revision_guard(spark.createDataFrame(rows, "pair_id int, seq int, op string, old_idx int, new_idx int, piece_kind string, text string")).collect()}
    assert guard[1].deleted == sum(map(len, paragraphs[1000:])) and guard[1].rejected
    assert guard[2].deleted == sum("7 of" in p for p in paragraphs) and not guard[2].rejected
    assert guard[3].deleted == 300 and not guard[3].rejected


def test_opcodes_are_those_of_difflib():
    rng = random.Random(5)
    for _ in range(60):
        letters = rng.choice(["a", "ab", "abcdefgh "])
        old = "".join(rng.choice(letters) for _ in range(rng.choice([50, 200, 500])))
        new = old
        for _ in range(rng.choice([0, 2, 40])):
            p = rng.randrange(len(new) + 1)
            new = new[:p] + rng.choice(["", "x", "ab" * 3]) + new[p + rng.choice([0, 1, 9]) :]
        for a, b in ((old, new), (list(old), list(new)), (old, new[::-1])):
            assert revision.opcodes(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_throttle_streams_a_hot_key(spark):
    rng = random.Random(3)
    events = [(rng.choice(["hot", "hot", "a", "b", None]), pd.Timestamp(rng.randrange(40_000), unit="s").to_pydatetime(), rng.random() < 0.1) for _ in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = polls.throttle(spark.createDataFrame(events, "key string, ts timestamp, ok boolean"))
        assert "InPandas" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroupsInPandas" not in plan
        rows = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, failures = [], {}
    for key, ts, ok in sorted(events, key=lambda e: (e[1], e[2])):
        failures[key], blocked, wait = polls.fold(failures.get(key, []), pd.Timestamp(ts).timestamp(), ok, 900, 5)
        expected.append((key, ts, blocked, wait))
    assert rows == sorted(expected, key=str) and any(r[2] for r in rows)


def test_bad_messages_end_no_job(spark):
    late = b"Message-ID: <1>\nDate: Fri, 31 Dec 9999 23:59:59 -2300\n\nx"
    word = b"Message-ID: <2>\nSubject: =?utf-8?B?4?=\nFrom: =?no-such?Q?a=ff?=\n\n  body \n"
    page = b"Message-ID: <3>\nContent-Type: multipart/mixed; boundary=c\n\n--c\nContent-Type: text/html; charset=\\0bad\n\n<p>a</p><![foo[ x\n--c--"
    parsed = {r.path: r for r in mail.parse_or_reject(raw(spark, late, word, page, None, b"", b"x" * 200), "2024-01-01 00:00:00", largest=150).collect()}
    assert [str(parsed[f"p{i}"].received_at) for i in (0, 1)] == ["2024-01-01 00:00:00"] * 2
    assert (parsed["p1"].subject, parsed["p1"].sender, parsed["p1"].body_text) == ("=?utf-8?B?4?=", "a\ufffd", "body")
    assert parsed["p2"].body_text == "a\n<![foo[ x"
    assert {k: r.error for k, r in parsed.items() if r.error} == {"p3": "no content", "p5": "over 150 bytes: 200"} and parsed["p4"].message_id.startswith("synth-")


def test_bad_files_end_no_job(spark):
    broken = bytearray(zipped({"a.txt": b"some text, long enough to be packed " * 20, "word/document.xml": b"<x/>" * 50}))
    broken[45:60] = b"\xff" * 15
    gz = bytearray(gzip.compress(b"text " * 100))
    gz[12:30] = b"\xff" * 18
    df = spark.createDataFrame([(1, 0, "a.zip", bytes(broken)), (1, 1, "b.gz", bytes(gz)), (1, 2, None, None)], "mail_id int, att_idx int, filename string, content binary")
    rows = archives.expand_archives(df).collect()
    assert sorted(r.filename or "" for r in rows if not r.expanded) == ["", "a.zip", "b.gz"] or {r.filename for r in rows} >= {"b.gz"}
    assert any(r.errors for r in rows)
    assert mail.docx_text(bytes(broken)) == mail.docx_text(None) == mail.readable_runs(None) == ""
    ole = mail.OLE + "第一条 甲方\0\0ok\0合同文本".encode("utf-16-le")
    assert mail.readable_runs(ole).split("\n")[-2:] == ["第一条 甲方", "合同文本"] and mail.readable_runs("ab\x00合同文本\x01xyz\x02long run".encode()) == "合同文本\nlong run"


def test_long_tags(spark):
    n = 1_000_000
    pages = ["<p " + "x" * n + ">text</p>", "<p '" + "y" * n + "'>a</p>", "<p \"" + "y" * n, "<!--" + "z" * n + "-->b", "<script " + "q" * n + ">c</script>"]
    assert cells(spark, F.right(mail.html_to_text(F.col("t")), F.lit(4)), pages) == ["text", "a", "yyyy", "b", "c"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    parsed = mail.parse_or_reject(raw(spark, b"Message-ID: <1>\n\na", None, b"Message-ID: <2>\n\nb", b"Message-ID: <1>\n\nc"), "2024-01-01 00:00:00")
    folder = str(tmp_path / "t")
    sink = polls.into_tables(folder)
    for n in (0, 1, 1):
        sink(parsed, n)
    assert polls.polled_mails(spark, folder).count() == 6 and sorted(map(tuple, polls.polled_rejects(spark, folder).collect())) == [("p1", "no content", 0), ("p1", "no content", 1)]
    log = spark.createDataFrame([("<2>",)], "message_id string")
    assert [(r.path, r.batch) for r in polls.new_polled(polls.polled_mails(spark, folder), log).collect()] == [("p0", 0)]


def test_messages_in_parts_are_parsed_once(spark, monkeypatch):
    found = intake.mail_attachments(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert found.count() == 2 * view(spark, "/root/testdata/sf0.001", "parts").count()
    messages = raw(spark, *[f"Message-ID: <{i}>\n\n{'b' * 50}".encode() for i in range(40)]).coalesce(1)
    monkeypatch.setattr(mail, "MOST_AT_ONCE", 7)
    for most in (2_000_000, 100):  # by number, then by bytes
        monkeypatch.setattr(mail, "AT_ONCE", most)
        assert sorted(r.message_id for r in mail.parse_mail(messages, "2024-01-01 00:00:00").collect()) == sorted(f"<{i}>" for i in range(40))


def test_many_small_files_are_few_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("mail_id=%d", F.col("id") % 280).alias("place"), F.encode(F.format_string("Message-ID: <%d>\n\nb", "id"), "UTF-8").alias("content"))
    assert mail.land_messages(rows.repartition(3, "place"), f"file://{tmp_path}/in").agg(F.sum("n")).first()[0] == 300
    tasks, before = [], {k: spark.conf.get(k) for k in polls.MANY_SMALL}

    def sink(batch, number):
        tasks.append(batch.rdd.getNumPartitions())
        polls.into_tables(str(tmp_path / "t"))(batch, number)

    with polls.many_small_files(spark):
        polls.run_polls(polls.poll_all(spark, str(tmp_path / "in"), "2024-01-01 00:00:00", glob="*.txt", below=True), sink, str(tmp_path / "s")).awaitTermination()
    assert len(tasks) == 1 and tasks[0] <= 5  # more than twice as many by Spark's own cost of a file
    assert before == {k: spark.conf.get(k) for k in polls.MANY_SMALL}
    got = polls.polled_mails(spark, str(tmp_path / "t")).collect()
    assert sorted(r.message_id for r in got) == sorted(f"<{i}>" for i in range(300)) and all("/mail_id=" in r.path for r in got)


def test_a_driver_lists_notes_not_messages(spark, tmp_path, monkeypatch):
    said = "Message-ID: <%d>\n\nb"
    rows = spark.range(300).select(F.format_string("mail_id=%d", F.col("id") % 280).alias("place"), F.when(F.col("id") != 7, F.encode(F.format_string(said, "id"), "UTF-8")).alias("content"))
    big = rows.limit(1).select(F.lit("big/one").alias("place"), F.encode(F.repeat(F.lit("x"), 900), "UTF-8").alias("content"))
    folder, notes, of = f"file://{tmp_path}/in", str(tmp_path / "notes"), "2024-01-01 00:00:00"
    monkeypatch.setattr(mail, "MOST_AT_ONCE", 7)
    mail.land_noted(rows.repartition(3, "place"), folder, notes)
    streams = {"noted": lambda: polls.poll_noted(spark, notes, folder, of, largest=800), "all": lambda: polls.poll_all(spark, folder, of, glob="*.txt", largest=800, below=True)}

    def run(name):
        polls.run_polls(streams[name](), polls.into_tables(str(tmp_path / name)), str(tmp_path / f"state-{name}")).awaitTermination()

    run("noted")
    mail.land_noted(big, folder, notes)  # a second batch
    run("noted"), run("noted"), run("all")
    seen = [sorted((r.path.split("/in/")[1], r.message_id, r.body_text, r.error) for r in spark.read.schema(polls.POLLED).parquet(str(tmp_path / n)).collect()) for n in streams]
    assert [r for r in seen[0] if r[2] != ""] == seen[1] and len(seen[0]) == 301 and seen[0][0][1:] == (None, None, "over 800 bytes: 900")  # Spark leaves out empty files
    assert {r.batch for r in polls.polled_rejects(spark, str(tmp_path / "noted")).collect()} == {1}
    assert [len((tmp_path / f"state-noted/sources/0/{n}").read_text().splitlines()) - 1 for n in (0, 1)] == [3, 1]


def test_landed_messages_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "scratch_path", lambda *_: str(tmp_path / "out"))
    found = intake.landed_messages(spark, "/root/testdata/sf0.01")
    logged = (tmp_path / "out/state/sources/0/0").read_text().splitlines()[1:]
    assert 1 <= len(logged) <= 4 and not any((tmp_path / "out/landing").iterdir())  # 100 messages
    polled = spark.read.schema(polls.POLLED).parquet(str(tmp_path / "out/tables"))
    assert polled.count() == polled.select("path").distinct().count() == view(spark, "/root/testdata/sf0.01", "parts").filter("att_idx = 0").count() == 100
    assert found.count() == 37


def test_history_is_joined_where_it_lies(spark):
    known = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "message_id string")
    table = tables.write_history(known, buckets=4)
    mails = spark.createDataFrame([("a", 1), ("c", 2), (None, 3), ("", 4)], "message_id string, n int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = mail.drop_known(mails, tables.read_history(spark, table))
        assert sorted(r.n for r in left.collect()) == [2, 3, 4]
        plan = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_deny_lists_equal_short_ones(spark):
    rng = random.Random(5)
    mails = spark.createDataFrame([(i, i % 7 if i % 11 else None, "".join(rng.choices("abcdE@. ", k=rng.randrange(12))) if i % 13 else None) for i in range(400)], "id int, account_id long, sender string")
    accounts = spark.createDataFrame([(a, ", ".join("".join(rng.choices("abCd@", k=rng.randrange(1, 7))) for _ in range(2)) if a % 2 else None) for a in range(7)], "id long, filter_sender string")
    for shared in ([], ["a@", " DAB ", "", "abcde", "c"], ["".join(rng.choices("abcd@", k=5)) for _ in range(300)]):
        short = {r.id for r in mail.filter_senders(mails, accounts, shared).collect()}
        assert {r.id for r in mail.filter_senders_long(mails, accounts, spark.createDataFrame([(x,) for x in shared], "entry string")).collect()} == short


def test_entries_of_accounts_meet_their_own_senders_only(spark):
    n = 3000
    mails = spark.range(n).select("id", F.col("id").alias("account_id"), F.concat(F.lit("clerk 1 c"), F.col("id").cast("string"), F.lit("@x")).alias("sender"))
    accounts = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "k 1, CLERK 1").otherwise("clerk 2").alias("filter_sender")).unionByName(spark.createDataFrame([(None, "c1")], "id long, filter_sender string"))
    left = mail.filter_senders_long(mails, accounts, spark.createDataFrame([("c7@",), ("@x7",)], "entry string"))
    assert {r.id for r in left.collect()} == {i for i in range(n) if i % 2 and i != 7}
    seen, nodes = [], [left._jdf.queryExecution().executedPlan()]
    while nodes:  # what each join of the finished plan gave
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind:
            seen.append(node.metrics().apply("numOutputRows").value())
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(kind, "plan" if kind.endswith("QueryStageExec") else "")
        nodes += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    assert seen and max(seen) <= 20 * n, seen  # of pairs of an account's entry and any account's sender there would be millions


def test_numbers_within_a_large_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("key"), (-F.col("id")).alias("at"), F.lit("x").alias("range_part"))
    rows = ranks.ranked(df, ["key"], ["at"], "n", parts=7).collect()
    places = {}
    for r in sorted(rows, key=lambda r: r.at):
        places[r.key] = places.get(r.key, 0) + 1
        assert r.n == places[r.key]
    assert len(rows) == 3000 and rows[0].range_part == "x" and places["hot"] == 2000
    assert ranks.ranked(df.limit(0), ["key"], ["at"], "n").collect() == []
