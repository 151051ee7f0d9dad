"""Tables as files: what lies on disk, and what is read of it."""

from __future__ import annotations

import csv
import glob
import io
import json
import os

from pyspark.sql import functions as F

from quillmill.operators import reports
from quillmill.plans.stores import stored_outbox
from quillmill.sources import stores

LOG = "id long, sender string, subject string, doc_type string, urgency string, status string, case_summary string, key_date string, case_number string, involved_parties string, target_email string, error_message string, created_at timestamp_ntz"


def mail_log(spark, n):
    rows = spark.range(n).select("id", F.lit("A <a@x>").alias("sender"), F.concat(F.lit(' s, "'), F.col("id").cast("string"), F.lit('"\n')).alias("subject"), F.lit("=1").alias("case_summary"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id").cast("int"))).alias("created_at"))
    return spark.createDataFrame([], LOG).unionByName(rows, allowMissingColumns=True)


def test_export_parts_are_one_file(spark, tmp_path):
    attachments = spark.createDataFrame([(1, 3, "f.txt")], "id long, log_id long, filename string")
    for n in (500, 0):
        path = str(tmp_path / f"e{n}")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one part
        try:
            reports.export_log_csv(mail_log(spark, n).repartition(5), attachments, path)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts = sorted(glob.glob(f"{path}/part-*"))
        assert [r.name for r in reports.export_parts(spark, path).collect()] == [os.path.basename(p) for p in parts]
        data = b"".join(open(p, "rb").read() for p in parts)
        assert data.startswith("﻿created_at,".encode()) and data.count("﻿".encode()) == 1
        rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
        assert len(rows) == n + 1 and len(rows[0]) == 13
        if n:
            assert len(parts) > 1 and [r[3] for r in rows[1:]] == [f' s, "{i}"\n' for i in range(n - 1, -1, -1)] and rows[-4][12] == "f.txt" and rows[1][7] == "'=1"


def test_an_outbox_has_bounded_parts(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "mail_id long, target_email string, body string"
    outbox = spark.range(4000).select(F.col("id").alias("mail_id"), F.when(F.col("id") % 3 == 0, "hot@x").otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("target_email"), F.lit("b").alias("body"))
    stores.write_outbox(outbox, path, 8)
    sizes = {r.part: r.n for r in spark.read.parquet(f"{path}/manifest").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) < 1000 and len(glob.glob(f"{path}/mails/part=*/*.json")) <= 8
    for target, n in (("hot@x", 1334), ("t7", 5), ("none", 0)):
        assert stores.read_outbox(spark, path, schema, target).count() == n


def test_tasks_of_a_large_outbox_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "OUTBOX_BYTES", 40_000, raising=False)
    path, schema = str(tmp_path / "out"), "mail_id long, target_email string, body string"
    outbox = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot@x").otherwise(F.concat(F.lit("t"), (F.col("id") % 90).cast("string"))).alias("target_email"), F.repeat(F.lit("b"), 300).alias("body")).withColumnRenamed("id", "mail_id")
    stores.write_outbox(outbox, path, 4)
    files = [sorted(glob.glob(f"{path}/mails/part={p}/*.json")) for p in range(4)]
    assert all(files) and max(os.path.getsize(f) for part in files for f in part) < 120_000  # over 200,000 for each of four files
    rows = [(x["target_email"], x["mail_id"]) for part in files for f in part for x in map(json.loads, open(f))]
    assert rows == sorted(rows) and len(rows) == 3000
    assert stores.read_outbox(spark, path, schema, "hot@x").count() == 1000
    stores.write_outbox(outbox.limit(0), path, 4)
    assert stores.read_outbox(spark, path, schema, "hot@x").count() == 0


def test_a_stored_outbox_is_a_small_part_of_its_texts(spark, tmp_path, monkeypatch):
    path, schema, write = str(tmp_path / "out"), "mail_id long, target_email string, body string", stores.write_outbox
    monkeypatch.setattr(stores, "write_outbox", lambda outbox, _, *more: write(outbox, path, *more))
    monkeypatch.setattr("quillmill.plans.stores.scratch_path", lambda *_: path)
    rows = stored_outbox(spark, "/root/testdata/sf0.001").collect()
    mails = spark.read.schema(schema).json(f"{path}/mails")
    chars, n = mails.agg(F.sum(F.octet_length("body")), F.count("*")).first()
    assert n == sum(r.mails for r in rows) == sum(r.listed for r in rows) > 2000
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path}/mails/part=*/part-*")) < chars / 5
    assert stores.read_outbox(spark, path, schema, rows[0].target_email).count() == rows[0].mails


def test_retention_drops_days(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id long, created_at timestamp_ntz"
    log = mail_log(spark, 24 * 20).select("id", "created_at")
    stores.write_by_day(log.unionByName(log.limit(1).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))), path)
    before = {d: os.listdir(f"{path}/{d}") for d in os.listdir(path) if d.startswith("day=")}
    assert stores.drop_expired(spark, path, schema, "2024-01-20 12:00:00", 0) == []
    dropped = stores.drop_expired(spark, path, schema, "2024-01-20 12:00:00", 10)
    assert dropped == [f"2024-01-{d:02d}" for d in range(1, 10)]
    assert stores.drop_expired(spark, path, schema, "2024-01-20 12:00:00", 10) == []
    after = {d: os.listdir(f"{path}/{d}") for d in os.listdir(path) if d.startswith("day=")}
    assert {d for d in after if after[d] != before[d]} == {"day=2024-01-10"}  # others are as they were
    kept = stores.read_by_day(spark, path, schema)
    assert sorted(r.id for r in kept.filter("created_at is not null").collect()) == list(range(24 * 9 + 12, 24 * 20)) and kept.count() == 24 * 11 - 12 + 1


def test_changes_by_number(spark, tmp_path):
    path, columns = str(tmp_path / "t"), ["k", "a", "b"]
    stores.write_base(spark.createDataFrame([(1, "a1", "b1"), (2, "a2", None), (None, "a3", "b3")], "k int, a string, b string"), path)
    stores.compact(spark, path, ["k"])
    stores.write_change(spark.createDataFrame([(1, "***"), (9, "a9")], "k int, a string"), path, 1, columns)
    stores.write_change(spark.createDataFrame([(2, "wrong")], "k int, b string"), path, 2, columns)
    stores.write_change(spark.createDataFrame([(1, None), (None, "c3")], "k int, b string"), path, 2, columns)  # again, another
    expected = [(1, "a1", None), (2, "a2", None), (9, "a9", None), (None, "a3", "c3")]
    for _ in range(2):
        assert sorted(map(tuple, stores.read_merged(spark, path, ["k"], "***").collect()), key=str) == expected
        stores.compact(spark, path, ["k"], "***")
    assert stores.folders(spark, f"{path}/base", "seq") == [f"{n:012d}" for n in (0, 2)]
    assert stores.folders(spark, str(tmp_path / "none"), "seq") == []
