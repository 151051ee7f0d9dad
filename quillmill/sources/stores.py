"""Tables as files: a log by day, an outbox in bounded parts, files of several versions, a base with changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.maintenance import retention_days, upgrade_schema
from quillmill.sources.scratch import discard, file_system, scope, written


def folders(spark: SparkSession, path: str, name: str) -> list[str]:
    """The values of the folders ``name=value`` right below ``path``, sorted; none if there is no ``path``."""
    files, place = file_system(spark, path)
    found = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
    return sorted(x.removeprefix(f"{name}=") for x in found if x.startswith(f"{name}="))


# --- a log by day


def write_by_day(log: DataFrame, path: str) -> None:
    """Rows in a folder for each day of created_at; those without one in a folder of their own, which is never dropped."""
    by_day = log.withColumn("day", F.to_date("created_at"))
    by_day.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("day").parquet(path)  # a large day is up to eight tasks


def read_by_day(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, day date").parquet(path)


def drop_expired(spark: SparkSession, path: str, schema: str, as_of: str, setting: int | None) -> list[str]:
    """Retention in place; the days dropped. Days wholly expired are dropped without being read, and one day at most is written anew.

    A run that is cut off can be repeated: what it has dropped stays dropped.
    """
    days = retention_days(setting)
    if days is None:
        return []
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    last = str(spark.range(1).select(F.to_date(limit)).first()[0])
    dated = [d for d in folders(spark, path, "day") if d[:1].isdigit()]
    old = [d for d in dated if d < last]
    for day in old:
        discard(spark, f"{path}/day={day}")
    if last in dated:
        own = read_by_day(spark, path, schema).filter(F.col("day") == F.lit(last).cast("date"))
        kept = written(own.filter(F.col("created_at") >= limit), "kept-day")
        if kept.isEmpty():
            discard(spark, f"{path}/day={last}")
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return old


# --- an outbox


#: Bytes of text that one task sorts and writes.
OUTBOX_BYTES = 32 << 20


def write_outbox(outbox: DataFrame, path: str, parts: int, compression: str = "none") -> None:
    """Mails in ``parts`` parts, sorted by target; a target of very many mails fills several. The manifest says which part has what.

    A part is one file, or several in order where the mails are over ``OUTBOX_BYTES`` for each part: what one task sorts doesn't
    grow with the outbox. It is laid down first, as ranges are drawn from a sample and would make it twice. Mails repeat much of
    each other, so that files with a ``compression`` ("gzip") are a small part of the texts; readers tell it by a file's name.
    """
    spark, size = outbox.sparkSession, Observation()
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in outbox.schema if f.dataType.typeName() == "string"]
    with scope(spark):
        laid = written(outbox.observe(size, F.sum(reduce(lambda a, b: a + b, texts, F.lit(8 * len(outbox.columns)))).alias("bytes")), "outbox-mails", "zstd")
        files = max(1, -(-(size.get["bytes"] or 0) // (OUTBOX_BYTES * parts)))
        ranges = laid.repartitionByRange(parts * files, "target_email", "mail_id").withColumn("part", F.floor(F.spark_partition_id() / files).cast("int"))
        ranges.sortWithinPartitions("part", "target_email", "mail_id").write.mode("overwrite").partitionBy("part").json(f"{path}/mails", compression=compression)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in outbox.schema)}, part int"
    stored = outbox.sparkSession.read.schema(schema).json(f"{path}/mails")
    stored.groupBy("target_email", "part").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/manifest")


def read_outbox(spark: SparkSession, path: str, schema: str, target: str) -> DataFrame:
    """The mails of one target; only parts that the manifest names are read."""
    named = [r.part for r in spark.read.parquet(f"{path}/manifest").filter(F.col("target_email") == target).select("part").collect()]  # parts of one target
    return spark.read.schema(f"{schema}, part int").json(f"{path}/mails").filter(F.col("part").isin(named) & (F.col("target_email") == target)).drop("part")


# --- files of several versions


def read_versions(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of the folders ``version=...`` below ``path``: each is upgraded by what its own files lack, then all are one.

    A null in a file that has the column stays null; only a column that a version didn't have yet gets its default.
    """
    own = [upgrade_schema(spark.read.parquet(f"{path}/version={v}"), table).withColumn("version", F.lit(v)) for v in folders(spark, path, "version")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


# --- a base with changes


def write_base(df: DataFrame, path: str, seq: int = 0) -> None:
    """The table as of change ``seq``."""
    df.write.parquet(f"{path}/base/seq={seq:012d}")


def write_change(snapshot: DataFrame, path: str, seq: int, columns: list[str]) -> None:
    """A snapshot's rows as change ``seq``; which of the table's ``columns`` it has is kept with them. Writing a change again replaces it."""
    given = [c for c in columns if c in snapshot.columns]
    snapshot.select(*given, F.array(*map(F.lit, given)).alias("given")).write.mode("overwrite").parquet(f"{path}/changes/seq={seq:012d}")


def read_merged(spark: SparkSession, path: str, key: list[str], skip: str | None = None) -> DataFrame:
    """The latest base with all later changes: of each column the newest value that a change has, but for those equal to ``skip``.

    Rows meet by their keys in one aggregation, however many changes there are; a key that only changes have is a new row.
    A change must have a key once.
    """
    start = folders(spark, f"{path}/base", "seq")[-1]
    base = spark.read.parquet(f"{path}/base/seq={start}")
    columns = base.columns
    rows = [base.select("*", F.array(*map(F.lit, columns)).alias("given"), F.lit(int(start)).alias("seq"))]
    for seq in folders(spark, f"{path}/changes", "seq"):
        if seq > start:
            rows.append(spark.read.parquet(f"{path}/changes/seq={seq}").withColumn("seq", F.lit(int(seq))))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)

    def newest(c: str) -> Column:
        counts = F.array_contains("given", c)
        if skip is not None:
            counts = counts & (~F.col(c).cast("string").eqNullSafe(F.lit(skip)) | (F.col("seq") == int(start)))
        return F.max_by(F.struct(c), F.when(counts, F.col("seq")))[c].alias(c)

    merged = every.groupBy(*key).agg(*[newest(c) for c in columns if c not in key])
    return merged.select(*columns)


def compact(spark: SparkSession, path: str, key: list[str], skip: str | None = None) -> None:
    """All changes so far become the base; older ones stay on disk for readers that still use them, and count no more."""
    seqs = folders(spark, f"{path}/changes", "seq")
    if seqs and seqs[-1] > folders(spark, f"{path}/base", "seq")[-1]:
        read_merged(spark, path, key, skip).write.mode("overwrite").parquet(f"{path}/base/seq={seqs[-1]}")
