"""Structured Streaming: exactly-once intake, daily summaries and a failure throttle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.sources import mail

THROTTLE = "key string, ts timestamp, blocked boolean, retry_after int"


#: What Spark takes a file to cost is meant for large ones, and it lists each folder by a task of its own; for very many files of a few KB.
MANY_SMALL = {"spark.sql.files.openCostInBytes": ("4194304", "262144"), "spark.sql.sources.parallelPartitionDiscovery.parallelism": ("10000", "64")}


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Streams made and started inside list their folders in few tasks and read some 500 small files in each; values that the session set stay.

    A stream keeps the settings it was started with.
    """
    own = {k: few for k, (usual, few) in MANY_SMALL.items() if spark.conf.get(k).removesuffix("b") == usual}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, few in own.items():
            spark.conf.set(k, few)
        yield
    finally:
        for k, usual in before.items():
            spark.conf.set(k, usual)


def poll_all(spark: SparkSession, folder: str, as_of: str, glob: str = "*", largest: int = mail.LARGEST, below: bool = False) -> DataFrame:
    """A stream of ``mail.parse_or_reject`` rows of message files that land in a folder, or also in folders ``below`` it.

    The driver lists the folder and holds each of its files; for very many files see ``poll_noted``.
    """
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", str(below).lower()).option("pathGlobFilter", glob)
    return mail.parse_or_reject(raw.schema("path string, modificationTime timestamp, length long, content binary").load(folder), as_of, largest)


def poll_noted(spark: SparkSession, notes: str, folder: str, as_of: str, largest: int = mail.LARGEST) -> DataFrame:
    """The rows of ``poll_all``, and those of empty files, for what ``mail.land_noted`` landed: a stream of notes, in few files, whose messages tasks open.

    A stream over the message files themselves has the driver list, hold and log each of them. The notes say little of
    how much there is to read, so that they are dealt to as many tasks as a shuffle has.
    """
    noted = spark.readStream.schema(mail.NOTE).parquet(notes)
    dealt = noted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return mail.parse_or_reject(mail.read_noted(dealt, folder), as_of, largest)


def poll(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """A stream of the mails alone; see ``into_tables`` for what becomes of the others."""
    return poll_all(spark, folder, as_of).filter("error is null").drop("error")


POLLED = f"path string, {mail.MAIL}, error string, batch long, kind string"


def into_tables(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on ``poll_all``: a batch's mails and rejects in one write, parsed once.

    Both tables lie below the batch's own folder, which a replay of the batch replaces as a whole: running a batch again
    changes nothing, and one that was cut off leaves nothing behind.
    """

    def sink(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col("error").isNull(), "mails").otherwise("rejects")
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={number}")

    return sink


def polled_mails(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mail columns, batch) of all batches; rejects are not read."""
    return spark.read.schema(POLLED).parquet(folder).filter("kind = 'mails'").drop("kind", "error")


def polled_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """(path, error, batch) of the messages that could not be read."""
    return spark.read.schema(POLLED).parquet(folder).filter("kind = 'rejects'").select("path", "error", "batch")


def new_polled(mails: DataFrame, log: DataFrame) -> DataFrame:
    """The first polled mail of each message id, by batch, then path, that the log doesn't have."""
    return mail.drop_known(mail.dedup_batch(mails, ["batch", "path"]), log)


def exactly_once(mails: DataFrame, days: int = 7, column: str = "received_at") -> DataFrame:
    """Each message id once within the look-back, which bounds lateness and state; ``column`` must be a timestamp."""
    timed = mails.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, f"{days} days").dropDuplicatesWithinWatermark(["message_id"])


def new_only(batch: DataFrame, log: DataFrame) -> DataFrame:
    """For foreachBatch: what neither the batch nor the log has, for ids older than the state."""
    return mail.drop_known(mail.dedup_batch(batch, ["received_at"]), log)


def run_polls(mails: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Start the poll; without an interval, take what is there and stop."""
    writer = mails.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def daily_targets(ledger: DataFrame, late: str = "7 days") -> DataFrame:
    """(day, target, total, failed) by tumbling days; append mode gives a day once it is closed."""
    timed = ledger.withColumn("ts", F.col("created_at").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if ledger.isStreaming else timed
    day = F.window("ts", "1 day")
    counts = timed.groupBy(day.alias("w"), F.trim("target_email").alias("target")).agg(F.count_if("success").alias("total"), F.count_if(~F.col("success")).alias("failed"))
    return counts.select(F.to_date("w.start").alias("day"), "target", "total", "failed")


def fold(failures: list[float], now: float, ok: bool, window_s: int, limit: int) -> tuple[list[float], bool, int]:
    """One attempt: failures that still count, whether it is blocked, seconds to wait. Blocked attempts don't count."""
    live = [t for t in failures if now - t < window_s]
    if len(live) >= limit:
        return live, True, int(live[0] + window_s - now)
    return ([] if ok else [*live, now]), False, 0


def throttle(attempts: DataFrame, window_s: int = 900, limit: int = 5) -> DataFrame:
    """(key, ts, blocked, retry_after) of (key, ts, ok) attempts in order, per key.

    Keys are sorted within their partition, which can spill, and folded batch by batch: only the
    current key and its few live failures are held, however many attempts a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures: list[float] = []
        started, current = False, None
        for batch in batches:
            rows = []
            for key, ts, ok in batch[["key", "ts", "ok"]].itertuples(index=False):
                if not started or not (key == current or (pd.isna(key) and pd.isna(current))):
                    started, current, failures = True, key, []
                failures, blocked, wait = fold(failures, ts.timestamp(), bool(ok), window_s, limit)
                rows.append((key, ts, blocked, wait))
            yield pd.DataFrame(rows, columns=["key", "ts", "blocked", "retry_after"])

    ordered = attempts.select("key", "ts", "ok").repartition("key").sortWithinPartitions("key", F.asc_nulls_last("ts"), F.asc_nulls_last("ok"))
    return ordered.mapInPandas(run, THROTTLE)


class Throttle(StatefulProcessor):
    """Counted failures of a key as list state. Attempts of a batch are folded as they come, in order of time.

    A timer by event time drops what no longer counts, so that a key that stays away leaves no state. Attempts
    that come later than the watermark are not given to it.
    """

    def __init__(self, window_s: int, limit: int) -> None:
        self.window_s, self.limit = window_s, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getListState("failures", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        failures = sorted(x for (x,) in self.failures.get())
        last = None
        for part in rows:
            out = []
            for ts, ok in part[["ts", "ok"]].sort_values(["ts", "ok"]).itertuples(index=False):
                last = ts.timestamp() if last is None else max(last, ts.timestamp())
                failures, blocked, wait = fold(failures, ts.timestamp(), bool(ok), self.window_s, self.limit)
                out.append((key[0], ts, blocked, wait))
            yield pd.DataFrame(out, columns=["key", "ts", "blocked", "retry_after"])
        self.failures.clear()
        if failures:
            self.failures.put([(x,) for x in failures])  # at most ``limit``
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old if isinstance(old, int) else old[0])
            self.handle.registerTimer(int((failures[-1] + self.window_s) * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.failures.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "ts": pd.Series([], dtype="datetime64[ns]"), "blocked": pd.Series([], dtype="bool"), "retry_after": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


#: The state store that keyed lists and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def throttle_stream(attempts: DataFrame, window_s: int = 900, limit: int = 5, late: str = "1 hour") -> DataFrame:
    """The same over a stream: state is a key's counted failures, at most ``limit``, dropped by event time once the window is over.

    A micro-batch's attempts of a key come in Arrow batches and are folded one after the other, never as a whole: the batches
    should be in order of time, as files that land are. The session must use ``STATE_STORE``.
    """
    timed = attempts.select("key", F.col("ts").cast("timestamp").alias("ts"), "ok").withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Throttle(window_s, limit), THROTTLE, outputMode="Append", timeMode="EventTime")
