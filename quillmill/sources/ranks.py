"""Row numbers within keys of which one may have a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions.names import fresh
from quillmill.sources.scratch import written


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the row's number in its key by ``order``, from 1; null keys are keys, and ties get some order.

    Rows are dealt into ranges of (key, order), so that a large key fills several, and written with their range. A row's
    number is its place among its key's rows of the range, and how many of these lie in ranges before: only
    a range's first key can have any, so that there are no more such counts than ranges.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, number, before = (fresh(df, x) for x in ("range_part", "range_number", "range_before"))
    sorted_rows = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).sortWithinPartitions(*keys, *order)
    laid = written(sorted_rows.withColumns({part: F.spark_partition_id(), number: F.monotonically_increasing_id()}), "ranked")
    counts = laid.groupBy(*keys, part).agg(F.count("*").alias(before))
    earlier = F.sum(before).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    others = {k: f"{before}_{i}" for i, k in enumerate([*keys, part])}
    carried = counts.withColumn(before, earlier).filter(F.col(before) > 0).select(before, *[F.col(k).alias(o) for k, o in others.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in others.items()])
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(number))
    numbered = laid.withColumn(name, local).join(F.broadcast(carried), same, "left")  # as many rows as ranges at most
    return numbered.select(*[f"`{c}`" for c in df.columns], (F.col(name) + F.coalesce(before, F.lit(0))).cast("int").alias(name))
