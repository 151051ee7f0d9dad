"""Batches of texts are bounded by bytes, however long the texts are."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm.common import BATCH_BYTES, by_arrow

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.set(LIMIT, before)


def _sizes(spark):
    """Rows and bytes of each batch that Python gets of 40 MB of texts in one partition; nulls and one long text among them."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    at = F.col("id")
    text = F.when(at % 7 == 0, F.lit(None)).when(at == 5, F.repeat(F.lit("x"), 2 * BATCH_BYTES)).otherwise(F.repeat(F.lit("some text "), 300))
    docs = spark.range(0, 10_000, 1, 1).select(text.alias("text"))
    by_arrow(docs, "n long", lambda batch: [], text=0)  # sets the limit, when it is called
    return [(x.n, x.size) for x in docs.mapInArrow(sizes, "n long, size long").collect()]


def test_batches_of_texts_are_bounded(spark, limit):
    found = _sizes(spark)
    assert sum(n for n, _ in found) == 10_000
    assert sorted(size for _, size in found)[-2] < 1.1 * BATCH_BYTES  # a batch ends with the text that fills it
    assert max(size for _, size in found) < 3.2 * BATCH_BYTES


def test_a_limit_of_the_session_stays(spark, limit):
    spark.conf.set(LIMIT, "16m")
    _sizes(spark)
    assert spark.conf.get(LIMIT) == "16m"


def test_slices_keep_all_rows(spark, limit):
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "ab " * i) for i in range(500)] * 2, "id long, text string")
    out = by_arrow(docs, "id long, text string", lambda batch: [{"id": batch.column(0), "text": batch.column(1)}], text=1, at_once=1000)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert by_arrow(docs.limit(0), "id long, text string", lambda batch: [], text=1).count() == 0
