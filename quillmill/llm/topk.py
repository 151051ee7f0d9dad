"""Exact top-k by inner product as a Voronoi kNN join (operator 10).

Pivots cut the vectors into cells; each cell is cut further into shells by distance from its
pivot. Counts and distance bounds of the shells are the summary, at most ``PIVOTS`` x
(``SHELLS`` + 1) rows. For a query q and a vector x of a shell of pivot p at distance at most r,

    q.p - |q| r  <=  q.x  <=  q.p + |q| r.

The lower bounds and counts give each query a score that its k-th best reaches at least; a
shell whose upper bound is below it can't matter. Queries are grouped by the same pivots at every
size, and a group needs the shells that one of its queries needs. Groups are solved in bounded
blocks of queries and buckets of vectors: small groups share a block and small shells a bucket, large
ones are cut into several. A shell's vectors go to the blocks with a group that needs it, a group's queries
to the buckets with a shell that it needs, and there they only meet the shells that they need. The best
of the buckets are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import by_arrow, materialize

#: Pivots are the square root of the number of vectors, and at most these.
PIVOTS, SHELLS = 1024, 8
#: Queries of a block and vectors of a bucket at most, about.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 20_000


def quantized(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as long; null if a component is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(vectors: list[np.ndarray] | pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floats where these are exact."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] < 2**53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


class Cells:
    """Vectors by cell and shell, written once, and their summary; ``rows`` has row, id, v, asks, cell, far and shell."""

    def __init__(self, chosen: DataFrame, pivots: int | None = None) -> None:
        self.width = max(chosen.agg(F.max(F.size("v"))).first()[0] or 0, 1)
        width = self.width
        pivots = isqrt(chosen.count()) + 1 if pivots is None else pivots
        # pivots: a bounded number, drawn by hash
        drawn = chosen.orderBy(F.xxhash64("v"), "row").select("v").limit(min(pivots, PIVOTS)).collect()
        centres = self.centres = np.unique(_matrix([r.v for r in drawn], width), axis=0).astype(np.float64)

        def locate(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            x = _matrix(batch.column(2).to_numpy(zero_copy_only=False), width).astype(np.float64)
            cell = ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            own = {c: batch.column(i) for i, c in enumerate(("row", "id", "v", "asks"))}
            yield own | {"cell": pa.array(cell, pa.int32()), "far": pa.array(np.linalg.norm(x - centres[cell], axis=1))}

        kind = chosen.schema["id"].dataType.simpleString()
        located = materialize(by_arrow(chosen, f"row long, id {kind}, v array<bigint>, asks boolean, cell int, far double", locate), "topk-cells")
        farthest = located.agg(F.max("far")).first()[0] or 0.0
        self.rows = located.withColumn("shell", F.floor(F.col("far") * (SHELLS / (farthest or 1.0))).cast("int"))
        self.summary = self.rows.groupBy("cell", "shell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if("asks").alias("asking")).collect()  # bounded: pivots x shells

    def needed(self, k: int) -> DataFrame:
        """(for_cell, cell, shell): what the queries of a cell need to find their ``k`` best and themselves."""
        width, centres = self.width, self.centres
        cells, shells, counts, reach = (np.array([r[c] for r in self.summary]) for c in ("cell", "shell", "n", "far"))

        def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            whole, group = _matrix(batch.column(0).to_numpy(zero_copy_only=False), width).astype(np.float64), batch.column(1).to_numpy()
            wanted = {g: np.zeros(len(cells), bool) for g in np.unique(group)}
            for a in range(0, len(whole), 256):
                x = whole[a : a + 256]
                middle = (x @ centres.T)[:, cells]
                slack = np.linalg.norm(x, axis=1)[:, None] * reach * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
                low = middle - slack
                order = np.argsort(-low, axis=1)
                enough = np.cumsum(counts[order], axis=1) >= k + 1  # one of them may be the query's own row
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
                bound = np.where(at >= 0, np.take_along_axis(low, order, axis=1)[np.arange(len(x)), at], -np.inf)
                for g, want in zip(group[a : a + 256], middle + slack >= bound[:, None]):
                    wanted[g] |= want
            found = [(g, int(j)) for g, want in wanted.items() for j in np.flatnonzero(want)]
            yield {"for_cell": pa.array([g for g, _ in found], pa.int32()), "cell": pa.array([cells[j] for _, j in found], pa.int32()), "shell": pa.array([shells[j] for _, j in found], pa.int32())}

        return by_arrow(self.rows.filter("asks").select("v", "cell"), "for_cell int, cell int, shell int", run).distinct()

    def buckets(self, most: int) -> list[tuple[int, int, int, int, int]]:
        """(cell, shell, unit, bucket, splits): neighbouring shells share a bucket up to ``most`` vectors; a larger one has its own, in splits."""
        out, held, bucket = [], 0, 0
        for unit, r in enumerate(sorted(self.summary, key=lambda r: (r.cell, r.shell))):
            if held and held + r.n > most:
                held, bucket = 0, bucket + 1
            held += r.n
            out.append((r.cell, r.shell, unit, bucket, max(1, -(-r.n // most))))
        return out

    def blocks(self, most: int) -> list[tuple[int, int, int]]:
        """(cell, block, parts): groups of queries share a block up to ``most`` of them; a larger group has its own, in parts."""
        asking = Counter()
        for r in self.summary:
            asking[r.cell] += r.asking
        out, held, block = [], 0, 0
        for cell, n in sorted(asking.items()):
            if held and held + n > most:
                held, block = 0, block + 1
            held += n
            out.append((cell, block, max(1, -(-n // most))))
        return out


def _numbers(n: str) -> Column:
    """A row for each of 0 to the column ``n`` less one."""
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "v", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each query row, the ``k`` rows of highest inner product but its own.

    ``vector_col`` is array<bigint>. Ties go to the smaller id, null ids first. Rows with a null
    vector or a null component take no part; a shorter vector lacks its last components, which
    count as zero. Rows that repeat an id are rows of their own: each is a candidate for the
    other. Products must fit 64 bits. With fewer candidates than ``k``, all are returned.
    ``pivots`` is by default the square root of the number of rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    chosen = materialize(chosen.filter(F.col("v").isNotNull() & ~F.exists("v", F.isnull)), "topk-rows")
    cells = Cells(chosen, pivots)
    width = cells.width
    blocks = spark.createDataFrame(cells.blocks(QUERY_BLOCK), "for_cell int, block int, parts int")  # at most the pivots
    buckets = spark.createDataFrame(cells.buckets(VECTOR_BLOCK), "cell int, shell int, unit int, bucket int, splits int")  # at most the summary
    needed = materialize(cells.needed(k).join(F.broadcast(blocks), "for_cell").join(F.broadcast(buckets), ["cell", "shell"]), "topk-needed")

    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part")
    asking = cells.rows.filter("asks").join(F.broadcast(blocks), F.col("cell") == F.col("for_cell")).select("for_cell", part, F.col("row").alias("q_row"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))
    groups = needed.groupBy("for_cell", "block", "parts", "bucket", "splits").agg(F.collect_set("unit").alias("units"))  # at most the shells of a bucket
    left = asking.join(groups.withColumn("part", _numbers("parts")), ["for_cell", "part"]).withColumn("split", _numbers("splits"))
    left = left.select("for_cell", "units", "q_row", "q_id", "q_v", *[F.col(c).alias(f"q_{c}") for c in ("block", "part", "bucket", "split")])
    split = F.pmod(F.xxhash64("row", F.lit(1)), F.col("splits")).cast("int").alias("split")
    data = cells.rows.join(F.broadcast(buckets), ["cell", "shell"]).select("unit", split, "row", "id", "v")
    asked = needed.select("block", "parts", "unit", "bucket", "splits").distinct()
    right = data.join(asked.withColumn("split", _numbers("splits")), ["unit", "split"]).withColumn("part", _numbers("parts"))
    # a block's groups have equal parts, as one that is cut has a block of its own; so have a bucket's shells their splits

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(data):
            data = data.sort_values(["id", "row"], na_position="first")
            x, rows, ids, units = _matrix(data["v"], width), data["row"].to_numpy(), data["id"].to_numpy(), data["unit"].to_numpy()
        for _, own in queries.groupby("for_cell") if len(data) else ():
            meets = np.flatnonzero(np.isin(units, own["units"].iloc[0]))
            near = x[meets]
            for a in range(0, len(own), 256):
                some = own.iloc[a : a + 256]
                scores = _products(_matrix(some["q_v"], width), near)
                for own_row, own_id, s in zip(some["q_row"], some["q_id"], scores):
                    there = np.flatnonzero(rows[meets] != own_row)
                    s, there = s[there], meets[there]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        above = np.flatnonzero(s > least)
                        best = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
                    else:
                        best = np.arange(len(s))
                    out += [(own_row, own_id, rows[there[i]], ids[there[i]], s[i]) for i in best]
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "id", "score"])

    found = left.groupBy("q_block", "q_part", "q_bucket", "q_split").cogroup(right.groupBy("block", "part", "bucket", "split")).applyInPandas(solve, f"query_row long, query_id {id_type}, row long, id {id_type}, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
