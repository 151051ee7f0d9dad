"""Mixing sources to target weights (operator 2).

Documents are aggregated by membership pattern (the set of sources they belong to). A
min-cost flow routes each pattern's word capacity to the quotas of its sources: a pattern
offers its words up to ``max_repeats`` times, and the k-th pass costs ``k``, so that the cost of
repetition is convex and fresh words go first. Within a pattern, every document is taken as
often as whole passes say, and a seeded order picks the documents of the last, partial pass.

Only one row per pattern reaches the driver; ``MAX_PATTERNS`` bounds them, and more raise an
error. The documents are read twice and never shuffled, but for those in the one hash range
of a million of each pattern in which the partial pass ends.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import materialize

MAX_PATTERNS = 100_000
#: Hash ranges of the seeded order, and ranges within each, as powers of two.
RANGE_BITS = 10
#: Columns that ``mix`` adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def share_out(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float) -> dict[str | None, float]:
    """Targets by weight, each at most ``most`` times its source's size; the excess is shared again by weight."""
    targets: dict[str | None, float] = {}
    left, weight = float(total), float(sum(weights.values()))
    for source in sorted(sizes, key=lambda s: sizes[s] * most / weights[s]):
        fair = left * weights[source] / weight if weight > 0 else 0.0
        targets[source] = min(fair, most * sizes[source])
        left -= targets[source]
        weight -= weights[source]
    return targets


def route(patterns: list[tuple[str | None, ...]], sizes: list[int], quotas: dict[str | None, float], repeats: int) -> list[float]:
    """Words that each pattern supplies in a min-cost flow from patterns to source quotas.

    The graph falls apart into patterns that share sources, directly or by others; each part has a
    flow of its own.
    """
    part_of: dict[str | None, str | None] = {}

    def root(source: str | None) -> str | None:
        while part_of.setdefault(source, source) != source:
            part_of[source] = part_of[part_of[source]]
            source = part_of[source]
        return source

    for sources in patterns:
        for source in sources:
            part_of[root(source)] = root(sources[0])
    parts: dict[str | None, list[int]] = defaultdict(list)
    for i, sources in enumerate(patterns):
        parts[root(sources[0])].append(i)
    flow = [0.0] * len(patterns)
    for own in parts.values():
        for i, words in zip(own, _flow([patterns[i] for i in own], [sizes[i] for i in own], quotas, repeats)):
            flow[i] = words
    return flow


def _flow(patterns: list[tuple[str | None, ...]], sizes: list[int], quotas: dict[str | None, float], repeats: int) -> list[float]:
    """Successive shortest paths on the small graph of passes, patterns, sources and a sink."""
    names = sorted({s for sources in patterns for s in sources}, key=lambda s: (s is None, s or ""))
    first = 2 + len(patterns)
    at = {s: first + k for k, s in enumerate(names)}
    graph: list[list[list]] = [[] for _ in range(first + len(names))]  # arcs: head, capacity, cost, place of the reverse arc

    def arc(a: int, b: int, capacity: float, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0.0, -cost, len(graph[a]) - 1])

    for k, sources in enumerate(patterns):
        for turn in range(repeats):
            arc(0, 2 + k, float(sizes[k]), turn)
        for source in sources:
            arc(2 + k, at[source], float("inf"), 0)
    for source, node in at.items():
        arc(node, 1, quotas[source], 0)
    height = [0] * len(graph)
    tiny = 1e-6
    while True:
        cost: list[float] = [float("inf")] * len(graph)
        came: list[tuple[int, list] | None] = [None] * len(graph)
        cost[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > cost[a]:
                continue
            for x in graph[a]:
                through = d + x[2] + height[a] - height[x[0]]
                if x[1] > tiny and through < cost[x[0]]:
                    cost[x[0]], came[x[0]] = through, (a, x)
                    heapq.heappush(queue, (through, x[0]))
        if cost[1] == float("inf"):
            break
        height = [h + (c if c < float("inf") else 0) for h, c in zip(height, cost)]
        path, node = [], 1
        while node:
            node, x = came[node]
            path.append(x)
        amount = min(x[1] for x in path)
        for x in path:
            x[1] -= amount
            graph[x[0]][x[3]][1] += amount
    return [sum(graph[x[0]][x[3]][1] for x in graph[2 + k] if x[0] >= first) for k in range(len(patterns))]


def cycle_weights(sources: list[str | None]) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating, over the sources in order of code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    return {s: float(k % 3 + 1) for k, s in enumerate(ordered)}


def sub_of(draw: Column) -> Column:
    """The range within a draw's hash range."""
    return F.shiftright(draw, 64 - 2 * RANGE_BITS).bitwiseAND(F.lit((1 << RANGE_BITS) - 1))


def mix(df: DataFrame, size: Column, sources: Column, order: Column, weights: dict[str | None, float] | None = None, total: float | None = None, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """``df`` with mix_size, mix_source_size, mix_target (of its first source) and mix_copies.

    ``size``: a document's words (null as 0); ``sources``: the array of its sources, null being a
    source of its own; ``order``: what tells documents apart in the seeded order. ``weights``
    default to 1, 2, 3 in cycles, ``total`` to the words of all documents. Rows that agree in
    ``order`` and size are numbered where the partial pass ends among them, and only as many as fit
    are taken. Empty documents are copied as often as their pattern's whole passes. An empty table gives none.
    Columns of ``df`` named like the added ones are replaced.
    """
    spark = df.sparkSession
    size = F.coalesce(size, F.lit(0)).cast("long")
    pattern = F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"})
    draw = F.xxhash64(order, size, F.lit(seed))
    turn = F.struct(draw.alias("draw"), order.alias("of"), size.alias("size"))
    bin_of = F.shiftright(draw, 64 - RANGE_BITS)
    narrow = df.select(pattern.alias("pattern"), size.alias("size"), bin_of.alias("bin"), turn.alias("turn"))
    base = materialize(narrow, "mix")

    rows = base.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows.sort(key=lambda r: r.pattern)  # of several cheapest flows, reruns take the same
    patterns = [tuple(json.loads(r.pattern)) for r in rows]
    sizes: dict[str | None, int] = defaultdict(int)
    for r, members in zip(rows, patterns):
        for source in members:
            sizes[source] += r["size"]
    weights = weights or cycle_weights(list(sizes))
    targets = share_out(sizes, weights, sum(r["size"] for r in rows) if total is None else total, max_repeats)
    plan = []
    for r, members, words in zip(rows, patterns, route(patterns, [r["size"] for r in rows], targets, max_repeats)):
        passes = min(int(words // r["size"]), max_repeats) if r["size"] else 1
        rest = max(0.0, words - passes * r["size"]) if passes < max_repeats else 0.0
        plan.append((r.pattern, sizes[members[0]], float(targets[members[0]]), passes, float(rest)))
    plan_df = spark.createDataFrame(plan, "pattern string, source_size long, target double, passes int, rest double")

    # the hash range in which the partial pass ends, the range within it, then its last document
    def ended(rows: DataFrame, place: str, before: Column, rest: DataFrame) -> DataFrame:
        """(pattern, place, before, rest): where each pattern's words reach ``rest``, and the words before."""
        words = rows.groupBy("pattern", place).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy(place))
        reached = words.withColumn("upto", upto).join(F.broadcast(rest), "pattern").withColumn("upto", F.col("upto") + before).filter(F.col("upto") >= F.col("rest"))
        first = reached.groupBy("pattern").agg(F.min(F.struct(place, (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("end"))
        return first.select("pattern", "end.*")

    ends = materialize(ended(base, "bin", F.lit(0), plan_df.select("pattern", "rest")), "mix-ends")
    last = base.join(F.broadcast(ends.select("pattern", "bin")), ["pattern", "bin"]).withColumn("sub", sub_of(F.col("turn.draw")))
    subs = materialize(ended(last, "sub", F.col("before"), ends.select("pattern", "before", "rest")), "mix-subs")
    final = last.join(F.broadcast(subs), ["pattern", "sub"])
    # rows of an equal turn are one, counted; of the turn in which the rest ends, as many are taken as fit
    turns = final.groupBy("pattern", "turn").agg(F.count("*").alias("m"), F.first("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    earlier = F.coalesce(F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("pattern").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitting = F.when(F.col("size") == 0, F.col("m")).otherwise(F.floor((F.col("rest") - F.col("before") - earlier) / F.col("size") + 0.5))
    taken = turns.withColumn("k", F.least(fitting, F.col("m"))).filter("k > 0 and rest > 0")
    seams = materialize(taken.groupBy("pattern").agg(F.max(F.struct("turn", "k", "m")).alias("seam")).select("pattern", F.col("seam.turn").alias("seam"), "seam.k", "seam.m"), "mix-seams")
    plan_df = plan_df.join(ends.select("pattern", F.col("bin").alias("end_bin")), "pattern", "left").join(subs.select("pattern", F.col("sub").alias("end_sub")), "pattern", "left").join(seams, "pattern", "left")

    plan_df = plan_df.select([F.col(c).alias(f"_mix_{c}") for c in plan_df.columns])
    added = {"_mix_of": pattern, "_mix_bin": bin_of, "_mix_sub": sub_of(draw), "_mix_turn": turn, "mix_size": size}
    joined = df.withColumns(added).join(F.broadcast(plan_df), F.col("_mix_of") == F.col("_mix_pattern"))
    cut = F.coalesce((F.col("_mix_turn") == F.col("_mix_seam")) & (F.col("_mix_k") < F.col("_mix_m")), F.lit(False))
    before_end = F.col("_mix_bin") < F.col("_mix_end_bin")
    at_seam = (F.col("_mix_sub") == F.col("_mix_end_sub")) & F.coalesce(F.col("_mix_turn") <= F.col("_mix_seam"), F.lit(False))
    at_end = (F.col("_mix_bin") == F.col("_mix_end_bin")) & ((F.col("_mix_sub") < F.col("_mix_end_sub")) | at_seam)

    def shown(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select(
            *[F.col(f"`{c}`") for c in df.columns if c not in ADDED],
            "mix_size",
            F.col("_mix_source_size").alias("mix_source_size"),
            F.col("_mix_target").alias("mix_target"),
            (F.col("_mix_passes") + F.coalesce((F.col("_mix_rest") > 0) & extra, F.lit(False)).cast("int")).alias("mix_copies"),
        )

    if seams.filter("k < m").isEmpty():
        return shown(joined, before_end | at_end)
    return shown(joined.filter(~cut), before_end | at_end).unionByName(shown(_numbered(joined.filter(cut)), F.col("_mix_place") <= F.col("_mix_k")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _mix_place, from 1 within their pattern. They are written once; each task numbers its own, after those of the tasks before."""
    written = materialize(rows.withColumn("_mix_number", F.monotonically_increasing_id()), "mix-equal")
    part = F.shiftright("_mix_number", 33).alias("_mix_part")
    counts = written.groupBy(F.col("_mix_pattern").alias("of"), part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("of", "part", before.alias("offset"))  # a row for each written part and pattern
    own = F.row_number().over(Window.partitionBy("_mix_pattern", "_mix_part").orderBy("_mix_number"))
    local = written.withColumn("_mix_part", part).withColumn("_mix_own", own)
    return local.join(offsets, (F.col("_mix_pattern") == F.col("of")) & (F.col("_mix_part") == F.col("part"))).withColumn("_mix_place", F.col("offset") + F.col("_mix_own"))
