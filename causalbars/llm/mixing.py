"""Mixing overlapping sources to target weights: min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.llm.common import put
from causalbars.llm.graph import components
from causalbars.plans.series import numbered
from causalbars.plans.staging import stage

_BUCKETS = 4096


class FlowNetwork:
    """Min-cost flow by shortest augmenting paths with potentials; capacities are whole numbers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def run(self, start: int, end: int) -> int:
        """Send as much as fits, at least cost; returns the amount.  Costs of given edges are not negative."""
        n, sent = len(self.out), 0
        potential = [0] * n
        while True:
            far, via = [None] * n, [-1] * n
            far[start], heap = 0, [(0, start)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    if self.room[e]:
                        v, nd = self.to[e], d + self.cost[e] + potential[u] - potential[self.to[e]]
                        if far[v] is None or nd < far[v]:
                            far[v], via[v] = nd, e
                            heapq.heappush(heap, (nd, v))
            if far[end] is None:
                return sent
            longest = max(d for d in far if d is not None)
            potential = [p + (longest if d is None else d) for p, d in zip(potential, far, strict=True)]
            path, v = [], end
            while v != start:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            sent += amount


def plan_flow(patterns: dict[tuple, int], wanted: dict[object, float], passes: int) -> dict[tuple, int]:
    """Words to take from each pattern: demand of sources met at least repetition cost.

    Each pass over a pattern's documents is an edge of its size whose cost is the number of the pass, so
    repeating is convex and no document is read again while another that would serve is unread.
    """
    sources, keys = list(wanted), list(patterns)
    at = {s: 2 + i for i, s in enumerate(sources)}
    net = FlowNetwork(2 + len(sources) + len(keys))
    supply = {}
    for i, key in enumerate(keys):
        node = 2 + len(sources) + i
        supply[key] = [net.add(0, node, patterns[key], r) for r in range(1, passes + 1)]
        for s in key:
            net.add(node, at[s], passes * patterns[key], 0)
    for s in sources:
        net.add(at[s], 1, round(wanted[s]), 0)
    net.run(0, 1)
    return {key: sum(net.flow(e) for e in supply[key]) for key in keys}


def _named(source: str) -> Column:
    """A source as a join key; null is a source too."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _targets(edges: DataFrame, total: int, weights: Sequence[float], most: int) -> DataFrame:
    """_source and _target: ``total`` words shared by weight; a target stops at ``most`` times its source's size, the excess is reshared."""
    sizes = edges.groupBy("_source", "_s").agg(F.sum("_total").alias("_words"))
    sizes = numbered(sizes.withColumn("_last", F.col("_s").isNull()), ["_last", "_s"], "_i")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights)).cast("int"))
    sizes = stage(sizes.select("_source", (most * F.col("_words")).cast("double").alias("_most"), weight.alias("_weight")), "mix-sources")
    rate, full = 0.0, -1
    while True:
        is_full = F.col("_weight") * rate > F.col("_most")
        n, taken, open_weight = sizes.agg(
            F.count_if(is_full), F.sum(F.when(is_full, F.col("_most")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("_weight")))
        ).first()
        if n == full or not open_weight:
            break
        full, rate = n, (total - taken) / open_weight
    return sizes.select("_source", F.least(F.col("_weight") * rate, "_most").alias("_target"))


def _flows(edges: DataFrame, passes: int) -> DataFrame:
    """_pattern and _flow, the words that the flow takes of each pattern."""
    lone = edges.groupBy("_source").agg(F.count(F.lit(1)).alias("_p")).where("_p > 1").select("_source")
    hung = edges.join(lone, "_source", "left_semi").select("_pattern").distinct()
    roots = components(edges.join(hung, "_pattern", "left_semi").select(F.concat(F.lit("p"), "_pattern").alias("a"), "_source").withColumnRenamed("_source", "b"))
    roots = roots.where("node like 'p%'").select(F.substring("node", 2, 1 << 30).alias("_pattern"), "root")
    grouped = edges.join(roots, "_pattern", "left").withColumn("_group", F.coalesce("root", F.concat(F.lit("p"), "_pattern")))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = grouped.select("_group", "_pattern", "_total", "_source", "_target").repartition(n, "_group").sortWithinPartitions("_group", "_pattern")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, patterns, sources, held, out = None, {}, {}, {}, []

        def close() -> None:
            flow = plan_flow({(*s,): held[p] for p, s in patterns.items()}, sources, passes)
            out.extend((p, flow[(*s,)]) for p, s in patterns.items())

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["_pattern", "_flow"])

        for batch in batches:
            for group, p, total, source, target in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != now:
                    if patterns:
                        close()
                    now, patterns, sources, held = group, {}, {}, {}
                patterns.setdefault(p, []).append(source)
                sources[source], held[p] = target, total
            yield ready()
            out = []
        if patterns:
            close()
            yield ready()

    return rows.mapInArrow(solve, "_pattern string, _flow bigint")


def mix_sources(
    docs: DataFrame,
    sources: Column,
    size: Column,
    key: Column,
    weights: Sequence[float] = (1, 2, 3),
    passes: int = 3,
    seed: int = 0,
) -> DataFrame:
    """How often to take each document so that every source comes near its target share of words.

    ``sources`` is an array of the sources a document belongs to (it may serve any of them; a null source is a
    source), ``size`` its words, ``key`` what tells documents apart.  Sources in code point order, null
    last, weigh ``weights``, repeating; their shares add up to all words; a target stops at ``passes``
    times the words of the source's documents.

    1. Sizes are summed per membership pattern before the shuffle.  Targets are found on the table of sources, from a few totals
       a round, however many sources there are.
    2. A min-cost flow routes pattern capacity to source quotas (``plan_flow``).  Patterns that share no source, directly or
       through others, have flows of their own, which tasks solve side by side; nothing goes to the driver.  Only
       patterns that hang together are in one task.
    3. A pattern's documents are all taken ``flow div size`` times, and those first in a seeded hash order once more,
       as many as come nearest to the rest.  The order's border is found from sums of 4,096 hash ranges per
       pattern, and only the range on the border is sorted, so a hot source is never in one task.

    Adds mix_size, mix_pattern_size, mix_target (sum of its sources' targets), mix_repeats and mix_taken.  A null or
    negative size counts as 0; documents with no source are never taken; equal keys are taken alike;
    an empty table stays empty; input columns with the added names are replaced.
    """
    names = F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast("array<string>"))
    words = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    pattern = F.to_json(F.struct(names.alias("s")), {"ignoreNullFields": "false"})
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    bucket = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    docs = docs.withColumns({"_pattern": pattern, "_size": words, "_order": order})
    light = stage(docs.select("_pattern", names.alias("_sources"), "_size", "_order"), "mix-sizes")

    sums = stage(light.groupBy("_pattern").agg(F.first("_sources").alias("_sources"), F.sum("_size").alias("_total")), "mix-patterns")
    edges = sums.select("_pattern", "_total", F.explode("_sources").alias("_s")).withColumn("_source", _named("_s"))
    total = sums.where(F.size("_sources") > 0).agg(F.sum("_total")).first()[0] or 0
    wanted = _targets(edges, total, weights, passes)
    edges = stage(edges.join(wanted, "_source").select("_pattern", "_total", "_source", "_target"), "mix-edges")
    flow = _flows(edges, passes)
    aims = edges.groupBy("_pattern").agg(F.sum("_target").alias("_target"))
    plan = (
        sums.select("_pattern", "_total")
        .join(aims, "_pattern", "left")
        .join(flow, "_pattern", "left")
        .select(
            "_pattern",
            "_total",
            F.coalesce("_target", F.lit(0.0)).alias("_target"),
            F.coalesce(F.floor(F.try_divide("_flow", "_total")), F.lit(0)).alias("_passes"),
            F.coalesce(F.expr("try_mod(_flow, _total)"), F.lit(0)).alias("_rest"),
        )
    )
    plan = stage(plan, "mix-plan")
    by_bucket = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        light.groupBy("_pattern", bucket.alias("_bucket"))
        .agg(F.sum("_size").alias("_words"))
        .withColumn("_end", F.sum("_words").over(by_bucket))
        .join(plan, "_pattern")
    )
    # One row per pattern at most: the hash range in which the rest runs out.
    border = ranges.where((F.col("_end") > F.col("_rest")) & (F.col("_end") - F.col("_words") <= F.col("_rest")) & (F.col("_words") > 0))
    border = stage(border.select("_pattern", "_bucket", "_rest", (F.col("_end") - F.col("_words")).alias("_before")), "mix-borders")
    in_order = Window.partitionBy("_pattern").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    near = (
        light.withColumn("_bucket", bucket)
        .join(border, ["_pattern", "_bucket"])
        .groupBy("_pattern", "_order", "_before", "_rest")
        .agg(F.sum("_size").alias("_size"))
        .withColumn("_end", F.col("_before") + F.sum("_size").over(in_order))
        .where(2 * F.col("_end") - F.col("_size") <= 2 * F.col("_rest"))
        .groupBy("_pattern")
        .agg(F.max("_order").alias("_last_near"))
    )
    first = border.select("_pattern", F.lpad(F.lower(F.conv(F.col("_bucket"), 10, 16)), 3, "0").alias("_first"))
    cuts = (
        plan.join(first, "_pattern", "left")
        .join(near, "_pattern", "left")
        .withColumn("_last", F.coalesce("_last_near", "_first", F.lit("")))
        .select("_pattern", "_total", "_target", "_passes", "_last")
    )
    cuts = stage(cuts, "mix-cuts")
    chosen = docs.join(cuts, "_pattern", "left")
    repeats = (F.coalesce("_passes", F.lit(0)) + F.when(F.col("_order") <= F.col("_last"), 1).otherwise(0)).cast("int")
    return put(
        chosen,
        mix_size=F.col("_size"),
        mix_pattern_size=F.coalesce("_total", F.lit(0)),
        mix_target=F.coalesce("_target", F.lit(0.0)),
        mix_repeats=F.least(repeats, F.lit(passes)),
        mix_taken=F.least(repeats, F.lit(passes)) * F.col("_size"),
    ).drop("_pattern", "_size", "_order", "_total", "_target", "_passes", "_last")
