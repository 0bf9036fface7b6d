"""Mixing sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources they belong to). Word capacity flows from patterns to
source quotas: a pattern's words can be used once for nothing and repeated at a rising cost, so the cheapest flow that
meets the quotas repeats as little as possible. The amount routed through a pattern is then filled with whole documents
in seeded order. What is summed per pattern, not the documents, reaches the driver (at most ``MOST_PATTERNS`` rows).

Selection needs no global sort: seeded hashes are cut into bins of about ``BIN_ROWS`` documents; bins below the one where
the running total crosses the amount are taken whole, bins above are left, and in that one bin documents are taken in
seeded order while they fit. So the words taken differ from the amount by less than the smallest document left.

Null text has size 0 and is never taken; a null source is a source of its own, ranked last. Repeated rows are documents
of their own. Sources without words get target 0. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthcheck.llm.common import stored

MOST_PATTERNS = 100_000
BIN_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_260


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((x for x in sources if x is not None)) + [None] * (None in sources)


def targets(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Quotas by weight, none above ``most`` times its source; what is cut off goes to the others by weight."""
    left, out, open_ = share * sum(sizes.values()), {}, {x for x in sizes if weights[x] > 0}
    out = dict.fromkeys(sizes, 0.0)
    while open_:
        total = sum(weights[x] for x in open_)
        over = {x for x in open_ if left * weights[x] / total > most * sizes[x]}
        if not over:
            return out | {x: left * weights[x] / total for x in open_}
        for x in over:
            out[x] = float(most * sizes[x])
        left -= sum(out[x] for x in over)
        open_ -= over
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quotas: list[int], costs: Sequence[int] = (0, 1)) -> list[dict[int, int]]:
    """Words routed from each pattern to each of its sources.

    Level k of a pattern holds its capacity once more at cost ``costs[k]`` a word. Successive cheapest paths with
    node potentials; every path carries the most it can.
    """
    n, m = len(capacity), len(quotas)
    end = n + m + 1
    edges: list[list] = []
    near: list[list[int]] = [[] for _ in range(end + 1)]

    def link(a: int, b: int, room: int, cost: int) -> None:
        near[a].append(len(edges))
        edges.append([b, room, cost])
        near[b].append(len(edges))
        edges.append([a, 0, -cost])

    for p, room in enumerate(capacity):
        for cost in costs:
            link(0, 1 + p, room, cost)
    routes = {}
    for p, sources in enumerate(members):
        for s in sources:
            routes[p, s] = len(edges)
            link(1 + p, 1 + n + s, len(costs) * capacity[p], 0)
    for s, quota in enumerate(quotas):
        link(1 + n + s, end, quota, 0)
    height = [0] * (end + 1)
    while True:
        far, came, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for e in near[a]:
                b, room, cost = edges[e]
                there = d + cost + height[a] - height[b]
                if room and (b not in far or there < far[b]):
                    far[b], came[b] = there, e
                    heappush(heap, (there, b))
        if end not in far:
            break
        for a, d in far.items():
            height[a] += d
        path, a = [], end
        while a:
            path.append(came[a])
            a = edges[came[a] ^ 1][0]
        most = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= most
            edges[e ^ 1][1] += most
    flow: list[dict[int, int]] = [{} for _ in capacity]
    for (p, s), e in routes.items():
        if edges[e ^ 1][1]:
            flow[p][s] = edges[e ^ 1][1]
    return flow


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bin, in seeded order, the documents that still fit."""
    rows = rows.sort_values(["place", "doc_id", "row"], kind="stable")
    left, chosen = int(rows["need"].iloc[0]), []
    for size in rows["size"].tolist():
        fits = 0 < size <= left
        left -= size * fits
        chosen.append(fits)
    return rows[["row"]][chosen]


def mix(
    docs: DataFrame,
    memberships: Column,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
    whole: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, pattern, source_size, target, copies, taken, and with ``whole`` its row as ``doc``.

    ``memberships`` is an array of the sources a document belongs to; with one source, ``source_size`` and ``target`` are
    that source's, with more they are those of the first by rank.
    """
    spark = docs.sparkSession
    # equal hashes fall together; the row number of the written table tells repeated rows apart
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array_sort(memberships).alias("pattern"),
        word_count(F.col("text")).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 24).alias("place"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc")] if whole else []),
    )
    slim = stored(slim, "mix-sizes")
    summed = slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(summed) > MOST_PATTERNS:
        raise ValueError(f"More than {MOST_PATTERNS} membership patterns.")
    summed.sort(key=lambda r: [(x is None, x or "") for x in r["pattern"]])
    names = ranked({x for r in summed for x in r["pattern"]})
    number = {x: k for k, x in enumerate(names)}
    sizes = {x: sum(r["words"] for r in summed if x in r["pattern"]) for x in names}
    quotas = targets(sizes, {x: weights[k % len(weights)] for k, x in enumerate(names)}, share, most)
    flow = min_cost_flow(
        [r["words"] for r in summed], [[number[x] for x in r["pattern"]] for r in summed], [round(quotas[x]) for x in names],
        costs=tuple(range(most)),
    )
    plan = []
    for k, r in enumerate(summed):
        first = next((x for x in names if x in r["pattern"]), None)
        used = sum(flow[k].values())
        base = min(used // r["words"], most) if r["words"] else 0
        need = used - base * r["words"]
        bins = max(1, r["n"] // BIN_ROWS)
        plan.append((r["pattern"], sizes.get(first, 0), float(quotas.get(first, 0.0)), int(base), int(need), bins))
    kinds = "pattern array<string>, source_size long, target double, base long, need long, bins long"
    planned = F.broadcast(spark.createDataFrame(plan, kinds))
    slim = slim.join(planned.withColumnRenamed("pattern", "planned"), F.col("pattern").eqNullSafe(F.col("planned"))).drop("planned")
    slim = slim.withColumn("bin", F.floor(F.col("place") * F.col("bins") / F.lit(float(1 << 40))))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    binned = slim.groupBy("pattern", "bin", "need").agg(F.sum("size").alias("words"))
    binned = binned.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = (
        binned.where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need")))
        .groupBy("pattern").agg(F.min("bin").alias("edge_bin"), F.min_by(F.col("need") - F.col("before"), "bin").alias("edge_need"))
    )
    # at most one row per pattern
    slim = slim.join(F.broadcast(edge.withColumnRenamed("pattern", "edge_of")), F.col("pattern").eqNullSafe(F.col("edge_of")), "left")
    inside = slim.where(F.col("bin") == F.col("edge_bin")).select("pattern", "row", "doc_id", "place", "size", F.col("edge_need").alias("need"))
    fitted = inside.groupBy("pattern").applyInPandas(_fit, "row long").withColumn("fits", F.lit(1))
    extra = F.when(F.col("bin") < F.col("edge_bin"), 1).otherwise(F.coalesce("fits", F.lit(0)))
    return slim.join(fitted, "row", "left").select(
        "doc_id", "row", "size", "pattern", "source_size", "target",
        F.when(F.col("size") > 0, F.col("base") + extra).otherwise(0).alias("copies"),
        F.when(F.col("size") > 0, F.col("size") * (F.col("base") + extra)).otherwise(0).alias("taken"),
        *(["doc"] if whole else []),
    )


def mixed_rows(docs: DataFrame, memberships: Column, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    chosen = mix(docs, memberships, whole=True, **options).where("copies > 0")
    return chosen.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")
