"""Hard negatives by exact search in cover trees over norm-augmented vectors.

Each candidate x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm around, and an anchor q gets 0 there:
then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so distances order candidates as inner products do and a ball around a node bounds
the products of everything below it.

Candidates are dealt to groups of bounded size by the nearest of a few centres (fitted on a bounded seeded sample; they only
decide which rows share a tree) and, where a centre attracts more than a group holds, by a hash of the id. Per group a
cover tree is built and written: children of a node cover its members within half its radius, leaves keep their members
by distance from their centre, cut into rings. All rows are in a tree, and every search is exact.

Blocks of anchors meet every group. A tree is searched best first for a whole block: a node is opened with those anchors
whose windows and best rows so far its bounds do not rule out; rings that remain are verified by exact integer products.
A first search finds the positives (best rows of the anchor's label), a second one the best rows of other labels within
the window of each positive. Only the best few rows per anchor, window and group leave a task.

Rows with a null id, label or vector or with a null or non-finite component take no part. Rows that repeat an id count
once, as the one with the smallest label, then vector. Vectors of different lengths are compared as if padded with
zeros. Products are exact up to 2^53; beyond that they are rounded doubles held within a long. Ties go to the smaller id. An
anchor without another row of its label gives no rows, and neither does a positive with an empty window. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthcheck.llm.common import stored

GROUP_ROWS = 16_384
ANCHOR_ROWS = 2_048
SAMPLE_ROWS = 256  # centres are chosen among so many rows
LEAF = 64
RING = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # a negative scores at least this share of the positive, in hundredths
_TOP_LONG = float(2**63 - 1024)


# ---------------------------------------------------------------------- rows


def _times_256(x: Column) -> Column:
    """floor(256 x) as a double; from 2^52 on doubles are whole, and a long could not hold all of them."""
    scaled = x * 256.0
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)


def candidates(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the rows that take part, once per id, components as whole numbers."""
    kept = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    ).where("vec_id is not null and label is not null and vec is not null")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("vec", _times_256)
    once = kept.where(~odd).select("vec_id", "label", whole.alias("vec")).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return once.select("vec_id", F.col("r.label").alias("label"), F.col("r.vec").alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to the common width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


# ---------------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes of a cover tree over members in leaf order; an inner node's children are consecutive nodes."""

    centre: np.ndarray
    radius: np.ndarray
    kids: np.ndarray
    span: np.ndarray
    order: np.ndarray
    far: np.ndarray  # of each member in leaf order, the distance from its leaf's centre
    top2: float  # M^2, the largest squared norm


def augmented(x: np.ndarray) -> tuple[np.ndarray, float]:
    norms = (x * x).sum(axis=1)
    top = float(norms.max(initial=0.0))
    return np.hstack([x, np.sqrt(np.maximum(top - norms, 0.0))[:, None]]), top


def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def _net(points: np.ndarray, radius: float, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """Greedy cover by balls of ``radius`` around members: (centre, members, distances) each.

    None when it would need more than ``most`` balls.
    """
    balls, left = [], np.arange(len(points))
    while len(left):
        if len(balls) == most:
            return None
        centre = points[left[0]]
        far = _distance(points[left], centre)
        inside = far <= radius
        balls.append((centre, left[inside], far[inside]))
        left = left[~inside]
    return balls


def cover_tree(points: np.ndarray, top2: float, leaf: int = LEAF) -> Tree:
    """Levels halve the covering radius. A node whose members no few balls of half its radius cover is a leaf."""
    centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
    waiting = [(centre, np.arange(len(points)), _distance(points, centre))]
    radius, kids, span, order, distances, at, k = [], [], [], [], [], 0, 0
    while k < len(waiting):
        centre, members, far = waiting[k]
        size = float(far.max(initial=0.0))
        balls = None
        if len(members) > leaf and size > 0:
            some = points[members[:: max(1, len(members) // leaf)]]
            if _net(some, size / 2, len(some) // 2) is not None:
                balls = _net(points[members], size / 2, len(members) // 4)
        radius.append(size)
        if balls is None:
            sort = np.argsort(far, kind="stable")
            order.append(members[sort])
            distances.append(far[sort])
            kids.append((0, 0))
            span.append((at, at + len(members)))
            at += len(members)
        else:
            kids.append((len(waiting), len(waiting) + len(balls)))
            span.append((0, 0))
            waiting.extend((c, members[inside], near) for c, inside, near in balls)
        k += 1
    centres = np.array([w[0] for w in waiting])
    return Tree(centres, np.array(radius), np.array(kids), np.array(span), np.concatenate(order), np.concatenate(distances), top2)


class _Best:
    """The best k (score, id) per anchor and window."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), -np.inf)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def needed(self, rows: np.ndarray, bottom: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Which anchors may still gain from rows scoring between ``bottom`` and ``top``."""
        least = np.maximum(self.low[rows], self.score[rows, :, -1])
        return ((top[:, None] >= least) & (bottom[:, None] <= self.high[rows])).any(axis=1)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            least, last = self.score[rows, w, -1][:, None], self.id[rows, w, -1][:, None]
            good = allowed & (scores >= self.low[rows, w][:, None]) & (scores <= self.high[rows, w][:, None])
            good &= (scores > least) | ((scores == least) & (ids < last))
            r, c = np.nonzero(good)
            if not len(r):
                continue
            some, place = np.unique(r, return_inverse=True)
            who = rows[some]
            score = np.concatenate([self.score[who, w].ravel(), scores[r, c]])
            ident = np.concatenate([self.id[who, w].ravel(), ids[c]])
            owner = np.concatenate([np.repeat(np.arange(len(who)), self.k), place])
            sort = np.lexsort((ident, -score, owner))
            first = np.searchsorted(owner[sort], np.arange(len(who)))
            keep = sort[first[:, None] + np.arange(self.k)]
            self.score[who, w], self.id[who, w] = score[keep], ident[keep]


def search(tree: Tree, members: tuple, anchors: tuple, best: _Best, same: bool, opened: list | None = None) -> None:
    """Best-first descent for a block of anchors; members and anchors are (ids, labels, vectors), members in leaf order.

    What waits in the heap is a node, or a ring of a leaf as (start, stop), with the anchors it can still serve.
    """
    ids, labels, x = members
    q_ids, q_labels, q = anchors
    qq = (q * q).sum(axis=1)
    slack = 1e-6 * (qq + tree.top2) + 1e-6  # far above what rounding can do to a bound
    heap: list[tuple] = []
    ticks = count()

    def offer(what: int | tuple[int, int], rows: np.ndarray, distance: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        total = qq[rows] + tree.top2
        top, bottom = (total - np.maximum(near, 0.0) ** 2) / 2 + slack[rows], (total - far**2) / 2 - slack[rows]
        use = best.needed(rows, bottom, top)
        if use.any():
            heapq.heappush(heap, (-float(top[use].max()), next(ticks), what, rows[use], distance[use], bottom[use], top[use]))

    def to_centres(rows: np.ndarray, start: int, stop: int) -> np.ndarray:
        c = tree.centre[start:stop]
        return np.sqrt(np.maximum(qq[rows][:, None] + (c * c).sum(axis=1) - 2 * q[rows] @ c[:, :-1].T, 0.0))

    rows = np.arange(len(q))
    d = to_centres(rows, 0, 1)[:, 0]
    offer(0, rows, d, d - tree.radius[0], d + tree.radius[0])
    while heap:
        _, _, what, rows, distance, bottom, top = heapq.heappop(heap)
        use = best.needed(rows, bottom, top)
        rows, distance = rows[use], distance[use]
        if not len(rows):
            continue
        if opened is not None:
            opened.append((what, len(rows)))
        if isinstance(what, tuple):
            ring = slice(*what)
            scores = np.clip(q[rows] @ x[ring].T, -_TOP_LONG, _TOP_LONG)
            allowed = ((q_labels[rows][:, None] == labels[ring]) == same) & (q_ids[rows][:, None] != ids[ring])
            best.take(rows, scores, ids[ring], allowed)
            continue
        start, stop = tree.kids[what]
        if stop > start:
            away = to_centres(rows, start, stop)
            for k in range(start, stop):
                d = away[:, k - start]
                offer(k, rows, d, d - tree.radius[k], d + tree.radius[k])
        start, stop = tree.span[what]
        for at in range(start, stop, RING):
            end = min(at + RING, stop)
            inner, outer = tree.far[at], tree.far[end - 1]
            offer((at, end), rows, distance, np.maximum(distance - outer, inner - distance), distance + outer)


# ---------------------------------------------------------------------- on Spark

_MEMBER = "g int, pos int, vec_id long, label long, vec array<double>, tree binary"


def _grouped(rows: DataFrame, width: int, group_rows: int) -> tuple[DataFrame, int]:
    """Rows with their group ``g``, and the number of groups."""
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return rows.withColumn("g", F.lit(0)), 1
    share = int(min(1.0, SAMPLE_ROWS / total) * (1 << 20)) + 1
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) < share).select("vec_id", "vec").orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS)
    points = matrix(sample.toArrow().column("vec"), width)
    centres = np.zeros((1, width))
    if len(points):  # the coarsest net of at most so many balls
        size = float(_distance(points, points.mean(axis=0)).max()) * 2
        centres = points[:1]
        while (balls := _net(points, size, max(1, SAMPLE_ROWS // 8))) is not None and size > 0:
            centres, size = np.array([b[0] for b in balls]), size / 2
            if len(centres) == len(points):
                break
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = matrix(batch.column("vec"), width)
            cell = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "label", "vec", "cell"])

    placed = stored(rows.select("vec_id", "label", "vec").mapInArrow(nearest, "vec_id long, label long, vec array<double>, cell int"), "vector-cells")
    deal, g, room = [], 0, 0
    for cell, n in sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect()):  # at most SAMPLE_ROWS
        if n > group_rows:
            parts = -(-n // group_rows)
            g, room = g + bool(room), 0
            deal.append((cell, g, parts))
            g += parts
            continue
        if room + n > group_rows:
            g, room = g + 1, 0
        deal.append((cell, g, 1))
        room += n
    groups = g + bool(room)
    table = F.broadcast(spark.createDataFrame(deal, "cell int, first int, parts int"))
    dealt = placed.join(table, "cell").withColumn("g", (F.col("first") + F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.col("parts"))).cast("int"))
    return dealt.select("vec_id", "label", "vec", "g"), groups


def build_index(rows: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int, int]:
    """The written trees of all rows (as from ``candidates``), the number of groups, and the common width."""
    width = int(rows.agg(F.max(F.size("vec"))).first()[0] or 1)
    dealt, groups = _grouped(rows, width, group_rows)

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec"), width)
        lifted, top2 = augmented(x)
        tree = cover_tree(lifted, top2)
        table = table.take(pa.array(tree.order))
        n = len(table)
        held = [pickle.dumps(tree)] + [None] * (n - 1)
        columns = [pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32))]
        columns += [table.column(c) for c in ("vec_id", "label", "vec")]
        return pa.table([*columns, pa.array(held, pa.binary())], ["g", "pos", "vec_id", "label", "vec", "tree"])

    return stored(dealt.groupBy("g").applyInArrow(plant, _MEMBER), "cover-trees"), groups, width


def _searched(index: tuple[DataFrame, int, int], anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """The best k per anchor, window and group: (anchor_id, window, score, vec_id).

    ``anchors``: (anchor_id, label, vec, lows, highs), the last two one number per window.
    """
    trees, groups, width = index

    def find(table: pa.Table, wanted: pa.Table) -> pa.Table:
        out = _Best(np.zeros((0, 1)), np.zeros((0, 1)), k)
        q_ids = np.zeros(0, np.int64)
        if len(table) and len(wanted):
            table = table.sort_by("pos")
            tree = pickle.loads(table.column("tree")[0].as_py())
            members = (*(table.column(c).to_numpy() for c in ("vec_id", "label")), matrix(table.column("vec"), width))
            q_ids = wanted.column("anchor_id").to_numpy()
            count_of = max(len(x) for x in wanted.column("lows").to_pylist())
            low, high = matrix(wanted.column("lows"), count_of), matrix(wanted.column("highs"), count_of)
            none = np.arange(count_of) >= np.diff(wanted.column("lows").combine_chunks().offsets.to_numpy())[:, None]
            low[none], high[none] = np.inf, -np.inf
            out = _Best(low, high, k)
            search(tree, members, (q_ids, wanted.column("label").to_numpy(), matrix(wanted.column("vec"), width)), out, same)
        a, w, n = np.nonzero(np.isfinite(out.score))
        columns = [pa.array(q_ids[a]), pa.array(w.astype(np.int32)), pa.array(out.score[a, w, n].astype(np.int64)), pa.array(out.id[a, w, n])]
        return pa.table(columns, ["anchor_id", "window", "score", "vec_id"])

    block = F.pmod(F.xxhash64(F.lit(11), "anchor_id"), F.lit(blocks)).cast("int")
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return (
        left.groupBy("g", "block").cogroup(right.groupBy("g", "block"))
        .applyInArrow(find, "anchor_id long, window int, score long, vec_id long")
    )


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, group_rows: int = GROUP_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for candidates as from ``candidates``."""
    rows = stored(rows, "vectors")
    index = build_index(rows, group_rows)
    anchors = rows.where(is_anchor).withColumnRenamed("vec_id", "anchor_id")
    blocks = max(1, -(-anchors.count() // anchor_rows))
    anywhere = anchors.withColumn("lows", F.array(F.lit(float("-inf")))).withColumn("highs", F.array(F.lit(float("inf"))))
    found = _first(_searched(index, anywhere, blocks, positives, True), ["anchor_id"], positives)
    # a window's ends as whole numbers: low * p <= 100 * n is n >= ceil(low * p / 100), and the same for the other end
    end = "cast(case when abs(score) < 70000000000000 then {} else score * {}D end as double)"
    lows = end.format(f"ceil(cast(score * {low} as decimal(20, 0)) / 100)", low / 100)
    highs = end.format(f"floor(cast(score * {high} as decimal(20, 0)) / 100)", high / 100)
    pairs = stored(found.select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), "score", F.expr(lows).alias("low"), F.expr(highs).alias("high")), "positives")
    windows = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))  # few per anchor
    asked = anchors.join(windows, "anchor_id").select("anchor_id", "label", "vec", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = _first(_searched(index, asked, blocks, negatives, False), ["anchor_id", "window"], negatives)
    named = pairs.select("anchor_id", (F.col("rank") - 1).alias("window"), "positive_id", F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
