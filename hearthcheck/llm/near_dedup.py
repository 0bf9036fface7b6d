"""Near-duplicate groups by order MinHash and banded alignment.

A text's five-word shingles are labelled with their occurrence number. Each of ``SKETCHES`` sketches takes the ``DEPTH``
labelled shingles of smallest seeded hash and keeps them in text order, so texts meet in a bucket only if they share those
shingles in the same order. Two texts are linked if the share of shingles that a banded alignment matches in order, among
all shingles of both, is at least ``SIMILARITY``. Groups are the connected components of links.

Equal word sequences are one node from the start (combined on the map side), so a large group of copies costs one row per
task. In a bucket every text is compared with one leader, the one that meets most others. Where a bucket then still holds
several components, buckets of at most ``SMALL`` texts compare all pairs across components; in larger ones each text
outside the largest component first meets ``DRAWS`` seeded leaders, which only joins components early. Buckets that still
hold several components then settle every pair across them, in blocks of ``SIDE`` x ``SIDE`` texts dealt to tasks: so any
two texts of one bucket are compared, known to be in one component, or ruled out without loss. What rules out is an upper
bound of the similarity, from shingle counts alone, and in large buckets from how many shingles fall into each of ``BINS``
classes: two texts share no more than the smaller number of each class. Leaders of many pairs are dealt out in parts by
their counted pairs.

Texts without words are grouped when equal character by character; texts of fewer than five words have one shingle. Null
text counts as empty. Null ids rank last; of repeated rows one stays. No rows give no rows. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from hearthcheck.llm.common import mixed, rows_of, shingles, slices, stored, word_hashes

WIDTH = 5
SKETCHES = 20
DEPTH = 4
SIMILARITY = 0.8
PART_PAIRS = 256
SMALL = 32
DRAWS = 4
SIDE = 2048
BINS = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def labelled(words: np.ndarray) -> np.ndarray:
    """Shingle hashes in text order, made distinct by their occurrence number."""
    runs = shingles(words, WIDTH)
    order = np.argsort(runs, kind="stable")
    sorted_runs = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = sorted_runs[1:] != sorted_runs[:-1]
    place = np.arange(len(runs))
    nth = np.zeros(len(runs), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(nth > 0, mixed(runs + nth * _ODD), runs)


def order_sketches(labels: np.ndarray) -> np.ndarray:
    """One bucket per sketch: a hash of the smallest labelled shingles, in text order."""
    if not len(labels):
        return np.zeros(0, np.int64)
    depth = min(DEPTH, len(labels))
    ranks = (labels[None, :] ^ _SEEDS[:, None]) * _SEEDS[:, None]
    chosen = np.sort(np.argpartition(ranks, depth - 1, axis=1)[:, :depth], axis=1)
    bucket = _SEEDS.copy()
    for k in range(depth):
        bucket = mixed(bucket * _ODD + labels[chosen[:, k]])
    return bucket.view(np.int64)


def longest_rise(values: list[int]) -> int:
    tails: list[int] = []
    for x in values:
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> float:
    """Share of shingles matched in order within the band; below ``least`` an upper bound of it may be given.

    Each text is (sorted labels, their places). At the threshold no match lies further off the diagonal than a fifth of
    the longer text, so the band loses nothing.
    """
    na, nb = len(a[0]), len(b[0])
    if not na or not nb:
        return 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(ia) / (na + nb - len(ia)) < least:
        return len(ia) / (na + nb - len(ia))
    pa_, pb = a[1][ia], b[1][ib]
    near = np.abs(pa_ - pb) <= np.ceil((1 - least) * max(na, nb))
    pa_, pb = pa_[near], pb[near]
    pb = pb[np.argsort(pa_)]
    m = len(pb) if (np.diff(pb) > 0).all() else longest_rise(pb.tolist())
    return m / (na + nb - m)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "lower"):
        lower = batch.column("lower")
        words, offsets = word_hashes(lower)
        raw, sigs, sizes, buckets = lower.to_pylist() if np.any(np.diff(offsets) == 0) else None, [], [], []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = words[a:b]
            what = own.tobytes() if b > a else b"\0" + (raw[k] or "").encode("utf-8", "replace")
            sigs.append(hashlib.blake2b(what, digest_size=16).digest())
            labels = labelled(own)
            sizes.append(len(labels))
            buckets.append(order_sketches(labels))
        lengths = np.concatenate([[0], np.cumsum([len(x) for x in buckets])])
        nested = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(buckets) if buckets else []))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), nested], ["doc", "sig", "size", "buckets"]
        )


def _compare(least: float):
    """Rows sorted by leader, part and kind: a leader's own text comes first, then those it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_key = None, None
        for batch in slices(batches, "lower"):
            words, offsets = word_hashes(batch.column("lower"))
            out = []
            for k, (leader, part, node) in enumerate(zip(*(rows_of(batch, x) for x in ("leader", "part", "node")))):
                labels = labelled(words[offsets[k] : offsets[k + 1]])
                order = np.argsort(labels)
                own = (labels[order], order)
                if node is None:
                    head, head_key = own, (leader, part)
                    continue
                if head_key != (leader, part):
                    raise ValueError("A leader's text is missing.")
                out.append((leader, node, similarity(head, own, least)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["leader", "node", "similarity"]
                )

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """leader, node, similarity of distinct pairs; each text of a pair moves once, leaders once per part."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PART_PAIRS).cast("long").alias("parts"))
    members = pairs.join(parts, "leader").join(texts, F.col("node") == F.col("row")).select(
        "leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", "lower"
    )
    heads = parts.join(texts, F.col("leader") == F.col("row")).select(
        "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "lower"
    )
    dealt = members.unionByName(heads).repartition("leader", "part")
    dealt = dealt.sortWithinPartitions("leader", "part", F.col("node").asc_nulls_first())
    return stored(dealt.mapInArrow(_compare(least), "leader long, node long, similarity double"), "near-pairs")


def _shared(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, node, size, nodes) of buckets with two nodes or more, with the number of nodes."""
    members = nodes.where("size > 0").select(F.explode("buckets").alias("bucket"), "node", "size")
    many = members.groupBy("bucket").agg(F.count("*").alias("nodes")).where("nodes > 1")
    return members.join(many, "bucket")


def _possible(a: str, b: str, least: float):
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def _first_pairs(members: DataFrame, least: float) -> DataFrame:
    """(leader, node): each node of a bucket with the one that meets most others."""
    degree = members.groupBy("node").agg(F.sum(F.col("nodes") - 1).alias("degree"))
    leaders = (
        members.join(degree, "node").groupBy("bucket")
        .agg(F.max(F.struct(F.col("degree"), (-F.col("node")).alias("node"), F.col("size"))).alias("top"))
        .select("bucket", (-F.col("top.node")).alias("leader"), F.col("top.size").alias("leader_size"))
    )
    led = members.join(leaders, "bucket").where(F.col("node") != F.col("leader"))
    return led.where(_possible("size", "leader_size", least)).select("leader", "node").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets of several components, with their label and that of the bucket's largest component."""
    labelled_rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = labelled_rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    split = (
        counted.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
        .select("bucket", F.col("top.label").alias("main"))
    )
    return stored(labelled_rows.join(split, "bucket").select("bucket", "node", "size", "nodes", "label", "main"), "near-open")


def _further_pairs(members: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(leader, node) in buckets that still hold several components.

    In buckets of at most ``SMALL`` nodes all pairs across components; in larger ones each node outside the largest
    component with ``DRAWS`` seeded leaders of the bucket; ``_remaining_pairs`` gives the others.
    """
    open_rows = _open(members, labels)
    small, large = open_rows.where(F.col("nodes") <= SMALL), open_rows.where(F.col("nodes") > SMALL)
    other = small.select("bucket", F.col("node").alias("leader"), F.col("size").alias("leader_size"), F.col("label").alias("leader_label"))
    all_of_small = small.where(F.col("label") != F.col("main")).join(other, "bucket")
    drawn = large.groupBy("bucket").agg(
        F.array(*(F.max(F.struct(F.xxhash64(F.lit(k), "node").alias("draw"), F.col("node"), F.col("size"), F.col("label"))) for k in range(DRAWS))).alias("drawn")
    )
    drawn = drawn.select("bucket", F.explode("drawn").alias("d")).select(
        "bucket", F.col("d.node").alias("leader"), F.col("d.size").alias("leader_size"), F.col("d.label").alias("leader_label")
    )
    some_of_large = large.where(F.col("label") != F.col("main")).join(drawn, "bucket")
    met = all_of_small.unionByName(some_of_large)
    return met.where((F.col("label") != F.col("leader_label")) & _possible("size", "leader_size", least)).select("leader", "node").distinct()


def class_counts(labels: np.ndarray) -> tuple[bytes, int]:
    """How many shingles fall into each of ``BINS`` classes, one byte each, and the sum of what is above a byte."""
    counts = np.bincount((labels & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    held = np.minimum(counts, 255)
    return held.astype(np.uint8).tobytes(), int((counts - held).sum())


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "lower"):
        words, offsets = word_hashes(batch.column("lower"))
        found = [class_counts(labelled(words[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        held, above = pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), held, above], ["row", "held", "above"])


def _may_match(least: float):
    """(leader, node) across components in a pair of blocks of one bucket, but for pairs which the class counts rule out."""

    def run(block: pa.Table) -> pa.Table:
        node, size, label, part, above = (block.column(x).to_numpy() for x in ("node", "size", "label", "part", "above"))
        counts = np.frombuffer(b"".join(block.column("held").to_pylist()), np.uint8).reshape(-1, BINS)
        one = len(set(part.tolist())) == 1
        own = block.column("a").to_numpy()
        left = np.flatnonzero(part == own)
        right = left if one and own[0] == block.column("b")[0].as_py() else np.flatnonzero(part != own)
        right = right[np.argsort(size[right], kind="stable")]
        sizes, pairs = size[right], []
        for x in left.tolist():
            low = np.searchsorted(sizes, least * size[x] * (1 - 1e-9))
            high = np.searchsorted(sizes, size[x] / least * (1 + 1e-9), side="right")
            near = right[low:high]
            near = near[(label[near] != label[x]) & ((node[near] > node[x]) | (part[near] != part[x]))]
            for k in range(0, len(near), 512):
                some = near[k : k + 512]
                most = np.minimum(counts[some], counts[x]).sum(axis=1, dtype=np.int64) + np.minimum(above[some], above[x])
                some = some[most >= least * (size[some] + size[x] - most) * (1 - 1e-9)]
                pairs.append(np.stack([np.full(len(some), node[x]), node[some]]))
        found = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        return pa.table({"leader": pa.array(found[0]), "node": pa.array(found[1])})

    return run


def _remaining_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(leader, node) of all pairs across components in large buckets that may be similar enough."""
    rows = _open(members.where(F.col("nodes") > SMALL), labels)
    wanted = rows.select(F.col("node").alias("row")).distinct().hint("merge")
    counts = texts.join(wanted, "row", "left_semi").mapInArrow(_class_counts, "row long, held binary, above long")
    parts = F.ceil(F.col("nodes") / SIDE).cast("long")
    placed = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # each block meets each: a node goes to the pairs (a, b), a <= b, that hold its own block
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("bucket", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "node", "size", "label", "part")
    met = met.join(counts.hint("merge"), F.col("node") == F.col("row")).drop("row")
    return met.groupBy("bucket", "a", "b").applyInArrow(_may_match(least), "leader long, node long").distinct()


def _unseen(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """The distinct pairs which ``done`` does not hold either way round."""
    keyed = pairs.withColumn("hi", F.greatest("leader", "node")).withColumn("lo", F.least("leader", "node"))
    seen = done.select(F.greatest("leader", "node").alias("hi"), F.least("leader", "node").alias("lo")).distinct()
    fresh = keyed.join(seen, ["hi", "lo"], "left_anti").groupBy("hi", "lo").agg(F.min("leader").alias("leader"))
    return fresh.select("leader", F.when(F.col("leader") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("node"))


def _links(sketched: DataFrame, nodes: DataFrame, text_col: str, least: float) -> DataFrame:
    """Verified links (leader, node) between nodes."""
    members = stored(_shared(nodes), "near-buckets")
    texts = sketched.select("row", F.lower(F.col("doc").getField(text_col)).alias("lower"))
    # never broadcast: the nodes grow with the corpus, and one plan should hold at every size
    wanted = members.select(F.col("node").alias("row")).distinct().hint("merge")
    texts = stored(texts.join(wanted, "row", "left_semi"), "near-texts")
    done = verified(_first_pairs(members, least), texts, least)
    near = done.where(F.col("similarity") >= least).select("leader", "node")
    more = verified(_unseen(_further_pairs(members, components(near), least), done), texts, least)
    done = done.unionByName(more)
    near = done.where(F.col("similarity") >= least).select("leader", "node")
    rest = stored(_unseen(_remaining_pairs(members, components(near), texts, least), done), "near-rest")
    more = verified(rest, texts, least)
    return near.unionByName(more.where(F.col("similarity") >= least).select("leader", "node"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component, by passing labels along links and jumping over labels."""
    edges = stored(links.select(F.col("leader").alias("u"), F.col("node").alias("v")).unionByName(links.select(F.col("node"), F.col("leader"))
                   .toDF("u", "v")).distinct(), "near-edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "near-labels")
    while True:
        passed = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("passed"))
        new = labels.join(passed, labels["node"] == passed["u"]).select("node", F.col("label").alias("old"), F.least("label", "passed").alias("label"))
        new = stored(new, "near-labels")
        up = new.select(F.col("node").alias("at"), F.col("label").alias("above"))
        jumped = stored(new.join(up, new["label"] == up["at"]).select("node", "old", F.least("label", "above").alias("label")), "near-labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The written rows, and for each of their nodes its class."""
    packed = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc"), F.lower(F.col(text_col)).alias("lower"))
    sketched = packed.mapInArrow(_sketch, _sketch_schema(packed))
    sketched = stored(sketched.withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    doc_id = F.col("doc").getField(id_col).cast("long")
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("row"))
    firsts = sketched.groupBy("sig").agg(F.min(rank).alias("first"), F.count("*").alias("copies"))
    nodes = stored(
        firsts.join(sketched.select("row", "size", "buckets"), F.col("first.row") == F.col("row"))
        .select("sig", F.col("row").alias("node"), "first", "copies", "size", "buckets"), "near-nodes"
    )
    labels = components(_links(sketched, nodes, text_col, least))
    told = nodes.select("sig", "node", "first", "copies").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    groups = told.groupBy("group").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"))
    return sketched, told.join(groups, "group").select("sig", "keep", "class_size")


def _sketch_schema(packed: DataFrame):
    return StructType([packed.schema["doc"], StructField("sig", BinaryType()), StructField("size", LongType()), StructField("buckets", ArrayType(LongType()))])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its group), class_size, kept."""
    sketched, classes = _grouped(docs.select(id_col, text_col), id_col, text_col, least)
    rows = sketched.select(F.col("doc").getField(id_col).cast("long").alias("doc_id"), "row", "sig")
    return rows.join(classes, "sig").select(
        "doc_id", F.col("keep.id").alias("class_id"), "class_size", (F.col("row") == F.col("keep.row")).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    sketched, classes = _grouped(docs, id_col, text_col, least)
    kept = classes.select(F.col("keep.row").alias("row")).distinct()
    return sketched.join(kept, "row", "left_semi").select("doc.*")
