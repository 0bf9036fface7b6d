"""A Merkle manifest of a corpus, and inclusion proofs found by pointer jumping.

Leaves are digests of whole rows, hashed once where the rows are read and written; after that only ids and digests move. The
rows of a source are numbered by id from a range-partitioned table (counts per partition, no window over a source), every
``FAN`` consecutive nodes make a parent, level by level, until one node per source is left: its subroot. The subroots,
ordered by source, are joined to one root the same way.

Proofs: each node above the leaves holds the digests left and right of it in its run (its sibling segment) and a
pointer to its parent. A self-join replaces a node's pointer by its parent's and appends the parent's segments, so the
distance doubles with each round until all pointers have left the root. Runs of leaves then meet the path of their parent,
once per run: a leaf's own segment comes from its run, and the long paths are never shuffled once per document.

Null fields are hashed as ``-``; the null source is a source of its own and the first; a missing id sorts first. Rows that
repeat are leaves of their own, in the order of their digests. Texts count whole, empty ones as ``0:``. Extra columns are
ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthcheck.llm.common import stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_ROWS = 4_096  # a path is a few KB, so that many ancestors are a few tens of MB
_NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


@dataclass
class Manifest:
    """Runs of leaves (tree, run, n, kids, hash), paths of their parents (node, path, subroot), and the root (one row)."""

    runs: DataFrame
    paths: DataFrame
    root: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    return digest(*(field(text if name == "text" else F.col(name)) for name in fields))


def _numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Columns ``idx`` (place within ``tree``) and ``n`` (rows of the tree) added, in the order given.

    The sorted rows are written, so that their partitions stay as they are whatever is lost or run again. A tree has one
    count per partition it reaches; those are summed up, never its rows.
    """
    tie = F.monotonically_increasing_id()  # spreads rows that are equal in all of the order
    rows = rows.withColumn("_tie", tie).repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie")
    rows = stored(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("_at", 33)
    per_part = rows.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_part.select(
        F.col("tree").alias("_tree"), "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = rows.withColumn("_of", part).join(shift, (F.col("tree") == F.col("_tree")) & (F.col("_of") == F.col("_part")))
    return joined.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_of", "_tree", "_part", "_shift")


def _runs(nodes: DataFrame, kid: list[str]) -> DataFrame:
    """Runs of up to FAN consecutive nodes of a tree: (tree, run, n, kids, hash). A lone node keeps its hash."""
    run = F.floor(F.col("idx") / FAN).cast("long")
    grouped = nodes.groupBy("tree", run.alias("run")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash", *kid))).alias("kids")
    )
    together = F.when(F.col("n") == 1, F.col("kids")[0]["hash"]).otherwise(F.sha2(F.array_join("kids.hash", ""), 256))
    return grouped.withColumn("hash", together)


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select("tree", F.col("run").alias("idx"), "hash", F.ceil(F.col("n") / FAN).cast("long").alias("n"))


def _segment(kids: Column, place: Column) -> Column:
    """Digests left and right of one node of a run."""
    left = F.array_join(F.slice(kids, F.lit(1), place), "")
    right = F.array_join(F.slice(kids, place + 2, F.lit(FAN)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _node(level: int, tree: Column, idx: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), tree.alias("tree"), idx.cast("long").alias("idx"))


def _levels(n: int | None) -> int:
    """Levels above nodes of which the largest tree has n; one at least."""
    levels, n = 1, -(-(n or 1) // FAN)
    while n > 1:
        levels, n = levels + 1, -(-n // FAN)
    return levels


def _links(runs: DataFrame, level: int, last: bool) -> DataFrame:
    """One row per kid of each run: its node, its parent, its segment (none in a run without a choice), its subroot."""
    path = F.when(F.col("n") == 1, F.expr(_NO_PATH)).otherwise(F.array(_segment(F.col("kids.hash"), F.col("place"))))
    return runs.select("*", F.posexplode("kids").alias("place", "kid")).select(
        _node(level, F.col("tree"), F.col("kid.idx")).alias("node"),
        _node(level + 1, F.col("tree"), F.col("run")).alias("up"),
        path.alias("path"),
        (F.col("hash") if last else F.lit(None).cast("string")).alias("subroot"),
    )


def build(docs: DataFrame, claim: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of all rows; ``claim`` is a text held against the manifest instead of the row's own."""
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # null first, then bytewise
    leaf, claimed = leaf_digest(F.col("text"), fields), F.lit(None).cast("string")
    if claim is not None:
        claimed = F.when(claim.eqNullSafe(F.col("text")), claimed).otherwise(leaf_digest(claim, fields))
    rows = stored(docs.select(tree.alias("tree"), F.col("doc_id"), leaf.alias("hash"), claimed.alias("claim")), "merkle-digests")
    leaves = _numbered(rows, ["doc_id", "hash"], "merkle-leaves")
    runs = stored(_runs(leaves, ["doc_id", "claim"]), "merkle-runs")
    height = _levels(runs.agg(F.max("n")).first()[0])

    links, nodes = [], _parents(runs)
    for level in range(1, height):
        above = stored(_runs(nodes, []), "merkle-level")
        links.append(_links(above, level, level + 1 == height))
        nodes = _parents(above)

    # the subroots are the leaves of one more tree; their place in it stands beside their own name
    subroots = nodes.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "hash")
    top = _numbered(subroots, ["source_tree"], "merkle-subroots")
    above = stored(_runs(top, ["source_tree"]), "merkle-top")
    rise = _levels(above.agg(F.max("n")).first()[0])
    path = F.when(F.col("n") == 1, F.expr(_NO_PATH)).otherwise(F.array(_segment(F.col("kids.hash"), F.col("place"))))
    links.append(
        above.select("*", F.posexplode("kids").alias("place", "kid")).select(
            _node(height, F.col("kid.source_tree"), F.lit(0)).alias("node"),
            _node(height + 1, F.col("tree"), F.col("run")).alias("up"),
            path.alias("path"),
            F.col("kid.hash").alias("subroot"),
        )
    )
    nodes = _parents(above)
    for level in range(height + 1, height + rise):
        above = stored(_runs(nodes, []), "merkle-top")
        links.append(_links(above, level, False))
        nodes = _parents(above)
    held = links[0]
    for more in links[1:]:
        held = held.unionByName(more)
    return Manifest(runs, jump(stored(held, "merkle-links"), height + rise - 1), nodes.select(F.col("hash").alias("root")))


def jump(links: DataFrame, height: int) -> DataFrame:
    """Paths of all nodes to the root (node, path, subroot): rounds of self-joins, each doubling the distance.

    The ancestors asked for in a round are joined by broadcast where their counted rows allow it, else by a shuffle; late
    rounds ask for few ancestors, the nodes near the root, and each of them is then wanted by very many nodes.
    """
    distance = 1
    while distance < height:
        wanted = links.where(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
        ancestors = stored(links.join(wanted, "node", "left_semi"), "merkle-ancestors")
        side = ancestors.select(
            F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("subroot").alias("_subroot")
        )
        if ancestors.count() <= BROADCAST_ROWS:
            side = F.broadcast(side)
        going, arrived = links.where(F.col("up").isNotNull()), links.where(F.col("up").isNull())
        longer = going.join(side, F.col("up") == F.col("_node"), "left").select(
            "node", F.col("_up").alias("up"),
            F.concat("path", F.coalesce("_path", F.expr(_NO_PATH))).alias("path"),
            F.coalesce("subroot", "_subroot").alias("subroot"),
        )
        links, distance = stored(longer.unionByName(arrived), "merkle-paths"), distance * 2
    return links.select("node", "path", "subroot")


def fold(start: Column, path: Column) -> Column:
    """The digest that a node's digest leads to along a path."""
    return F.aggregate(path, start, lambda digest_so_far, s: F.sha2(F.concat(s["left"], digest_so_far, s["right"]), 256))


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf where there is one), verified."""
    paths = manifest.paths.where(F.col("node.level") == 1).select(
        F.col("node.tree").alias("_tree"), F.col("node.idx").alias("_run"), "path", "subroot"
    )
    runs = manifest.runs.join(paths, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    runs = runs.select("n", "path", "subroot", siblings.alias("above"), F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("place", "kid"))
    own = F.when(F.col("n") > 1, _segment(F.col("hashes"), F.col("place")))
    rows = runs.select("subroot", "path", "above", "kid", own.alias("own"), manifest.root.scalar().alias("root"))
    claimed = F.coalesce("kid.claim", "kid.hash")
    first = F.when(F.col("own").isNull(), claimed).otherwise(digest(F.col("own.left"), claimed, F.col("own.right")))
    beside = F.coalesce(F.concat("own.left", "own.right"), F.lit(""))
    return rows.select(
        F.col("kid.doc_id").alias("doc_id"), F.col("kid.hash").alias("leaf"), "subroot", "root",
        digest(beside, F.col("above")).alias("proof_sha256"), fold(first, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
