"""Exact deduplication by Patricia tries.

Each scan task inserts the full bytes of its normalised texts into a compressed radix trie whose first bytes are a hash
of length and content; terminal nodes keep the smallest row. A subtree over budget leaves the trie as partial results.
Partials (one per distinct text, task and spill) are dealt by length and content hash, sorted, and inserted again; a
subtree is finished and leaves memory as soon as the hash moves on. So a group holding a third of all rows is one
partial per task, its members never move to one place, and equality is that of bytes, not of hashes.

Null text counts as empty, and empty texts are equal. Of repeated ids in a group one row stays; null ids rank last.
No rows give no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import rows_of, slices, stored

TRIE_BYTES = 64 << 20
_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LAST = 1 << 63


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    text = text.translate(_WHITE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def common_length(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` equal those of ``b`` from ``at``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("label", "below", "value")

    def __init__(self, label: bytes, below: dict | None = None, value: object = None):
        self.label, self.below, self.value = label, below, value


class RadixTrie:
    """A compressed radix trie over byte strings; ``held`` is the size of its labels."""

    def __init__(self) -> None:
        self.root, self.held = Node(b"", {}), 0

    def node(self, key: bytes) -> Node:
        """The terminal node of ``key``, made if need be."""
        here, at = self.root, 0
        while at < len(key):
            if here.below is None:
                here.below = {}
            edge = here.below.get(key[at])
            if edge is None:
                edge = here.below[key[at]] = Node(key[at:])
                self.held += len(edge.label) + 200
                return edge
            if not key.startswith(edge.label, at):
                same = common_length(edge.label, key, at)
                upper = Node(edge.label[:same], {edge.label[same]: edge})
                here.below[key[at]] = upper
                edge.label = edge.label[same:]
                self.held += 200
                edge = upper
            here, at = edge, at + len(edge.label)
        return here

    def terminals(self, top: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        heap = [(top, prefix + top.label)]
        while heap:
            here, key = heap.pop()
            if here.value is not None:
                yield key, here.value
            heap += [(x, key + x.label) for x in (here.below or {}).values()]

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Take the largest subtree below the root out of the trie and give its terminals."""
        size = {k: sum(len(key) + 200 for key, _ in self.terminals(x)) for k, x in self.root.below.items()}
        top = self.root.below.pop(max(size, key=size.get))
        self.held = sum(size.values()) - size[ord(top.label[:1])]
        yield from self.terminals(top)

    def drain(self) -> Iterator[tuple[bytes, object]]:
        found = self.terminals(self.root)
        self.root, self.held = Node(b"", {}), 0
        return found


def partition_key(text: bytes, digest: bytes) -> bytes:
    """Eight bytes from content and length."""
    return hashlib.blake2b(struct.pack(">Q", len(text)) + digest, digest_size=8).digest()


LOCAL = "doc_id long, row long, partial long, digest string, part binary, text binary, first_id long, first_row long, n long"
OWNERS = "partial long, keep_id long, keep_row long, group_size long"


def _rank(doc_id: int | None, row: int) -> tuple[int, int]:
    return (_LAST if doc_id is None else doc_id, row)


def _local(trie_bytes: int):
    """Members of a task with their partial, and the partials with their full text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("partial", pa.int64()), ("digest", pa.string()),
                            ("part", pa.binary()), ("text", pa.binary()), ("first_id", pa.int64()), ("first_row", pa.int64()),
                            ("n", pa.int64())])
        base = TaskContext.get().partitionId() << 33
        trie, row, partials = RadixTrie(), 0, 0

        def left(terminals: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for key, (partial, (first_id, first_row), n, _) in terminals:
                rows.append((None, None, partial, None, key[:8], key[8:], None if first_id == _LAST else first_id, first_row, n))
                size += len(key)
                if size > (8 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in slices(batches):
            members = []
            for doc_id, raw in zip(rows_of(batch, "doc_id"), batch.column("text").cast(pa.large_binary()).to_pylist()):
                text = normalised(raw or b"")
                sha = hashlib.sha256(text)
                terminal = trie.node(partition_key(text, sha.digest()) + text)
                if terminal.value is None:
                    terminal.value = [base + partials, _rank(doc_id, base + row), 0, sha.hexdigest()]
                    partials += 1
                value = terminal.value
                value[1] = min(value[1], _rank(doc_id, base + row))
                value[2] += 1
                members.append((doc_id, base + row, value[0], value[3]))
                row += 1
                while trie.held > trie_bytes:
                    yield from left(trie.spill())
            columns = [pa.array(x, f.type) for x, f in zip(zip(*members), schema)]
            columns += [pa.nulls(len(members), f.type) for f in list(schema)[4:]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        yield from left(trie.drain())

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``part``: each part is a subtree that is finished when the next one begins."""
    trie, part, out = RadixTrie(), None, []
    names = ["partial", "keep_id", "keep_row", "group_size"]

    def finish() -> None:
        for _, found in trie.drain():
            (keep_id, keep_row), total = min(x[1] for x in found), sum(x[2] for x in found)
            out.extend((x[0], None if keep_id == _LAST else keep_id, keep_row, total) for x in found)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    for batch in batches:
        columns = [rows_of(batch, x) for x in ("part", "text", "partial", "first_id", "first_row", "n")]
        for key, text, partial, first_id, first_row, n in zip(*columns):
            if key != part:
                finish()
                part = key
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            terminal = trie.node(key + text)
            if terminal.value is None:
                terminal.value = []
            terminal.value.append((partial, _rank(first_id, first_row), n))
    finish()
    if out:
        yield batch_of(out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    local = stored(slim.mapInArrow(_local(trie_bytes), LOCAL), "exact-local")
    partials = local.where(F.col("part").isNotNull()).select("part", "text", "partial", "first_id", "first_row", "n")
    owners = partials.repartition("part").sortWithinPartitions("part").mapInArrow(_owners, OWNERS)
    members = local.where(F.col("part").isNull()).select("doc_id", "row", "partial", "digest")
    return members.join(owners, "partial").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
