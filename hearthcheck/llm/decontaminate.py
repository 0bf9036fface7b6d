"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into chunks of ``CHUNK`` words; a passage is a run of chunks, one longer than the benchmark item it is held
against, from every chunk of every text. Words are hashed to ``TERMS`` terms and weighted by inverse frequency counted
over all chunks of all documents. A randomised SVD gives ``RANK`` latent dimensions, fitted on all items and on all disjoint
passages of all documents: tasks add each passage, with a random sign, to one of ``ROWS`` rows, and the rows are added per
block of terms. Every passage of every document is then projected and compared with the items by cosine.

Passages above ``COSINE`` are checked word by word: the longest common subsequence with the item has to cover ``EXACT``
of its words, or ``PARAPHRASE`` of them if the answer is there too: the item's ``answer`` where the benchmark has that
column, else its rarest words, have to stand in the passage. Items shorter than ``SHORT`` words have to stand there in
full, word after word, and are looked for directly since they are too short for a vector.

What is found does not rest on the vectors alone: an item that the word check accepts has at least one of its rarest words
in the stretch (``anchors`` says how many of them that takes), so the passage around every place of such a word, as long as
the item's passages on either side, is checked too, at every length of item and whatever ``COSINE`` leaves out. Items made of common words only make this slower, not less whole.
Of all these stretches the word check reads those with enough places of the rarer half of the item's words (``least_places``
says how many an accepted one has).

The corpus is scanned (three times), never shuffled; the benchmark is broadcast in blocks of at most about ``MOST_ITEMS`` items, one
scan each. Null or empty texts match nothing; null or empty items are matched by nothing. Repeated rows are each reported.
No rows give no rows. Other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import rows_of, slices, stored, word_hashes

CHUNK = 8
TERM_BITS = 15
TERMS = 1 << TERM_BITS
RANK = 64
ROWS = 4 * RANK
COSINE = 0.7
EXACT = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
RAREST = 0.25
RARER = 0.5
SHORT = 8
MOST_ITEMS = 4096
BLOCK = 1024
_PASSAGE = 8
_SLICE = 512 << 10


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int32)


def chunks_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all rows: the words of each chunk (a place per slot, -1 for none), and each row's first chunk."""
    lengths = np.diff(offsets)
    per_row = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(lengths)), per_row)
    start = offsets[:-1][row] + (np.arange(first[-1]) - first[row]) * CHUNK
    place = start[:, None] + np.arange(CHUNK)
    place[place >= offsets[1:][row][:, None]] = -1
    return place, first


def _summed(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Add up rows (block, values as little-endian doubles) per block of ``BLOCK`` terms; blocks without a value are absent."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["data"].iloc[0]) // 8)
        for raw in rows["data"]:
            total += np.frombuffer(raw, "<f8")
        return pd.DataFrame({"block": rows["block"].iloc[:1], "data": [total.tobytes()]})

    # two levels, so that no task adds more than its share of what all tasks counted
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = salted.groupBy("block", "salt").applyInPandas(add, "block int, data binary")
    found = some.groupBy("block").applyInPandas(add, "block int, data binary").toArrow()
    return {b.as_py(): np.frombuffer(raw.as_buffer(), "<f8").reshape(BLOCK, width) for b, raw in zip(found.column("block"), found.column("data"))}


def _parts(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, TERMS, BLOCK):
        if table[k : k + BLOCK].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // BLOCK], pa.int32()), pa.array([table[k : k + BLOCK].astype("<f8").tobytes()], pa.binary())], ["block", "data"]
            )


def term_weights(texts: DataFrame) -> np.ndarray:
    """Inverse frequency of each hashed term over all chunks of all texts (``lower``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((TERMS, 2))
        for batch in slices(batches, "lower"):
            words, offsets = word_hashes(batch.column("lower"))
            place, first = chunks_of(offsets)
            # each term once per chunk: sorted within the chunk, repeats and empty slots left out
            terms = np.where(place >= 0, np.append(terms_of(words), 0)[place], TERMS)
            terms.sort(axis=1)
            once = np.ones(terms.shape, bool)
            once[:, 1:] = terms[:, 1:] != terms[:, :-1]
            seen[:, 0] += np.bincount(terms[once], minlength=TERMS + 1)[:TERMS]
            seen[0, 1] += first[-1]
        yield from _parts(seen)

    found = np.zeros((TERMS, 2))
    for k, values in _summed(texts.select("lower").mapInArrow(run, "block int, data binary"), 2).items():
        found[k * BLOCK : (k + 1) * BLOCK] = values
    total = max(found[0, 1], 1.0)
    return np.log((total + 1) / (found[:, 0] + 0.5)).clip(0.0).astype(np.float32)


def _passages(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its term, its passage (of ``_PASSAGE`` chunks, none in two) and its weight, each passage of unit length."""
    words, offsets = word_hashes(column)
    lengths = np.diff(offsets)
    width = _PASSAGE * CHUNK
    first = np.concatenate([[0], np.cumsum(-(-lengths // width))])
    passage = np.repeat(first[:-1], lengths) + (np.arange(len(words)) - np.repeat(offsets[:-1], lengths)) // width
    terms = terms_of(words)
    value = weights[terms]
    norm = np.sqrt(np.bincount(passage, value * value, int(first[-1])))
    return terms, passage, value / np.maximum(norm, 1e-9)[passage]


def _sketch(texts: DataFrame, weights: np.ndarray, rows: int, seed: int) -> DataFrame:
    """The passages' TF-IDF matrix, each passage added with a random sign to a random one of ``rows`` rows: per block of
    ``BLOCK`` terms, terms x rows as floats. No passage is left out."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal passages of one task fall on different rows, so that copies count as often as they are there and no more
        chance = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = np.zeros(TERMS * rows, np.float32)
        for batch in slices(batches, "lower", _SLICE // 4):
            terms, passage, value = _passages(batch.column("lower"), shared.value)
            if len(terms):
                row, sign = chance.integers(0, rows, passage[-1] + 1), chance.integers(0, 2, passage[-1] + 1) * 2 - 1
                np.add.at(total, terms.astype(np.int64) * rows + row[passage], (value * sign[passage]).astype(np.float32))
        for k in range(0, TERMS, BLOCK):
            part = total[k * rows : (k + BLOCK) * rows]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "data"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(BLOCK * rows), None
        for batch in parts:
            block = batch.column("block")[:1]
            for raw in batch.column("data"):
                total += np.frombuffer(raw.as_buffer(), "<f4")
        yield pa.RecordBatch.from_arrays([block, pa.array([total.astype("<f4").tobytes()], pa.binary())], ["block", "data"])

    # as many sums as the cluster has cores, whatever the corpus: what is shuffled does not grow with it
    parts = texts.select("lower").coalesce(sc.defaultParallelism).mapInArrow(run, "block int, data binary")
    return stored(parts.groupBy("block").applyInArrow(add, "block int, data binary"), "latent-sketch")


def latent_basis(texts: DataFrame, weights: np.ndarray, rank: int = RANK, seed: int = 11, rows: int = ROWS) -> np.ndarray:
    """The first right singular vectors of the passages' TF-IDF matrix (terms x rank), by a randomised SVD of all passages.

    Those of the sketch, which is small enough for an exact one: from the sum of its blocks' Gram matrices, by tasks.
    Vectors beyond the rank are zero.
    """
    blocks = _sketch(texts, weights, rows, seed)

    def matrix(raw: pa.BinaryScalar) -> np.ndarray:
        return np.frombuffer(raw.as_buffer(), "<f4").reshape(BLOCK, rows).astype(np.float64)

    def gram(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for raw in batch.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array([((b := matrix(raw)).T @ b).tobytes()], pa.binary())], ["data"])

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, rows))
        for batch in parts:
            for raw in batch.column("data"):
                total += np.frombuffer(raw.as_buffer(), "<f8").reshape(rows, rows)
        values, own = np.linalg.eigh(total)
        scale = np.where(values > 1e-10 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([(own * scale)[:, ::-1][:, :rank].tobytes()], pa.binary())], ["data"])

    # at most one Gram matrix per block of terms
    turn = blocks.select("data").mapInArrow(gram, "data binary").groupBy().applyInArrow(solve, "data binary").toArrow().column("data")
    out = np.zeros((TERMS, rank), np.float32)
    if not len(turn):
        return out
    turned = np.frombuffer(turn[0].as_buffer(), "<f8").reshape(rows, -1)

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            data = [(matrix(raw) @ turned).astype("<f4").tobytes() for raw in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(data, pa.binary())], ["block", "data"])

    found = blocks.mapInArrow(project, "block int, data binary").toArrow()
    for b, raw in zip(found.column("block"), found.column("data")):
        out[b.as_py() * BLOCK : (b.as_py() + 1) * BLOCK, : turned.shape[1]] = np.frombuffer(raw.as_buffer(), "<f4").reshape(BLOCK, -1)
    return out


@dataclass
class Held:
    """Which items hold a word: sorted words, each one's first place in ``items``, and the end."""

    words: np.ndarray
    first: np.ndarray
    items: np.ndarray
    heads: np.ndarray  # by the first 16 bits, whether a word begins so

    @staticmethod
    def of(held: dict[int, list[int]]) -> Held:
        words = sorted(held)
        found = np.array(words, np.uint64)
        heads = np.zeros(1 << 16, bool)
        heads[found >> np.uint64(48)] = True
        return Held(found, np.cumsum([0, *(len(held[x]) for x in words)]), np.array([k for x in words for k in held[x]], np.int64), heads)


@dataclass
class Block:
    """A block of the benchmark in the latent space."""

    weights: np.ndarray
    vectors: np.ndarray  # terms + 1 rows: weighted, and one of zeros for empty slots
    items: list[dict]
    spans: dict[int, tuple[np.ndarray, np.ndarray]]  # passage length in chunks -> item numbers and unit vectors
    short: dict[int, list[int]]  # first word -> items
    anchors: Held  # words one of which an accepted stretch holds
    rarer: Held  # the rarer half of each item's words
    least: np.ndarray  # places of an item's rarer words that an accepted stretch has
    reach: np.ndarray  # words of an item's passage


def anchors(ranked: np.ndarray, given: bool) -> np.ndarray:
    """Of an item's words, rarest first, those of which each accepted stretch holds at least one.

    A common subsequence of a given share leaves out fewer of the item's places than are taken here; so does, for items
    without an answer of their own, the check for the rarest words.
    """
    n = len(ranked)
    least = n - int(np.ceil((PARAPHRASE if given else EXACT) * n - 1e-9)) + 1
    return ranked[: least if given else max(least, int(np.ceil(RAREST * n)))]


def least_places(ranked: np.ndarray, given: bool) -> int:
    """How many places of the rarer half (``RARER``) of an item's words, rarest first, each accepted stretch has at least.

    A common subsequence takes a place of the stretch for each place of the item, and may leave out only so many of the
    item's. Without an answer of its own, an item accepted by ``PARAPHRASE`` also needs ``ANSWER`` of its rarest words.
    """
    n = len(ranked)
    half = int(np.ceil(RARER * n))
    loose, exact = (int(np.ceil(share * n - 1e-9)) - (n - half) for share in (PARAPHRASE, EXACT))
    if not given:
        rare = len(set(ranked[: int(np.ceil(RAREST * n))].tolist()))
        loose = min(exact, max(loose, int(np.ceil(ANSWER * rare - 1e-9))))
    return max(1, loose)


def _block(items: pd.DataFrame, weights: np.ndarray, basis: np.ndarray) -> Block:
    vectors = np.vstack([basis * weights[:, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
    none = Held.of({})
    block = Block(weights, vectors, [], {}, {}, none, none, np.ones(len(items), np.int64), np.zeros(len(items), np.int64))
    by_span, held, rarer = {}, {}, {}
    words, offsets = word_hashes(pa.array(items["lower"].tolist(), pa.string()))
    answers = items["answer"].tolist() if "answer" in items else [None] * len(items)
    for k, item_id in enumerate(None if pd.isna(x) else int(x) for x in items["item_id"]):
        own = words[offsets[k] : offsets[k + 1]]
        ranked = own[np.argsort(-weights[terms_of(own)], kind="stable")]
        rare = set(ranked[: int(np.ceil(RAREST * len(own)))].tolist())
        given = word_hashes(pa.array([answers[k]], pa.string()))[0].tolist() if isinstance(answers[k], str) else []
        masks: dict[int, int] = {}
        for n, word in enumerate(own.tolist()):
            masks[word] = masks.get(word, 0) | (1 << n)
        times = {word: mask.bit_count() for word, mask in masks.items()}
        block.items.append({"id": item_id, "words": own.tolist(), "masks": masks, "times": times, "answer": set(given) or rare})
        if 0 < len(own) < SHORT:
            block.short.setdefault(int(own[0]), []).append(k)
        elif len(own):
            vector = vectors[terms_of(own)].sum(axis=0)
            span = -(-len(own) // CHUNK) + 1
            by_span.setdefault(span, []).append((k, vector / max(np.linalg.norm(vector), 1e-9)))
            block.reach[k] = span * CHUNK
            block.least[k] = least_places(ranked, bool(given))
            for word in set(anchors(ranked, bool(given)).tolist()):
                held.setdefault(word, []).append(k)
            for word in set(ranked[: int(np.ceil(RARER * len(own)))].tolist()):
                rarer.setdefault(word, []).append(k)
    block.spans = {m: (np.array([k for k, _ in x]), np.stack([v for _, v in x]).astype(np.float32)) for m, x in by_span.items()}
    block.anchors, block.rarer = Held.of(held), Held.of(rarer)
    return block


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, all places of the item at once as bits."""
    full = (1 << size) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row, item, first word, end


def _candidates(block: Block, words: np.ndarray, offsets: np.ndarray, cosine: float) -> Iterator[Stretches]:
    """Stretches whose passages are close to an item."""
    place, first = chunks_of(offsets)
    if not len(place):
        return
    terms = np.concatenate([terms_of(words), [TERMS]])
    sums = np.zeros((len(place) + 1, block.vectors.shape[1]), np.float32)
    # slot by slot, and the running sums along the longer axis: the same additions on less memory at a time
    slots, total, some = terms[place], np.zeros((len(place), sums.shape[1]), np.float32), np.empty((len(place), sums.shape[1]), np.float32)
    for slot in range(CHUNK):
        total += np.take(block.vectors, slots[:, slot], axis=0, out=some, mode="clip")
    sums[1:] = np.cumsum(total.T.copy(), axis=1).T
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.arange(len(place))
    for span, (items, unit) in block.spans.items():
        stop = np.minimum(number + span, first[1:][row])
        passage = sums[stop]
        passage -= sums[:-1]
        floor = cosine * np.sqrt(np.einsum("pk,pk->p", passage, passage))
        floor[floor == 0] = np.inf
        for at in range(0, len(items), 512):
            some = unit[at : at + 512]
            hits = np.flatnonzero(some @ passage.T >= floor)
            if not len(hits):
                continue
            which, where = np.divmod(hits, len(passage))
            # neighbouring passages near one item are one stretch
            new = np.ones(len(where), bool)
            new[1:] = (which[1:] != which[:-1]) | (where[1:] > where[:-1] + 1) | (row[where[1:]] != row[where[:-1]])
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(where)) - 1
            rows = row[where[begins]]
            low = np.maximum(offsets[rows], place[where[begins], 0] - CHUNK)
            high = np.minimum(offsets[rows + 1], place[stop[where[ends]] - 1, 0] + 2 * CHUNK)
            yield rows, items[at + which[begins]], low, high


def _places(held: Held, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) of every place of an item's held words, in that order."""
    hits = np.flatnonzero(held.heads[words >> np.uint64(48)])
    if not len(hits):
        return hits, hits
    at = np.minimum(np.searchsorted(held.words, words[hits]), len(held.words) - 1)
    same = held.words[at] == words[hits]
    at, hits = at[same], hits[same]
    times = held.first[at + 1] - held.first[at]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    which = held.items[np.repeat(held.first[at], times) + nth]
    place = np.repeat(hits, times)
    order = np.argsort(which, kind="stable")
    return which[order], place[order]


def _stretches(block: Block, words: np.ndarray, offsets: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, end) of all stretches to be checked.

    An accepted stretch holds an anchor of its item, so those without one are left out of the candidates; around the
    anchors' own places there is a stretch in any case. Stretches with too few of the item's rarer words are left out of both.
    """
    which, place = _places(block.anchors, words)
    if not len(which):
        return
    wide = len(words) + 1
    keys = which * wide + place
    rarer, at = _places(block.rarer, words)
    counted = rarer * wide + at

    def enough(items: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.searchsorted(counted, items * wide + high) - np.searchsorted(counted, items * wide + low) >= block.least[items]

    for rows, items, low, high in _candidates(block, words, offsets, cosine):
        held = np.searchsorted(keys, items * wide + low) < np.searchsorted(keys, items * wide + high)
        held &= enough(items, low, high)
        yield from zip(rows[held].tolist(), items[held].tolist(), low[held].tolist(), high[held].tolist())
    rows = np.searchsorted(offsets, place, side="right") - 1
    low = np.maximum(place - block.reach[which], offsets[rows])
    high = np.minimum(place + block.reach[which] + 1, offsets[rows + 1])
    held = enough(which, low, high)
    yield from zip(rows[held].tolist(), which[held].tolist(), low[held].tolist(), high[held].tolist())


def _matches(block: Block, column: pa.Array, cosine: float) -> Iterator[tuple[int, int, float]]:
    """(row, item, share of the item's words found) of contaminated rows."""
    words, offsets = word_hashes(column)
    best: dict[tuple[int, int], float] = {}
    for row, k, low, high in _stretches(block, words, offsets, cosine):
        if best.get((row, k)) == 1.0:
            continue
        item = block.items[k]
        n, some = len(item["words"]), words[low:high].tolist()
        # no common subsequence is longer than the item's places whose words stand in the stretch
        if sum(map(item["times"].__getitem__, item["times"].keys() & some)) < PARAPHRASE * n:
            continue
        share = common_words(item["masks"], n, some) / n
        if share >= EXACT or (share >= PARAPHRASE and len(item["answer"].intersection(some)) >= ANSWER * len(item["answer"])):
            best[row, k] = max(share, best.get((row, k), 0.0))
    if block.short:
        heads = np.array(sorted(block.short), np.uint64)
        for at in np.flatnonzero(np.isin(words, heads)).tolist():
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            for k in block.short[int(words[at])]:
                own = block.items[k]["words"]
                if at + len(own) <= offsets[row + 1] and words[at : at + len(own)].tolist() == own:
                    best[row, k] = 1.0
    for (row, k), share in sorted(best.items()):
        yield row, k, share


def prepared(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rank: int = RANK) -> list[Block]:
    """Weights and latent basis of all documents, and the benchmark in blocks."""
    texts = docs.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("lower"))
    items = benchmark.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("lower"),
                             *([F.lower("answer").alias("answer")] if "answer" in benchmark.columns else []))
    count = items.count()
    if not count:
        return []
    weights = term_weights(texts)
    basis = latent_basis(texts.unionByName(items.select("lower")), weights, rank)
    blocks = -(-count // MOST_ITEMS)
    part, out = F.pmod(F.xxhash64("item_id"), F.lit(blocks)), []
    for k in range(blocks):
        out.append(_block(items.where(part == k).orderBy("item_id", "lower").toPandas(), weights, basis))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, overlap for each document and item found in it; documents without one are not listed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("lower"))
    schema, out = "doc_id long, item_id long, overlap double", None
    for block in prepared(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "lower", _SLICE):
                ids = rows_of(batch, "doc_id")
                found = [(ids[r], shared.value.items[k]["id"], x) for r, k, x in _matches(shared.value, batch.column("lower"), cosine)]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["doc_id", "item_id", "overlap"])

        some = slim.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """The rows in which no item is found, with all their columns, without a shuffle."""
    kept = docs
    for block in prepared(docs, benchmark, text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "lower", _SLICE):
                bad = {r for r, _, _ in _matches(shared.value, batch.column("lower"), cosine)}
                rows = batch.column("row").filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(rows.flatten(), names=names)

        names = docs.columns
        packed = kept.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("row"), F.lower(F.col(text_col)).alias("lower"))
        kept = packed.mapInArrow(run, docs.schema)
    return kept
