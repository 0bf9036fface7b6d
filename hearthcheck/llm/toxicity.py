"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, give every word and the word before it a probability along a chain of
ever more general expressions: the pair given its word, the word given its first six bytes, those given its first four, and
those alone. At each step a class's probability is interpolated Kneser-Ney: the discounted share of the class's own count,
plus the mass the discount frees, spread by the share the expression has in both classes together. So an expression that
is rare leans on counts the classes share, and on those of its more general form: endings never seen before are
judged by the stem they follow. Counts are of documents for pairs and of distinct contexts above (Kneser-Ney's
continuation counts), so copies and repeated lines are no evidence.

A step where the class counts differ no more than chance explains (``LEAST_CHI2``), or by a factor below
e^``LEAST_GAIN``, takes the shared counts in both models and cancels when the length-normalised toxic and ordinary
log-likelihoods are compared; so does an expression seen once, whose count the discount uses up. There is no floor, cap or
limit besides: all counts lie in a table that grows with the labelled rows, and so do the expressions that tell the
classes apart. Texts are scored against that table: tasks hold a Bloom filter of its keys (fixed size) against each
text, and only the expressions that pass are joined to it. A logistic curve, fitted on labelled rows kept out of the
counts (at most about ``CALIBRATION_ROWS``), turns the difference into a score.

Null and empty texts get the score of a text without evidence. Without labels of both classes every
score is the share of toxic labels (0 without labels). Repeated label rows count as toxic if one of them says so. Rows
with null ids or labels teach nothing but are scored, documents that share an id are scored each. Whole texts are read;
other columns are never used as input. Words are told apart by 40 bits, the words before them by 24.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import fold, mixed, slices, stored, words_of
from hearthcheck.operators.skew import join_reference

DISCOUNT = 0.75
LEAST_CHI2 = 15.0
LEAST_GAIN = 0.5
CALIBRATION_ROWS = 10_000
CLEAN_KEPT = 0.995  # of the ordinary calibration rows, where documents are filtered
FILTER_WORDS = 1 << 18  # 64 bits each: 2 MB, about 1 % wrong hits at 1.6 million expressions
LABEL_WORDS = 1 << 18  # 64 bits each: 2 MB, about 1 % wrong hits at 1.6 million labels
PROBES = 3
_HELD_GRAMS = 2_000_000
# Bits of a word's 40 that are left when it is reduced to six bytes, and to four.
_LEVELS = ((0, 0), (1, 0), (2, 10), (3, 18))  # level, shift; level 0 is the pair
_WORD = (1 << 40) - 1


@dataclass
class Model:
    """Expressions that tell the classes apart (level, key, gain), a Bloom filter of them, the curve and the stage's cut."""

    gains: DataFrame | None = None
    bits: np.ndarray | None = None
    curve: tuple[float, float] = (-30.0, 0.0)
    cut: float = 0.5


# ---------------------------------------------------------------------- expressions


def word_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (24 bits of the word before, 40 bits of the word) and row offsets; a row's first word follows 0.

    A word's bits are 22 of its first four bytes, 8 of its first six, and 10 of the whole word.
    """
    words = words_of(column)
    if not len(words.hashes):
        return np.zeros(0, np.uint64), words.offsets
    stem = np.zeros(len(words.hashes), np.uint64)
    parts = {}
    for k in range(6):
        inside = words.sizes > k
        stem[inside] |= words.data[words.starts[inside] + k].astype(np.uint64) << np.uint64(8 * k)
        parts[k + 1] = stem.copy() if k in (3, 5) else None
    word = (mixed(parts[4] + np.uint64(1)) >> np.uint64(42)) << np.uint64(18)
    word |= (mixed(parts[6] + np.uint64(2)) >> np.uint64(56)) << np.uint64(10)
    word |= words.hashes >> np.uint64(54)
    before = np.zeros_like(word)
    before[1:] = (words.hashes[:-1] & np.uint64(0xFFFFFF)) | np.uint64(1)
    before[words.offsets[:-1][words.offsets[:-1] < len(word)]] = 0
    return (before << np.uint64(40)) | word, words.offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray]:
        grams, where = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        counts = np.zeros((len(grams), 2), np.int64)
        np.add.at(counts, where, np.concatenate([x[1] for x in held]))
        return grams, counts

    def out(grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(grams), 100_000):
            some = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[some].view(np.int64)), pa.array(counts[some, 0]), pa.array(counts[some, 1])], ["gram", "n0", "n1"]
            )

    size = 0
    for batch in slices(batches):
        grams, offsets = word_pairs(batch.column("text"))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        toxic = np.asarray(batch.column("toxic").to_pylist(), np.int64)[rows[first]]
        held.append((grams[first], np.stack([1 - toxic, toxic], axis=1)))
        size += int(first.sum())
        if size > 2 * _HELD_GRAMS:
            held = [together()]
            size = len(held[0][0])
            if size > _HELD_GRAMS:
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*together())


def labelled(docs: DataFrame, labels: DataFrame, condition: Column) -> DataFrame:
    """(text, toxic) of labelled rows; ``condition`` is on doc_id and applied on both sides before they meet."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isNotNull() & condition).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # a Bloom filter of the labelled ids keeps most other texts out of the shuffle; never broadcast the labels
    # themselves: they grow with the corpus, and one plan should hold at every size
    ids = labels.select(F.lit(0).alias("level"), F.col("doc_id").cast("long").alias("key")).where("key is not null")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(ids, LABEL_WORDS))

    @F.pandas_udf("boolean")
    def may_be_labelled(keys: pd.Series) -> pd.Series:
        numbers = keys.fillna(0).to_numpy(np.int64).view(np.uint64)
        found = np.zeros(len(numbers), bool)
        found[_passing(shared.value, numbers, 0)] = True
        return pd.Series(found)

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(condition)
    texts = texts.where(may_be_labelled("doc_id")).select("doc_id", F.lower("text").alias("text"))
    return texts.join(marks.hint("merge"), "doc_id")


def _probe(keys: np.ndarray, level: int, probe: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a Bloom filter that stand for keys of a level."""
    h = mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (4 * probe + level + 1) % (1 << 64)))
    return (h % np.uint64(words)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58))


def _passing(bits: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """Places of the keys that the filter lets through."""
    at = np.arange(len(keys))
    for probe in range(PROBES):
        words, bit = _probe(keys[at], level, probe, len(bits))
        at = at[(bits[words] & bit) != 0]
    return at


def _filter(keys: DataFrame, size: int) -> np.ndarray:
    """The Bloom filter of keys (level, key): set bits are united on Spark, at most ``size`` rows reach the driver."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint64)
        for batch in batches:
            levels, keys = batch.column("level").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for level in np.unique(levels):
                for probe in range(PROBES):
                    np.bitwise_or.at(held, *_probe(keys[levels == level], int(level), probe, size))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], ["word", "bits"])

    found = keys.select("level", "key").mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits) as bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


# ---------------------------------------------------------------------- counts to gains


def _gains(children: DataFrame, level: int) -> DataFrame:
    """(level, key, gain) of the children (key, c0, c1) that differ from their parents (p0, p1, kinds0, kinds1) beyond chance."""
    total, both, share = "(c0 + c1)", "(p0 + p1)", "(p1 / (p0 + p1))"
    chi2 = f"pow(c1 - {total} * {share}, 2) / nullif({total} * {share} * (1 - {share}), 0d)"

    def model(c: int) -> str:
        return f"((greatest(c{c} - {DISCOUNT}d, 0d) + {DISCOUNT}d * kinds{c} * {total} / {both}) / p{c})"

    told = children.where(f"{total} >= 2 and p0 > 0 and p1 > 0").where(f"{chi2} > {LEAST_CHI2}")
    gains = told.selectExpr(f"{level} as level", "key", f"ln({model(1)} / {model(0)}) as gain")
    return gains.where(F.abs("gain") >= LEAST_GAIN)


def _expressions(pairs: DataFrame) -> DataFrame:
    """Gains of all four levels from the stored pair counts (gram, n0, n1)."""
    counted = pairs.groupBy(F.col("gram").bitwiseAND(F.lit(_WORD)).alias("key")).agg(
        F.expr("count_if(n0 > 0) as c0"), F.expr("count_if(n1 > 0) as c1"), F.expr("sum(n0) as p0"), F.expr("sum(n1) as p1")
    )
    children = stored(counted, "toxic-words")
    # a word's kinds of pairs are its contexts
    parents = children.selectExpr("key as parent", "p0", "p1", "c0 as kinds0", "c1 as kinds1")
    seen = pairs.where("n0 + n1 >= 2").select(F.col("gram").alias("key"), F.col("n0").alias("c0"), F.col("n1").alias("c1"), F.col("gram").bitwiseAND(F.lit(_WORD)).alias("parent"))
    found = [_gains(seen.join(parents, "parent"), 0)]
    for (level, shift), (_, above) in zip(_LEVELS[1:], (*_LEVELS[2:], (4, 40))):
        parent = F.shiftrightunsigned("key", above - shift)
        sums = children.groupBy(parent.alias("parent")).agg(
            F.expr("sum(c0) as p0"), F.expr("sum(c1) as p1"), F.expr("count_if(c0 > 0) as kinds0"), F.expr("count_if(c1 > 0) as kinds1")
        )
        own = children.select("key", "c0", "c1", parent.alias("parent"))
        found.append(_gains(own.join(sums, "parent"), level))
        children = sums.selectExpr("parent as key", "p0 as c0", "p1 as c1")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out, "toxic-expressions")


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold: all but the calibration rows are counted."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).count()
    share = min(0.25, calibration_rows / max(1, known))
    kept_out = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("long")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    learn = labelled(docs, labels, (fold() != 0) & ~kept_out)
    pairs = learn.select("text", "toxic").mapInArrow(_count, "gram long, n0 long, n1 long")
    pairs = stored(pairs.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-pairs")
    gains = _expressions(pairs)
    model = Model(gains, _filter(gains, FILTER_WORDS))
    rows = evidence(labelled(docs, labels, (fold() != 0) & kept_out), model, ["toxic"]).toPandas()  # at most calibration_rows
    y, x = rows["toxic"].to_numpy(float), rows["gain"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        model.curve = (30.0 if mean >= 1 else -30.0, 0.0)
        return model
    a, b = _fit(np.stack([np.ones(len(y)), x], axis=1), y)
    model.curve = float(a), float(max(b, 0.0))
    ordinary = 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * x[y == 0], -30, 30)))
    model.cut = float(min(0.5, np.nextafter(np.quantile(ordinary, CLEAN_KEPT), 1)))
    return model


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a slight pull to zero."""
    b = np.zeros(x.shape[1])
    pull = np.diag([0.0] + [1e-2] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        b = b + np.linalg.solve((x.T * w) @ x + pull + 1e-9 * np.eye(len(b)), x.T @ (y - p) - pull @ b)
    return b


# ---------------------------------------------------------------------- scoring


def evidence(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the gain of the lower-cased ``text``: toxic less ordinary log-likelihood per word.

    What passes the filter is written, a few numbers per text, and met with the expressions in one join.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model.bits if model.bits is not None else np.zeros(FILTER_WORDS, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches):
            grams, offsets = word_pairs(batch.column("text"))
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            found = []
            for level, shift in _LEVELS:
                keys = grams if level == 0 else (grams & np.uint64(_WORD)) >> np.uint64(shift)
                at = _passing(held, keys, level)
                found.append((row_of[at], np.full(len(at), level, np.int8), keys[at]))
            rows_, levels, keys = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((keys, levels, rows_))
            rows_, levels, keys = rows_[order], levels[order], keys[order]
            new = np.ones(len(rows_), bool)
            new[1:] = (rows_[1:] != rows_[:-1]) | (levels[1:] != levels[:-1]) | (keys[1:] != keys[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rows_))).astype(np.int32)
            ends = pa.array(np.searchsorted(rows_[first], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (levels[first].astype(np.int32), keys[first].view(np.int64), times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), pa.array(np.diff(offsets)), *lists], [*keep, "_words", "_levels", "_keys", "_times"]
            )

    kinds = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in keep)
    seen = rows.select(*keep, "text").mapInArrow(run, f"{kinds}, _words long, _levels array<int>, _keys array<long>, _times array<int>")
    seen = stored(seen.withColumn("_row", F.monotonically_increasing_id()), "toxic-seen")
    shared.destroy()
    if model.gains is None:
        return seen.select(*keep, F.lit(0.0).alias("gain"))
    hits = seen.selectExpr("_row", "inline(arrays_zip(_levels, _keys, _times))")
    known = model.gains.selectExpr("level as _levels", "key as _keys", "gain as _gain")
    sums = hits.join(known, ["_levels", "_keys"]).groupBy("_row").agg(F.sum(F.col("_times") * F.col("_gain")).alias("_sum"))
    mean = F.coalesce(F.col("_sum") / F.greatest("_words", F.lit(1)), F.lit(0.0))
    return seen.select("_row", "_words", *keep).join(sums, "_row", "left").select(*keep, mean.alias("gain"))


def _probability(model: Model) -> Column:
    a, b = model.curve
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.col("gain"))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.lower("text").alias("text"))
    seen = evidence(slim, model, ["doc_id", "held_out"])
    return seen.select("doc_id", "held_out", _probability(model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows below the model's cut, with all their columns. Equal texts have equal scores, so rejected texts are
    told by their digests."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    slim = docs.select(digest.alias("digest"), F.lower(F.col(text_col)).alias("text"))
    rejected = evidence(slim, model, ["digest"]).where(_probability(model) >= F.lit(model.cut)).select("digest").distinct()
    return join_reference(docs, digest, rejected, "digest", "left_anti")
