"""Document quality by a factorisation machine.

A document's features are its hashed lower-case words (each with weight 1 / sqrt(distinct words)), its structure statistics
and its metadata (both as bins, weight 1). The machine adds a bias, one weight per feature, and the interaction of
every pair of features as the inner product of two low-rank vectors; by the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2, so a document is scored in time linear in its
features. A logistic curve fitted on labelled rows that the machine has not seen turns its output into a probability.

Structure statistics: words, characters per word, words that are distinct, five-word runs that are distinct, the most
frequent word's share, words that repeat the one before, capital letters, digits, punctuation, bars, words per line, and
bytes beyond ASCII. Metadata: the row's own ``n_chars`` and its distance from the text's length. Statistics read whole
texts and cover all documents; only the fit is bounded.

The machine is fitted in one task on at most about ``TRAIN_ROWS`` labelled rows chosen by a seeded hash (documented bound; their
features are bounded by the number of buckets); the model of ``BUCKETS`` + bins rows is broadcast, below 1 MB. A lost
executor repeats the fit with the same rows in the same order, so it gives the same model.

Null texts count as empty; they are scored by their structure bins. Without labels of both classes every score is the
share of good labels (0 without labels). Rows that repeat a label count as bad if one of them says so. Rows with a null id or
label teach nothing but are scored; documents that share an id are scored each. Labels, language, source and id are
never inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import shingles, slices, utf8_parts, word_hashes

FOLDS = 4
HELD_OUT = 2
BUCKETS = 1 << 13
RANK = 4
TRAIN_ROWS = 6_000
EPOCHS = 12
BATCH = 64
RATE = 0.08
DECAY = 1e-4
SEED = 11

# Upper ends of the bins of each statistic, in order.
BINS: dict[str, tuple[float, ...]] = {
    "words": (0, 8, 20, 50, 100, 200, 400, 800, 1600, 5000),
    "word_length": (1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 15, 30),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999),
    "distinct_runs": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.999),
    "top_word": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8),
    "echo": (0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "capitals": (0.0, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7),
    "digits": (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "punctuation": (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5),
    "bars": (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
    "line_words": (2, 5, 10, 20, 40, 80, 160, 320),
    "foreign": (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "n_chars": (0, 50, 100, 200, 400, 800, 1600, 3200, 10_000, 50_000),
    "n_chars_gap": (0, 1, 10, 100),
}
_FIRST = dict(zip(BINS, np.cumsum([BUCKETS, *(len(x) + 2 for x in BINS.values())])))  # the last bin of each is for null
FEATURES = BUCKETS + sum(len(x) + 2 for x in BINS.values())


@dataclass
class Model:
    bias: float = 0.0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    factor: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, RANK), np.float32))
    curve: tuple[float, float] = (-30.0, 0.0)


# ---------------------------------------------------------------------- features


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) of the distinct values of each row, in order."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    starts = np.flatnonzero(new)
    return rows[starts], values[starts], np.diff(np.append(starts, len(rows)))


def statistics(texts: pa.Array, lower: pa.Array, n_chars: pa.Array) -> tuple[dict[str, np.ndarray], tuple]:
    """The structure statistics and metadata of each row (nan: null), and its distinct words as (row, hash, count)."""
    data, at = utf8_parts(texts)
    size = np.diff(at)
    some = np.maximum(size, 1)
    words, offsets = word_hashes(lower)
    n = np.diff(offsets)
    many = np.maximum(n, 1)
    rows, values, counts = _by_row(words, offsets)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, rows, counts)
    kinds = np.bincount(rows, minlength=len(n))
    echo = np.zeros(len(words), bool)
    echo[1:] = words[1:] == words[:-1]
    echo[offsets[:-1][n > 0]] = False
    runs = [len(np.unique(run)) / len(run) if len(run := shingles(words[a:b], 5)) else 1.0 for a, b in zip(offsets[:-1], offsets[1:])]
    capital = (data >= 65) & (data <= 90)
    accented = np.zeros(len(data), bool)  # C3 80 to C3 9E: Latin capitals with marks
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    digit = (data >= 48) & (data <= 57)
    letter = capital | ((data >= 97) & (data <= 122)) | (data >= 128)
    points = _sums((data & 0xC0) != 0x80, at)
    told = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = {
        "words": n,
        "word_length": _sums(letter | digit, at) / many,
        "distinct": kinds / many,
        "distinct_runs": np.array(runs),
        "top_word": top / many,
        "echo": _sums(echo, offsets) / many,
        "capitals": _sums(capital | accented, at) / some,
        "digits": _sums(digit, at) / some,
        "punctuation": _sums((data > 32) & ~letter & ~digit, at) / some,
        "bars": _sums(data == 124, at) / some,
        "line_words": n / (_sums(data == 10, at) + 1),
        "foreign": _sums(data >= 128, at) / some,
        "n_chars": told,
        "n_chars_gap": np.abs(told - points),
    }
    return found, (rows, values, counts)


def features(texts: pa.Array, lower: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight), sorted by row: hashed words, then one bin per statistic."""
    found, (rows, values, _) = statistics(texts, lower, n_chars)
    n = len(texts)
    rows, values, counts = _by_row((values >> np.uint64(40)).astype(np.int64) % BUCKETS, np.searchsorted(rows, np.arange(n + 1)))
    weights = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))[rows]
    bins = []
    for name, ends in BINS.items():
        place = np.searchsorted(ends, found[name])
        place[np.isnan(found[name])] = len(ends) + 1
        bins.append(_FIRST[name] + place)
    rows = np.concatenate([rows, np.repeat(np.arange(n), len(bins))])
    values = np.concatenate([values, np.stack(bins, axis=1).ravel()])
    weights = np.concatenate([weights, np.ones(n * len(bins))])
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order], weights[order].astype(np.float32)


def output(model: Model, rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The machine's output per row; pairs by the sum-of-squares identity."""
    linear = np.bincount(rows, model.weight[values] * weights, n)
    total = np.full(n, model.bias) + linear
    for f in range(model.factor.shape[1]):
        part = model.factor[values, f] * weights
        total += 0.5 * (np.bincount(rows, part, n) ** 2 - np.bincount(rows, part**2, n))
    return total


# ---------------------------------------------------------------------- fitting


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, with a slight pull of the slope to 1."""
    a, b = 0.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        slope = np.array([(y - p).sum(), ((y - p) * x).sum() - (b - 1)])
        bend = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        a, b = np.array([a, b]) + np.linalg.solve(bend, slope)
    return float(a), float(b)


def fit(starts: np.ndarray, values: np.ndarray, weights: np.ndarray, good: np.ndarray, seen: np.ndarray) -> Model:
    """Mini-batch gradient steps of the logistic loss, scaled per feature, on the rows ``seen``; the curve on the others.

    Row k has the entries ``starts[k]:starts[k + 1]``.
    """
    chosen = np.random.default_rng(SEED)
    model = Model(factor=(0.01 * chosen.standard_normal((FEATURES, RANK))).astype(np.float32))
    share = good[seen].mean()
    model.bias = float(np.log(share / (1 - share)))
    pace_w, pace_v, pace_b = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6), 1e-6
    which = np.flatnonzero(seen)
    for epoch in range(EPOCHS):
        which = chosen.permutation(which)
        for k in range(0, len(which), BATCH):
            some = which[k : k + BATCH]
            sizes = starts[some + 1] - starts[some]
            entry = np.repeat(starts[some] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            row, v, x = np.repeat(np.arange(len(some)), sizes), values[entry], weights[entry]
            sums = np.stack([np.bincount(row, model.factor[v, f] * x, len(some)) for f in range(RANK)], axis=1)
            out = output(model, row, v, x, len(some))
            miss = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - good[some]
            used, place = np.unique(v, return_inverse=True)
            pull = miss[row] * x / len(some)
            step = np.bincount(place, pull, len(used)) + DECAY * model.weight[used]
            pace_w[used] += step**2
            for f in range(RANK):
                part = pull * (sums[row, f] - model.factor[v, f] * x)
                turn = np.bincount(place, part, len(used)) + DECAY * model.factor[used, f]
                pace_v[used, f] += turn**2
                model.factor[used, f] -= RATE * turn / np.sqrt(pace_v[used, f])
            model.weight[used] -= RATE * step / np.sqrt(pace_w[used])
            pace_b += miss.mean() ** 2
            model.bias -= RATE * miss.mean() / np.sqrt(pace_b)
    rest = np.flatnonzero(~seen)
    if len(rest):
        sizes = starts[rest + 1] - starts[rest]
        entry = np.repeat(starts[rest] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        model.curve = _curve(output(model, np.repeat(np.arange(len(rest)), sizes), values[entry], weights[entry], len(rest)), good[rest])
    else:
        model.curve = (0.0, 1.0)
    return model


def learnable(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS != HELD_OUT


def _slim(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, text.alias("text"), F.lower(text).alias("lower"), F.col("n_chars").cast("long").alias("n_chars"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, values, weights = features(*(batch.column(c) for c in ("text", "lower", "n_chars")))
        starts = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("good"), pa.ListArray.from_arrays(starts, pa.array(values.astype(np.int32))),
             pa.ListArray.from_arrays(starts, pa.array(weights))],
            ["doc_id", "good", "features", "weights"],
        )


def _fitted(table: pa.Table) -> pa.Table:
    """One task: the model of all rows given, as one binary value."""
    table = table.sort_by([("doc_id", "ascending"), ("good", "ascending")]).combine_chunks()
    lists = table.column("features").combine_chunks()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    good = table.column("good").to_numpy().astype(float)
    seen = np.random.default_rng(SEED).permutation(len(good)) >= len(good) // 4
    if 0 < good[seen].sum() < seen.sum():
        model = fit(starts, lists.flatten().to_numpy(), table.column("weights").combine_chunks().flatten().to_numpy(), good, seen)
    else:
        mean = good.mean()
        model = Model(curve=(float(np.clip(np.log(max(mean, 1e-13) / max(1 - mean, 1e-13)), -30, 30)), 0.0))
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold, at most about ``most`` of them."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    marks = marks.where(F.col("good").isNotNull() & learnable())
    share = min(1.0, most / max(1, marks.count()))
    chosen = learnable() & (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    marks = marks.where(chosen).groupBy("doc_id").agg((F.min("good") > 0).cast("int").alias("good"))
    rows = _slim(docs, F.col("doc_id").cast("long").alias("doc_id")).where(chosen).join(marks.hint("merge"), "doc_id")
    vectors = rows.mapInArrow(_vectors, "doc_id long, good int, features array<int>, weights array<float>")
    found = vectors.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fitted, "model binary").collect()  # one row, of a bounded sample
    return pickle.loads(found[0]["model"]) if found else Model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches):
            found = features(*(batch.column(c) for c in ("text", "lower", "n_chars")))
            a, b = machine.curve
            value = 1 / (1 + np.exp(-np.clip(a + b * output(machine, *found, batch.num_rows), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.7).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    slim = _slim(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learnable(), F.lit(False)).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
