"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs on Spark over a bounded, seeded share of the labelled rows of each language; the summed counts make one
log-probability matrix of ``buckets`` x languages, which is broadcast (at most 2^15 x 64 floats, 8 MB). Scoring gathers
matrix rows for whole batches of n-grams at a time in numpy and adds them per document.

``und`` with score 0 is given to null texts and to texts without a letter, and to all texts when nothing was learned.
Ties go to the language first by code point. Whole texts are read whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import rows_of, slices, utf8_parts

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
ROWS_PER_LANGUAGE = 20_000
MOST_LANGUAGES = 64
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text column with all but letters turned into spaces, and its row offsets in them."""
    data, offsets = utf8_parts(column)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(32)), starts[offsets]


def grams(points: np.ndarray, offsets: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that stay in one row and hold no two adjacent spaces, and where they start."""
    count = len(points) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row_end = np.repeat(offsets[1:], np.diff(offsets))[:count]
    good = np.arange(count) + size <= row_end
    blank = points == 32
    if size == 1:
        good &= ~blank
    else:
        for step in range(size - 1):
            good &= ~(blank[step : count + step] & blank[step + 1 : count + step + 1])
    at = np.flatnonzero(good)
    key = np.full(len(at), size, np.uint64)
    for step in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + points[at + step]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(40)).astype(np.int64) & (buckets - 1), at


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            points, offsets = code_points(batch.column("text"))
            langs = np.array(rows_of(batch, "lang"), object)
            row_of = np.repeat(np.arange(len(langs)), np.diff(offsets))
            known = sorted(set(langs))
            number = np.searchsorted(np.array(known, object), langs)
            for size in SIZES:
                key, at = grams(points, offsets, size, buckets)
                both = np.bincount(number[row_of[at]] * buckets + key, minlength=len(known) * buckets)
                for k, lang in enumerate(known):
                    if lang not in held:
                        held[lang] = np.zeros(buckets, np.int64)
                    held[lang] += both[k * buckets : (k + 1) * buckets]
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"]
            )

    return run


def train(labelled: DataFrame, buckets: int = BUCKETS, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (buckets x languages) and log priors, from rows (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = labelled.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"More than {MOST_LANGUAGES} languages are labelled.")
    if not rows:
        return [], np.zeros((buckets, 0), np.float32), np.zeros(0)
    # a row is learned from when its seeded hash falls below the language's share
    share = F.lit(0.0)
    for r in rows:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows_per_language / r["count"]))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    learned = labelled.where(place < share).select(F.lower("text").alias("text"), "lang")
    counted = (
        learned.mapInArrow(_counts(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    found: pd.DataFrame = counted.toPandas()
    langs = [r["lang"] for r in rows]
    counts = np.zeros((buckets, len(langs)))
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)] = found["n"]
    matrix = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * buckets))
    priors = np.array([r["count"] for r in rows], float)
    return langs, matrix.astype(np.float32), np.log(priors / priors.sum())


def _score(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, priors = model.value
        for batch in slices(batches, most=1 << 20):
            points, offsets = code_points(batch.column("text"))
            total = np.tile(priors, (batch.num_rows, 1))
            seen = np.zeros(batch.num_rows, bool)
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            for size in SIZES if langs else ():
                key, at = grams(points, offsets, size, buckets)
                if not len(at):
                    continue
                rows = row_of[at]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                total[rows[first]] += np.add.reduceat(matrix[key], first, axis=0, dtype=np.float64)
                seen[rows[first]] = True
            if langs:
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            name = [langs[k] if ok else UNKNOWN for k, ok in zip(best, seen)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()), pa.array(np.where(seen, score, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"),
                       F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out"))
    return slim.mapInArrow(_score(shared, buckets), "doc_id long, held_out boolean, lang_pred string, score double")
