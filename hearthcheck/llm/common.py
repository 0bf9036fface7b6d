"""Helpers of the corpus operators: tables, folds, and word hashing over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthcheck.session import new_work_path

FOLDS = 5
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out of every training."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


_RECORDER: ContextVar[list[str] | None] = ContextVar("work", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, is computed once.

    The folder stays until its owner deletes it: see ``recording``.
    """
    spark = df.sparkSession
    path = new_work_path(spark, label)
    df.write.parquet(path)
    if (mine := _RECORDER.get()) is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recording(paths: list[str]) -> Iterator[list[str]]:
    """Note in ``paths`` what ``stored`` writes inside; nothing written elsewhere is touched by ``forget`` of that list."""
    token = _RECORDER.set(paths)
    try:
        yield paths
    finally:
        _RECORDER.reset(token)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded work tables, once all results built on them are written."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``most`` bytes of text, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8_parts(batch.column(text))[1][1:]
        if ends[-1] <= most:
            yield batch
            continue
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets, starting at 0; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_mask(data: np.ndarray) -> np.ndarray:
    """Letters, digits and all non-ASCII bytes, but for general punctuation (U+2000-203F) and Latin-1 signs."""
    mask = _WORD_BYTE[data]
    lead = np.flatnonzero(data == 0xE2)
    lead = lead[lead + 2 < len(data)]
    lead = lead[data[lead + 1] == 0x80]
    for step in range(3):
        mask[lead + step] = False
    sign = np.flatnonzero(data == 0xC2)
    sign = sign[sign + 1 < len(data)]
    mask[sign] = False
    mask[sign + 1] = False
    return mask


@dataclass
class Words:
    """All words of a text column: 64-bit hashes, where each starts in ``data`` and its bytes, where each row's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


_POWER = 0x9E3779B97F4A7C15
_HELD_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the word hash's odd factor and of its inverse, modulo 2 to the 64; those of a slice are kept."""
    if not _HELD_POWERS or len(_HELD_POWERS[0]) < n:
        tables = []
        for factor in (_POWER, pow(_POWER, -1, 1 << 64)):
            powers = np.full(max(n, SLICE_BYTES), factor, np.uint64)
            powers[0] = 1
            tables.append(np.multiply.accumulate(powers))
        if n > SLICE_BYTES:
            return tables[0], tables[1]
        _HELD_POWERS[:] = tables
    return _HELD_POWERS[0][:n], _HELD_POWERS[1][:n]


def words_of(column: pa.Array) -> Words:
    data, offsets = utf8_parts(column)
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    mask = _word_mask(data)
    begins, lasts = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    lasts[:-1] &= ~mask[1:]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] = mask[rows]
    ended = rows[rows > 0] - 1
    lasts[ended] = mask[ended]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    ends = np.flatnonzero(lasts) + 1
    # a word's polynomial is a difference of running sums over the whole column, moved back to where the word starts
    powers, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= powers
    np.cumsum(value, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * back[starts]
    return Words(mixed(hashes), starts, ends - starts, np.searchsorted(starts, offsets), data)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a text column, and where each row's words start and end in them."""
    words = words_of(column)
    return words.hashes, words.offsets


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words; fewer words than that make one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for step in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[step : len(words) - width + 1 + step]
    return mixed(out)


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()
