"""Documents to passages, passages to a TF-IDF index, and ranked passages for a batch of questions.

Weights are those of the usual smoothed TF-IDF: words of two or more characters and pairs of
neighbouring words, idf ``ln((1 + n) / (1 + df)) + 1``, unit length per passage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from hearthcheck.functions import scalars as S
from hearthcheck.operators.skew import may_be_member, member_bits
from hearthcheck.operators.stats import union_all
from hearthcheck.plans import patterns as P
from hearthcheck.session import new_work_path

WORD = r"[\p{L}\p{N}_]{2,}"
# Questions held by every task at a time; a larger batch takes one pass over the passages per block.
BLOCK_QUESTIONS = 1_000
SCORE_DIGITS = 6
# Scores (a passage and a question each) that are held at a time.
ROUND_SCORES = 1 << 20
# Text of a block of passages, cut into terms at a time.
BLOCK_CHARS = 8 << 20
# Text that a task cuts into words at a time, text it collects before it deals it to blocks, and neighbouring passages that go to
# one block together.
SLICE_BYTES = 4 << 20
PACKED_BYTES = 16 << 20
NEAR_SHIFT = 6
PACKED_LEVEL = 3
# Bytes that a term of a sorted list may share with the one before it without writing them.
MOST_SHARED = 255


# ---------------------------------------------------------------------- text


# What ends a line, and the blanks trimmed from the end of a line.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = (
    " \t\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)


def clean_text(c: Column) -> Column:
    """Unix line ends, no trailing blanks on lines, at most one empty line in a row, outer blanks trimmed."""
    unified = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    # Trimming line by line is several times faster than a pattern over all blanks.
    lines = F.transform(F.split(unified, "\n"), lambda line: F.rtrim(line, F.lit(BLANKS)))
    stripped = F.array_join(lines, "\n")
    spaced = F.regexp_replace(stripped, "\n{3,}", "\n\n")
    return F.btrim(spaced, F.lit(BLANKS + "\n"))


def with_header(stem: Column, text: Column) -> Column:
    """The cleaned text under a line naming its document."""
    return F.concat(F.lit("Document: "), stem, F.lit("\n\n"), clean_text(text))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def passages(df: DataFrame, source: str, text: str, separator: str = r"\n\s*\n") -> DataFrame:
    """One row per block of each document: ``source, passage_no, text``.

    The first line of a document introduces all its passages; the first block is left out unless
    it is the only one. Lines of a block are joined by a space.
    """
    # Each step is its own projection, so that no text is split or trimmed twice.
    opened = df.where(S.column(text).isNotNull()).select(
        S.column(source).alias("source"), _strip(S.column(text)).alias("body")
    )
    split = opened.where(F.length("body") > 0).select("source", F.split("body", separator).alias("blocks"))
    exploded = split.select(
        "source",
        _strip(F.substring_index(F.element_at("blocks", 1), "\n", 1)).alias("first_line"),
        (F.size("blocks") > 1).alias("several"),
        F.posexplode("blocks").alias("position", "block"),
    ).where(~F.col("several") | (F.col("position") > 0))
    stripped = exploded.select(
        "source",
        (F.col("position") - F.col("several").cast("int")).cast("bigint").alias("passage_no"),
        "first_line",
        _strip(F.col("block")).alias("block"),
    ).where(F.col("block") != "")
    joined = F.when(F.contains("block", F.lit("\n")), F.regexp_replace("block", r"[ \t\r\x0b\f]*\n\s*", " ")).otherwise(F.col("block"))
    prefix = F.concat(F.lit("["), F.col("source").cast("string"), F.lit("] "), F.col("first_line"), F.lit(" — "))
    return stripped.select("source", "passage_no", F.concat(prefix, joined).alias("text"))


def words(text: Column) -> Column:
    """Words of two or more characters, lower-cased, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def neighbours(w: Column) -> Column:
    """Pairs of neighbouring words, joined by a space."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


# ---------------------------------------------------------------------- index


@dataclass
class PassageIndex:
    """``passages`` (id columns, text) and how many of them hold each term (``counted``, see ``count_terms``).

    ``idf`` (term, df, idf) and ``vectors`` (id columns, terms, weights) follow from them, by one scan, wherever they are used.
    The ``counted`` of an index that is neither kept nor saved is a plan: one result of it shuffles the texts (``texts``) once and
    writes nothing, each further result counts anew.
    """

    passages: DataFrame
    counted: DataFrame
    ids: tuple[str, ...]
    n_passages: int
    n_blocks: int
    max_share: float = P.MAX_DOCUMENT_SHARE
    texts: DataFrame | None = None
    written: bool = False

    def kept(self) -> PassageIndex:
        """The index with its counts written to the shared folder, for more than one result."""
        if self.written:
            return self
        spark, path = self.passages.sparkSession, new_work_path(self.passages.sparkSession, "term-counts")
        self.counted.write.parquet(path)
        return replace(self, counted=spark.read.schema(COUNTED).parquet(path), written=True)

    @property
    def idf(self) -> DataFrame:
        return inverse_frequencies(vocabulary(self.counted), self.n_passages, self.max_share)

    @property
    def vectors(self) -> DataFrame:
        """One row per passage with a known term: id columns, terms, weights of unit length."""
        weights = _weighing(self.ids, self.n_passages, self.n_blocks, self.max_share)
        ids = self.ids

        def listed(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
            table, cut, passage, code, weight = weights(block, found)
            held = np.bincount(passage, minlength=len(cut.first))
            some = np.flatnonzero(held)
            order = np.argsort(passage, kind="stable")
            code, weight = code[order], weight[order]
            ends = pa.array(np.concatenate([[0], np.cumsum(held[some])]), pa.int32())
            terms = _term_texts(cut.words, cut.terms).take(pa.array(code))
            lists = {"terms": pa.ListArray.from_arrays(ends, terms), "weights": pa.ListArray.from_arrays(ends, pa.array(weight))}
            return pa.table({c: table.column(c).take(pa.array(cut.first[some])) for c in ids} | lists)

        return self.by_block(listed, f"{self.id_kinds}, terms array<string>, weights array<double>")

    @property
    def id_kinds(self) -> str:
        return ", ".join(f"`{c}` {self.passages.schema[c].dataType.simpleString()}" for c in self.ids)

    def by_block(self, run, schema: str, factor: Column | None = None) -> DataFrame:
        """What ``run(key, block, found)`` makes of each block of passages and the frequencies that were found for its terms."""
        if factor is not None or self.texts is None:
            texts = _in_blocks(self.passages, self.ids, self.n_blocks, factor)
        else:
            texts = self.texts
        found = self.counted.where("_block >= 0").select("_block", "bucket", "data")
        return texts.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(run, schema)

    @property
    def postings(self) -> DataFrame:
        """One row per passage and term: id columns, term, weight."""
        cells = F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))
        return self.vectors.select(*self.ids, F.inline(cells))

    def save(self, path: str, copy: bool = True) -> PassageIndex:
        """Write the index, replacing an earlier one at the path, and return the written index.

        Without ``copy`` the passages are not written again: they stay where they were read from, and ``load`` is given them.
        """
        spark = self.passages.sparkSession
        settings = spark.createDataFrame([(self.n_passages, self.n_blocks, self.max_share)], SETTINGS)
        tables = [("counted", self.counted), ("settings", settings)]
        for name, table in ([("passages", self.passages)] if copy else []) + tables:
            table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        return PassageIndex.load(spark, path, self.ids, None if copy else self.passages)

    @staticmethod
    def load(spark: SparkSession, path: str, ids: Sequence[str], passages_df: DataFrame | None = None) -> PassageIndex:
        """The written index; ``passages_df`` are its passages where it was saved without a copy of them."""
        settings = spark.read.schema(SETTINGS).parquet(f"{path}/settings").first()
        counted = spark.read.schema(COUNTED).parquet(f"{path}/counted")
        if passages_df is None:
            passages_df = spark.read.parquet(f"{path}/passages")
        return PassageIndex(passages_df, counted, tuple(ids), *settings, written=True)


SETTINGS = "n_passages bigint, n_blocks bigint, max_share double"
COUNTED = "_block int, bucket int, data binary"


def _in_blocks(passages_df: DataFrame, ids: Sequence[str], n_blocks: int, factor: Column | None = None) -> DataFrame:
    """Blocks of passages by a digest of their ids: ``_block, data``, many passages compressed to a row (ids, ``factor`` if one is
    given, and ``_words``, the text's words with a space after each).

    Where the last of several ids is a whole number, runs of neighbouring passages go to one block: they begin alike and
    share terms, so that texts and terms get shorter.
    """
    near = [F.col(c) for c in ids]
    if len(ids) > 1 and isinstance(passages_df.schema[ids[-1]].dataType, IntegralType):
        near[-1] = F.shiftright(near[-1].cast("bigint"), NEAR_SHIFT)
    block = F.pmod(F.xxhash64(*near), F.lit(n_blocks)).cast("int")
    letters = zlib.compress(np.packbits(_word_characters(passages_df.sparkSession)).tobytes())

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        own = table.column("_block").to_numpy()
        order = np.argsort(own, kind="stable")
        blocks, first = np.unique(own[order], return_index=True)
        rows, ends = table.drop_columns("_block").take(pa.array(order)), [*first[1:].tolist(), len(order)]
        data = [_packed_table(rows.slice(a, b - a)) for a, b in zip(first.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], ["_block", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(zlib.decompress(letters), np.uint8)).view(bool)
        held, size = [], 0
        for batch in _sliced(batches, "_words"):
            cut = _only_words(batch.column("_words"), known)
            held.append(batch.set_column(batch.schema.get_field_index("_words"), "_words", cut))
            size += held[-1].nbytes
            if size >= PACKED_BYTES:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    # the sign after each text keeps words of two texts apart
    lowered = F.concat(F.lower(S.column("text")), F.lit("\n")).alias("_words")
    factors = [] if factor is None else [factor.alias("_factor")]
    return passages_df.select(block.alias("_block"), *ids, *factors, lowered).mapInArrow(pack, "_block int, data binary")


_LETTERS: list[np.ndarray] = []


def _word_characters(spark: SparkSession) -> np.ndarray:
    """Which code points are part of words, as Spark's own patterns tell; found once."""
    if not _LETTERS:
        width = 1 << 12
        blocks = [["".join(chr(c) for c in range(k, k + width) if not 0xD800 <= c < 0xE000)] for k in range(0, 0x110000, width)]
        kept = spark.createDataFrame(blocks, "c string").select(F.regexp_replace("c", WORD[: WORD.index("]")].replace("[", "[^") + "]", "").alias("c"))
        found = np.zeros(0x110000, bool)
        found[[ord(c) for row in kept.collect() for c in row["c"]]] = True
        _LETTERS.append(found)
    return _LETTERS[0]


def _sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``SLICE_BYTES`` of text, and at least one row."""
    for batch in batches:
        at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins and ends in them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _only_words(texts: pa.Array, known: np.ndarray) -> pa.Array:
    """Of each lower-cased text that ends with a sign between words (or is null): its words of two or more characters, a space after each."""
    data, offsets = _bytes_of(texts.fill_null(""))
    inside = known[:256][data] & (data < 128)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        follow = 1 + (data[lead] >= 0xE0).astype(np.int8) + (data[lead] >= 0xF0)
        padded = np.append(data, np.zeros(3, np.uint8))
        point = data[lead].astype(np.int32) & np.array([0, 0x1F, 0x0F, 0x07])[follow]
        whole = np.ones(len(lead), bool)
        for step in range(1, 4):
            more = follow >= step
            byte = padded[lead + step]
            whole &= ~more | ((byte & 0xC0) == 0x80)
            point = np.where(more, (point << 6) | (byte & 0x3F), point)
        good = whole & (point < len(known)) & known[np.minimum(point, len(known) - 1)]
        for step in range(4):
            inside[lead[good & (follow >= step)] + step] = True
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[0::2], edges[1::2]
    size, first = ends - starts, data[starts]
    single = size == 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    for step in range(4):
        inside[starts[single & (size > step)] + step] = False
    starts, ends = starts[~single], ends[~single]
    inside[ends] = True
    spaced = data.copy()
    spaced[ends] = ord(" ")
    kept = spaced[inside]
    places = np.concatenate([[0], np.cumsum(ends - starts + 1)])[np.searchsorted(starts, offsets)]
    buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(kept)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), buffers).cast(pa.string())


def _packed(**columns) -> bytes:
    return _packed_table(pa.table(columns))


def _packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACKED_LEVEL))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all()


def _packed_terms(terms: pa.Array, counts: np.ndarray) -> bytes:
    """Sorted terms and a number for each: of a term only what differs from the one before it, lengths apart from bytes."""
    return _packed_lists(terms, counts, np.array([0, len(terms)]))[0]


def _packed_lists(terms: pa.Array, counts: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """``_packed_terms`` of each stretch of the terms; a stretch begins and ends where ``bounds`` say."""
    data, offsets = _bytes_of(terms)
    start, size = offsets[:-1], np.diff(offsets)
    shared, opens, own = np.zeros(len(terms), np.int64), np.zeros(len(terms) + 1, bool), np.ones(len(data), bool)
    opens[bounds] = True
    live = np.flatnonzero(~opens[:-1])
    for place in range(MOST_SHARED):
        live = live[np.minimum(size[live], size[live - 1]) > place]
        live = live[data[start[live] + place] == data[start[live - 1] + place]]
        if not len(live):
            break
        shared[live] += 1
        own[start[live] + place] = False
    rest, kept = size - shared, data[own]
    ends = np.concatenate([[0], np.cumsum(rest)])[bounds]
    shared, out = shared.astype(np.uint8), []
    for k in range(len(bounds) - 1):
        some = slice(bounds[k], bounds[k + 1])
        parts = [shared[some].tobytes(), _by_byte(rest[some]), _by_byte(counts[some]), kept[ends[k] : ends[k + 1]].tobytes()]
        out.append(_squeezed(int(bounds[k + 1] - bounds[k]).to_bytes(8, "little") + b"".join(parts)))
    return out


def _unpacked_terms(raw: pa.BinaryScalar) -> tuple[pa.Array, np.ndarray]:
    """What ``_packed_terms`` packed."""
    return _unpacked_lists([raw])[:2]


def _unpacked_lists(raws: Sequence[pa.BinaryScalar]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What was packed into each of several lists, one after another, and where each ends."""
    held, sizes = [], []
    for raw in raws:
        own = _released(raw)
        n = int.from_bytes(own[:8].tobytes(), "little")
        held.append((own[8 : 8 + n], _from_bytes(own[8 + n : 8 + 9 * n]), _from_bytes(own[8 + 9 * n : 8 + 17 * n]), own[8 + 17 * n :]))
        sizes.append(n)
    shared, rest, counts, kept = (np.concatenate([x[k] for x in held]) for k in range(4)) if held else (np.zeros(0, np.int64),) * 4
    offsets = np.concatenate([[0], np.cumsum(shared + rest)])
    start, own = offsets[:-1], np.cumsum(rest) - rest
    data, written = np.empty(offsets[-1], np.uint8), np.ones(offsets[-1], bool)
    for place in range(int(shared.max(initial=0))):
        # a byte that is not written is that of the last term before which wrote it
        writer = np.maximum.accumulate(np.where(shared <= place, np.arange(len(shared), dtype=np.int32), 0))
        need = np.flatnonzero(shared > place)
        writer = writer[need]
        data[start[need] + place] = kept[own[writer] + place - shared[writer]]
        written[start[need] + place] = False
    data[written] = kept
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(shared), buffers).cast(pa.string()), counts, np.cumsum(sizes)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", PACKED_LEVEL).compress(raw, asbytes=True)


def _released(raw: pa.BinaryScalar) -> np.ndarray:
    """The bytes that ``_squeezed`` was given."""
    held = raw.as_buffer()
    return np.frombuffer(pa.Codec("zstd").decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little")), np.uint8)


def _by_byte(numbers: np.ndarray) -> bytes:
    """Numbers with all their lowest bytes first, then the next ones: most are small, and zeros pack to nothing."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").reshape(-1)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _passages_of(block: pa.Table) -> pa.Table:
    pa.default_memory_pool().release_unused()  # what blocks before have left
    return pa.concat_tables([_unpacked(raw) for raw in block.column("data")])


@dataclass
class Cut:
    """A block's passages cut into terms: each passage's first row, then (passage, term, occurrences) as three arrays sorted by term
    and passage, the block's words, sorted, and its terms as numbers.

    A word alone is its place in the words times one more than there are words; a pair adds one more than the place of its second
    word. So numbers sort as the terms' texts do, no pair is written out, and equal terms of two blocks have equal texts.
    """

    first: np.ndarray
    passage: np.ndarray
    code: np.ndarray
    times: np.ndarray
    words: pa.Array
    terms: np.ndarray


def _cut(table: pa.Table, ids: Sequence[str]) -> Cut:
    """Rows of the same ids are one passage."""
    number = np.zeros(table.num_rows, np.int64)
    for c in ids:
        own = _flat(table.column(c)).dictionary_encode(null_encoding="encode")
        _, first, number = np.unique(number * (len(own.dictionary) + 1) + own.indices.to_numpy(), return_index=True, return_inverse=True)
    data, offsets = _bytes_of(_flat(table.column("_words")))
    gap = data == ord(" ")
    ends = np.flatnonzero(gap)
    row = np.repeat(number, np.diff(np.searchsorted(ends, offsets)))
    # a word that ends a row has no neighbour after it
    last = np.zeros(len(ends), bool)
    if len(ends):
        last[np.searchsorted(ends, offsets[1:]) - 1] = True
    sizes = np.diff(ends, prepend=-1) - 1
    buffers = [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data[~gap])]
    encoded = pa.Array.from_buffers(pa.large_string(), len(ends), buffers).dictionary_encode()
    del data, gap, buffers
    order = pc.sort_indices(encoded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    word = place[encoded.indices.to_numpy()]
    left = np.flatnonzero(~last)
    base, n, alone = len(order) + 1, max(1, len(first)), len(word)
    # in place: these arrays are the most that a task holds
    cells = np.concatenate([word, word[left]])
    cells *= base
    cells[alone:] += word[left + 1] + 1
    terms = None
    if base * base * n >= 1 << 63:  # term and passage do not fit one number: terms are numbered first
        terms, cells = np.unique(cells, return_inverse=True)
    cells *= n
    cells[:alone] += row
    cells[alone:] += row[left]
    del word, row, left, last, ends, sizes
    cells.sort()
    fresh = np.ones(len(cells), bool)
    fresh[1:] = cells[1:] != cells[:-1]
    new = np.flatnonzero(fresh)
    times, cells = np.diff(new, append=len(cells)), cells[new]
    del new, fresh
    code, passage = np.divmod(cells, n)
    if terms is None:
        begin = np.diff(code, prepend=-1) > 0
        terms, code = code[begin], np.cumsum(begin) - 1
    return Cut(first, passage, code, times, encoded.dictionary.take(order), terms)


def _term_texts(words: pa.Array, terms: np.ndarray) -> pa.Array:
    """The texts of terms that are numbers (see ``Cut``)."""
    a, b = np.divmod(terms, len(words) + 1)
    one = words.take(pa.array(a))
    if not len(words):
        return one.cast(pa.string())
    two = pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(b - 1, 0))), pa.scalar(" ", pa.large_string()))
    return pc.if_else(pa.array(b == 0), one, two).cast(pa.string())


def _dealt(cut: Cut, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms' places in order of their buckets, and where each bucket begins and ends in them."""
    own = pd.util.hash_array(cut.words.to_numpy(zero_copy_only=False), categorize=False)
    a, b = np.divmod(cut.terms, len(cut.words) + 1)
    mixed = own[a]
    pair = b > 0
    mixed[pair] = (mixed[pair] * np.uint64(0x9E3779B97F4A7C15)) ^ own[b[pair] - 1]
    mixed ^= mixed >> np.uint64(32)
    bucket = mixed % np.uint64(n_blocks)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_blocks + 1))


def count_terms(texts: DataFrame, ids: Sequence[str], n_blocks: int) -> DataFrame:
    """In how many passages (``texts``, see ``_in_blocks``) each term stands: ``_block, bucket, data``.

    A block of passages sends each of its terms once, without what it shares with the one before, to the term's bucket. What a bucket finds goes into two
    kinds of rows: under ``_block`` -1 its terms and their frequencies, and for each block the frequencies alone, in the
    order of the block's terms. So no term of a passage is ever shuffled by itself, neither there nor back.
    """

    def send(key: tuple, table: pa.Table) -> pa.Table:
        cut = _cut(_passages_of(table), ids)
        n = np.bincount(cut.code, minlength=len(cut.terms))
        order, bounds = _dealt(cut, n_blocks)
        used = np.flatnonzero(np.diff(bounds))
        data = _packed_lists(_term_texts(cut.words, cut.terms[order]), n[order], np.append(bounds[used], len(order)))
        return pa.table({"_block": pa.array([key[0].as_py()] * len(used), pa.int32()), "bucket": pa.array(used, pa.int32()), "data": pa.array(data, pa.binary())})

    def count(key: tuple, table: pa.Table) -> pa.Table:
        terms, n, ends = _unpacked_lists(table.column("data"))
        term = terms.dictionary_encode()
        code = term.indices.to_numpy()
        df = np.bincount(code, n).astype(np.int64)
        order = pc.sort_indices(term.dictionary)
        data = [_packed_terms(term.dictionary.take(order), df[order.to_numpy()])]
        data += [_squeezed(_by_byte(df[x])) for x in np.split(code, ends[:-1])]
        blocks = pa.concat_arrays([pa.array([-1], pa.int32()), _flat(table.column("_block"))])
        return pa.table({"_block": blocks, "bucket": pa.array([key[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    ids = tuple(ids)
    sent = texts.groupBy("_block").applyInArrow(send, COUNTED)
    return sent.groupBy("bucket").applyInArrow(count, COUNTED)


def vocabulary(counted: DataFrame) -> DataFrame:
    """``term, df`` of every term."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("data"):
                term, df = _unpacked_terms(raw)
                yield from pa.table({"term": term, "df": pa.array(df)}).to_batches(max_chunksize=1 << 16)

    return counted.where("_block = -1").select("data").mapInArrow(listed, "term string, df bigint")


def _weighing(ids: Sequence[str], n_passages: int, n_blocks: int, max_share: float):
    """Weights of a block of passages from the frequencies that were found for its terms: the block's rows, its terms, and
    (passage, term, weight) as three arrays, terms in too many passages left out."""

    def weigh(block: pa.Table, found: pa.Table) -> tuple[pa.Table, Cut, np.ndarray, np.ndarray, np.ndarray]:
        table = _passages_of(block)
        cut = _cut(table, ids)
        table = table.drop_columns("_words")
        order, _ = _dealt(cut, n_blocks)
        parts = found.take(pc.sort_indices(found, [("bucket", "ascending")])).column("data")
        df = np.zeros(len(cut.terms))
        df[order] = np.concatenate([np.zeros(0), *(_from_bytes(_released(raw)) for raw in parts)])
        idf = np.log((1.0 + n_passages) / (1.0 + df)) + 1
        known = (df <= n_passages * max_share)[cut.code]
        passage, code = cut.passage[known], cut.code[known]
        w = cut.times[known] * idf[code]
        norm = np.sqrt(np.bincount(passage, w * w, len(cut.first)))
        return table, cut, passage, code, w / norm[passage]

    return weigh


def term_counts(df: DataFrame, ids: Sequence[str], text: str = "text") -> DataFrame:
    """Occurrences of each term in each row: ``ids, term, tf``.

    Texts are spread by their ids before they are cut into terms. The terms of a row then already
    sit where they are counted: the text is shuffled, not its many times larger list of terms.
    """
    spread = df.select(*ids, S.column(text).alias("_text")).repartition(*ids)
    cut = spread.select(*ids, words(F.col("_text")).alias("_words"))
    exploded = cut.select(*ids, F.explode(F.concat("_words", neighbours(F.col("_words")))).alias("term"))
    return exploded.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequencies(frequencies: DataFrame, n_passages: int, max_share: float = P.MAX_DOCUMENT_SHARE) -> DataFrame:
    """``term, df, idf`` of every term found in at most ``max_share`` of the passages."""
    idf = F.log((F.lit(1.0) + F.lit(n_passages)) / (F.lit(1.0) + F.col("df"))) + 1
    return frequencies.where(F.col("df") <= F.lit(n_passages) * F.lit(max_share)).select("term", "df", idf.alias("idf"))


def build_index(
    passages_df: DataFrame, ids: Sequence[str] = ("source", "passage_no"), max_share: float = P.MAX_DOCUMENT_SHARE, block_chars: int = BLOCK_CHARS
) -> PassageIndex:
    """Fit the index: how often terms occur; the rest follows from it and the passages. ``kept`` or ``save`` write it."""
    n_passages, chars = passages_df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = 1 + chars // block_chars
    texts = _in_blocks(passages_df, ids, n_blocks)
    return PassageIndex(passages_df, count_terms(texts, ids, n_blocks), tuple(ids), n_passages, n_blocks, max_share, texts)


def index_documents(documents: DataFrame, source: str = "source", text: str = "text") -> PassageIndex:
    """The whole way from text files to index; refuses an empty folder."""
    cut = passages(documents, source, text)
    if cut.isEmpty():
        raise ValueError("No document to index.")
    return build_index(cut)


def query_vectors(idf: DataFrame, questions: DataFrame, question_id: str, text: str, also: Sequence[str] = ()) -> DataFrame:
    """Unit-length term weights of each question (and value of the columns ``also``) over the index vocabulary."""
    keys = ["query_id", *also]
    counts = term_counts(questions.select(S.column(question_id).alias("query_id"), *also, S.column(text).alias("text")), keys)
    # of a vocabulary as long as the passages, only what the questions may hold is shuffled
    asked = idf.withColumn("_bits", member_bits(counts, "term")).where(may_be_member("term", "_bits")).drop("_bits")
    weighted = counts.join(asked, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "term", (F.col("w") / norm).alias("weight"))


# ---------------------------------------------------------------------- scoring


def rank_passages(
    index: PassageIndex,
    questions: DataFrame,
    question_id: str,
    text: str,
    k: int = P.TOP_PASSAGES,
    boosted: Sequence[str] = (),
    boost: float = P.PRIORITY_BOOST,
    source: str = "source",
    block: int = BLOCK_QUESTIONS,
) -> DataFrame:
    """The ``k`` best passages of each question with a positive score: ``query_id, ids, score, rank``.

    Scores are cosines, multiplied by ``boost`` for the named sources; ties go to the lowest ids.

    Questions are cut into blocks of about ``block``. The vectors of one block are held by every task:
    passages stream by, each task scores its passages against the whole block and keeps its own best, so
    no pair of question and passage is ever shuffled.
    """
    asked = questions.select(S.column(question_id).alias("query_id"), F.lit(1).alias("phrasing"), S.column(text).alias("text"))
    return _rank_phrasings(index, asked, k, boosted, boost, source, block).drop("phrasing")


def _rank_phrasings(
    index: PassageIndex,
    asked: DataFrame,
    k: int = P.TOP_PASSAGES,
    boosted: Sequence[str] = (),
    boost: float = P.PRIORITY_BOOST,
    source: str = "source",
    block: int = BLOCK_QUESTIONS,
) -> DataFrame:
    """``rank_passages`` of several phrasings (``query_id, phrasing, text``) by the same passes: ``query_id, ids, score, rank, phrasing``."""
    index = index.kept()
    spark = index.passages.sparkSession
    path = new_work_path(spark, "question-vectors")
    blocks = max(1, -(-asked.count() // block))
    vectors = query_vectors(index.idf, asked, "query_id", "text", ["phrasing"])
    vectors.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).write.partitionBy("_block").parquet(path)
    kinds = vectors.schema.simpleString()[7:-1].replace(":", " ")
    written = spark.read.schema(f"{kinds}, _block bigint").parquet(path)
    query_type = vectors.schema["query_id"].dataType.simpleString()
    parts = []
    # questions without an id are not ranked
    for number in range(blocks):
        held = written.where((F.col("_block") == number) & F.col("query_id").isNotNull()).select("query_id", "phrasing", "term", "weight").toPandas()
        parts.append(_rank_against_held(index, held, query_type, k, boosted, boost, source))
    order = Window.partitionBy("query_id", "phrasing").orderBy(F.desc("score"), *[F.asc(c) for c in index.ids])
    ranked = union_all(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", *index.ids, "score", "rank", "phrasing")


def _boost(score: Column, boosted: Sequence[str], boost: float, source: str) -> Column:
    if not boosted:
        return score
    return F.when(S.column(source).isin(*boosted), score * boost).otherwise(score)


def _rank_against_held(
    index: PassageIndex,
    held: pd.DataFrame,
    query_type: str,
    k: int,
    boosted: Sequence[str],
    boost: float,
    source: str,
) -> DataFrame:
    """Best passages of each block of passages, scored where its weights are found; terms no question has are skipped."""
    ids = list(index.ids)
    digits = SCORE_DIGITS
    # questions are numbered, each phrasing by itself
    held = held.sort_values(["term", "query_id", "phrasing"], kind="stable").reset_index(drop=True)
    vocabulary = pd.Index(held["term"].unique())
    questions = held[["query_id", "phrasing"]].drop_duplicates(ignore_index=True)
    term_of = vocabulary.get_indexer(held["term"])
    query_of = pd.MultiIndex.from_frame(questions).get_indexer(pd.MultiIndex.from_frame(held[["query_id", "phrasing"]]))
    starts = np.searchsorted(term_of, np.arange(len(vocabulary) + 1))
    weights = held["weight"].to_numpy()
    # a term's first word, and its second or null
    split = [t.split(" ", 1) for t in vocabulary]
    one, two = (pa.array([x[k] if len(x) > k else None for x in split], pa.large_string()) for k in (0, 1))
    spark = index.passages.sparkSession
    shared = spark.sparkContext.broadcast((one, two, questions, starts, query_of, weights))
    weigh = _weighing(index.ids, index.n_passages, index.n_blocks, index.max_share)
    schema = f"query_id {query_type}, phrasing int, {index.id_kinds}, score double"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def score(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        one, two, questions, starts, query_of, weights = shared.value
        table, cut, passage, code, weight = weigh(block, found)
        # where each of the block's terms stands among the questions' terms, or -1
        a, b = (pc.index_in(x, value_set=cut.words) for x in (one, two))
        here = np.flatnonzero(pc.and_(a.is_valid(), pc.or_(two.is_null(), b.is_valid())).to_numpy(zero_copy_only=False))
        wanted = a.fill_null(0).to_numpy().astype(np.int64)[here] * (len(cut.words) + 1) + (b.fill_null(-1).to_numpy().astype(np.int64)[here] + 1)
        at = np.minimum(np.searchsorted(cut.terms, wanted), max(0, len(cut.terms) - 1))
        same = cut.terms[at] == wanted if len(cut.terms) else np.zeros(len(wanted), bool)
        asked = np.full(len(cut.terms), -1)
        asked[at[same]] = here[same]
        hits = np.flatnonzero(asked[code] >= 0)
        if not len(hits):
            return empty
        hits = hits[np.argsort(passage[hits], kind="stable")]
        term, passage, weight = asked[code[hits]], passage[hits], weight[hits]
        rows, own = np.unique(passage, return_inverse=True)
        factor = _flat(table.column("_factor")).to_numpy()[cut.first[rows]] if "_factor" in table.column_names else np.ones(len(rows))
        keys = table.select(ids).take(pa.array(cut.first[rows]))
        # nulls first, as in the last ranking
        by_ids = pc.sort_indices(keys, [(c, "ascending") for c in ids], null_placement="at_start").to_numpy()
        place = np.empty(len(rows), np.int64)
        place[by_ids] = np.arange(len(rows))
        n = len(questions)
        floor = np.zeros(n)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        per_round = max(1, ROUND_SCORES // n)
        for start in range(0, len(rows), per_round):
            part = slice(*np.searchsorted(own, [start, start + per_round]))
            size = min(per_round, len(rows) - start)
            times = starts[term[part] + 1] - starts[term[part]]
            places = _runs(starts[term[part]], times)
            cells = np.repeat((own[part] - start) * n, times) + query_of[places]
            products = np.repeat(weight[part], times) * weights[places]
            scores = np.bincount(cells, products, size * n).reshape(size, n)
            scores = np.round(scores * factor[start : start + size, None], digits)
            # only scores reaching a question's current k-th best can still matter
            if size > k:
                floor = np.maximum(floor, np.partition(scores, size - k, axis=0)[size - k])
            row, question = np.nonzero((scores > 0) & (scores >= floor))
            best = [np.concatenate(x) for x in zip(best, (question, row + start, scores[row, question]))]
            order = np.lexsort((place[best[1]], -best[2], best[0]))
            best = [x[order] for x in best]
            rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [x[rank < k] for x in best]
            full = best[0][rank[rank < k] == k - 1]
            floor[full] = np.maximum(floor[full], best[2][rank[rank < k] == k - 1])
        asked_by = questions.iloc[best[0]]
        columns = [pa.array(asked_by["query_id"]), pa.array(asked_by["phrasing"]), *keys.take(pa.array(best[1])).columns, pa.array(best[2])]
        return pa.table(dict(zip(empty.column_names, columns))).cast(empty.schema)

    factor = _boost(F.lit(1.0), boosted, boost, source) if boosted else None
    return index.by_block(score, schema, factor)


def best_phrasing(
    index: PassageIndex,
    questions: DataFrame,
    question_id: str,
    text: str,
    rephrased: str,
    k: int = P.TOP_PASSAGES,
    weak: float = P.WEAK_SCORE,
    **settings,
) -> DataFrame:
    """Ranked passages, using a second phrasing where the first finds only weak ones and the second
    finds a better one. Questions without a second phrasing keep the first."""
    usable = questions.where(
        S.column(rephrased).isNotNull()
        & (F.length(F.trim(S.column(rephrased))) > 0)
        & (F.lower(F.trim(S.column(rephrased))) != F.lower(F.trim(S.column(text))))
    )
    # both by one pass over the passages
    asked = [
        rows.select(S.column(question_id).alias("query_id"), F.lit(number).alias("phrasing"), S.column(c).alias("text"))
        for number, rows, c in ((1, questions, text), (2, usable, rephrased))
    ]
    ranked = _rank_phrasings(index, union_all(asked), k, **settings)
    # At most 2k rows per question.
    same_question = Window.partitionBy("query_id")

    def top(phrasing: int) -> Column:
        return F.max(F.when(F.col("phrasing") == phrasing, F.col("score"))).over(same_question)

    both = (
        ranked.withColumn("_top1", F.coalesce(top(1), F.lit(0.0)))
        .withColumn("_top2", top(2))
        .withColumn("_better", F.coalesce((F.col("_top1") < weak) & (F.col("_top2") > F.col("_top1")), F.lit(False)))
    )
    chosen = both.where((F.col("phrasing") == 2) == F.col("_better"))
    return chosen.drop("_top1", "_top2", "_better")


def contexts(index: PassageIndex, ranked: DataFrame) -> DataFrame:
    """The passages of each question as one bulleted text, best first: ``query_id, context``.

    The ranking is written, since it is used twice: its passages are told by a filter before any text is shuffled.
    """
    spark, path = index.passages.sparkSession, new_work_path(index.passages.sparkSession, "ranked-passages")
    ranked.write.parquet(path)
    ranked = spark.read.schema(ranked.schema).parquet(path)
    key = F.xxhash64(*[F.col(c).cast(index.passages.schema[c].dataType) for c in index.ids]).alias("_key")
    texts = index.passages.select(*index.ids, "text", key).withColumn("_bits", member_bits(ranked.select(key), "_key"))
    with_text = ranked.join(texts.where(may_be_member("_key", "_bits")).drop("_key", "_bits"), list(index.ids))
    listed = with_text.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    return listed.select(
        "query_id",
        F.array_join(F.transform("found", lambda p: F.concat(F.lit("- "), p["text"])), "\n").alias("context"),
    )
