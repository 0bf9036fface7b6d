"""Token ids in bit-packed binary files.

Documents are range-partitioned and sorted by id; each task encodes its texts and writes one shard: every id takes the
minimum number of bits of the vocabulary, in blocks of a fixed number of ids whose offsets stand in an index, so that
any stretch of ids is found and unpacked with numpy alone. Shards are written under a fresh name and count only once the
manifest, which Spark commits, names them; a lost task leaves an unnamed file and is run again.

Layout of a shard, little-endian: the blocks; u64 block offsets (one more than blocks), i64 document ids, u64 document
starts (one more than documents); then a tail of 8 bytes magic and u64 bits, block size, ids, blocks, documents, documents
without an id and the place of the index. The tail comes last because object stores write front to back only.

Null text counts as empty: its document is the end id alone. Documents with equal ids stand next to each other, ordered
by text; null ids come first, stored as 0 and counted in the tail. No rows give no shards. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthcheck.llm.common import mixed, rows_of, slices, utf8_parts
from hearthcheck.session import new_work_path

MAGIC = b"BITIDS01"
TAIL = 8 + 7 * 8
BLOCK = 4096
END_ID = 0
SHARD_CHARS = 64 << 20
CACHE_UNITS = 3_000_000  # about 40 bytes each
JOINED_UNITS = 2_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits], bitorder="little").tobytes()


def unpack(raw: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Takes documents one after another and writes whole blocks as they fill."""

    def __init__(self, stream, bits: int, block: int = BLOCK) -> None:
        self.stream, self.bits, self.block = stream, bits, block
        self.rest, self.offsets, self.at, self.total = np.zeros(0, "<u4"), array("Q"), 0, 0
        self.ids, self.starts, self.nulls = array("q"), array("Q"), 0

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), self.block):
            raw = pack(ids[k : k + self.block], self.bits)
            self.offsets.append(self.at)
            self.stream.write(raw)
            self.at += len(raw)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` holds those of all the documents in a row."""
        self.nulls += doc_ids.count(None)
        self.ids.extend(x or 0 for x in doc_ids)
        self.starts.extend((self.total + np.cumsum(lengths) - lengths).tolist())
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % self.block
        self._blocks(ids[:whole])
        self.rest = ids[whole:].copy()

    def finish(self) -> None:
        """Write what is left, the index and the tail."""
        self._blocks(self.rest)
        index = self.at
        self.offsets.append(self.at)
        self.starts.append(self.total)
        for column, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.starts, "<u8")):
            self.stream.write(np.frombuffer(column, kind[1:]).astype(kind).tobytes() if len(column) else b"")
        numbers = [self.bits, self.block, self.total, len(self.offsets) - 1, len(self.ids), self.nulls, index]
        self.stream.write(MAGIC + np.array(numbers, "<u8").tobytes())


class ShardReader:
    """Random access to a shard: any stretch of ids, or one document at a time."""

    def __init__(self, store: pafs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - TAIL)
        tail = self.file.read(TAIL)
        if tail[:8] != MAGIC:
            raise ValueError(f"Not a shard of token ids: {path}")
        self.bits, self.block, self.total, blocks, docs, self.nulls, index = (int(x) for x in np.frombuffer(tail[8:], "<u8"))
        self.file.seek(index)
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(self.file.read(8 * docs), "<i8")
        self.starts = np.frombuffer(self.file.read(8 * (docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start``: only the blocks that hold them are read."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        raw, at, out = self.file.read(int(self.offsets[last + 1] - self.offsets[first])), 0, []
        for k in range(first, last + 1):
            held, size = min(self.block, self.total - k * self.block), int(self.offsets[k + 1] - self.offsets[k])
            out.append(unpack(raw[at : at + size], held, self.bits))
            at += size
        return np.concatenate(out)[start - first * self.block :][:count]


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it: plain paths are local, anything else is opened by its scheme."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


# Bytes of the white space that Python's str.isspace knows: one byte, and the leads and tails of longer ones.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WHITE_LONG = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
               b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to white space."""
    mask = _WHITE[data]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        for code in _WHITE_LONG:
            if code[0] == lead:
                found = at[at + len(code) <= len(data)]
                for k, byte in enumerate(code[1:], start=1):
                    found = found[data[found + k] == byte]
                for k in range(len(code)):
                    mask[found + k] = True
    return mask


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Does a letter of the Latin blocks up to U+024F end before each place?"""
    one, two = data[at - 1], data[np.maximum(at - 2, 0)]
    plain = ((one | 32) >= 97) & ((one | 32) <= 122) & (one < 128)
    marked = (two >= 0xC3) & (two <= 0xC9) & (one >= 0x80) & (one <= 0xBF) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ((two < 0xC9) | (one <= 0x8F))
    return plain | marked


def unit_starts(data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, at each single space between two non-spaces, and at a full stop or comma between a
    letter and such a space. Byte-level BPE never merges across these places. Empty texts have no unit."""
    begins = np.zeros(len(data), bool)
    if len(data):
        begins[1:-1] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
        rows = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[rows[rows > 0] - 1] = False  # the last byte of a text ends it
        begins[rows] = False
        before = np.flatnonzero(begins) - 1
        before = before[(data[before] == 46) | (data[before] == 44)]
        before = before[before > 0]
        begins[before[_after_letter(data, before)]] = True
        begins[rows] = True
    return np.flatnonzero(begins)


class _Encoder:
    """A tokenizer with the ids of the units met so far, by the sorted hashes of their bytes; kept by the worker."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():  # byte-level: one character of a token's name is one byte
            self.width[number] = len(token)
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray, single: np.ndarray) -> None:
        """Keep the ids of new units, given by rising hashes and where their bytes lie.

        Units that follow a space are encoded many in one text, and the ids are cut where a unit's bytes end;
        ``single`` ones are encoded each by itself.
        """
        order = np.argsort(single, kind="stable")  # the joined ones first
        hashes, starts, stops = hashes[order], starts[order], stops[order]
        n, flat, counts = int((~single).sum()), [], []
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        texts = [b"".join(pieces[k : min(k + JOINED_UNITS, n)]).decode() for k in range(0, n, JOINED_UNITS)]
        sizes = stops - starts
        for k, found in zip(range(0, n, JOINED_UNITS), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[k : min(k + JOINED_UNITS, n)]), side="left") + 1
            flat.append(ids)
            counts.append(np.diff(ends, prepend=0))
        for piece in pieces[n:]:
            flat.append(np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, np.uint32))
            counts.append(np.array([len(flat[-1])]))
        flat, counts = np.concatenate(flat), np.concatenate(counts)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        back = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[back])
        self.keys, self.first, self.count = (np.insert(old, at, new[back]) for old, new in ((self.keys, hashes), (self.first, first), (self.count, counts)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and how many each text has."""
        data, offsets = utf8_parts(column)
        white = _white(data)
        starts = unit_starts(data, offsets, white)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if len(self.keys) > CACHE_UNITS:
            self.forget()
        stops = np.append(starts[1:], len(data))
        hashes, first, unit = np.unique(byte_hashes(data, starts), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        if not known.all():
            new = first[~known]
            single = (data[starts[new]] != 32) | white[stops[new] - 1]
            self.learn(hashes[~known], data.tobytes(), starts[new], stops[new], single)
            at = np.searchsorted(self.keys, hashes)
        slots = at[unit]
        counts = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(counts)])
        where = np.arange(ends[-1]) + np.repeat(self.first[slots] - ends[:-1], counts)
        return self.ids[where], np.diff(ends[np.searchsorted(starts, offsets)])


def byte_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of bytes that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(data)))
    powers = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
    value = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mixed(np.add.reduceat(value, starts) ^ (sizes.astype(np.uint64) << np.uint64(40)))


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(tokenizer_file: str) -> _Encoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = _Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def encode_column(column: pa.Array, tokenizer_file: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and how many each has: each distinct unit goes to the tokenizer once, then is looked up by the 64-bit
    hash of its bytes."""
    return _encoder(tokenizer_file).encode(column)


def encode(texts: list[str], tokenizer_file: str) -> list[bytes]:
    """Ids of each text as little-endian u32 bytes."""
    ids, lengths = encode_column(pa.array(texts, pa.string()), tokenizer_file)
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


def _write(folder: str, tokenizer_file: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        path, writer, first = f"{root}/{uuid.uuid4().hex}.ids", None, None
        for batch in slices(batches):
            if writer is None:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(path)
                bits = bits_for(_encoder(tokenizer_file).tokenizer.get_vocab_size())  # only tasks load the tokenizer
                writer, first = ShardWriter(stream, bits, block), batch.column("doc_id")[0].as_py()
            ids, lengths = encode_column(batch.column("text"), tokenizer_file)
            writer.add(rows_of(batch, "doc_id"), lengths + 1, np.insert(ids, np.cumsum(lengths), END_ID))
        if writer is not None:
            writer.finish()
            stream.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.rsplit("/", 1)[1]]), pa.array([first], pa.int64()), pa.array([writer.total], pa.int64()),
                 pa.array([len(writer.ids)], pa.int64())],
                ["shard", "first_id", "n_ids", "n_docs"],
            )

    return run


MANIFEST = "shard string, first_id long, n_ids long, n_docs long"


def write_ids(docs: DataFrame, tokenizer_file: str, shard_chars: int = SHARD_CHARS, block: int = BLOCK) -> str:
    """Write all texts of (doc_id, text) as shards plus a manifest; gives the folder."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = new_work_path(spark, "token-ids")
    tie = F.xxhash64("text")
    dealt = slim.repartitionByRange(max(1, -(-chars // shard_chars)), F.col("doc_id"), tie)
    dealt = dealt.sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    dealt.mapInArrow(_write(f"{folder}/shards", tokenizer_file, block), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            for shard, before in zip(rows_of(batch, "shard"), rows_of(batch, "before")):
                reader = ShardReader(store, f"{root}/{shard}")
                n, at = len(reader.doc_ids), 0
                while at < n:
                    stop = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + (1 << 20), side="right")) - 1)
                    ids = reader.ids(int(reader.starts[at]), int(reader.starts[stop] - reader.starts[at]))
                    cut = reader.starts[at : stop + 1] - reader.starts[at]
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    some, none = reader.doc_ids[at:stop], np.arange(at, stop) < reader.nulls
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64(), mask=none), pa.array(before + reader.starts[at:stop]),
                         pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = stop

    return run


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per shard (64 million characters each): the running total is over the manifest, not over documents
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy(F.col("first_id").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.select("shard", before.alias("before"))
    return placed.repartition(max(1, shards.count()), "shard").mapInArrow(
        _read(f"{folder}/shards"), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
