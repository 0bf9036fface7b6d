"""Finding the newest export of each table in a folder of dated files, sub-folders or archives.

A listing is a DataFrame ``path, name, folder, modified, size``. Choosing files is done on the
listing with aggregates; file contents are only opened for what was chosen.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.session import new_work_path

# Extensions of table files, how an export date is written in a name, and the separators left around it.
TABLE_EXTENSIONS = ("csv", "xlsx", "xls", "dta")
READABLE_EXTENSIONS = ("csv", "parquet", "json", "orc")
YEAR_FIRST = r"(?<!\d)(20\d{2})[-_.](\d{2})[-_.](\d{2})(?!\d)"
COMPACT = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
DAY_FIRST = r"(?<!\d)(\d{2})[-_.](\d{2})[-_.](20\d{2})(?!\d)"
SEPARATOR_RUN = r"[_\-.\s]{2,}"
OUTER_SEPARATORS = r"^[_\-. ]+|[_\-. ]+$"


# ---------------------------------------------------------------------- names


def _date_from(name: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = [F.regexp_extract(name, pattern, i) for i in (year, month, day)]
    written = F.concat_ws("-", *part)
    return F.when(F.length(written) == 10, written.try_cast("date"))


def export_date(name: Column) -> Column:
    """The date in a file or folder name: year first, then compact, then day first; null when none is valid."""
    return F.coalesce(
        _date_from(name, YEAR_FIRST, 1, 2, 3), _date_from(name, COMPACT, 1, 2, 3), _date_from(name, DAY_FIRST, 3, 2, 1)
    )


def base_name(name: Column, extensions: Sequence[str] = TABLE_EXTENSIONS) -> Column:
    """The table a file belongs to: its name without extension and date."""
    bare = F.regexp_replace(name, rf"(?i)\.({'|'.join(extensions)})$", "")
    for pattern in (YEAR_FIRST, COMPACT, DAY_FIRST):
        bare = F.regexp_replace(bare, pattern, "")
    joined = F.regexp_replace(bare, SEPARATOR_RUN, "_")
    trimmed = F.regexp_replace(joined, OUTER_SEPARATORS, "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), name)


def is_table_file(name: Column, extensions: Sequence[str] = TABLE_EXTENSIONS) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(extensions)})$")


# ---------------------------------------------------------------------- listings


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Every file under a folder with its time and size; contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*")
        .load(folder)
    )
    parts = F.split(F.col("path"), "/")
    return files.select(
        F.col("path"),
        F.element_at(parts, -1).alias("name"),
        F.element_at(parts, -2).alias("folder"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
        F.col("length").alias("size"),
    )


def diagnose(files: DataFrame) -> DataFrame:
    """What a folder holds, unfiltered: each file with its kind, table and export date."""
    kind = (
        F.when(is_table_file(F.col("name")), "table")
        .when(F.lower("name").endswith(".zip"), "archive")
        .otherwise("other")
    )
    return files.select(
        "name", "folder", kind.alias("kind"), base_name(F.col("name")).alias("table"),
        export_date(F.col("name")).alias("export_date"), "modified", "size",
    )


def _age_key(dated: Column | None = None) -> Column:
    """Name date if there is one, else modification time; then modification time."""
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    named = (export_date(F.col("name")) if dated is None else dated).cast("timestamp_ntz")
    return F.struct(
        F.coalesce(named, F.col("modified"), never).alias("dated"), F.coalesce(F.col("modified"), never).alias("modified")
    )


def latest_per_table(files: DataFrame, extensions: Sequence[str] = TABLE_EXTENSIONS) -> DataFrame:
    """The newest file of each table. Of equally new ones, the first path wins.

    A grouped extreme, not a window: however many exports one table has, they combine map-side.
    """
    # The earliest path must win ties of a maximum, so the extreme is taken over the negated age.
    # Date and table are read from each different name once, however many files carry it.
    tables = files.where(is_table_file(F.col("name"), extensions))
    names = tables.select("name").distinct().select(
        F.col("name").alias("_name"), export_date(F.col("name")).alias("_named"), base_name(F.col("name"), extensions).alias("table")
    )
    named = tables.join(names, F.col("name") == F.col("_name")).withColumn("_age", _age_key(F.col("_named")))
    chosen = named.groupBy("table").agg(
        F.min(
            F.struct(
                (-F.unix_micros(F.col("_age.dated").cast("timestamp"))).alias("a"),
                (-F.unix_micros(F.col("_age.modified").cast("timestamp"))).alias("b"),
                "path", "name", "folder", "modified", "size", F.col("_named").alias("export_date"),
            )
        ).alias("f")
    )
    return chosen.select(
        "table", "f.path", "f.name", "f.folder", "f.export_date", "f.modified", "f.size"
    )


def latest_batch(files: DataFrame, root: str) -> DataFrame:
    """Files of the newest sub-folder of ``root``, or of ``root`` itself when it has none.

    A folder is dated by its name, else by its newest file.
    """
    inside = F.regexp_replace(F.col("path"), "^file:/+", "/")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/" if root.startswith("file:") else root.rstrip("/") + "/"
    relative = F.regexp_replace(F.replace(inside, F.lit(start), F.lit("")), "^/+", "")
    batch = F.when(F.contains(relative, F.lit("/")), F.split(relative, "/").getItem(0)).otherwise(F.lit(""))
    placed = files.withColumn("batch", batch)
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    folders = placed.where("batch <> ''").groupBy("batch").agg(F.max("modified").alias("touched"))
    dated = folders.select(
        F.struct(
            F.coalesce(export_date(F.col("batch")).cast("timestamp_ntz"), F.col("touched"), never),
            F.coalesce(F.col("touched"), never),
        ).alias("age"),
        "batch",
    )
    newest = F.coalesce(dated.agg(F.max_by("batch", "age").alias("b")).scalar(), F.lit(""))
    direct = F.when(F.col("batch") == "", True).otherwise(F.size(F.split(relative, "/")) == 2)
    return placed.where((F.col("batch") == newest) & direct)


def tables_or_archive(batch: DataFrame) -> DataFrame:
    """The table files of a batch; when it shows none, its newest archive."""
    tables = batch.where(is_table_file(F.col("name")))
    n_tables = tables.agg(F.count(F.lit(1)).alias("n")).scalar()
    archives = batch.where(F.lower("name").endswith(".zip")).withColumn("_age", _age_key())
    newest = archives.agg(F.max_by("path", "_age").alias("p")).scalar()
    return batch.where(is_table_file(F.col("name")) | ((n_tables == 0) & (F.col("path") == newest)))


# ---------------------------------------------------------------------- archives

PIECE_BYTES = 1 << 20
FILE_PIECES = 128  # pieces of a member that go to one file
CHUNK_BYTES = 64 << 20
MEMBERS = "archive string, member string, part string, chunk bigint, method int, crc bigint, size bigint, data binary, error string"
PIECES = "archive string, member string, part string, piece bigint, value string, error string"
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)


def _is_table_member(name: str) -> bool:
    """Text tables only; system leftovers, folders and hidden files are not tables."""
    own = name.rsplit("/", 1)[-1]
    return own.lower().endswith(".csv") and not own.startswith(".") and "__MACOSX" not in name.split("/")


def _stored_bytes(content: bytes, info: zipfile.ZipInfo) -> memoryview:
    """A member as it lies in the archive, still compressed."""
    at = info.header_offset
    if content[at : at + 4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"No member at byte {at}")
    start = at + 30 + sum(struct.unpack("<HH", content[at + 26 : at + 30]))
    data = memoryview(content)[start : start + info.compress_size]
    if len(data) < info.compress_size:
        raise zipfile.BadZipFile("The archive ends inside a member")
    return data


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the members of each archive, compressed as they are: the archive's own listing says where they lie."""
    names = [x.split()[0] for x in MEMBERS.split(", ")]

    def row(path: str, member: str, part=None, chunk=None, method=None, crc=None, size=None, data=None, error=None) -> pd.DataFrame:
        return pd.DataFrame([(path, member, part, chunk, method, crc, size, data, error)], columns=names)

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except BROKEN as problem:
                yield row(path, path.rsplit("/", 1)[-1], error=str(problem))
                continue
            for info in filter(lambda i: _is_table_member(i.filename), archive.infolist()):
                member, part = info.filename.rsplit("/", 1)[-1], f"{zlib.crc32(path.encode()):08x}{info.header_offset:012x}"
                method = info.compress_type
                try:
                    if method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.flag_bits & 1:
                        data = _stored_bytes(content, info)
                    else:
                        method, data = zipfile.ZIP_STORED, archive.read(info)
                except BROKEN as problem:
                    yield row(path, member, part, error=str(problem))
                    continue
                for n, at in enumerate(range(0, max(1, len(data)), CHUNK_BYTES)):
                    yield row(path, member, part, n, method, info.CRC, info.file_size, bytes(data[at : at + CHUNK_BYTES]))


class _Member:
    """One member being unpacked: compressed chunks in, pieces of whole lines out."""

    def __init__(self, first, piece_bytes: int, file_pieces: int):
        self.first, self.piece_bytes, self.file_pieces = first, piece_bytes, file_pieces
        self.inflate = zlib.decompressobj(-15) if first.method == zipfile.ZIP_DEFLATED else None
        self.crc, self.size, self.rest, self.header, self.pieces, self.problem = 0, 0, b"", "", 0, None

    def _plain(self, data: bytes) -> Iterator[bytes]:
        if self.inflate is None:
            yield from (data[k : k + self.piece_bytes] for k in range(0, len(data), self.piece_bytes))
            return
        while data:
            yield self.inflate.decompress(data, self.piece_bytes)
            data = self.inflate.unconsumed_tail

    def _piece(self, lines: bytes) -> tuple[int, str]:
        """The number and text of a piece; each file's first one begins with the member's header."""
        text, n = lines.decode("utf-8", "replace"), self.pieces
        if n == 0:
            text = text.lstrip("\ufeff")
            self.header = text.partition("\n")[0]
        elif n % self.file_pieces == 0:
            text = f"{self.header}\n{text}"
        self.pieces += 1
        return n, text

    def feed(self, data: bytes) -> Iterator[tuple[int, str]]:
        for raw in self._plain(data):
            yield from self._lines(raw)

    def _lines(self, raw: bytes) -> Iterator[tuple[int, str]]:
        self.crc, self.size = zlib.crc32(raw, self.crc), self.size + len(raw)
        lines, _, self.rest = (self.rest + raw).rpartition(b"\n")
        if lines:
            yield self._piece(lines)

    def finish(self) -> Iterator[tuple[int, str]]:
        if self.inflate is not None:
            yield from self._lines(self.inflate.flush())
        if self.rest:
            yield self._piece(self.rest)
        if (self.crc, self.size) != (self.first.crc, self.first.size):
            raise zipfile.BadZipFile(f"Bad CRC-32 or length of {self.first.member}")


def _unpack(piece_bytes: int, file_pieces: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        member: _Member | None = None

        def rows(found: Iterator[tuple[int, str]]) -> Iterator[pd.DataFrame]:
            own = member.first
            try:
                for n, text in found:
                    yield pd.DataFrame([(own.archive, own.member, own.part, n, text, None)], columns=names)
            except BROKEN as problem:
                member.problem = str(problem)
                yield pd.DataFrame([(own.archive, own.member, own.part, None, None, str(problem))], columns=names)

        for batch in batches:
            for chunk in batch.itertuples(index=False):
                if member is None or member.first.part != chunk.part:
                    if member is not None and member.problem is None:
                        yield from rows(member.finish())
                    member = _Member(chunk, piece_bytes, file_pieces)
                if member.problem is None:
                    yield from rows(member.feed(chunk.data))
        if member is not None and member.problem is None:
            yield from rows(member.finish())

    return run


def expand_archives(
    spark: SparkSession, paths: Sequence[str], piece_bytes: int = PIECE_BYTES, file_pieces: int = FILE_PIECES
) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Text tables inside zip archives, written out to the shared folder: (member, folder to read), (name, error).

    An archive's task only cuts it into its members. Each member is then unpacked by a task of its own, checked against
    its check sum, and leaves it in pieces of whole lines, which are dealt again: a large member becomes several files, each
    with the header. A damaged archive or member gives an error and stops nothing else.
    """
    target = new_work_path(spark, "archives")
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    files.mapInPandas(_cut, MEMBERS).write.parquet(f"{target}/compressed")
    members = spark.read.schema(MEMBERS).parquet(f"{target}/compressed")
    sound = members.where(F.col("error").isNull())
    # one row per member: as short as the archives' own listings
    listed = members.groupBy("archive", "member", "part").agg(F.max("error").alias("error")).orderBy("archive", "member", "part").collect()
    dealt = sound.repartitionByRange(max(1, len(listed)), "part").sortWithinPartitions("part", "chunk")
    dealt.mapInPandas(_unpack(piece_bytes, file_pieces), PIECES).write.parquet(f"{target}/pieces")
    pieces = spark.read.schema(PIECES).parquet(f"{target}/pieces")
    torn = pieces.where(F.col("error").isNotNull()).select("part", "error")
    whole = pieces.where(F.col("error").isNull()).join(F.broadcast(torn.select("part").distinct()), "part", "left_anti")  # one row per member at most
    placed = whole.withColumn("file", F.floor(F.col("piece") / file_pieces)).repartition("part", "file").sortWithinPartitions("part", "file", "piece")
    # a file ends with its pieces, so that each begins with a header
    placed.select("part", "value").write.option("maxRecordsPerFile", file_pieces).partitionBy("part").text(f"{target}/members")
    problems = {r["part"]: r["error"] for r in torn.collect()}
    written = {r["part"] for r in pieces.select("part").distinct().collect()}  # an empty member has no piece
    found = [(r["member"], r["part"], r["error"] or problems.get(r["part"])) for r in listed]
    good = [(member, f"{target}/members/part={part}") for member, part, error in found if error is None and part in written]
    return good, [(member, error) for member, _, error in found if error is not None]
