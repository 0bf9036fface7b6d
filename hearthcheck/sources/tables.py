"""Reading tables: delimited files, columnar files, whole folders, databases, text documents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet
from hearthcheck.sources import exports as X

DELIMITERS = (",", ";", "\t", "|")
TEXT_EXTENSIONS = ("txt", "md")
# Files that a reader unpacks by their extension.
PACKED_EXTENSIONS = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")
LISTED = "path string, modified bigint, at string, folder boolean"
READ_BYTES = 8 << 20


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter occurring most in the header line; the comma when there is none."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(DELIMITERS, key=lambda d: (line.count(d), d == ","))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, delimiter: str | None = None
) -> DataFrame:
    """A delimited file with header. Without a schema the types are inferred, which reads it once more."""
    reader = spark.read.option("header", True).option("sep", delimiter or detect_delimiter(spark, path))
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    frame = reader.csv(path)
    first = frame.columns[0] if frame.columns else ""
    return frame.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else frame


def extension(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by the extension of its file, without person-name columns."""
    kind = extension(path)
    if kind == "csv":
        frame = read_csv(spark, path, schema)
    elif kind in ("parquet", "orc", "json"):
        reader = spark.read.schema(schema) if schema else spark.read
        frame = reader.format(kind).load(path)
    else:
        raise ValueError(f"Unsupported table format: {kind} (expected {', '.join(X.READABLE_EXTENSIONS)})")
    return R.drop_person_names(frame)


def load_files(
    spark: SparkSession, files: Sequence[tuple[str, str]], tables: TableSet | None = None
) -> tuple[TableSet, list[tuple[str, str, str]]]:
    """Load (table, path) pairs into a table set, and report (table, path, problem) for those that failed.

    Tables without columns or rows are skipped. A name already taken gets its folder in front.
    One unreadable file never stops the others.
    """
    loaded = TableSet() if tables is None else tables
    problems = []
    for name, path in files:
        try:
            frame = read_table(spark, path) if extension(path) in X.READABLE_EXTENSIONS else R.drop_person_names(read_csv(spark, path))
            if not frame.columns or frame.isEmpty():
                problems.append((name, path, "empty"))
                continue
        except (PySparkException, Py4JError, ValueError) as problem:
            problems.append((name, path, str(problem).splitlines()[0]))
            continue
        folder = path.rstrip("/").rsplit("/", 2)[-2] if "/" in path else ""
        loaded.add(name if name not in loaded else f"{folder}_{name}", frame)
    return loaded, problems


def load_folder(spark: SparkSession, folder: str) -> tuple[TableSet, list[tuple[str, str, str]]]:
    """The newest export of every table found under a folder, or of its newest archive when no table file is there.

    Only the chosen files are opened.
    """
    batch = X.latest_batch(X.listing(spark, folder), folder)
    chosen = X.latest_per_table(batch, X.READABLE_EXTENSIONS)
    # One row per table: a list as short as the catalog.
    pairs = [(r["table"], r["path"]) for r in chosen.orderBy("table").select("table", "path").collect()]
    if pairs:
        return load_files(spark, pairs)
    archives = X.tables_or_archive(batch).where(F.lower("name").endswith(".zip")).select("path").collect()
    if not archives:
        return TableSet(), []
    members, errors = X.expand_archives(spark, [r["path"] for r in archives])
    tables, problems = load_files(spark, [(m.rsplit(".", 1)[0], path) for m, path in members])
    return tables, problems + [(name, archives[0]["path"], error) for name, error in errors]


# ---------------------------------------------------------------------- databases


def jdbc_options(
    url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1
) -> dict[str, str]:
    """Reader options for a database table, read in parallel ranges of a numeric column when one is given."""
    options = {"url": url, "dbtable": '"' + table.replace('"', '""') + '"', "fetchsize": "10000"}
    if partition_column and bounds and parts > 1:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(parts),
        }
    return options


def read_database_table(
    spark: SparkSession, url: str, table: str, first: int | None = None, properties: dict | None = None, **ranges
) -> DataFrame:
    """A database table without person-name columns; ``first`` is pushed to the database as its limit."""
    frame = spark.read.format("jdbc").options(**(properties or {}), **jdbc_options(url, table, **ranges)).load()
    return R.drop_person_names(frame.limit(first) if first is not None else frame)


def list_database_tables(
    spark: SparkSession, url: str, catalog_query: str = "SELECT table_name FROM information_schema.tables", **properties
) -> DataFrame:
    """Names of the tables of a database, sorted. ``catalog_query`` is that database's way of listing them."""
    names = spark.read.format("jdbc").options(url=url, query=catalog_query, **properties).load()
    return names.select(F.col(f"`{names.columns[0]}`").alias("table")).orderBy("table")


# ---------------------------------------------------------------------- documents


def read_documents(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] = TEXT_EXTENSIONS,
    ignored_stems: Sequence[str] = (),
) -> DataFrame:
    """Whole text files: ``path, stem, modified, text``. Other extensions and ignored names are left out.

    A reader holds a description of every file on the driver. So folders that tasks can open themselves are listed and read by
    tasks, no more than a shuffle has, and the driver knows folders only. Other stores, single files and patterns of names go
    through Spark's reader.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    root = None if set(map(str.lower, extensions)) & set(PACKED_EXTENSIONS) else _local_folder(spark, folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    kept = F.lower(name).rlike(rf"\.({'|'.join(extensions)})$")
    if ignored_stems:
        kept = kept & ~F.lower(stem).isin([s.lower() for s in ignored_stems])
    if root is None:
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .text(folder, wholetext=True)
            .select(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("modified"),
                F.col("value").alias("text"),
            )
            .coalesce(tasks)
            .where(kept)
        )
    else:
        listed = _entries(spark, _folders_under(spark, root, tasks), tasks).where(~F.col("folder")).where(kept)
        texts = listed.select("path", "modified", "at").repartition(tasks, "at").mapInArrow(_read, "path string, modified bigint, text binary")
        files = texts.select("path", F.timestamp_micros("modified").alias("modified"), F.col("text").cast("string").alias("text"))
    return files.select("path", stem.alias("stem"), "modified", "text")


def _local_folder(spark: SparkSession, folder: str) -> str | None:
    """The folder as a path of the file system that driver and executors see, if it is one."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        uri = store.makeQualified(path).toUri()
        plain = uri.getScheme() == "file" and store.exists(path) and store.getFileStatus(path).isDirectory()
    except Py4JError:
        return None
    return uri.getPath() if plain else None


def _folders_under(spark: SparkSession, root: str, tasks: int) -> list[str]:
    """The folder and all those below it, a level at a time."""
    found, level = [root], [root]
    while level:
        level = [r["at"] for r in _entries(spark, level, tasks).where("folder").select("at").collect()]
        found += level
    return found


def _entries(spark: SparkSession, folders: Sequence[str], tasks: int) -> DataFrame:
    """Files and folders right under each folder, as a reader names them; hidden names and empty files are left out."""
    return spark.createDataFrame([(f,) for f in folders], "at string").repartition(tasks, "at").mapInArrow(_list, LISTED)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[str, list] = {"path": [], "modified": [], "at": [], "folder": []}
    kinds = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("at", pa.string()), ("folder", pa.bool_())])
    for batch in batches:
        for folder in batch.column("at").to_pylist():
            with os.scandir(folder) as entries:
                for entry in entries:
                    name, below = entry.name, entry.is_dir()
                    hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
                    if hidden and not (below and name.startswith(("_metadata", "_common_metadata"))):
                        continue
                    state = entry.stat()
                    if not below and not state.st_size:
                        continue
                    uri = re.sub(r"[\x00-\x7f\s]", lambda m: quote(m[0], safe="/_-!.~'()*,;:$&+=@"), entry.path)
                    values = (f"file:{uri}", state.st_mtime_ns // 1_000_000 * 1_000, entry.path, below)
                    for column, value in zip(rows.values(), values):
                        column.append(value)
                    if len(rows["at"]) == 10_000:
                        yield pa.RecordBatch.from_pydict(rows, kinds)
                        rows = {c: [] for c in rows}
    if rows["at"]:
        yield pa.RecordBatch.from_pydict(rows, kinds)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["path", "modified", "text"])

    held, size = [], 0
    for batch in batches:
        for path, modified, at in zip(*(batch.column(c).to_pylist() for c in ("path", "modified", "at"))):
            with open(at, "rb") as file:
                held.append((path, modified, file.read()))
            size += len(held[-1][2])
            if size >= READ_BYTES or len(held) == 10_000:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def documents_to_convert(sources: DataFrame, converted: DataFrame) -> DataFrame:
    """Source documents whose conversion is missing or older than they are. Blank documents are left out."""
    done = converted.groupBy("stem").agg(F.max("modified").alias("_done"))
    pending = sources.join(done, "stem", "left").where(F.col("_done").isNull() | (F.col("_done") < F.col("modified")))
    return pending.drop("_done").where(F.length(F.trim("text")) > 0)


def is_index_stale(files: DataFrame, index_written) -> DataFrame:
    """One row: is any file newer than the index? An index never written is stale."""
    newest = files.agg(F.max("modified").alias("newest"))
    written = F.lit(index_written).cast("timestamp_ntz")
    return newest.select(
        (written.isNull() | F.coalesce(F.col("newest") > written, F.lit(False))).alias("stale"), "newest"
    )
