"""Keeping table snapshots up to date from a folder that receives dated exports.

An export is a file, or a folder of part files, with a date in its name; what is left of the name
is its table. The stream takes the names of new files only, so a file that cannot be read never
stops it. In each batch the newest export of every table is read whole and, when it is not older
than the table's snapshot, written to a folder of its own. A manifest then names the exports that
count, a few per table; it is written beside the old one and takes its place by a rename, so readers
see all tables of a batch or none, and find a table's newest export without opening any other. What
the new manifest does not name is deleted after that: exports beyond ``keep`` per table, what a
replayed batch or a later part of the same export has replaced, and what a batch that failed left.

An export that cannot be read leaves a row (table, export, path, error) beside the snapshots, the
next older one of the batch is tried, and it is tried again with every later batch until it is
read or a newer one is in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hearthcheck.plans import roles as R
from hearthcheck.sources import exports as X

REFRESH_INTERVAL = "15 minutes"
KEPT_EXPORTS = 2  # readers of the one before may finish
KEPT_MANIFESTS = 3
MANIFEST = "table_name string, export_date date, export string, folder string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
PROBLEMS = "table_name string, export string, path string, error string, batch bigint"


def incoming(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """The stream of new files: path and modification time. Contents are not read."""
    reader = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"))


def _export_of(path: Column) -> tuple[Column, Column, Column]:
    """(name, date, path) of the export a file belongs to: itself if dated, else its folder if that is."""
    parts = F.split(path, "/")
    own, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    inside = X.export_date(own).isNull() & X.export_date(folder).isNotNull()
    name = F.when(inside, folder).otherwise(own)
    place = F.when(inside, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(path)
    return name, X.export_date(name), place


def exports_of(files: DataFrame) -> DataFrame:
    """One row per export: table_name, export, export_date, modified, path. Undated ones go by their time."""
    name, dated, place = _export_of(F.col("path"))
    named = files.select(name.alias("export"), dated.alias("dated"), place.alias("path"), "modified")
    grouped = named.groupBy("export", "dated", "path").agg(F.max("modified").alias("modified"))
    table = X.base_name(F.col("export"), X.READABLE_EXTENSIONS)
    return grouped.select(
        table.alias("table_name"), "export", F.coalesce("dated", F.col("modified").cast("date")).alias("export_date"), "modified", "path"
    )


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException:
        return None


def problems(spark: SparkSession, target: str) -> DataFrame:
    """Every failed attempt to read an export, with its error."""
    found = _read(spark, f"{target}/problems", PROBLEMS)
    return found if found is not None else spark.createDataFrame([], PROBLEMS)


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _inside(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    files, place = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _versions(spark: SparkSession, target: str) -> list[str]:
    """Committed manifests, oldest first."""
    return sorted(n for n in _inside(spark, f"{target}/manifest") if n.startswith("v-"))


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The exports that count: table_name, export_date, export, folder. A few rows per table."""
    versions = _versions(spark, target)
    if not versions:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest/{versions[-1]}")


def commit(spark: SparkSession, target: str, rows: list[tuple]) -> None:
    """Put a manifest in place of the last one and delete what it does not name."""
    versions = _versions(spark, target)
    number = int(versions[-1][2:]) + 1 if versions else 1
    fresh = f"{target}/manifest/_{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(fresh)
    files, place = _folder(spark, fresh)
    if not files.rename(place, _folder(spark, f"{target}/manifest/v-{number:012d}")[1]):
        raise OSError(f"Another writer has committed version {number} of {target}")
    named = {r[3] for r in rows}
    for folder in _inside(spark, f"{target}/exports"):
        if folder not in named:
            files.delete(_folder(spark, f"{target}/exports/{folder}")[1], True)
    for old in versions[: -(KEPT_MANIFESTS - 1)]:
        files.delete(_folder(spark, f"{target}/manifest/{old}")[1], True)


def current_snapshot(spark: SparkSession, target: str, table: str | None = None) -> DataFrame:
    """Rows of the newest export of one table, or of every table with its name; no other export is opened."""
    newest: dict[str, tuple] = {}
    for r in manifest(spark, target).collect():
        newest[r["table_name"]] = max(newest.get(r["table_name"], ()), (r["export_date"], r["export"], r["folder"]))
    folders = [f"{target}/exports/{n[2]}" for t, n in sorted(newest.items()) if table in (None, t)]
    if not folders:
        raise ValueError(f"No snapshot of {table or 'any table'} in {target}")
    rows = spark.read.parquet(*folders)
    return rows.drop("table_name") if table is not None else rows


def keep_newest(
    target: str, schema: T.StructType | str, kind: str = "csv", delimiter: str = ",", mode: str = "FAILFAST", keep: int = KEPT_EXPORTS
) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps, per table, the newest export that can be read and is not older than the snapshot."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = {(r["table_name"], r["export"]): tuple(r) for r in manifest(spark, target).collect()}
        newest = {table: max(r[1] for r in held.values() if r[0] == table) for table, _ in held}
        arrived = exports_of(batch.select("path", "modified"))
        again = problems(spark, target).select("path").distinct().withColumn("modified", F.lit(None).cast("timestamp"))
        # one row per export, never one per file
        waiting = arrived.unionByName(exports_of(again).where(F.col("export_date").isNotNull()).join(arrived.select("path"), "path", "left_anti"))
        order = [F.asc("table_name"), F.desc("export_date"), F.desc_nulls_last("modified"), F.desc("export")]
        failed, done = [], set()
        for e in waiting.orderBy(*order).collect():
            table, day = e["table_name"], e["export_date"]
            if table in done or (table in newest and day < newest[table]):
                continue
            try:
                reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
                if kind == "csv":
                    reader = reader.option("header", True).option("sep", delimiter).option("mode", mode)
                rows = R.drop_person_names(reader.format(kind).load(e["path"]))
                folder = uuid.uuid4().hex
                rows.withColumn("table_name", F.lit(table)).write.parquet(f"{target}/exports/{folder}")
                held[table, e["export"]] = (table, day, e["export"], folder)
                done.add(table)
            except (PySparkException, Py4JError) as problem:
                failed.append((table, e["export"], e["path"], str(problem).splitlines()[0][:500], number))
        if done:
            by_table: dict[str, list[tuple]] = {}
            for row in sorted(held.values(), key=lambda r: (r[1], r[2]), reverse=True):
                by_table.setdefault(row[0], []).append(row)
            commit(spark, target, [row for rows in by_table.values() for row in rows[:keep]])
        if failed:
            spark.createDataFrame(failed, PROBLEMS).coalesce(1).write.mode("append").parquet(f"{target}/problems")

    return write


def refresh_tables(
    files: DataFrame,
    target: str,
    checkpoint: str,
    schema: T.StructType | str,
    kind: str = "csv",
    delimiter: str = ",",
    once: bool = True,
    interval: str = REFRESH_INTERVAL,
) -> StreamingQuery:
    """Start refreshing snapshots: everything waiting and then stop, or every ``interval``."""
    writer = files.writeStream.foreachBatch(keep_newest(target, schema, kind, delimiter)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
