"""Writing results: CSV, columnar files, names fit for restricted targets, the load history."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthcheck.functions import scalars as S

FORMATS = ("csv", "parquet", "orc", "json")
BYTE_ORDER_MARK = "﻿"
NAME_LENGTH = 32


def restricted_names(columns: Sequence[str], length: int = NAME_LENGTH) -> list[str]:
    """Names of letters, digits and underscores that start with a letter, fit the length and stay unique.

    Columns whose names come out alike are numbered among themselves, past every name that is free of a clash.
    """
    stems = [re.sub(r"\W", "_", re.sub(r"^(?![A-Za-z_])", "v_", c), flags=re.ASCII)[:length] for c in columns]
    given = set(stems)

    def names_of(stem: str) -> Iterator[str]:
        yield stem
        for number in itertools.count(1):
            name = f"{stem[: length - len(str(number)) - 1]}_{number}"
            if name not in given:
                given.add(name)
                yield name

    supply = {stem: names_of(stem) for stem in given.copy()}
    return [next(supply[stem]) for stem in stems]


def with_restricted_names(df: DataFrame, length: int = NAME_LENGTH) -> DataFrame:
    return df.toDF(*restricted_names(df.columns, length))


def booleans_as_text(df: DataFrame) -> DataFrame:
    """Booleans written out as True / False, other columns untouched."""
    return df.select(
        *[
            F.when(S.column(f.name), "True").when(~S.column(f.name), "False").alias(f.name)
            if isinstance(f.dataType, T.BooleanType)
            else S.column(f.name)
            for f in df.schema.fields
        ]
    )


def export(df: DataFrame, path: str, kind: str = "csv", restricted: bool = False) -> None:
    """Write a result as a folder of files. CSV has a header and starts with a byte-order mark."""
    kind = kind.lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"Unsupported export format: {kind} (expected {', '.join(FORMATS)})")
    if restricted:
        df = booleans_as_text(with_restricted_names(df))
    if kind == "csv":
        marked = df.toDF(BYTE_ORDER_MARK + df.columns[0], *df.columns[1:])
        marked.write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True, quoteAll=False)
    else:
        df.write.mode("overwrite").format(kind).save(path)


HISTORY = "loaded_at timestamp, file string, table string, n_rows bigint, export_date date, source string"


def record_loads(spark: SparkSession, path: str, loads: DataFrame) -> None:
    """Append loads (file, table, n_rows, export_date, source) to the history, stamped now."""
    stamped = loads.select(
        F.current_timestamp().alias("loaded_at"),
        "file",
        "table",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("export_date").cast("date").alias("export_date"),
        "source",
    )
    stamped.write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Past loads, newest first."""
    return spark.read.schema(HISTORY).parquet(path).orderBy(F.desc("loaded_at"), "table", "file")


# ---------------------------------------------------------------------- documents

FOLDER_FILES = 1_000
ENDS_TEXT = "\u0001"


def _text_files(folder: str):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder)) if ":" in folder else (fs.LocalFileSystem(), folder)
        root = f"{root}/{int(rows['folder'].iloc[0])}"
        store.create_dir(root, recursive=True)
        for name, texts in rows.groupby("name", sort=False)["text"]:
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write("".join(text + ENDS_TEXT for text in texts).encode())
        return pd.DataFrame({"folder": rows["folder"].iloc[:1]})

    return write


def write_documents(texts: DataFrame, folder: str, folders: int) -> None:
    """Each text as a file of its own: rows ``name, text`` go to ``folders`` sub-folders by a digest of the name.

    Tasks write the files where they belong, so that nothing is renamed afterwards and a listing reads ``folders`` folders,
    not one per file. Texts of one name go to one file, each ended by ``ENDS_TEXT``.
    """
    placed = texts.withColumn("folder", F.pmod(F.xxhash64("name"), F.lit(max(1, folders))))
    placed.groupBy("folder").applyInPandas(_text_files(folder), "folder bigint").agg(F.count("*")).first()
