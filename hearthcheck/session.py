"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


SHUFFLE_PARTITION_BYTES = 200 << 20


def partitions_for(shuffle_bytes: int) -> int:
    """How many shuffle partitions keep each one around 200 MB; adaptive execution merges small ones."""
    return min(max(200, -(-shuffle_bytes // SHUFFLE_PARTITION_BYTES)), 200_000)


def build_session(
    app: str = "hearthcheck", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and a UTC clock.

    ``shuffle_bytes`` is the size of the largest expected shuffle and sets the number of partitions,
    since adaptive execution merges partitions but does not split an aggregate's.
    """
    if shuffle_bytes is not None:
        conf.setdefault("spark.sql.shuffle.partitions", str(partitions_for(shuffle_bytes)))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.codegen.cache.maxEntries", "1000")  # a report over many tables compiles more than the default 100 steps
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent, and only on a local master, does a temporary folder stand in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    fallback = tempfile.mkdtemp(prefix="hearthcheck-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never used by another run."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def default_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
