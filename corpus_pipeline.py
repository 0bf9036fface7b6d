"""The corpus pipeline: documents in, token files out.

Each stage is written before the next one reads it. A stage therefore begins by deleting the work tables of the stages
before it in the same run (over the same folder), so that the shared folder never holds those of two stages at once.
Work tables of other results are left alone.

A stage hands texts to Python in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes. An executor holds each batch
several times outside its heap, for every task; Spark's 10 000 rows of whole texts are hundreds of megabytes there. The session
keeps these settings, since a stage's result is computed after the stage returns; smaller ones of the caller stay.

A stage also bounds the description Spark makes of a plan to ``PLAN_CHARS`` characters. The driver writes that text anew whenever
adaptive execution changes the plan, and the plans of near duplicates have about a hundred exchanges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthcheck.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from hearthcheck.llm.common import forget, recording, table
from hearthcheck.llm.suite import TOKENIZER_FILE
from hearthcheck.session import new_work_path


BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20
PLAN_CHARS = 64 << 10

_WORK: dict[str, list[str]] = {}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(spark: SparkSession) -> None:
    """Bound what is handed to Python at once; 0 or less means unbounded."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def short_plans(spark: SparkSession) -> None:
    """Bound the text of a plan on the driver; what is run does not depend on it."""
    key = "spark.sql.maxPlanStringLength"
    held = spark.conf.get(key).rstrip("bB")
    if not held.isdigit() or int(held) > PLAN_CHARS:
        spark.conf.set(key, str(PLAN_CHARS))


def stage(run: Stage) -> Stage:
    """A stage that owns the work tables it writes."""

    @wraps(run)
    def owning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        short_plans(spark)
        work = _WORK.setdefault(sf_dir, [])
        forget(spark, work)
        with recording(work):
            return run(spark, docs, sf_dir)

    return owning


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model of the labelled ones."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return near_dedup.one_of_each(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixing.mixed_rows(docs, F.array("source"))


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from its token files."""
    return token_files.read_documents(spark, token_files.write_ids(docs, TOKENIZER_FILE))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", token_ids),
]

# learned scores, retrieval and seeded selection are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, act in STAGES[:-1]:
        path = new_work_path(spark, f"pipeline-{name}")
        act(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
