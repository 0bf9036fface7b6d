import corpus_pipeline
import pyarrow as pa
from hearthcheck.llm import decontaminate, mixing, near_dedup, toxicity
from hearthcheck.llm.common import table
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_act_on_what_the_one_before_kept(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, left, FOLDER), tmp_path / name)
        assert out.columns == columns, name
        before, after = {r.doc_id for r in left.collect()}, [r.doc_id for r in out.collect()]
        assert set(after) <= before
        if name == "toxicity":
            labels = table(spark, FOLDER, "labels")
            model = toxicity.train(left, labels)
            bad = {r.doc_id for r in toxicity.score(left, model).where(F.col("score") >= model.cut).collect()}
            assert set(after) == before - bad
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in near_dedup.near_groups(left).where("kept").collect()}
        elif name == "decontamination":
            found = decontaminate.contaminated(left, table(spark, FOLDER, "benchmark")).collect()
            assert set(after) == before - {r.doc_id for r in found}
        else:
            copies = {r.doc_id: r.copies for r in mixing.mix(left, F.array("source")).collect()}
            assert all(after.count(k) == n for k, n in copies.items())
        left = out
    got = corpus_pipeline.STAGES[-1][1](spark, left, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in left.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_take_an_empty_table(spark, tmp_path):
    left = table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        left = written(stage(spark, left, FOLDER), tmp_path / name)
        assert left.count() == 0


def test_a_result_built_before_a_run_stays_readable(spark, tmp_path, docs):
    from tests.llm.conftest import ODD

    groups = near_dedup.near_groups(docs(*ODD))  # lazy over its own work tables
    documents = table(spark, FOLDER, "documents")
    for name, act in corpus_pipeline.STAGES[:2]:
        documents = written(act(spark, documents, FOLDER), tmp_path / name)
    assert groups.count() == len(ODD)


def test_odd_rows_go_through_the_first_stages(spark, tmp_path, docs):
    """Null ids, repeated rows, extra columns and empty texts."""
    from tests.llm.conftest import ODD

    table_of = docs(*ODD)
    for name, act in corpus_pipeline.STAGES[:2]:
        table_of = written(act(spark, table_of, FOLDER), tmp_path / name)
        assert table_of.columns == docs(*ODD).columns
    kept = table_of.collect()
    assert 0 < len(kept) < len(ODD)


def test_stages_hand_texts_to_python_in_small_batches(spark):
    """Both bounds hold for what a stage computes after it returned; a smaller setting of the caller stays."""
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(x) for x in names]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    @corpus_pipeline.stage
    def measured(spark, docs, folder):
        return docs.mapInArrow(sizes, "rows long, bytes long")

    try:
        for key in names:
            spark.conf.set(key, str(1 << 30))
        short = measured(spark, spark.range(0, 2500, 1, 1).selectExpr("repeat('x', 10) as text"), "batches").collect()
        long = measured(spark, spark.range(0, 900, 1, 1).selectExpr("repeat('x', 20000) as text"), "batches").collect()
        assert max(r.rows for r in short) == corpus_pipeline.BATCH_ROWS and sum(r.rows for r in short) == 2500
        assert max(r.bytes for r in long) < 2 * corpus_pipeline.BATCH_BYTES and sum(r.rows for r in long) == 900
        spark.conf.set(names[0], "10")
        assert max(r.rows for r in measured(spark, spark.range(0, 25, 1, 1).selectExpr("'x' as text"), "batches").collect()) == 10
    finally:
        for key, value in zip(names, before):
            spark.conf.set(key, value)


def test_stages_bound_the_text_of_plans_on_the_driver(spark):
    """The bound holds for what a stage computes after it returned; a smaller setting of the caller stays."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)

    @corpus_pipeline.stage
    def long_plan(spark, docs, folder):
        for k in range(40):
            docs = docs.union(docs.sparkSession.range(1).selectExpr(f"id + {k} as {'n' * 2000}{k}"))
        return docs

    try:
        spark.conf.set(key, str(1 << 30))
        out = long_plan(spark, spark.range(1), "plans")
        assert len(out._jdf.queryExecution().toString()) < 2 * corpus_pipeline.PLAN_CHARS
        assert out.count() == 41
        for mine, left in (("1000", "1000"), ("1g", str(corpus_pipeline.PLAN_CHARS))):
            spark.conf.set(key, mine)
            long_plan(spark, spark.range(1), "plans")
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)
