import pytest
from conftest import as_set
from pyspark.sql import functions as F

from hearthcheck.operators import joins as J
from hearthcheck.operators import skew
from hearthcheck.plans.catalog import TableSet


@pytest.fixture
def tables(make):
    return TableSet(
        {
            "education": make("id int, individid int", (1, 10), (2, 20), (3, 30), (4, None)),
            "presences": make("id int, individid int", (1, 10), (2, 20), (3, 20)),
        }
    )


def test_difference_uses_the_documented_key(tables):
    assert as_set(J.difference(tables, "education", "presences"), "individid") == {30, None}


def test_missing_keys_meet_only_when_asked(make):
    tables = TableSet({"a": make("individid int", (1,), (None,)), "b": make("individid int", (None,), (2,))})
    assert as_set(J.difference(tables, "a", "b")) == {1}
    assert as_set(J.difference(tables, "a", "b", match_nulls=False)) == {1, None}
    assert as_set(J.overlap(tables, "a", "b")) == {None}


def test_fusion_suffixes_and_registers(spark, tables):
    fused = J.fuse_and_publish(tables, "education", "presences")
    assert set(fused.columns) == {"id_education", "individid", "id_presences"}
    assert spark.table("fusion_education_presences").count() == 3
    assert "fusion_education_presences" in tables


def test_undocumented_keys_are_refused(make):
    tables = TableSet({"a": make("id int, menage_id int", (1, 1)), "b": make("id int, menage_id int", (1, 1))})
    for operator in (J.fuse, J.difference, J.overlap):
        with pytest.raises(ValueError, match="not documented"):
            operator(tables, "a", "b")
    assert J.fuse(tables, "a", "b", "menage_id").count() == 1
    with pytest.raises(ValueError):
        J.fuse(tables, "a", "zz")


def test_both_ways_in_one_pass(tables):
    assert as_set(J.difference_counts(tables, "education", "presences")) == {
        ("education", "presences", 2),
        ("presences", "education", 0),
    }


def test_text_and_number_keys_meet(make):
    tables = TableSet({"a": make("individid string", ("1",), ("2.0",)), "b": make("individid double", (1.0,), (2.0,))})
    assert J.overlap(tables, "a", "b").count() == 2


def test_set_difference_lists_are_sorted_as_text(make):
    left, right = make("k int", (1,), (10,), (2,), (2,), (None,)), make("k int", (2,), (5,))
    assert [tuple(r) for r in J.set_difference((left, "k"), (right, "k")).collect()] == [
        ("left", "1"), ("left", "10"), ("right", "5"),
    ]
    assert as_set(J.set_difference_counts((left, "k"), (right, "k"))) == {(2, 1, 1)}


def test_lookup_takes_the_first_and_fills_the_rest(make):
    rows = make("agent string", ("A",), ("B",), (None,))
    team = make("a string, c string, o int", ("A", "late", 2), (" A ", "early", 1))
    found = J.lookup(rows, "agent", team, "a", "c", "controller", order=["o"])
    assert as_set(found) == {("A", "early"), ("B", "Non renseigné"), (None, "Non renseigné")}


def rows_with_a_hot_key(spark, n=3000):
    """Two fifths of the rows share one key, another part has none."""
    return spark.range(n).selectExpr("id", "case when id % 5 < 2 then 7 when id % 10 = 2 then null else id % 50 end as k", "repeat('x', 50) as pad")


@pytest.fixture
def reference(spark):
    return spark.range(40).selectExpr("id as r", "id * 2 as v").unionByName(spark.sql("select cast(null as bigint) as r, cast(-1 as bigint) as v"))


JOINS = [("left", False), ("inner", False), ("left_semi", True), ("left_anti", False), ("left_anti", True)]


@pytest.mark.parametrize("how, match_nulls", JOINS)
def test_join_to_a_reference_equals_the_plain_one(spark, reference, how, match_nulls):
    rows = rows_with_a_hot_key(spark)
    same = rows["k"].eqNullSafe(reference["r"]) if match_nulls else rows["k"] == reference["r"]
    plain = sorted(map(str, rows.join(reference, same, how).drop("r").collect()))
    assert sorted(map(str, skew.join_reference(rows, F.col("k"), reference, "r", how, match_nulls).collect())) == plain


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_a_hot_key_is_split_and_each_input_is_read_once(spark, tmp_path, how):
    """A key with 40 % of the rows, against distinct keys: no counting pass, and the join is cut where the key lies."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    rows_with_a_hot_key(spark, 20_000).repartition(12).write.parquet(str(tmp_path / "a"))
    spark.range(4000).selectExpr("id % 40 as r").write.parquet(str(tmp_path / "b"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows, keys = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")).groupBy("r").agg(F.count("*").alias("v"))
        joined = skew.join_reference(rows, F.col("k"), keys, "r", how)
        n = len(joined.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == {"left": 20_000, "left_semi": rows.where("k < 40").count(), "left_anti": rows.where("k is null or k >= 40").count()}[how]
    assert "skew=true" in plan
    assert plan.count("FileScan") == 2


def test_member_filter_keeps_all_members_and_few_others(spark):
    keys = spark.range(0, 3000, 3).selectExpr("cast(id as string) as key")
    df = spark.range(3000).select(F.col("id"), F.col("id").cast("string").alias("value"), skew.member_bits(keys, "key", 512).alias("bits"))
    kept = {r["id"] for r in df.where(skew.may_be_member("value", "bits", 512)).collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1100
    none = spark.range(10).select(F.col("id").cast("string").alias("value"), skew.member_bits(keys.limit(0), "key").alias("bits"))
    assert none.where(skew.may_be_member("value", "bits")).count() == 0


def test_missing_keys_pair_only_when_asked(make):
    tables = TableSet({"a": make("individid int, x int", (None, 1), (1, 2)), "b": make("individid int, y int", (None, 3), (1, 4))})
    assert J.fuse(tables, "a", "b").count() == 1
    assert J.fuse(tables, "a", "b", match_nulls=True).count() == 2


def test_lookup_without_order_prefers_a_known_value(make):
    team = make("a string, c string", ("A", "A5"), ("A", None), ("B", None))
    found = J.lookup(make("agent string", ("A",), ("B",)), "agent", team, "a", "c", "controller")
    assert as_set(found) == {("A", "A5"), ("B", "Non renseigné")}
