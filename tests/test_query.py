import pytest
from conftest import as_set

from hearthcheck.operators import query as Q
from hearthcheck.plans.catalog import TableSet


@pytest.fixture
def people(make):
    return make(
        "individu_id int, commune string, age double",
        (1, "North ", 20.0), (2, "north", 30.0), (3, "Southbob", None), (4, None, 50.0), (5, "NORTH", 12.0),
    )


def answer(df, operation, target=None, *filters):
    raw = {
        "operation": operation,
        "colonne_cible": target,
        "filtres": [{"colonne": c, "operateur": o, "valeur": v} for c, o, v in filters],
    }
    return Q.run_spec(df, Q.parse_spec(raw, df.columns))


def test_text_equality_ignores_case_and_blanks(people):
    assert answer(people, "compter", None, ("commune", "==", " NORTH")).first()["n"] == 3
    assert answer(people, "compter", None, ("commune", "!=", "north")).first()["n"] == 2
    assert answer(people, "compter", None, ("commune", "contient", "OB")).first()["n"] == 1


def test_aggregates_report_usable_values(people):
    row = answer(people, "moyenne", "AGE", ("commune", "==", "north")).first()
    assert (round(row["result"], 4), row["n_values"]) == (20.6667, 3)
    assert answer(people, "max", "commune").first()["result"] is None


def test_unknown_filters_are_ignored_and_reported(people):
    spec = Q.parse_spec({"operation": "compter", "filtres": [{"colonne": "zz", "operateur": "==", "valeur": 1}]}, people.columns)
    assert Q.run_spec(people, spec).first()["n"] == 5
    assert Q.applied_conditions(people, spec) == []


@pytest.mark.parametrize(
    "raw",
    [
        {"operation": "drop"},
        {"operation": "moyenne", "colonne_cible": "zz"},
        {"operation": "compter", "filtres": [{"colonne": "age", "operateur": ">", "valeur": " "}]},
        {"operation": "compter", "filtres": [{"colonne": "age", "operateur": "!="}]},
    ],
)
def test_bad_specs_are_refused(people, raw):
    with pytest.raises(Q.InvalidSpec):
        Q.parse_spec(raw, people.columns)


def test_listing_gives_fifty_and_the_total(spark):
    df = spark.range(120).selectExpr("cast(id as int) as individid")
    rows = Q.run_spec(df, Q.Spec("lister", None, ()), ["individid"]).collect()
    assert len(rows) == 50 and {r["n_total"] for r in rows} == {120}


@pytest.fixture
def tables(make):
    return TableSet(
        {
            "presences": make("individu_id int, enquete_id int", (1, 1), (2, 1), (2, 2), (3, 2)),
            "deaths": make("individu_id int", (2,), (3,)),
            "visits": make("id int, agent_id string", (1, "A"), (2, "B")),
        }
    )


def test_sql_joins_three_tables(spark, tables):
    rows = Q.run_sql(
        spark,
        tables,
        'select v."agent_id", count(*) as n from presences p join deaths d on d.individu_id = p.individu_id '
        "join visits v on v.id = p.enquete_id group by v.agent_id;",
    )
    assert as_set(rows) == {("A", 1), ("B", 2)}
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


def test_sql_is_capped(spark):
    tables = TableSet({"t": spark.range(500).toDF("x")})
    assert Q.run_sql(spark, tables, "SELECT x FROM t").count() == 200


@pytest.mark.parametrize(
    "text",
    ["", None, "select 1; select 2", "delete from deaths", "with x as (select 1) insert into deaths select 1",
     "explain select 1", "select * from nowhere", "select nope from deaths",
     "select * from text.`/etc/hostname`", "with x as (select * from csv.`/etc/hostname`) select * from x", "select * from range(3)",
     "select (select max(value) from text.`/etc/hostname`) from deaths", "select reflect('java.lang.System', 'nanoTime') from deaths",
     "select 1 from deaths where exists (select 1 from parquet.`/tmp`)", "select java_method('java.lang.System', 'nanoTime')",
     "with x as (select 1 as a) from x insert overwrite directory '/tmp/out' select a"],
)
def test_sql_is_read_only(spark, tables, text):
    with pytest.raises(Q.InvalidSql):
        Q.run_sql(spark, tables, text)


@pytest.mark.parametrize("text", ["select 'a; set b' as x from deaths", "with t as (select 1 as drop_) select * from t;",
                                  'select "set" from (select 1 as "set")', "select x.a from (select 1 as a) x, deaths d"])
def test_quoted_words_and_own_names_are_allowed(spark, tables, text):
    assert Q.run_sql(spark, tables, text, cap=None).count() >= 1


@pytest.mark.parametrize(
    "text",
    ["select * from IDENTIFIER('text.`/etc/hostname`')", "select * from IDENTIFIER('hid' || 'den')", "select * from hidden",
     "select IDENTIFIER('reflect')('java.lang.System', 'lineSeparator') from deaths", "select 'CTE [hidden]' as a, id from hidden",
     "with a as (with hidden as (select 1 as id) select * from hidden) select hidden.id from a, hidden",
     "select (with hidden as (select 2 as id) select max(id) from hidden) from hidden", "select * from global_temp.shown",
     "select 1 from deaths where exists (select 1 from hidden where hidden.id = 1)", "select * from deaths, lateral (select * from hidden)",
     "select try_reflect('java.lang.System', 'nanoTime') from deaths", "select 1 from values (reflect('java.lang.System', 'nanoTime')) t(a)",
     "select input_file_name() from deaths", "select twice(1) from deaths", "with recursive r as (select 1 as a union all select a + 1 from r, hidden) select * from r",
     "select transform(individu_id) using 'cat' as (x string) from deaths", "select * from kept_view", "select * from deaths union all select id from hidden",
     "select count(*) filter (where exists (select 1 from hidden)) from deaths", "select sum(1) over (order by (select max(id) from hidden)) from deaths"],
)
def test_nothing_but_the_set_is_read(spark, tables, text, foreign_names):
    with pytest.raises(Q.InvalidSql):
        Q.run_sql(spark, tables, text)


@pytest.fixture
def foreign_names(spark):
    """A view, a global view and a function that only the caller knows."""
    spark.range(3).createOrReplaceTempView("hidden")
    spark.range(3).createOrReplaceGlobalTempView("shown")
    spark.udf.register("twice", lambda x: 2 * x, "int")
    yield
    spark.catalog.dropTempView("hidden")
    spark.catalog.dropGlobalTempView("shown")


@pytest.mark.parametrize(
    "text, rows",
    [("select 1 as a from deaths where 1 = 1 -- drop table deaths", 2), ("select 'reflect(' as a, \"set\" from (select 1 as \"set\") /* insert */", 1),
     ("with hidden as (select 5 as id) select * from hidden", 1), ("select * from (values (1, 'x'), (2, 'y')) t(a, b)", 2),
     ("select d.individu_id, x.n from deaths d, lateral (select count(*) as n from presences p where p.individu_id = d.individu_id) x", 2),
     ("select * from deaths where individu_id in (select individu_id from PRESENCES)", 2), ("select individu_id from deaths group by cube (individu_id)", 3),
     ("with recursive r as (select 1 as a union all select a + 1 from r where a < 4) select * from r", 4),
     ("select explode(array(1, 2, 3)) from deaths limit 4", 4), ("select * from deaths tablesample (100 percent)", 2),
     ("select row_number() over (order by individu_id) from deaths union select 7", 3), ("select \"individu_id\" from IDENTIFIER('deaths')", 2),
     ("select * from presences pivot (count(*) for enquete_id in (1, 2))", 3), ("select /*+ broadcast(d) */ 1 from deaths d order by 1 limit 1 offset 1", 1)],
)
def test_reading_statements_are_accepted(spark, tables, text, rows, foreign_names):
    assert Q.run_sql(spark, tables, text).count() == rows


def test_the_callers_names_stay_as_they_were(spark, tables):
    spark.range(3).createOrReplaceTempView("deaths")
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    assert Q.run_sql(spark, tables, "select * from deaths").count() == 2
    assert spark.table("deaths").count() == 3 and spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false") == before
    spark.catalog.dropTempView("deaths")


def test_what_is_read_of_a_file_stays_pruned(spark, tmp_path):
    spark.range(10).selectExpr("id as a", "id as b").write.parquet(str(tmp_path / "t"))
    own = TableSet({"t": spark.read.parquet(str(tmp_path / "t"))})
    plan = Q.plan_sql(spark, own, "select a from t where a > 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint>" in plan and "GreaterThan(a,3)" in plan


@pytest.mark.parametrize("wanted, n", [("7", 1), ("007", 0), (" 7 ", 1), ("7.0", 0), ("-0", 0)])
def test_integers_compare_as_their_text(spark, wanted, n):
    df = spark.range(10).selectExpr("cast(id as int) as i")
    assert answer(df, "compter", None, ("i", "==", wanted)).first()["n"] == n


def test_growing_join_is_noticed(spark, tables):
    grew = Q.join_growth(spark, tables, "select 1 as x from presences a join presences b on a.enquete_id = b.enquete_id").first()
    assert (grew["result_rows"], grew["largest_input"], grew["grew"]) == (8, 4, True)
    assert Q.tables_in_statement(tables, "select 1 from Deaths, visits_old") == ["deaths"]


def test_spec_over_all_tables(make):
    tables = TableSet({"a": make("x int, y int", (1, 2), (3, 4)), "b": make("x int, y int", (5, 6)), "c": make("x int", (1,))})
    raw = {"operation": "somme", "colonne_cible": "y", "filtres": [{"colonne": "x", "operateur": ">=", "valeur": "1"}]}
    assert as_set(Q.run_spec_everywhere(tables, raw)) == {("a", 6.0, 2), ("b", 6.0, 1)}


@pytest.mark.parametrize("operator", [">", "<", ">=", "<="])
@pytest.mark.parametrize("bound", ["2", "2,5", "-1.5", "1e30"])
def test_order_tests_on_integers_equal_those_on_decimals(spark, operator, bound):
    df = spark.range(-3, 6).selectExpr("cast(id as int) as i", "cast(id as double) as d").unionByName(
        spark.sql("select cast(null as int) as i, cast(null as double) as d")
    )
    by_integer, by_decimal = (answer(df, "compter", None, (c, operator, bound)).first()["n"] for c in ("i", "d"))
    assert by_integer == by_decimal


def test_filters_reach_the_file_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as individid", "cast(id as double) as age").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    wanted = {
        "GreaterThan(individid,3)": ("individid", ">", "3,5"),
        "LessThanOrEqual(age,8.0)": ("age", "<=", 8),
        "EqualTo(individid,7)": ("individid", "==", "7"),
    }
    for pushed, condition in wanted.items():
        plan = answer(df, "compter", None, condition)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan
    assert answer(df, "compter", None, *wanted.values()).first()["n"] == 1
