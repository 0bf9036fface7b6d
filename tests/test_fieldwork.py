import datetime

import pytest
from conftest import as_set

from hearthcheck.operators import fieldwork as W
from hearthcheck.plans.catalog import TableSet


@pytest.fixture
def tables(make):
    return TableSet(
        {
            "FNewPresences": make(
                "individid int, menageid int, field_wrkr string, visit_date string",
                (1, 10, "A", "01/02/2024"), (2, 10, "A", "01/02/2024"), (3, 11, "A", "02/02/2024"),
                (4, 12, "B ", "02/02/2024"), (5, 13, "B", "bad"), (6, 14, "C", "03/02/2024"),
            ),
            "FNewBirth": make("individid int, field_wrkr string", (7, "A"), (8, "B"), (9, "B")),
            "FNewDeath": make("individid int, field_wrkr string", (1, "A")),
            "equipe": make("field_wrkr string, controleur string", ("A", "X"), ("B", "Y")),
        }
    )


def test_volume_per_agent(tables):
    rows = {r["agent"]: r.asDict() for r in W.agent_volume(tables).collect()}
    assert rows["A"]["Ménages/UCH visités"] == 3
    assert rows["A"]["Ménages/UCH distincts"] == 2
    assert rows["A"]["total_fiches"] == 5
    assert rows["B"]["Ménages/UCH visités"] == 2
    assert rows["B"]["Naissances enregistrées"] == 2
    assert rows["C"]["Décès enregistrés"] == 0


def test_excluded_agents_and_controllers(tables):
    report = W.add_controller(W.agent_volume(tables, exclude=[" b"]), tables)
    assert as_set(report, "agent", "controleur") == {("A", "X"), ("C", "Non renseigné")}
    assert W.only_categories(report, ["Décès enregistrés"]).columns == ["agent", "controleur", "Décès enregistrés"]
    assert W.only_categories(report, []).columns == report.columns


def test_daily_progress_and_forecast(tables):
    daily = W.agent_daily(tables)
    assert (datetime.date(2024, 2, 2), "B", 1) in as_set(daily)
    assert [r["cumulative"] for r in W.progress_curve(daily).orderBy("day").collect()] == [2, 4, 5]
    row = W.goal_forecast(daily, goal=20, days_available=4).first()
    assert (row["done"], row["days_observed"], row["mean_per_day"], row["remaining"]) == (5, 3, 1.7, 15)
    assert (row["days_left"], row["projected_end"]) == (9, datetime.date(2024, 2, 12))
    assert row["needed_per_day"] == 3.8
    with pytest.raises(ValueError):
        W.goal_forecast(daily, days_available=0)


def test_agent_found_through_the_visit(make):
    tables = TableSet(
        {
            "naissances": make("individu_id int, enquete_id int", (1, 1), (2, 1), (3, 2), (4, None)),
            "visites": make("id int, agent_id string", (1, "A"), (2, "B")),
        }
    )
    rows, column = W.with_agent(tables, "naissances")
    assert as_set(rows, "individu_id", column) == {(1, "A"), (2, "A"), (3, "B"), (4, None)}
    found = as_set(W.agent_volume_long(tables))
    assert ("A", "Naissances enregistrées", 2) in found
    unmatched = TableSet({"naissances": make("enquete_id int", (9,)), "visites": tables["visites"]})
    assert W.with_agent(unmatched, "naissances", check_match=True)[1] is None


def test_quality_counts_missing_identifiers_as_duplicates(make):
    df = make(
        "individid int, birth_date string, field_wrkr string",
        (1, "01/01/2000", "A"), (1, "01/01/1800", "B"), (None, None, "A"), (None, "01/01/2001", "B"), (5, "01/01/2050", "B"),
    )
    rows = {r["agent"]: tuple(r)[1:] for r in W.agent_quality(df, as_of="2024-01-01").collect()}
    assert rows["A"] == (2, 2, 1, 0.333)
    assert rows["B"] == (3, 2, 2, 0.111)
    with pytest.raises(ValueError):
        W.agent_quality(make("x int", (1,)))


def test_emails_come_from_the_user_table(make):
    tables = TableSet({"naissances": make("agent_id string", ("1",), ("2",)), "users": make("id int, email string", (1, "a@x"))})
    report = W.add_email(W.agent_volume(tables), tables)
    assert as_set(report, "agent", "email_agent") == {("1", "a@x"), ("2", "Non renseigné")}


def test_identifier_search_over_all_tables(make):
    tables = TableSet(
        {
            "a": make("individid int, x string", (1024, "p"), (7, "q")),
            "b": make("recID string, individid string", ("r", " 1024 "), ("1024", "s"), ("z", "t")),
            "c": make("x int", (1024,)),
            "d": make("individid double", (1024.0,), (None,)),
        }
    )
    assert sorted(r["table"] for r in W.search_identifier(tables, "1024 ").collect()) == ["a", "b", "b", "d"]
    wanted = make("w int", (1024,), (7,), (8,))
    assert as_set(W.search_identifiers(tables, wanted, "w"), "identifier", "table") == {
        ("1024", "a"), ("7", "a"), ("1024", "b"), ("1024", "d"),
    }


def test_reports_start_no_job_before_an_action(spark, make):
    from hearthcheck.operators import stats as ST

    rows = make("individid int, agent string, day string, enquete_id int", (1, "A", "01/02/2020", 5), (2, "B", "x", 6))
    visits = make("enquete_id int, field_wrkr string", (5, "A"))
    tables = TableSet({"FNewPresences": rows, "FNewVisits": visits})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "building plans")
    try:
        reports = [W.agent_quality(rows), ST.coherence_report(rows), W.agent_volume(tables), ST.correlation_matrix(rows)]
        assert list(tracker.getJobIdsForGroup("plan")) == []
        assert all(r.count() for r in reports)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
