import pytest
from conftest import as_set

from hearthcheck.operators import audit as A
from hearthcheck.plans.catalog import TableSet

TODAY = "2024-01-01"


def counts(result):
    return {(r["check"], r["table_a"], r["table_b"], r["metric"]): r["n"] for r in result.where("applicable").collect()}


def one_table(tables, name, *checks):
    return {(k[0], k[3]): n for k, n in counts(A.audit_table(tables, name, TODAY, list(checks))).items()}


def test_presence_checks_find_one_row_each(make):
    df = make(
        "individid int, sleep_lastnight string, arrive_date string, depart_date string",
        (1, "oui", "01/01/2023", None),
        (2, "oui", "01/01/2023", "02/01/2023"),
        (3, "non", "01/01/2023", None),
        (4, None, None, None),
        (5, "non", "01/01/2023", "05/01/2023"),
        (6, "non", "10/01/2023", "10/01/2023"),
    )
    found = one_table(TableSet({"FNewPresences": df}), "FNewPresences", "CHK11", "CHK16", "CHK17", "CHK18")
    assert found == {("CHK11", "n"): 1, ("CHK16", "n"): 1, ("CHK17", "n"): 1, ("CHK18", "n"): 1}


def test_form_checks(make):
    births = make(
        "eventid int, individid int, birth_date string, entry_date string, weight double, height int, rltn_head double",
        (1, 1, "01/06/2020", "01/05/2020", 9999.0, 50, 1.0),
        (2, 2, "01/06/2020", "01/07/2020", 3000.0, 99, 2.0),
        (3, 3, "01/06/2000", "01/07/2000", None, None, 1.0),
    )
    found = one_table(TableSet({"FNewBirth": births}), "FNewBirth", "CHK6", "CHK7", "CHK8", "CHK21")
    assert found == {("CHK6", "n"): 1, ("CHK7", "n"): 1, ("CHK8", "n"): 1, ("CHK21", "n"): 1}


def test_two_counter_checks_show_both(make):
    df = make("observeid int, begin_time string, end_time string", (1, "08:00", "08:02"), (2, "08:00", "07:00"), (3, "08:00", "09:00"))
    found = one_table(TableSet({"FNewObservation": df}), "FNewObservation", "CHK25")
    assert found == {("CHK25", "n_too_short"): 1, ("CHK25", "n_end_before_start"): 1}


def test_antenatal_visit_ten_follows_visit_two(make):
    df = make(
        "nb_cpn int, cpn_date1 string, cpn_date10 string, cpn_date2 string",
        (3, "01/01/2023", "01/03/2023", "01/02/2023"),
        (3, "01/01/2023", "01/02/2023", "01/03/2023"),
        (3, "01/01/2023", None, None),
        (None, None, None, None),
    )
    found = one_table(TableSet({"cpn": df}), "cpn", "CHK22", "CHK23")
    assert found == {("CHK22", "n"): 1, ("CHK23", "n"): 1}


def test_identifier_lengths_and_self_reference(make):
    df = make("individid string, individid2 string", ("001", "001"), ("002", "003"), ("0004", "001"), (None, "002"))
    tables = TableSet({"relationship": df})
    assert one_table(tables, "relationship", "CHK1", "CHK2") == {("CHK1", "n"): 1, ("CHK2", "n"): 1}
    assert as_set(A.unusual_length_rows(tables, "relationship"), "individid") == {"0004"}


def test_inapplicable_checks_are_listed(make):
    result = A.audit_table(TableSet({"t": make("x int", (1,))}), "t", TODAY)
    assert result.where("applicable").count() == 0
    assert {"CHK1", "CHK3", "CHK9", "CHK12"} <= as_set(result, "check")


def test_several_places_and_repeated_deaths(make):
    tables = TableSet(
        {
            "FNewDeath": make("individid int, locationid int", (1, 5), (1, 6), (2, 7), (2, 7), (3, None), (None, 1), (None, 2)),
        }
    )
    assert one_table(tables, "FNewDeath", "CHK12", "CHK19") == {("CHK12", "n"): 1, ("CHK19", "n"): 2}
    assert A.flagged_key_rows(tables, "FNewDeath", "CHK12").count() == 2


def test_flagged_rows_name_their_checks(make):
    df = make("lat double, lon double, NumTelephone string", (12.0, -1.5, "70123456"), (50.0, -1.5, "7"), (None, 0.0, None))
    rows = A.flagged_rows(TableSet({"places": df}), "places").select("violations").collect()
    assert sorted(map(tuple, (r[0] for r in rows))) == [("CHK9",), ("CHK9", "CHK10")]


PERSONS = "individid int, socialgpid int, birth_date string, gender string"


def test_eligibility_by_person(make):
    tables = TableSet(
        {
            "FNewPresences": make(
                "individid int, sleep_lastnight int, depart_date string",
                (1, 1, None), (2, 1, None), (3, 2, None), (4, 1, "01/01/2023"), (5, 1, None),
            ),
            "FNewEducation": make("individid string", ("1",), ("4.0",), ("6",)),
        }
    )
    audit = A.CrossAudit(tables, TODAY)
    assert counts(A.audit_across(tables, TODAY, ["XCK2"])) == {
        ("XCK2", "FNewPresences", "FNewEducation", "n_eligible_without_form"): 2,
        ("XCK2", "FNewPresences", "FNewEducation", "n_form_without_eligibility"): 2,
    }
    assert as_set(audit.keys("XCK2"), "metric", "key") == {
        ("n_eligible_without_form", "2"), ("n_eligible_without_form", "5"),
        ("n_form_without_eligibility", "4"), ("n_form_without_eligibility", "6"),
    }


def test_eligibility_by_household(make):
    tables = TableSet(
        {
            "FNewPresences": make(
                "individid int, sleep_lastnight string, depart_date string",
                (1, "oui", None), (2, "oui", None), (3, "non", None), (4, "oui", "01/01/2023"),
            ),
            "FNewIndividual": make(
                PERSONS, (1, 10, "01/01/1990", "1"), (2, 20, "01/01/1990", "1"), (3, 30, "01/01/1990", "1"), (4, 40, "01/01/1990", "1")
            ),
            "FNewPauvrete": make("socialgpid int", (10,), (30,)),
        }
    )
    assert set(counts(A.audit_across(tables, TODAY, ["XCK3"])).values()) == {1}


def test_dates_against_births_and_duplicate_persons(make):
    """A person listed twice counts once per listing, as in a join."""
    tables = TableSet(
        {
            "FNewIndividual": make(PERSONS, (1, 1, "01/01/2000", "1"), (1, 1, "01/01/2010", "1"), (2, 1, "01/01/1950", "2")),
            "FNewDeath": make("individid int, evtdate string", (1, "01/01/1999"), (1, "01/01/2005"), (2, "01/01/1960"), (None, "01/01/1900")),
            "FNewEducation": make("individid int", (1,), (1,), (2,)),
        }
    )
    assert counts(A.audit_across(tables, TODAY, ["XCK6"]))[("XCK6", "FNewDeath", "FNewIndividual", "n")] == 3
    # Ages 24 and 14 fit 5-34, age 74 does not.
    assert counts(A.audit_across(tables, TODAY, ["XCK1"]))[("XCK1", "FNewEducation", "FNewIndividual", "n")] == 1


def test_migration_pairs_are_counted_without_forming_them(spark, make):
    out = [(1, f"{d:02d}/01/2023") for d in (1, 5, 9)] + [(2, "01/01/2023")]
    came = [(1, f"{d:02d}/01/2023") for d in (3, 5, 7)] + [(3, "01/01/2023")]
    tables = TableSet(
        {
            "migration_out": make("individid int, depart_date string", *out),
            "migration_in": make("individid int, arrive_date string", *came),
        }
    )
    expected = sum(1 for a, d in out for b, e in came if a == b and d < e)
    assert counts(A.audit_across(tables, TODAY, ["XCK9"])) == {("XCK9", "migration_out", "migration_in", "n"): expected}


def test_union_age_gap_weighs_repeated_rows(make):
    tables = TableSet(
        {
            "FNewIndividual": make(PERSONS, (1, 1, "01/01/1980", "2"), (2, 1, "01/01/1980", "2")),
            "FNewBase_HistMat": make("individid int, union_age int", (1, 20), (1, 20), (2, 40), (2, 40)),
            "FNewRelationship": make("individid int, uni_start_date string", (1, "01/01/2000"), (2, "01/01/2000"), (2, "01/01/2000")),
        }
    )
    assert counts(A.audit_across(tables, TODAY, ["XCK8"]))[("XCK8", "FNewBase_HistMat", "FNewRelationship", "n")] == 4


def test_phones_by_age(make):
    tables = TableSet(
        {
            "FNewIndividual": make(PERSONS, (1, 1, "01/01/2020", "1"), (2, 1, "01/01/1980", "1"), (3, 1, "01/01/1980", "1")),
            "FNewTelephone": make("individid int, NumTelephone string", (1, "70123456"), (2, None)),
        }
    )
    found = counts(A.audit_across(tables, TODAY, ["XCK17"]))
    assert found[("XCK17", "FNewTelephone", "FNewIndividual", "n_minor_with_phone")] == 1
    assert found[("XCK17", "FNewTelephone", "FNewIndividual", "n_adult_without_phone")] == 2


def test_event_numbers_not_persons_link_births_to_outcomes(make):
    tables = TableSet(
        {
            "FNewBirth": make("pregoutid int, individid int", (100, 1), (101, 1), (101, 2), (None, 3)),
            "FNewPregoutcome": make("eventid int, peventid int, individid int", (100, 7, 1), (500, 8, 2)),
            "FNewPregnancy": make("eventid int, individid int", (7, 1), (9, 2), (10, 3)),
        }
    )
    found = {k[0]: n for k, n in counts(A.audit_across(tables, TODAY, ["XCK10", "XCK11", "XCK12"])).items()}
    assert found == {"XCK10": 1, "XCK11": 1, "XCK12": 1}


def test_one_table_audit_keeps_what_concerns_it(make):
    tables = TableSet(
        {
            "FNewPresences": make("individid int, sleep_lastnight string, depart_date string", (1, "oui", None)),
            "FNewDeath": make("individid int, evtdate string", (1, "01/01/2023")),
            "FNewEducation": make("individid int", (1,)),
        }
    )
    result = A.audit_full(tables, TODAY, table="FNewDeath").collect()
    assert {r["check"] for r in result if r["check"].startswith("XCK")} == {"XCK4"}
    assert {r["table_a"] for r in result} == {"FNewDeath"}


def test_documented_rules(make):
    persons = make(
        "individid int, gender string, ethnic_gp int, birth_date string, fatherid int, motherid int",
        (1, "1", 1, "01/01/1980", None, None),
        (2, "2", 14, "01/01/1982", None, 99),
        (3, "3", 2, "01/01/1990", 2, 2),
        (4, "1", None, "01/01/2010", 4, 1),
    )
    tables = TableSet({"FNewIndividual": persons})
    found = {(k[0], k[3]): n for k, n in counts(A.audit_across(tables, TODAY, A.PERSON_RULES)).items()}
    assert found == {
        ("RUL1", "n_sex"): 1, ("RUL1", "n_ethnic_group"): 1, ("RUL2", "n_father"): 1, ("RUL2", "n_mother"): 0,
        ("RUL3", "n_father"): 0, ("RUL3", "n_mother"): 1, ("RUL4", "n_father"): 1, ("RUL4", "n_mother"): 1,
        ("RUL5", "n_father"): 2, ("RUL5", "n_mother"): 1,
    }


@pytest.mark.parametrize("check", ["XCK4", "XCK23"])
def test_status_overlap(make, check):
    tables = TableSet(
        {
            "FNewDeath": make("eventid int, individid int", (1, 1), (2, 1), (3, 2)),
            "FNewPresences": make("eventid int, individid int", (1, 1), (2, 1)),
        }
    )
    if check == "XCK23":
        assert A.status_overlap(tables, "FNewDeath", "FNewPresences").first()["n"] == 2
    else:
        assert set(counts(A.audit_across(tables, TODAY, ["XCK4"])).values()) == {2}


def test_cross_checks_without_their_tables_are_listed(make):
    tables = TableSet({"FNewDeath": make("individid int, evtdate string", (1, "01/01/2023"))})
    result = A.audit_full(tables, TODAY)
    absent = as_set(result.where("not applicable and table_a is null"), "check")
    assert absent == set(A.CROSS_CHECKS)
