import pytest

from hearthcheck.demo.suite_audit import IDS
from hearthcheck.demo.views import SHEETS, survey
from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet


def test_person_names_go_and_agents_stay(make):
    df = make("individid int, nom string, forename string, agent_name string, Prenom string", (1, "a", "b", "c", "d"))
    assert R.drop_person_names(df).columns == ["individid", "agent_name"]
    assert R.drop_person_names(df, keep=["nom"]).columns == ["individid", "nom", "agent_name"]


def test_agents_are_not_visits(make):
    df = make("enquete_id int, field_wrkr string, agent_id string, date_enquete string", (1, "a", "b", "c"))
    assert R.agent_columns(df) == ["field_wrkr", "agent_id"]


def test_date_columns_by_type_and_content(make):
    df = make(
        "d date, t string, mixed string, n int, empty string",
        (None, "01/02/2020", "01/02/2020", 1, None),
        (None, "2020-01-05", "x", 2, None),
        (None, None, "y", 3, None),
    )
    assert R.date_columns(df) == ["d", "t"]


def test_table_names_lose_prefix_and_underscores():
    assert R.normalised_name("FNew_Deces") == "deces"
    assert R.normalised_name("site_app_d_e_c_e_s", ("site_app_",)) == "deces"
    assert R.plays_role("d_e_c_e_s", ["deces"])
    assert not R.plays_role("FNewEducation", ["deces"])


def test_first_table_wins_and_exclusions_hold(make):
    df = make("individid int", (1,))
    tables = TableSet({"FNewPregnancy_CPN": df, "FNewPregnancy": df, "grossesses": df})
    assert tables.with_role(("pregnancy", "grossesse"), ("cpn",)) == "FNewPregnancy"


def test_antenatal_dates_follow_their_number(make):
    df = make("cpn_date10 string, cpn_date2 string, cpn_date1 string, cpn string", ("a", "b", "c", "d"))
    assert R.antenatal_dates(df) == ["cpn_date1", "cpn_date2", "cpn_date10"]


def test_person_table_needs_key_and_birth_date(make):
    bare = make("individid int", (1,))
    full = make("individid2 int, individid int, birth_date string", (1, 1, "2000-01-01"))
    tables = TableSet({"individus_old": bare, "FNewIndividual": full})
    assert tables.persons() == "FNewIndividual"
    assert tables.persons(exclude="FNewIndividual") is None
    assert R.person_key(full) == "individid"


def test_local_ids_are_never_keys(make):
    tables = TableSet(
        {
            "education": make("id int, individid int, menage_id int", (1, 1, 1)),
            "presences": make("id int, individid int, menage_id int", (1, 1, 1)),
            "other": make("id int, menage_id int", (1, 1)),
        }
    )
    assert tables.join_key("education", "presences") == "individid"
    assert tables.join_key("education", "other") is None
    assert ("education", "other", "menage_id", False, False) in tables.relations()
    schema = tables.describe_schema()
    assert "confirmed: education <-> presences on individid" in schema
    assert "unconfirmed: education <-> other on menage_id" in schema


def test_pairs_are_resolved_from_what_is_named(make):
    df = make("individid int", (1,))
    two = TableSet({"a": df, "b": df})
    assert two.resolve_pair(["b"]) == ("b", "a")
    assert two.resolve_pair([]) is None
    assert TableSet({"a": df, "b": df, "c": df}).resolve_pair(["b"]) is None


def test_columns_are_listed_once_in_first_spelling(make):
    tables = TableSet({"a": make("Sex int, x int", (1, 1)), "b": make("sex int, y int", (1, 1))})
    assert tables.all_columns() == ["Sex", "x", "y"]
    assert tables.tables_with_columns(["SEX", "y"]) == ["b"]
    assert tables.tables_with_columns([]) == []


def test_missing_table_in_report(make):
    tables = TableSet({"a": make("individid int", (1,)), "b": make("individid int", (1,))})
    with pytest.raises(KeyError):
        tables.relation_report("a", "zz")


def test_demo_identifiers_are_the_detected_ones(spark):
    tables = survey(spark, "/root/testdata/sf0.001")
    for sheet, name in SHEETS.items():
        assert tuple(R.id_columns(tables[sheet])) == IDS[name]


def test_shuffle_partitions_follow_the_data():
    from hearthcheck.session import partitions_for

    assert partitions_for(1) == 200
    assert partitions_for(100 << 40) == 200_000
    assert partitions_for(1 << 40) == 5243
