import pytest
from conftest import as_set

from hearthcheck.operators import stats as ST
from hearthcheck.plans.catalog import TableSet


def test_frequency_keeps_missing_and_rounds_half_even(make):
    df = make("s string", *[("a",)] * 5, (None,), *[("b",)] * 2)
    assert as_set(ST.frequency(df, "s")) == {("a", 5, 62.5), (None, 1, 12.5), ("b", 2, 25.0)}


def test_frequency_of_unknown_column(make):
    with pytest.raises(ValueError, match="nope"):
        ST.frequency(make("a int", (1,)), "nope")


def test_sample_is_repeatable_whatever_the_partitioning(spark):
    df = spark.range(1000)
    first = as_set(ST.sample_rows(df.repartition(2), 50))
    assert first == as_set(ST.sample_rows(df.repartition(13), 50))
    assert len(first) == 50
    assert first != as_set(ST.sample_rows(df, 50, seed=1))
    assert ST.sample_rows(spark.range(7), 100).count() == 7


def test_crosstab_drops_rows_missing_either_value(make):
    df = make("a string, b int", ("x", 1), ("x", 2), ("y", 1), (None, 1), ("y", None))
    cells = {(r["row_value"], r["column_value"]): r["n"] for r in ST.crosstab(df, "a", "b").collect()}
    assert cells == {
        ("x", "1"): 1, ("x", "2"): 1, ("y", "1"): 1, ("x", "Total"): 2, ("y", "Total"): 1,
        ("Total", "1"): 2, ("Total", "2"): 1, ("Total", "Total"): 3,
    }


def test_correlation_of_constant_is_missing_not_an_error(make):
    df = make("a double, b double, c double", (1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (None, 1.0, 5.0))
    pairs = {(r[0], r[1]): r[2] for r in ST.correlation_pairs(df).collect()}
    assert pairs == {("a", "b"): 1.0, ("a", "c"): None, ("b", "c"): None}
    assert ST.strongest_correlation(df).first()["column_b"] == "b"
    with pytest.raises(ValueError):
        ST.correlation_pairs(df, ["a"])


def test_duplicates_ignore_missing_identifiers(make):
    df = make("individid int, x string", (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"))
    assert as_set(ST.duplicated_rows(df), "x") == {"a", "b"}
    assert as_set(ST.duplicate_counts(df)) == {("individid", 2)}


def test_coherence_report_shows_what_was_checked(make):
    df = make(
        "individid int, sex int, birth_date string, entry_date string",
        (1, 1, "01/02/1990", "01/02/2020"),
        (1, 2, "01/02/1890", "01/02/2020"),
        (2, 1, "01/02/2090", None),
        (3, 2, None, "01/02/2020"),
    )
    found = {(r["kind"], r["column"]): r["value"] for r in ST.coherence_report(df, "2024-01-01").collect()}
    assert found[("rows", None)] == 4
    assert found[("duplicates", "individid")] == 2
    assert found[("implausible_dates", "birth_date")] == 3
    assert found[("implausible_dates", "entry_date")] == 1
    assert found[("missing_rate", "birth_date")] == 0.25
    assert ("missing_rate", "sex") not in found


def test_multiway_counts_keep_missing(make):
    df = make("a int, b int, c int", (1, None, 2), (1, None, 2), (1, 1, 1))
    assert as_set(ST.group_counts(df, ["a", "b", "c"])) == {(1, None, 2, 2), (1, 1, 1, 1)}


def test_everywhere_uses_only_tables_with_the_columns(make):
    tables = TableSet(
        {
            "education": make("individid int, sex int, level int", (1, 1, 2), (2, 2, 4)),
            "employment": make("individid int, sex int, income int", (1, 1, 5)),
            "health": make("individid int, other int", (1, 1)),
        }
    )
    assert as_set(ST.frequency_everywhere(tables, "SEX"), "table") == {"education", "employment"}
    assert as_set(ST.crosstab_everywhere(tables, "sex", "level"), "table") == {"education"}
    assert as_set(ST.correlation_everywhere(tables, ["sex", "level"]), "table") == {"education"}
    assert as_set(ST.group_counts_everywhere(tables, ["individid", "sex"]), "table") == {"education", "employment"}
    with pytest.raises(ValueError):
        ST.crosstab_everywhere(tables, "sex", "zz")
