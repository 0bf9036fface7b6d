"""Counts of the two groupings against loops over all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from hearthcheck.operators import audit as A
from hearthcheck.operators import one_pass
from hearthcheck.plans import patterns as P
from hearthcheck.plans.catalog import TableSet

TODAY = "2024-01-01"
START = datetime(1960, 1, 1)


def counts(result):
    return {(r["check"], r["table_a"], r["metric"]): r["n"] for r in result.where("applicable").collect()}


def moments(seed, n, days=20_000):
    chosen = random.Random(seed)
    return [
        (chosen.choice([None, *range(6), 1, 1, 1, 1]), None if chosen.random() < 0.1 else START + timedelta(days=chosen.randrange(days), minutes=chosen.choice([0, 0, 5])))
        for _ in range(n)
    ]


def shown(moment, seed):
    shape = ("%d/%m/%Y %H:%M", "%Y-%m-%d %H:%M:%S")[seed % 2]
    return moment and moment.strftime(shape)


@pytest.mark.parametrize("days", [3, 60, 20_000])
@pytest.mark.parametrize("bits", [36, 42, 60])
def test_departures_before_arrivals_equal_all_pairs(make, monkeypatch, days, bits):
    monkeypatch.setattr(one_pass, "STRETCH_BITS", bits)
    out, into = moments(1, 120, days), moments(2, 130, days)
    tables = TableSet({
        "FNewMigration_Out": make("individid int, depart_date string", *[(k, shown(m, 0)) for k, m in out]),
        "FNewMigration_IN": make("individid string, arrive_date string", *[(None if k is None else f"{k}.0", shown(m, 1)) for k, m in into]),
    })
    wanted = sum(1 for a, d in out for b, e in into if a is not None and a == b and d and e and d < e)
    assert counts(A.audit_across(tables, TODAY, ["XCK9"])) == {("XCK9", "FNewMigration_Out", "n"): wanted}


def test_dates_against_births_equal_all_pairs(make):
    born, deaths, unions, children = moments(3, 90), moments(4, 80), moments(5, 70), moments(6, 60)
    ends = moments(7, 70)
    tables = TableSet({
        "FNewIndividual": make("individid int, birth_date string", *[(k, shown(m, 0)) for k, m in born]),
        "FNewDeath": make("individid int, evtdate string", *[(k, shown(m, 1)) for k, m in deaths]),
        "FNewRelationship": make("individid int, uni_start_date string, uni_civil_date string", *[(k, shown(m, 0), shown(e, 1)) for (k, m), (_, e) in zip(unions, ends)]),
        "FNewHistGnesiqCompl": make("individid int, birthDate string", *[(k, shown(m, 1)) for k, m in children]),
    })

    def pairs(events, broken):
        return sum(1 for a, day in events for b, birth in born if a is not None and a == b and day and birth and broken(birth, day))

    before = lambda birth, day: day < birth
    young = lambda birth, day: (day.date() - birth.date()).days / 365.25 < P.MOTHER_MINIMUM_AGE
    assert counts(A.audit_across(tables, TODAY, ["XCK6", "XCK7", "XCK16"])) == {
        ("XCK6", "FNewDeath", "n"): pairs(deaths, before),
        ("XCK7", "FNewRelationship", "n_start"): pairs(unions, before),
        ("XCK7", "FNewRelationship", "n_civil"): pairs([(k, e) for (k, _), (_, e) in zip(unions, ends)], before),
        ("XCK16", "FNewHistGnesiqCompl", "n"): pairs(children, young),
    }


def test_union_ages_equal_all_combinations(make):
    born, unions, chosen = moments(13, 40), moments(14, 40), random.Random(15)
    declared = [(chosen.choice([None, *range(6)]), chosen.choice([None, 15.0, 20.5, 30.0])) for _ in range(40)]
    tables = TableSet({
        "FNewIndividual": make("individid int, birth_date string", *[(k, shown(m, 0)) for k, m in born]),
        "FNewRelationship": make("individid int, uni_start_date string", *[(k, shown(m, 1)) for k, m in unions]),
        "FNewBase_HistMat": make("individid int, union_age double", *declared),
    })
    wanted = sum(
        abs(age - (start.date() - birth.date()).days / 365.25) > P.UNION_AGE_GAP
        for a, age in declared for b, start in unions for c, birth in born
        if a is not None and a == b == c and age is not None and start and birth
    )
    assert counts(A.audit_across(tables, TODAY, ["XCK8"])) == {("XCK8", "FNewBase_HistMat", "n"): wanted}


def test_households_equal_sets(make):
    chosen = random.Random(8)
    person = lambda: chosen.choice([None, 0, 0, 0, *range(1, 25)])
    home = lambda: chosen.choice([None, *range(12)])
    presences = [(person(), chosen.choice(["oui", "non", None]), chosen.choice([None, None, "01/01/2023"])) for _ in range(60)]
    persons = [(person(), home(), "01/01/1990") for _ in range(90)]
    forms = [(home(),) for _ in range(6)]
    tables = TableSet({
        "FNewPresences": make("individid int, sleep_lastnight string, depart_date string", *presences),
        "FNewIndividual": make("individid int, socialgpid int, birth_date string", *persons),
        "FNewPauvrete": make("socialgpid int", *forms),
    })
    staying = {k for k, slept, left in presences if k is not None and slept == "oui" and left is None}
    eligible = {h for k, h, _ in persons if k in staying and h is not None}
    having = {h for (h,) in forms if h is not None}
    assert counts(A.audit_across(tables, TODAY, ["XCK3"])) == {
        ("XCK3", "FNewPresences", "n_eligible_without_form"): len(eligible - having),
        ("XCK3", "FNewPresences", "n_form_without_eligibility"): len(having - eligible),
    }


def test_wide_ledgers_are_split_and_still_complete(make, monkeypatch):
    presences = make("individid int, sleep_lastnight string, depart_date string", *[(k, "oui", None) for k in range(9)])
    forms = {n: make("individid int", *[(k,) for k in range(i, 12)]) for i, n in enumerate(("FNewEducation", "FNewEmploi", "FNewHistGnesiqCompl", "FNewTelephone"))}
    tables = TableSet({"FNewPresences": presences, **forms, "FNewDeath": make("individid int", (1,), (77,)), "FNewDepart": make("individid int", (2,))})
    narrow = counts(A.audit_across(tables, TODAY))
    monkeypatch.setattr(one_pass, "MOST_TALLIES", 50)
    assert counts(A.audit_across(tables, TODAY)) == narrow
    assert narrow[("XCK2", "FNewPresences", "n_form_without_eligibility")] == 3


def test_each_table_is_read_twice_at_most(spark, make, tmp_path):
    frames = {
        "FNewIndividual": make("individid int, socialgpid int, birth_date string, gender string, fatherid int", (1, 1, "01/01/2000", "1", 2)),
        "FNewPresences": make("individid int, sleep_lastnight string, arrive_date string, depart_date string", (1, "oui", None, None)),
        "FNewDeath": make("individid int, evtdate string", (1, "01/01/1999")),
        "FNewPauvrete": make("socialgpid int", (1,)),
        "FNewMigration_Out": make("individid int, depart_date string", (1, "01/01/1999")),
        "FNewMigration_IN": make("individid int, arrive_date string", (1, "01/01/2001")),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / name))
    tables = TableSet({n: spark.read.parquet(str(tmp_path / n)) for n in frames})
    planned = A.audit_full(tables, TODAY, include_rules=True)._jdf.queryExecution()
    leaves, plan = planned.optimizedPlan().collectLeaves(), planned.executedPlan().toString()
    read = [leaf.relation().location().rootPaths().toString() for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName() == "LogicalRelation"]
    for name in frames:
        assert 1 <= sum(f"/{name})" in path for path in read) <= 2, name
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan


def test_a_person_with_most_events_is_spread_over_stretches(make):
    hot = [(1, shown(START + timedelta(days=k), 0)) for k in range(3_000)]
    tables = TableSet({
        "FNewMigration_Out": make("individid int, depart_date string", *hot),
        "FNewMigration_IN": make("individid int, arrive_date string", *hot),
    })
    result = A.audit_across(tables, TODAY, ["XCK9"])
    assert counts(result) == {("XCK9", "FNewMigration_Out", "n"): 3_000 * 2_999 // 2}
    plan = result._jdf.queryExecution().executedPlan().toString()
    # both windows are cut by stretch or run over stretches; none holds a person's own rows
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert len(windows) == 2 and all("c#" in line for line in windows)


def test_unusual_lengths_read_the_table_twice(spark, make, tmp_path):
    make("aid string, bid string, cid string", ("1", "22", "3"), ("1", "22", "33"), ("11", "2", "3")).write.parquet(str(tmp_path / "t"))
    tables = TableSet({"t": spark.read.parquet(str(tmp_path / "t"))}, documented_keys=["aid"])
    rows = A.unusual_length_rows(tables, "t")
    assert sorted(tuple(r["violations"]) for r in rows.collect()) == [("aid", "bid"), ("cid",)]
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedSubquery") >= 2
