"""Registered consistency checks: one query per check, and the whole audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthcheck.demo.registry import query, register
from hearthcheck.demo.views import AS_OF, SHEETS, survey, view
from hearthcheck.operators import audit as A
from hearthcheck.plans.catalog import TableSet

AGE = "datediff('day', {birth}, date '2005-01-01') / 365.25"
YES = "coalesce(lower(trim({c})) in ('1', '1.0', 'oui', 'yes', 'true'), false)"


def age(birth: str = "birth_date") -> str:
    return AGE.format(birth=birth)


def yes(c: str) -> str:
    return YES.format(c=c)


IDS = {
    "individuals": ("individid", "socialgpid", "fatherid", "motherid"),
    "presences": ("eventid", "individid", "menageid"),
    "deaths": ("eventid", "individid"),
    "births": ("eventid", "pregoutid", "individid"),
    "pregnancies": ("eventid", "individid"),
    "outcomes": ("eventid", "peventid", "individid"),
    "antenatal": ("peventid",),
    "education": ("individid", "socialgpid"),
    "employment": ("individid",),
    "union_history": ("individid",),
    "relationships": ("individid", "individid2"),
    "reproductive": ("individid",),
    "reproductive_complement": ("individid",),
    "telephones": ("individid",),
    "migration_in": ("individid",),
    "migration_out": ("individid",),
    "residency": ("individid", "socialgpid", "locationid"),
    "snakebite": ("socialgpid",),
    "poverty": ("socialgpid",),
    "health": ("respondid", "socialgpid"),
    "observations": ("observeid",),
    "locations": ("locationid",),
}


def unusual_lengths_sql(name: str) -> str:
    per_column = [
        f"(select coalesce(sum(k) - max(k), 0) from (select count(*) as k from {name} "
        f"where {c} is not null group by length(cast({c} as varchar))) q)"
        for c in IDS[name]
    ]
    return f"select {' + '.join(per_column)} as n"


def several_sql(name: str, key: str, value: str) -> str:
    return (
        f"select count(*) as n from (select {key} from {name} where {key} is not null "
        f"group by {key} having count(distinct {value}) > 1) q"
    )


def rows_sql(name: str, condition: str) -> str:
    return f"select count(*) as n from {name} where {condition}"


def with_births_sql(name: str, key: str, condition: str) -> str:
    return f"select count(*) as n from {name} f join individuals i on f.{key} = i.individid where {condition}"


ELIGIBLE = f"select distinct individid from presences where {yes('sleep_lastnight')} and depart_date is null"
AWAY = f"select individid from presences where not {yes('sleep_lastnight')}"
PHONES = "select individid from telephones where NumTelephone is not null"
ELIGIBLE_HOMES = f"select distinct socialgpid from individuals where individid in ({ELIGIBLE})"
RESIDENT_HOMES = "select socialgpid from residency where trim(res_status) = '1'"


def missing_from(keys: str, column: str, others: str) -> str:
    return f"select count(*) as n from ({keys}) k where {column} not in ({others})"


# (check, sheet, metric) -> SQL giving its count.
TABLE_CHECKS: dict[tuple[str, str, str], str] = {
    **{("CHK1", sheet, "n"): unusual_lengths_sql(name) for sheet, name in SHEETS.items()},
    ("CHK2", "FNewRelationship", "n"): rows_sql("relationships", "individid = individid2"),
    ("CHK3", "FNewIndividual", "n"): rows_sql("individuals", "fatherid = motherid"),
    ("CHK4", "FNewIndividual", "n"): rows_sql("individuals", f"{age()} < 5 and motherid is null"),
    ("CHK4", "FNewIndividual", "n_without_both"): rows_sql(
        "individuals", f"{age()} < 5 and motherid is null and fatherid is null"
    ),
    ("CHK6", "FNewBirth", "n"): rows_sql("births", "birth_date > entry_date"),
    ("CHK6", "FNewIndividual", "n"): rows_sql("individuals", "birth_date > entry_date"),
    ("CHK7", "FNewBirth", "n"): rows_sql("births", "weight = 9999"),
    ("CHK8", "FNewBirth", "n"): rows_sql("births", "height = 99"),
    ("CHK9", "FNewLocation", "n"): rows_sql(
        "locations",
        "latitude is null or longitude is null or latitude < 9.0 or latitude > 15.2 "
        "or longitude < -5.6 or longitude > 2.5",
    ),
    ("CHK10", "FNewTelephone", "n"): rows_sql(
        "telephones",
        "len(list_filter(string_split(NumTelephone, '/'), "
        "lambda p: trim(p) <> '' and not regexp_full_match(trim(p), '[0-9]{8}'))) > 0",
    ),
    ("CHK11", "FNewPresences", "n"): rows_sql("presences", "depart_date <= arrive_date"),
    ("CHK12", "FNewIndividual", "n"): several_sql("individuals", "individid", "socialgpid"),
    ("CHK12", "FNewPresences", "n"): several_sql("presences", "individid", "menageid"),
    ("CHK12", "FNewEducation", "n"): several_sql("education", "individid", "socialgpid"),
    ("CHK12", "FNewResidency", "n"): several_sql("residency", "individid", "locationid"),
    ("CHK15", "FNewBase_HistMat", "n"): rows_sql("union_history", "union_age < 12 or union_age > 40"),
    ("CHK16", "FNewPresences", "n"): rows_sql("presences", f"{yes('sleep_lastnight')} and depart_date is not null"),
    ("CHK17", "FNewPresences", "n"): rows_sql(
        "presences", f"sleep_lastnight is not null and not {yes('sleep_lastnight')} and depart_date is null"
    ),
    ("CHK18", "FNewPresences", "n"): rows_sql("presences", "arrive_date is null and depart_date is null"),
    ("CHK19", "FNewDeath", "n"): (
        "select count(*) as n from (select individid from deaths where individid is not null "
        "group by individid having count(*) > 1) q"
    ),
    ("CHK20", "FNewDeath", "n"): rows_sql("deaths", f"{yes('diedinhs')} and gonetohs is not null and not {yes('gonetohs')}"),
    ("CHK21", "FNewBirth", "n"): rows_sql("births", f"{age()} < 12 and trim(rltn_head) = '1'"),
    ("CHK22", "FNewPregnancy_CPN", "n"): rows_sql(
        "antenatal", "cpn_date1 > cpn_date2 or cpn_date1 > cpn_date10 or cpn_date2 > cpn_date10"
    ),
    ("CHK23", "FNewPregnancy_CPN", "n"): rows_sql(
        "antenatal",
        "nb_cpn > (cpn_date1 is not null)::int + (cpn_date2 is not null)::int + (cpn_date10 is not null)::int",
    ),
    ("CHK24", "FNewHistGnesiqCompl", "n"): rows_sql(
        "reproductive_complement", "year(birthDate) < 2022 or year(birthDate) > 2026"
    ),
    ("CHK25", "FNewObservation", "n_too_short"): rows_sql(
        "observations", "end_time >= begin_time and datediff('second', begin_time, end_time) / 60.0 < 3"
    ),
    ("CHK25", "FNewObservation", "n_end_before_start"): rows_sql("observations", "end_time < begin_time"),
    ("CHK26", "FNewSante", "n"): several_sql("health", "respondid", "socialgpid"),
    ("CHK27", "FNewSante", "n"): rows_sql("health", "trim(S4_2) = '2' and S4_2mm is null"),
    ("CHK28", "FNewSante", "n"): rows_sql(
        "health",
        "trim(S5_1) = '7' and (trim(S5_2A) in ('1','2','3','4') or trim(S5_2B) in ('1','2','3','4') "
        "or trim(S5_2C) in ('1','2','3','4'))",
    ),
}

OUTSIDE = "({a} < {low} or {a} > {high})"


def bracket(low: int, high: int) -> str:
    return OUTSIDE.format(a=age("i.birth_date"), low=low, high=high)


# (check, table a, table b, metric) -> SQL giving its count.
CROSS_CHECKS: dict[tuple[str, str, str, str], str] = {
    ("XCK1", "FNewEducation", "FNewIndividual", "n"): with_births_sql("education", "individid", bracket(5, 34)),
    ("XCK1", "FNewEmploi", "FNewIndividual", "n"): with_births_sql("employment", "individid", bracket(15, 120)),
    ("XCK1", "FNewHistoireGnesique", "FNewIndividual", "n"): with_births_sql(
        "reproductive", "individid", bracket(12, 49)
    ),
    ("XCK1", "FNewHistGnesiqCompl", "FNewIndividual", "n"): with_births_sql(
        "reproductive_complement", "individid", bracket(12, 49)
    ),
    ("XCK1", "FNewPregnancy", "FNewIndividual", "n"): with_births_sql("pregnancies", "individid", bracket(12, 49)),
    **{
        ("XCK2", "FNewPresences", sheet, "n_eligible_without_form"): missing_from(
            ELIGIBLE, "individid", f"select individid from {name} where individid is not null"
        )
        for sheet, name in SHEETS.items()
        if sheet in ("FNewEducation", "FNewEmploi", "FNewHistGnesiqCompl", "FNewTelephone")
    },
    **{
        ("XCK2", "FNewPresences", sheet, "n_form_without_eligibility"): missing_from(
            f"select distinct individid from {name}", "individid", ELIGIBLE
        )
        for sheet, name in SHEETS.items()
        if sheet in ("FNewEducation", "FNewEmploi", "FNewHistGnesiqCompl", "FNewTelephone")
    },
    **{
        ("XCK3", "FNewPresences", sheet, "n_eligible_without_form"): missing_from(
            ELIGIBLE_HOMES, "socialgpid", f"select socialgpid from {name}"
        )
        for sheet, name in SHEETS.items()
        if sheet in ("FNewPauvrete", "FNewSante")
    },
    **{
        ("XCK3", "FNewPresences", sheet, "n_form_without_eligibility"): missing_from(
            f"select distinct socialgpid from {name}", "socialgpid", ELIGIBLE_HOMES
        )
        for sheet, name in SHEETS.items()
        if sheet in ("FNewPauvrete", "FNewSante")
    },
    ("XCK4", "FNewDeath", "FNewPresences", "n"): rows_sql("deaths", "individid in (select individid from presences)"),
    ("XCK5", "FNewMigration_Out", "FNewPresences", "n"): rows_sql(
        "migration_out", "individid in (select individid from presences)"
    ),
    ("XCK6", "FNewDeath", "FNewIndividual", "n"): with_births_sql("deaths", "individid", "evtdate < birth_date"),
    ("XCK7", "FNewRelationship", "FNewIndividual", "n_start"): with_births_sql(
        "relationships", "individid", "birth_date > uni_start_date"
    ),
    ("XCK7", "FNewRelationship", "FNewIndividual", "n_civil"): with_births_sql(
        "relationships", "individid", "birth_date > uni_civil_date"
    ),
    ("XCK8", "FNewBase_HistMat", "FNewRelationship", "n"): (
        "select count(*) as n from union_history h join relationships r on h.individid = r.individid "
        "join individuals i on i.individid = h.individid "
        "where abs(union_age - datediff('day', birth_date, uni_start_date) / 365.25) > 3"
    ),
    ("XCK9", "FNewMigration_Out", "FNewMigration_IN", "n"): (
        "select count(*) as n from migration_out o join migration_in i on o.individid = i.individid "
        "where depart_date < arrive_date"
    ),
    ("XCK10", "FNewPregnancy", "FNewPregoutcome", "n"): rows_sql(
        "pregnancies", "individid not in (select individid from outcomes)"
    ),
    ("XCK11", "FNewBirth", "FNewPregoutcome", "n"): missing_from(
        "select distinct pregoutid from births", "pregoutid", "select eventid from outcomes"
    ),
    ("XCK12", "FNewPregoutcome", "FNewPregnancy", "n"): missing_from(
        "select distinct peventid from outcomes", "peventid", "select eventid from pregnancies"
    ),
    ("XCK13", "FNewPregnancy", "FNewPresences", "n"): (
        f"select count(distinct individid) as n from pregnancies where individid in ({AWAY})"
    ),
    ("XCK14", "FNewHistoireGnesique", "FNewIndividual", "n"): with_births_sql(
        "reproductive", "individid", "trim(gender) = '1'"
    ),
    ("XCK14", "FNewHistGnesiqCompl", "FNewIndividual", "n"): with_births_sql(
        "reproductive_complement", "individid", "trim(gender) = '1'"
    ),
    ("XCK15", "FNewHistoireGnesique", "FNewHistGnesiqCompl", "n"): (
        "select count(distinct individid) as n from reproductive where living_children_number = 0 "
        f"and individid in (select individid from reproductive_complement where {yes('isAlive')})"
    ),
    ("XCK16", "FNewHistGnesiqCompl", "FNewIndividual", "n"): with_births_sql(
        "reproductive_complement", "individid", "datediff('day', birth_date, birthDate) / 365.25 < 15"
    ),
    ("XCK17", "FNewTelephone", "FNewIndividual", "n_minor_with_phone"): rows_sql(
        "individuals", f"{age()} < 15 and individid in ({PHONES})"
    ),
    ("XCK17", "FNewTelephone", "FNewIndividual", "n_adult_without_phone"): rows_sql(
        "individuals", f"{age()} >= 15 and individid not in ({PHONES})"
    ),
    ("XCK18", "FNewSante", "FNewPresences", "n"): (
        f"select count(distinct respondid) as n from health where respondid in ({AWAY})"
    ),
    ("XCK19", "FNewSante", "FNewIndividual", "n"): with_births_sql("health", "respondid", f"{age()} < 15"),
    ("XCK20", "FNewSante", "FNewIndividual", "n"): with_births_sql(
        "health", "respondid", f"{age()} < 35 and S4_2 is not null"
    ),
    ("XCK21", "FNewSnakebite", "FNewResidency", "n_form_without_resident"): missing_from(
        "select distinct socialgpid from snakebite", "socialgpid", RESIDENT_HOMES
    ),
    ("XCK21", "FNewSnakebite", "FNewResidency", "n_residents_without_form"): missing_from(
        f"select distinct socialgpid from ({RESIDENT_HOMES}) r", "socialgpid", "select socialgpid from snakebite"
    ),
}

PARENT = "select count(*) as n from individuals c join individuals p on p.individid = c.{parent} where {condition}"
GAP = "datediff('day', p.birth_date, c.birth_date) / 365.25 < 12"

RULES: dict[tuple[str, str, str | None, str], str] = {
    ("RUL1", "FNewIndividual", None, "n_sex"): rows_sql("individuals", "gender not in ('1', '2')"),
    ("RUL1", "FNewIndividual", None, "n_ethnic_group"): rows_sql("individuals", "ethnic_gp not between 1 and 13"),
    ("RUL2", "FNewIndividual", None, "n_father"): rows_sql("individuals", "fatherid = individid"),
    ("RUL2", "FNewIndividual", None, "n_mother"): rows_sql("individuals", "motherid = individid"),
    **{
        ("RUL3", "FNewIndividual", "FNewIndividual", f"n_{p}"): rows_sql(
            "individuals", f"{p}id is not null and {p}id not in (select individid from individuals)"
        )
        for p in ("father", "mother")
    },
    ("RUL4", "FNewIndividual", "FNewIndividual", "n_father"): PARENT.format(
        parent="fatherid", condition="p.gender <> '1'"
    ),
    ("RUL4", "FNewIndividual", "FNewIndividual", "n_mother"): PARENT.format(
        parent="motherid", condition="p.gender <> '2'"
    ),
    **{
        ("RUL5", "FNewIndividual", "FNewIndividual", f"n_{p}"): PARENT.format(parent=f"{p}id", condition=GAP)
        for p in ("father", "mother")
    },
}


def labelled(check: str, a: str, b: str | None, metric: str, sql: str) -> str:
    other = f"'{b}'" if b else "cast(null as varchar)"
    return f"select '{check}' as check_id, '{a}' as table_a, {other} as table_b, '{metric}' as metric, cast(n as bigint) as n from ({sql}) r"


def all_labelled(*groups: dict, check: str | None = None, table: str | None = None) -> str:
    parts = []
    for group in groups:
        for key, sql in group.items():
            name, a, b, metric = key if len(key) == 4 else (key[0], key[1], None, key[2])
            if (check in (None, name)) and (table is None or table in (a, b)):
                parts.append(labelled(name, a, b, metric, sql))
    return "\nunion all\n".join(parts)


def shown(result):
    return result.where("applicable").select(
        F.col("check").alias("check_id"), "table_a", "table_b", "metric", "n"
    )


# The sheets a check needs, for the single-check queries.
NEEDS = {
    "XCK1": ("FNewIndividual", "FNewEducation", "FNewEmploi", "FNewHistoireGnesique", "FNewHistGnesiqCompl", "FNewPregnancy"),
    "XCK2": ("FNewPresences", "FNewEducation", "FNewEmploi", "FNewHistGnesiqCompl", "FNewTelephone"),
    "XCK3": ("FNewIndividual", "FNewPresences", "FNewPauvrete", "FNewSante"),
}


def _register_single_checks() -> None:
    for check in sorted({k[0] for k in TABLE_CHECKS}, key=lambda c: int(c[3:])):
        sheets = [k[1] for k in TABLE_CHECKS if k[0] == check]
        sheets = list(dict.fromkeys(sheets))

        def run(spark, folder, check=check, sheets=tuple(sheets)):
            tables = survey(spark, folder, *sheets)
            return shown(A.union_all(A.audit_tables(tables, list(tables), AS_OF, [check])))

        register(f"chk_{int(check[3:]):02d}", run, all_labelled(TABLE_CHECKS, check=check))

    for group, prefix in ((CROSS_CHECKS, "xck"), (RULES, "rule")):
        for check in sorted({k[0] for k in group}, key=lambda c: int(c[3:])):
            sheets = {name for k in group if k[0] == check for name in k[1:3] if name}
            if check not in ("XCK2", "XCK4", "XCK5", "XCK9", "XCK10", "XCK11", "XCK12", "XCK13", "XCK18", "XCK21"):
                sheets.add("FNewIndividual")
            sheets |= set(NEEDS.get(check, ()))

            def run(spark, folder, check=check, sheets=tuple(sheets)):
                return shown(A.audit_across(survey(spark, folder, *sheets), AS_OF, [check]))

            register(f"{prefix}_{int(check[3:]):02d}", run, all_labelled(group, check=check))


_register_single_checks()


@query(
    "chk_05",
    labelled("CHK5", "FNewDeath", None, "n", with_births_sql("deaths", "individid", "birth_date > evtdate")),
)
def birth_after_death(spark, folder):
    """A death form that carries the birth date itself."""
    births = view(spark, folder, "individuals").select("individid", "birth_date")
    tables = TableSet({"FNewDeath": view(spark, folder, "deaths").join(births, "individid")})
    return shown(A.audit_table(tables, "FNewDeath", AS_OF, ["CHK5"]))


@query(
    "chk_13_14",
    " union all ".join(
        labelled("CHK13", sheet, None, "n", with_births_sql(name, "individid", bracket(low, high)))
        for sheet, name, low, high in (
            ("FNewEducation", "education", 5, 34),
            ("FNewEmploi", "employment", 15, 120),
            ("FNewHistoireGnesique", "reproductive", 12, 49),
            ("FNewPregnancy", "pregnancies", 12, 49),
        )
    ),
)
def age_brackets(spark, folder):
    """Forms that carry the birth date themselves, each with the bracket of its type."""
    births = view(spark, folder, "individuals").select("individid", "birth_date")
    names = {
        "FNewEducation": "education",
        "FNewEmploi": "employment",
        "FNewHistoireGnesique": "reproductive",
        "FNewPregnancy": "pregnancies",
    }
    tables = TableSet({s: view(spark, folder, n).join(births, "individid") for s, n in names.items()})
    return shown(A.union_all(A.audit_tables(tables, list(tables), AS_OF, ["CHK13"])))


@query("audit_row_checks", all_labelled(TABLE_CHECKS))
def audit_row_checks(spark, folder):
    tables = survey(spark, folder)
    return shown(A.union_all(A.audit_tables(tables, list(tables), AS_OF)))


@query("audit_full", all_labelled(TABLE_CHECKS, CROSS_CHECKS))
def audit_full(spark, folder):
    return shown(A.audit_full(survey(spark, folder), AS_OF))


@query("audit_one_table", all_labelled(TABLE_CHECKS, CROSS_CHECKS, table="FNewTelephone"))
def audit_one_table(spark, folder):
    tables = survey(spark, folder)
    return shown(A.audit_full(tables, AS_OF, table="FNewTelephone"))


@query(
    "flagged_presences",
    f"""
    select violation, count(*) as n from (
      select unnest(list_filter([
        case when depart_date <= arrive_date then 'CHK11' end,
        case when {yes('sleep_lastnight')} and depart_date is not null then 'CHK16' end,
        case when sleep_lastnight is not null and not {yes('sleep_lastnight')} and depart_date is null then 'CHK17' end,
        case when arrive_date is null and depart_date is null then 'CHK18' end
      ], lambda x: x is not null)) as violation from presences) q
    group by violation
    """,
)
def flagged_presences(spark, folder):
    """Rows with the checks they break, counted per check."""
    tables = survey(spark, folder, "FNewPresences")
    rows = A.flagged_rows(tables, "FNewPresences", AS_OF)
    return rows.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query(
    "flagged_residency_rows",
    """
    select individid, socialgpid, locationid, res_status from residency where individid in (
      select individid from residency group by individid having count(distinct locationid) > 1)
    """,
)
def flagged_residency_rows(spark, folder):
    return A.flagged_key_rows(survey(spark, folder, "FNewResidency"), "FNewResidency", "CHK12")


@query(
    "unusual_identifiers",
    """
    select eventid, individid from pregnancies
    where length(cast(eventid as varchar)) <> (
        select l from (select length(cast(eventid as varchar)) as l, count(*) as k from pregnancies group by 1
                       order by k desc, l limit 1) a)
      or length(cast(individid as varchar)) <> (
        select l from (select length(cast(individid as varchar)) as l, count(*) as k from pregnancies group by 1
                       order by k desc, l limit 1) b)
    """,
)
def unusual_identifiers(spark, folder):
    rows = A.unusual_length_rows(survey(spark, folder, "FNewPregnancy"), "FNewPregnancy")
    return rows.select("eventid", "individid")


@query(
    "xck_02_keys",
    f"""
    with eligible as ({ELIGIBLE}), forms as (select distinct individid from education)
    select 'n_eligible_without_form' as metric, cast(individid as varchar) as person from eligible
      where individid not in (select individid from forms)
    union all
    select 'n_form_without_eligibility' as metric, cast(individid as varchar) as person from forms
      where individid not in (select individid from eligible)
    """,
)
def eligibility_keys(spark, folder):
    """All persons of each direction."""
    tables = survey(spark, folder, "FNewPresences", "FNewEducation")
    return A.CrossAudit(tables, AS_OF).keys("XCK2", cap=None).select("metric", F.col("key").alias("person"))


@query(
    "xck_23_status_overlap",
    """
    select 'FNewDeath' as status_table, 'FNewPresences' as target, 'individid' as key, count(*) as n
    from deaths where individid in (select individid from presences)
    """,
)
def status_overlap(spark, folder):
    return A.status_overlap(survey(spark, folder, "FNewDeath", "FNewPresences"), "FNewDeath", "FNewPresences")
