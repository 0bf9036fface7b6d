"""Survey-shaped views over the customer, orders, supplier and nation tables.

The SQL runs unchanged in Spark and in other ANSI engines, so the same text feeds the queries
and the checks of their results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hearthcheck.plans.catalog import TableSet

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The day ages are computed at.
AS_OF = "2005-01-01"

VIEWS: dict[str, str] = {
    "individuals": """
select c_custkey as individid, cast(floor(c_custkey / 4) as bigint) as socialgpid,
  case when c_custkey % 2 = 0 then '1' else '2' end as gender, cast(1 + c_custkey % 14 as int) as ethnic_gp,
  case when c_custkey % 29 = 0 then null else cast('1940-01-01' as date) + cast((c_custkey * 7919) % 30000 as int) end as birth_date,
  case when c_custkey % 7 = 0 then null when c_custkey % 35 = 1 then c_custkey - 3 else c_custkey - 2 end as fatherid,
  case when c_custkey % 5 = 0 then null else c_custkey - 3 end as motherid,
  cast('1990-01-01' as date) + cast((c_custkey * 31) % 4000 as int) as entry_date from customer""",
    "presences": """
select o_orderkey as eventid, o_custkey as individid, o_orderkey % 200 as menageid,
  concat('A', cast(o_orderkey % 11 as string)) as field_wrkr, cast(o_orderdate as date) as entry_date,
  case when o_orderkey % 17 = 0 then null when o_orderstatus = 'F' then '2' when o_orderkey % 3 = 0 then 'Oui' else '1' end as sleep_lastnight,
  case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as arrive_date,
  case when o_orderkey % 6 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 5 - 2 as int) end as depart_date from orders""",
    "deaths": """
select o_orderkey as eventid, case when o_orderkey % 38 = 0 then o_custkey + 1000000 else o_custkey end as individid,
  concat('A', cast(o_orderkey % 11 as string)) as field_wrkr, cast(o_orderdate as date) as evtdate, case when o_orderkey % 2 = 0 then 'oui' else 'non' end as diedinhs,
  case when o_orderkey % 3 = 0 then 'non' else 'oui' end as gonetohs from orders where o_orderkey % 19 = 0""",
    "births": """
select o_orderkey as eventid, o_orderkey as pregoutid, o_custkey as individid, concat('A', cast(o_orderkey % 11 as string)) as field_wrkr,
  cast(o_orderdate as date) as birth_date, cast(o_orderdate as date) + cast(o_orderkey % 40 - 3 as int) as entry_date,
  case when o_orderkey % 70 = 0 then 9999 else 2500 + o_orderkey % 1500 end as weight,
  case when o_orderkey % 110 = 0 then 99 else 45 + o_orderkey % 10 end as height,
  cast(1 + o_orderkey % 9 as string) as rltn_head from orders where o_orderkey % 10 = 0""",
    "pregnancies": """
select o_orderkey as eventid, o_custkey as individid, concat('A', cast(o_orderkey % 11 as string)) as field_wrkr,
  cast(o_orderdate as date) as evtdate from orders where o_orderkey % 5 = 0""",
    "outcomes": """
select o_orderkey as eventid, case when o_orderkey % 60 = 0 then -1 - o_orderkey else o_orderkey end as peventid,
  o_custkey as individid from orders where o_orderkey % 10 = 0 and o_orderkey % 50 <> 0""",
    "antenatal": """
select o_orderkey as peventid, cast(floor(o_orderkey / 5) as bigint) % 5 as nb_cpn, cast(o_orderdate as date) as cpn_date1,
  case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) + cast(o_orderkey % 50 - 5 as int) end as cpn_date2,
  case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) + 60 end as cpn_date10 from orders where o_orderkey % 5 = 0""",
    "education": """
select c_custkey as individid, cast(floor(c_custkey / 4) as bigint) as socialgpid, c_mktsegment as education_level
  from customer where c_custkey % 3 = 0""",
    "employment": """
select c_custkey as individid, c_mktsegment as activity, c_acctbal as income from customer where c_custkey % 4 = 1""",
    "union_history": """
select c_custkey as individid, 8 + c_custkey % 40 as union_age from customer where c_custkey % 6 = 0""",
    "relationships": """
select c_custkey as individid, case when c_custkey % 42 = 0 then c_custkey else c_custkey + 1 end as individid2,
  cast('1955-01-01' as date) + cast((c_custkey * 6151) % 25000 as int) as uni_start_date,
  case when c_custkey % 12 = 0 then cast('1960-01-01' as date) + cast((c_custkey * 4153) % 25000 as int) end as uni_civil_date
  from customer where c_custkey % 6 = 0""",
    "reproductive": """
select c_custkey as individid, c_custkey % 3 as living_children_number from customer where c_custkey % 5 = 0""",
    "reproductive_complement": """
select c_custkey as individid, case when c_custkey % 20 = 0 then 'oui' else 'non' end as isAlive,
  cast('1990-01-01' as date) + cast((c_custkey * 3571) % 13000 as int) as birthDate from customer where c_custkey % 10 = 0""",
    "telephones": """
select c_custkey as individid, case when c_custkey % 33 = 1 then '701234' when c_custkey % 13 = 0 then '70123456/70654321'
  when c_custkey % 20 = 4 then null else cast(70000000 + c_custkey as string) end as NumTelephone from customer where c_custkey % 3 = 1""",
    "migration_in": """
select c_custkey as individid, cast('1995-01-01' as date) + cast((c_custkey * 37) % 900 as int) as arrive_date from customer where c_custkey % 9 = 0""",
    "migration_out": """
select c_custkey as individid, cast('1995-06-01' as date) + cast((c_custkey * 53) % 900 as int) as depart_date from customer where c_custkey % 3 = 0""",
    "residency": """
select c_custkey as individid, cast(floor(c_custkey / 4) as bigint) as socialgpid, c_custkey % 50 as locationid,
  case when c_custkey % 8 = 0 then '2' else '1' end as res_status from customer
  union all select c_custkey, cast(floor(c_custkey / 4) as bigint), 900 + c_custkey % 50, '1' from customer where c_custkey % 25 = 0""",
    "snakebite": """
select case when s_suppkey % 5 = 0 then s_suppkey + 100000 else s_suppkey * 3 end as socialgpid from supplier""",
    "poverty": """
select s_suppkey * 2 as socialgpid from supplier""",
    "health": """
select c_custkey as respondid, cast(floor(c_custkey / 4) as bigint) as socialgpid, cast(1 + c_custkey % 2 as string) as S4_2,
  case when c_custkey % 4 = 0 then '06' end as S4_2mm, cast(1 + c_custkey % 8 as string) as S5_1, cast(1 + c_custkey % 6 as string) as S5_2A,
  '5' as S5_2B, cast(1 + c_custkey % 9 as string) as S5_2C from customer where c_custkey % 7 = 0
  union all select c_custkey, 5000 + c_custkey, '1', '06', '1', '1', '5', '1' from customer where c_custkey % 49 = 0""",
    "observations": """
select o_orderkey as observeid, o_orderdate as begin_time, case when o_orderkey % 3 = 0 then o_orderdate + interval '2' minute
  when o_orderkey % 7 = 0 then o_orderdate - interval '5' minute else o_orderdate + interval '45' minute end as end_time from orders where o_orderkey % 25 = 0""",
    "locations": """
select s_suppkey as locationid, case when s_suppkey % 9 = 0 then null else cast(8 + s_suppkey % 9 as double) end as latitude,
  cast(s_suppkey % 11 as double) - 6.5 as longitude from supplier""",
    "visits": """
select o_orderkey as id, concat('A', cast(o_orderkey % 11 as string)) as agent_id from orders where o_orderkey % 2 = 0""",
    "births_by_visit": """
select o_custkey as individu_id, o_orderkey as enquete_id from orders where o_orderkey % 10 = 0""",
    "team": """
select concat('A', cast(n_nationkey as string)) as field_wrkr, concat('C', cast(n_nationkey % 3 as string)) as controleur from nation where n_nationkey < 10""",
    "users": """
select concat('A', cast(n_nationkey as string)) as id, concat('a', cast(n_nationkey as string), '@example.org') as email from nation where n_nationkey < 9""",
}

# The name each view carries in the table set, which is what gives it its role.
SHEETS: dict[str, str] = {
    "FNewIndividual": "individuals",
    "FNewPresences": "presences",
    "FNewDeath": "deaths",
    "FNewBirth": "births",
    "FNewPregnancy": "pregnancies",
    "FNewPregoutcome": "outcomes",
    "FNewPregnancy_CPN": "antenatal",
    "FNewEducation": "education",
    "FNewEmploi": "employment",
    "FNewBase_HistMat": "union_history",
    "FNewRelationship": "relationships",
    "FNewHistoireGnesique": "reproductive",
    "FNewHistGnesiqCompl": "reproductive_complement",
    "FNewTelephone": "telephones",
    "FNewMigration_IN": "migration_in",
    "FNewMigration_Out": "migration_out",
    "FNewResidency": "residency",
    "FNewSnakebite": "snakebite",
    "FNewPauvrete": "poverty",
    "FNewSante": "health",
    "FNewObservation": "observations",
    "FNewLocation": "locations",
}

FIELD_SHEETS: dict[str, str] = {
    "FNewPresences": "presences",
    "FNewBirth": "births",
    "FNewDeath": "deaths",
    "FNewPregnancy": "pregnancies",
    "equipe": "team",
    "users": "users",
}


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _open(spark: SparkSession, folder: str, *names: str) -> None:
    """The base tables that the named views are made of, each opened once."""
    for table in BASE_TABLES:
        if any(re.search(rf"\bfrom {table}\b", VIEWS[n]) for n in names):
            base_table(spark, folder, table).createOrReplaceTempView(table)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One survey view; only the base tables it names are opened."""
    _open(spark, folder, name)
    return spark.sql(VIEWS[name])


def survey(spark: SparkSession, folder: str, *sheets: str, names: dict[str, str] = SHEETS) -> TableSet:
    """A table set of the named sheets (all of them by default)."""
    picked = [s for s in names if not sheets or s in sheets]
    _open(spark, folder, *(names[s] for s in picked))
    return TableSet({s: spark.sql(VIEWS[names[s]]) for s in picked})


def with_views(query: str) -> str:
    """The query preceded by the views it uses, for an engine that only has the base tables."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", query)]
    if not used:
        return query
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in used)
    body = query.strip()
    glue = ",\n" if body.lower().startswith("with ") else "\n"
    return f"with {ctes}{glue}{body[5:] if glue[0] == ',' else body}"
