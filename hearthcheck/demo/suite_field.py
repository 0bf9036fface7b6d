"""Registered field-work reports and identifier search."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthcheck.demo.registry import query
from hearthcheck.demo.views import AS_OF, FIELD_SHEETS, base_table, survey, view
from hearthcheck.operators import fieldwork as W
from hearthcheck.plans.catalog import TableSet

BAD = "({c} is null or {c} > date '2005-01-01' or {c} < date '1900-01-01')"


@query(
    "agent_quality",
    f"""
    with marked as (
      select *, count(*) over (partition by eventid) > 1 as d1, count(*) over (partition by individid) > 1 as d2,
        count(*) over (partition by menageid) > 1 as d3 from presences)
    select field_wrkr as agent, count(*) as n_forms,
      cast(sum(d1::int + d2::int + d3::int) as bigint) as duplicate_ids,
      cast(sum({"+".join(BAD.format(c=c) + "::int" for c in ("entry_date", "arrive_date", "depart_date"))}) as bigint) as implausible_dates,
      round_even(avg(({"+".join(f"({c} is null)::int" for c in ("eventid", "individid", "menageid", "field_wrkr", "entry_date", "sleep_lastnight", "arrive_date", "depart_date"))}) / 8.0), 3)
        as mean_missing_rate
    from marked group by field_wrkr
    """,
)
def agent_quality(spark, folder):
    return W.agent_quality(view(spark, folder, "presences"), as_of=AS_OF)


VOLUME = """
    select field_wrkr as agent, 'Ménages/UCH visités' as category, count(*) as n from presences group by 1
    union all select field_wrkr, 'Ménages/UCH distincts', count(distinct menageid) from presences group by 1
    union all select field_wrkr, 'Naissances enregistrées', count(*) from births group by 1
    union all select field_wrkr, 'Décès enregistrés', count(*) from deaths group by 1
    union all select field_wrkr, 'Grossesses enregistrées', count(*) from pregnancies group by 1
"""
WIDE = """
    select agent, {extra}
      cast(coalesce(sum(n) filter (where category = 'Ménages/UCH visités'), 0) as bigint) as visits,
      cast(coalesce(sum(n) filter (where category = 'Ménages/UCH distincts'), 0) as bigint) as homes,
      cast(coalesce(sum(n) filter (where category = 'Naissances enregistrées'), 0) as bigint) as births,
      cast(coalesce(sum(n) filter (where category = 'Décès enregistrés'), 0) as bigint) as deaths,
      cast(coalesce(sum(n) filter (where category = 'Grossesses enregistrées'), 0) as bigint) as pregnancies,
      cast(coalesce(sum(n) filter (where category <> 'Ménages/UCH distincts'), 0) as bigint) as total
    from ({volume}) v group by all
"""
SHORT = {
    "Ménages/UCH visités": "visits",
    "Ménages/UCH distincts": "homes",
    "Naissances enregistrées": "births",
    "Décès enregistrés": "deaths",
    "Grossesses enregistrées": "pregnancies",
    "total_fiches": "total",
}


def _field(spark, folder):
    return survey(spark, folder, names=FIELD_SHEETS)


@query("agent_volume", WIDE.format(extra="", volume=VOLUME))
def agent_volume(spark, folder):
    return W.agent_volume(_field(spark, folder)).withColumnsRenamed(SHORT)


@query("agent_volume_excluding", f"select * from ({VOLUME}) v where lower(agent) not in ('a1', 'a7')")
def agent_volume_excluding(spark, folder):
    return W.agent_volume_long(_field(spark, folder), exclude=[" A1", "a7 "])


@query(
    "agent_volume_births_only",
    "select field_wrkr as agent, count(*) as births from births group by 1 "
    "union all select agent, 0 from (select distinct field_wrkr as agent from presences union select field_wrkr from deaths "
    "union select field_wrkr from pregnancies) a where agent not in (select field_wrkr from births)",
)
def agent_volume_births_only(spark, folder):
    report = W.agent_volume(_field(spark, folder))
    return W.only_categories(report, ["Naissances enregistrées"]).withColumnsRenamed(SHORT)


@query(
    "agent_controller",
    f"""
    select v.*, coalesce(t.controleur, 'Non renseigné') as controleur, coalesce(u.email, 'Non renseigné') as email_agent
    from ({WIDE.format(extra="", volume=VOLUME)}) v
    left join team t on t.field_wrkr = v.agent left join users u on u.id = v.agent
    """,
)
def agent_controller(spark, folder):
    tables = _field(spark, folder)
    report = W.add_email(W.add_controller(W.agent_volume(tables), tables), tables)
    return report.withColumnsRenamed(SHORT)


def _visits(spark, folder) -> TableSet:
    names = {"enquete_or_visites": "visits", "naissances": "births_by_visit"}
    return TableSet({sheet: view(spark, folder, name) for sheet, name in names.items()})


@query(
    "agent_via_visit",
    """
    select b.individu_id, b.enquete_id, v.agent_id as agent from births_by_visit b left join visits v on v.id = b.enquete_id
    """,
)
def agent_via_visit(spark, folder):
    rows, column = W.with_agent(_visits(spark, folder), "naissances")
    return rows.select("individu_id", "enquete_id", F.col(column).alias("agent"))


@query(
    "agent_volume_via_visit",
    """
    select v.agent_id as agent, 'Naissances enregistrées' as category, count(*) as n
    from births_by_visit b join visits v on v.id = b.enquete_id group by 1
    union all select agent_id, 'Autres fiches (enquete_or_visites)', count(*) from visits group by 1
    """,
)
def agent_volume_via_visit(spark, folder):
    return W.agent_volume_long(_visits(spark, folder))


DAILY = "select cast(entry_date as varchar) as day, field_wrkr as agent, count(*) as n_forms from presences where entry_date is not null group by 1, 2"


@query("agent_daily", DAILY)
def agent_daily(spark, folder):
    return W.agent_daily(_field(spark, folder)).withColumn("day", F.col("day").cast("string"))


@query(
    "progress_curve",
    f"""
    select day, cast(sum(n_forms) as bigint) as n, cast(sum(sum(n_forms)) over (order by day) as bigint) as cumulative
    from ({DAILY}) d group by day
    """,
)
def progress_curve(spark, folder):
    curve = W.progress_curve(W.agent_daily(_field(spark, folder)))
    return curve.withColumn("day", F.col("day").cast("string"))


def forecast_sql(goal: str) -> str:
    return f"""
    with d as ({DAILY}),
      t as (select cast(sum(n_forms) as bigint) as done, count(distinct day) as days_observed, min(day) as first_day, max(day) as last_day from d),
      r as (select *, cast({goal} as bigint) as goal, greatest(cast({goal} as bigint) - done, 0) as remaining, done / days_observed as pace from t),
      l as (select *, case when remaining = 0 then 0 else cast(ceil(remaining / pace) as bigint) end as days_left from r)
    select goal, done, days_observed, round_even(pace, 1) as mean_per_day, remaining, first_day, last_day, days_left,
      cast(cast(last_day as date) + cast(days_left as integer) as varchar) as projected_end,
      round_even(remaining / 20, 1) as needed_per_day from l
    """


def _forecast(spark, folder, goal):
    forecast = W.goal_forecast(W.agent_daily(_field(spark, folder)), goal, days_available=20)
    for c in ("first_day", "last_day", "projected_end"):
        forecast = forecast.withColumn(c, F.col(c).cast("string"))
    return forecast


@query("goal_forecast", forecast_sql("1000000"))
def goal_forecast(spark, folder):
    return _forecast(spark, folder, 1_000_000)


@query("goal_reached", forecast_sql("10"))
def goal_reached(spark, folder):
    return _forecast(spark, folder, 10)


# ---------------------------------------------------------------------- identifier search

SEARCHED = {"education": "individid, socialgpid", "deaths": "eventid, individid", "telephones": "individid"}


def hits_sql(value: str) -> str:
    parts = []
    for name, columns in SEARCHED.items():
        test = " or ".join(f"{c.strip()} = {value}" for c in columns.split(","))
        parts.append(f"select '{name}' as table_name, count(*) as n from {name} where {test} having count(*) > 0")
    return " union all ".join(parts)


def _searched(spark, folder) -> TableSet:
    return survey(spark, folder, names={n: n for n in SEARCHED})


@query("id_search", hits_sql("114"))
def id_search(spark, folder):
    found = W.search_identifier(_searched(spark, folder), " 114 ")
    return found.groupBy(F.col("table").alias("table_name")).agg(F.count("*").alias("n"))


@query(
    "id_search_batch",
    "select identifier, table_name, count(*) as n from ("
    + " union all ".join(
        f"select cast(w.id as varchar) as identifier, '{name}' as table_name from {name} t join (select distinct n_nationkey as id from nation) w on "
        + " or ".join(f"t.{c.strip()} = w.id" for c in columns.split(","))
        for name, columns in SEARCHED.items()
    )
    + ") q group by 1, 2",
)
def id_search_batch(spark, folder):
    wanted = base_table(spark, folder, "nation").select("n_nationkey")
    found = W.search_identifiers(_searched(spark, folder), wanted, "n_nationkey")
    return found.groupBy("identifier", F.col("table").alias("table_name")).agg(F.count("*").alias("n"))
