"""Field-work reports: quality and volume per agent, daily progress, goal forecast, identifier search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.operators.joins import lookup, one_per_key
from hearthcheck.operators.skew import join_reference, may_be_member, member_bits
from hearthcheck.operators.stats import implausible_date, require_columns, running_total, union_all
from hearthcheck.plans import patterns as P
from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet

VIA_VISIT = "_agent_via_visit"


# ---------------------------------------------------------------------- quality


def agent_quality(
    df: DataFrame,
    agent: str | None = None,
    as_of: str | None = None,
    ids: Sequence[str] | None = None,
    dates: Sequence[str] | None = None,
) -> DataFrame:
    """Forms, duplicated identifier cells, implausible dates and mean missing rate of each agent.

    A cell is a duplicate when its value occurs again anywhere in the table, whoever entered it;
    missing identifiers are duplicates of each other. Values are grouped once: those seen a single
    time name their only agent, and an agent's duplicates are all the other cells.
    """
    if agent is None:
        found = R.agent_columns(df)
        if not found:
            raise ValueError("No agent column found; name one.")
        agent = found[0]
    require_columns(df, agent)
    ids = [c for c in (R.id_columns(df) if ids is None else ids) if c != agent]
    texts = R.text_columns(df) if dates is None else []
    dates = R.typed_dates(df) if dates is None else list(dates)
    who = S.column(agent)

    bad_dates = sum((S.as_flag(implausible_date(df, c, as_of)) for c in dates), F.lit(0).cast("bigint"))
    # text columns are counted per agent as if they were dates; whether they are is known from all agents together
    judged = [
        F.struct(
            F.sum(S.as_flag(implausible_date(df, c, as_of))).alias("bad"),
            F.sum(S.as_flag(S.parse_moment(S.column(c)).isNotNull())).alias("parsed"),
            F.count(S.column(c)).alias("filled"),
        ).alias(f"t{i}")
        for i, c in enumerate(texts)
    ]
    missing = sum((S.as_flag(S.column(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    per_agent = df.groupBy(who.alias("agent")).agg(
        F.count(F.lit(1)).alias("n_forms"),
        F.sum(bad_dates).alias("implausible_dates"),
        F.bround(F.avg(missing / F.lit(float(len(df.columns)))), 3).alias("mean_missing_rate"),
        *judged,
    )
    if texts:
        shares = per_agent.agg(
            F.array(*[F.try_divide(F.sum(f"t{i}.parsed"), F.sum(f"t{i}.filled")) for i in range(len(texts))]).alias("s")
        ).scalar()
        more = [F.when(F.get(shares, F.lit(i)) > P.DATE_SHARE, F.col(f"t{i}.bad")).otherwise(F.lit(0)) for i in range(len(texts))]
        per_agent = per_agent.withColumn("implausible_dates", sum(more, F.col("implausible_dates")))
    if not ids:
        return per_agent.withColumn("duplicate_ids", F.lit(0).cast("bigint")).select(*QUALITY_COLUMNS)

    cells = F.array(
        *[F.struct(F.lit(i).alias("slot"), S.column(c).cast("string").alias("value")) for i, c in enumerate(ids)]
    )
    unique = (
        df.select(who.alias("agent"), F.explode(cells).alias("cell"))
        .groupBy("cell.slot", "cell.value")
        .agg(F.count(F.lit(1)).alias("k"), F.min("agent").alias("agent"))
        .where("k = 1")
        .groupBy("agent")
        .agg(F.count(F.lit(1)).alias("n_unique"))
    )
    joined = per_agent.join(
        unique.withColumnRenamed("agent", "_agent"), F.col("agent").eqNullSafe(F.col("_agent")), "left"
    )
    duplicates = F.col("n_forms") * len(ids) - F.coalesce(F.col("n_unique"), F.lit(0))
    return joined.withColumn("duplicate_ids", duplicates).select(*QUALITY_COLUMNS)


QUALITY_COLUMNS = ("agent", "n_forms", "duplicate_ids", "implausible_dates", "mean_missing_rate")


# ---------------------------------------------------------------------- who did it


def visit_table(tables: TableSet) -> tuple[str, str, str] | None:
    """(table, its identifier, its agent column) of the visits that say who filled a form."""
    for name, df in tables.items():
        agents, own = R.agent_columns(df), R.primary_id(df)
        if tables.plays(name, P.VISIT_TABLE) and agents and own:
            return name, own, agents[0]
    return None


def _visit_link(tables: TableSet, name: str) -> tuple[str, DataFrame, str, str] | None:
    """(visit column of the form, visits, their identifier, their agent), when a form only cites a visit."""
    cited, visits = R.first_column(tables[name], P.VISIT_ID), visit_table(tables)
    if cited is None or visits is None:
        return None
    table, own, agent = visits
    return cited, tables[table], own, agent


def with_agent(tables: TableSet, name: str, check_match: bool = False) -> tuple[DataFrame, str | None]:
    """The table and its agent column: its own, else one looked up through the visit it cites.

    With ``check_match`` the lookup is run at once, and an agent column that no row could fill counts as none.
    """
    df = tables[name]
    direct = R.agent_columns(df)
    if direct:
        return df, direct[0]
    link = _visit_link(tables, name)
    if link is None:
        return df, None
    cited, visits, own, agent = link
    enriched = lookup(df, cited, visits, own, agent, VIA_VISIT, default=None)
    if check_match and enriched.where(S.column(VIA_VISIT).isNotNull()).isEmpty():
        return df, None
    return enriched, VIA_VISIT


def _is_team_table(df: DataFrame) -> bool:
    return R.first_column(df, P.CONTROLLER) is not None


def _agent_text(c: Column) -> Column:
    return F.trim(c.cast("string"))


# ---------------------------------------------------------------------- volume


def volume_category(tables: TableSet, name: str) -> str:
    for label, words in P.VOLUME_CATEGORIES:
        if tables.plays(name, words):
            return label
    return P.OTHER_FORMS.format(table=name)


def _counts_by_agent(tables: TableSet, name: str, agent: str | None) -> DataFrame | None:
    """Forms per agent of one table. Through visits, forms are counted per visit before the join."""
    df = tables[name]
    direct = agent if agent and agent in df.columns else next(iter(R.agent_columns(df)), None)
    if direct:
        return df.groupBy(_agent_text(S.column(direct)).alias("agent")).agg(F.count(F.lit(1)).alias("n"))
    link = _visit_link(tables, name)
    if link is None:
        return None
    cited, visits, own, agent_column = link
    as_text = S.needs_text_key([(df, cited), (visits, own)])
    per_visit = df.groupBy(S.key_column(df, cited, as_text).alias("_visit")).agg(F.count(F.lit(1)).alias("n"))
    keyed = visits.withColumn("_own", S.key_column(visits, own, as_text))
    known = one_per_key(keyed, "_own", agent_column)
    joined = per_visit.join(known, F.col("_visit") == F.col("_lookup"), "left")
    # a table none of whose visits is known says nothing about agents
    matched = joined.agg(F.count("_lookup").alias("m")).scalar()
    joined = joined.where(matched > 0)
    return joined.groupBy(_agent_text(F.col("_found")).alias("agent")).agg(F.sum("n").alias("n"))


def agent_volume_long(
    tables: TableSet, exclude: Sequence[str] = (), agent: str | None = None
) -> DataFrame:
    """Forms per agent and category over all tables that know their agent; team tables are not forms."""
    parts = []
    for name, df in tables.items():
        if _is_team_table(df):
            continue
        counts = _counts_by_agent(tables, name, agent)
        if counts is None:
            continue
        category = volume_category(tables, name)
        parts.append(counts.select("agent", F.lit(category).alias("category"), "n"))
        place = R.first_column(df, P.PLACE)
        if category == P.VOLUME_CATEGORIES[0][0] and place:
            enriched, column = with_agent(tables, name, check_match=False)
            column = agent if agent and agent in df.columns else column
            homes = (
                enriched.groupBy(S.column(column).alias("a"))
                .agg(F.countDistinct(S.column(place)).alias("n"))
                .groupBy(_agent_text(F.col("a")).alias("agent"))
                .agg(F.sum("n").alias("n"))
            )
            parts.append(homes.select("agent", F.lit(P.DISTINCT_HOUSEHOLDS).alias("category"), "n"))
    if not parts:
        raise ValueError("No loaded table says which agent filled its forms.")
    totals = union_all(parts).groupBy("agent", "category").agg(F.sum("n").alias("n"))
    left_out = sorted({str(a).strip().lower() for a in exclude})
    if left_out:
        totals = totals.where(F.col("agent").isNull() | ~F.lower("agent").isin(left_out))
    return totals


def volume_categories(tables: TableSet, agent: str | None = None) -> list[str]:
    """The categories the report of these tables has, from names and schemas."""
    found: list[str] = []
    for name, df in tables.items():
        knows = R.agent_columns(df) or _visit_link(tables, name) or (agent and agent in df.columns)
        if _is_team_table(df) or not knows:
            continue
        category = volume_category(tables, name)
        found.append(category)
        if category == P.VOLUME_CATEGORIES[0][0] and R.first_column(df, P.PLACE):
            found.append(P.DISTINCT_HOUSEHOLDS)
    return sorted(set(found))


def agent_volume(tables: TableSet, exclude: Sequence[str] = (), agent: str | None = None) -> DataFrame:
    """One row per agent, one column per category, and the total of all forms."""
    categories = volume_categories(tables, agent)
    wide = (
        agent_volume_long(tables, exclude, agent)
        .groupBy("agent")
        .pivot("category", categories)
        .agg(F.sum("n"))
        .na.fill(0, categories)
    )
    forms = [S.column(c) for c in categories if c != P.DISTINCT_HOUSEHOLDS]
    return wide.withColumn("total_fiches", sum(forms, F.lit(0).cast("bigint")))


def only_categories(report: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The report reduced to the asked categories (all of it when none is asked)."""
    if not categories:
        return report
    wanted = list(categories)
    if P.VOLUME_CATEGORIES[0][0] in wanted:
        wanted.append(P.DISTINCT_HOUSEHOLDS)
    kept = [c for c in ("agent", "controleur", "email_agent", *wanted) if c in report.columns]
    return report.select(*[S.column(c) for c in kept])


def agent_daily(tables: TableSet, agent: str | None = None, dates: Sequence[str] | None = None) -> DataFrame:
    """Forms per day and agent, from the presence table if it can tell, else the first table that can."""
    ordered = sorted(tables, key=lambda n: 0 if tables.plays(n, P.PRESENCE_TABLE) else 1)
    for name in ordered:
        if _is_team_table(tables[name]):
            continue
        # typed dates are known without a look; only a table without any has its text columns read
        day = next(iter(dates if dates is not None else R.typed_dates(tables[name]) or R.date_columns(tables[name])), None)
        if day is None or day not in tables[name].columns:
            continue
        if agent and agent in tables[name].columns:
            df, column = tables[name], agent
        else:
            df, column = with_agent(tables, name)
        if column is None:
            continue
        dated = df.select(S.moment(df, day).cast("date").alias("day"), _agent_text(S.column(column)).alias("agent"))
        return dated.where(F.col("day").isNotNull()).groupBy("day", "agent").agg(F.count(F.lit(1)).alias("n_forms"))
    raise ValueError("No loaded table has both an agent and a date.")


def progress_curve(daily: DataFrame) -> DataFrame:
    return running_total(daily, "day", "n_forms")


# ---------------------------------------------------------------------- people behind agents


def add_controller(report: DataFrame, tables: TableSet) -> DataFrame:
    """The controller of each agent, from the first table having both; the report unchanged without one."""
    for df in tables.values():
        agents, controller = R.agent_columns(df), R.first_column(df, P.CONTROLLER)
        if agents and controller and agents[0] != controller:
            found = lookup(report, "agent", df, agents[0], controller, "controleur")
            return _after_agent(found, "controleur")
    return report


def add_email(report: DataFrame, tables: TableSet) -> DataFrame:
    """The e-mail of each agent, from the user table; the report unchanged without one."""
    for name, df in tables.items():
        email, own = R.first_column(df, P.EMAIL), R.primary_id(df)
        if tables.plays(name, P.USER_TABLE) and email and own:
            return _after_agent(lookup(report, "agent", df, own, email, "email_agent"), "email_agent")
    return report


def _after_agent(report: DataFrame, column: str) -> DataFrame:
    others = [S.column(c) for c in report.columns if c not in ("agent", column)]
    return report.select("agent", column, *others)


# ---------------------------------------------------------------------- goal


def goal_forecast(daily: DataFrame, goal: int = P.GOAL, days_available: int | None = None) -> DataFrame:
    """Done so far, mean per observed day, what remains, and the day it would be finished at that pace.

    ``days_available`` adds the pace needed to finish in that many days. One row, or none without data.
    """
    if days_available is not None and days_available <= 0:
        raise ValueError("The number of days must be positive.")
    done = daily.agg(
        F.sum("n_forms").alias("done"),
        F.countDistinct("day").alias("days_observed"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    ).where(F.col("days_observed") > 0)
    pace = F.col("done") / F.col("days_observed")
    remaining = F.greatest(F.lit(goal).cast("bigint") - F.col("done"), F.lit(0).cast("bigint"))
    left = F.when(remaining == 0, F.lit(0).cast("bigint")).otherwise(F.ceil(F.try_divide(remaining, pace)))
    forecast = done.select(
        F.lit(goal).cast("bigint").alias("goal"),
        "done",
        "days_observed",
        F.bround(pace, 1).alias("mean_per_day"),
        remaining.alias("remaining"),
        "first_day",
        "last_day",
        left.alias("days_left"),
        F.date_add(F.col("last_day"), left.cast("int")).alias("projected_end"),
    )
    if days_available is None:
        return forecast
    return forecast.withColumn("needed_per_day", F.bround(F.col("remaining") / days_available, 1))


# ---------------------------------------------------------------------- identifier search


def _holds_identifier(df: DataFrame, wanted: str) -> Column | None:
    """Does any identifier column equal the value? Integer columns compare as integers, so that the
    test reaches the file scan."""
    tests = []
    for c in R.id_columns(df):
        if S.integral(df, c):
            if S.writes_integer(wanted):
                tests.append(S.column(c) == F.lit(int(wanted)))
        else:
            tests.append(S.plain_text(S.exact_text(df, c)) == F.lit(wanted))
    return S.any_of(tests) if tests else None


def search_identifier(tables: TableSet, identifier: object) -> DataFrame:
    """Rows of every table where an identifier column equals the value, as (table, JSON row)."""
    wanted = str(identifier).strip().lower()
    parts = []
    for name, df in tables.items():
        test = _holds_identifier(df, wanted)
        if test is not None:
            row = F.to_json(F.struct(*[S.column(c) for c in df.columns]))
            parts.append(df.where(test).select(F.lit(name).alias("table"), row.alias("row")))
    if not parts:
        raise ValueError("No loaded table has an identifier column.")
    return union_all(parts)


def search_identifiers(tables: TableSet, wanted: DataFrame, column: str) -> DataFrame:
    """The same for a table of identifiers: (identifier, table, JSON row) for each match.

    A Bloom filter of the wanted identifiers is held against every identifier cell as the tables are read. Only rows
    that may match become text; their cells meet the wanted identifiers in one join for all tables.
    """
    keys = wanted.select(F.lower(F.trim(S.exact_text(wanted, column))).alias("_wanted")).where("_wanted is not null")
    bits = member_bits(keys, "_wanted")
    parts = []
    for name, df in tables.items():
        ids = R.id_columns(df)
        if not ids:
            continue
        texts = [f"lower(trim({S.sql_exact_text(df, c)})) as _id{i}" for i, c in enumerate(ids)]
        cells = df.withColumn("_bits", bits).selectExpr("*", *texts)
        found = ", ".join(f"case when {may_be_member(f'_id{i}', '_bits')} then _id{i} end" for i in range(len(ids)))
        row = ", ".join(S.quoted(c) for c in df.columns)
        # an empty array has no rows, so only rows that may match become text
        parts.append(cells.selectExpr(f"explode(array_distinct(array_compact(array({found})))) as identifier", f"{S.sql_text(name)} as table", f"to_json(struct({row})) as row"))
    if not parts:
        raise ValueError("No loaded table has an identifier column.")
    return join_reference(union_all(parts), F.col("identifier"), keys.distinct(), "_wanted", "left_semi")
