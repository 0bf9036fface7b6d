"""Registered statistics, specs, SQL and table relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthcheck.demo.registry import query
from hearthcheck.demo.views import AS_OF, base_table, survey, view
from hearthcheck.functions import scalars as S
from hearthcheck.operators import joins as J
from hearthcheck.operators import query as Q
from hearthcheck.operators import stats as ST
from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet

# ---------------------------------------------------------------------- statistics


@query(
    "frequency",
    "select o_orderstatus, count(*) as n, round_even(100 * count(*) / sum(count(*)) over (), 1) as percent "
    "from orders group by o_orderstatus",
)
def frequency(spark, folder):
    return ST.frequency(TableSet({"orders": base_table(spark, folder, "orders")})["orders"], "o_orderstatus")


@query(
    "frequency_null_kept",
    "select cast(depart_date as varchar) as depart_date, count(*) as n, "
    "round_even(100 * count(*) / sum(count(*)) over (), 1) as percent from presences group by depart_date",
)
def frequency_null_kept(spark, folder):
    counts = ST.frequency(view(spark, folder, "presences"), "depart_date")
    return counts.withColumn("depart_date", F.col("depart_date").cast("string"))


@query(
    "frequency_top",
    """
    select p_type, n, percent from (
      select p_type, count(*) as n, round_even(100 * count(*) / sum(count(*)) over (), 1) as percent
      from part group by p_type) q
    order by n desc, p_type limit 10
    """,
)
def frequency_top(spark, folder):
    """The ten leading rows of a sorted frequency table: the preview is the feature."""
    return ST.frequency_sorted(base_table(spark, folder, "part"), "p_type", top=10)


@query(
    "frequency_everywhere",
    """
    select 'FNewPresences' as table_name, field_wrkr as value, count(*) as n,
      round_even(100 * count(*) / sum(count(*)) over (), 1) as percent from presences group by field_wrkr
    union all
    select 'FNewDeath', field_wrkr, count(*), round_even(100 * count(*) / sum(count(*)) over (), 1) from deaths group by field_wrkr
    """,
)
def frequency_everywhere(spark, folder):
    tables = survey(spark, folder, "FNewPresences", "FNewDeath", "FNewEducation")
    return ST.frequency_everywhere(tables, "field_wrkr").withColumnRenamed("table", "table_name")


@query(
    "crosstab_everywhere",
    " union all ".join(
        f"""
        select '{sheet}' as table_name, coalesce(cast(fieldwrkr as varchar), 'Total') as row_value, coalesce(cast(half as varchar), 'Total') as column_value, n
        from (select field_wrkr as fieldwrkr, {column} as half, count(*) as n from {name}
              where field_wrkr is not null and {column} is not null group by cube (field_wrkr, {column})) q
        """
        for sheet, name, column in (("FNewDeath", "deaths", "diedinhs"), ("FNewDeathAgain", "deaths", "diedinhs"))
    ),
)
def crosstab_everywhere(spark, folder):
    """The same cross-tab on every table that has both columns."""
    deaths = view(spark, folder, "deaths")
    tables = TableSet({"FNewDeath": deaths, "FNewDeathAgain": deaths, "FNewEducation": view(spark, folder, "education")})
    found = ST.crosstab_everywhere(tables, "field_wrkr", "diedinhs")
    return found.select(F.col("table").alias("table_name"), "row_value", "column_value", "n")


@query(
    "correlation_everywhere",
    " union all ".join(
        f"select '{name}' as table_name, 'individid' as column_a, 'socialgpid' as column_b, round(corr(individid, socialgpid), 3) as r from {name}"
        for name in ("individuals", "education", "residency")
    ),
)
def correlation_everywhere(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("individuals", "deaths", "education", "residency")})
    return ST.correlation_everywhere(tables, ["individid", "socialgpid"]).withColumnRenamed("table", "table_name")


@query(
    "group_counts_everywhere",
    " union all ".join(
        f"select '{name}' as table_name, field_wrkr, cast(entry_date as varchar) as entry_date, count(*) as n from {name} group by field_wrkr, entry_date"
        for name in ("presences", "births")
    ),
)
def group_counts_everywhere(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("presences", "deaths", "births")})
    return ST.group_counts_everywhere(tables, ["field_wrkr", "entry_date"]).withColumnRenamed("table", "table_name")


@query(
    "sample_fixed",
    """
    select * from orders
    order by md5(concat_ws('|', '20260729', cast(o_orderkey as varchar))), o_orderkey limit 100
    """,
)
def sample_fixed(spark, folder):
    return ST.sample_rows(base_table(spark, folder, "orders"), keys=["o_orderkey"])


@query(
    "samples_everywhere",
    """
    select 'education' as table_name, cast(sum(individid) as bigint) as checksum, count(*) as n from (select individid from education
      order by md5(concat_ws('|', '7', coalesce(cast(individid as varchar), ''), coalesce(cast(socialgpid as varchar), ''),
        coalesce(education_level, ''))) limit 20) a
    union all
    select 'migration_out', cast(sum(individid) as bigint), count(*) from (select individid from migration_out
      order by md5(concat_ws('|', '7', coalesce(cast(individid as varchar), ''), coalesce(cast(depart_date as varchar), ''))) limit 20) b
    """,
)
def samples_everywhere(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("education", "migration_out")})
    rows = ST.samples_everywhere(tables, n=20, seed=7)
    person = F.get_json_object("row", "$.individid").cast("bigint")
    return rows.groupBy(F.col("table").alias("table_name")).agg(F.sum(person).alias("checksum"), F.count("*").alias("n"))


@query(
    "crosstab_margins",
    """
    select coalesce(l_returnflag, 'Total') as row_value, coalesce(l_linestatus, 'Total') as column_value,
      (l_returnflag is null or l_linestatus is null) as is_margin, count(*) as n
    from lineitem where l_returnflag is not null and l_linestatus is not null
    group by cube (l_returnflag, l_linestatus)
    """,
)
def crosstab_margins(spark, folder):
    return ST.crosstab(base_table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "crosstab_wide",
    """
    select coalesce(gender, 'Total') as row_value,
    """
    + ", ".join(f'count(*) filter (where ethnic_gp = {k}) as "{k}"' for k in range(1, 15))
    + """, count(*) as "Total"
    from individuals where ethnic_gp is not null and gender is not null group by grouping sets ((gender), ())
    """,
)
def crosstab_wide(spark, folder):
    return ST.crosstab_wide(view(spark, folder, "individuals"), "gender", "ethnic_gp", [str(k) for k in range(1, 15)])


@query(
    "crosstab_largest_cell",
    """
    select l_returnflag as row_value, l_linestatus as column_value, count(*) as n from lineitem
    where l_returnflag is not null and l_linestatus is not null
    group by l_returnflag, l_linestatus order by n desc, row_value, column_value limit 1
    """,
)
def crosstab_largest_cell(spark, folder):
    return ST.largest_cell(base_table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "multiway_counts",
    "select o_orderstatus, o_orderpriority, year(o_orderdate) as o_year, count(*) as n from orders group by all",
)
def multiway_counts(spark, folder):
    orders = base_table(spark, folder, "orders").withColumn("o_year", F.year("o_orderdate").cast("bigint"))
    return ST.group_counts(orders, ["o_orderstatus", "o_orderpriority", "o_year"])


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def correlations_sql() -> str:
    parts = [
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 3) as r from lineitem"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    ]
    return " union all ".join(parts)


@query(
    "correlation_matrix",
    f"""
    with pairs as ({correlations_sql()})
    select * from pairs union all select column_b, column_a, r from pairs
    union all {" union all ".join(f"select '{c}', '{c}', 1.0::double from lineitem having count(*) > 1" for c in NUMBERS)}
    """,
)
def correlation_matrix(spark, folder):
    return ST.correlation_matrix(base_table(spark, folder, "lineitem"), NUMBERS)


@query("correlation_strongest", f"select * from ({correlations_sql()}) q order by abs(r) desc, column_a, column_b limit 1")
def correlation_strongest(spark, folder):
    return ST.strongest_correlation(base_table(spark, folder, "lineitem"), NUMBERS)


@query(
    "correlation_constant_column",
    """
    select 'p_size' as column_a, 'p_retailprice' as column_b, round(corr(p_size, p_retailprice), 3) as r from part
    union all select 'p_size', 'fixed', cast(null as double) union all select 'p_retailprice', 'fixed', cast(null as double)
    """,
)
def correlation_constant_column(spark, folder):
    part = base_table(spark, folder, "part").withColumn("fixed", F.lit(1.0))
    return ST.correlation_pairs(part, ["p_size", "p_retailprice", "fixed"])


PERSON_COLUMNS = ("individid", "socialgpid", "gender", "ethnic_gp", "birth_date", "fatherid", "motherid", "entry_date")


@query(
    "missing_rates",
    "select * from ("
    + " union all ".join(
        f"select '{c}' as column_name, round_even(avg(case when {c} is null then 1.0 else 0.0 end), 3) as missing_rate "
        "from individuals"
        for c in PERSON_COLUMNS
    )
    + ") q where missing_rate > 0",
)
def missing_rates(spark, folder):
    return ST.missing_rates(view(spark, folder, "individuals")).withColumnRenamed("column", "column_name")


@query(
    "duplicates_rows",
    "select eventid, individid, evtdate::varchar as evtdate from deaths where individid in "
    "(select individid from deaths group by individid having count(*) > 1)",
)
def duplicates_rows(spark, folder):
    rows = ST.duplicated_rows(view(spark, folder, "deaths"), "individid")
    return rows.select("eventid", "individid", F.col("evtdate").cast("string").alias("evtdate"))


@query(
    "duplicates_by_id",
    " union all ".join(
        f"select '{c}' as column_name, cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as bigint) as n from "
        f"(select count(*) as k from presences where {c} is not null group by {c}) q"
        for c in ("eventid", "individid", "menageid")
    ),
)
def duplicates_by_id(spark, folder):
    return ST.duplicate_counts(view(spark, folder, "presences")).withColumnRenamed("column", "column_name")


@query(
    "duplicates_everywhere",
    " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as bigint) as n "
        f"from (select count(*) as k from {v} where {c} is not null group by {c}) q"
        for t, v, c in (
            ("FNewDeath", "deaths", "eventid"),
            ("FNewDeath", "deaths", "individid"),
            ("FNewSante", "health", "respondid"),
            ("FNewSante", "health", "socialgpid"),
        )
    ),
)
def duplicates_everywhere(spark, folder):
    report = ST.duplicates_everywhere(survey(spark, folder, "FNewDeath", "FNewSante"))
    return report.withColumnsRenamed({"table": "table_name", "column": "column_name"})


BAD_DATE = "({c} is null or {c} > date '2005-01-01' or {c} < date '1900-01-01')"


@query(
    "implausible_dates",
    f"select individid, birth_date::varchar as birth_date from individuals where {BAD_DATE.format(c='birth_date')}",
)
def implausible_dates(spark, folder):
    """Birth dates written day first, as the paper forms have them."""
    persons = view(spark, folder, "individuals")
    written = persons.withColumn("written", F.date_format("birth_date", "dd/MM/yyyy"))
    rows = ST.implausible_dates(written, "written", AS_OF)
    return rows.select("individid", F.col("birth_date").cast("string").alias("birth_date"))


@query(
    "date_columns_detected",
    """
    select 'arrive_text' as column_name, true as is_date, count(*) as n_rows from presences
    union all select 'field_wrkr', false, count(*) from presences
    union all select 'entry_date', true, count(*) from presences
    """,
)
def date_columns_detected(spark, folder):
    """Which columns hold dates, judged on the whole table, next to its row count."""
    presences = view(spark, folder, "presences").withColumn("arrive_text", F.date_format("arrive_date", "d/M/yyyy"))
    wanted = ["arrive_text", "field_wrkr", "entry_date"]
    dates = R.date_columns(presences.select(*wanted))
    flags = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in dates).alias("is_date")) for c in wanted])
    counted = presences.agg(F.count("*").alias("n_rows"))
    return counted.select(F.explode(flags).alias("f"), "n_rows").select("f.*", "n_rows")


@query(
    "coherence_report",
    "select 'rows' as kind, cast(null as varchar) as column_name, cast(count(*) as double) as value from individuals"
    + "".join(
        f" union all select 'implausible_dates', '{c}', cast(count(*) filter (where {BAD_DATE.format(c=c)}) as double) from individuals"
        for c in ("birth_date", "entry_date")
    )
    + "".join(
        f" union all select 'duplicates', '{c}', cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as double) "
        f"from (select count(*) as k from individuals where {c} is not null group by {c}) q"
        for c in ("individid", "socialgpid", "fatherid", "motherid")
    )
    + " union all select 'missing_rate', column_name, r from ("
    + " union all ".join(
        f"select '{c}' as column_name, round_even(avg(case when {c} is null then 1.0 else 0.0 end), 3) as r from individuals"
        for c in PERSON_COLUMNS
    )
    + ") q where r > 0",
)
def coherence_report(spark, folder):
    return ST.coherence_report(view(spark, folder, "individuals"), AS_OF).withColumnRenamed("column", "column_name")


@query(
    "coherence_everywhere",
    "\nunion all\n".join(
        f"select '{t}' as table_name, 'rows' as kind, cast(count(*) as double) as value from {v}"
        for t, v in (("FNewEducation", "education"), ("FNewMigration_Out", "migration_out"))
    )
    + """
    union all select 'FNewMigration_Out', 'implausible_dates', cast(count(*) filter (where """
    + BAD_DATE.format(c="depart_date")
    + """) as double) from migration_out
    union all select 'FNewEducation', 'duplicates', cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as double)
      from (select count(*) as k from education group by individid union all select count(*) from education group by socialgpid) q
    union all select 'FNewMigration_Out', 'duplicates', cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as double)
      from (select count(*) as k from migration_out group by individid) q
    """
    + "".join(
        f" union all select '{t}', 'missing_rate', round(sum(r), 6) from ("
        + " union all ".join(f"select round_even(avg(case when {c} is null then 1.0 else 0.0 end), 3) as r from {v}" for c in columns)
        + ") q where r > 0 having count(*) > 0"
        for t, v, columns in (
            ("FNewEducation", "education", ("individid", "socialgpid", "education_level")),
            ("FNewMigration_Out", "migration_out", ("individid", "depart_date")),
        )
    ),
)
def coherence_everywhere(spark, folder):
    report = ST.coherence_everywhere(survey(spark, folder, "FNewEducation", "FNewMigration_Out"), AS_OF)
    return report.groupBy(F.col("table").alias("table_name"), "kind").agg(F.round(F.sum("value"), 6).alias("value"))


@query("table_summary", """
    select cast(1 as integer) as position, 'orders' as table_name, count(*) as n_rows, cast(6 as bigint) as n_columns,
      'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' as columns from orders
    union all select 2, 'customer', count(*), 4, 'c_custkey, c_nationkey, c_acctbal, c_mktsegment' from customer
    """)
def table_summary(spark, folder):
    """Person-name columns are gone before anything is summarised."""
    tables = TableSet({n: base_table(spark, folder, n) for n in ("orders", "customer")})
    return tables.summary().withColumnRenamed("table", "table_name")


@query("person_names_dropped", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def person_names_dropped(spark, folder):
    return R.drop_person_names(base_table(spark, folder, "customer"))


# ---------------------------------------------------------------------- specs


def spec(operation, target=None, *filters):
    return {
        "operation": operation,
        "colonne_cible": target,
        "filtres": [{"colonne": c, "operateur": o, "valeur": v} for c, o, v in filters],
    }


def run(df, raw, order_by=()):
    return Q.run_spec(df, Q.parse_spec(raw, df.columns), order_by)


@query(
    "spec_count",
    "select count(*) as n from orders where lower(trim(o_orderstatus)) = 'f' and o_totalprice > 150000.5 and o_custkey <= 700",
)
def spec_count(spark, folder):
    raw = spec("compter", None, ("O_ORDERSTATUS", "==", " f "), ("o_totalprice", ">", "150000,5"), ("o_custkey", "<=", 700), ("nowhere", "==", 1))
    return run(base_table(spark, folder, "orders"), raw)


@query("spec_equal_integer", "select count(*) as n from orders where o_custkey = 7")
def spec_equal_integer(spark, folder):
    return run(base_table(spark, folder, "orders"), spec("compter", None, ("o_custkey", "==", "7")))


@query(
    "spec_list",
    """
    select o_orderkey, o_custkey, o_totalprice, count(*) over () as n_total from orders
    where o_orderpriority = '1-URGENT' and o_totalprice >= 100000 and o_totalprice < 300000 order by o_orderkey limit 50
    """,
)
def spec_list(spark, folder):
    raw = spec("lister", None, ("o_orderpriority", "==", "1-urgent"), ("o_totalprice", ">=", 100000), ("o_totalprice", "<", 300000))
    return run(base_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), raw, ["o_orderkey"]).drop("o_orderpriority")


@query(
    "spec_mean_sum_min_max",
    """
    with q as (select c_acctbal from customer where c_mktsegment = 'BUILDING')
    select 'moyenne' as operation, round(avg(c_acctbal), 6) as result, count(c_acctbal) as n_values from q
    union all select 'somme', round(sum(c_acctbal), 6), count(c_acctbal) from q
    union all select 'min', min(c_acctbal), count(c_acctbal) from q
    union all select 'max', max(c_acctbal), count(c_acctbal) from q
    """,
)
def spec_mean_sum_min_max(spark, folder):
    customers = base_table(spark, folder, "customer")
    answers = [
        run(customers, spec(op, "c_acctbal", ("c_mktsegment", "==", "building"))).select(
            F.lit(op).alias("operation"), F.round("result", 6).alias("result"), "n_values"
        )
        for op in Q.AGGREGATES
    ]
    return ST.union_all(answers)


@query("spec_no_usable_value", "select cast(null as double) as result, cast(0 as bigint) as n_values from customer limit 1")
def spec_no_usable_value(spark, folder):
    return run(base_table(spark, folder, "customer"), spec("moyenne", "c_mktsegment"))


@query("spec_not_equal_null", "select count(*) as n from presences where sleep_lastnight is null or lower(trim(sleep_lastnight)) <> 'oui'")
def spec_not_equal_null(spark, folder):
    return run(view(spark, folder, "presences"), spec("compter", None, ("sleep_lastnight", "!=", "OUI")))


@query("spec_contains", "select count(*) as n from part where contains(lower(p_type), 'nom') and p_size >= 10")
def spec_contains(spark, folder):
    raw = spec("compter", None, ("p_type", "contient", "NOM"), ("p_size", ">=", "10"))
    return run(base_table(spark, folder, "part"), raw)


@query(
    "spec_fanout",
    """
    select 'FNewPresences' as table_name, avg(individid) as result, count(individid) as n_values from presences where field_wrkr = 'A3'
    union all select 'FNewDeath', avg(individid), count(individid) from deaths where field_wrkr = 'A3'
    """,
)
def spec_fanout(spark, folder):
    tables = survey(spark, folder, "FNewPresences", "FNewDeath", "FNewEducation")
    report = Q.run_spec_everywhere(tables, spec("moyenne", "individid", ("field_wrkr", "==", "a3")))
    return report.withColumnRenamed("table", "table_name")


# ---------------------------------------------------------------------- SQL

THREE_WAY = """
select n.n_regionkey, o.o_orderstatus, count(*) as n, round(sum(o.o_totalprice), 2) as total
from customer c join orders o on o.o_custkey = c.c_custkey join nation n on n.n_nationkey = c.c_nationkey
group by n.n_regionkey, o.o_orderstatus
"""
WINDOW = """
select o_custkey, o_orderkey, rn, price_before from (
  select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn,
    lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as price_before
  from orders) q where rn = 2 order by o_custkey
"""
GROUPING = """
select l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) as level,
  count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ()) having count(*) > 1
"""
SET_OPS = """
select c_custkey as person from customer where c_acctbal > 9000 union select o_custkey from orders where o_totalprice > 480000
intersect select c_custkey from customer where c_nationkey < 12 except select o_custkey from orders where o_orderstatus = 'P' order by person
"""
NESTED = """
with big as (select "o_custkey", count(*) as n from orders group by "o_custkey" having count(*) >= 15)
select c.c_custkey, c.c_mktsegment, b.n, case when b.n > 18 then 'many' else 'some' end as band
from customer c left join big b on b.o_custkey = c.c_custkey
where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice between 400000 and 500000)
  and c.c_mktsegment like 'B%' and c.c_nationkey in (1, 2, 3) and b.n is not null
order by c.c_custkey
"""
SCALARS = """
select o_orderpriority, upper(substring(o_orderpriority, 3, 3)) as part, sum(abs(floor(o_totalprice) - ceil(o_totalprice))) as gap,
  min(extract(year from o_orderdate)) as first_year, max(length(trim(o_orderstatus))) as len, count(distinct o_custkey) as people
from orders group by o_orderpriority order by o_orderpriority
"""


def _sql(spark, folder, names, text):
    return Q.run_sql(spark, TableSet({n: base_table(spark, folder, n) for n in names}), text, cap=None)


@query("sql_three_way_join", THREE_WAY)
def sql_three_way_join(spark, folder):
    return _sql(spark, folder, ("customer", "orders", "nation"), THREE_WAY)


@query("sql_window", WINDOW.replace("as rn,", "::integer as rn,"))
def sql_window(spark, folder):
    return _sql(spark, folder, ("orders",), WINDOW)


@query("sql_grouping_sets", GROUPING.replace("grouping(l_returnflag) + grouping(l_linestatus)", "(grouping(l_returnflag) + grouping(l_linestatus))::integer"))
def sql_grouping_sets(spark, folder):
    return _sql(spark, folder, ("lineitem",), GROUPING).withColumn("level", F.col("level").cast("int"))


@query("sql_set_ops", SET_OPS)
def sql_set_ops(spark, folder):
    return _sql(spark, folder, ("customer", "orders"), SET_OPS)


@query("sql_subqueries", NESTED)
def sql_subqueries(spark, folder):
    return _sql(spark, folder, ("customer", "orders"), NESTED)


@query("sql_scalar_functions", SCALARS.replace("sum(abs(", "cast(sum(abs(").replace("as gap", "as bigint) as gap").replace("min(extract(year from o_orderdate))", "min(extract(year from o_orderdate))::integer").replace("max(length(trim(o_orderstatus)))", "max(length(trim(o_orderstatus)))::integer"))
def sql_scalar_functions(spark, folder):
    return _sql(spark, folder, ("orders",), SCALARS)


OUTER = """
select coalesce(n.n_nationkey, -1) as nation, coalesce(s.s_suppkey, -1) as supplier, count(o.o_orderkey) as n
from (select * from supplier where s_nationkey < 20) s full join (select * from nation where n_nationkey > 3) n on n.n_nationkey = s.s_nationkey
right join customer c on c.c_nationkey = n.n_nationkey and c.c_acctbal > s.s_acctbal
left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice >= 100000
where not exists (select 1 from orders p where p.o_custkey = c.c_custkey and p.o_orderstatus = 'P')
group by coalesce(n.n_nationkey, -1), coalesce(s.s_suppkey, -1)
"""
FRAMES = """
select o_orderkey, lead(o_orderkey) over w as next_order, rank() over w as place, dense_rank() over w as dense_place,
  sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as of_three,
  count(*) over (partition by o_custkey order by o_orderdate range between unbounded preceding and current row) as so_far
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)
"""
ROLLUPS = """
select l_returnflag, l_linestatus, l_suppkey, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus, l_suppkey)
union all select l_returnflag, l_linestatus, -1, count(*) from lineitem group by cube (l_returnflag, l_linestatus)
"""
NESTED_VALUES = """
select o_orderkey, {size}({split}(o_orderpriority, '-')) as parts, {element} as first_part, {json} as status from orders
"""
SPARK_NESTED = NESTED_VALUES.format(
    size="size", split="split", element="element_at(split(o_orderpriority, '-'), 1)",
    json="get_json_object(to_json(named_struct('s', o_orderstatus)), '$.s')",
)
DUCK_NESTED = NESTED_VALUES.format(
    size="len", split="string_split", element="string_split(o_orderpriority, '-')[1]", json="json_extract_string(to_json({'s': o_orderstatus}), '$.s')"
).replace("as parts", "::integer as parts")


@query("sql_outer_joins", OUTER)
def sql_outer_joins(spark, folder):
    return _sql(spark, folder, ("supplier", "nation", "customer", "orders"), OUTER)


@query("sql_frames", FRAMES.replace(" as place", "::integer as place").replace("dense_rank() over w as", "(dense_rank() over w)::integer as"))
def sql_frames(spark, folder):
    return _sql(spark, folder, ("orders",), FRAMES)


@query("sql_rollup_cube", ROLLUPS)
def sql_rollup_cube(spark, folder):
    return _sql(spark, folder, ("lineitem",), ROLLUPS)


@query("sql_arrays_json", DUCK_NESTED)
def sql_arrays_json(spark, folder):
    return _sql(spark, folder, ("orders",), SPARK_NESTED)


@query(
    "lookup_gaps",
    """
    select o_orderkey, coalesce(m.c_mktsegment, 'Non renseigné') as segment from orders o left join (
      select c_nationkey, min(case when c_custkey % 3 <> 0 then c_mktsegment end) as c_mktsegment from customer group by c_nationkey) m
      on m.c_nationkey = o.o_custkey % 30
    """,
)
def lookup_gaps(spark, folder):
    """A reference with several rows a key, a third of them without a value, and keys it lacks."""
    team = base_table(spark, folder, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment_of"))
    orders = base_table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 30).cast("int").alias("agent"))
    return J.lookup(orders, "agent", team, "c_nationkey", "segment_of", "segment").select("o_orderkey", "segment")


@query("spec_leading_zeros", "select count(*) filter (where o_custkey = 7) as seven, 0::bigint as zeros from orders")
def spec_leading_zeros(spark, folder):
    """Text is compared, not amounts: 007 is no customer."""
    orders = base_table(spark, folder, "orders")

    def counted(value):
        raw = {"operation": "compter", "filtres": [{"colonne": "o_custkey", "operateur": "==", "valeur": value}]}
        return Q.run_spec(orders, Q.parse_spec(raw, orders.columns))

    return counted("7").select(F.col("n").alias("seven"), counted("007").scalar().alias("zeros"))


SPELLINGS = {
    "%d/%m/%Y": "dd/MM/yyyy", "%Y/%m/%d": "yyyy/MM/dd", "%d.%m.%Y": "dd.MM.yyyy", "%Y%m%d": "yyyyMMdd", "%d/%m/%y": "dd/MM/yy",
    "%-d %B %Y": "d MMMM yyyy", "%d/%m/%Y %H:%M:%S.5": "dd/MM/yyyy HH:mm:ss'.5'", "%Y-%m-%d": "yyyy-MM-dd",
}


@query("date_spellings", "\nunion all\n".join(f"select '{d}' as spelling, cast(o_orderdate as date) as day, count(*) as n from orders group by 2" for d in SPELLINGS))
def date_spellings(spark, folder):
    """Every order date written in every spelling and read back."""
    days = base_table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("d"))
    written = [days.select(F.lit(name).alias("spelling"), F.date_format("d", how).alias("text")) for name, how in SPELLINGS.items()]
    read = ST.union_all(written).select("spelling", S.parse_moment(F.col("text")).cast("date").alias("day"))
    return read.groupBy("spelling", "day").agg(F.count("*").alias("n"))


GROWTH = "select a.individid from presences a join pregnancies b on a.individid = b.individid"


@query(
    "sql_join_growth",
    f"""
    select result_rows, largest_input, result_rows > largest_input as grew from (
      select (select count(*) from ({GROWTH}) q) as result_rows, (select count(*) from presences) as largest_input) r
    """,
)
def sql_join_growth(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("presences", "pregnancies")})
    return Q.join_growth(spark, tables, GROWTH)


# ---------------------------------------------------------------------- relations


@query(
    "relations_all_pairs",
    """
    with sizes as (
      select 'FNewIndividual' as t, count(*) as n from individuals union all select 'FNewPresences', count(*) from presences
      union all select 'FNewDeath', count(*) from deaths),
    pairs(table_a, table_b, column_name, documented, recommended) as (values
      ('FNewIndividual', 'FNewPresences', 'individid', true, true),
      ('FNewIndividual', 'FNewPresences', 'entry_date', false, false),
      ('FNewIndividual', 'FNewDeath', 'individid', true, true),
      ('FNewPresences', 'FNewDeath', 'eventid', true, true),
      ('FNewPresences', 'FNewDeath', 'individid', true, false),
      ('FNewPresences', 'FNewDeath', 'field_wrkr', false, false))
    select p.*, false as warning, a.n as rows_a, b.n as rows_b
    from pairs p join sizes a on a.t = p.table_a join sizes b on b.t = p.table_b
    """,
)
def relations_all_pairs(spark, folder):
    tables = survey(spark, folder, "FNewIndividual", "FNewPresences", "FNewDeath")
    return tables.relation_report().withColumnRenamed("column", "column_name")


@query(
    "relation_without_key",
    """
    select 'a' as table_a, 'b' as table_b, 'menageid' as column_name, false as documented, false as recommended,
      true as warning, (select count(*) from presences) as rows_a, (select count(distinct menageid) from presences) as rows_b
    """,
)
def relation_without_key(spark, folder):
    """Two tables sharing only an undocumented column: reported, never joined on."""
    homes = view(spark, folder, "presences").select("menageid")
    tables = TableSet({"a": homes, "b": homes.distinct()})
    return tables.relation_report("a", "b").withColumnRenamed("column", "column_name")


@query(
    "fusion",
    """
    select e.individid, e.socialgpid, e.education_level, d.eventid, d.field_wrkr, d.diedinhs
    from education e join deaths d on e.individid = d.individid
    """,
)
def fusion(spark, folder):
    fused = J.fuse(survey(spark, folder, "FNewEducation", "FNewDeath"), "FNewEducation", "FNewDeath")
    return fused.select("individid", "socialgpid", "education_level", "eventid", "field_wrkr", "diedinhs")


@query(
    "fusion_suffixes",
    """
    select b.individid, b.eventid as eventid_births, d.eventid as eventid_deaths, b.field_wrkr as field_wrkr_births,
      d.field_wrkr as field_wrkr_deaths
    from births b join deaths d on b.individid = d.individid
    """,
)
def fusion_suffixes(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("births", "deaths")})
    fused = J.fuse_and_publish(tables, "births", "deaths", "individid")
    return fused.select("individid", "eventid_births", "eventid_deaths", "field_wrkr_births", "field_wrkr_deaths")


@query(
    "difference",
    "select individid, socialgpid, education_level from education where individid not in (select individid from deaths)",
)
def difference(spark, folder):
    tables = survey(spark, folder, "FNewEducation", "FNewDeath")
    return J.difference_and_publish(tables, "FNewEducation", "FNewDeath")


@query(
    "difference_null_keys",
    """
    select fatherid, individid from individuals a where not exists
      (select 1 from individuals b where b.motherid is not distinct from a.fatherid)
    """,
)
def difference_null_keys(spark, folder):
    """A missing key on one side meets a missing key on the other, as in the difference of whole tables."""
    persons = view(spark, folder, "individuals")
    tables = TableSet({"a": persons.select("fatherid", "individid"), "b": persons.select(F.col("motherid").alias("fatherid"))})
    return J.difference(tables, "a", "b")


@query(
    "difference_both",
    """
    select 'education' as in_table, 'deaths' as not_in_table, count(*) as n from education where individid not in (select individid from deaths)
    union all
    select 'deaths', 'education', count(*) from deaths where individid not in (select individid from education)
    """,
)
def difference_both(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("education", "deaths")})
    return J.difference_counts(tables, "education", "deaths")


@query(
    "overlap",
    "select eventid, individid, field_wrkr from deaths where individid in (select individid from presences)",
)
def overlap(spark, folder):
    tables = TableSet({n: view(spark, folder, n) for n in ("deaths", "presences")})
    return J.overlap(tables, "deaths", "presences", "individid").select("eventid", "individid", "field_wrkr")


@query(
    "set_difference_counts",
    """
    with l as (select distinct individid from education), r as (select distinct individid from deaths)
    select (select count(*) from l where individid not in (select individid from r)) as left_only,
      (select count(*) from r where individid not in (select individid from l)) as right_only,
      (select count(*) from l where individid in (select individid from r)) as "both"
    """,
)
def set_difference_counts(spark, folder):
    sides = [(view(spark, folder, n), "individid") for n in ("education", "deaths")]
    return J.set_difference_counts(*sides)


@query(
    "set_difference_keys",
    """
    with l as (select distinct individid from education), r as (select distinct individid from deaths)
    select 'left' as side, cast(individid as varchar) as key from l where individid not in (select individid from r)
    union all select 'right', cast(individid as varchar) from r where individid not in (select individid from l)
    """,
)
def set_difference_keys(spark, folder):
    sides = [(view(spark, folder, n), "individid") for n in ("education", "deaths")]
    return J.set_difference(*sides, cap=None)


@query("set_intersection", "select individid as key from education intersect select individid from deaths")
def set_intersection(spark, folder):
    sides = [(view(spark, folder, n), "individid") for n in ("education", "deaths")]
    return J.distinct_keys_in_both(*sides)


@query(
    "lookup_default",
    """
    select p.eventid, p.field_wrkr, coalesce(t.controleur, 'Non renseigné') as controleur
    from presences p left join team t on t.field_wrkr = p.field_wrkr
    """,
)
def lookup_default(spark, folder):
    presences = view(spark, folder, "presences").select("eventid", "field_wrkr")
    return J.lookup(presences, "field_wrkr", view(spark, folder, "team"), "field_wrkr", "controleur", "controleur")


@query(
    "lookup_first_per_key",
    """
    with first_event as (select individid, min(eventid) as eventid from presences group by individid),
      found as (select p.individid, p.field_wrkr from presences p join first_event f on f.individid = p.individid and f.eventid = p.eventid)
    select e.individid, coalesce(f.field_wrkr, 'Non renseigné') as first_agent from education e left join found f on f.individid = e.individid
    """,
)
def lookup_first_per_key(spark, folder):
    education = view(spark, folder, "education").select("individid")
    presences = view(spark, folder, "presences")
    return J.lookup(education, "individid", presences, "individid", "field_wrkr", "first_agent", order=["eventid"])


@query(
    "text_keys_meet_numbers",
    "select e.individid, e.education_level from education e where individid in (select individid from deaths)",
)
def text_keys_meet_numbers(spark, folder):
    """Identifiers stored as decimals in one table and as integers in the other."""
    deaths = view(spark, folder, "deaths").select(F.col("individid").cast("double").alias("individid"))
    tables = TableSet({"education": view(spark, folder, "education"), "deaths": deaths})
    return J.overlap(tables, "education", "deaths").select("individid", "education_level")
