"""Filter-and-aggregate specs, and read-only SQL over the loaded tables."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.operators.sql_guard import InvalidSql, read_only
from hearthcheck.operators.stats import union_all
from hearthcheck.plans import patterns as P
from hearthcheck.plans.catalog import TableSet

# The operations and comparison operators a spec may use.
OPERATIONS = ("compter", "lister", "moyenne", "somme", "min", "max")
AGGREGATES = {"moyenne": F.avg, "somme": F.sum, "min": F.min, "max": F.max}
OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "contient")


class InvalidSpec(ValueError):
    """The spec names an unknown operation or column, or a filter without a value."""


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object

    def __str__(self) -> str:
        return f"{self.column} {self.operator} {self.value}"


@dataclass(frozen=True)
class Spec:
    operation: str
    target: str | None
    conditions: tuple[Condition, ...]

    @property
    def columns(self) -> list[str]:
        return [c.column for c in self.conditions] + ([self.target] if self.target else [])


def _literal_number(value: object) -> float | None:
    try:
        return float(str(value).strip().replace(",", "."))
    except ValueError:
        return None


def _compare(df: DataFrame, column: str, operator: str, number: float) -> Column:
    """An order test the file scan can take over: on an integer column the bound is made an integer."""
    cell = S.column(column)
    if S.integral(df, column) and math.isfinite(number) and abs(number) < 2**53:
        bound = F.lit(math.floor(number) if operator in (">", "<=") else math.ceil(number)).cast("bigint")
    else:
        cell, bound = S.numeric(df, column), F.lit(number)
    tests = {">": cell > bound, "<": cell < bound, ">=": cell >= bound, "<=": cell <= bound}
    return tests[operator]


def condition_column(df: DataFrame, condition: Condition) -> Column:
    """The row test of one condition, for a filter. Missing values pass no test but ``!=``."""
    cell, wanted = S.column(condition.column), str(condition.value).strip().lower()
    if condition.operator == "==":
        if S.integral(df, condition.column) and S.writes_integer(wanted):
            return cell == F.lit(int(wanted))
        return S.plain_text(cell) == wanted
    if condition.operator == "!=":
        return F.coalesce(S.plain_text(cell) != wanted, F.lit(True))
    if condition.operator == "contient":
        return F.contains(F.lower(cell.cast("string")), F.lit(str(condition.value).lower()))
    number = _literal_number(condition.value)
    return F.lit(False) if number is None else _compare(df, condition.column, condition.operator, number)


def usable_conditions(df: DataFrame, conditions: Sequence[Condition]) -> list[Condition]:
    """Conditions on columns and operators that exist; the others are ignored."""
    return [c for c in conditions if c.column in df.columns and c.operator in OPERATORS]


def filtered(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    usable = usable_conditions(df, conditions)
    return df.where(S.all_of([condition_column(df, c) for c in usable])) if usable else df


def parse_spec(raw: Mapping, columns: Sequence[str]) -> Spec:
    """Check a spec against the columns at hand, whatever the case of the names.

    Filters on unknown columns or operators are dropped. A valid filter without a value makes the
    whole spec invalid, since the count would then be of something else.
    """
    known = {c.lower(): c for c in columns}

    def named(name: object) -> str | None:
        return known.get(str(name or "").lower())

    entries = [e for e in raw.get("filtres") or [] if isinstance(e, Mapping)]
    found = [Condition(named(e.get("colonne")), e.get("operateur"), e.get("valeur")) for e in entries]
    usable = tuple(c for c in found if c.column is not None and c.operator in OPERATORS)
    spec = Spec(str(raw.get("operation", "")).strip().lower(), named(raw.get("colonne_cible")), usable)
    broken = {
        f"Unknown operation: {spec.operation!r}": spec.operation not in OPERATIONS,
        f"{spec.operation} needs a known target column": spec.operation in AGGREGATES and spec.target is None,
        **{f"No value to compare {c.column} with": not str("" if c.value is None else c.value).strip() for c in usable},
    }
    if problem := next((text for text, holds in broken.items() if holds), None):
        raise InvalidSpec(problem)
    return spec


def run_spec(
    df: DataFrame, spec: Spec, order_by: Sequence[str] = (), cap: int | None = P.LIST_CAP
) -> DataFrame:
    """The answer to one spec.

    ``compter`` gives ``n``; ``lister`` the first ``cap`` rows (in ``order_by``, else by all columns;
    None lists all) with ``n_total``; the others ``result`` and ``n_values``, with a null result when
    no value is usable.
    """
    if spec.operation not in OPERATIONS:
        raise InvalidSpec(f"Unknown operation: {spec.operation!r}")
    rows = filtered(df, spec.conditions)
    if spec.operation == "compter":
        return rows.agg(F.count(F.lit(1)).alias("n"))
    if spec.operation == "lister":
        total = rows.agg(F.count(F.lit(1)).alias("t")).scalar()
        if cap is None:
            return rows.withColumn("n_total", total)
        return rows.orderBy(*[S.column(c) for c in order_by or df.columns]).limit(cap).withColumn("n_total", total)
    if spec.target not in df.columns:
        raise InvalidSpec(f"No such target column: {spec.target}")
    value = S.numeric(df, spec.target)
    return rows.agg(AGGREGATES[spec.operation](value).alias("result"), F.count(value).alias("n_values"))


def applied_conditions(df: DataFrame, spec: Spec) -> list[str]:
    return [str(c) for c in usable_conditions(df, spec.conditions)]


def run_spec_everywhere(tables: TableSet, raw: Mapping) -> DataFrame:
    """The same count or aggregate on every table that has all the columns it needs."""
    spec = parse_spec(raw, tables.all_columns())
    if spec.operation == "lister":
        raise InvalidSpec("lister returns rows of one table")
    if not spec.columns:
        raise InvalidSpec("A spec over all tables must name a column")
    parts = []
    for name, df in tables.items():
        if not set(spec.columns) <= set(df.columns):
            continue
        answer = run_spec(df, spec)
        if spec.operation == "compter":
            answer = answer.select(F.col("n").cast("double").alias("result"), F.col("n").alias("n_values"))
        parts.append(answer.select(F.lit(name).alias("table"), "result", "n_values"))
    if not parts:
        raise InvalidSpec("No loaded table has all the columns of this spec")
    return union_all(parts)


# ---------------------------------------------------------------------- SQL


def statement_text(text: str | None) -> str:
    """A single statement that begins like a question, final semicolons removed."""
    statement = re.sub(r"[;\s]+\Z", "", text or "")
    if not re.match(r"\s*(SELECT|WITH)\b", statement, re.IGNORECASE):
        raise InvalidSql("A statement has to begin with SELECT or WITH")
    return statement


def tables_in_statement(tables: TableSet, statement: str) -> list[str]:
    """Loaded tables named as whole words in the statement."""
    return [n for n in tables if re.search(rf"\b{re.escape(n)}\b", statement, re.IGNORECASE)]


def plan_sql(spark: SparkSession, tables: TableSet, text: str) -> DataFrame:
    """The uncapped result of a checked statement. Double quotes enclose names, as in ANSI SQL."""
    return read_only(spark, tables, statement_text(text))


def run_sql(spark: SparkSession, tables: TableSet, text: str, cap: int | None = P.SQL_ROW_CAP) -> DataFrame:
    """The first ``cap`` rows (None: all) of a read-only statement over the loaded tables."""
    result = plan_sql(spark, tables, text)
    return result if cap is None else result.limit(cap)


def join_growth(spark: SparkSession, tables: TableSet, text: str) -> DataFrame:
    """Does a statement return more rows than its largest input? A sign of a join on a wrong key.

    The result is counted before any cap.
    """
    used = tables_in_statement(tables, text)
    if not used:
        raise InvalidSql("The statement names no loaded table")
    result = plan_sql(spark, tables, text).agg(F.count(F.lit(1)).alias("n"))
    largest = tables.only(*used).summary().agg(F.max("n_rows").alias("n")).scalar()
    return result.select(
        F.col("n").alias("result_rows"),
        largest.alias("largest_input"),
    ).withColumn("grew", F.col("result_rows") > F.col("largest_input"))
