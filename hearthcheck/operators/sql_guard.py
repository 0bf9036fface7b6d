"""Which statements only read a set of tables, judged by the plan Spark itself makes of them.

A statement is analysed in a session of its own that knows the set's tables and nothing else: no views of the caller, no
functions registered elsewhere, no files as relations. The analysed plan is then walked, with all its subqueries. What
it reads must be one of the set's views or rows written in the statement, every step must be one that reads, and
every function one that stays inside the rows. Names play no part: a quoted word, a comment, an alias or a table
expression called like a foreign table changes nothing, since resolved relations and expression classes are judged.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Steps of a plan that read and nothing else.
READING_STEPS = frozenset({
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate",
    "Union", "Intersect", "Except", "Window", "Generate", "Expand", "SubqueryAlias", "Subquery", "WithCTE", "CTERelationDef", "LateralJoin",
    "Sample", "RepartitionByExpression", "Repartition", "RebalancePartitions", "ResolvedHint", "UnionLoop", "Pivot", "Unpivot",
})
# Leaves that hold no data but what the statement itself writes down.
OWN_LEAVES = frozenset({"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"})
# Expressions that run foreign code or look at files.
REACHING_OUT = frozenset({
    "CallMethodViaReflection", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "ScalaUDF", "PythonUDF", "PythonUDAF",
    "ApplyFunctionExpression", "SQLFunctionExpression", "SQLScalarFunction", "FromAvro", "ToAvro",
})
_STEPS = "org.apache.spark.sql.catalyst.plans.logical."
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
# What decides how a statement is read, taken over from the caller.
_CARRIED = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")


class InvalidSql(ValueError):
    """The statement is not a single read, or Spark refused it."""


def _each(sequence: JavaObject) -> Iterator[JavaObject]:
    walk = sequence.iterator()
    while walk.hasNext():
        yield walk.next()


def _class_name(thing: JavaObject) -> str:
    return thing.getClass().getName()


def _own_session(spark: SparkSession, tables: Mapping[str, DataFrame]) -> JavaObject:
    """A session whose only views are the tables; double quotes enclose names, files are no relations."""
    own = spark.newSession()
    for name in _CARRIED:
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in tables.items():
        dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return own._jsparkSession


def _check_view(view: JavaObject, names: set[str]) -> None:
    found = view.desc().identifier()
    if not view.isTempView() or found.database().isDefined() or found.table().lower() not in names:
        raise InvalidSql(f"Not a loaded table: {found.unquotedString()}")


def _check_expressions(node: JavaObject) -> None:
    waiting = list(_each(node.expressions()))
    while waiting:
        expression = waiting.pop()
        name = _class_name(expression)
        if not name.startswith(_EXPRESSIONS) or name.rsplit(".", 1)[1] in REACHING_OUT:
            raise InvalidSql(f"Function not allowed: {expression.prettyName()}")
        waiting.extend(_each(expression.children()))


def check_plan(plan: JavaObject, names: set[str]) -> None:
    """Refuse an analysed plan that does more than read the views of these (lower-case) names."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = _class_name(node)
        step = name.removeprefix(_STEPS)
        if step == "View":
            _check_view(node, names)
            continue
        if step not in READING_STEPS | OWN_LEAVES:
            if node.children().isEmpty():
                raise InvalidSql(f"Not a loaded table: {node.nodeName()}")
            raise InvalidSql(f"The statement does more than read: {node.nodeName()}")
        _check_expressions(node)
        waiting.extend(_each(node.children()))
        waiting.extend(_each(node.subqueries()))


@contextmanager
def _active(spark: SparkSession, session: JavaObject) -> Iterator[None]:
    """Parser and analyser take their settings from the active session."""
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    sessions.setActiveSession(session)
    try:
        yield
    finally:
        sessions.setActiveSession(spark._jsparkSession)


def read_only(spark: SparkSession, tables: Mapping[str, DataFrame], statement: str) -> DataFrame:
    """The rows of a statement over the tables, or InvalidSql. The plan that was checked is the plan that runs."""
    try:
        own = _own_session(spark, tables)
        with _active(spark, own):
            parsed = own.sessionState().sqlParser().parsePlan(statement)
            planned = own.sessionState().executePlan(parsed, spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP())
            planned.assertAnalyzed()
            plan = planned.analyzed()
            check_plan(plan, {name.lower() for name in tables})
        return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    except (PySparkException, Py4JError) as problem:
        raise InvalidSql(f"SQL error: {problem}") from problem
