"""A guarded SQL console: read-only statements over named tables, judged on what Catalyst's own parser and analyzer make of them."""

from __future__ import annotations

import datetime
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .dialect import to_spark

#: The plan nodes that a statement may consist of.
READ_ONLY = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias",
    "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition", "Window",
}
#: Functions that call Java methods or read files by a name of the statement's.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "from_protobuf", "to_protobuf", "from_avro", "to_avro", "schema_of_avro"}
#: What the analyzer may have made of the tables; what is below a view is the table itself.
RESOLVED_LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef", "View"}
RESOLVED_FORBIDDEN = {"CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaAggregator", "HiveSimpleUDF", "HiveGenericUDF"}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
SECONDS = 300


class Rejected(ValueError):
    """The statement isn't a single read-only one over the tables given."""


class TimedOut(RuntimeError):
    """The statement took longer than it may."""


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan, tables: set[str], functions: set[str]) -> None:
    name = plan.getClass().getSimpleName()
    if name not in READ_ONLY:
        raise Rejected(f"{name} isn't allowed")
    if name == "UnresolvedWith":
        for definition in _items(plan.innerChildren()):  # each sees the names before it, and itself if it is recursive
            alias = definition.alias().lower()
            _walk(definition, tables | {alias} if plan.allowRecursion() else tables, functions)
            tables = tables | {alias}
    if name == "WithWindowDefinition":
        windows = plan.windowDefinitions().values().iterator()
        while windows.hasNext():
            _walk_expression(windows.next(), tables, functions)
    if name == "UnresolvedRelation" and [p.lower() for p in _items(plan.multipartIdentifier())] not in [[t] for t in tables]:
        raise Rejected(f"unknown table {plan.multipartIdentifier().mkString('.')}")
    for child in _items(plan.children()):
        _walk(child, tables, functions)
    for expression in _items(plan.expressions()):
        _walk_expression(expression, tables, functions)


def _walk_expression(e, tables: set[str], functions: set[str]) -> None:
    name = e.getClass().getSimpleName()
    if name == "ExpressionWithUnresolvedIdentifier":
        raise Rejected("IDENTIFIER isn't allowed")
    if name == "UnresolvedFunction" and (e.nameParts().size() != 1 or e.nameParts().apply(0).lower() not in functions):
        raise Rejected(f"function {e.nameParts().mkString('.')} isn't allowed")
    if name in SUBQUERIES:
        _walk(e.plan(), tables, functions)
    for child in _items(e.children()):
        _walk_expression(child, tables, functions)


def _named_functions(spark: SparkSession) -> set[str]:
    """The names of Spark's own functions, without the forbidden ones."""
    return {r.function.lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - FORBIDDEN


def check(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Raises Rejected, or Spark's ParseException for what isn't SQL."""
    _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), {t.lower() for t in tables}, _named_functions(spark))


def _check_resolved(plan, tables: set[str]) -> None:
    """Once more on what the statement has become: it reads nothing but the tables, and no function is a user's or calls one by name."""
    name = plan.getClass().getSimpleName()
    if name == "View":
        if plan.desc().identifier().table().lower() not in tables:
            raise Rejected("unknown table")
        return
    if plan.children().isEmpty() and name not in RESOLVED_LEAVES:
        raise Rejected(f"{name} isn't allowed")
    todo = _items(plan.expressions())
    while todo:
        e = todo.pop()
        kind = e.getClass().getSimpleName()
        if kind in RESOLVED_FORBIDDEN:
            raise Rejected("function isn't allowed")
        if kind in SUBQUERIES:
            _check_resolved(e.plan(), tables)
        todo += _items(e.children())
    for child in _items(plan.children()):
        _check_resolved(child, tables)


def console(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int | None = None, args: dict | list | None = None, dialect: str = "spark") -> DataFrame:
    """The rows of a read-only statement over the tables, which are temporary views by these names. ``args`` are the values of its
    parameters (``:name`` or ``?``); ``max_rows`` limits the report. With ``dialect`` duckdb its forms are rewritten as Spark's
    first; what has become of it is what is checked."""
    sql = to_spark(sql) if dialect == "duckdb" else sql
    check(spark, sql, set(tables))
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    out = spark.sql(sql, args=args)
    _check_resolved(out._jdf.queryExecution().analyzed(), {t.lower() for t in tables})
    return out if max_rows is None else out.limit(max_rows)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the jobs that the block starts in this thread once the seconds are over, and raises TimedOut; other threads' jobs go on."""
    if seconds is None:
        yield
        return
    context, tag, over, late = spark.sparkContext, f"console-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while not over.is_set():  # a statement may start one job after another
                context.cancelJobsWithTag(tag)
                over.wait(0.2)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"the statement took more than {seconds} seconds") from e
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)


@dataclass
class Result:
    """A report: columns with their types, cells as a JSON value each, and whether there were more rows than asked for."""

    columns: list[tuple[str, str]]
    rows: list[list]
    truncated: bool


def cell(x):
    """Numbers, booleans and texts as they are, times in ISO form, lists and structs by their parts, anything else as a text."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, dict):
        return {str(k): cell(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [cell(v) for v in x]
    return str(x)


def report(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int = 10_000, args: dict | list | None = None, seconds: float | None = SECONDS) -> Result:
    """The first ``max_rows`` rows of a statement, for a person to look at: one row more is asked for, which tells whether it goes on.
    A statement that runs longer than ``seconds`` (None: no limit) is cancelled and raises TimedOut."""
    out = console(spark, sql, tables, max_rows + 1, args)
    with time_limit(spark, seconds):
        rows = out.collect()
    return Result(out.dtypes, [[cell(x) for x in r] for r in rows[:max_rows]], len(rows) > max_rows)
