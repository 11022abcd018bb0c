"""Read-only SQL over the registered tables.

A statement may run if all of this holds: it parses as it is and inside SELECT EXISTS (...);
no node of its plan, subqueries included, is a command, a statement or a script; it names
views by one name, never files, other catalogs or names made up at run time; and every
function in it is one of Spark's own, except those that run JVM code by name. The plan is
walked, not the text, so quotes, comments and letter case hide nothing. After analysis, and
before anything runs, the resolved plan is walked once more. `strict` also refuses any
text that holds a word that changes data, literals included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

ROW_CAP = 100
CHANGES = re.compile(r"\b(insert|update|delete|drop|alter|create|replace|truncate|attach|detach|pragma|vacuum)\b", re.I)
#: Functions of Spark's own that are refused: they call any method of any class.
REFLECTS = frozenset(("reflect", "java_method", "try_reflect"))
#: Nodes and expressions that are refused wherever they stand, by class.
REFUSED = {
    "ScriptTransformation": "scripts are not allowed",
    "PlanWithUnresolvedIdentifier": "tables have to be named as they are",
    "ExpressionWithUnresolvedIdentifier": "functions have to be named as they are",
    "CallMethodViaReflection": "functions that run JVM code are not allowed",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"


class Refused(ValueError):
    """The statement is not a query that may run."""


def _each(seq: object) -> Iterator[object]:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


@lru_cache(maxsize=4)
def _kinds(app: str, spark: SparkSession) -> dict[str, object]:
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    names = {"Command": f"{_LOGICAL}.Command", "ParsedStatement": f"{_LOGICAL}.ParsedStatement", "Plan": f"{_LOGICAL}.LogicalPlan", "Expression": f"{_EXPRESSIONS}.Expression", "Subquery": f"{_EXPRESSIONS}.PlanExpression"}
    return {k: loader.loadClass(v) for k, v in names.items()}


@lru_cache(maxsize=4)
def _known(app: str, spark: SparkSession) -> frozenset[str]:
    """Spark's own functions, table functions included."""
    of = spark._jvm.org.apache.spark.sql.catalyst.analysis
    return frozenset(f.funcName().lower() for r in (of.FunctionRegistry.builtin(), of.TableFunctionRegistry.builtin()) for f in _each(r.listFunction())) - REFLECTS


def _walk(spark: SparkSession, plan: object) -> Iterator[tuple[str, object]]:
    """(class name, node) of every node and expression of a plan, those of subqueries included."""
    kinds, todo = _kinds(spark.sparkContext.applicationId, spark), [plan]
    while todo:
        node = todo.pop()
        if kinds["Plan"].isInstance(node):
            groups = (node.children(), node.innerChildren(), node.expressions())
        elif kinds["Expression"].isInstance(node):
            groups = (node.children(),)
            if kinds["Subquery"].isInstance(node):
                todo.append(node.plan())
        else:
            continue
        yield node.getClass().getSimpleName(), node
        for group in groups:
            todo += _each(group)


def _refuse(spark: SparkSession, plan: object) -> None:
    """Raises Refused for a parsed or analysed plan that may not run."""
    app = spark.sparkContext.applicationId
    kinds, known = _kinds(app, spark), _known(app, spark)
    for name, node in _walk(spark, plan):
        if name in REFUSED:
            raise Refused(REFUSED[name])
        if kinds["Command"].isInstance(node) or kinds["ParsedStatement"].isInstance(node):
            raise Refused("only queries are allowed")
        if name == "UnresolvedRelation" and len(parts := list(_each(node.multipartIdentifier()))) > 1:
            raise Refused(f"{'.'.join(parts)} cannot be read: only registered views can")
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = [p.lower() for p in _each(node.nameParts() if name == "UnresolvedFunction" else node.name())]
            if len(parts) > 1 or parts[0] not in known:
                raise Refused(f"the function {'.'.join(parts)} is not allowed")


def check(spark: SparkSession, sql: str, strict: bool = False) -> None:
    if not isinstance(sql, str) or not sql.strip():
        raise Refused("a statement is needed")
    if strict and (m := CHANGES.search(sql)):
        raise Refused(f"{m[0]} is not allowed")
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(sql)
        parser.parsePlan(f"SELECT EXISTS (\n{sql.rstrip().rstrip(';')}\n)")
    except Exception as e:  # the parser's own exception class comes through py4j or as a PySpark one
        raise Refused(str(e).split("\n")[0]) from None
    _refuse(spark, plan)


def query(spark: SparkSession, sql: str, args: list | None = None, cap: int | None = ROW_CAP, strict: bool = False) -> DataFrame:
    """The rows of a read-only statement, `cap` at most."""
    check(spark, sql, strict)
    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    _refuse(spark, df._jdf.queryExecution().analyzed())
    return df.limit(cap) if cap else df


def answer(spark: SparkSession, sql: object) -> dict:
    """rows, or an error envelope; never raises."""
    if not isinstance(sql, str) or not sql.strip():
        return {"error": "bad_arguments"}
    try:
        return {"rows": [r.asDict(recursive=True) for r in query(spark, sql).collect()]}
    except Refused as e:
        return {"error": "read_only_refusal", "detail": str(e)}
    except PySparkException as e:
        return {"error": "sql_error", "detail": str(e).split("\n")[0]}
    except Exception as e:
        return {"error": "unexpected", "detail": str(e).split("\n")[0]}
