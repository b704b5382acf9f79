"""Checks SQL from outside before it runs: one SELECT over one known relation, nothing else.

The text is parsed and bound by Spark against an empty view of the schema; the plan is
then read. It does not bound what a query costs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import QueryError

#: Plan nodes that a query over one in-memory relation may consist of.
ALLOWED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "SubqueryAlias", "View", "LogicalRDD", "LocalRelation", "Distinct", "Union", "Join",
    "Window", "Intersect", "Except", "WithCTE", "CTERelationDef", "CTERelationRef", "OneRowRelation", "UnresolvedWith", "Deduplicate", "Expand", "LateralJoin",
}
#: Functions that reach outside the query.
FORBIDDEN = ("java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user")


def _nodes(plan):
    yield plan.nodeName(), plan
    for part in (plan.children(), plan.innerChildren()):
        for i in range(part.size()):
            child = part.apply(i)
            if "logical" in child.getClass().getName():
                yield from _nodes(child)


def validate(spark: SparkSession, sql: str, schema: T.StructType, table: str = "records", parameters: dict | None = None, allow_explode: bool = False) -> T.StructType:
    """The result's schema, or a QueryError. An unknown plan node is refused."""
    lowered = f" {sql.lower()} "
    for name in FORBIDDEN:
        if f"{name}(" in lowered.replace(" (", "("):
            raise QueryError(f"{name} is not available")
    session = spark.newSession()
    session.createDataFrame([], schema).createOrReplaceTempView(table)
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        if not plan.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical") or plan.nodeName() in ("CreateView", "InsertIntoStatement", "ShowTables", "SetCatalogAndNamespace"):
            raise QueryError("only SELECT is allowed")
        if any(c in plan.getClass().getName() for c in ("Command", "Statement", "Create", "Drop", "Set")):
            raise QueryError("only SELECT is allowed")
        for name, node in _nodes(plan):
            if name == "UnresolvedRelation" and node.multipartIdentifier().mkString(".") != table and not _is_cte(plan, node.multipartIdentifier().mkString(".")):
                raise QueryError(f"unknown relation {node.multipartIdentifier().mkString('.')!r}")
            if name == "Generate" and not allow_explode:
                raise QueryError("rows may not be exploded here; use exists, transform or filter on the list")
        df: DataFrame = session.sql(sql, args=parameters or {})
        for name, _ in _nodes(df._jdf.queryExecution().analyzed()):
            if name == "Generate" and not allow_explode:
                raise QueryError("rows may not be exploded here; use exists, transform or filter on the list")
            if name not in ALLOWED and name != "Generate":
                raise QueryError(f"{name} is not allowed")
        return df.schema
    except (ParseException, AnalysisException) as error:
        raise QueryError(str(error).splitlines()[0]) from error
    finally:
        session.catalog.dropTempView(table)


def _is_cte(plan, name: str) -> bool:
    return plan.nodeName() == "UnresolvedWith" and any(plan.cteRelations().apply(i)._1() == name for i in range(plan.cteRelations().size()))
