"""The free query: any SQL over registered views that only reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(ValueError):
    """The statement does more than read."""


def read_only(spark: SparkSession, statement: str, limit: int | None = 200) -> DataFrame:
    """The statement's rows, at most limit of them (None: all).

    The check looks at the parsed plan, not at the text: a command anywhere in
    it (DDL, inserts, settings, cache, resources) is refused before it runs.
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    plan = parser.parsePlan(statement)
    loader = plan.getClass().getClassLoader()
    refused = [loader.loadClass(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in ("Command", "ParsedStatement")]
    queue = [plan]
    while queue:
        node = queue.pop()
        if any(c.isInstance(node) for c in refused):
            raise NotReadOnly(f"{node.nodeName()} is not a query")
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    out = spark.sql(statement)
    return out.limit(limit) if limit is not None else out
