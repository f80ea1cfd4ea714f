"""Vector search in SQL: distance functions, filtered top-k statements, and what the plan makes of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Name and body of each function of two arrays of doubles.
FUNCTIONS = {
    "l2_sq": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    "inner_product": "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
}


def register(spark: SparkSession) -> None:
    """Make the distance functions known to this session's SQL.  Their bodies are inlined, so plans stay in the JVM."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")


def statement(table: str, query: list[float], k: int, condition: str | None = None, metric: str = "l2") -> str:
    """The k nearest rows of a table to one vector, ties by id; ``condition`` is SQL.  ``a <-> b`` of other systems is ``l2_sq(a, b)`` here."""
    vector = "array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")"
    name = {"l2": "l2_sq", "ip": "inner_product"}[metric]
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT vec_id, {name}(embedding, {vector}) AS dist FROM {table}{where} ORDER BY dist, vec_id LIMIT {int(k)}"


def operators(text: str) -> str:
    """``x <-> y`` of two columns or arrays as a call of ``l2_sq``."""
    term = r"((?:[A-Za-z_][\w.]*|array)(?:\([^()]*\))?)"
    return re.sub(rf"{term}\s*<->\s*{term}", r"l2_sq(\1, \2)", text)


@dataclass
class Plan:
    """A plan's text, and whether it keeps k rows a task, reads only wanted partitions, and filters in the scan."""

    text: str
    top_k: bool
    partition_filters: bool
    pushed_filters: list[str]


def explain(found: DataFrame) -> Plan:
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    return Plan(text, "TakeOrderedAndProject" in text, bool(re.search(r"PartitionFilters: \[[^\]]", text)), [x for one in pushed for x in one.split(", ") if x])
