"""The query catalogue: a Spark plan and, where SQL can say the same, a DuckDB statement per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.operators import core, traverse
from plexigraph.plans import change_queries, graph_queries, report_queries, resolve_queries, rule_queries, source_queries  # noqa: F401  they register their queries
from plexigraph.plans.registry import QUERIES, SQL  # noqa: F401
from plexigraph.sources import tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop impact in both directions of the start parts, with fan-in and fan-out of what it reaches."""
    impact = traverse.bfs_both(tables.strong(spark, sf_dir), tables.starts(spark), 2)
    return impact.join(core.fan_in_out(tables.calls(spark, sf_dir)), "id").join(tables.parts(spark, sf_dir).select("id", F.col("name"), "module"), "id")
