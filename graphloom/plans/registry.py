"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.budget import pack

from . import queries_graph as graph
from . import queries_lanes as lanes
from . import queries_more as more
from . import queries_tree as tree

MODULES = (graph, lanes, tree, more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, capped edges, PageRank, scores and budget packing in one plan."""
    rows = graph.scored(spark, sf_dir).withColumn("cost", (F.col("definition_count") + F.col("reference_count")).cast("int"))
    return pack(rows, graph.BUDGET).select("rel_path", "rank", "included")
