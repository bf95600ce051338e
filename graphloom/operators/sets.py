"""Set operations on files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen_union(*sides: DataFrame) -> DataFrame:
    """Each path once with the first side that has it."""
    tagged = [s.select("rel_path", F.lit(k).alias("origin")) for k, s in enumerate(sides)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out.groupBy("rel_path").agg(F.min("origin").alias("origin"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2"""
    return a.join(b, "rel_path", "left_anti").distinct()


def in_scope(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3/J11"""
    return a.join(b, "rel_path", "left_semi").distinct()
