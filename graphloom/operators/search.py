"""Identifier search (P10, T11) and report shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_identifiers(tags: DataFrame, query: str, max_results: int | None = 50, definitions: bool = True, references: bool = True) -> DataFrame:
    """Case-insensitive substring over tag names: definitions first, then earliest match, then
    path and line. max_results None means all."""
    kinds = [k for k, on in (("def", definitions), ("ref", references)) if on]
    q = query.lower()
    hit = tags.filter(F.col("kind").isin(*kinds) & F.contains(F.lower("name"), F.lit(q)))
    order = [(F.col("kind") != "def").cast("int"), F.instr(F.lower("name"), q), F.col("rel_path"), F.col("line"), F.col("name"), *([F.col("pos")] if "pos" in tags.columns else [])]
    hit = hit.orderBy(*order)
    return (hit.limit(max_results) if max_results and max_results > 0 else hit).select("rel_path", "line", "name", "kind")


def reason_histogram(reasons: DataFrame) -> DataFrame:
    """(code, n) over (rel_path, reasons)."""
    return reasons.select(F.explode("reasons").alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.count("*").alias("n"))


def shaped(files: DataFrame, limit: int = 20) -> DataFrame:
    """The best files as one row of JSON per rank; limit <= 0 means all."""
    best = files.orderBy(F.desc("rank"), "rel_path")
    best = best.limit(limit) if limit > 0 else best
    return best.select("rel_path", F.to_json(F.struct(*sorted(files.columns))).alias("payload"))
