"""Command line: python -m graphloom.cli [paths] --root DIR [mode and options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.plans import reports
from graphloom.plans.engine import CodeGraph
from graphloom.sources.git import changed_lines


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    option = lambda name, **how: p.add_argument(f"--{name}", **how)
    p.add_argument("paths", help="files and folders below root; all if none", nargs="*")
    option("root", default=".")
    option("map-tokens", help="a number, small, medium, large, xlarge, auto or ai_guided", default="8192")
    for name in ("chat-files", "mentioned-files", "mentioned-idents", "impact-from"):
        option(name, default=[], nargs="*")
    for name in ("search", "trace-from", "trace-to", "base-ref"):
        option(name)
    for name, value in {"max-context-window": None, "trace-max-hops": 6, "impact-max-depth": 2, "impact-max-results": 10, "changed-neighbors": 0}.items():
        option(name, default=value, type=int)
    for name in ("impact-changed", "review", "edit-plan", "changed", "exclude-unranked"):
        option(name, action="store_true")
    option("query", default="")
    option("output-format", default="text", choices=("json", "text"))
    a = p.parse_args(argv)
    modes = [bool(a.trace_from or a.trace_to), bool(a.impact_from), a.impact_changed, a.review, bool(a.search)]
    if sum(modes) > 1:
        p.error("only one of trace, impact, review and search at a time")
    if bool(a.trace_from) != bool(a.trace_to):
        p.error("--trace-from and --trace-to go together")
    if a.edit_plan and not (a.impact_from or a.impact_changed):
        p.error("--edit-plan needs an impact mode")
    return a


def run(spark: SparkSession, a: argparse.Namespace) -> str:
    g = CodeGraph.from_tree(spark, a.root, a.paths or None)
    as_json = a.output_format == "json"
    lines = changed_lines(spark, a.root, a.base_ref) if a.changed or a.impact_changed or a.review else None
    if a.search:
        found = reports.rows(g.search(a.search))
        return reports.as_json(found) if as_json else "\n".join(f"{r['rel_path']}:{r['line']} {r['kind']} {r['name']}" for r in found)
    if a.trace_from:
        found = g.trace(a.trace_from, a.trace_to, a.trace_max_hops)
        return reports.as_json(found) if as_json else reports.trace_text(found)
    if a.review:
        found = reports.collected(g.review(lines, a.impact_max_depth, a.impact_max_results))
        return reports.as_json(found) if as_json else reports.review_text(found)
    if a.impact_from or a.impact_changed:
        seeds = a.impact_from or [r[0] for r in lines.select("rel_path").distinct().join(g.files.select("rel_path"), "rel_path", "left_semi").orderBy(F.col("rel_path")).collect()]
        found = reports.collected(g.impact(seeds, lines, a.impact_max_depth, a.impact_max_results))
        return reports.as_json(found) if as_json else (reports.plan_text if a.edit_plan else reports.impact_text)(found)
    changed = [r[0] for r in lines.select("rel_path").distinct().collect()] if lines is not None else []
    text, chosen = g.map(a.map_tokens, a.chat_files, a.max_context_window, mentioned=a.mentioned_files, identifiers=a.mentioned_idents, query=a.query, changed=changed, neighbors=a.changed_neighbors, exclude_unranked=a.exclude_unranked)
    return reports.as_json({"map": text, "ranked_files": reports.rows(chosen), "excluded": reports.rows(g.excluded)}) if as_json else text


def main() -> None:
    a = arguments()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        print(run(spark, a))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
