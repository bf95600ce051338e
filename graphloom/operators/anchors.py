"""Where an action starts: snippets around boundary symbols, the choice among them, a place in the
file where there is none, and the texts of actions (L6-L9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.content import LINE_END
from graphloom.functions.paths import basename
from graphloom.plans.session import saved

SNIPPET = ("file", "start_line", "end_line", "highlight_line", "kind", "symbol", "excerpt")


def _parts(text: Column) -> Column:
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _excerpt(parts: Column, line: Column, context: int) -> tuple[Column, Column, Column, Column]:
    """(first, last and nearest existing line, numbered text) around a line."""
    at = F.least(F.greatest(line, F.lit(1)), F.size(parts))
    first, last = F.greatest(F.lit(1), at - context), F.least(F.size(parts), at + context)
    text = F.array_join(F.transform(F.sequence(first, last), lambda n: F.concat(n.cast("string"), F.lit(": "), F.element_at(parts, n))), "\n")
    return first, last, at, text


def boundary_snippets(locations: DataFrame, files: DataFrame, context: int = 1, show: int = 6) -> DataFrame:
    """The first `show` snippets of each target, numbered by `position`. locations: path (the
    target), k (order), rel_path, line, kind, name; files: rel_path, text."""
    one = saved(locations.groupBy("path", "rel_path", "line", "kind", "name").agg(F.min("k").alias("k")))
    # a file's text meets the lines to show once, whatever the number of targets that show them
    spots = one.groupBy("rel_path").agg(F.collect_set("line").alias("lines")).join(files.select("rel_path", "text"), "rel_path")
    lines = spots.select("rel_path", "lines", _parts(F.col("text")).alias("parts")).filter("size(parts) > 0").select("rel_path", F.explode("lines").alias("line"), "parts")
    start, end, _, text = _excerpt(F.col("parts"), F.col("line"), context)
    there = one.join(lines.select("rel_path", "line", start.alias("start_line"), end.alias("end_line"), text.alias("excerpt")), ["rel_path", "line"])
    order = Window.partitionBy("path").orderBy("k", "rel_path", "line", "kind", "name")
    out = there.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= show)
    return out.select("path", "position", F.col("rel_path").alias("file"), "start_line", "end_line", F.col("line").alias("highlight_line"), "kind", F.col("name").alias("symbol"), "excerpt")


def target_anchors(targets: DataFrame, snippets: DataFrame, prefer_target_file: bool = True) -> DataFrame:
    """Each target's best snippet, in its own file if asked, else none. A changed symbol (where
    prefer_changed) is worth 4, the target's file 2, a focus line 1; ties go to the earlier one.
    targets: path, changed, focus_lines, prefer_changed."""
    j = snippets.join(targets, "path")
    own = F.col("file") == F.col("path")
    has = lambda a, x: F.coalesce(F.array_contains(a, F.col(x)), F.lit(False))
    score = F.when(F.col("prefer_changed") & has("changed", "symbol"), 4).otherwise(0) + F.when(has("focus_lines", "highlight_line"), 1).otherwise(0)
    score = score + F.when(own, 2).otherwise(0) if prefer_target_file else score
    best = j.groupBy("path").agg(F.max_by(F.struct(*SNIPPET), F.struct(score, -F.col("position"))).alias("anchor"), F.max(own).alias("own"))
    return (best.filter("own") if prefer_target_file else best).select("path", "anchor")


def file_anchors(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(path, anchor) at the first focus line, else at the first line. targets: path, focus_lines."""
    focus = F.coalesce(F.get("focus_lines", F.lit(0)), F.lit(1)).cast("int")
    j = targets.select("path", focus.alias("line")).join(files.select(F.col("rel_path").alias("path"), _parts(F.col("text")).alias("parts")), "path").filter("size(parts) > 0")
    start, end, at, text = _excerpt(F.col("parts"), F.col("line"), 1)
    return j.select("path", F.struct(F.col("path").alias("file"), start.alias("start_line"), end.alias("end_line"), at.alias("highlight_line"), F.lit("file").alias("kind"), basename(F.col("path")).alias("symbol"), text.alias("excerpt")).alias("anchor"))


def action_anchor(anchor: Column) -> Column:
    """An action's anchor as a place of one line; null without a file or line."""
    a = anchor
    there = (F.coalesce(a["file"], F.lit("")) != "") & (F.coalesce(a["highlight_line"], F.lit(0)) != 0)
    line = a["highlight_line"]
    symbol = F.coalesce(F.when(a["symbol"] != "", a["symbol"]), basename(a["file"]))
    kind = F.coalesce(F.when(a["kind"] != "", a["kind"]), F.lit("file"))
    return F.when(there, F.struct(a["file"].alias("file"), line.alias("start_line"), line.alias("end_line"), line.alias("highlight_line"), kind.alias("kind"), symbol.alias("symbol"), F.coalesce(a["excerpt"], F.lit("")).alias("excerpt")))


#: Risk, why now, what to find out, and what follows if it does or doesn't hold.
TEXTS = {
    "run_nearby_test": ("low", "Quickest check close to {seed}.", "Does the nearby test pass, or show what broke?", "Fails: go from the assertion to the boundary it names.", "Passes: take the next boundary or neighbour that isn't a test."),
    "open_changed_boundary": ("low", "Narrowest boundary that the changed symbol touches.", "Does the boundary still keep to the changed symbol?", "No: update its callers and nearby tests.", "Yes: take the next boundary on the path."),
    "open_direct_neighbor": ("low", "One hop away, so the least there is to read outside tests.", "Is the neighbour affected?", "Yes: widen along its boundary symbols and tests.", "No: leave this branch for the next action."),
    "check_config_assumption": ("medium", "A configuration that doesn't fit voids the rest of the trail.", "Does the configuration fit the changed path and test setup?", "No: look at entrypoints, setup documents and dependent tests.", "Yes: back to boundaries in the code."),
    "start_here": ("medium", "Nothing of less risk was found; best place with an anchor.", "Is there a first sign that the trail is real?", "Yes: turn to the closest boundary and its tests.", "No: go down the remaining suggestions in order."),
}
OTHER = ("low", "A place next to the current boundary.", "Does it change what to look at next?", "Yes: go on outward from here.", "No: step back to the next action.")
AT_HUNK = ("low", "Only {hunk} line(s) from the changed hunk.", "Does this symbol or call need a matching change?", "Yes: follow it to callers, tests and public interfaces.", "No: take the next closest file or configuration.")


def action_texts(kind: Column, hunk: Column, seed: Column) -> Column:
    """Struct of risk, why, outcome, follow_up_yes and follow_up_no."""
    names = ("risk", "why", "outcome", "follow_up_yes", "follow_up_no")
    row = lambda t: F.struct(*[F.replace(F.replace(F.lit(x), F.lit("{hunk}"), F.coalesce(hunk.cast("string"), F.lit(""))), F.lit("{seed}"), F.coalesce(F.when(seed != "", seed), F.lit("the seed file"))).alias(n) for n, x in zip(names, t, strict=True)])
    out = F.when((kind == "open_changed_boundary") & hunk.isNotNull(), row(AT_HUNK))
    for k, t in TEXTS.items():
        out = out.when(kind == k, row(t))
    return out.otherwise(row(OTHER))


def anchored(actions: DataFrame, targets: DataFrame, snippets: DataFrame, files: DataFrame) -> DataFrame:
    """actions with `anchor` and the texts. targets: path, hunk, changed, focus_lines; few rows."""
    t = actions.select(F.col("target").alias("path"), (F.col("kind") == "open_changed_boundary").alias("prefer_changed"), "kind").join(targets, "path")
    best = target_anchors(t.select("path", "prefer_changed", "changed", "focus_lines").groupBy("path").agg(F.max("prefer_changed").alias("prefer_changed"), F.first("changed").alias("changed"), F.first("focus_lines").alias("focus_lines")), snippets)
    fallback = file_anchors(targets.select("path", "focus_lines"), files).withColumnRenamed("anchor", "plain")
    j = actions.join(best.withColumnRenamed("path", "target"), "target", "left").join(fallback.withColumnRenamed("path", "target"), "target", "left").join(targets.select(F.col("path").alias("target"), "hunk"), "target", "left")
    text = action_texts(F.col("kind"), F.col("hunk"), F.col("seed"))
    return j.select(*actions.columns, action_anchor(F.coalesce("anchor", "plain")).alias("anchor"), text.alias("t")).select(*actions.columns, "anchor", "t.*")
