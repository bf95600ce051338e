"""Follow-up lanes over impact rows.

Anchors and texts of actions (L6-L9) are in anchors.py; edit_candidates names the target file.

Impact rows: path, seed, distance, path_length, is_test, is_api, is_entry, is_important,
summary_kind, hunk (distance to the closest changed hunk), n_changed, boundary and changed
(symbols). Rules are struct arrays that are exploded, never a pass per rule. Where the original
keeps the first of equal keys, impact order decides (T5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import is_integration_test
from graphloom.functions.scores import action_confidence

from .related import test_pairs

ROLES = {k: n for n, k in enumerate("boundary public_api entrypoint config test neighbor".split())}
REVIEW_ROLES = {k: n for n, k in enumerate("public_api entrypoint config test boundary neighbor".split())}
CLUSTERS = {k: n for n, k in enumerate("sibling nearby integration".split())}


def _rank(c: Column, order: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in order.items()], F.lit(9))


def impact_order() -> list[Column]:
    """T5"""
    kinds = 3 * F.col("is_test").cast("int") + 2 * F.col("is_api").cast("int") + 2 * F.col("is_entry").cast("int") + F.col("is_important").cast("int") + F.col("summary_kind").isNotNull().cast("int")
    return [F.col("n_changed") == 0, F.coalesce("hunk", F.lit(999)), -F.col("n_changed"), F.col("distance"), -kinds, F.col("path")]


def top_impact(rows: DataFrame, max_results: int) -> DataFrame:
    """T5: the first rows in impact order, numbered by `position`. All lanes work on this cut."""
    cut = rows.orderBy(*impact_order()).limit(max_results)
    return cut.withColumn("position", F.row_number().over(Window.orderBy(*impact_order())))  # max_results rows


def suggestions(impact: DataFrame, show: int = 8) -> DataFrame:
    """(priority, kind, target, seed, path_length)."""
    def rule(cond: Column, priority, kind: str) -> Column:
        return F.when(cond, F.struct(F.lit(priority).alias("priority") if isinstance(priority, int) else priority.alias("priority"), F.lit(kind).alias("kind")))

    rules = F.array_compact(
        F.array(
            rule(F.col("is_test"), 0, "review_test"),
            rule(F.col("is_api"), 1, "review_public_api"),
            rule(F.col("is_entry"), 1, "verify_entrypoint"),
            rule(F.col("summary_kind") == "config", 2, "review_config"),
            rule(F.col("summary_kind") == "doc", 3, "read_doc"),
            rule((F.col("distance") == 1) & ~F.col("is_test"), 2, "inspect_neighbor"),
            rule(F.size("boundary") > 0, 2, "follow_symbols"),
            rule(F.size("changed") > 0, F.when(F.col("hunk") == 0, 0).otherwise(1), "review_changed_symbol_boundary"),
        )
    )
    fallback = F.when((F.size(rules) == 0) & (F.col("position") == 1), F.array(F.struct(F.lit(2).alias("priority"), F.lit("inspect_neighbor").alias("kind")))).otherwise(rules)
    all_rules = impact.select("position", "path", "seed", "path_length", F.explode(fallback).alias("r")).select("position", F.col("r.priority").alias("priority"), F.col("r.kind").alias("kind"), F.col("path").alias("target"), "seed", "path_length")
    first = Window.partitionBy("kind", "target").orderBy("position")
    return all_rules.withColumn("k", F.row_number().over(first)).filter("k = 1").orderBy("priority", "path_length", "target", "kind").limit(show).select("priority", "kind", "target", "seed", "path_length")


def target_role(kind: Column, t: str = "") -> Column:
    """L4"""
    c = lambda x: F.coalesce(F.col(t + x), F.lit(False))
    default = F.when(kind == "run_nearby_test", "test").when(kind == "check_config_assumption", "config").when(kind == "open_direct_neighbor", "neighbor").otherwise("boundary")
    return F.when(c("is_test"), "test").when(F.col(t + "summary_kind") == "config", "config").when(c("is_api"), "public_api").when(c("is_entry"), "entrypoint").otherwise(default)


def quick_actions(impact: DataFrame, suggested: DataFrame, show: int = 6) -> DataFrame:
    """(priority, kind, target, target_role, confidence, focus_symbols, ...)."""
    j = suggested.join(impact.drop("seed", "path_length"), F.col("target") == F.col("path"), "left")
    kind = (
        F.when(F.col("kind") == "review_changed_symbol_boundary", "open_changed_boundary")
        .when(F.col("kind") == "review_test", "run_nearby_test")
        .when(F.col("kind") == "review_config", "check_config_assumption")
        .when((F.col("kind") == "inspect_neighbor") & (F.col("distance") == 1), "open_direct_neighbor")
    )
    j = j.withColumn("action", kind).withColumn("first", F.row_number().over(Window.orderBy("priority", "path_length", "target", "kind"))).withColumn("some", F.max(F.col("action").isNotNull()).over(Window.partitionBy()))  # a few rows
    j = j.withColumn("action", F.when(~F.col("some") & (F.col("first") == 1), "start_here").otherwise(F.col("action"))).filter("action is not null")
    a = F.col("action")
    priority = F.when(a == "open_changed_boundary", 0).when(a == "run_nearby_test", F.when(F.col("distance") == 1, 0).otherwise(1)).when(a == "check_config_assumption", 1).when(a == "open_direct_neighbor", 2).otherwise(F.col("priority"))
    confidence = action_confidence(a, F.coalesce("distance", F.lit(1)), F.col("hunk"), F.coalesce("is_test", F.lit(False)), F.coalesce(F.col("summary_kind") == "config", F.lit(False)), F.coalesce("is_api", F.lit(False)), F.coalesce("is_entry", F.lit(False)))
    none = F.array().cast("array<string>")
    changed, boundary = F.coalesce("changed", none), F.coalesce("boundary", none)
    focus = F.when(a.isin("open_changed_boundary", "run_nearby_test"), F.when(F.size(changed) > 0, changed).otherwise(F.slice(boundary, 1, 1))).otherwise(boundary)
    out = j.select(priority.alias("priority"), a.alias("kind"), "target", target_role(a).alias("target_role"), confidence.alias("confidence"), F.slice(F.array_distinct(focus), 1, 3).alias("focus_symbols"), "seed", "path_length", F.col("changed").alias("changed_symbols"))
    first = Window.partitionBy("kind", "target").orderBy("priority", "seed")
    return out.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k").orderBy("priority", F.desc("confidence"), "path_length", "target", "kind").limit(show)


def candidate_reason(role: Column, symbol: Column, seed: Column, changed: Column) -> Column:
    """Why a place is likely to need an edit."""
    has = symbol.isNotNull()
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return (
        F.when(role == "test", say("Nearest test on the path from ", seed, "."))
        .when(role == "config", say("Configuration on the path from ", seed, "; a wrong value here voids deeper edits."))
        .when(role == "public_api", F.when(has, say("Contract of public symbol ", symbol, " may have to follow.")).otherwise(F.lit("Public surface whose contract may have to follow.")))
        .when(role == "entrypoint", F.when(has, say("Flow enters at ", symbol, "; changes show up here first.")).otherwise(F.lit("Flow enters here; changes show up first.")))
        .when(role == "neighbor", say("One hop from ", seed, "; quick to confirm or rule out."))
        .when(has, say("Shared symbol ", symbol, " is the clearest place to edit."))
        .when(F.size(changed) > 0, say("A change in ", seed, " reaches this file."))
        .otherwise(say("Closest boundary that ", seed, " reaches."))
    )


def edit_candidates(actions: DataFrame, show: int = 8) -> DataFrame:
    """L10/L11/T8, anchored at the target file: (path, target_role, priority, confidence, symbol, reason, ...)."""
    symbol = F.get("focus_symbols", F.lit(0))
    none = F.array().cast("array<string>")
    out = actions.select(F.col("target").alias("path"), "target_role", "priority", "confidence", symbol.alias("symbol"), candidate_reason(F.col("target_role"), symbol, F.col("seed"), F.coalesce("changed_symbols", none)).alias("reason"), "seed", "path_length", F.col("kind").alias("source_action"), _rank(F.col("target_role"), ROLES).alias("o"))
    first = Window.partitionBy("path", "symbol", "target_role").orderBy("priority", F.desc("confidence"), "source_action")
    out = out.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return out.orderBy("priority", F.desc("confidence"), "o", "path_length", "path", "symbol").limit(show).drop("k", "o")


def edit_plan(actions: DataFrame, candidates: DataFrame, steps: int = 4, each: int = 3) -> DataFrame:
    """The first actions with their candidates: (step, title, kind, target, candidates)."""
    order = Window.orderBy("priority", F.desc("confidence"), "path_length", "target", "kind")
    first = actions.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= steps)  # a few rows
    c = candidates.select(F.col("source_action").alias("kind"), F.col("path").alias("target"), F.struct("priority", (-F.col("confidence")).alias("c"), "path", "symbol").alias("c"))
    title = F.when(F.col("target_role") == "test", "Run the nearest test").when(F.col("target_role") == "config", "Check the configuration").when(F.col("target_role") == "public_api", "Inspect public API boundary").when(F.col("target_role") == "entrypoint", "Inspect entrypoint").when(F.col("target_role") == "neighbor", "Inspect the neighbor").otherwise("Inspect changed boundary")
    j = first.join(c, ["kind", "target"], "left").groupBy("step", "kind", "target", title.alias("title")).agg(F.slice(F.sort_array(F.collect_list("c")), 1, each).alias("c"))
    return j.select("step", "title", "kind", "target", F.transform("c", lambda x: x["path"]).alias("candidates"))


def shared_symbols(impact: DataFrame, changed: DataFrame | None = None, show: int = 12) -> DataFrame:
    """Boundary symbols by how much they connect. changed: symbol."""
    rows = impact.select("path", "seed", "distance", "hunk", "changed", F.explode("boundary").alias("name"))
    own = F.when(F.array_contains("changed", F.col("name")), F.col("hunk"))
    g = rows.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("target_files"), F.sort_array(F.collect_set("seed")).alias("seed_files"), F.min("distance").alias("closest_distance"), F.min(own).alias("closest_changed_hunk_distance"))
    if changed is not None:
        g = g.join(changed.select(F.col("symbol").alias("name"), F.lit(True).alias("c")).distinct(), "name", "left")
    else:
        g = g.withColumn("c", F.lit(None).cast("boolean"))
    g = g.select("name", "target_files", "seed_files", F.size("target_files").alias("target_count"), "closest_distance", F.coalesce("c", F.lit(False)).alias("is_changed_seed_symbol"), "closest_changed_hunk_distance")
    return g.orderBy(F.desc("is_changed_seed_symbol"), F.coalesce("closest_changed_hunk_distance", F.lit(999)), F.desc("target_count"), "closest_distance", F.lower("name"), "name").limit(show)


def test_clusters(impact: DataFrame, show: int = 6) -> DataFrame:
    """Impacted tests by seed and kind; siblings by candidate paths, an equi-join.
    A group's lists are cut where its rows are counted, so no task holds a whole group."""
    tests = impact.filter("is_test")
    sib = test_pairs(impact.filter("not is_test").select(F.col("path").alias("rel_path")), tests.select(F.col("path").alias("rel_path"))).groupBy(F.col("test").alias("path")).agg(F.collect_set("source").alias("covers"))
    none = F.array().cast("array<string>")
    t = tests.join(sib, "path", "left").withColumn("covers", F.coalesce("covers", none))
    kind = F.when(is_integration_test(F.col("path")), "integration").when(F.size("covers") > 0, "sibling").otherwise("nearby")
    part = lambda k, x: F.transform(F.coalesce(x, none), lambda v: F.struct(F.lit(k).alias("part"), v.alias("value")))
    lists = F.concat(part(0, F.array(F.lit(None).cast("string"))), part(1, F.array_compact(F.array("path"))), part(2, F.col("covers")), part(3, F.col("boundary")))  # 0: the group itself
    rows = t.select("seed", kind.alias("kind"), "distance", F.explode(lists).alias("x")).groupBy("seed", "kind", "x.part", "x.value").agg(F.min("distance").alias("distance"))
    k = F.row_number().over(Window.partitionBy("seed", "kind", "part").orderBy("value"))
    few = rows.withColumn("k", k).filter(F.col("k") <= 6).filter((F.col("k") <= 5) | (F.col("part") == 1))
    of = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == n, F.struct("k", "value")))), lambda x: x["value"])
    g = few.groupBy("seed", "kind").agg(of(1).alias("paths"), of(2).alias("covers"), F.min(F.when(F.col("part") == 0, F.col("distance"))).alias("closest_distance"), of(3).alias("focus_symbols"))
    return g.orderBy("closest_distance", _rank(F.col("kind"), CLUSTERS), "seed", F.get("paths", F.lit(0))).limit(show)


def review_role(c=F.col) -> Column:
    """L15"""
    return F.when(c("is_test"), "test").when(c("summary_kind") == "config", "config").when(c("is_api"), "public_api").when(c("is_entry"), "entrypoint").otherwise("boundary")


def review_focus(changed: DataFrame, actions: DataFrame, clusters: DataFrame, show: int = 10) -> DataFrame:
    """Changed surfaces, then actions, then clusters; one item per (kind, target).
    changed: path, is_test, is_api, is_entry, summary_kind."""
    def item(cond: Column, priority: int, kind: str, role: str, confidence: float) -> Column:
        return F.when(cond, F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), F.lit(role).alias("target_role"), F.lit(confidence).alias("confidence")))

    rules = F.array_compact(
        F.array(
            item(F.col("is_api"), 0, "review_changed_public_api", "public_api", 0.94),
            item(F.col("is_entry"), 0, "review_changed_entrypoint", "entrypoint", 0.9),
            item(F.col("summary_kind") == "config", 1, "review_changed_config", "config", 0.82),
            item(F.col("is_test"), 1, "review_changed_test", "test", 0.84),
        )
    )
    a = changed.select(F.explode(rules).alias("r"), F.col("path").alias("target")).select("r.priority", "r.kind", "target", "r.target_role", "r.confidence", F.lit(0).alias("o"))
    b = actions.select((F.col("priority") + 2).alias("priority"), "kind", "target", "target_role", "confidence", F.lit(1).alias("o"))
    sib = F.col("kind") == "sibling"
    c = clusters.select(F.when(sib, 3).otherwise(4).alias("priority"), F.concat(F.lit("review_"), "kind", F.lit("_test_cluster")).alias("kind"), F.get("paths", F.lit(0)).alias("target"), F.lit("test").alias("target_role"), F.when(sib, 0.8).otherwise(0.74).alias("confidence"), F.lit(2).alias("o"))
    every = a.unionByName(b).unionByName(c)
    first = Window.partitionBy("kind", "target").orderBy("o", "priority", F.desc("confidence"))
    one = every.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return one.orderBy("priority", _rank(F.col("target_role"), REVIEW_ROLES), F.desc("confidence"), "target", "kind").limit(show).select("priority", "kind", "target", "target_role", "confidence")


def reasons(files: DataFrame) -> Column:
    """The reasons of a ranked file in their fixed order, as array<struct<code, message>>."""
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    few = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    reason = lambda cond, code, msg: F.when(cond, F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(msg) if isinstance(msg, str) else msg).alias("message")))
    some = lambda c: F.size(F.col(c)) > 0
    d = F.col("changed_distance")
    many = F.when(F.size("mentioned_identifiers") > 3, say(", +", F.size("mentioned_identifiers") - 3, " more")).otherwise("")
    near = F.when(some("related_changed_files"), few("related_changed_files", 3)).otherwise("changed files")
    return F.array_compact(
        F.array(
            reason(d == 0, "changed_file", "Changed in the current selection."),
            reason(d > 0, "changed_neighbor", say("At distance ", d, " from ", near, ".")),
            reason(F.col("is_chat"), "chat_file", "In the edit context."),
            reason(F.col("is_mentioned"), "mentioned_file", "Mentioned by the caller."),
            reason(some("entry_signals"), "entrypoint_file", say("Entrypoint by ", few("entry_signals", 3), ".")),
            reason(some("api_signals"), "public_api_file", say("Public API by ", few("api_signals", 3), ".")),
            reason(some("summary_items"), F.when(F.col("summary_kind") == "doc", "doc_summary").otherwise("config_summary"), say("Summary: ", few("summary_items", 2), ".")),
            reason(some("path_terms"), "query_path_match", say("Path has ", few("path_terms", 4), ".")),
            reason(some("symbol_terms"), "query_symbol_match", say("Symbols have ", few("symbol_terms", 4), ".")),
            reason(some("related_tests"), "related_tests", say("Tested by ", few("related_tests", 3), ".")),
            reason(F.col("is_test") & some("related_sources"), "related_source", say("Tests ", few("related_sources", 3), ".")),
            reason(some("mentioned_identifiers"), "mentioned_identifier", say("Has ", few("mentioned_identifiers", 3), many, ".")),
            reason(F.col("is_important"), "important_file", "Important document or configuration."),
            reason(some("inbound"), "referenced_by", say("Referenced by ", F.col("n_in"), ": ", few("inbound", 3), ".")),
            reason(some("outbound"), "references", say("References ", F.col("n_out"), ": ", few("outbound", 3), ".")),
            reason(F.col("definition_count") > 0, "definitions", say("Defines ", F.col("definition_count"), " symbols.")),
            reason(F.col("reference_count") > 0, "identifier_references", say("Has ", F.col("reference_count"), " references.")),
        )
    )
