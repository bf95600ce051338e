"""Graph relations and fixpoints.

Edges are aggregated to one row per pair before any loop. Loops are driven from here because
recursive SQL rejects aggregates in the recursive part; each keeps its state as a small frame
(node, value) and cuts its lineage in the shared checkpoint folder every few rounds.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.plans.session import saved

FANOUT_CAP = 1000
#: Files beyond which a symbol without pairs is dropped before its tags are counted by file.
LOUD = 256
#: Rows that are broadcast at most, after they were counted.
SMALL = 200_000
DAMPING = 0.85
RELATIONS = ("package_reexports", "re_exports", "imports", "references", "related_test", "related_source")


def symbol_sides(tags: DataFrame) -> DataFrame:
    """(name, rel_path, kinds, def_line, ref_line): a row per symbol and file; kinds is 1 where it is
    defined, 2 where it is referenced, 3 for both."""
    line = lambda k: F.min(F.when(F.col("kind") == k, F.col("line"))).alias(f"{k}_line")
    return tags.filter(F.col("kind").isin("def", "ref")).groupBy("name", "rel_path").agg(F.bit_or(F.when(F.col("kind") == "def", 1).otherwise(2)).alias("kinds"), line("def"), line("ref"))


def _def_files() -> Column:
    return F.sum(F.col("kinds").bitwiseAND(1))


def _ref_files() -> Column:
    return F.sum(F.shiftright("kinds", 1))


def symbol_counts(sides: DataFrame) -> DataFrame:
    """A1: per symbol, the number of files that define and that reference it. sides: name, kinds."""
    return sides.groupBy("name").agg(_def_files().alias("n_def_files"), _ref_files().alias("n_ref_files"))


def symbol_edges(tags: DataFrame, cap: int = FANOUT_CAP, sides: DataFrame | None = None) -> DataFrame:
    """(src, dst, name, ref_line, def_line) for each file that references what another
    defines. A symbol with more than cap pairs is skipped, by counts taken before the join.

    Most tags are of symbols that are in many files and make no pairs. These are found first and
    their tags dropped where they are read; what is left has few files a symbol. sides: symbol_sides
    of the tags, if they are known in a cheaper way."""
    counts, nd, nr = symbol_counts(symbol_sides(tags) if sides is None else sides), F.col("n_def_files"), F.col("n_ref_files")
    fits = (nd > 0) & (nr > 0) & (nd * nr <= cap)
    loud = saved(counts.filter(~fits & (nd + nr > LOUD)).select("name"))
    loud = F.broadcast(loud) if loud.count() <= SMALL else loud
    w = Window.partitionBy("name")
    fit = symbol_sides(tags.join(loud, "name", "left_anti")).withColumns({"n_def_files": _def_files().over(w), "n_ref_files": _ref_files().over(w)}).filter(fits)
    # no join of references with definitions: a symbol's definitions go with each of its references
    defs = F.collect_list(F.when(F.col("kinds") != 2, F.struct(F.col("rel_path").alias("dst"), "def_line"))).over(w)
    refs = fit.withColumn("defs", defs).filter("kinds >= 2").select("name", F.col("rel_path").alias("src"), "ref_line", F.explode("defs").alias("d"))
    return refs.select("name", "src", "ref_line", "d.dst", "d.def_line").filter("src <> dst")


def rank_edges(tags: DataFrame, links: DataFrame | None = None, cap: int = FANOUT_CAP, sides: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight); parallel edges count. Semantic links may be loops."""
    pairs = symbol_edges(tags, cap, sides).select("src", "dst")
    if links is not None:
        pairs = pairs.unionByName(links.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return pairs.repartition("src").groupBy("src", "dst").agg(F.count("*").alias("weight"))  # few pairs are parallel


def nav_edges(tags: DataFrame, links: DataFrame | None = None, tests: DataFrame | None = None, cap: int = FANOUT_CAP, sides: DataFrame | None = None) -> DataFrame:
    """(src, dst, symbols, details) with the first 8 details by relation, line and symbol."""
    best = {r: k for k, r in enumerate(RELATIONS)}
    detail = "struct<priority:int,relation:string,source_symbol:string,target_symbol:string,source_line:int,target_line:int,evidence_kind:string,detail:string>"
    shape = lambda d, rel, ss, ts, sl, tl, ev, de: d.select(
        "src", "dst", ss.alias("symbol"), F.struct(F.coalesce(*[F.when(rel == r, F.lit(k)) for r, k in best.items()], F.lit(9)).alias("priority"), rel.alias("relation"), ss.alias("source_symbol"), ts.alias("target_symbol"), sl.cast("int").alias("source_line"), tl.cast("int").alias("target_line"), ev.alias("evidence_kind"), de.alias("detail")).cast(detail).alias("d")
    )
    none = F.lit(None).cast("string")
    out = shape(symbol_edges(tags, cap, sides), F.lit("references"), F.col("name"), F.col("name"), F.col("ref_line"), F.col("def_line"), F.lit("symbol"), none)
    if links is not None:
        first_def = tags.filter("kind = 'def'").groupBy(F.col("rel_path").alias("target"), F.col("name").alias("target_symbol")).agg(F.min("line").alias("target_line"))
        l = links.join(first_def, ["target", "target_symbol"], "left").withColumnRenamed("source", "src").withColumnRenamed("target", "dst")
        kind = F.when(F.col("relation") == "re_exports", "re_export").when(F.col("relation") == "package_reexports", "package_boundary").otherwise("import")
        out = out.unionByName(shape(l, F.col("relation"), F.col("source_symbol"), F.col("target_symbol"), F.col("line"), F.col("target_line"), kind, F.col("detail")))
    if tests is not None:
        for a, b, rel in (("source", "test", "related_test"), ("test", "source", "related_source")):
            t = tests.select(F.col(a).alias("src"), F.col(b).alias("dst"))
            e = shape(t, F.lit(rel), none, none, F.lit(None), F.lit(None), F.lit(rel), none)
            out = out.unionByName(e.withColumn("symbol", F.lit(f"__{rel}__")))
    return out.groupBy("src", "dst").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.slice(F.sort_array(F.collect_set("d")), 1, 8).alias("details"))


def pagerank(nodes: DataFrame, edges: DataFrame, personal: DataFrame | None = None, damping: float = DAMPING, rounds: int | None = None, tolerance: float = 1e-6, limit: int = 100) -> DataFrame:
    """G1: (node, rank). edges: src, dst, weight. With rounds, exactly so many; otherwise until
    the change is below tolerance per node, and 1.0 for all if it isn't after limit rounds.
    Mass of nodes without edges out goes where restarts go. personal: node, weight."""
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(1.0).alias("rank"))
    # kept as it is dealt by src, so that a round moves ranks and not edges
    flow = edges.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share")).persist(StorageLevel.DISK_ONLY)
    try:
        return _rounds(nodes.select("node"), n, flow, personal, damping, rounds, tolerance, limit)
    finally:
        flow.unpersist()


def _rounds(base: DataFrame, n: int, flow: DataFrame, personal: DataFrame | None, damping: float, rounds: int | None, tolerance: float, limit: int) -> DataFrame:
    if personal is not None:
        whole = personal.join(base, "node", "left_semi").agg(F.sum("weight")).first()[0]
    if personal is not None and whole:
        restart = base.join(personal, "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / whole).alias("p"))
    else:
        restart = base.select("node", F.lit(1.0 / n).alias("p"))
    base = saved(restart.join(flow.select("src").distinct(), F.col("node") == F.col("src"), "left").select("node", "p", F.col("src").isNull().alias("ends")))
    rank, lost = base.select("node", "p", "ends", F.lit(1.0 / n).alias("rank")), None
    for k in range(rounds if rounds is not None else limit):
        if lost is None:
            lost = base.filter("ends").count() / n
        into = rank.join(flow, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = damping * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p")) + (1 - damping) * F.col("p")
        # two scalars are observed by the job that saves the round, so a round is one job
        sums = Observation()
        step = rank.join(into, F.col("node") == F.col("dst"), "left").select("node", "p", "ends", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        rank = saved(step.observe(sums, F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0)).alias("lost"), F.sum("change").alias("change"))).drop("change")
        lost, change = sums.get["lost"], sums.get["change"]
        if rounds is None and change < n * tolerance:
            return rank.select("node", "rank")
    return rank.select("node", "rank") if rounds is not None else rank.select("node", F.lit(1.0).alias("rank"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(seed, node, distance, path) for all nodes within max_hops of each seed, over
    edges in both directions; of equal paths the least one. seeds: node."""
    way = saved(both_ways(edges))
    found = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.array("node").alias("path")).distinct()
    edge_of = found
    for hop in range(1, max_hops + 1):
        step = edge_of.join(way, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = step.groupBy("seed", "node").agg(F.min("path").alias("path")).join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        edge_of = saved(new.select("seed", "node", F.lit(hop).alias("distance"), "path"))
        if edge_of.isEmpty():
            break
        found = saved(found.unionByName(edge_of))
    return found


def khop(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Per reached node its least (distance, seed, path)."""
    paths = shortest_paths(edges, seeds, max_depth).filter("distance > 0")
    best = paths.join(seeds, "node", "left_anti").groupBy("node").agg(F.min(F.struct("distance", "seed", "path")).alias("b"))
    return best.select("node", "b.distance", "b.seed", "b.path")


def anchors(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """(node, distance, anchors): distance to the nearest changed nodes, and all of these."""
    way = saved(both_ways(edges))
    seen = saved(changed.select("node", F.lit(0).alias("distance"), F.col("node").alias("anchor")).distinct())
    front = seen
    for d in range(1, depth + 1):
        new = front.join(way, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "anchor").distinct().join(seen.select("node").distinct(), "node", "left_anti")
        front = saved(new.select("node", F.lit(d).alias("distance"), "anchor"))
        seen = seen.unionByName(front)
    return seen.groupBy("node", "distance").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))


def connection_steps(paths: DataFrame, nav: DataFrame, key: list[str]) -> DataFrame:
    """One row per step of each path (key..., path): position, source, target, relation,
    symbols (5), hops (6). A forward edge wins over a backward one."""
    steps = paths.select(*key, F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("source"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("target"))).alias("position", "s")).select(*key, "position", "s.*")
    fwd = nav.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct("symbols", "details").alias("f"))
    back = nav.select(F.col("dst").alias("source"), F.col("src").alias("target"), F.struct("symbols", "details").alias("b"))
    j = steps.join(fwd, ["source", "target"], "left").join(back, ["source", "target"], "left")
    e = F.coalesce("f", "b")
    symbols, details = F.coalesce(e["symbols"], F.array().cast("array<string>")), e["details"]
    relation = F.when(F.col("f").isNotNull(), F.coalesce(F.get(details, F.lit(0))["relation"], F.lit("references"))).when(F.col("b").isNotNull(), "referenced_by").otherwise("related")
    test, source = F.array_contains(symbols, "__related_test__"), F.array_contains(symbols, "__related_source__")
    return j.select(
        *key, "position", "source", "target",
        F.when(test, "related_test").when(source, "related_source").otherwise(relation).alias("relation"),
        F.when(test | source, F.array().cast("array<string>")).otherwise(F.slice(symbols, 1, 5)).alias("symbols"),
        F.transform(F.slice(F.coalesce(details, F.array()), 1, 6), lambda d: d.dropFields("priority")).alias("hops"),
    )


def neighbours(edges: DataFrame, show: int = 5) -> DataFrame:
    """(node, n_in, n_out, inbound, outbound); the names sorted, the first few. edges: a row per
    pair; read once, each as a row of both its ends. The number of partitions is fixed, as small
    compressed rows would be drawn together to tasks that sort too many of them."""
    n_parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = lambda node, out, other: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"), F.col(other).alias("other"))
    rows = edges.filter("src <> dst").select(F.explode(F.array(end("src", True, "dst"), end("dst", False, "src"))).alias("x")).select("x.*").repartition(n_parts, "node")
    w = Window.partitionBy("node", "out")
    first = rows.withColumns({"n": F.count("*").over(w).cast("int"), "k": F.row_number().over(w.orderBy("other"))}).filter(F.col("k") <= show)
    n = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    names = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("k", "other")))), lambda x: x["other"])
    return first.groupBy("node").agg(n(~F.col("out")).alias("n_in"), n(F.col("out")).alias("n_out"), names(~F.col("out")).alias("inbound"), names(F.col("out")).alias("outbound"))


def tag_totals(tags: DataFrame) -> DataFrame:
    """A2"""
    return tags.agg(F.count_if(F.col("kind") == "def").alias("definition_matches"), F.count_if(F.col("kind") == "ref").alias("reference_matches"))


def file_tag_stats(tags: DataFrame, show: int = 5, lines: int = 10) -> DataFrame:
    """A3/A4: counts, the first symbols (definitions, else references) and lines of interest."""
    at = F.shiftleft(F.col("line").cast("long"), 32) + F.col("pos")  # a number, so that groups are hashed and not sorted
    first = tags.filter("rel_path is not null").groupBy("rel_path", "kind", "name").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    w = Window.partitionBy("rel_path", "kind")
    sample = first.withColumns({"k": F.row_number().over(w.orderBy("at", "name")), "n": F.sum("n").over(w)}).filter(F.col("k") <= show)
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("k", "name"))))
    count = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))
    counts = sample.groupBy("rel_path").agg(count("def").alias("definition_count"), count("ref").alias("reference_count"), of("def").alias("d"), of("ref").alias("r"))
    places = tags.filter("kind <> 'ref'").select("rel_path", "line").distinct().groupBy("rel_path").agg(F.slice(F.sort_array(F.collect_list("line")), 1, lines).alias("l"))
    names = F.transform(F.when(F.size("d") > 0, F.col("d")).otherwise(F.col("r")), lambda x: x["name"])
    return counts.join(places, "rel_path", "left").select("rel_path", "definition_count", "reference_count", names.alias("symbols"), F.coalesce("l", F.array().cast("array<int>")).alias("lines_of_interest"))


def ranked_tags(tags: DataFrame, files: DataFrame, identifiers=(), **weights) -> DataFrame:
    """(rank, rel_path, line, name, kind) of definitions, best first; a tag with a
    mentioned name ranks above its file's others. files: rel_path, eff, boost, is_mentioned, is_chat."""
    own = F.col("name").isin(*identifiers) if identifiers else F.lit(False)
    rank = scores.tag_score(F.col("eff"), own, F.col("is_mentioned"), F.col("is_chat"), F.col("boost"), **weights)
    rows = tags.filter("kind = 'def'").select("rel_path", "line", "name", "kind").distinct().join(files, "rel_path")
    return rows.select(rank.alias("rank"), "rel_path", "line", "name", "kind").orderBy(F.desc("rank"), "rel_path", "line", "name", "kind")


def tags_by_file(ranked: DataFrame) -> DataFrame:
    """One row per file, by its best tag and then path: (rel_path, rank, tags)."""
    tag = F.struct((-F.col("rank")).alias("r"), "line", "name", "kind")
    g = ranked.groupBy("rel_path").agg(F.max("rank").alias("rank"), F.sort_array(F.collect_list(tag)).alias("t"))
    return g.select("rel_path", "rank", F.transform("t", lambda x: x.dropFields("r")).alias("tags")).orderBy(F.desc("rank"), "rel_path")


def boundary_symbols(steps: DataFrame, key: list[str], show: int = 8) -> DataFrame:
    """The first distinct symbols along a path, without synthetic ones. steps: key, position, symbols."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "symbols"))), lambda x: x["symbols"])
    real = F.filter(F.array_distinct(F.flatten(ordered)), lambda x: ~x.startswith("__"))
    return steps.groupBy(*key).agg(F.slice(real, 1, show).alias("boundary"))


def flat_hops(steps: DataFrame, key: list[str], show: int = 16) -> DataFrame:
    """The distinct hops of a path in order. steps: key, position, source, target, hops."""
    own = F.transform("hops", lambda h: F.struct("source", "target", h.alias("hop")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", own.alias("own")))), lambda x: x["own"])
    return steps.groupBy(*key).agg(F.slice(F.array_distinct(F.flatten(ordered)), 1, show).alias("hops"))


def boundary_locations(impact: DataFrame, tags: DataFrame, show: int = 12) -> DataFrame:
    """(path, k, rel_path, name, line, kind): definitions and references of a path's boundary
    symbols in its files. impact: path, path_from_seed, boundary.

    Only tags of boundary symbols are moved, and of a file that is on many paths only the first
    `show` of a symbol, as no path can show more of them."""
    on = impact.select("path", F.posexplode("path_from_seed").alias("at", "rel_path"), "boundary").select("path", "at", "rel_path", F.explode("boundary").alias("name"))
    names = saved(on.select("name").distinct())
    names = F.broadcast(names) if names.count() <= SMALL else names
    own = tags.filter("kind in ('def', 'ref')").join(names, "name", "left_semi").select("rel_path", "name", "line", "kind").distinct()
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("rel_path", "name").orderBy("line", "kind"))).filter(F.col("n") <= show).drop("n")
    k = F.row_number().over(Window.partitionBy("path").orderBy("at", "name", "line", "kind"))
    return on.join(first, ["rel_path", "name"]).withColumn("k", k).filter(F.col("k") <= show).select("path", "k", "rel_path", "name", "line", "kind")
