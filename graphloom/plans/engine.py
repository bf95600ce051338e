"""The five query facades: map, trace, impact, review, search.

An engine holds frames: files (rel_path, text), tags (rel_path, line, name, kind) and links. They
come from a source tree or are given. Each facade is one plan over them; only its small result is
collected. Ranks and graphs are cached per engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import content, paths, scores, summaries
from graphloom.operators import anchors, budget, graph, hunks, lanes, links, related, search
from graphloom.sources import git
from graphloom.sources.config import Config, load_config
from graphloom.sources.tags import extract_tags
from graphloom.sources.tree import read_tree

from .session import saved

UNRANKED = 1e-4


class CodeGraph:
    def __init__(self, files: DataFrame, tags: DataFrame | None = None, semantic: DataFrame | None = None, config: Config | None = None):
        self.spark, self.config = files.sparkSession, config or Config()
        scope = paths.scope_reason(F.col("rel_path"), self.config.include, self.config.exclude)
        every = files.withColumn("reason", F.coalesce(scope, F.when(F.col("text").isNull(), "File not found")))
        self.excluded = every.filter("reason is not null").select("rel_path", "reason")
        self.files = every.filter("reason is null").drop("reason")
        self._tags, self._links = tags, semantic

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, specs: list[str] | None = None) -> CodeGraph:
        return cls(read_tree(spark, root, specs), config=load_config(root))

    @cached_property
    def parsed(self) -> DataFrame:
        return saved(extract_tags(self.files))

    @cached_property
    def tags(self) -> DataFrame:
        if self._tags is not None:
            return self._tags.join(self.files.select("rel_path"), "rel_path", "left_semi")
        return self.parsed.filter("error is null").drop("error")

    @cached_property
    def failures(self) -> DataFrame:
        """X7"""
        return self.parsed.filter("error is not null").select("rel_path", F.col("error").alias("reason"))

    @cached_property
    def links(self) -> DataFrame:
        return self._links if self._links is not None else saved(links.semantic_links(self.files))

    @cached_property
    def tests(self) -> DataFrame:
        return related.related_tests(self.files.select("rel_path"))

    @cached_property
    def nav(self) -> DataFrame:
        return saved(graph.nav_edges(self.tags, self.links, self.tests.select("source", "test").distinct()))

    @cached_property
    def edges(self) -> DataFrame:
        return saved(graph.rank_edges(self.tags, self.links))

    @cached_property
    def roles(self) -> DataFrame:
        """Path and content signals, summaries and predicates of each file."""
        p = F.col("rel_path")
        important = paths.is_important(p)
        for g in self.config.important_files:
            important = important | paths.matches_glob(p, g)
        base = self.files.select("rel_path", paths.entry_signals(p).alias("pe"), paths.api_signals(p).alias("pa"), paths.is_test_file(p, (*paths.TEST_DIRS, *self.config.test_dirs)).alias("is_test"), important.alias("is_important"))
        out = base.join(content.runtime_roles(self.files), "rel_path", "left").join(summaries.summaries(self.files), "rel_path", "left")
        both = lambda a, b: F.array_distinct(F.concat(a, b))
        return saved(out.select("rel_path", both("pe", "entry_signals").alias("entry_signals"), both("pa", "api_signals").alias("api_signals"), F.col("pe").alias("path_entry"), F.col("pa").alias("path_api"), "is_test", "is_important", "summary_kind", "summary_items", "role_tags"))

    # Q1
    def ranked(self, chat=(), mentioned=(), identifiers=(), query: str = "", changed=(), neighbors: int = 0, exclude_unranked: bool = False) -> DataFrame:
        """One row per file that has a scored tag, with ranks, reasons and lines."""
        w, nodes = self.config.weights, self.files.select(F.col("rel_path").alias("node"))
        strings = lambda xs, c: self.spark.createDataFrame([(x,) for x in dict.fromkeys(xs)], f"{c} string")
        personal = strings(chat, "node").withColumn("weight", F.lit(100.0)) if chat else None
        rank = graph.pagerank(nodes, self.edges, personal).withColumnRenamed("node", "rel_path")
        terms = scores.query_terms(query)
        name = F.lower("name")
        found = lambda c, xs: F.array_compact(F.array(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in xs])) if xs else F.array().cast("array<string>")
        stats = graph.file_tag_stats(self.tags if "pos" in self.tags.columns else self.tags.withColumn("pos", F.lit(0)))
        hits = self.tags.groupBy("rel_path").agg(F.array_distinct(F.flatten(F.collect_set(found(name, terms)))).alias("hit"), F.sort_array(F.collect_set(F.when(F.col("name").isin(*identifiers) if identifiers else F.lit(False), F.col("name")))).alias("mentioned_identifiers"), F.max((F.col("kind") == "def") & (F.col("name").isin(*identifiers) if identifiers else F.lit(False))).alias("defines_mentioned"))
        none = F.array().cast("array<string>")
        d = self.roles.join(rank, "rel_path").join(stats, "rel_path", "left").join(hits, "rel_path", "left").join(graph.neighbours(self.edges).withColumnRenamed("node", "rel_path"), "rel_path", "left")
        if changed:
            near = graph.anchors(self.edges.select("src", "dst").unionByName(self.tests.select(F.col("source").alias("src"), F.col("test").alias("dst"))), strings(changed, "node"), neighbors)
            d = d.join(near.select(F.col("node").alias("rel_path"), F.col("distance").alias("changed_distance"), F.col("anchors").alias("related_changed_files")), "rel_path")
        else:
            d = d.withColumns({"changed_distance": F.lit(None).cast("int"), "related_changed_files": none})
        rt = self.tests.groupBy(F.col("source").alias("rel_path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "test"))), lambda x: x["test"]).alias("related_tests"))
        rs = self.tests.groupBy(F.col("test").alias("rel_path")).agg(F.sort_array(F.collect_set("source")).alias("related_sources"))
        d = d.join(rt, "rel_path", "left").join(rs, "rel_path", "left")
        p = F.col("rel_path")
        d = d.withColumns({
            "is_chat": p.isin(*chat) if chat else F.lit(False), "is_mentioned": p.isin(*mentioned) if mentioned else F.lit(False),
            "path_terms": found(F.lower(p), terms), "symbol_terms": F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(F.coalesce("hit", none), t)) if terms else none,
            **{c: F.coalesce(c, none) for c in ("related_tests", "related_sources", "mentioned_identifiers", "inbound", "outbound", "symbols", "summary_items")}, **{c: F.coalesce(c, F.lit(0)) for c in ("n_in", "n_out", "definition_count", "reference_count")},
        })
        ranked, qboost = scores.query_context(F.col("rank"), F.size("path_terms"), F.size("symbol_terms"), w.query)
        rfloor, rboost = scores.role_context(F.size("entry_signals"), F.size("api_signals"), F.col("is_test"), w.entrypoint, w.public_api)
        cfloor, cboost = scores.changed_context(F.col("changed_distance"))
        d = d.withColumns({"own": F.greatest(ranked, rfloor, cfloor), "boost": qboost * rboost * cboost})
        d = d.join(related.test_lift(d, self.tests, w.related_test), "rel_path", "left").withColumn("eff", F.greatest("own", F.coalesce("lift", F.lit(0.0))))
        extra = self._supplemental(d)
        d = d.join(extra, "rel_path", "left").withColumn("extra_lines", F.coalesce("extra_lines", F.array().cast("array<int>")))
        if exclude_unranked:
            d = d.filter((F.col("eff") > UNRANKED) | (F.size("extra_lines") > 0))
        base = lambda r, ident: scores.tag_score(r, ident, F.col("is_mentioned"), F.col("is_chat"), F.col("boost"), w.mentioned_identifier, w.mentioned_file, w.chat_file)
        by_def = F.when(F.col("definition_count") > 0, base(F.col("eff"), F.coalesce("defines_mentioned", F.lit(False))))
        by_extra = F.when(F.size("extra_lines") > 0, base(F.greatest(F.col("eff") * 4, F.lit(0.02)), F.lit(False)))
        d = d.withColumn("score", F.greatest(by_def, by_extra)).filter("score is not null")
        loi = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("lines_of_interest", F.array().cast("array<int>")), "extra_lines"))), 1, 10)
        return d.withColumn("reasons", lanes.reasons(d)).withColumn("lines_of_interest", loi).withColumn("base_rank", F.col("rank")).withColumn("rank", F.col("score")).drop("score", "hit", "lift", "own", "path_entry", "path_api", "defines_mentioned")

    def ranked_tags(self, identifiers=(), **how) -> DataFrame:
        """Definitions by their own rank: (rank, rel_path, line, name, kind)."""
        w = self.config.weights
        files = self.ranked(identifiers=identifiers, **how).select("rel_path", "eff", "boost", "is_mentioned", "is_chat")
        return graph.ranked_tags(self.tags, files, identifiers, w_ident=w.mentioned_identifier, w_file=w.mentioned_file, w_chat=w.chat_file)

    @cached_property
    def root_files(self) -> dict[str, str]:
        """The texts of the few project files that tell of test runners."""
        names = "pytest.ini .pytest.ini conftest.py pyproject.toml requirements.txt setup.cfg tox.ini package.json".split()
        return {r["rel_path"]: r["text"] or "" for r in self.files.filter(F.col("rel_path").isin(*names)).select("rel_path", "text").collect()}

    def commands(self, paths: Column) -> Column:
        """The command that runs tests at these paths."""
        return related.test_commands(paths, git.python_runner(self.root_files, self.config.python_runner), git.js_runner(self.root_files, self.config.js_runner))

    def _supplemental(self, d: DataFrame) -> DataFrame:
        """Lines of files whose importance no definition shows: documents, tests, roles."""
        docs = d.filter("is_important and definition_count = 0").select("rel_path")
        tests = d.filter("is_test and definition_count = 0").select("rel_path")
        roles = d.select("rel_path", F.explode("role_tags").alias("t")).select("rel_path", F.col("t.line").alias("line"))
        pick = lambda s, kind: content.synthetic_tags(self.files.join(s, "rel_path", "left_semi"), kind).select("rel_path", "line")
        rows = pick(docs, "doc").unionByName(pick(tests, "test")).unionByName(roles)
        return rows.groupBy("rel_path").agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias("extra_lines"))

    def map(self, budget_tokens=None, chat=(), context_window: int | None = None, count=None, **how) -> tuple[str, DataFrame]:
        """Q1: the map text and the files in it, by rank. count: a column function of tokens in a
        text, white-space words if none is given."""
        ranked = saved(self.ranked(chat=chat, **how))
        scope = budget.Scope(self.files.count(), len(chat), len(how.get("mentioned", ())), len(scores.query_terms(how.get("query", ""))), len(how.get("changed", ())), how.get("neighbors", 0))
        limit = budget.resolve_budget(budget.parse_budget(budget_tokens), scope, context_window)
        sections = content.map_sections(self.files.join(ranked.select("rel_path", "rank"), "rel_path"), ranked.select("rel_path", "lines_of_interest", "summary_kind", "summary_items"))
        priced = ranked.join(sections, "rel_path").filter(~F.col("is_chat")).withColumn("cost", (count or budget.words)(F.col("section")))
        chosen = saved(budget.pack(priced, limit.tokens).filter("included"))
        text = chosen.agg(content.joined_sections()).first()[0]
        return text or "", chosen.drop("section", "included").orderBy(F.desc("rank"), "rel_path")

    # Q2
    def trace(self, start: str, end: str, max_hops: int = 6) -> dict:
        """The least shortest path and its steps; errors are values."""
        known = {r["rel_path"] for r in self.files.filter(F.col("rel_path").isin(start, end)).select("rel_path").collect()}
        if missing := [x for x in (start, end) if x not in known]:
            return {"error": f"not in scope: {', '.join(missing)}", "path": [], "steps": []}
        seeds = self.spark.createDataFrame([(start,)], "node string")
        found = graph.shortest_paths(self.nav, seeds, max_hops).filter(F.col("node") == end)
        steps = graph.connection_steps(found, self.nav, ["seed", "node"]).orderBy("position").collect()
        row = found.first()
        if row is None:
            return {"error": f"no path within {max_hops} hops", "path": [], "steps": []}
        out = [s.asDict(recursive=True) for s in steps]
        flat = list({str(h): h for s in out for h in ({"source": s["source"], "target": s["target"], **h} for h in s["hops"])}.values())
        return {"error": None, "path": row["path"], "steps": out, "symbol_path": flat[:16]}

    # Q3
    def impact(self, seeds, changed: DataFrame | None = None, max_depth: int = 2, max_results: int = 10) -> dict[str, DataFrame]:
        """Impacted files within max_depth of the seeds and the lanes over them. changed:
        (rel_path, line) of changed lines of the seeds."""
        s = seeds.select(F.col("rel_path").alias("node")) if isinstance(seeds, DataFrame) else self.spark.createDataFrame([(x,) for x in dict.fromkeys(seeds)], "node string")
        near = graph.khop(self.nav, s, max_depth)
        steps = graph.connection_steps(near, self.nav, ["node", "seed"])
        none = F.array().cast("array<string>")
        rel = F.transform(F.sort_array(F.collect_list(F.struct("position", "relation"))), lambda x: x["relation"])
        bound = graph.boundary_symbols(steps, ["node"]).join(steps.groupBy("node").agg(rel.alias("relations")), "node")
        rows = near.join(bound, "node", "left").join(self.roles.withColumnRenamed("rel_path", "node"), "node")
        if changed is not None:
            near_changed = hunks.changed_symbols(self.tags, hunks.hunks(changed)).groupBy(F.col("rel_path").alias("seed")).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "distance"))).alias("cs"))
            rows = rows.join(near_changed, "seed", "left")
        else:
            rows = rows.withColumn("cs", F.lit(None).cast("map<string,int>"))
        touched = F.filter(F.coalesce("boundary", none), lambda x: F.coalesce(F.map_contains_key(F.coalesce("cs", F.create_map().cast("map<string,int>")), x), F.lit(False)))
        rows = rows.withColumn("changed", touched).select(
            F.col("node").alias("path"), "seed", "distance", F.size("path").alias("path_length"), F.col("path").alias("path_from_seed"), "relations", "is_test", (F.size("path_api") > 0).alias("is_api"), (F.size("path_entry") > 0).alias("is_entry"), "is_important", "summary_kind",
            F.array_min(F.transform("changed", lambda x: F.element_at("cs", x))).cast("int").alias("hunk"), F.size("changed").alias("n_changed"), F.coalesce("boundary", none).alias("boundary"), "changed",
        )
        top = saved(lanes.top_impact(rows, max_results))
        suggested = lanes.suggestions(top)
        actions = saved(lanes.quick_actions(top, suggested))
        places = graph.boundary_locations(top, self.tags)
        focus = self.tags.filter("kind = 'def'").join(top.select(F.col("path").alias("rel_path")), "rel_path", "left_semi").groupBy(F.col("rel_path").alias("path")).agg(F.slice(F.sort_array(F.collect_set("line")), 1, 10).alias("focus_lines"))
        targets = top.select("path", "hunk", "changed").join(focus, "path", "left").withColumn("focus_lines", F.coalesce("focus_lines", F.array().cast("array<int>")))
        named = self.files.join(top.select(F.explode("path_from_seed").alias("rel_path")).distinct(), "rel_path", "left_semi")
        snippets = saved(anchors.boundary_snippets(places, named))
        candidates = lanes.edit_candidates(actions)
        run = F.when(F.col("kind") == "run_nearby_test", self.commands(F.array("target")))
        full = saved(anchors.anchored(actions, targets, snippets, named).withColumn("command", run).orderBy("priority", F.desc("confidence"), "path_length", "target", "kind"))
        seen = hunks.changed_symbols(self.tags, hunks.hunks(changed)).select("symbol") if changed is not None else None
        return {"files": top, "suggestions": suggested, "actions": full, "snippets": snippets, "candidates": candidates, "plan": lanes.edit_plan(actions, candidates), "symbols": lanes.shared_symbols(top, seen), "clusters": lanes.test_clusters(top).withColumn("command", self.commands(F.col("paths"))), "locations": places.drop("k")}

    # Q4
    def review(self, changed: DataFrame, max_depth: int = 2, max_results: int = 10) -> dict[str, DataFrame]:
        """The impact of changed files, their roles, and one queue of what to look at first."""
        names = saved(changed.select("rel_path").distinct().join(self.files.select("rel_path"), "rel_path", "left_semi"))
        report = self.impact(names, changed, max_depth, max_results)
        own = self.roles.join(names, "rel_path", "left_semi").select(F.col("rel_path").alias("path"), "is_test", (F.size("api_signals") > 0).alias("is_api"), (F.size("entry_signals") > 0).alias("is_entry"), "summary_kind", "entry_signals", "api_signals")
        own = own.withColumn("role", lanes.review_role())
        return report | {"changed": own.orderBy("role", "path"), "focus": lanes.review_focus(own, report["actions"], report["clusters"])}

    # Q5
    def search(self, query: str, max_results: int | None = 50, definitions: bool = True, references: bool = True) -> DataFrame:
        return search.search_identifiers(self.tags, query, max_results, definitions, references)
