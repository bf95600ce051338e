"""Queries over the table adapter, and the same in SQL: tags, edges, ranks, paths, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.functions import scores as S
from graphloom.operators import budget as B
from graphloom.operators import graph as G
from graphloom.operators import hunks as H
from graphloom.operators import search as X
from graphloom.sources import tables as T

ROUNDS = 10
QUERY = "the ation of code"
BUDGET = 8192
INCLUDE, EXCLUDE = ("src/**", "docs/*.md", "*.json", "generated/", "tests/**/test_*.py", "pkg[0-9]*/__init__.py"), ("src/mod3/**", "generated/r[!1]*/README.md", "**/package.json")

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SIDES = f"""{T.TAGS},
sides AS MATERIALIZED (SELECT name, kind, rel_path, min(line) AS line FROM tags GROUP BY 1, 2, 3),
counts AS MATERIALIZED (SELECT name, count(*) FILTER (kind = 'def') AS nd, count(*) FILTER (kind = 'ref') AS nr FROM sides GROUP BY 1),
pairs AS MATERIALIZED (SELECT r.rel_path AS src, d.rel_path AS dst, r.name, r.line AS ref_line, d.line AS def_line
  FROM sides r JOIN sides d ON r.name = d.name AND r.kind = 'ref' AND d.kind = 'def' AND r.rel_path <> d.rel_path
  JOIN counts c ON c.name = r.name AND nd * nr <= {G.FANOUT_CAP}),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM pairs GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT 'doc/' || doc_id AS node FROM documents)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("node"))


@query("s6_tag_extract", f"WITH {T.TAGS} SELECT rel_path, line, pos, name, kind FROM tags")
def tag_extract(spark, d):
    return T.tags(spark, d)


@query("a1_symbol_files", f"WITH {SIDES} SELECT name, nd AS n_def_files, nr AS n_ref_files FROM counts")
def symbol_files(spark, d):
    return G.symbol_counts(T.symbols(spark, d))


@query("a2_tag_totals", f"WITH {T.TAGS} SELECT count(*) FILTER (kind = 'def') AS definition_matches, count(*) FILTER (kind = 'ref') AS reference_matches FROM tags")
def totals(spark, d):
    return G.tag_totals(T.tags(spark, d))


@query(
    "a3_file_tag_stats",
    f"""WITH {T.TAGS}, f AS (SELECT rel_path, kind, name, min((line, pos)) AS first_at FROM tags GROUP BY 1, 2, 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY rel_path, kind ORDER BY first_at, name) AS k FROM f),
    g AS (SELECT rel_path, list(name ORDER BY k) FILTER (kind = 'def') AS d, list(name ORDER BY k) FILTER (kind = 'ref') AS r FROM s WHERE k <= 5 GROUP BY 1),
    c AS (SELECT rel_path, count(*) FILTER (kind = 'def') AS definition_count, count(*) FILTER (kind = 'ref') AS reference_count, list_sort(list(DISTINCT line) FILTER (kind <> 'ref'))[1:10] AS lines_of_interest FROM tags GROUP BY 1)
    SELECT rel_path, definition_count, reference_count, coalesce(d, r) AS symbols, coalesce(lines_of_interest, []) AS lines_of_interest FROM c JOIN g USING (rel_path)""",
)
def tag_stats(spark, d):
    return G.file_tag_stats(T.tags(spark, d, True))


@query("j1_symbol_edges_capped", f"WITH {SIDES} SELECT src, dst, weight FROM edges")
def edges(spark, d):
    return G.rank_edges(T.tags(spark, d, True), sides=T.symbols(spark, d))


@query("j2_symbol_edges_evidence", f"WITH {SIDES} SELECT src, dst, name, ref_line, def_line FROM pairs")
def evidence(spark, d):
    return G.symbol_edges(T.tags(spark, d, True), sides=T.symbols(spark, d))


@query("g2_navigation_graph", f"WITH {SIDES} SELECT src, dst, list_sort(list(name)) AS symbols, least(count(*), 8) AS n_details FROM pairs GROUP BY 1, 2")
def navigation(spark, d):
    return G.nav_edges(T.tags(spark, d, True), sides=T.symbols(spark, d)).select("src", "dst", "symbols", F.size("details").cast("long").alias("n_details"))


@query(
    "g9_neighbors",
    f"""WITH {SIDES}, i AS (SELECT dst AS node, list_sort(list(src)) AS x FROM edges GROUP BY 1), o AS (SELECT src AS node, list_sort(list(dst)) AS x FROM edges GROUP BY 1)
    SELECT coalesce(i.node, o.node) AS node, coalesce(len(i.x), 0)::INTEGER AS n_in, coalesce(len(o.x), 0)::INTEGER AS n_out, coalesce(i.x[1:5], []) AS inbound, coalesce(o.x[1:5], []) AS outbound FROM i FULL JOIN o ON i.node = o.node""",
)
def neighbours(spark, d):
    return G.neighbours(G.rank_edges(T.tags(spark, d, True), sides=T.symbols(spark, d)))


def rank_sql(personal: bool) -> str:
    p = "CASE WHEN node IN ('doc/0', 'doc/3') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END" if personal else "1.0::DOUBLE / (SELECT count(*) FROM nodes)"
    steps = [f"r0 AS MATERIALIZED (SELECT node, {p} AS p, o.src IS NULL AS ends, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes LEFT JOIN (SELECT DISTINCT src FROM edges) o ON node = o.src)"]
    for k in range(ROUNDS):
        steps.append(
            f"i{k + 1} AS MATERIALIZED (SELECT dst, sum(rank * share) AS got FROM r{k} JOIN flow ON node = src GROUP BY 1), "
            f"r{k + 1} AS MATERIALIZED (SELECT node, p, ends, {G.DAMPING} * (coalesce(got, 0) + (SELECT coalesce(sum(rank) FILTER (ends), 0) FROM r{k}) * p) + (1 - {G.DAMPING}) * p AS rank FROM r{k} LEFT JOIN i{k + 1} ON node = dst)"
        )
    return f"{SIDES}, flow AS MATERIALIZED (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS share FROM edges), {', '.join(steps)}"


def ranks(spark, d, personal=False):
    chat = spark.createDataFrame([("doc/0", 100.0), ("doc/3", 100.0)], "node string, weight double") if personal else None
    return G.pagerank(nodes(spark, d), G.rank_edges(T.tags(spark, d, True), sides=T.symbols(spark, d)), chat, rounds=ROUNDS)


@query("g1_pagerank_uniform", f"WITH {rank_sql(False)} SELECT node, round(rank, 9) AS rank FROM r{ROUNDS}")
def uniform(spark, d):
    return ranks(spark, d).select("node", F.round("rank", 9).alias("rank"))


@query("g1_pagerank_personalized", f"WITH {rank_sql(True)} SELECT node, round(rank, 9) AS rank FROM r{ROUNDS}")
def personalized(spark, d):
    return ranks(spark, d, True).select("node", F.round("rank", 9).alias("rank"))


def scored(spark, d) -> DataFrame:
    """R1-R10 and P9 over documents: chat and mentioned files and identifiers by fixed rules."""
    terms = S.query_terms(QUERY)
    n_of = lambda k: F.count_if(F.col("kind") == k)
    hits = T.tags(spark, d, True).groupBy("rel_path").agg(n_of("def").alias("definition_count"), n_of("ref").alias("reference_count"), *[F.max(F.contains("name", F.lit(t)).cast("int")).alias(f"t{k}") for k, t in enumerate(terms)], F.max((F.col("name") == "code").cast("int")).alias("ident"))
    r = nodes(spark, d).withColumnRenamed("node", "rel_path").join(ranks(spark, d).withColumnRenamed("node", "rel_path"), "rel_path").join(hits, "rel_path", "left")
    path_hits = sum((F.contains("rel_path", F.lit(t)).cast("int") for t in terms), F.lit(0))
    symbol_hits = sum((F.coalesce(F.col(f"t{k}"), F.lit(0)) for k in range(len(terms))), F.lit(0))
    floored, boost = S.query_context(F.col("rank"), path_hits, symbol_hits)
    number = F.substring_index("rel_path", "/", -1).cast("long")
    role_floor, role_boost = S.role_context((number % 7 == 0).cast("int"), (number % 5 == 0).cast("int") * 2, number % 3 == 0)
    distance = F.when(number % 11 < 4, (number % 11).cast("int"))
    ch_floor, ch_boost = S.changed_context(distance)
    eff = F.greatest(floored, role_floor, ch_floor)
    score = S.tag_score(eff, F.coalesce(F.col("ident"), F.lit(0)) == 1, number % 13 == 0, number % 17 == 0, boost * role_boost * ch_boost)
    return r.select("rel_path", F.round(eff, 9).alias("effective_rank"), F.round(boost * role_boost * ch_boost, 9).alias("context_boost"), F.round(score, 8).alias("rank"), path_hits.alias("path_hits"), symbol_hits.alias("symbol_hits"), F.coalesce("definition_count", F.lit(0)).alias("definition_count"), F.coalesce("reference_count", F.lit(0)).alias("reference_count")).filter("definition_count > 0")


def _scored_sql() -> str:
    terms = S.query_terms(QUERY)
    hit = " + ".join(f"coalesce(max(CASE WHEN contains(name, '{t}') THEN 1 ELSE 0 END), 0)" for t in terms)
    path = " + ".join(f"CASE WHEN contains(node, '{t}') THEN 1 ELSE 0 END" for t in terms)
    return f"""{rank_sql(False)},
    h AS (SELECT rel_path, {hit} AS symbol_hits, max(CASE WHEN name = 'code' THEN 1 ELSE 0 END) AS ident, count(*) FILTER (kind = 'def') AS definition_count, count(*) FILTER (kind = 'ref') AS reference_count FROM tags GROUP BY 1),
    b AS (SELECT node AS rel_path, rank, ({path})::INTEGER AS path_hits, coalesce(symbol_hits, 0)::INTEGER AS symbol_hits, coalesce(ident, 0) AS ident, coalesce(definition_count, 0) AS definition_count, coalesce(reference_count, 0) AS reference_count, split_part(node, '/', 2)::BIGINT AS n FROM r{ROUNDS} LEFT JOIN h ON node = rel_path),
    c AS (SELECT *, CASE WHEN path_hits + symbol_hits > 0 THEN greatest(rank, 0.02 * path_hits + 0.05 * symbol_hits) ELSE rank END AS floored,
      CASE WHEN path_hits + symbol_hits > 0 THEN least((1 + 0.75 * path_hits) * (1 + 1.25 * symbol_hits), 8) ELSE 1 END::DOUBLE AS qb,
      CASE WHEN n % 3 = 0 THEN 0.35 ELSE 1 END::DOUBLE AS db, CASE WHEN n % 3 = 0 THEN 0.25 ELSE 1 END::DOUBLE AS df, CASE WHEN n % 11 < 4 THEN n % 11 END AS dist FROM b),
    e AS (SELECT *, greatest(CASE WHEN n % 7 = 0 THEN 0.06 * df ELSE 0 END, CASE WHEN n % 5 = 0 THEN 0.045 * df ELSE 0 END) AS rf,
      (CASE WHEN n % 7 = 0 THEN 1 + 0.5 * db ELSE 1 END) * (CASE WHEN n % 5 = 0 THEN 1 + 0.4 * db ELSE 1 END) AS rb,
      CASE dist WHEN 0 THEN 0.08 WHEN 1 THEN 0.03 WHEN 2 THEN 0.015 WHEN 3 THEN 0.015 ELSE 0 END::DOUBLE AS cf, CASE dist WHEN 0 THEN 8 WHEN 1 THEN 2.5 WHEN 2 THEN 1.75 WHEN 3 THEN 1.5 ELSE 1 END::DOUBLE AS cb FROM c),
    scored AS MATERIALIZED (SELECT rel_path, round(greatest(floored, rf, cf), 9) AS effective_rank, round(qb * rb * cb, 9) AS context_boost,
      round(greatest(floored, rf, cf) * CASE ident WHEN 1 THEN 10 ELSE 1 END * CASE WHEN n % 13 = 0 THEN 5 ELSE 1 END * CASE WHEN n % 17 = 0 THEN 20 ELSE 1 END * (qb * rb * cb), 8) AS rank,
      path_hits, symbol_hits, definition_count, reference_count FROM e WHERE definition_count > 0)"""


@query("r10_rank_scored", f"WITH {_scored_sql()} SELECT * FROM scored")
def rank_scored(spark, d):
    return scored(spark, d)


@query("t1_budget_topk", f"WITH s AS (SELECT doc_id, text, n_chars, sum(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) OVER (ORDER BY n_chars DESC, 'doc/' || doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) SELECT 'doc/' || doc_id AS rel_path, n_chars AS rank, spent <= {BUDGET * 8} AS included FROM s")
def budget(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), F.col("n_chars").alias("rank"), B.words(F.col("text")).alias("cost"))
    return B.pack(docs, BUDGET * 8).select("rel_path", "rank", "included")


@query("t2_budget_oversize", "WITH p AS (SELECT concat('p/', p_partkey) AS rel_path, p_retailprice AS rank, p_size AS cost FROM part), s AS (SELECT *, sum(cost) OVER (ORDER BY rank DESC, rel_path ROWS UNBOUNDED PRECEDING) AS spent FROM p WHERE cost <= 3 ) SELECT p.rel_path, p.rank, coalesce(spent <= 3, false) AS included FROM p LEFT JOIN s USING (rel_path)")
def oversize(spark, d):
    """With a first row that costs more than the budget, the retry drops what never fits."""
    part = T.table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey")).alias("rel_path"), F.col("p_retailprice").alias("rank"), F.col("p_size").alias("cost"))
    return B.pack(part, 3).select("rel_path", "rank", "included")


@query("f2_token_estimate", """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    s AS (SELECT *, array_to_string(list_filter(lines, lambda x, i: (i - 1) % greatest(1, len(lines) // 100) = 0), chr(10)) AS sample FROM l),
    w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, len(list_filter(regexp_split_to_array(sample, '\\s+'), lambda x: x <> '')) AS m FROM s)
    SELECT doc_id, CASE WHEN length(text) < 200 OR length(sample) = 0 THEN n ELSE floor(m / length(sample) * length(text)) END::BIGINT AS tokens FROM w""")
def token_estimate(spark, d):
    return T.table(spark, d, "documents").select("doc_id", B.sampled_tokens(F.col("text")).alias("tokens"))


@query("p10_ident_search", f"WITH {T.TAGS} SELECT rel_path, line, name, kind FROM tags WHERE contains(name, 'tion') ORDER BY kind <> 'def', instr(name, 'tion'), rel_path, line, name, pos LIMIT 50")
def ident_search(spark, d):
    return X.search_identifiers(T.tags(spark, d), "TION", 50)


def _glob_sql(globs) -> str:
    out = []
    for g in globs:
        r, name = P.glob_regex(g)
        out.append(f"regexp_matches({'base' if name else 'rel_path'}, '(?s){r}')")
    return " OR ".join(out)


@query("p3_glob_scope", f"WITH {T.FILES}, b AS (SELECT *, string_split(rel_path, '/')[-1] AS base FROM files) SELECT rel_path, CASE WHEN NOT ({_glob_sql(INCLUDE)}) THEN 'Outside configured include patterns' WHEN {_glob_sql(EXCLUDE)} THEN 'Matched configured exclude pattern' END AS reason FROM b")
def glob_scope(spark, d):
    return T.files(spark, d).select("rel_path", P.scope_reason(F.col("rel_path"), INCLUDE, EXCLUDE).alias("reason"))


PARTS = f"{T.FILES}, parts AS MATERIALIZED (SELECT rel_path, string_split(rel_path, '/')[-1] AS real, lower(string_split(rel_path, '/')[-1]) AS base, list_transform(string_split(rel_path, '/')[:-2], lambda x: lower(x)) AS up, regexp_replace(lower(string_split(rel_path, '/')[-1]), '^(.+)\\.[^.]+$', '\\1') AS stem, CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS folder FROM files)"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
NEXT = "base IN ('route.ts', 'route.tsx', 'route.js', 'route.jsx') AND list_contains(up, 'app') AND list_contains(up, 'api')"
TEST = f"NOT ({NEXT}) AND (len(list_intersect(up, {_list(P.TEST_DIRS)})) > 0 OR regexp_matches(base, '^test_|_test\\.py$|\\.test\\.|\\.spec\\.') OR regexp_matches(stem, '^test_|_test$|_spec$'))"


@query("p5_test_files", f"WITH {PARTS} SELECT rel_path, {TEST} AS is_test, len(list_intersect(list_append(up, base), {_list(P.INTEGRATION)})) > 0 OR regexp_matches(stem, '{'|'.join(P.INTEGRATION)}') AS is_integration FROM parts")
def test_files(spark, d):
    p = F.col("rel_path")
    return T.files(spark, d).select("rel_path", P.is_test_file(p).alias("is_test"), P.is_integration_test(p).alias("is_integration"))


@query("p7_path_roles", f"WITH {PARTS} SELECT rel_path, list_filter([CASE WHEN list_contains({_list(P.ENTRY_NAMES)}, base) THEN 'entrypoint_filename' END, CASE WHEN len(list_intersect(up, {_list(P.ENTRY_DIRS)})) > 0 THEN 'entrypoint_directory' END], lambda x: x IS NOT NULL) AS entrypoint, list_filter([CASE WHEN list_contains({_list(P.API_NAMES)}, base) THEN 'public_api_filename' END, CASE WHEN len(list_intersect(up, {_list(P.API_DIRS)})) > 0 THEN 'public_api_directory' END, CASE WHEN {NEXT} THEN 'public_api_next_route' END], lambda x: x IS NOT NULL) AS public_api FROM parts")
def path_roles(spark, d):
    p = F.col("rel_path")
    return T.files(spark, d).select("rel_path", P.entry_signals(p).alias("entrypoint"), P.api_signals(p).alias("public_api"))


@query("p1_important_files", f"WITH {PARTS} SELECT rel_path, list_contains({_list(P.IMPORTANT)}, real) OR (folder = '.github/workflows' AND regexp_matches(real, '\\.ya?ml$')) OR (folder = '.github' AND regexp_matches(real, '\\.(md|ya?ml)$')) OR (folder = 'docs' AND regexp_matches(real, '\\.(md|rst|txt)$')) AS is_important FROM parts")
def important_files(spark, d):
    return T.files(spark, d).select("rel_path", P.is_important(F.col("rel_path")).alias("is_important"))


REACH = 3


def _bfs_sql(seeds: str) -> str:
    """Least path per (seed, node) at its distance, hop by hop."""
    steps = [f"f0 AS MATERIALIZED ({seeds})", "a0 AS MATERIALIZED (SELECT * FROM f0)"]
    for h in range(1, REACH + 1):
        steps.append(f"f{h} AS MATERIALIZED (SELECT f.seed, w.dst AS node, {h} AS distance, min(list_append(f.path, w.dst)) AS path FROM f{h - 1} f JOIN way w ON f.node = w.src WHERE NOT EXISTS (SELECT 1 FROM a{h - 1} a WHERE a.seed = f.seed AND a.node = w.dst) GROUP BY 1, 2)")
        steps.append(f"a{h} AS MATERIALIZED (SELECT * FROM a{h - 1} UNION ALL SELECT * FROM f{h})")
    return f"{T.PLACES}, {', '.join(steps)}"


def seeds_of(spark) -> DataFrame:
    return spark.createDataFrame([("s:1",), ("s:2",), ("n:3",)], "node string")


SEEDS = "SELECT s AS seed, s AS node, 0 AS distance, [s] AS path FROM (VALUES ('s:1'), ('s:2'), ('n:3')) v(s)"


@query("g3_shortest_paths", f"WITH {_bfs_sql(SEEDS)} SELECT seed, node, distance, path FROM a{REACH}")
def paths(spark, d):
    return G.shortest_paths(T.places(spark, d), seeds_of(spark), REACH)


@query("g4_impact_khop", f"WITH {_bfs_sql(SEEDS)}, b AS (SELECT node, min((distance, seed, path)) AS b FROM a{REACH} WHERE distance > 0 AND node NOT IN ('s:1', 's:2', 'n:3') GROUP BY 1) SELECT node, struct_extract(b, 1) AS distance, struct_extract(b, 2) AS seed, struct_extract(b, 3) AS path FROM b")
def impact_khop(spark, d):
    return G.khop(T.places(spark, d), seeds_of(spark), REACH)


@query("g5_changed_anchors", f"WITH {_bfs_sql(SEEDS)}, m AS (SELECT node, min(distance) AS distance FROM a{REACH} GROUP BY 1) SELECT m.node, m.distance, list_sort(list(seed)) AS anchors FROM m JOIN a{REACH} a ON a.node = m.node AND a.distance = m.distance GROUP BY 1, 2")
def changed_anchors(spark, d):
    return G.anchors(T.places(spark, d), seeds_of(spark), REACH)


@query("g6_connection_steps", f"WITH {_bfs_sql(SEEDS)}, s AS (SELECT seed, node, (k - 1)::INTEGER AS position, path[k] AS source, path[k + 1] AS target FROM (SELECT *, unnest(generate_series(1, len(path) - 1)) AS k FROM a{REACH})) SELECT seed, node, position, s.source, s.target, CASE WHEN EXISTS (SELECT 1 FROM places p WHERE p.src = s.source AND p.dst = s.target) THEN 'imports' ELSE 'referenced_by' END AS relation FROM s")
def steps(spark, d):
    """Memberships as links, so that direction is recovered per step."""
    places = T.places(spark, d)
    none = F.lit(None).cast("string")
    links = places.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("imports").alias("relation"), F.lit(1).alias("line"), none.alias("source_symbol"), none.alias("target_symbol"), none.alias("detail"))
    tags = spark.createDataFrame([], "rel_path string, line int, pos int, name string, kind string")
    found = G.shortest_paths(places, seeds_of(spark), REACH)
    return G.connection_steps(found, G.nav_edges(tags, links), ["seed", "node"]).select("seed", "node", "position", "source", "target", "relation")


HUNKS = f"{T.CHANGED}, spans AS MATERIALIZED (SELECT rel_path, min(line) AS start, max(line) AS \"end\" FROM (SELECT *, line - row_number() OVER (PARTITION BY rel_path ORDER BY line) AS g FROM (SELECT DISTINCT rel_path, line FROM changed)) GROUP BY rel_path, g)"


@query("a5_changed_hunks", f"WITH {HUNKS} SELECT rel_path, start, \"end\", CASE WHEN start = \"end\" THEN start::VARCHAR ELSE start || '-' || \"end\" END AS label FROM spans")
def changed_hunks(spark, d):
    return H.hunks(T.changed_lines(spark, d)).withColumn("label", S.hunk_label(F.col("start"), F.col("end")))


@query("j12_hunk_distance", f"WITH {HUNKS}, l AS (SELECT DISTINCT event_type AS rel_path, user_id AS line FROM events), b AS (SELECT l.*, s.\"end\" AS e FROM l ASOF LEFT JOIN spans s ON l.rel_path = s.rel_path AND l.line >= s.start), a AS (SELECT b.*, s.start AS n FROM b ASOF LEFT JOIN spans s ON b.rel_path = s.rel_path AND b.line <= s.start) SELECT rel_path, line, least(CASE WHEN e IS NOT NULL THEN greatest(0, line - e) END, n - line) AS distance FROM a")
def distance(spark, d):
    lines = T.table(spark, d, "events").select(F.col("event_type").alias("rel_path"), F.col("user_id").alias("line")).distinct()
    return H.hunk_distance(lines, H.hunks(T.changed_lines(spark, d))).select("rel_path", "line", "distance")


@query(
    "a6_changed_symbols",
    f"""WITH {T.TAGS}, s AS (SELECT 'doc/' || doc_id AS rel_path, (1 + doc_id % 4)::INTEGER AS start, (1 + doc_id % 4 + doc_id % 2)::INTEGER AS "end" FROM documents),
    n AS (SELECT t.rel_path, name AS symbol, min(greatest(0, start - line, line - "end")) AS distance FROM tags t JOIN s USING (rel_path) GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN distance <= 0 THEN 0 WHEN distance <= 2 THEN 1 ELSE 2 END AS tier FROM n WHERE distance <= 8),
    m AS (SELECT *, min(tier) OVER (PARTITION BY rel_path) AS best FROM k)
    SELECT rel_path, symbol, distance FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY distance, symbol) AS r FROM m WHERE tier = best) WHERE r <= 8""",
)
def symbols_changed(spark, d):
    i = F.col("doc_id")
    spans = T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), i).alias("rel_path"), (1 + i % 4).cast("int").alias("start"), (1 + i % 4 + i % 2).cast("int").alias("end"))
    return H.changed_symbols(T.tags(spark, d, True), spans)


@query("j13_context_lines", "WITH l AS (SELECT doc_id, unnest(generate_series(1, len(lines)))::INTEGER AS line, unnest(lines) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)), p AS (SELECT doc_id, (1 + doc_id % 4)::INTEGER AS focus FROM documents) SELECT 'doc/' || doc_id AS rel_path, line, focus, body FROM l JOIN p USING (doc_id) WHERE line BETWEEN focus - 2 AND focus + 2")
def context(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), "doc_id", "text")
    lines = docs.select("rel_path", F.posexplode(F.split("text", "\n")).alias("p", "body")).select("rel_path", (F.col("p") + 1).alias("line"), "body")
    return H.context_lines(lines, docs.select("rel_path", (1 + F.col("doc_id") % 4).cast("int").alias("line")))


RELATED = """cand AS (SELECT rel_path AS source, unnest(generate_series(1, 55))::INTEGER AS pos, CASE WHEN dirs[1 + (pos - 1) // 5] = '' THEN names[1 + (pos - 1) % 5] ELSE dirs[1 + (pos - 1) // 5] || '/' || names[1 + (pos - 1) % 5] END AS test FROM (
  SELECT rel_path, [real, 'test_' || s || e, s || '_test' || e, s || '.test' || e, s || '.spec' || e] AS names,
    list_concat([folder], list_transform(['tests', 'test', '__tests__', 'spec', 'specs'], lambda x: CASE folder WHEN '' THEN x ELSE folder || '/' || x END), list_transform(['tests', 'test', '__tests__', 'spec', 'specs'], lambda x: CASE inn WHEN '' THEN x ELSE x || '/' || inn END)) AS dirs
  FROM (SELECT *, regexp_replace(real, '^(.+)\\.[^.]+$', '\\1') AS s, regexp_extract(real, '^.+(\\.[^.]+)$', 1) AS e, regexp_replace(folder, '^(app|lib|source|src)(/|$)', '') AS inn, test FROM kinds WHERE NOT test)))"""


@query("j6_related_tests", f"WITH {PARTS}, kinds AS MATERIALIZED (SELECT *, {TEST} AS test FROM parts), {RELATED}, hit AS (SELECT source, k.rel_path AS test, min(pos) AS pos FROM cand c JOIN kinds k ON c.test = k.rel_path AND k.test AND k.rel_path <> c.source GROUP BY 1, 2) SELECT source, list(test ORDER BY pos) AS tests FROM hit GROUP BY 1")
def related(spark, d):
    from graphloom.operators.related import related_tests

    return related_tests(T.files(spark, d).select("rel_path")).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "test"))), lambda x: x["test"]).alias("tests"))


@query("j8_related_sources", f"WITH {PARTS}, kinds AS MATERIALIZED (SELECT *, {TEST} AS test FROM parts), {RELATED}, hit AS (SELECT DISTINCT source, k.rel_path AS test FROM cand c JOIN kinds k ON c.test = k.rel_path AND k.test AND k.rel_path <> c.source) SELECT test, list_sort(list(source)) AS sources FROM hit GROUP BY 1")
def related_sources(spark, d):
    from graphloom.operators.related import related_tests

    return related_tests(T.files(spark, d).select("rel_path")).groupBy("test").agg(F.sort_array(F.collect_set("source")).alias("sources"))
