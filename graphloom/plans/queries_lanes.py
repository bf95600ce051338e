"""Queries of lanes, reasons, content signals, summaries, diffs and set operations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import content as C
from graphloom.functions import paths as P
from graphloom.operators import graph as G
from graphloom.operators import hunks as H
from graphloom.operators import lanes as L
from graphloom.operators import search as X
from graphloom.sources import tables as T

from .queries_graph import PARTS, SIDES, _list, scored

Q: dict = {}
SQL: dict[str, str] = {}
MAX = 40


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ORDER = "n_changed = 0, coalesce(hunk, 999), -n_changed, distance, -(3 * is_test::INT + 2 * is_api::INT + 2 * is_entry::INT + is_important::INT + (summary_kind IS NOT NULL)::INT), path"
TOP = f"{T.IMPACT_SQL}, top AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {ORDER})::INTEGER AS position FROM impact ORDER BY {ORDER} LIMIT {MAX})"
SUGGEST = f"""{TOP}, sug AS MATERIALIZED (SELECT * FROM (
  SELECT 0 AS priority, 'review_test' AS kind, path AS target, seed, path_length FROM top WHERE is_test
  UNION ALL SELECT 1, 'review_public_api', path, seed, path_length FROM top WHERE is_api
  UNION ALL SELECT 1, 'verify_entrypoint', path, seed, path_length FROM top WHERE is_entry
  UNION ALL SELECT 2, 'review_config', path, seed, path_length FROM top WHERE summary_kind = 'config'
  UNION ALL SELECT 3, 'read_doc', path, seed, path_length FROM top WHERE summary_kind = 'doc'
  UNION ALL SELECT 2, 'inspect_neighbor', path, seed, path_length FROM top WHERE distance = 1 AND NOT is_test
  UNION ALL SELECT 2, 'follow_symbols', path, seed, path_length FROM top WHERE len(boundary) > 0
  UNION ALL SELECT CASE WHEN hunk = 0 THEN 0 ELSE 1 END, 'review_changed_symbol_boundary', path, seed, path_length FROM top WHERE len(changed) > 0)
  ORDER BY priority, path_length, target, kind LIMIT 30)"""
ACTIONS = f"""{SUGGEST}, act AS MATERIALIZED (SELECT CASE a WHEN 'open_changed_boundary' THEN 0 WHEN 'run_nearby_test' THEN CASE WHEN distance = 1 THEN 0 ELSE 1 END WHEN 'check_config_assumption' THEN 1 ELSE 2 END AS priority, a AS kind, target,
  CASE WHEN is_test THEN 'test' WHEN summary_kind = 'config' THEN 'config' WHEN is_api THEN 'public_api' WHEN is_entry THEN 'entrypoint' WHEN a = 'open_direct_neighbor' THEN 'neighbor' ELSE 'boundary' END AS target_role,
  round(greatest(least(CASE a WHEN 'open_changed_boundary' THEN 90 WHEN 'run_nearby_test' THEN 82 WHEN 'check_config_assumption' THEN 64 ELSE 72 END - 5 * (distance - 1)
    + CASE WHEN hunk = 0 THEN 5 WHEN hunk = 1 THEN 3 WHEN hunk >= 3 THEN -4 ELSE 0 END
    + CASE WHEN is_test AND a = 'run_nearby_test' THEN 4 ELSE 0 END + CASE WHEN summary_kind = 'config' AND a = 'check_config_assumption' THEN 4 ELSE 0 END
    + CASE WHEN is_api AND a = 'open_changed_boundary' THEN 3 ELSE 0 END + CASE WHEN is_entry AND a = 'open_direct_neighbor' THEN 2 ELSE 0 END, 98), 15) / 100.0, 2)::DOUBLE AS confidence,
  CASE WHEN a IN ('open_changed_boundary', 'run_nearby_test') THEN CASE WHEN len(changed) > 0 THEN changed ELSE boundary[1:1] END ELSE boundary END[1:3] AS focus_symbols, seed, path_length, changed
  FROM (SELECT s.*, t.* EXCLUDE (seed, path_length), CASE s.kind WHEN 'review_changed_symbol_boundary' THEN 'open_changed_boundary' WHEN 'review_test' THEN 'run_nearby_test' WHEN 'review_config' THEN 'check_config_assumption' WHEN 'inspect_neighbor' THEN CASE WHEN distance = 1 THEN 'open_direct_neighbor' END END AS a FROM sug s JOIN top t ON s.target = t.path) WHERE a IS NOT NULL
  ORDER BY priority, confidence DESC, path_length, target, kind LIMIT 12)"""


def top(spark, d) -> DataFrame:
    return L.top_impact(T.impact(spark, d), MAX)


def suggested(spark, d) -> DataFrame:
    return L.suggestions(top(spark, d), 30)


def actions(spark, d) -> DataFrame:
    return L.quick_actions(top(spark, d), suggested(spark, d), 12)


@query("t5_impact_order", f"WITH {TOP} SELECT position, path, seed, distance FROM top")
def impact_order(spark, d):
    return top(spark, d).select("position", "path", "seed", "distance")


@query("l2_suggestions", f"WITH {SUGGEST} SELECT * FROM sug")
def suggestions(spark, d):
    return suggested(spark, d)


@query("l3_quick_actions", f"WITH {ACTIONS} SELECT priority, kind, target, target_role, confidence, focus_symbols, seed, path_length FROM act")
def quick_actions(spark, d):
    return actions(spark, d).drop("changed_symbols")


CANDIDATES = f"""{ACTIONS}, cnd AS MATERIALIZED (SELECT target AS path, target_role, priority, confidence, focus_symbols[1] AS symbol, seed, path_length, kind AS source_action,
  list_position(['boundary', 'public_api', 'entrypoint', 'config', 'test', 'neighbor'], target_role) AS o FROM act
  QUALIFY row_number() OVER (PARTITION BY target, focus_symbols[1], target_role ORDER BY priority, confidence DESC, kind) = 1 ORDER BY priority, confidence DESC, o, path_length, path, symbol LIMIT 8)"""


@query("l10_edit_candidates", f"WITH {CANDIDATES} SELECT path, target_role, priority, confidence, symbol, seed, path_length, source_action FROM cnd")
def edit_candidates(spark, d):
    return L.edit_candidates(actions(spark, d)).drop("reason")


@query("l12_edit_plan", f"WITH {CANDIDATES}, f AS (SELECT *, row_number() OVER (ORDER BY priority, confidence DESC, path_length, target, kind)::INTEGER AS step FROM act QUALIFY step <= 4) SELECT step, f.kind, f.target, coalesce(list(c.path) FILTER (c.path IS NOT NULL), []) AS candidates FROM f LEFT JOIN cnd c ON c.source_action = f.kind AND c.path = f.target GROUP BY 1, 2, 3")
def edit_plan(spark, d):
    a = actions(spark, d)
    return L.edit_plan(a, L.edit_candidates(a)).drop("title")


@query("a9_shared_symbols", f"WITH {T.IMPACT_SQL}, r AS (SELECT path, seed, distance, CASE WHEN list_contains(changed, name) THEN hunk END AS h, name FROM (SELECT *, unnest(boundary) AS name FROM impact)), g AS (SELECT name, list_sort(list(DISTINCT path)) AS target_files, list_sort(list(DISTINCT seed)) AS seed_files, min(distance) AS closest_distance, min(h) AS closest_changed_hunk_distance FROM r GROUP BY 1) SELECT name, target_files, seed_files, len(target_files)::INTEGER AS target_count, closest_distance, name IN ('type_1', 'type_4') AS is_changed_seed_symbol, closest_changed_hunk_distance FROM g ORDER BY is_changed_seed_symbol DESC, coalesce(closest_changed_hunk_distance, 999), target_count DESC, closest_distance, lower(name), name LIMIT 12")
def shared_symbols(spark, d):
    return L.shared_symbols(T.impact(spark, d), spark.createDataFrame([("type_1",), ("type_4",)], "symbol string"))


CLUSTERS = "cl AS MATERIALIZED (SELECT seed, 'nearby' AS kind, list_sort(list(DISTINCT path))[1:6] AS paths, []::VARCHAR[] AS covers, min(distance) AS closest_distance, list_sort(list_distinct(flatten(list(boundary))))[1:5] AS focus_symbols FROM impact WHERE is_test GROUP BY 1 ORDER BY closest_distance, seed LIMIT 6)"


@query("a10_test_clusters", f"WITH {T.IMPACT_SQL}, {CLUSTERS} SELECT * FROM cl")
def test_clusters(spark, d):
    return L.test_clusters(T.impact(spark, d))


@query(
    "l16_review_focus",
    f"""WITH {ACTIONS}, {CLUSTERS}, e AS (
    SELECT 0 AS priority, 'review_changed_public_api' AS kind, path AS target, 'public_api' AS target_role, 0.94::DOUBLE AS confidence, 0 AS o FROM top WHERE is_api AND distance = 2
    UNION ALL SELECT 0, 'review_changed_entrypoint', path, 'entrypoint', 0.9, 0 FROM top WHERE is_entry AND distance = 2
    UNION ALL SELECT 1, 'review_changed_config', path, 'config', 0.82, 0 FROM top WHERE summary_kind = 'config' AND distance = 2
    UNION ALL SELECT 1, 'review_changed_test', path, 'test', 0.84, 0 FROM top WHERE is_test AND distance = 2
    UNION ALL SELECT priority + 2, kind, target, target_role, confidence, 1 FROM act
    UNION ALL SELECT 4, 'review_nearby_test_cluster', paths[1], 'test', 0.74, 2 FROM cl),
    u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY kind, target ORDER BY o, priority, confidence DESC) = 1)
    SELECT priority, kind, target, target_role, confidence FROM u ORDER BY priority, list_position(['public_api', 'entrypoint', 'config', 'test', 'boundary', 'neighbor'], target_role), confidence DESC, target, kind LIMIT 25""",
)
def review_focus(spark, d):
    return L.review_focus(top(spark, d).filter("distance = 2"), actions(spark, d), L.test_clusters(T.impact(spark, d)), 25)


@query("l15_review_roles", f"WITH {T.IMPACT_SQL} SELECT path, CASE WHEN is_test THEN 'test' WHEN summary_kind = 'config' THEN 'config' WHEN is_api THEN 'public_api' WHEN is_entry THEN 'entrypoint' ELSE 'boundary' END AS role FROM impact")
def review_roles(spark, d):
    return T.impact(spark, d).select("path", L.review_role().alias("role"))


def _reason_rows(spark, d) -> DataFrame:
    """Documents with every column that reasons need, by fixed rules."""
    n = F.col("doc_id")
    none = F.array().cast("array<string>")
    some = lambda cond, *x: F.when(cond, F.array(*map(F.lit, x))).otherwise(none)
    docs = T.table(spark, d, "documents").select("doc_id", "lang")
    return docs.select(
        "doc_id", F.when(n % 9 < 3, n % 9).alias("changed_distance"), some(n % 2 == 0, "a.py").alias("related_changed_files"), (n % 5 == 0).alias("is_chat"), (n % 7 == 0).alias("is_mentioned"),
        some(n % 4 == 0, "x", "y").alias("entry_signals"), some(n % 6 == 0, "z").alias("api_signals"), some(n % 8 == 1, "s", "t", "u").alias("summary_items"), F.when(n % 3 == 0, "doc").otherwise("config").alias("summary_kind"),
        F.array("lang").alias("path_terms"), none.alias("symbol_terms"), some(n % 10 == 0, "t.py").alias("related_tests"), (n % 11 == 0).alias("is_test"), some(n % 2 == 1, "s.py").alias("related_sources"),
        some(n % 12 == 0, "i", "j", "k", "l").alias("mentioned_identifiers"), (n % 13 == 0).alias("is_important"), some(n % 14 == 0, "p").alias("inbound"), F.lit(1).alias("n_in"), none.alias("outbound"), F.lit(0).alias("n_out"), (n % 3).alias("definition_count"), (n % 4).alias("reference_count"),
    )


@query(
    "r12_ranking_reasons",
    """WITH n AS (SELECT doc_id, doc_id % 9 AS d9, * EXCLUDE (doc_id) FROM documents) SELECT doc_id, list_filter([
    CASE WHEN d9 = 0 THEN 'changed_file|Changed in the current selection.' END,
    CASE WHEN d9 IN (1, 2) THEN concat('changed_neighbor|At distance ', d9, ' from ', CASE doc_id % 2 WHEN 0 THEN 'a.py' ELSE 'changed files' END, '.') END,
    CASE WHEN doc_id % 5 = 0 THEN 'chat_file|In the edit context.' END, CASE WHEN doc_id % 7 = 0 THEN 'mentioned_file|Mentioned by the caller.' END,
    CASE WHEN doc_id % 4 = 0 THEN 'entrypoint_file|Entrypoint by x, y.' END, CASE WHEN doc_id % 6 = 0 THEN 'public_api_file|Public API by z.' END,
    CASE WHEN doc_id % 8 = 1 THEN concat(CASE doc_id % 3 WHEN 0 THEN 'doc' ELSE 'config' END, '_summary|Summary: s, t.') END,
    concat('query_path_match|Path has ', lang, '.'), CASE WHEN doc_id % 10 = 0 THEN 'related_tests|Tested by t.py.' END,
    CASE WHEN doc_id % 11 = 0 AND doc_id % 2 = 1 THEN 'related_source|Tests s.py.' END, CASE WHEN doc_id % 12 = 0 THEN 'mentioned_identifier|Has i, j, k, +1 more.' END,
    CASE WHEN doc_id % 13 = 0 THEN 'important_file|Important document or configuration.' END, CASE WHEN doc_id % 14 = 0 THEN 'referenced_by|Referenced by 1: p.' END,
    CASE WHEN doc_id % 3 > 0 THEN concat('definitions|Defines ', doc_id % 3, ' symbols.') END, CASE WHEN doc_id % 4 > 0 THEN concat('identifier_references|Has ', doc_id % 4, ' references.') END
    ], lambda x: x IS NOT NULL) AS reasons FROM n""",
)
def ranking_reasons(spark, d):
    rows = _reason_rows(spark, d)
    return rows.select("doc_id", F.transform(L.reasons(rows), lambda r: F.concat_ws("|", r["code"], r["message"])).alias("reasons"))


@query("a11_reason_histogram", "WITH n AS (SELECT doc_id AS n FROM documents) SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n % 9 = 0 THEN 'changed_file' END, CASE WHEN n % 9 IN (1, 2) THEN 'changed_neighbor' END, CASE WHEN n % 5 = 0 THEN 'chat_file' END, CASE WHEN n % 7 = 0 THEN 'mentioned_file' END, CASE WHEN n % 4 = 0 THEN 'entrypoint_file' END, CASE WHEN n % 6 = 0 THEN 'public_api_file' END, CASE WHEN n % 8 = 1 THEN CASE n % 3 WHEN 0 THEN 'doc_summary' ELSE 'config_summary' END END, 'query_path_match', CASE WHEN n % 10 = 0 THEN 'related_tests' END, CASE WHEN n % 11 = 0 AND n % 2 = 1 THEN 'related_source' END, CASE WHEN n % 12 = 0 THEN 'mentioned_identifier' END, CASE WHEN n % 13 = 0 THEN 'important_file' END, CASE WHEN n % 14 = 0 THEN 'referenced_by' END, CASE WHEN n % 3 > 0 THEN 'definitions' END, CASE WHEN n % 4 > 0 THEN 'identifier_references' END], lambda x: x IS NOT NULL)) AS code FROM n) GROUP BY 1")
def reason_histogram(spark, d):
    rows = _reason_rows(spark, d)
    return X.reason_histogram(rows.select(L.reasons(rows).alias("reasons")))


@query("k10_report_shaping", "SELECT rel_path, rank FROM (SELECT 'doc/' || doc_id AS rel_path, n_chars AS rank FROM documents) ORDER BY rank DESC, rel_path LIMIT 20")
def report_shaping(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), F.col("n_chars").alias("rank"))
    return X.shaped(docs).select("rel_path", F.get_json_object("payload", "$.rank").cast("long").alias("rank"))


SIGNAL = ", ".join(f"('entry', {k}, '{n}', '{r.replace(chr(39), chr(39) * 2)}')" for k, (n, r) in enumerate(P.ENTRY_SIGNALS)) + ", " + ", ".join(f"('api', {k + 5}, '{n}', '{r.replace(chr(39), chr(39) * 2)}')" for k, (n, r) in enumerate(P.API_SIGNALS))
#: Lines of code, one per page and sample, so that signals occur.
CODE = ("if __name__ == \"__main__\":", "func main() {", "app.listen(80)", "import argparse; argparse.ArgumentParser()", "app = Flask(__name__)", "router.get(\"/x\")", "bp = Blueprint(\"b\")", "export const a = 1", "from .core import x", "urlpatterns = []", "plain line", "")
_codes = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in CODE) + "]"


def code_files(spark, d) -> DataFrame:
    lines = F.array(*map(F.lit, CODE))
    n = F.col("page_id")
    return T.files(spark, d).select("rel_path", F.array_join(F.transform(F.sequence(F.lit(0), (n % 13).cast("int")), lambda k: F.element_at(lines, ((k * 5 + n) % len(CODE) + 1).cast("int"))), "\n").alias("text"))


CODE_FILES = f"{T.FILES}, code AS MATERIALIZED (SELECT rel_path, unnest(generate_series(1, 1 + page_id % 13))::INTEGER AS line, page_id FROM files), lines AS MATERIALIZED (SELECT rel_path, line, {_codes}[1 + ((line - 1) * 5 + page_id) % {len(CODE)}] AS body FROM code)"


@query("p8_content_signals", f"WITH {CODE_FILES}, s AS (SELECT rel_path, line, kind, k, name FROM lines JOIN (VALUES {SIGNAL}) v(kind, k, name, r) ON regexp_matches(body, r)), f AS (SELECT rel_path, kind, name, min((line, k)) AS first_at FROM s GROUP BY 1, 2, 3) SELECT fi.rel_path, coalesce(list(name ORDER BY first_at) FILTER (kind = 'entry'), []) AS entry_signals, coalesce(list(name ORDER BY first_at) FILTER (kind = 'api'), []) AS api_signals FROM files fi LEFT JOIN f ON fi.rel_path = f.rel_path GROUP BY 1")
def content_signals(spark, d):
    return C.runtime_roles(code_files(spark, d)).select("rel_path", "entry_signals", "api_signals")


@query("f12_doc_tags", f"WITH {CODE_FILES}, t AS (SELECT *, trim(body) AS b FROM lines WHERE trim(body) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY line) AS k, row_number() OVER (PARTITION BY rel_path, c ORDER BY line) AS kc, max(c::INT) OVER (PARTITION BY rel_path) AS has FROM (SELECT *, line = 1 OR starts_with(b, '#') OR starts_with(b, '[') OR starts_with(b, '{{') OR contains(b, '=') OR contains(b, ':') AS c FROM t)) SELECT rel_path, line FROM r WHERE CASE WHEN has = 1 THEN c AND kc <= 6 ELSE k <= 4 END")
def doc_tags(spark, d):
    return C.synthetic_tags(code_files(spark, d), "doc").select("rel_path", "line")


@query("f13_test_tags", f"WITH {CODE_FILES}, t AS (SELECT *, lower(trim(body)) AS b FROM lines WHERE trim(body) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY line) AS k, row_number() OVER (PARTITION BY rel_path, c ORDER BY line) AS kc, max(c::INT) OVER (PARTITION BY rel_path) AS has FROM (SELECT *, regexp_matches(b, 'def test_|class test|it\\(|test\\(|describe\\(|scenario\\(') AS c FROM t)) SELECT rel_path, line FROM r WHERE CASE WHEN has = 1 THEN c AND kc <= 6 ELSE k <= 4 END")
def test_tags(spark, d):
    return C.synthetic_tags(code_files(spark, d), "test").select("rel_path", "line")


DIFF = "concat('diff --git a/f', event_id % 50, ' b/f', event_id % 50, chr(10), '--- a/f', event_id % 50, chr(10), CASE WHEN event_id % 17 = 0 THEN '+++ /dev/null' ELSE concat('+++ b/f', event_id % 50, '.py') END, chr(10), '@@ -1,2 +', user_id % 90 + 1, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',0' ELSE ',4' END, ' @@ x', chr(10), '+ y')"


@query("s14_diff_parse", f"SELECT DISTINCT concat('f', event_id % 50, '.py') AS rel_path, unnest(generate_series(user_id % 90 + 1, user_id % 90 + CASE event_id % 3 WHEN 0 THEN 1 ELSE 4 END))::INTEGER AS line FROM events WHERE event_id % 17 <> 0 AND event_id % 3 <> 1")
def diff_parse(spark, d):
    return H.diff_lines(T.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(DIFF).alias("text")))


@query("s15_untracked_lines", "WITH f AS (SELECT DISTINCT event_type AS rel_path, event_id::INTEGER AS line FROM events WHERE event_type IN ('click', 'view')), u AS (SELECT event_type AS rel_path, count(*)::INTEGER AS n FROM events GROUP BY 1) SELECT rel_path, line FROM f UNION SELECT rel_path, unnest(generate_series(1, n))::INTEGER FROM u WHERE rel_path NOT IN (SELECT rel_path FROM f)")
def untracked(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_type").alias("rel_path"), F.col("event_id").cast("int").alias("line"))
    return H.with_untracked(e.filter("rel_path in ('click', 'view')"), e.groupBy("rel_path").agg(F.count("*").cast("int").alias("n_lines")))


@query("f9_dependency_names", "SELECT doc_id, regexp_extract(x, '^([A-Za-z0-9_.-]+)', 1) AS name FROM (SELECT doc_id, concat(lang, '.', source, '[extra]>=1.', doc_id, '; python_version > \"3\"') AS x FROM documents)")
def dependency_names(spark, d):
    docs = T.table(spark, d, "documents")
    return docs.select("doc_id", C.dependency_name(F.concat("lang", F.lit("."), "source", F.lit("[extra]>=1."), "doc_id", F.lit('; python_version > "3"'))).alias("name"))


@query("f11_shorten", "SELECT doc_id, CASE WHEN length(s) > 60 THEN rtrim(s[1:57]) || '...' ELSE s END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def shorten(spark, d):
    return T.table(spark, d, "documents").select("doc_id", C.shorten(F.col("text"), 60).alias("short"))


@query("u1_first_seen_union", "SELECT rel_path, min(o) AS origin FROM (SELECT 'doc/' || doc_id AS rel_path, 0 AS o FROM documents WHERE lang = 'fr' UNION ALL SELECT 'doc/' || doc_id, 1 FROM documents WHERE source < 'src5') GROUP BY 1")
def first_seen(spark, d):
    from graphloom.operators.sets import first_seen_union

    docs = T.table(spark, d, "documents").withColumn("rel_path", F.concat(F.lit("doc/"), F.col("doc_id")))
    return first_seen_union(docs.filter("lang = 'fr'").select("rel_path"), docs.filter("source < 'src5'").select("rel_path"))


@query("u2_other_minus_chat", "SELECT 'doc/' || doc_id AS rel_path FROM documents EXCEPT SELECT 'doc/' || doc_id FROM labels")
def minus(spark, d):
    from graphloom.operators.sets import minus as f

    path = F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path")
    return f(T.table(spark, d, "documents").select(path), T.table(spark, d, "labels").select(path))


@query("u3_changed_in_scope", "SELECT 'doc/' || doc_id AS rel_path FROM documents INTERSECT SELECT 'doc/' || doc_id FROM labels")
def in_scope(spark, d):
    from graphloom.operators.sets import in_scope as f

    path = F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path")
    return f(T.table(spark, d, "documents").select(path), T.table(spark, d, "labels").select(path))


@query("k1_map_sections", "SELECT rel_path, concat(rel_path, ':', chr(10), '(Rank value: ', printf('%.4f', rank), ')', chr(10), chr(10), '   1: ', first_line) AS section FROM (SELECT 'doc/' || doc_id AS rel_path, n_chars / 7.0::DOUBLE AS rank, string_split(text, chr(10))[1] AS first_line FROM documents)")
def map_sections(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), (F.col("n_chars") / 7.0).alias("rank"), "text")
    return C.map_sections(docs, docs.select("rel_path", F.array(F.lit(1)).alias("lines_of_interest")))
