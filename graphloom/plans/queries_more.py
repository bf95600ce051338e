"""Queries of tag extraction, tag ranks, budgets, map sections, anchors and commands, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import content
from graphloom.functions.summaries import summaries
from graphloom.operators import anchors as A
from graphloom.operators import budget as B
from graphloom.operators import graph as G
from graphloom.operators import related as R
from graphloom.sources import tables as T
from graphloom.sources.tags import extract_tags

from .queries_graph import SIDES
from .queries_tree import SUMMARIES, written
from .session import saved

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def spark_sql(text: str) -> str:
    return text.replace("chr(10)", "char(10)").replace("::VARCHAR", "").replace("[]", "array()")


# Sources in four languages whose tags are known
SOURCES = (
    "CASE page_id % 16 "
    "WHEN 0 THEN concat('import os', chr(10), 'class C', page_id, '(B):', chr(10), '    def run', page_id, '(self, x):', chr(10), '        return g', page_id, '(x)', chr(10), chr(10), 'def f', page_id, '():', chr(10), '    C', page_id, '().run', page_id, '(1)', chr(10)) "
    "WHEN 2 THEN concat('export function f', page_id, '(x: number) {', chr(10), '  return 1;', chr(10), '}', chr(10), 'export class C', page_id, ' {}', chr(10)) "
    "WHEN 8 THEN 'def broken(:' "
    "WHEN 11 THEN concat('function f', page_id, '(x) {', chr(10), '  return g', page_id, '(x);', chr(10), '}', chr(10)) ELSE 'x' END"
)


@query(
    "s6_extract_tags",
    f"""WITH f AS (SELECT page_id % 16 AS k, page_id AS i, {T.PATH} AS rel_path FROM pages),
    t AS (SELECT * FROM (VALUES (0, 2, 'C', 'def'), (0, 3, 'run', 'def'), (0, 4, 'g', 'ref'), (0, 6, 'f', 'def'), (0, 7, 'C', 'ref'), (0, 7, 'run', 'ref'), (2, 1, 'f', 'def'), (2, 4, 'C', 'def'), (11, 1, 'f', 'def'), (11, 2, 'g', 'ref')) v(k, line, name, kind))
    SELECT rel_path, line, name || i AS name, kind, false AS failed FROM f JOIN t USING (k) UNION ALL SELECT rel_path, NULL, NULL, NULL, true FROM f WHERE k = 8""",
)
def extracted(spark, d):
    return extract_tags(written(spark, d, SOURCES)).select("rel_path", "line", "name", "kind", F.col("error").isNotNull().alias("failed"))


# F5, F7, F8
CONFIG_PATH = "CASE page_id % 4 WHEN 0 THEN concat('p', page_id, '/pyproject.toml') WHEN 1 THEN concat('d', page_id, '/Dockerfile') WHEN 2 THEN concat('r', page_id, '/requirements.in') ELSE concat('x', page_id, '/setup.toml') END"
CONFIG_TEXT = (
    "CASE page_id % 4 WHEN 0 THEN concat('[project]', chr(10), 'name = \"p', page_id, '\"', chr(10), 'version = \"0.', page_id, '\"', chr(10), 'dependencies = [\"numpy>=1\", \"rich[all]; python_version > \\u00273\\u0027\"]', chr(10), '[tool.pytest]', chr(10), 'x = 1', chr(10)) "
    "WHEN 1 THEN concat('# base', chr(10), 'FROM base:', page_id, chr(10), 'EXPOSE 80', chr(10), 'FROM later', chr(10), 'CMD run', chr(10)) "
    "WHEN 2 THEN concat('# none', chr(10), 'numpy>=1', chr(10), '-r other.in', chr(10), 'pkg', page_id, '==2', chr(10)) ELSE 'name = 1' END"
)


@query(
    "f5_f8_config_summaries",
    f"""SELECT {CONFIG_PATH} AS rel_path, CASE WHEN page_id % 4 < 3 THEN 'config' END AS summary_kind,
    CASE page_id % 4 WHEN 0 THEN [concat('Project: p', page_id, '@0.', page_id), 'Dependencies: numpy, rich', 'Tooling: pytest'] WHEN 1 THEN [concat('FROM: base:', page_id), 'EXPOSE: 80', 'CMD: run']
      WHEN 2 THEN [concat('Dependencies: numpy, pkg', page_id)] ELSE []::VARCHAR[] END AS summary_items FROM pages""",
)
def config_summaries(spark, d):
    pages = T.table(spark, d, "pages")
    return summaries(pages.select(F.expr(CONFIG_PATH).alias("rel_path"), F.expr(spark_sql(CONFIG_TEXT)).alias("text")))


# Requests and scopes by document
RAW = "CASE doc_id % 11 WHEN 0 THEN 'auto' WHEN 1 THEN ' LARGE ' WHEN 2 THEN '123' WHEN 3 THEN '-5' WHEN 4 THEN 'foo' WHEN 5 THEN '' WHEN 7 THEN 'dynamic' WHEN 8 THEN 'xlarge' WHEN 9 THEN '1_000' WHEN 10 THEN 'small' END"
SCOPE = {
    "files": "CASE doc_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 300 WHEN 3 THEN 1500 WHEN 4 THEN 6000 ELSE 41 END",
    "chat": "CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END", "mentioned": "doc_id % 5", "terms": "doc_id % 9", "changed": "(doc_id % 2) * 3", "depth": "doc_id % 3",
}
WINDOW = "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 9000 WHEN 2 THEN 4000 WHEN 3 THEN 0 ELSE 128000 END"
REQUESTS = f"""s AS MATERIALIZED (SELECT doc_id, {RAW} AS given, {', '.join(f'{v} AS {k}' for k, v in SCOPE.items())}, {WINDOW} AS wide FROM documents),
q AS MATERIALIZED (SELECT *, CASE doc_id % 11 WHEN 0 THEN 'auto' WHEN 7 THEN 'auto' WHEN 1 THEN 'ai_guided' WHEN 8 THEN 'ai_guided' WHEN 10 THEN 'ai_guided' ELSE 'fixed' END AS mode,
  CASE doc_id % 11 WHEN 1 THEN 'large' WHEN 8 THEN 'xlarge' WHEN 10 THEN 'small' END AS hint,
  CASE doc_id % 11 WHEN 2 THEN 123 WHEN 3 THEN 8192 WHEN 4 THEN 8192 WHEN 5 THEN 8192 WHEN 6 THEN 8192 WHEN 9 THEN 1000 END::BIGINT AS tokens FROM s),
p AS MATERIALIZED (SELECT *, (CASE WHEN files >= 5000 THEN 3 WHEN files >= 1000 THEN 2 WHEN files >= 250 THEN 1 WHEN files <= 40 THEN -1 ELSE 0 END) + (terms >= 3)::INT + (terms >= 7)::INT + (mentioned >= 3)::INT
  - (changed > 0)::INT + (changed > 0 AND depth > 0)::INT - 2 * (chat > 0)::INT AS score FROM q),
a AS MATERIALIZED (SELECT *, CASE WHEN score <= -1 THEN 'small' WHEN score <= 1 THEN 'medium' WHEN score <= 3 THEN 'large' ELSE 'xlarge' END AS auto_preset FROM p)"""


def requests(spark, d) -> tuple[DataFrame, B.Scope]:
    rows = T.table(spark, d, "documents").selectExpr("doc_id", f"{RAW} AS given", *[f"{v} AS {k}" for k, v in SCOPE.items()], f"{WINDOW} AS wide")
    return rows.withColumn("r", B.request_columns(F.col("given"))), B.Scope(*[F.col(c) for c in SCOPE])


@query(
    "f15_budget_requests",
    f"""WITH {REQUESTS} SELECT doc_id, mode, CASE doc_id % 11 WHEN 5 THEN '8192' WHEN 6 THEN '8192' ELSE lower(trim(given)) END AS raw, tokens, hint, doc_id % 11 IN (3, 4) AS ignored FROM q""",
)
def budget_requests(spark, d):
    return requests(spark, d)[0].select("doc_id", "r.*")


@query("f16_auto_presets", f"WITH {REQUESTS} SELECT doc_id, auto_preset AS preset FROM a")
def auto_presets(spark, d):
    rows, scope = requests(spark, d)
    return rows.select("doc_id", B.preset_column(scope)["preset"].alias("preset"))


@query(
    "f17_resolved_budgets",
    f"""WITH {REQUESTS}, o AS (SELECT *, CASE mode WHEN 'auto' THEN auto_preset WHEN 'ai_guided' THEN CASE WHEN files >= 5000 AND chat = 0 THEN CASE hint WHEN 'small' THEN 'medium' ELSE 'xlarge' END
      WHEN chat > 0 THEN CASE hint WHEN 'xlarge' THEN 'large' WHEN 'large' THEN 'medium' ELSE 'small' END ELSE hint END END AS preset FROM a),
    n AS (SELECT *, CASE preset WHEN 'small' THEN 2048 WHEN 'medium' THEN 4096 WHEN 'large' THEN 8192 WHEN 'xlarge' THEN 12288 END AS own FROM o)
    SELECT doc_id, preset, (CASE WHEN mode = 'fixed' THEN tokens WHEN chat = 0 AND coalesce(wide, 0) <> 0 THEN greatest(own, least(own * 8, greatest(0, wide - 1024), 16384)) ELSE own END)::BIGINT AS tokens FROM n""",
)
def resolved_budgets(spark, d):
    rows, scope = requests(spark, d)
    return rows.select("doc_id", B.resolved_column(F.col("r"), scope, F.col("wide")).alias("x")).select("doc_id", "x.*")


# K1-K4
SECTIONS = f"""k AS MATERIALIZED (SELECT page_id, {T.PATH} AS rel_path, page_id / 1000.0::DOUBLE AS rank, {SUMMARIES} AS text FROM pages),
z AS MATERIALIZED (SELECT page_id, rel_path, rank, string_split(text, chr(10)) AS l,
  CASE page_id % 16 WHEN 9 THEN concat('(Config Highlights)', chr(10), '- Package: p', page_id, '@1.2', chr(10), '- Scripts: build, test')
    WHEN 6 THEN concat('(Config Highlights)', chr(10), '- Workflow: CI ', page_id, chr(10), '- Triggers: push, pull_request', chr(10), '- Jobs: test')
    WHEN 13 THEN concat('(Doc Highlights)', chr(10), '- Overview: numpy>=1') WHEN 15 THEN concat('(Doc Highlights)', chr(10), '- Heading: Guide ', page_id, chr(10), '- Overview: Some text here')
    WHEN 5 THEN concat('(Doc Highlights)', chr(10), '- Overview: plain') END AS block FROM k),
y AS MATERIALIZED (SELECT page_id, rel_path, rank, concat_ws(chr(10) || chr(10), concat(rel_path, ':', chr(10), '(Rank value: ', format('{{:.4f}}', rank), ')'), block, '   1: ' || l[1], CASE WHEN len(l) >= 4 THEN '' END) AS head,
  CASE WHEN len(l) >= 4 THEN concat(chr(10), '   3: ', l[3]) ELSE '' END AS third, block, l FROM z),
x AS MATERIALIZED (SELECT page_id, rel_path, rank, concat_ws(chr(10) || chr(10), concat(rel_path, ':', chr(10), '(Rank value: ', format('{{:.4f}}', rank), ')'), block, concat('   1: ', l[1], third)) AS section FROM y)"""


def sections(spark, d) -> DataFrame:
    files = written(spark, d, SUMMARIES).join(T.table(spark, d, "pages").select(F.expr(T.PATH).alias("rel_path"), (F.col("page_id") / 1000).alias("rank"), "page_id"), "rel_path")
    interest = summaries(files).withColumn("lines_of_interest", F.array(F.lit(1), F.lit(3), F.lit(99)))
    return content.map_sections(files, interest).join(files.select("rel_path", "rank", "page_id"), "rel_path")


@query("k4_map_sections", f"WITH {SECTIONS} SELECT rel_path, section FROM x")
def map_sections(spark, d):
    return sections(spark, d).select("rel_path", "section")


@query("k2_joined_sections", f"WITH {SECTIONS} SELECT page_id % 5 AS part, string_agg(section, chr(10) || chr(10) ORDER BY rank DESC, rel_path) AS map FROM x GROUP BY 1")
def joined(spark, d):
    return sections(spark, d).groupBy((F.col("page_id") % 5).alias("part")).agg(content.joined_sections().alias("map"))


# T3, A12
IDENTIFIERS = ("code", "the", "ation")
RANKED = f"""{T.TAGS}, n AS (SELECT 'doc/' || doc_id AS rel_path, (doc_id % 97 + 1) / 1000.0::DOUBLE AS eff, 1 + (doc_id % 3) * 0.5::DOUBLE AS boost, doc_id % 13 = 0 AS m, doc_id % 17 = 0 AS c FROM documents),
g AS MATERIALIZED (SELECT DISTINCT round(eff * (CASE WHEN name IN {IDENTIFIERS} THEN 10 ELSE 1 END) * (CASE WHEN m THEN 5 ELSE 1 END) * (CASE WHEN c THEN 20 ELSE 1 END) * boost, 9) AS rank, rel_path, line, name, kind FROM tags JOIN n USING (rel_path) WHERE kind = 'def')"""


def ranked(spark, d) -> DataFrame:
    i = F.col("doc_id")
    files = T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), i).alias("rel_path"), ((i % 97 + 1) / 1000).alias("eff"), (1 + (i % 3) * 0.5).alias("boost"), (i % 13 == 0).alias("is_mentioned"), (i % 17 == 0).alias("is_chat"))
    return G.ranked_tags(T.tags(spark, d), files, IDENTIFIERS).withColumn("rank", F.round("rank", 9))


@query("t3_ranked_tags", f"WITH {RANKED} SELECT rank, rel_path, line, name, kind FROM g")
def ranked_tags(spark, d):
    return ranked(spark, d)


@query("a12_tags_by_file", f"WITH {RANKED} SELECT rel_path, max(rank) AS rank, count(*) AS n_tags, list(name ORDER BY rank DESC, line, name)[1:5] AS first_names, list(line ORDER BY rank DESC, line, name)[1:5] AS first_lines FROM g GROUP BY 1")
def tags_by_file(spark, d):
    t = G.tags_by_file(ranked(spark, d))
    return t.select("rel_path", "rank", F.size("tags").cast("long").alias("n_tags"), F.slice(F.transform("tags", lambda x: x["name"]), 1, 5).alias("first_names"), F.slice(F.transform("tags", lambda x: x["line"]), 1, 5).alias("first_lines"))


# A7, G8
@query(
    "a7_boundary_symbols",
    """WITH s AS (SELECT doc_id, unnest(['a' || doc_id % 3, '__related_test__', 'b' || doc_id % 2]) AS x, unnest([1, 2, 3]) AS k, 1 AS p FROM documents
      UNION ALL SELECT doc_id, unnest(['a0', 'c', 'b1', 'd', 'e', 'f', 'g', 'h', 'i']), unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]), 2 FROM documents WHERE doc_id % 2 = 0),
    f AS (SELECT doc_id, x, min((p, k)) AS seen FROM s WHERE NOT starts_with(x, '__') GROUP BY 1, 2) SELECT doc_id, list(x ORDER BY seen)[1:8] AS boundary FROM f GROUP BY 1""",
)
def boundary(spark, d):
    docs, i = T.table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    one = docs.select("doc_id", F.lit(1).alias("position"), F.array(F.concat(F.lit("a"), i % 3), F.lit("__related_test__"), F.concat(F.lit("b"), i % 2)).alias("symbols"))
    two = docs.filter(i % 2 == 0).select("doc_id", F.lit(2).alias("position"), F.array(*map(F.lit, ("a0", "c", "b1", *"defghi"))).alias("symbols"))
    return G.boundary_symbols(one.unionByName(two), ["doc_id"])


@query(
    "g8_flat_hops",
    """WITH s AS (SELECT doc_id, p, unnest(list_transform(range(0, 6 + doc_id % 4), lambda h: h % (p + 4))) AS hop, unnest(range(0, 6 + doc_id % 4)) AS k FROM documents, (VALUES (1), (2), (3)) v(p)),
    f AS (SELECT doc_id, p, hop, min(k) AS k FROM s GROUP BY 1, 2, 3) SELECT doc_id, list(p || '>' || hop ORDER BY p, k)[1:16] AS hops FROM f GROUP BY 1""",
)
def hops(spark, d):
    rows = T.table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position"))
    rows = rows.select("doc_id", "position", F.col("position").cast("string").alias("source"), F.lit("t").alias("target"), F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4 + 5).cast("int")), lambda h: F.struct((h % (F.col("position") + 4)).alias("line"))).alias("hops"))
    return G.flat_hops(rows, ["doc_id"]).select("doc_id", F.transform("hops", lambda h: F.concat(h["source"], F.lit(">"), h["hop"]["line"])).alias("hops"))


# A8, L6-L9
LOCATIONS = f"""{T.TAGS}, w AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) AS r FROM tags GROUP BY 1),
im AS MATERIALIZED (SELECT doc_id, 'doc/' || doc_id AS path, unnest(['doc/0', 'doc/' || doc_id]) AS rel_path, unnest([0, 1]) AS nth FROM documents WHERE doc_id % 7 = 3),
lo AS MATERIALIZED (SELECT path, row_number() OVER (PARTITION BY path ORDER BY nth, name, line, kind) AS k, rel_path, name, line, kind FROM (
  SELECT DISTINCT path, nth, rel_path, name, line, kind FROM im JOIN tags USING (rel_path) JOIN w USING (name) WHERE r <= 2) QUALIFY k <= 12)"""
SNIPPETS = f"""{LOCATIONS}, dt AS MATERIALIZED (SELECT 'doc/' || doc_id AS rel_path, CASE WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text IS NOT NULL),
sn AS MATERIALIZED (SELECT path, k AS position, rel_path AS file, greatest(1, line - 1) AS start_line, least(len(l), line + 1)::INTEGER AS end_line, line AS highlight_line, kind, name AS symbol,
  array_to_string(list_transform(range(greatest(1, line - 1), least(len(l), line + 1) + 1), lambda i: i || ': ' || l[i]), chr(10)) AS excerpt FROM lo JOIN dt USING (rel_path) WHERE k <= 6),
tg AS MATERIALIZED (SELECT doc_id, 'doc/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN (SELECT name FROM w WHERE r = 2) ELSE 'none' END AS changed, doc_id % 4 = 0 OR doc_id % 3 = 0 AS prefer_changed, doc_id % 5 + 1 AS focus FROM documents WHERE doc_id % 7 = 3)"""


def common(spark, d) -> DataFrame:
    """One row: the two commonest names as `boundary`, and the second of them."""
    two = T.tags(spark, d).groupBy("name").count().orderBy(F.desc("count"), "name").limit(2)
    return saved(two.agg(F.sort_array(F.collect_list("name")).alias("boundary"), F.max_by("name", F.struct(-F.col("count"), "name")).alias("second")))


def locations(spark, d, top=None) -> DataFrame:
    tags, i = T.tags(spark, d), F.col("doc_id")
    top = (top or common(spark, d)).select("boundary")
    path = F.concat(F.lit("doc/"), i)
    impact = T.table(spark, d, "documents").filter(i % 7 == 3).select(path.alias("path"), F.array(F.lit("doc/0"), path).alias("path_from_seed")).join(F.broadcast(top))  # one row
    return G.boundary_locations(impact, tags)


def texts(spark, d) -> DataFrame:
    return T.table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), "text")


def targets(spark, d, top=None) -> DataFrame:
    i = F.col("doc_id")
    second = (top or common(spark, d)).select("second")
    rows = T.table(spark, d, "documents").filter(i % 7 == 3).join(F.broadcast(second))  # one row
    return rows.select(F.concat(F.lit("doc/"), i).alias("path"), F.array(F.when(i % 2 == 0, F.col("second")).otherwise("none")).alias("changed"), ((i % 4 == 0) | (i % 3 == 0)).alias("prefer_changed"), F.array((i % 5 + 1).cast("int")).alias("focus_lines"))


@query("a8_boundary_locations", f"WITH {LOCATIONS} SELECT path, k::INTEGER AS k, rel_path, name, line, kind FROM lo")
def located(spark, d):
    return locations(spark, d)


@query("l6_boundary_snippets", f"WITH {SNIPPETS} SELECT path, position::INTEGER AS position, file, start_line, end_line, highlight_line, kind, symbol, excerpt FROM sn")
def snippets(spark, d, top=None):
    return A.boundary_snippets(locations(spark, d, top), texts(spark, d))


@query(
    "l6_target_anchors",
    f"""WITH {SNIPPETS}, sc AS (SELECT sn.*, (CASE WHEN prefer_changed AND symbol = changed THEN 4 ELSE 0 END) + (CASE WHEN file = path THEN 2 ELSE 0 END) + (CASE WHEN highlight_line = focus THEN 1 ELSE 0 END) AS score,
      max(file = path) OVER (PARTITION BY path) AS own FROM sn JOIN tg USING (path))
    SELECT path, file, start_line, end_line, highlight_line, kind, symbol, excerpt FROM sc WHERE own QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, position) = 1""",
)
def target_anchors(spark, d):
    top = common(spark, d)
    return A.target_anchors(targets(spark, d, top), snippets(spark, d, top)).select("path", "anchor.*")


@query(
    "l7_file_anchors",
    f"""WITH {SNIPPETS}, h AS (SELECT path, l, least(focus, len(l))::INTEGER AS mid FROM tg JOIN dt ON path = rel_path)
    SELECT path, path AS file, greatest(1, mid - 1) AS start_line, least(len(l), mid + 1)::INTEGER AS end_line, mid AS highlight_line, 'file' AS kind, string_split(path, '/')[-1] AS symbol,
      array_to_string(list_transform(range(greatest(1, mid - 1), least(len(l), mid + 1) + 1), lambda i: i || ': ' || l[i]), chr(10)) AS excerpt FROM h""",
)
def file_anchors(spark, d):
    return A.file_anchors(targets(spark, d), texts(spark, d)).select("path", "anchor.*")


@query(
    "l8_action_anchors",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 > 0 THEN doc_id % 4 END AS line, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 > 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'doc' || doc_id ELSE 's' END END AS symbol,
    CASE WHEN doc_id % 3 > 0 AND doc_id % 4 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'ref' END END AS kind FROM documents""",
)
def action_anchors(spark, d):
    i = F.col("doc_id")
    file = F.when(i % 3 > 0, F.concat(F.lit("a/doc"), i))
    anchor = F.struct(file.alias("file"), (i % 4).alias("highlight_line"), F.when(i % 5 != 0, "s").alias("symbol"), F.when(i % 2 == 0, "").otherwise("ref").alias("kind"), F.lit(None).cast("string").alias("excerpt"))
    return T.table(spark, d, "documents").select("doc_id", A.action_anchor(anchor).alias("a")).select("doc_id", F.col("a.start_line").alias("line"), "a.symbol", "a.kind")


KINDS = (*A.TEXTS, "other")


def _texts_sql() -> str:
    word = lambda x: "replace(replace('" + x.replace("'", "''") + "', '{hunk}', coalesce(hunk::VARCHAR, '')), '{seed}', coalesce(seed, 'the seed file'))"
    column = lambda n: f"CASE WHEN kind = 'open_changed_boundary' AND hunk IS NOT NULL THEN {word(A.AT_HUNK[n])} " + " ".join(f"WHEN kind = '{k}' THEN {word(t[n])}" for k, t in A.TEXTS.items()) + f" ELSE {word(A.OTHER[n])} END"
    names = ("risk", "why", "outcome", "follow_up_yes", "follow_up_no")
    return f"""WITH a AS (SELECT doc_id, {list(KINDS)}[doc_id % {len(KINDS)} + 1] AS kind, CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 END AS hunk, CASE WHEN doc_id % 5 > 0 THEN 's/' || doc_id END AS seed FROM documents)
    SELECT doc_id, {', '.join(f'{column(n)} AS {c}' for n, c in enumerate(names))} FROM a"""


@query("l9_action_texts", _texts_sql())
def action_texts(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % len(KINDS) + 1).cast("int"))
    seed = F.when(i % 5 > 0, F.concat(F.lit("s/"), i)).otherwise(F.when(i % 2 == 0, F.lit("")))
    return T.table(spark, d, "documents").select("doc_id", A.action_texts(kind, F.when(i % 4 > 0, i % 9), seed).alias("t")).select("doc_id", "t.*")


# F20, F21
@query(
    "f20_test_commands",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('pytest tests/t', doc_id, '.py') WHEN 1 THEN concat('pytest ''a b/t', doc_id, '.py'' x.PY') WHEN 2 THEN concat('npx vitest run src/t', doc_id, '.spec.ts b.jsx')
    WHEN 5 THEN 'npx vitest run a.ts b.ts c.ts d.ts e.ts f.ts' END AS command FROM documents""",
)
def commands(spark, d):
    i, lit = F.col("doc_id"), F.lit
    name = lambda a, b: F.concat(lit(a), i, lit(b))
    paths = (
        F.when(i % 6 == 0, F.array(name("tests/t", ".py"))).when(i % 6 == 1, F.array(name("a b/t", ".py"), lit("x.PY"))).when(i % 6 == 2, F.array(name("src/t", ".spec.ts"), lit("b.jsx")))
        .when(i % 6 == 3, F.array(lit("a.py"), lit("b.ts"))).when(i % 6 == 4, F.array().cast("array<string>")).otherwise(F.array(*[lit(f"{c}.ts") for c in "abcdefgh"]))
    )
    return T.table(spark, d, "documents").select("doc_id", R.test_commands(paths, "pytest", "vitest").alias("command"))


# R7
@query(
    "r7_test_lift",
    """WITH f AS (SELECT page_id AS i, page_id / 100.0::DOUBLE AS own, 1 + (page_id % 4)::DOUBLE AS boost, page_id % 5 = 0 AS c, page_id % 3 = 0 AS m FROM pages)
    SELECT 't' || f.i % 10 AS rel_path, round(max(own * (CASE WHEN c THEN 4 ELSE 1 END) * (CASE WHEN m THEN 1.5::DOUBLE ELSE 1 END) * least(boost, 2) * 0.5::DOUBLE * 0.8::DOUBLE), 9) AS lift FROM f GROUP BY 1""",
)
def lifted(spark, d):
    i = F.col("page_id")
    files = T.table(spark, d, "pages").select(F.concat(F.lit("s"), i).alias("rel_path"), (i / 100).alias("own"), (1.0 + i % 4).alias("boost"), (i % 5 == 0).alias("is_chat"), (i % 3 == 0).alias("is_mentioned"))
    tests = T.table(spark, d, "pages").select(F.concat(F.lit("s"), i).alias("source"), F.concat(F.lit("t"), i % 10).alias("test"))
    return R.test_lift(files, tests, 0.8).withColumn("lift", F.round("lift", 9))


# U4, G17
LINKS = "SELECT 'doc/' || doc_id AS source, 'doc/' || (doc_id + 1) // 2 AS target, CASE doc_id % 3 WHEN 0 THEN 'imports' WHEN 1 THEN 're_exports' ELSE 'package_reexports' END AS relation, (doc_id % 9 + 1)::INTEGER AS line, CASE WHEN doc_id % 4 > 0 THEN 'the' END AS symbol FROM documents"


def links(spark, d) -> DataFrame:
    i = F.col("doc_id")
    relation = F.when(i % 3 == 0, "imports").when(i % 3 == 1, "re_exports").otherwise("package_reexports")
    symbol = F.when(i % 4 > 0, "the")
    return T.table(spark, d, "documents").select(F.concat(F.lit("doc/"), i).alias("source"), F.concat(F.lit("doc/"), F.floor((i + 1) / 2)).alias("target"), relation.alias("relation"), (i % 9 + 1).cast("int").alias("line"), symbol.alias("source_symbol"), symbol.alias("target_symbol"), F.lit("d").alias("detail"))


@query("u4_edge_families", f"WITH {SIDES}, l AS ({LINKS}) SELECT src, dst, sum(w)::BIGINT AS weight FROM (SELECT src, dst, weight AS w FROM edges UNION ALL SELECT source, target, 1 FROM l) GROUP BY 1, 2")
def edge_families(spark, d):
    return G.rank_edges(T.tags(spark, d, True), links(spark, d), sides=T.symbols(spark, d))


@query(
    "g17_link_hops",
    f"""WITH {T.TAGS}, l AS ({LINKS}), m AS (SELECT rel_path, name, min(line) AS target_line FROM tags WHERE kind = 'def' GROUP BY 1, 2)
    SELECT source, target, relation, symbol, l.line AS source_line, target_line, CASE relation WHEN 'imports' THEN 'import' WHEN 're_exports' THEN 're_export' ELSE 'package_boundary' END AS evidence_kind FROM l LEFT JOIN m ON target = rel_path AND symbol = name""",
)
def link_hops(spark, d):
    tags = T.tags(spark, d)
    e = G.nav_edges(tags.filter("kind = 'def'"), links(spark, d)).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.explode("details").alias("x"))
    return e.select("source", "target", "x.relation", F.col("x.source_symbol").alias("symbol"), "x.source_line", "x.target_line", "x.evidence_kind")
