"""Table adapter: files, tags, links and changed lines from the driver's Parquet tables.

Each rule has a DataFrame form and a SQL form that give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task gets where rows are dealt by file.
PART_BYTES = 4 << 20


def parts(df: DataFrame) -> int:
    """Partitions for the rows of a table, by the size of its files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART_BYTES), 1 << 14))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("[A-Za-z0-9]{2,}"), F.lit(0))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kinds): a row per symbol and file that defines it (1), and one per symbol and file that
    references it (2); the distinct tags, found inside each file's text."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", "text").repartition(parts(docs), "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    lines = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, "\n"), _words)))
    of = lambda k, words: F.transform(F.array_distinct(F.transform(F.flatten(words), F.lower)), lambda w: F.struct(w.alias("name"), F.lit(k).alias("kinds")))
    first, rest = F.transform("lines", lambda w: F.slice(w, 1, 1)), F.transform("lines", lambda w: F.slice(w, 2, 1 << 30))
    return texts.select("doc_id", lines.alias("lines")).select(F.explode(F.concat(of(1, first), of(2, rest))).alias("x")).select("x.*")


def tags(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    """(rel_path, line, pos, name, kind): a line's first word is a definition, others references.

    by_file: texts are dealt by path before they become tags, so that whatever is then counted or
    ordered within files moves no tags."""
    docs = table(spark, sf_dir, "documents")
    n = parts(docs) if by_file else 0
    docs = docs.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("rel_path"), "text")
    docs = docs.repartition(n, "rel_path") if by_file else docs
    lines = docs.select("rel_path", F.posexplode(F.split("text", "\n")).alias("at", "body"))
    out = lines.select("rel_path", (F.col("at") + 1).alias("line"), F.posexplode(_words(F.col("body"))).alias("pos", "word"))
    return out.select("rel_path", "line", "pos", F.lower("word").alias("name"), F.when(F.col("pos") == 0, "def").otherwise("ref").alias("kind"))


TAGS = """
tags AS MATERIALIZED (
  SELECT 'doc/' || doc_id AS rel_path, line, (pos - 1)::INTEGER AS pos, lower(words[pos]) AS name, CASE pos WHEN 1 THEN 'def' ELSE 'ref' END AS kind
  FROM (SELECT *, unnest(generate_series(1, len(words))) AS pos FROM (
    SELECT doc_id, line, list_filter(regexp_extract_all(lines[line], '[A-Za-z0-9]+'), lambda w: length(w) >= 2) AS words
    FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines)))::INTEGER AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))))"""

#: Paths of a source tree, one per page; valid in both dialects.
PATH = (
    "CASE page_id % 16 "
    "WHEN 0 THEN concat('src/mod', page_id % 7, '/file', page_id, '.py') "
    "WHEN 1 THEN concat('tests/mod', (page_id - 1) % 7, '/test_file', page_id - 1, '.py') "
    "WHEN 2 THEN concat('src/mod', page_id % 7, '/file', page_id, '.ts') "
    "WHEN 3 THEN concat('src/mod', (page_id - 1) % 7, '/file', page_id - 1, '.spec.ts') "
    "WHEN 4 THEN concat('app/api/x', page_id, '/route.ts') "
    "WHEN 5 THEN CASE WHEN page_id % 3 = 0 THEN concat('docs/guide', page_id, '.md') ELSE concat('docs/deep/guide', page_id, '.md') END "
    "WHEN 6 THEN concat('.github/workflows/ci', page_id, '.yml') "
    "WHEN 7 THEN concat('pkg', page_id, '/__init__.py') "
    "WHEN 8 THEN concat('scripts/Run', page_id, '.py') "
    "WHEN 9 THEN concat('services/s', page_id, '/package.json') "
    "WHEN 10 THEN concat('s', page_id, '/main.py') "
    "WHEN 11 THEN concat('lib/routers/r', page_id, '.js') "
    "WHEN 12 THEN concat('lib/routers/__tests__/r', page_id - 1, '.js') "
    "WHEN 13 THEN concat('c', page_id, '/requirements.txt') "
    "WHEN 14 THEN concat('e2e/scenario', page_id, '_test.py') "
    "ELSE concat('generated/r', page_id, '/README.md') END"
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, text): pages under the paths of a source tree."""
    return table(spark, sf_dir, "pages").select(F.expr(PATH).alias("rel_path"), F.col("html").alias("text"), "page_id", "url")


FILES = f"files AS MATERIALIZED (SELECT {PATH} AS rel_path, html AS text, page_id, url FROM pages)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customers, suppliers and nations under their nation and region."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    e = lambda d, a, b, p, q: d.select(F.concat(F.lit(p), F.col(a)).alias("src"), F.concat(F.lit(q), F.col(b)).alias("dst"))
    return e(c, "c_custkey", "c_nationkey", "c:", "n:").unionByName(e(s, "s_suppkey", "s_nationkey", "s:", "n:")).unionByName(e(n, "n_nationkey", "n_regionkey", "n:", "r:"))


PLACES = """
places AS MATERIALIZED (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
way AS MATERIALIZED (SELECT src, dst FROM places UNION SELECT dst, src FROM places)"""


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, line): event types as files, event ids as lines."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("rel_path"), F.col("event_id").alias("line"))


CHANGED = "changed AS MATERIALIZED (SELECT event_type AS rel_path, event_id AS line FROM events)"

#: Impact rows with every flag, one per part; valid in both dialects.
IMPACT = {
    "path": "concat(CASE p_partkey % 4 WHEN 0 THEN 'tests/test_f' WHEN 1 THEN 'src/api/f' WHEN 2 THEN 'src/f' ELSE 'conf/f' END, p_partkey, CASE p_partkey % 4 WHEN 3 THEN '.toml' ELSE '.py' END)",
    "seed": "concat('src/seed', p_size % 5, '.py')",
    "distance": "cast(p_size % 3 + 1 as int)",
    "path_length": "cast(p_size % 3 + 2 as int)",
    "is_test": "p_partkey % 4 = 0",
    "is_api": "p_partkey % 4 = 1",
    "is_entry": "p_partkey % 6 = 2",
    "is_important": "p_partkey % 4 = 3",
    "summary_kind": "CASE WHEN p_partkey % 4 = 3 THEN CASE WHEN p_partkey % 8 = 3 THEN 'config' ELSE 'doc' END END",
    "hunk": "CASE WHEN p_partkey % 5 < 3 THEN cast(p_size % 5 as int) END",
    "n_changed": "CASE WHEN p_partkey % 5 < 3 THEN cast(1 + p_partkey % 2 as int) ELSE 0 END",
    "symbol_a": "lower(p_brand)",
    "symbol_b": "concat('type_', p_size % 7)",
}


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(*[F.expr(v).alias(k) for k, v in IMPACT.items()])
    symbols = F.array_distinct(F.array("symbol_a", "symbol_b"))
    return part.withColumn("boundary", symbols).withColumn("changed", F.when(F.col("n_changed") == 2, symbols).when(F.col("n_changed") == 1, F.array("symbol_a")).otherwise(F.array().cast("array<string>"))).drop("symbol_a", "symbol_b")


IMPACT_SQL = f"""
impact AS MATERIALIZED (SELECT * EXCLUDE (symbol_a, symbol_b), [symbol_a, symbol_b] AS boundary,
  CASE n_changed WHEN 2 THEN [symbol_a, symbol_b] WHEN 1 THEN [symbol_a] ELSE []::VARCHAR[] END AS changed
  FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in IMPACT.items())} FROM part))"""
