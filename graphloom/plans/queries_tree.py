"""Queries of import links and summaries over written-out source files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.summaries import summaries
from graphloom.operators.links import semantic_links
from graphloom.sources import tables as T

Q: dict = {}
SQL: dict[str, str] = {}

#: Files that import the file 112 pages earlier, which has the same folder and suffix.
IMPORTS = (
    "CASE page_id % 16 WHEN 0 THEN concat('import os', chr(10), 'from .file', page_id - 112, ' import thing as t') "
    "WHEN 2 THEN concat('import { run as go } from \"./file', page_id - 112, '\"', chr(10), 'export * from \"./file', page_id - 112, '.js\";') ELSE 'x' END"
)
SUMMARIES = (
    "CASE page_id % 16 WHEN 9 THEN concat('{\"name\": \"p', page_id, '\", \"version\": \"1.2\", \"scripts\": {\"build\": \"x\", \"test\": \"y\"}}') "
    "WHEN 6 THEN concat('name: CI ', page_id, chr(10), 'on: [push, pull_request]', chr(10), 'jobs:', chr(10), '  test:', chr(10)) "
    "WHEN 13 THEN 'numpy>=1' WHEN 15 THEN concat('# Guide ', page_id, chr(10), chr(10), 'Some   text here', chr(10)) ELSE 'plain' END"
)


def written(spark, d: str, text: str) -> DataFrame:
    pages = T.table(spark, d, "pages")
    return pages.select(F.expr(T.PATH).alias("rel_path"), F.expr(text.replace("chr(10)", "char(10)")).alias("text"))


def semantic(spark, d):
    return semantic_links(written(spark, d, IMPORTS))


Q["g12_semantic_links"] = semantic
SQL["g12_semantic_links"] = f"""WITH f AS (SELECT page_id, page_id - 112 AS o, {T.PATH} AS rel_path FROM pages), k AS (SELECT a.*, b.rel_path AS target FROM f a JOIN f b ON b.page_id = a.o)
SELECT rel_path AS source, target, 'imports' AS relation, 2 AS line, 't' AS source_symbol, 'thing' AS target_symbol, concat('from .file', o, ' import thing as t') AS detail FROM k WHERE page_id % 16 = 0
UNION ALL SELECT rel_path, target, 'imports', 1, 'go', 'run', concat('import {{ run as go }} from ./file', o) FROM k WHERE page_id % 16 = 2
UNION ALL SELECT rel_path, target, 're_exports', 2, '*', '*', concat('export * from ./file', o, '.js') FROM k WHERE page_id % 16 = 2"""


def summarised(spark, d):
    return summaries(written(spark, d, SUMMARIES))


Q["f10_summaries"] = summarised
SQL["f10_summaries"] = f"""SELECT {T.PATH} AS rel_path, CASE page_id % 16 WHEN 9 THEN 'config' WHEN 6 THEN 'config' WHEN 13 THEN 'doc' WHEN 15 THEN 'doc' WHEN 5 THEN 'doc' END AS summary_kind,
CASE page_id % 16 WHEN 9 THEN [concat('Package: p', page_id, '@1.2'), 'Scripts: build, test'] WHEN 6 THEN [concat('Workflow: CI ', page_id), 'Triggers: push, pull_request', 'Jobs: test']
  WHEN 13 THEN ['Overview: numpy>=1'] WHEN 15 THEN [concat('Heading: Guide ', page_id), 'Overview: Some text here'] WHEN 5 THEN ['Overview: plain'] ELSE []::VARCHAR[] END AS summary_items FROM pages"""
