"""Operator 9: sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight with
u hashed from the row's id and the child's path, and the least draw wins, so children are
hit in proportion to their weights. Changing weights changes only the draws of the nodes
whose weight changed: rows leave or enter those subtrees and stay put elsewhere.

The law is `key`. The first BASE shards form two regions of two racks; each later shard is
a region of its own, so one more shard takes rows only into itself.

Slots number a shard's rows from 0 without gaps: rows are counted by (shard, hash bin), a
prefix sum gives each bin's start, and only a bin is sorted at once.

Nulls: a null id is the empty text and so has one shard; a null text has 0 bytes and CRC 0.
Equal rows get different slots. Only the id and the text are read, so other columns may have any names; a
text of any length is measured whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, id_text, table

SHARDS = 16
BASE = 16
BIN_DIGITS = 3


def topology(shards: int, base: int = BASE, weights: dict[int, float] | None = None) -> dict:
    """Region -> rack -> shard -> weight. A node weighs as much as the shards below it."""
    weights = weights or {}
    tree: dict = {}
    first = min(shards, base)
    for n in range(shards):
        region, rack = (f"r{2 * n // first}", f"k{4 * n // first}") if n < first else (f"r{n}", f"k{n}")
        tree.setdefault(region, {}).setdefault(rack, {})[n] = float(weights.get(n, 1.0))
    return tree


def children(tree: dict) -> dict[str, list[tuple[str, float]]]:
    """Path of each inner node -> its children's paths and weights; without weight 0."""
    total = lambda x: sum(map(total, x.values())) if isinstance(x, dict) else x
    out: dict[str, list[tuple[str, float]]] = {}

    def walk(path: str, node: dict) -> None:
        out[path] = [(f"{path}/{k}", total(v)) for k, v in node.items() if total(v) > 0]
        for k, v in node.items():
            if isinstance(v, dict):
                walk(f"{path}/{k}", v)

    walk("", tree)
    return out


def shard_of(id_col: str | Column, tree: dict) -> Column:
    kids = children(tree)
    lists = F.create_map(*[x for path, own in kids.items() if own for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in own]))])
    key = id_text(id_col)

    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.encode(F.concat(key, F.lit("|"), c["path"]), "UTF-8")), 1, 13), 16, 10).cast("long")
        return F.struct((-F.log((bits + 1) / F.lit(float(2**52 + 1))) / c["weight"]).alias("draw"), c["path"].alias("path"))

    at: Column = F.lit("")
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(lists, at), draw))["path"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def slots(rows: DataFrame, shard: str, id_col: str, *ties: str) -> DataFrame:
    """rows with `slot`: 0, 1, ... inside each shard."""
    h, b, start, n = fresh(rows, "hash", "bin", "start", "n")
    keyed = rows.withColumn(h, F.substring(F.md5(F.encode(F.concat_ws("|", id_text(id_col), *[id_text(t) for t in ties]), "UTF-8")), 1, 16)).withColumn(b, F.substring(h, 1, BIN_DIGITS))
    before = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(shard, b).agg(F.count("*").alias(n)).withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inside = Window.partitionBy(shard, b).orderBy(h, id_col, *ties)
    return keyed.withColumn("slot", F.row_number().over(inside)).join(starts, [shard, b]).withColumn("slot", (F.col("slot") - 1 + F.col(start)).cast("long")).drop(h, b, start)


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(id_col, topology(shards)).alias("shard"),
        shard_of(id_col, topology(shards + 1)).alias("grown_shard"),
    )
    return slots(rows, "shard", id_col, "text_crc32", "size").select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    def descent(name: str, shards: int) -> str:
        rows = ", ".join(f"('{at}', '{path}', {weight})" for at, own in children(topology(shards)).items() for path, weight in own)
        steps = [f"t{name} AS MATERIALIZED (SELECT * FROM (VALUES {rows}) t(node, path, weight)), {name}0 AS (SELECT doc_id, '' AS node FROM k)"]
        for n in range(3):
            draw = "-ln((('0x' || substr(md5(doc_id || '|' || path), 1, 13))::BIGINT + 1) / 4503599627370497::DOUBLE) / weight"
            steps.append(f"{name}{n + 1} AS MATERIALIZED (SELECT doc_id, min({{'draw': {draw}, 'path': path}}).path AS node FROM {name}{n} JOIN t{name} USING (node) GROUP BY doc_id)")
        return ", ".join(steps)

    crc = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        crc.append(x)
    tail = "string_split(node, '/')[-1]::INTEGER"
    return f"""
WITH k AS MATERIALIZED (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS doc_id FROM documents),
{descent("a", SHARDS)},
{descent("b", SHARDS + 1)},
h AS MATERIALIZED (SELECT DISTINCT text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, x: xor(c >> 8, ({crc}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM h),
r AS (
  SELECT d.doc_id, strlen(coalesce(d.text, ''))::BIGINT + 1 AS size, c.crc AS text_crc32, {tail.replace("node", "a3.node")} AS shard, {tail.replace("node", "b3.node")} AS grown_shard
  FROM documents d JOIN c ON d.text IS NOT DISTINCT FROM c.text JOIN a3 ON a3.doc_id = coalesce(d.doc_id::VARCHAR, '') JOIN b3 ON b3.doc_id = coalesce(d.doc_id::VARCHAR, ''))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
  ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || text_crc32 || '|' || size), 1, 16), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM r
"""


OP9_SQL = _sql()
