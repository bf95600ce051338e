"""Operator 6: nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks of fixed size and joined block by block. A pair
of blocks is one matrix product of int8 codes (exact, since sums stay below 2**24 in float32
up to MAX_EXACT dimensions; wider vectors use float64). With r = x - code * scale the residual,
|q.c - q'.c'| <= |r_q||c| + |q'||r_c|, so each product gives a lower and an upper bound of the
squared distance. Pairs whose lower bound is above the query's k-th upper bound can't be among
the k nearest; the others are recomputed in double precision and kept in a heap per query and
block, and the heaps are merged. A task remembers each query's k-th distance so far and leaves out what
lies beyond it in later tiles. The result is exact.

Candidate blocks stay where they are; query blocks come to them in groups of a fixed size
(GROUP_BLOCKS), so nothing that grows with the table is broadcast and no candidate is shuffled twice.
Tiles are compared in units of their largest component, so finite components of any size have bounds.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
id, take no part. Vectors of different lengths are not compared. Rows with the query's id are
its own; a query id that repeats uses its smallest vector; other repeated rows are candidates
each. Ties go to the smaller id. Without candidates a query has no rows. Distances beyond the range of
doubles are infinite. Only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small, small_batches, table

K = 10
QUERY_EVERY = 100
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
MAX_EXACT = 1000
#: Blocks of queries that are sent to the candidates at once.
GROUP_BLOCKS = 8
#: Room for the rounding of the bounds themselves.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def packed(rows: DataFrame, block: int, name: str) -> DataFrame:
    """(dim, <name>, rows: array<struct<id, v>>): blocks of about `block` rows, dealt round. rows
    must be saved, as their order deals them."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).join(small(sizes), "dim").withColumn(name, F.pmod("at", "blocks"))
    return saved(dealt.groupBy("dim", name).agg(F.collect_list(F.struct("id", "v")).alias(name + "_rows")))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as numbers that multiply fast), scales and norms of the residuals."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    code = np.rint(x / scale[:, None])
    return code.astype(np.float32 if x.shape[1] <= MAX_EXACT else np.float64), scale, np.linalg.norm(x - code * scale[:, None], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows; those whose squares leave the range of doubles are taken in units of their
    largest difference."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - y[:, j]) ** 2
        odd = np.flatnonzero(~((d > 1e-280) & (d < 1e300)))
        d = np.sqrt(d)
        if len(odd):
            off = np.abs(x[odd] - y[odd])
            most = off.max(axis=1)
            unit = np.where((most > 0) & np.isfinite(most), most, 1.0)
            d[odd] = np.where(np.isfinite(most), np.sqrt(((off / unit[:, None]) ** 2).sum(axis=1)) * unit, np.inf)
    return d


def tile(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, candidate, distance): the k nearest of this block for each query, less
    those beyond the query's bound."""
    unit = 2.0 ** np.floor(np.log2(max(np.abs(q).max(), np.abs(c).max())))
    qx, cx = q / unit, c / unit
    qc, qs, qr = quantised(qx)
    cc, cs, cr = quantised(cx)
    qn, cn = np.linalg.norm(qx, axis=1), np.linalg.norm(cx, axis=1)
    about = qn[:, None] ** 2 + cn[None, :] ** 2 - 2 * (qc @ cc.T).astype(np.float64) * qs[:, None] * cs[None, :]
    room = 2 * (qr[:, None] * cn[None, :] + (qn + qr)[:, None] * cr[None, :]) + SLACK * (qn[:, None] + cn[None, :]) ** 2
    own = q_id[:, None] == c_id[None, :]
    upper = np.where(own, np.inf, about + room)
    kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q), np.inf)
    if bound is not None:
        with np.errstate(over="ignore"):
            kth = np.minimum(kth, (bound / unit) ** 2 * (1 + SLACK) + 1e-290)
    a, b = np.nonzero((about - room <= kth[:, None]) & ~own)
    d = distances(q[a], c[b])
    order = np.lexsort((c_id[b], d, a))
    a, b, d = a[order], b[order], d[order]
    first = np.searchsorted(a, np.arange(len(q)))
    near = np.arange(len(a)) - first[a] < k
    return a[near], c_id[b[near]], d[near]


def multiplied(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The heaps of tiles (dim, qb, qb_rows, cb_rows)."""
    best: dict[tuple[int, int], np.ndarray] = {}  # a group's query blocks are few
    for batch in batches:
        for n in range(batch.num_rows):
            block = (batch.column("dim")[n].as_py(), batch.column("qb")[n].as_py())
            q_id, q = unpacked(batch.column("qb_rows")[n])
            held = best.setdefault(block, np.full((len(q_id), k), np.inf))
            a, ids, d = tile(q_id, q, *unpacked(batch.column("cb_rows")[n]), k, held[:, -1])
            new = np.full((len(q_id), k), np.inf)
            new[a, np.arange(len(a)) - np.searchsorted(a, np.arange(len(q_id)))[a]] = d
            held[:] = np.sort(np.concatenate([held, new], axis=1), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_id[a], ids, d)], ["query_id", "vec_id", "score"])


def unpacked(lists: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    s = lists.values
    ids = s.field("id").to_numpy(zero_copy_only=False)
    return ids, s.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query."""
    small_batches(vectors.sparkSession)
    rows = saved(vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("is_query")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")))
    queries = saved(rows.filter("is_query").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    c = packed(rows.select("id", "v", "dim"), candidate_block, "cb")
    q = packed(queries, query_block, "qb")
    # one row per block of queries is numbered in one task
    numbers = q.select("dim", "qb").withColumn("group", F.floor((F.row_number().over(Window.orderBy("dim", "qb")) - 1) / group_blocks))
    q = saved(q.join(numbers, ["dim", "qb"]))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    groups = (q.agg(F.max("group")).first()[0] or 0) + 1
    out = None
    for g in range(groups):
        tiles = c.join(F.broadcast(q.filter(F.col("group") == g).drop("group")), "dim").select("dim", "qb", "qb_rows", "cb_rows")
        heaps = tiles.mapInArrow(lambda batches: multiplied(batches, k), "query_id long, vec_id long, score double")
        own = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        own = saved(own) if groups > 1 else own
        out = own if out is None else out.unionByName(own)
    return out


def op6_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod(F.col("vec_id"), F.lit(QUERY_EVERY)) == 0)


OP6_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= {K}
"""
