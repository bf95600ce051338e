"""Operator 1: mixing sources to target weights.

Every document gets a hash-random key. The key space of each source is range-partitioned
into equal bins, and the bins' token counts give each bin's start by a prefix sum. Bins that end
within their source's budget are taken and those that start beyond it aren't, so these rows stay
where they are; rows of the one bin at which the budget ends are sorted and summed, and the source
is cut where the running count meets its budget. Budgets above a source's size repeat whole epochs.
Only rows of a source's last bin are moved, so no task sees more than a bin of it.

Nulls: a null source is a source of its own and sorts last; a null text has size 0; a null
id is keyed as the empty text. Rows of size 0 are never taken. Equal rows are told apart by
nothing, so which of them meets the cut doesn't matter. Columns of the input named size, source_size,
target or taken give way to the results; others may have any names. An empty table gives no rows.
Sources are numbered and walked in one task (one row each), so they must be fewer than fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, fresh, id_text, saved, table, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1:"
#: Bins of a source's key space, a power of 16.
BIN_DIGITS = 3


def source_key(source: str) -> Column:
    """Sorts by code point, null last."""
    c = F.col(f"`{source}`").cast("string")
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def targets(sizes: DataFrame, key: str, size: str, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Share the sum of sizes by weight; a share stops at cap times its source's size and
    the excess goes to the others by weight. One row per source, in closed form: walk the
    sources by cap/weight; the first ones are those at their cap."""
    every = Window.orderBy(key)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("__w", w).withColumn("__c", cap * F.col(size))
    walk = Window.orderBy(F.col("__c") / F.col("__w"), key)
    whole = Window.partitionBy()
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    from_here = walk.rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("__total", F.sum(size).over(whole))
        .withColumn("__used", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(from_here))
        .withColumn("__full", F.col("__c") * F.col("__left") <= F.col("__w") * (F.col("__total") - F.col("__used")))
    )
    rest = F.col("__total") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__c"))).over(whole), F.lit(0))
    open_w = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(whole)
    target = F.when(F.col("__full"), F.col("__c").cast("double")).otherwise(F.col("__w") * rest / open_w)
    return s.withColumn("target", target).select(key, F.col(size).alias("source_size"), "target")


def mix_to_targets(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    id_col: str = "doc_id",
    weights=WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    whole: bool = False,
) -> DataFrame:
    """docs with size, source_size, target and taken (tokens the mix takes of the row).

    whole=False cuts inside the document at which the budget ends, so a source's taken
    tokens equal its target rounded down. whole=True takes documents only as wholes; the
    one at the cut is taken if most of it lies before the cut."""
    rest = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    key, hashed, own, fact, pad = fresh(docs, "key", "hash", "own", "fact", "pad")
    digest = F.substring(F.md5(F.encode(F.concat(F.lit(seed), id_text(F.col(f"`{id_col}`"))), "UTF-8")), 1, 16)
    keyed = docs.withColumns({key: source_key(source), hashed: digest})
    bin_of = F.substring(hashed, 1, BIN_DIGITS)
    bins = saved(keyed.select(F.col(key).alias("k"), bin_of.alias("b"), size.alias("size")).groupBy("k", "b").agg(F.sum("size").alias("bin_size")))
    goals = targets(bins.groupBy("k").agg(F.sum("bin_size").alias("own")), "k", "own", weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = saved(goals.withColumn("epochs", epochs).withColumn("left", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(goals.select("k", "left"), "k")
    ends = starts.filter(F.col("start") + F.col("bin_size") > F.col("left")).groupBy("k").agg(F.min(F.struct("b", "start")).alias("end"))
    facts = goals.join(ends, "k", "left").select("k", F.struct("source_size", "target", "epochs", "left", F.col("end.b").alias("end"), F.col("end.start").alias("start")).alias(fact))
    if goals.limit(SMALL + 1).count() <= SMALL:
        at = F.broadcast(facts.select(F.struct("k").alias(own), fact))
        joined = keyed.join(at, F.col(key) == F.col(f"{own}.k"))
    else:  # by source and bin, so that a large source is dealt to many tasks
        at = bins.select("k", "b").join(facts, "k").select(F.struct("k", "b").alias(own), fact)
        joined = keyed.join(at, (F.col(key) == F.col(f"{own}.k")) & (bin_of == F.col(f"{own}.b")))
    # the input's columns are in one struct, so no helper's name can meet one of theirs; sizes are
    # generated, so that filters on what is made of them don't count words again
    row = F.struct(F.lit(0).alias(pad), *[F.col(f"`{c}`").alias(c) for c in rest]).alias("row")
    columns = [row, F.col(f"`{id_col}`").alias("id"), F.col(key).alias("k"), F.col(hashed).alias("h"), bin_of.alias("b"), F.col(f"{fact}.*"), F.explode(F.array(size)).alias("size")]
    cut = joined.filter(bin_of == F.col(f"{fact}.end")).select(*columns)
    inside = Window.partitionBy("k", "b").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("run", F.sum("size").over(inside))
    ahead = F.col("start") + F.col("run") - F.col("size")
    last = F.when(2 * ahead + F.col("size") <= 2 * F.col("left"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - ahead))
    rest_of = joined.filter(F.col(f"{fact}.end").isNull() | (bin_of != F.col(f"{fact}.end"))).select(*columns)
    all_or_none = F.when(F.col("end").isNull() | (F.col("b") < F.col("end")), F.col("size")).otherwise(F.lit(0))
    names = [*[F.col(f"row.`{c}`").alias(c) for c in rest], "size", "source_size", "target", "taken"]
    taken = lambda df, part: df.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).select(*names)
    return taken(rest_of, all_or_none).union(taken(cut, last))


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole, with its own columns."""
    cols = docs.columns
    (at,) = fresh(docs, "copy")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{how.pop('id_col', 'doc_id')}`").alias("doc_id"), F.col(f"`{how.pop('source', 'source')}`").alias("source"))
    took = mix_to_targets(inner, word_count(F.col(f"row.`{text}`")), whole=True, **how).filter("taken > 0")
    copies = took.withColumn(at, F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return copies.select([F.col(f"row.`{c}`").alias(c) for c in cols])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = docs.select("doc_id", "source", word_count("text").alias("n"))
    return mix_to_targets(slim, F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, {CAP} * n AS c FROM s),
x AS (
  SELECT *, sum(n) OVER ()::DOUBLE AS total,
         coalesce(sum(c) OVER (ORDER BY c / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
         sum(w) OVER (ORDER BY c / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM w),
y AS (SELECT *, c * rest_w <= w * (total - used) AS is_full FROM x),
t AS (
  SELECT source, n, CASE WHEN is_full THEN c::DOUBLE
         ELSE w * (total - coalesce(sum(c) FILTER (is_full) OVER (), 0)::DOUBLE) / sum(w) FILTER (NOT is_full) OVER () END AS target
  FROM y),
r AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS ahead,
         CASE WHEN t.n > 0 THEN floor(t.target / t.n)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken
FROM r
"""
