"""Changed lines: diffs, hunks and what lies near them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIERS = (0, 2, 8)
#: Lines whose distances come to a file's tags in one row.
BLOCK = 256


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(rel_path, line) of added or changed lines. diffs: id, text of unified diffs."""
    rows = diffs.select("id", F.posexplode(F.split("text", r"\r\n|\n")).alias("at", "row"))
    head = F.when(F.col("row").startswith("+++ "), F.when(F.col("row").rlike(r"^\+\+\+ /dev/null"), F.lit("")).otherwise(F.regexp_extract("row", r"^\+\+\+ (?:b/)?([^\t]*)", 1)))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.withColumn("rel_path", F.last(head, ignorenulls=True).over(w)).filter(F.col("row").startswith("@@ ") & (F.coalesce("rel_path", F.lit("")) != ""))
    span = at.select("rel_path", F.regexp_extract("row", r"^@@ -\S+ \+(\d+)", 1).try_cast("int").alias("start"), F.regexp_extract("row", r"^@@ -\S+ \+\d+(?:,(\d+))?", 1).alias("n"))
    span = span.withColumn("n", F.when(F.col("n") == "", 1).otherwise(F.col("n").try_cast("int"))).filter("start is not null and n > 0")
    return span.select("rel_path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line")).distinct()


def with_untracked(changed: DataFrame, files: DataFrame) -> DataFrame:
    """All lines of untracked files (rel_path, n_lines) that the diffs don't name."""
    new = files.join(changed.select("rel_path").distinct(), "rel_path", "left_anti").filter("n_lines > 0")
    return changed.select("rel_path", "line").unionByName(new.select("rel_path", F.explode(F.sequence(F.lit(1), F.col("n_lines").cast("int"))).alias("line"))).distinct()


def hunks(changed: DataFrame, bucket: int = 4096) -> DataFrame:
    """A5: (rel_path, start, end) of runs of lines. Runs are found inside buckets of lines and
    then joined where they touch, so a file of any length is spread over tasks."""
    rows = changed.select("rel_path", "line").distinct().withColumn("b", F.floor(F.col("line") / bucket))
    w = Window.partitionBy("rel_path", "b").orderBy("line")
    part = rows.withColumn("g", F.col("line") - F.row_number().over(w)).groupBy("rel_path", "b", "g").agg(F.min("line").alias("start"), F.max("line").alias("end"))
    f = Window.partitionBy("rel_path").orderBy("start")
    new = F.when(F.col("start") == F.lag("end").over(f) + 1, 0).otherwise(1)
    runs = part.withColumn("new", new).withColumn("run", F.sum("new").over(f))
    return runs.groupBy("rel_path", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def hunk_distance(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (rel_path, line, ...) with the distance to the nearest hunk of their file, by
    carrying the last hunk before and the first after through one sort, without pairing."""
    marks = spans.select("rel_path", F.col("start").alias("line"), F.struct("start", "end").alias("h"), F.lit(0).alias("o"))
    every = lines.withColumns({"h": F.lit(None).cast(marks.schema["h"].dataType), "o": F.lit(1)})
    both = every.unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy("rel_path").orderBy("line", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("rel_path").orderBy(F.desc("line"), F.desc("o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("h", ignorenulls=True).over(back)
    after = F.last("h", ignorenulls=True).over(ahead)
    d1 = F.when(before.isNotNull(), F.greatest(F.lit(0), F.col("line") - before["end"]))
    d2 = after["start"] - F.col("line")
    return both.withColumn("distance", F.least(d1, d2)).filter("o = 1").drop("h", "o")


def changed_symbols(tags: DataFrame, spans: DataFrame, show: int = 8) -> DataFrame:
    """Per file the symbols of the nearest tier of hunks (inside, within 2, within 8), the
    first few by distance and name: (rel_path, symbol, distance)."""
    near = hunk_distance(tags.select("rel_path", "line").distinct(), spans).filter(F.col("distance") <= TIERS[-1])  # lines are sorted, not tags
    # tags stay where they are dealt by file: a file's near lines come to them in blocks, and as the
    # block is compared by a difference it is no key to deal by
    block = lambda line: F.floor(line / BLOCK)
    blocks = near.groupBy(F.col("rel_path").alias("file"), block(F.col("line")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("line"), "distance"))).alias("at"))
    met = tags.select("rel_path", "line", "name").join(blocks.hint("shuffle_hash"), (F.col("rel_path") == F.col("file")) & (block(F.col("line")) - F.col("b") == 0))
    best = met.select("rel_path", F.col("name").alias("symbol"), F.col("at")[F.col("line")].alias("distance")).filter("distance is not null").groupBy("rel_path", "symbol").agg(F.min("distance").alias("distance"))
    tier = F.when(F.col("distance") <= TIERS[0], 0).when(F.col("distance") <= TIERS[1], 1).otherwise(2)
    w = Window.partitionBy("rel_path")
    kept = best.withColumn("tier", tier).withColumn("m", F.min("tier").over(w)).filter("tier = m")
    k = F.row_number().over(w.orderBy("distance", "symbol"))
    return kept.withColumn("k", k).filter(F.col("k") <= show).select("rel_path", "symbol", "distance")


def context_lines(lines: DataFrame, at: DataFrame, around: int = 2) -> DataFrame:
    """The lines around each place. lines: rel_path, line, body; at: rel_path, line."""
    span = at.select("rel_path", F.col("line").alias("focus"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)).alias("line"))
    return span.join(lines, ["rel_path", "line"])
