"""Text of files: role signals, synthetic tags, summaries and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import API_SIGNALS, ENTRY_SIGNALS, basename

#: Line ends as Python's splitlines knows them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
DOC_MARK = r"^[#\[{]|[=:]"
TEST_MARK = r"def test_|class test|it\(|test\(|describe\(|scenario\("


def lines(files: DataFrame) -> DataFrame:
    """(rel_path, line, body) without the empty line after a final line end."""
    parts = F.split("text", LINE_END)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("rel_path", F.posexplode(kept).alias("p", "body")).select("rel_path", (F.col("p") + 1).alias("line"), "body")


def runtime_roles(files: DataFrame, tags: int = 6) -> DataFrame:
    """Signals in first-seen order and the first distinct (kind, line) as tags."""
    rules = [(k, "entry", n, r) for k, (n, r) in enumerate(ENTRY_SIGNALS)] + [(k + len(ENTRY_SIGNALS), "api", n, r) for k, (n, r) in enumerate(API_SIGNALS)]
    hit = F.array_compact(F.array(*[F.when(F.col("body").rlike(r), F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(n).alias("name"))) for k, kind, n, r in rules]))
    found = lines(files).select("rel_path", "line", F.explode(hit).alias("h")).select("rel_path", "line", "h.*")
    first = found.groupBy("rel_path", "kind", "name").agg(F.min(F.struct("line", "k")).alias("at"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "name")))), lambda x: x["name"])
    signals = first.groupBy("rel_path").agg(of("entry").alias("entry_signals"), of("api").alias("api_signals"))
    places = found.groupBy("rel_path", "kind", "line").agg(F.min("k").alias("k")).groupBy("rel_path").agg(F.slice(F.sort_array(F.collect_list(F.struct("line", "k", "kind"))), 1, tags).alias("role_tags"))
    none = F.array().cast("array<string>")
    out = files.select("rel_path").join(signals, "rel_path", "left").join(places, "rel_path", "left")
    return out.select("rel_path", F.coalesce("entry_signals", none).alias("entry_signals"), F.coalesce("api_signals", none).alias("api_signals"), F.transform("role_tags", lambda x: x.dropFields("k")).alias("role_tags"))


def synthetic_tags(files: DataFrame, kind: str) -> DataFrame:
    """lines that stand for a document or test without parsed tags: up to six that look
    like content, else the first four that aren't blank."""
    body = F.trim("body")
    rows = lines(files).filter(body != "")
    like = (F.col("line") == 1) | body.rlike(DOC_MARK) if kind == "doc" else F.lower(body).rlike(TEST_MARK)
    rows = rows.select("rel_path", "line", like.alias("like")).groupBy("rel_path").agg(F.slice(F.sort_array(F.collect_list(F.when(F.col("like"), F.col("line")))), 1, 6).alias("a"), F.slice(F.sort_array(F.collect_list("line")), 1, 4).alias("b"))
    return rows.select("rel_path", F.explode(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))).alias("line")).select("rel_path", "line", basename(F.col("rel_path")).alias("name"), F.lit(kind).alias("kind"))


def shorten(value: Column, limit: int) -> Column:
    """F11"""
    s = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("..."))).otherwise(s)


def dependency_name(spec: Column) -> Column:
    """the name in front of extras, versions and markers."""
    return F.regexp_extract(F.trim(spec), r"^([-.\w]+)", 1)


def code_line(line: Column, body: Column) -> Column:
    """K3: the plain form of a shown line."""
    return F.concat(F.lpad(line.cast("string"), 4, " "), F.lit(": "), body)


def summary_block(kind: Column, items: Column, show: int = 5) -> Column:
    """K4: highlights of a document or of configuration; null without any."""
    label = F.when(kind == "doc", "(Doc Highlights)").otherwise("(Config Highlights)")
    return F.when(F.size(items) > 0, F.concat_ws("\n", label, F.array_join(F.transform(F.slice(items, 1, show), lambda x: F.concat(F.lit("- "), x)), "\n")))


def map_sections(files: DataFrame, interest: DataFrame) -> DataFrame:
    """K1/K3/K4: (rel_path, section). files: rel_path, rank, text; interest: rel_path,
    lines_of_interest and, where highlights are wanted, summary_kind and summary_items."""
    parts = F.split("text", LINE_END)
    j = files.join(interest, "rel_path", "left")
    shown = F.array_join(F.transform(F.filter("lines_of_interest", lambda n: (n >= 1) & (n <= F.size(parts))), lambda n: code_line(n, F.element_at(parts, n.cast("int")))), "\n")
    head = F.concat(F.col("rel_path"), F.lit(":\n(Rank value: "), F.format_string("%.4f", F.col("rank")), F.lit(")"))
    block = [summary_block(F.col("summary_kind"), F.col("summary_items"))] if "summary_items" in interest.columns else []
    return j.select("rel_path", F.concat_ws("\n\n", head, *block, F.when(shown != "", shown)).alias("section"))


def joined_sections(rank: str = "rank") -> Column:
    """K2: an aggregate: sections by rank and path, a blank line between them."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(rank)).alias("r"), "rel_path", "section")))
    return F.array_join(F.transform(rows, lambda x: x["section"]), "\n\n")
