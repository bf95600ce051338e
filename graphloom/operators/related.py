"""Sources and their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import is_test_file, related_test_candidates, source_keys, test_keys


def related_tests(files: DataFrame) -> DataFrame:
    """(source, test, pos): candidate paths that exist and are tests, in order of preference.
    files: rel_path."""
    kinds = files.select("rel_path", is_test_file(F.col("rel_path")).alias("is_test")).distinct()
    return test_pairs(kinds.filter("not is_test").select("rel_path"), kinds.filter("is_test").select("rel_path")).filter("test <> source")


def test_pairs(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """(source, test, pos): the tests that are candidates of a source, and at which place. Both: rel_path.

    A source's 55 candidates are never rows: sources and tests meet by a few keys each, and only
    pairs that meet are held against the candidates."""
    s = sources.select(F.col("rel_path").alias("source")).distinct().select("source", F.explode(source_keys(F.col("source"))).alias("key"))
    t = tests.select(F.col("rel_path").alias("test")).distinct().select("test", F.explode(test_keys(F.col("test"))).alias("key"))
    met = s.join(t, "key").select("source", "test").distinct()
    at = met.select("source", "test", (F.array_position(related_test_candidates(F.col("source")), F.col("test")) - 1).cast("int").alias("pos"))
    return at.filter("pos >= 0")


def test_lift(files: DataFrame, tests: DataFrame, weight: float = 1.0) -> DataFrame:
    """(rel_path, lift): what a test gains from the sources it tests. files: rel_path, own
    (rank), boost, is_chat, is_mentioned; tests: source, test."""
    chat, mentioned = F.when(F.col("is_chat"), 4.0).otherwise(1.0), F.when(F.col("is_mentioned"), 1.5).otherwise(1.0)
    one = F.col("own") * chat * mentioned * F.least("boost", F.lit(2.0)) * 0.5 * weight
    from_source = tests.select("source", F.col("test").alias("rel_path")).distinct().join(files.select(F.col("rel_path").alias("source"), one.alias("one")), "source")
    return from_source.groupBy("rel_path").agg(F.max("one").alias("lift"))


def quoted(path: Column) -> Column:
    """A path as one word of a shell command."""
    safe = path.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(safe, path).otherwise(F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def test_commands(paths: Column, python: str | None, js: str | None, show: int = 6) -> Column:
    """one command for tests of one kind; null for mixed or unknown kinds and runners."""
    kinds = F.transform(paths, lambda p: F.lower(F.regexp_extract(p, r"[^/]\.([^./]+)$", 1)))
    words = F.array_join(F.transform(F.slice(paths, 1, show), quoted), " ")
    all_in = lambda *x: F.forall(kinds, lambda k: k.isin(*x))
    py = {"pytest": "pytest "}.get(python or "")
    script = {"vitest": "npx vitest run ", "jest": "npx jest ", "mocha": "npx mocha "}.get(js or "")
    say = lambda c: F.concat(F.lit(c), words) if c else F.lit(None).cast("string")
    return F.when(F.size(paths) > 0, F.when(all_in("py"), say(py)).when(all_in("ts", "tsx", "js", "jsx"), say(script)))
