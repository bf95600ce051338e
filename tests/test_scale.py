"""Steps that must not grow faster than their input: what becomes rows, and what is shuffled."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.operators import anchors as A
from graphloom.operators import graph as G
from graphloom.operators import hunks as H
from graphloom.operators import lanes as L
from graphloom.operators import related as R
from graphloom.sources import tables as T

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df) -> list[str]:
    """What is shuffled: the columns that each exchange deals by."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def test_sources_and_tests_meet_by_few_keys_with_the_same_pairs(spark):
    names = ("a.py", "b.", "Makefile", ".bashrc", "a.tar.gz", "test_a.py", "a_test.py", "", "a\nb.py", "_test", "a.spec")
    paths = spark.createDataFrame([(d + n,) for d in ("", "/", "src/", "src\\m/", "lib/x/", "src/tests/", "//", "app/spec/", "tests//") for n in names], "rel_path string")
    brute = paths.select(F.col("rel_path").alias("source"), F.posexplode(P.related_test_candidates(F.col("rel_path"))).alias("pos", "test")).select("source", "test", "pos")
    every = brute.select(F.col("test").alias("rel_path")).union(paths).distinct()
    assert {tuple(r) for r in R.test_pairs(paths, every).collect()} == {tuple(r) for r in brute.collect()}
    widest = every.agg(F.max(F.size(P.source_keys(F.col("rel_path")))).alias("s"), F.max(F.size(P.test_keys(F.col("rel_path")))).alias("t")).first()
    assert widest["s"] == 2 and widest["t"] <= 12


def test_clusters_keep_cuts_nulls_and_distances(spark):
    row = "path string, seed string, distance int, is_test boolean, boundary array<string>"
    rows = [(f"tests/test_f{k}.py", "s", k + 2, True, ["b", None, f"x{k}"]) for k in range(9)] + [("tests/test_f8.py", "s", 1, True, ["a"]), ("e2e/z.py", None, 4, True, None)]
    rows += [(f"{d}f{k}.py", "t", 3, False, []) for k in (0, 1) for d in ("", "src/", "lib/", "app/", "source/", "tests/")]
    got = {(r["seed"], r["kind"]): tuple(r)[2:] for r in L.test_clusters(spark.createDataFrame(rows, row)).collect()}
    six = [f"{d}f{k}.py" for d in ("", "app/", "lib/", "source/", "src/", "tests/") for k in (0, 1)]
    assert got == {
        ("s", "sibling"): (["tests/test_f0.py", "tests/test_f1.py"], sorted(six)[:5], 2, [None, "b", "x0", "x1"]),
        ("s", "nearby"): ([f"tests/test_f{k}.py" for k in range(2, 8)], [], 1, [None, "a", "b", "x2", "x3"]),
        (None, "integration"): (["e2e/z.py"], [], 4, []),
    }


def tagged(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, line int, pos int, name string, kind string")


def test_common_symbols_are_dropped_where_tags_are_read_and_edges_stay_the_same(spark, monkeypatch):
    rows = [(f"f{k}", 1 + k % 3, 1, "loud", "ref") for k in range(40)] + [(f"f{k}", 2, 0, "loud", "def") for k in range(30)] + [(f"f{k}", 4, 1, "never", "ref") for k in range(40)]
    rows += [(f"f{k}", 5 + k, 1, "fits", "ref") for k in range(6)] + [("f9", 3, 0, "fits", "def"), ("f9", 2, 0, "fits", "def"), ("f2", 9, 0, "fits", "def"), ("f2", 9, 0, None, "def"), (None, 1, 0, "fits", "ref")]
    tags = tagged(spark, rows)
    want = {(f"f{k}", d, "fits", 5 + k, n) for k in range(6) for d, n in (("f9", 2), ("f2", 9)) if f"f{k}" != d}
    cols = ("src", "dst", "name", "ref_line", "def_line")
    assert {tuple(r[c] for c in cols) for r in G.symbol_edges(tags).collect()} == want
    monkeypatch.setattr(G, "LOUD", 20)  # both common symbols are found first
    edges = G.symbol_edges(tags)
    assert {tuple(r[c] for c in cols) for r in edges.collect()} == want
    assert "LeftAnti" in plan_of(edges) and "BroadcastHashJoin" in plan_of(edges)
    monkeypatch.setattr(G, "SMALL", 0)  # too many to broadcast
    assert {tuple(r[c] for c in cols) for r in G.symbol_edges(tags).collect()} == want
    assert {tuple(r) for r in G.rank_edges(tags).collect()} == {(a, b, 1) for a, b, *_ in want}


def test_symbols_of_files_are_those_of_their_tags(spark, tmp_path):
    docs = [(1, "The cat\nthe a cat9 Cat\n\n x"), (2, None), (3, ""), (1, "dog the\nÄpfel K1"), (4, "one\none two")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counted = lambda sides: {tuple(r) for r in G.symbol_counts(sides).collect()}
    want = counted(G.symbol_sides(T.tags(spark, str(tmp_path))))
    assert counted(T.symbols(spark, str(tmp_path))) == counted(G.symbol_sides(T.tags(spark, str(tmp_path), True))) == want and len(want) > 6


def test_ranks_move_and_edges_do_not(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "c", 1)], "src string, dst string, weight long")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = {r["node"]: r["rank"] for r in G.pagerank(nodes, edges.mapInPandas(counted, edges.schema), rounds=2).collect()}
    assert read.value == 3  # each edge once
    r = dict.fromkeys("abcd", 0.25)
    for _ in range(2):
        lost = (r["c"] + r["d"]) / 4
        r = {n: 0.85 * (into + lost) + 0.15 / 4 for n, into in {"a": 0, "b": r["a"] * 2 / 3, "c": r["a"] / 3 + r["b"], "d": 0}.items()}
    assert all(abs(got[n] - r[n]) < 1e-12 for n in "abcd")
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_file_statistics_move_texts_and_no_tags(spark):
    stats = G.file_tag_stats(T.tags(spark, SF, True))
    assert moved(stats) and all(re.fullmatch(r"rel_path#\d+, \d+", x) for x in moved(stats))
    tags = tagged(spark, [("f", 2, 0, "b", "def"), ("f", 1, 3, "a", "ref"), ("f", 1, 0, "b", "def"), ("f", 1, 0, "doc", "doc"), ("g", 7, 2, "z", "ref"), ("g", 7, 1, "y", "ref"), (None, 1, 0, "q", "def")])
    assert {tuple(r[:3]) + (tuple(r[3]), tuple(r[4])) for r in G.file_tag_stats(tags).collect()} == {("f", 2, 1, ("b",), (1, 2)), ("g", 0, 2, ("y", "z"), ())}


def test_changed_symbols_do_not_move_tags(spark):
    spans = T.table(spark, SF, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("rel_path"), F.lit(2).alias("start"), F.lit(3).alias("end"))
    found = H.changed_symbols(T.tags(spark, SF, True), spans)
    assert "ShuffledHashJoin [rel_path" in plan_of(found) and not any("name" in x or "symbol" in x for x in moved(found))
    tags = tagged(spark, [("f", n, 0, f"n{n}", "def") for n in (1, 255, 256, 257, 263, 266, 600)] + [("f", 600, 1, "n266", "ref")])
    near = spark.createDataFrame([("f", 258, 260), ("f", 900, 900)], "rel_path string, start int, end int")
    assert [tuple(r) for r in H.changed_symbols(tags, near).orderBy("distance", "symbol").collect()] == [("f", "n257", 1), ("f", "n256", 2)]


def test_each_edge_is_read_once_for_neighbours(spark):
    edges = spark.createDataFrame([(a, b, 1) for a, b in ("ab", "cb", "aa", "ba", "da", "ea", "fa", "ga")], "src string, dst string, weight long")
    got = G.neighbours(edges)
    assert plan_of(got).count("Scan ExistingRDD") == 1
    assert {r["node"]: tuple(r)[1:] for r in got.collect()} == {"a": (5, 1, list("bdefg"), ["b"]), "b": (2, 1, ["a", "c"], ["a"]), **{x: (0, 1, [], ["b" if x == "c" else "a"]) for x in "cdefg"}}


def test_only_tags_of_boundary_symbols_are_moved(spark):
    impact = spark.createDataFrame([(p, ["hub", p], ["x", "y"]) for p in ("p1", "p2")], "path string, path_from_seed array<string>, boundary array<string>")
    tags = tagged(spark, [("hub", n, 0, "x", "def") for n in range(20, 0, -1)] + [("p1", 3, 1, "y", "ref"), ("p1", 1, 0, "other", "def"), ("p2", 2, 0, "x", "def")])
    places = G.boundary_locations(impact, tags)
    assert "LeftSemi" in plan_of(places)
    got = {(r["path"], r["k"]): (r["rel_path"], r["name"], r["line"]) for r in places.collect()}
    assert got == {(p, k): ("hub", "x", k) for p in ("p1", "p2") for k in range(1, 13)}
    files = spark.createDataFrame([("hub", "\n".join(f"l{n}" for n in range(1, 21))), ("p1", "a")], "rel_path string, text string")
    shown = A.boundary_snippets(places, files)
    by_path = re.findall(r"Exchange hashpartitioning\(path#[^\n]*\n(?:[^\n]*(?:WindowGroupLimit|Sort) [^\n]*\n)*[^\n]*Project \[([^\n]*)\]\n", plan_of(shown))
    assert by_path and not any(re.search(r"(?:^|, )(?:parts|text)#\d+(?:,|$)", columns) for columns in by_path)  # excerpts move, texts do not
    assert {(r["path"], r["position"]): r["excerpt"] for r in shown.collect()} == {(p, k): "\n".join(f"{n}: l{n}" for n in range(max(1, k - 1), k + 2)) for p in ("p1", "p2") for k in range(1, 7)}
