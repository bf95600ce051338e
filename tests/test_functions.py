"""Predicates, scores, hunks and graph laws."""

import fnmatch
import re
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import paths, scores, summaries
from graphloom.operators import budget, graph, hunks, links
from graphloom.sources import git, tags

SEGMENTS = st.lists(st.sampled_from(["src", "a", "ab", "b.py", "routes.py", "x"]), min_size=1, max_size=4)
PARTS = st.lists(st.sampled_from(["src", "**", "*", "a*", "?", "*.py", "[a-b]*", "x"]), min_size=2, max_size=4).filter(lambda x: set("".join(x)) & set("*?["))


def matches(path, pattern):
    p, g = path.split("/"), pattern.split("/")

    def at(i, j):
        if j == len(g):
            return i == len(p)
        if g[j] == "**":
            return at(i, j + 1) or (i < len(p) and at(i + 1, j))
        return i < len(p) and fnmatch.fnmatchcase(p[i], g[j]) and at(i + 1, j + 1)

    return at(0, 0)


@settings(max_examples=400, deadline=None)
@given(SEGMENTS, PARTS)
def test_globs_match_segment_by_segment(path, pattern):
    path, pattern = "/".join(path), "/".join(pattern)
    regex, by_name = paths.glob_regex(pattern)
    assert not by_name
    assert bool(re.search(regex, path, re.S)) == matches(path, pattern)


@pytest.mark.parametrize(("pattern", "path", "hit"), [("opensrc/**", "opensrc/a/b.py", True), ("src/**/routes.py", "src/routes.py", True), ("src/*.py", "src/a/b.py", False), ("docs/", "docs/a", True), ("docs", "x/docs", True), ("*.md", "a/b/README.md", True), ("", "a", False)])
def test_globs(pattern, path, hit):
    regex, by_name = paths.glob_regex(pattern)
    assert bool(re.search(regex, PurePosixPath(path).name if by_name else path)) == hit


def test_query_terms():
    assert scores.query_terms("How the Auth-login flow; a x auth") == ["auth", "login", "flow"]


def test_budget_requests_fall_back_with_a_diagnostic():
    p = budget.parse_budget
    fixed = lambda x: (x.mode, x.tokens, x.diagnostic is None)
    assert fixed(p(None)) == fixed(p("")) == fixed(p("  ")) == ("fixed", 8192, True) and fixed(p(" 77 ")) == ("fixed", 77, True) and p(3000).raw == "3000"
    for bad in (0, -3, "-3", "foo", "0", [1], float("nan"), {"mode": "odd"}):
        assert fixed(p(bad)) == ("fixed", 8192, False)
    assert (p("small").mode, p("small").hint) == ("ai_guided", "small") and p("Dynamic").mode == p(" auto").mode == "auto"
    assert p({"mode": "guided"}).hint == "medium" and p({"tokens": "500"}).tokens == 500 and p({"size": "Large"}).hint == "large" and p({}).mode == "auto"
    assert p({"mode": "fixed"}).tokens == 8192 and p({"mode": "ai", "hint": "huge", "tokens": 9}) == budget.Request("ai_guided", '{"hint": "huge", "mode": "ai", "tokens": 9}', 9, "medium")


def test_budget_resolution():
    def tokens(value, files, window=None, **scope):
        return budget.resolve_budget(budget.parse_budget(value), budget.Scope(files, **scope), window).tokens

    assert tokens("auto", 24) == 2048 and tokens("auto", 100) == 4096 and tokens("auto", 1500) == 8192 and tokens("auto", 6000, terms=7) == 12288
    assert tokens("auto", 6000, terms=8, mentioned=3) == 12288 > tokens("auto", 24, chat=1) == 2048
    assert tokens("auto", 1000, changed=2) == 4096 and tokens("auto", 1000, changed=2, depth=1) == 8192
    assert tokens("large", 5000) == 12288 and tokens("large", 100, chat=1) == 4096 and tokens("small", 10, chat=2) == 2048 and tokens("xlarge", 9000) == 12288
    assert tokens("small", 100, 9000) == 9000 - 1024 and tokens("small", 100, 128000) == 16384 and tokens("small", 100, 2000) == 2048 and tokens("small", 100, 128000, chat=1) == 2048
    assert tokens(700, 6000, 128000) == 700


def test_budget_columns_equal_the_plain_rules(spark):
    given = ["auto", " LARGE ", "12", "-5", "+7", "1_0", "foo", "", None, "dynamic", "xlarge", "0"]
    rows = [(x, *s, w) for n, x in enumerate(given) for s in ((10, 0, 0, 0, 0, 0), (300, 0, 3, 7, 1, 1), (6000, 0, 0, 3, 0, 2), (6000, 2, 1, 0, 4, 0)) for w in (None, 0, 2500, 128000)]
    d = spark.createDataFrame(rows, "given string, files int, chat int, mentioned int, terms int, changed int, depth int, wide int")
    scope = budget.Scope(*[F.col(c) for c in ("files", "chat", "mentioned", "terms", "changed", "depth")])
    r = budget.request_columns(F.col("given"))
    for x in d.select("*", r.alias("r"), budget.resolved_column(r, scope, F.col("wide")).alias("b"), budget.preset_column(scope).alias("a")).collect():
        own = budget.Scope(x["files"], x["chat"], x["mentioned"], x["terms"], x["changed"], x["depth"])
        q = budget.parse_budget(x["given"])
        assert (x["r"]["mode"], x["r"]["raw"], x["r"]["tokens"], x["r"]["hint"], x["r"]["ignored"]) == (q.mode, q.raw, q.tokens, q.hint, q.diagnostic is not None)
        out = budget.resolve_budget(q, own, x["wide"])
        assert (x["b"]["preset"], x["b"]["tokens"]) == (out.preset, out.tokens) and tuple(x["a"]) == budget.auto_preset(own)


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(1, 60), max_size=25))
def test_hunks_partition_the_lines(spark, lines):
    d = spark.createDataFrame([("f", x) for x in lines], "rel_path string, line int")
    got = sorted((r["start"], r["end"]) for r in hunks.hunks(d, bucket=8).collect())
    assert sorted(x for a, b in got for x in range(a, b + 1)) == sorted(lines)
    assert all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_nearest_hunk(spark):
    spans = spark.createDataFrame([("f", 5, 7), ("f", 20, 20)], "rel_path string, start int, end int")
    d = spark.createDataFrame([("f", x) for x in (1, 5, 6, 9, 15, 30)] + [("g", 1)], "rel_path string, line int")
    assert {r["line"]: r["distance"] for r in hunks.hunk_distance(d, spans).filter("rel_path = 'f'").collect()} == {1: 4, 5: 0, 6: 0, 9: 2, 15: 5, 30: 10}


def test_diffs(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +2,2 @@\n+a\n@@ -9,2 +9,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +1 @@\n+++ b/z\n@@ -0,0 +7 @@\n"
    assert sorted((r[0], r[1]) for r in hunks.diff_lines(spark.createDataFrame([(1, text)], "id int, text string")).collect()) == [("x", 2), ("x", 3), ("z", 7)]


def test_pagerank_sums_to_one_and_paths_are_metric(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "d", 1)], "src string, dst string, weight int")
    r = {x["node"]: x["rank"] for x in graph.pagerank(nodes, edges).collect()}
    assert sum(r.values()) == pytest.approx(1, abs=1e-5) and r["c"] > r["b"] > r["a"]
    d = {(x["seed"], x["node"]): x["distance"] for x in graph.shortest_paths(edges, nodes, 4).collect()}
    assert all(d[a, c] <= d[a, b] + d[b, c] for a in "abc" for b in "abc" for c in "abc")


def test_budget_packing(spark):
    rows = spark.createDataFrame([("alpha", 3.0, 99), ("beta", 2.0, 1), ("gamma", 1.0, 1)], "rel_path string, rank double, cost int")
    took = lambda n: {r["rel_path"] for r in budget.pack(rows, n).filter("included").collect()}
    assert took(2) == {"beta", "gamma"} and took(100) == {"alpha", "beta"} and took(101) == {"alpha", "beta", "gamma"} and took(0) == set()


def test_clauses_and_candidates():
    assert links.clause_symbols("type Foo, { a as b, type C }") == [("Foo", "Foo"), ("b", "a"), ("C", "C")]
    assert links.clause_symbols("* as ns") == [("ns", "*")]
    assert links.script_candidates("x/app.ts", "./index.js")[:2] == ["x/index.js", "x/index.ts"]
    assert links.python_candidates("p/q/m.py", "r", 2) == ["p/r.py", "p/r/__init__.py"]


def test_tags():
    assert tags.python_tags("X = 1\nclass A:\n    def f(self):\n        g(h.i())\n") == [(1, "X", "def"), (2, "A", "def"), (3, "f", "def"), (4, "g", "ref"), (4, "i", "ref")]
    vue = "<template/>\n<script lang='ts' setup x=\"a>b\">\ninterface P {}\nnew Q()\n</script>"
    assert tags.tags_of("a.vue", vue)[0] == [(3, "P", "def"), (4, "Q", "ref")]
    assert {(n, k) for _, n, k in tags.tags_of("a.go", "func (s *S) Run() {\n\tGo()\n}\n// func No()\n")[0]} == {("Run", "def"), ("Go", "ref")}
    assert {k for _, _, k in tags.tags_of("a.c", "int main(void) {\n  f();\n}\n")[0]} == {"def"}
    assert tags.tags_of("a.xyz", "def f")[0] == [] and tags.tags_of("a.py", "def (")[1]


def test_summaries():
    assert summaries.summary_of("README.md", "# One\nText here\nmore\n\n## Two\n") == ("doc", ["Heading: One", "Heading: Two", "Overview: Text here more"])
    assert summaries.summary_of("package.json", '{"name": "n", "version": "1", "scripts": {"b": 1, "a": 2}}') == ("config", ["Package: n@1", "Scripts: b, a"])
    assert summaries.summary_of("pyproject.toml", '[project]\nname = "p"\ndependencies = ["a[x]>1; y"]\n')[1] == ["Project: p", "Dependencies: a"]
    assert summaries.summary_of(".github/workflows/ci.yml", "name: CI\non: [push]\njobs:\n  test:\n    runs-on: x\n")[1][:2] == ["Workflow: CI", "Triggers: push"]
    assert summaries.summary_of("c/requirements.txt", "# Deps\n")[0] == "doc" and summaries.summary_of("Dockerfile", "FROM a\nCMD b\nCMD c\n")[1] == ["FROM: a", "CMD: b"]


def test_commands():
    assert git.test_command(["tests/test a.py"], {"pyproject.toml": "[tool.pytest.ini_options]\n"}) == "pytest 'tests/test a.py'"
    assert git.test_command(["a.test.ts"], {"package.json": '{"devDependencies": {"vitest": "1", "jest": "2"}, "scripts": {"t": "vitest"}}'}) == "npx vitest run a.test.ts"
    assert git.test_command(["a.py", "b.ts"], {}) is None


def test_git_changes(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("1\n2\n3\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("1\nB\n3\n4\n")
    (tmp_path / "new.py").write_text("x\ny\n")
    got = sorted((r[0], r[1]) for r in git.changed_lines(spark, str(tmp_path)).collect())
    assert got == [("a.py", 2), ("a.py", 4), ("new.py", 1), ("new.py", 2)]


def test_entry_registers_what_it_checks():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40
    assert F  # the module is importable without a session
