"""Scenarios of the five queries over small trees, with given and with extracted tags."""

import os

import pytest

from graphloom.plans.engine import CodeGraph
from graphloom.sources.config import load_config
from graphloom.sources.tree import list_files, read_tree
from graphloom.streaming.refresh import refresh

TAG = "rel_path string, line int, name string, kind string"


def tree(spark, texts, tags=None, config=None):
    files = spark.createDataFrame(list(texts.items()), "rel_path string, text string")
    return CodeGraph(files, spark.createDataFrame(tags, TAG) if tags is not None else None, config=config)


TS = {"app.ts": 'import { api } from "./index"\n', "index.ts": 'export { api } from "./service"\n', "service.ts": "export const api = () => true\n"}


@pytest.mark.parametrize("ending", ["", ".js"])
def test_reexport_trace_and_impact(spark, ending):
    texts = {k: v.replace('./index"', f'./index{ending}"').replace('./service"', f'./service{ending}"') for k, v in TS.items()}
    g = tree(spark, texts, [("service.ts", 1, "api", "def")])
    t = g.trace("app.ts", "service.ts")
    assert t["path"] == ["app.ts", "index.ts", "service.ts"]
    assert [s["relation"] for s in t["steps"]] == ["imports", "re_exports"]
    assert [s["symbols"] for s in t["steps"]] == [["api"], ["api"]]
    r = g.impact(["app.ts"], max_depth=3, max_results=5)
    assert [(x["path"], x["distance"], x["relations"]) for x in r["files"].orderBy("position").collect()] == [("index.ts", 1, ["imports"]), ("service.ts", 2, ["imports", "re_exports"])]
    a = r["actions"].first()
    assert (a["kind"], a["target"], a["target_role"]) == ("open_direct_neighbor", "index.ts", "public_api")
    assert r["plan"].first()["title"] == "Inspect public API boundary"
    assert r["clusters"].isEmpty()


def test_python_package_trace(spark):
    texts = {"consumer.py": "from package import api\n", "package/__init__.py": "from .service import api\n", "package/service.py": "def api():\n    return True\n"}
    t = tree(spark, texts, [("package/service.py", 1, "api", "def")]).trace("consumer.py", "package/service.py")
    assert t["path"] == ["consumer.py", "package/__init__.py", "package/service.py"]
    assert [s["relation"] for s in t["steps"]] == ["imports", "package_reexports"]
    assert [h["evidence_kind"] for h in t["symbol_path"]] == ["import", "package_boundary"]


def test_rank_chain_and_map(spark):
    tags = [("a.py", 1, "A", "def"), ("a.py", 2, "B", "ref"), ("b.py", 1, "B", "def"), ("b.py", 2, "C", "ref"), ("c.py", 1, "C", "def")]
    g = tree(spark, {f"{x}.py": f"def {x.upper()}(): pass\nx\n" for x in "abc"}, tags)
    rank = {r["rel_path"]: r["base_rank"] for r in g.ranked().collect()}
    assert rank["c.py"] > rank["b.py"] > rank["a.py"]
    assert rank["a.py"] == pytest.approx(0.184417, abs=1e-5) and rank["c.py"] == pytest.approx(0.474412, abs=1e-5)
    text, chosen = g.map(1000)
    assert [r["rel_path"] for r in chosen.collect()] == ["c.py", "b.py", "a.py"]
    assert text.startswith("c.py:\n(Rank value: ") and "   1: def C(): pass" in text


def test_important_document_is_kept(spark):
    g = tree(spark, {"README.md": "# Title\ntext\n", "main.py": "def main():\n    pass\n"})
    rows = {r["rel_path"]: r for r in g.ranked().collect()}
    assert rows["README.md"]["extra_lines"] == [1] and rows["README.md"]["definition_count"] == 0
    assert rows["main.py"]["definition_count"] == 1
    assert {"important_file", "doc_summary"} <= {x["code"] for x in rows["README.md"]["reasons"]}


def test_query_boosts_and_weight_zero(spark):
    from graphloom.sources.config import Config, Weights

    tags = [("auth_service.py", 1, "AuthService", "def"), ("auth_service.py", 2, "login_user", "def"), ("billing.py", 1, "Invoice", "def")]
    texts = {"auth_service.py": "x", "billing.py": "x"}
    rows = {r["rel_path"]: r for r in tree(spark, texts, tags).ranked(query="auth login flow").collect()}
    assert rows["auth_service.py"]["path_terms"] == ["auth"] and rows["auth_service.py"]["symbol_terms"] == ["auth", "login"]
    assert rows["auth_service.py"]["rank"] > rows["billing.py"]["rank"]
    off = {r["rel_path"]: r["rank"] for r in tree(spark, texts, tags, Config(weights=Weights(query=0.0))).ranked(query="auth").collect()}
    assert off["auth_service.py"] == pytest.approx(off["billing.py"])


def test_trace_uses_related_tests(spark):
    tags = [("app.py", 2, "Service", "ref"), ("service.py", 1, "Service", "def")]
    g = tree(spark, {"app.py": "", "service.py": "x", "tests/test_service.py": "x"} | {"app.py": "x"}, tags)
    t = g.trace("app.py", "tests/test_service.py")
    assert [s["relation"] for s in t["steps"]] == ["references", "related_test"]
    assert g.trace("app.py", "no.py")["error"]


def test_changed_neighbours(spark):
    tags = [("changed.py", 1, "Shared", "ref"), ("neighbor.py", 1, "Shared", "def"), ("unrelated.py", 1, "Other", "def"), ("changed.py", 2, "Own", "def")]
    g = tree(spark, {p: "x" for p in ("changed.py", "neighbor.py", "unrelated.py")}, tags)
    assert {r["rel_path"]: r["changed_distance"] for r in g.ranked(changed=["changed.py"], neighbors=1).collect()} == {"changed.py": 0, "neighbor.py": 1}


def test_changed_symbol_impact_and_review(spark):
    tags = [("app.py", 2, "Service", "ref"), ("app.py", 3, "helper", "ref"), ("service.py", 1, "Service", "def"), ("util.py", 1, "helper", "def")]
    g = tree(spark, {"app.py": "a\nb\nc\n", "service.py": "x", "util.py": "x", "api/routes.py": "x"}, tags)
    changed = spark.createDataFrame([("app.py", 2)], "rel_path string, line int")
    r = g.impact(["app.py"], changed)
    a = r["actions"].filter("kind = 'open_changed_boundary'").first()
    assert (a["target"], a["confidence"], a["focus_symbols"]) == ("service.py", 0.95, ["Service"])
    more = changed.union(spark.createDataFrame([("api/routes.py", 3)], "rel_path string, line int"))
    kinds = [x["kind"] for x in g.review(more)["focus"].collect()]
    assert kinds[:2] == ["review_changed_public_api", "review_changed_entrypoint"]


def test_search_order(spark):
    g = tree(spark, {"a.py": "x", "b.py": "x"}, [("a.py", 1, "my_user", "ref"), ("b.py", 2, "user_def", "def"), ("a.py", 3, "USER", "ref")])
    assert [r["name"] for r in g.search("User").collect()] == ["user_def", "USER", "my_user"]
    assert g.search("user", references=False).count() == 1


def test_tree_source(spark, tmp_path):
    for p in ("pkg/__init__.py", "pkg/a.py", ".hidden/x.py", "node_modules/m.js", "src/b.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("def f():\n    g()\n" if p.endswith("py") else "class K {}\n")
    (tmp_path / "bad.py").write_bytes(b"def (\xff\n")
    os.symlink("/etc/hostname", tmp_path / "out.txt")
    assert {os.path.relpath(p, tmp_path) for p in list_files(str(tmp_path))} == {"bad.py", "pkg/__init__.py", "pkg/a.py", "src/b.ts"}
    g = CodeGraph.from_tree(spark, str(tmp_path))
    assert {(r["rel_path"], r["name"], r["kind"]) for r in g.tags.collect()} == {("pkg/__init__.py", "f", "def"), ("pkg/__init__.py", "g", "ref"), ("pkg/a.py", "f", "def"), ("pkg/a.py", "g", "ref"), ("src/b.ts", "K", "def")}
    assert g.failures.first()["rel_path"] == "bad.py"
    snap = str(tmp_path / "snap")
    files = read_tree(spark, str(tmp_path / "pkg"))
    assert refresh(files, snap).count() == 4
    (tmp_path / "pkg/a.py").write_text("def changed():\n    pass\n")
    os.utime(tmp_path / "pkg/a.py", ns=(1, 1))
    assert {r["name"] for r in refresh(read_tree(spark, str(tmp_path / "pkg")), snap).filter("rel_path = 'a.py'").collect()} == {"changed"}


def test_config_is_forgiving(tmp_path):
    (tmp_path / ".graphloom.toml").write_text('include = ["./src/**"]\nexclude = 3\n[ranking_weights]\nquery = -2\nchat_file = "x"\n')
    c = load_config(str(tmp_path))
    assert c.include == ("src/**",) and c.exclude == () and c.weights.query == 0.0 and c.weights.chat_file == 1.0 and len(c.diagnostics) == 2


def test_map_shows_highlights_and_actions_have_anchors_texts_and_commands(spark):
    texts = {"lib.ts": "export function api() {\n  return 1;\n}\n", "lib.test.ts": "import { api } from './lib';\ntest('x', () => api());\n", "README.md": "# Guide\n\nSome text\n", "package.json": '{"name": "p", "devDependencies": {"vitest": "1"}}'}
    g = tree(spark, texts, [("lib.ts", 1, "api", "def"), ("lib.test.ts", 2, "api", "ref")])
    r = g.impact(["lib.ts"], spark.createDataFrame([("lib.ts", 1)], "rel_path string, line int"))
    run = {a["kind"]: a for a in r["actions"].collect()}["run_nearby_test"]
    assert run["target"] == "lib.test.ts" and run["command"] == "npx vitest run lib.test.ts" and run["risk"] == "low" and "lib.ts" in run["why"]
    # only the test relation leads here, so there is no boundary symbol and the anchor is the file's first line
    assert (run["anchor"]["file"], run["anchor"]["highlight_line"], run["anchor"]["kind"]) == ("lib.test.ts", 1, "file") and "2: test('x'" in run["anchor"]["excerpt"]
    assert r["clusters"].first()["command"] == "npx vitest run lib.test.ts"
    text, _ = g.map("small")
    assert "(Doc Highlights)\n- Heading: Guide" in text
