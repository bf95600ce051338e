"""The command line and its reports over one small tree."""

import json

import pytest

from graphloom import cli


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    (d / "app.py").write_text("from service import Service\n\ndef main():\n    Service().run()\n")
    (d / "service.py").write_text("class Service:\n    def run(self):\n        pass\n")
    (d / "tests").mkdir()
    (d / "tests/test_service.py").write_text("def test_run():\n    pass\n")
    return str(d)


def test_modes(spark, root):
    ask = lambda *a: cli.run(spark, cli.arguments(["--root", root, *a]))
    assert "app.py -> service.py" in ask("--trace-from", "app.py", "--trace-to", "service.py")
    impact = json.loads(ask("--impact-from", "app.py", "--output-format", "json"))
    assert [r["path"] for r in impact["files"]] == ["service.py", "tests/test_service.py"]
    assert ask("--search", "serv").startswith("service.py:1 def Service")


def test_guards(root):
    for bad in (["--review", "--impact-changed"], ["--trace-from", "a"], ["--edit-plan"]):
        with pytest.raises(SystemExit):
            cli.arguments(["--root", root, *bad])
