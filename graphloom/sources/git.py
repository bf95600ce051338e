"""Changes of a git working tree (S13, S17, S18, X17, X18), and test commands."""

from __future__ import annotations

import json
import os
import shlex
import subprocess
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.hunks import diff_lines, with_untracked

OWN = ".graphloom."


def git(root: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=False)
    if out.returncode:
        raise ValueError(out.stderr.strip() or f"git {args[0]} failed")
    return out.stdout


def branch(root: str) -> str:
    name = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return name if name != "HEAD" else f"detached@{git(root, 'rev-parse', '--short', 'HEAD').strip()}"


def changed_lines(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """(rel_path, line) of added, changed, moved and untracked lines under root."""
    how = ("--relative", "--no-ext-diff", "--no-color", "-U0", "--diff-filter=ACMR")
    diffs = [git(root, "diff", *how, f"{base}...HEAD")] if base else []
    diffs += [git(root, "diff", *how), git(root, "diff", *how, "--cached")]
    rows = diff_lines(spark.createDataFrame(list(enumerate(diffs)), "id int, text string"))
    new = []
    for path in filter(None, git(root, *"ls-files -z --exclude-standard --others".split()).split("\0")):
        full = os.path.join(root, path)
        if os.path.isfile(full):
            with open(full, "rb") as f:
                new.append((path, len(f.read().decode("utf-8", "ignore").splitlines())))
    out = with_untracked(rows, spark.createDataFrame(new, "rel_path string, n_lines int"))
    return out.filter(~F.exists(F.split("rel_path", "/"), lambda x: x.startswith(OWN)))


def python_runner(root_files: dict[str, str], configured: str | None = None) -> str | None:
    """root_files: name -> text."""
    if configured:
        return configured
    if {"pytest.ini", ".pytest.ini", "conftest.py"} & root_files.keys():
        return "pytest"
    try:
        tools = tomllib.loads(root_files.get("pyproject.toml", "")).get("tool", {})
    except tomllib.TOMLDecodeError:
        tools = {}
    texts = (root_files.get(n, "") for n in ("requirements.txt", "setup.cfg", "tox.ini", "pyproject.toml"))
    return "pytest" if "pytest" in tools or any("pytest" in t for t in texts) else None


def js_runner(root_files: dict[str, str], configured: str | None = None) -> str | None:
    """F19"""
    if configured:
        return configured
    try:
        package = json.loads(root_files.get("package.json") or "{}")
    except ValueError:
        return None
    package = package if isinstance(package, dict) else {}
    known = [v for k in ("scripts", "dependencies", "devDependencies") if isinstance(package.get(k), dict) for p in package[k].items() for v in map(str, p)]
    return next((r for r in ("vitest", "jest", "mocha") if any(r in v for v in known)), None)


def test_command(paths: list[str], root_files: dict[str, str], python: str | None = None, js: str | None = None) -> str | None:
    """one command for tests of one kind."""
    kinds = {os.path.splitext(p)[1].lower() for p in paths}
    quoted = " ".join(shlex.quote(p) for p in paths[:6])
    if not paths:
        return None
    if kinds == {".py"}:
        runner = python_runner(root_files, python)
        return f"pytest {quoted}" if runner == "pytest" else f"python -m unittest {quoted}" if runner == "unittest" else None
    if kinds <= set(".ts .tsx .js .jsx".split()):
        runner = js_runner(root_files, js)
        return {"vitest": f"npx vitest run {quoted}", "jest": f"npx jest {quoted}", "mocha": f"npx mocha {quoted}"}.get(runner or "")
    return None
