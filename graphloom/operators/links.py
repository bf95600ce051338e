"""Semantic links between files: imports and re-exports.

Statements are read per file with the candidate paths of what they name; candidates are resolved
by one join with the known files, the first that exists wins.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
SPEC = "source string, pos int, relation string, line int, source_symbol string, target_symbol string, detail string, candidates array<string>"
_NAME = r"[A-Za-z_]\w*"
_QUOTED = """(?:"|')([^'"]+)(?:"|')"""
_FROM = {kind: re.compile(rf"(?ms)^\s*{kind}\s+(.*?)\s+from\s+{_QUOTED}") for kind in ("import", "export")}
_REQUIRE = re.compile(rf"^\s*(?:var|let|const)\s+({_NAME})\s*=\s*require\(\s*{_QUOTED}\s*\)[\s;]*$")
_PY_FROM = re.compile(rf"^\s*from\s+(\.*)({_NAME}(?:[.\w]*))?\s+import\s+(\S.*?)\s*$")
_PY_IMPORT = re.compile(r"^\s*import\s+(\S.*?)\s*$")
_AS = re.compile(rf"({_NAME})\s+as\s+({_NAME})$")


def normal(path: str) -> str:
    """G16"""
    return posixpath.normpath(path).lstrip("./")


def script_candidates(source: str, spec: str) -> list[str]:
    """The path itself, its sibling suffixes, else added suffixes and index files."""
    base = posixpath.join(posixpath.dirname(source), spec) if spec.startswith(".") else spec
    stem, ext = posixpath.splitext(base)
    if ext:
        out = [base] + ([stem + s for s in SCRIPT_SUFFIXES if s != ext] if ext.lower() in SCRIPT_SUFFIXES else [])
    else:
        out = [base, *(base + s for s in SCRIPT_SUFFIXES), *(f"{base}/index{s}" for s in SCRIPT_SUFFIXES)]
    return list(dict.fromkeys(map(normal, out)))


def python_candidates(source: str, module: str, level: int = 0) -> list[str]:
    """Module or package, from the importing file's folder."""
    package = [p for p in posixpath.dirname(source).split("/") if p]
    if level > 1:
        package = package[: max(0, len(package) - (level - 1))]
    parts = package + [p for p in module.split(".") if p]
    own = "/".join(parts)
    if not parts:
        return []
    return [normal(f"{own}.py"), normal(f"{own}/__init__.py")]


def clause_symbols(clause: str) -> list[tuple[str | None, str | None]]:
    """(local, exported) names of an import clause."""
    clause = re.sub(r"^type\s+", "", clause.strip())
    if not clause:
        return [(None, None)]
    braces = re.search(r"[{]([^}]*)[}]", clause)
    if braces:
        out = []
        for part in (clause[: braces.start()].strip(" ,\n\t"), braces[1].strip()):
            out += clause_symbols(part) if part else []
        return out or [(None, None)]
    if clause.startswith("*"):
        alias = re.search(rf"\bas\s+({_NAME})", clause)
        return [(alias[1] if alias else "*", "*")]
    return import_names(clause, strip_type=True) or [(None, None)]


def import_names(names: str, strip_type: bool = False) -> list[tuple[str, str]]:
    """G14"""
    out = []
    for item in names.strip().strip("()").split(","):
        item = item.strip()
        item = re.sub(r"^type\s+", "", item) if strip_type else item
        if item:
            m = _AS.match(item)
            out.append((m[2], m[1]) if m else (item, item))
    return out


def script_specs(source: str, text: str) -> Iterator[tuple]:
    """G10"""
    for kind, relation in (("import", "imports"), ("export", "re_exports")):
        for m in _FROM[kind].finditer(text):
            line, flat = text.count("\n", 0, m.start()) + 1, " ".join(m[1].split())
            for local, exported in clause_symbols(m[1]):
                yield relation, line, local, exported, f"{kind} {flat} from {m[2]}", script_candidates(source, m[2])
    for n, body in enumerate(text.splitlines(), 1):
        if m := _REQUIRE.match(body):
            yield "imports", n, m[1], m[1], f"require({m[2]})", script_candidates(source, m[2])


def python_specs(source: str, text: str) -> Iterator[tuple]:
    """G11"""
    relation = "package_reexports" if posixpath.basename(source) == "__init__.py" else "imports"
    for n, body in enumerate(text.splitlines(), 1):
        if m := _PY_FROM.match(body):
            dots, module, names = m[1], m[2] or "", import_names(m[3])
            target = python_candidates(source, module, len(dots))
            for local, exported in names or [(None, None)]:
                yield relation, n, local, exported, f"from {dots}{module} import {m[3]}", target
            if not module:
                for local, exported in names:
                    yield relation, n, local, exported, f"from {dots or '.'} import {exported}", python_candidates(source, exported, max(len(dots), 1))
        elif m := _PY_IMPORT.match(body):
            for item in filter(None, map(str.strip, m[1].split(","))):
                alias = re.match(rf"({_NAME}[\w.]*)\s+as\s+({_NAME})$", item)
                module, local = (alias[1], alias[2]) if alias else (item, item.split(".")[-1])
                yield "imports", n, local, module.split(".")[-1], f"import {item}", python_candidates(source, module)


def semantic_links(files: DataFrame) -> DataFrame:
    """(source, target, relation, line, source_symbol, target_symbol, detail)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["rel_path"], pdf["text"], strict=True):
                ext = posixpath.splitext(path)[1].lower()
                found = script_specs(path, text or "") if ext in SCRIPT_SUFFIXES else python_specs(path, text or "") if ext == ".py" else ()
                rows += [(path, k, *x) for k, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["source", "pos", "relation", "line", "source_symbol", "target_symbol", "detail", "candidates"])

    specs = files.select("rel_path", "text").mapInPandas(each, SPEC)
    tried = specs.select("*", F.posexplode("candidates").alias("choice", "target")).join(files.select(F.col("rel_path").alias("target")).distinct(), "target")
    best = tried.groupBy("source", "pos", "relation", "line", "source_symbol", "target_symbol", "detail").agg(F.min(F.struct("choice", "target")).alias("t"))
    return best.select("source", F.col("t.target").alias("target"), "relation", "line", "source_symbol", "target_symbol", "detail").distinct()
