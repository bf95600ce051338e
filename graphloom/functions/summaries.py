"""Summaries of documents and configuration (F3-F8, F10), as one Arrow function over file texts."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "rel_path string, summary_kind string, summary_items array<string>"


def short(value: str, n: int) -> str:
    value = " ".join(value.split())
    return value if len(value) <= n else value[: n - 3].rstrip() + "..."


def markdown(text: str) -> list[str]:
    heads, para = [], []
    for row in map(str.strip, text.splitlines()):
        if m := re.match(r"#{1,6}\s+(.+?)\s*#*$", row):
            if len(heads) < 4:
                heads.append(short(m[1], 60))
        elif row and len(para) < 2 and not row.startswith(("```", "|", "!", "<", "---")):
            para.append(row)
        elif not row and para:
            para += [""] * (2 - len(para))
    overview = " ".join(filter(None, para))
    return [f"Heading: {h}" for h in heads] + ([f"Overview: {short(overview, 90)}"] if overview else [])


def _keys(label: str, value, n: int = 4) -> list[str]:
    return [f"{label}: {', '.join(list(value)[:n])}"] if isinstance(value, dict) and value else []


def package_json(text: str) -> list[str]:
    try:
        p = json.loads(text)
    except ValueError:
        return []
    if not isinstance(p, dict):
        return []
    name = [f"Package: {p['name']}" + (f"@{p['version']}" if p.get("version") else "")] if p.get("name") else []
    return name + _keys("Scripts", p.get("scripts")) + _keys("Dependencies", p.get("dependencies")) + _keys("Dev dependencies", p.get("devDependencies"))


def dependency_names(specs) -> list[str]:
    out = (re.match(r"[A-Za-z0-9_.-]+", s.split(";")[0].split("[")[0].strip()) for s in specs if isinstance(s, str))
    return list(dict.fromkeys(m[0] for m in out if m))


def pyproject(text: str) -> list[str]:
    try:
        p = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project, build = p.get("project", {}), p.get("build-system", {})
    out = [f"Project: {project['name']}" + (f"@{project['version']}" if project.get("version") else "")] if project.get("name") else []
    deps = dependency_names(project.get("dependencies", []))[:4]
    out += [f"Dependencies: {', '.join(deps)}"] if deps else []
    out += _keys("Scripts", project.get("scripts"))
    out += [f"Build: {build['build-backend']}"] if build.get("build-backend") else []
    return out + _keys("Tooling", p.get("tool"))


def workflow(text: str) -> list[str]:
    name, found, block = None, {"on": [], "jobs": []}, None
    for row in text.splitlines():
        bare = row.split("#")[0].rstrip()
        if not bare.strip():
            continue
        if not bare[0].isspace():
            key, _, value = bare.partition(":")
            key, value = key.strip("'\" "), value.strip()
            block = key if key in found else None
            if key == "name":
                name = value.strip("'\"")
            elif key == "on" and value:
                found["on"] += [x.strip() for x in value.strip("[]").split(",") if x.strip()]
        elif block and (m := re.match(r"\s{2,}([\w-]+):", bare)) and m[1] not in found[block]:
            found[block].append(m[1])
    out = [f"Workflow: {name}"] if name else []
    return out + [f"{label}: {', '.join(found[k][:4])}" for label, k in (("Triggers", "on"), ("Jobs", "jobs")) if found[k]]


def dockerfile(text: str) -> list[str]:
    first: dict[str, str] = {}
    for row in map(str.strip, text.splitlines()):
        if m := re.match(r"(FROM|EXPOSE|ENTRYPOINT|CMD)\s+(.+)", row, re.I):
            first.setdefault(m[1].upper(), short(m[2], 60))
    return [f"{k}: {first[k]}" for k in ("FROM", "EXPOSE", "ENTRYPOINT", "CMD") if k in first]


def requirements(text: str) -> list[str]:
    rows = [r.strip() for r in text.splitlines()[:8]]
    names = dependency_names(r for r in rows if r and not r.startswith(("#", "-")))[:6]
    return [f"Dependencies: {', '.join(names)}"] if names else []


def summary_of(rel_path: str, text: str | None) -> tuple[str | None, list[str]]:
    """F10; requirements.txt ends in .txt and so is read as a document."""
    name, ext = os.path.basename(rel_path), os.path.splitext(rel_path)[1].lower()
    if not text:
        return None, []
    if ext.lstrip(".") in ("txt", "rst", "md") or name.upper().startswith("README"):
        kind, items = "doc", markdown(text)
    elif name == "package.json":
        kind, items = "config", package_json(text)
    elif name == "pyproject.toml":
        kind, items = "config", pyproject(text)
    elif rel_path.startswith(".github/workflows/") and ext in (".yml", ".yaml"):
        kind, items = "config", workflow(text)
    elif name == "Dockerfile":
        kind, items = "config", dockerfile(text)
    elif name.startswith("requirements"):
        kind, items = "config", requirements(text)
    else:
        return None, []
    return (kind, items) if items else (None, [])


def summaries(files: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *summary_of(p, t)) for p, t in zip(pdf["rel_path"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["rel_path", "summary_kind", "summary_items"])

    return files.select("rel_path", "text").mapInPandas(each, SCHEMA)
