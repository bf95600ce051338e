"""Text and JSON of collected results (K5-K9)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


def collected(report: dict[str, DataFrame]) -> dict[str, list[dict]]:
    return {k: rows(v) for k, v in report.items()}


def as_json(report) -> str:
    return json.dumps(report, default=str, indent=2, ensure_ascii=False)


def trace_text(report: dict) -> str:
    """K5"""
    if report["error"]:
        return f"No trace: {report['error']}"
    out = [" -> ".join(report["path"])]
    for k, s in enumerate(report["steps"], 1):
        out.append(f"{k}. {s['source']} -[{s['relation']}]-> {s['target']}" + (f" ({', '.join(s['symbols'])})" if s["symbols"] else ""))
        out += [f"   {h['evidence_kind']}: {h['detail'] or h['source_symbol'] or ''} at line {h['source_line']}" for h in s["hops"]]
    return "\n".join(out)


def impact_text(report: dict[str, list[dict]]) -> str:
    """K6"""
    out = ["Impacted files"]
    out += [f"  {r['path']} (distance {r['distance']} from {r['seed']}" + (f"; {', '.join(r['boundary'])}" if r["boundary"] else "") + ")" for r in report["files"]]
    for title, key, line in (
        ("Checks", "suggestions", lambda r: f"P{r['priority']} {r['kind']} {r['target']}"),
        ("Actions", "actions", lambda r: f"P{r['priority']} {r['kind']} {r['target']} [{r['target_role']}, {r['confidence']:.2f}]"),
        ("Shared symbols", "symbols", lambda r: f"{r['name']}: {r['target_count']} files"),
        ("Tests", "clusters", lambda r: f"{r['kind']}: {', '.join(r['paths'])}"),
    ):
        if report.get(key):
            out += [title, *("  " + line(r) for r in report[key])]
    return "\n".join(out)


def plan_text(report: dict[str, list[dict]]) -> str:
    """K7"""
    return "\n".join(f"{r['step']}. {r['title']}: {r['target']}" + (f" (edit {', '.join(r['candidates'])})" if r["candidates"] else "") for r in sorted(report["plan"], key=lambda r: r["step"])) or "Nothing to do"


def review_text(report: dict[str, list[dict]]) -> str:
    """K8"""
    out = ["Changed files", *(f"  {r['path']} [{r['role']}]" for r in report["changed"]), "Look at first"]
    out += [f"  P{r['priority']} {r['kind']} {r['target']} [{r['target_role']}, {r['confidence']:.2f}]" for r in report["focus"]]
    return "\n".join(out + [impact_text(report)])
