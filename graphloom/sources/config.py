"""Project configuration (S19): a TOML file read forgivingly; a bad field gives a diagnostic and
its default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, make_dataclass

NAME = ".graphloom.toml"


NAMES = "chat_file mentioned_file mentioned_identifier query entrypoint public_api related_test changed changed_neighbor"
#: One factor per signal, 1 by default.
Weights = make_dataclass("Weights", [(n, float, 1.0) for n in NAMES.split()], frozen=True, module=__name__)


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    important_files: tuple[str, ...] = ()
    test_dirs: tuple[str, ...] = ()
    integration_markers: tuple[str, ...] = ()
    python_runner: str | None = None
    js_runner: str | None = None
    weights: Weights = field(default_factory=Weights)
    diagnostics: tuple[str, ...] = ()


def load_config(root: str, name: str = NAME) -> Config:
    path = os.path.join(root, name)
    if not os.path.isfile(path):
        return Config()
    notes: list[str] = []
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        return Config(diagnostics=(f"{name}: {e}",))

    def names(of: dict, key: str, lower: bool = False) -> tuple[str, ...]:
        value = of.get(key, [])
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            notes.append(f"{key}: a list of strings is needed")
            return ()
        clean = (x.replace("\\", "/").strip().removeprefix("./") for x in value)
        return tuple(dict.fromkeys(x.lower() if lower else x for x in clean if x))

    def section(key: str) -> dict:
        value = raw.get(key, {})
        if not isinstance(value, dict):
            notes.append(f"{key}: a table is needed")
            return {}
        return value

    def word(of: dict, key: str) -> str | None:
        value = of.get(key)
        if value is not None and not isinstance(value, str):
            notes.append(f"{key}: a string is needed")
            return None
        return value.strip().lower() or None if value else None

    def number(of: dict, key: str) -> float:
        value = of.get(key, 1.0)
        if isinstance(value, bool) or not isinstance(value, int | float):
            notes.append(f"{key}: a number is needed")
            return 1.0
        return max(float(value), 0.0)

    tests, weights = section("tests"), section("ranking_weights")
    for k in weights.keys() - {f.name for f in fields(Weights)}:
        notes.append(f"ranking_weights.{k}: unknown")
    out = Config(names(raw, "include"), names(raw, "exclude"), names(raw, "important_files"), names(tests, "dirs", True), names(tests, "integration_markers", True), word(tests, "python_runner"), word(tests, "js_runner"), Weights(**{f.name: number(weights, f.name) for f in fields(Weights)}))
    return Config(**{f.name: getattr(out, f.name) for f in fields(Config) if f.name != "diagnostics"}, diagnostics=tuple(notes))
