"""Tag extraction from source text.

Python is parsed with the standard library: functions, classes and module-level assignments are
definitions, calls are references. Other languages have rules of regular expressions per line,
over text whose comments and strings are blanked; this approximates a parser. Tags that come
from elsewhere can be given to the engine directly.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TAGS = "rel_path string, line int, name string, kind string, error string"
_N = r"([A-Za-z_$][\w$]*)"
_CALL = rf"\b{_N}\s*\("
_NEW = rf"\bnew\s+{_N}"
_C_DEFS = (rf"^\s*(?:typedef\s+)?(?:struct|union|enum|class)\s+{_N}", rf"^[A-Za-z_][\w\s*&:<>,]*?[\s*&]{_N}\s*\([^;]*$")
_JS_DEFS = (rf"\bfunction\s*\*?\s*{_N}", rf"\bclass\s+{_N}", rf"\b(?:const|let|var)\s+{_N}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{_N[1:-1]}\s*=>)", rf"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_N}\s*\([^)]*\)\s*\{{")
_TS_DEFS = (*_JS_DEFS, rf"\binterface\s+{_N}", rf"\btype\s+{_N}\s*(?:<[^>]*>)?\s*=", rf"\benum\s+{_N}", rf"\b(?:module|namespace)\s+{_N}", rf"\bexport\s+const\s+{_N}")
_LISP = r"([^\s()]+)"
_UP = r"([A-Z]\w*)"

#: language -> (suffixes, definitions, references); no references means none are captured.
RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "arduino": ((".ino",), (_C_DEFS[1],), (_CALL,)),
    "c": ((".c", ".h"), _C_DEFS, ()),
    "chatito": ((".chatito",), (r"^[%@~]\[([^\]]+)\]",), (r"\s[@~]\[([^\]]+)\]",)),
    "commonlisp": ((".lisp", ".cl"), (rf"\(def(?:un|class|macro|generic|method)\s+{_LISP}",), (rf"\({_LISP}",)),
    "cpp": ((".cc", ".cpp", ".cxx", ".hpp", ".hh"), _C_DEFS, ()),
    "csharp": ((".cs",), (rf"\b(?:class|interface|struct|enum|namespace)\s+{_N}", rf"^\s*(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\],?]+\s+{_N}\s*\("), (_NEW, _CALL, rf":\s*{_UP}")),
    "d": ((".d",), (rf"\b(?:class|struct|interface|enum|module)\s+{_N}", _C_DEFS[1]), (_CALL, _NEW)),
    "dart": ((".dart",), (rf"\b(?:class|enum|mixin|extension|typedef)\s+{_N}", rf"^\s*[\w<>?]+\s+{_N}\s*\([^;]*\{{"), (_CALL, _NEW)),
    "elisp": ((".el",), (rf"\(def(?:un|subst|macro)\s+{_LISP}",), ()),
    "elixir": ((".ex", ".exs"), (r"\bdef(?:p|macro|guard|delegate)?\s+([a-z_]\w*[?!]?)", r"\bdefmodule\s+([\w.]+)"), (r"\b([a-z_]\w*[?!]?)\(", rf"\b{_UP}\.")),
    "elm": ((".elm",), (r"^([a-z]\w*)\s*[^=:]*=", r"^module\s+([\w.]+)", r"^type\s+(?:alias\s+)?(\w+)"), (r"\b([a-z]\w*)\s+[\w(]", rf":\s*{_UP}")),
    "gleam": ((".gleam",), (r"\bfn\s+(\w+)", r"\btype\s+(\w+)"), (_CALL, r"\b([a-z]\w*)\.")),
    "go": ((".go",), (r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^\s*type\s+(\w+)", r"^\s*(?:var|const)\s+(\w+)", r"^package\s+(\w+)"), (_CALL, rf"\b\w+\.{_UP}")),
    "hcl": ((".hcl", ".tf"), (r'^(?:resource|data)\s+"[^"]*"\s+"([^"]+)"', r'^(?:variable|module|output|provider)\s+"([^"]+)"'), (r"\b(?:var|local|module|data)\.(\w+)",)),
    "java": ((".java",), (rf"\b(?:class|interface|enum|record)\s+{_N}", rf"^\s*(?:public|private|protected|static|final|abstract|synchronized|\s)+[\w<>\[\],.?]+\s+{_N}\s*\([^;]*$"), (_CALL, _NEW, rf"\b(?:extends|implements)\s+{_N}")),
    "javascript": ((".js", ".jsx", ".mjs", ".cjs"), _JS_DEFS, (_CALL, _NEW)),
    "kotlin": ((".kt", ".kts"), (r"\b(?:class|interface|object)\s+(\w+)", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), (_CALL, rf":\s*{_UP}")),
    "lua": ((".lua",), (r"\bfunction\s+(?:[\w.]+[.:])?(\w+)", r"\b(\w+)\s*=\s*function\b"), (_CALL,)),
    "ocaml": ((".ml",), (r"^\s*let\s+(?:rec\s+)?(\w+)", r"^\s*(?:module|type|class)\s+(?:type\s+)?(\w+)"), (r"\b([a-z]\w*)\s+[\w(]", rf"\b{_UP}\.")),
    "ocaml_interface": ((".mli",), (r"^\s*val\s+(\w+)",), ()),
    "php": ((".php",), (r"\b(?:class|interface|trait)\s+(\w+)", r"\bfunction\s+&?(\w+)"), (_CALL, _NEW)),
    "pony": ((".pony",), (r"^\s*(?:class|actor|primitive|struct|trait|interface)\s+(?:\w+\s+)?([A-Z]\w*)", r"^\s*(?:fun|be|new)\s+(?:\w+\s+)?(\w+)"), (_CALL,)),
    "properties": ((".properties",), (r"^\s*([\w.-]+)\s*[=:]",), (r"\$\{([\w.-]+)\}",)),
    "ql": ((".ql", ".qll"), (r"\b(?:class|module|newtype)\s+(\w+)", r"^\s*(?:predicate|\w+)\s+(\w+)\s*\([^)]*\)\s*\{"), (_CALL,)),
    "r": ((".r",), (r"^\s*([\w.]+)\s*(?:<-|=)\s*function",), (r"\b([\w.]+)\s*\(",)),
    "racket": ((".rkt",), (rf"\(define\s+\(?{_LISP}",), (rf"\({_LISP}",)),
    "ruby": ((".rb",), (r"^\s*(?:class|module)\s+(?:\w+::)*(\w+)", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"), (_CALL, r"\.(\w+)")),
    "rust": ((".rs",), (r"\b(?:struct|enum|union|trait|mod|type)\s+(\w+)", r"\bfn\s+(\w+)", r"\bmacro_rules!\s*(\w+)"), (_CALL, r"\b(\w+)!\s*[(\[{]", r"\bimpl(?:<[^>]*>)?\s+(\w+)")),
    "scala": ((".scala",), (r"\b(?:class|object|trait|enum|type)\s+(\w+)", r"\bdef\s+(\w+)", r"\b(?:val|var)\s+(\w+)"), (_CALL, _NEW, r"\bextends\s+(\w+)")),
    "solidity": ((".sol",), (r"\b(?:contract|interface|library|struct|enum|event)\s+(\w+)", r"\b(?:function|modifier)\s+(\w+)"), (_CALL, r"\bemit\s+(\w+)")),
    "swift": ((".swift",), (r"\b(?:class|struct|enum|protocol|extension)\s+(\w+)", r"\bfunc\s+(\w+)", r"\b(?:let|var)\s+(\w+)"), ()),
    "typescript": ((".ts", ".tsx", ".mts", ".cts"), _TS_DEFS, (_NEW, rf":\s*{_UP}")),
    "udev": ((".rules",), (r'\bLABEL="([^"]+)"', r"\bENV\{(\w+)\}="), (r'\bGOTO="([^"]+)"', r"\$env\{(\w+)\}")),
}
BY_SUFFIX = {s: lang for lang, (suffixes, _, _) in RULES.items() for s in suffixes} | {".py": "python", ".vue": "vue"}
KEYWORDS = frozenset("def fn fun func if for while switch catch return function else elif match with not and or in is typeof sizeof do new super this self".split())
_COMPILED = {lang: (tuple(map(re.compile, d)), tuple(map(re.compile, r))) for lang, (_, d, r) in RULES.items()}
_HASH = {"elixir", "r", "ruby", "properties", "udev", "hcl"}
_SEMI = {"commonlisp", "elisp", "racket"}
_SCRIPT = re.compile(r"<script\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</script\s*>", re.S | re.I)


def language_of(rel_path: str) -> str | None:
    """S9/S11"""
    m = re.search(r"\.[^./]+$", rel_path.lower())
    return BY_SUFFIX.get(m[0]) if m else None


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def masked(text: str, lang: str) -> str:
    """Text without comments; strings stay where rules read them."""
    text = re.sub(r"/\*.*?\*/", _blank, text, flags=re.S) if lang not in _HASH | _SEMI else text
    mark = "#" if lang in _HASH else ";" if lang in _SEMI else "--" if lang in ("lua", "elm") else "//"
    text = re.sub(rf"(?m)(?<![:\"'\w]){re.escape(mark)}.*$", _blank, text)
    if lang in ("hcl", "udev", "chatito", "properties"):
        return text
    return re.sub(r'"(?:\\.|[^"\\\n])*"', _blank, text)


def python_tags(text: str) -> list[tuple[int, str, str]]:
    out = []
    tree = ast.parse(text)
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else []
        out += [(node.lineno, t.id, "def") for t in targets if isinstance(t, ast.Name)]
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append((node.lineno, node.name, "def"))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append((f.lineno, f.id, "ref"))
            elif isinstance(f, ast.Attribute):
                out.append((f.end_lineno, f.attr, "ref"))
    return sorted(set(out))


def rule_tags(text: str, lang: str) -> list[tuple[int, str, str]]:
    defs, refs = _COMPILED[lang]
    out = []
    for n, body in enumerate(masked(text, lang).split("\n"), 1):
        own = {(m.start(1), m[1]) for r in defs for m in r.finditer(body)}
        out += [(n, name, "def") for _, name in sorted(own) if name not in KEYWORDS]
        seen = {(m.start(1), m[1]) for r in refs for m in r.finditer(body)} - own
        out += [(n, name, "ref") for _, name in sorted(seen) if name not in KEYWORDS]
    return out


def vue_tags(text: str) -> list[tuple[int, str, str]]:
    """Script blocks, at their own lines."""
    out = []
    for m in _SCRIPT.finditer(text):
        lang = "typescript" if re.search(r"""\blang\s*=\s*["']?tsx?\b""", m[1]) else "javascript"
        ahead = text.count("\n", 0, m.start(2))
        out += [(n + ahead, name, kind) for n, name, kind in rule_tags(m[2], lang)]
    return out


def tags_of(rel_path: str, text: str | None) -> tuple[list[tuple[int, str, str]], str | None]:
    """Tags of a file, and why it failed."""
    lang = language_of(rel_path)
    if not text or lang is None:
        return [], None
    try:
        return (python_tags(text) if lang == "python" else vue_tags(text) if lang == "vue" else rule_tags(text, lang)), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"


def extract_tags(files: DataFrame) -> DataFrame:
    """(rel_path, line, name, kind, error); a file that fails has one row with its error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["rel_path"], pdf["text"], strict=True):
                tags, error = tags_of(path, text)
                rows += [(path, n, name, kind, None) for n, name, kind in tags]
                if error:
                    rows.append((path, None, None, None, error))
            yield pd.DataFrame(rows, columns=["rel_path", "line", "name", "kind", "error"]).astype({"line": "Int32"})

    return files.select("rel_path", "text").mapInPandas(each, TAGS)
