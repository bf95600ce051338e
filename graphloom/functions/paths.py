"""Predicates and signals of repository paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_DIRS = ("__tests__", "spec", "specs", "test", "tests")
#: Order in which test folders are tried for a source file.
CANDIDATE_TEST_DIRS = tuple("tests test __tests__ spec specs".split())
INTEGRATION = ("system", "scenarios", "scenario", "integrations", "integration", "features", "feature", "end_to_end", "e2e", "acceptance")
_SCRIPT = ("js", "jsx", "ts", "tsx")
ENTRY_NAMES = tuple(sorted({f"{s}.{e}" for s in ("app", "index", "main", "server") for e in _SCRIPT} | {f"{s}.py" for s in ("__main__", "app", "asgi", "cli", "main", "manage", "server", "wsgi")}))
ENTRY_DIRS = ("scripts", "cmd", "bin")
API_NAMES = tuple(sorted({f"{s}.{e}" for s in ("api", "index", "route") for e in _SCRIPT} | {f"{s}.{e}" for s in ("client", "router", "routes", "urls") for e in ("js", "py", "ts")} | {"__init__.py", "api.py"}))
API_DIRS = ("public", "routers", "router", "routes", "route", "apis", "api")
SOURCE_ROOTS = ("app", "lib", "source", "src")
_DOTTED = ("dockerignore", "env", "env.example", "env.local", "flake8", "gitattributes", "gitignore", "pylintrc", "pytest.ini")
IMPORTANT = tuple(
    sorted(
        {f".{x}" for x in _DOTTED}
        | {f"README{e}" for e in ("", ".md", ".rst", ".txt")}
        | {f"LICENSE{e}" for e in ("", ".md", ".txt")}
        | {f"CHANGELOG.{e}" for e in ("md", "txt")}
        | {f"build.gradle{e}" for e in ("", ".kts")}
        | {f"docker-compose.{e}" for e in ("yaml", "yml")}
        | {f"composer.{e}" for e in ("json", "lock")}
        | {f"Cargo.{e}" for e in ("lock", "toml")}
        | {f"go.{e}" for e in ("mod", "sum")}
        | {f"{m}akefile" for m in "Mm"}
        | {f"{p}.ini" for p in ("mypy", "pytest", "tox")}
        | {f"setup.{e}" for e in ("cfg", "py")}
        | {"readme.md", "CMakeLists.txt", "CODE_OF_CONDUCT.md", "CONTRIBUTING.md", "COPYING", "Dockerfile", "Gemfile", "Gemfile.lock", "HISTORY.md", "Pipfile", "npm-shrinkwrap.json", "package-lock.json", "package.json", "pom.xml", "pyproject.toml", "requirements.txt", "yarn.lock"}
    )
)

#: (signal, regex) in the order in which they are tried on a line; Java and RE2 agree on these.
ENTRY_SIGNALS = (
    ("python_main_guard", r"""if\s+__name__\s*={2}\s*(?:"|')__main__(?:"|')"""),
    ("main_function", r"\b(?:(?:func|def)|static\s+void)\s+main\s*\("),
    ("server_bootstrap", r"\b(?:(?:server|app)\.listen|uvicorn\.run|createServer)\s*\("),
    ("cli_bootstrap", r"\b(?:typer\.Typer|click\.command|argparse\.ArgumentParser)\b"),
    ("web_app_factory", r"\b(?:express|Flask|FastAPI)\s*\("),
)
API_SIGNALS = (
    ("route_definition", r"@\w*(?:app\.route|router\.(?:delete|get|patch|post|put))|\b(?:app|router)\.(?:delete|get|patch|post|put)\s*\("),
    ("api_router", r"\b(?:Blueprint|APIRouter)\s*\("),
    ("explicit_exports", r"\bexport\s+(?:class|const|function|interface|type)\b|\b(?:module\.exports|__all__)\b|\bexports\.\w+\b"),
    ("package_reexports", r"^[\t ]*from[\t ]+\.[\w.]+\s+import\s"),
    ("url_patterns", r"\burlpatterns\b"),
)


def normal(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def _any(parts: Column, names) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def is_next_route(path: Column) -> Column:
    p = F.lower(normal(path))
    up = parents(p)
    return basename(p).isin(*[f"route.{e}" for e in _SCRIPT]) & F.array_contains(up, "app") & F.array_contains(up, "api")


def is_test_file(path: Column, dirs=TEST_DIRS) -> Column:
    p = F.lower(normal(path))
    name = basename(p)
    by_name = name.rlike(r"^test_|_test\.py$|\.test\.|\.spec\.") | stem(name).rlike(r"^test_|_test$|_spec$")
    return ~is_next_route(path) & (_any(parents(p), dirs) | by_name)


def is_integration_test(path: Column, markers=INTEGRATION) -> Column:
    p = F.lower(normal(path))
    return _any(F.split(p, "/"), markers) | stem(basename(p)).rlike("|".join(markers))


def is_important(path: Column) -> Column:
    """Known names, workflow files and files right under .github and docs."""
    p = normal(path)
    name = basename(p)
    up = F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))
    folder = (
        ((up == ".github/workflows") & name.rlike(r"\.ya?ml$"))
        | ((up == ".github") & name.rlike(r"\.(md|ya?ml)$"))
        | ((up == "docs") & name.rlike(r"\.(md|rst|txt)$"))
    )
    return folder | name.isin(*IMPORTANT)


def entry_signals(path: Column) -> Column:
    p = F.lower(normal(path))
    return F.array_compact(F.array(F.when(basename(p).isin(*ENTRY_NAMES), F.lit("entrypoint_filename")), F.when(_any(parents(p), ENTRY_DIRS), F.lit("entrypoint_directory"))))


def api_signals(path: Column) -> Column:
    p = F.lower(normal(path))
    return F.array_compact(
        F.array(
            F.when(basename(p).isin(*API_NAMES), F.lit("public_api_filename")),
            F.when(_any(parents(p), API_DIRS), F.lit("public_api_directory")),
            F.when(is_next_route(path), F.lit("public_api_next_route")),
        )
    )


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A glob as an anchored regex, and whether it is matched with the base name only.
    Works in Java, RE2 and Python."""
    p = re.sub(r"^(?:\./)+", "", re.sub(r"\\", "/", pattern.strip())).lstrip("/")
    if not p:
        return r"^[^\s\S]", False
    if p.endswith("/"):
        return f"^{_quoted(p.rstrip('/'))}(/.*)?$", False
    if not re.search(r"[*?\[\]]", p):
        return f"^{_quoted(p)}(/.*)?$" + ("" if "/" in p else f"|^(.*/)?{_quoted(p)}$"), False
    if "/" not in p:
        return f"^{_segment(p)}$", True
    parts = [x for x in p.split("/") if x]
    parts = [x for k, x in enumerate(parts) if x != "**" or parts[k - 1 : k] != ["**"]]
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(.*)" if last else "([^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    if parts[-1] == "**":  # zero segments: the slash before it goes as well
        head = out[: -len("(.*)")]
        out = f"{head.removesuffix('/')}(/.*)?" if head.endswith("/") else "(.*)"
    return f"^{out}$", False


def _quoted(s: str) -> str:
    return re.sub(r"([.^$+?(){}\[\]|*\\])", r"\\\1", s)


def _segment(s: str) -> str:
    out, k = "", 0
    while k < len(s):
        c = s[k]
        end = s.find("]", k + 2 if s[k + 1 : k + 2] in ("!", "]") else k + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and end > 0:
            body = s[k + 1 : end]
            neg, body = ("^", body[1:]) if body.startswith("!") else ("", body)
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("^", "\\^").replace("&", "\\&")
            out += f"[{neg}{body}]"
            k = end
        else:
            out += _quoted(c)
        k += 1
    return out


def matches_glob(path: Column, pattern: str) -> Column:
    regex, by_name = glob_regex(pattern)
    p = normal(path)
    return (basename(p) if by_name else p).rlike(f"(?s){regex}")


def scope_reason(path: Column, include=(), exclude=()) -> Column:
    """Why a path is out of scope, or null."""
    out = F.lit(None).cast("string")
    if exclude:
        hit = F.lit(False)
        for g in exclude:
            hit = hit | matches_glob(path, g)
        out = F.when(hit, F.lit("Matched configured exclude pattern"))
    if include:
        hit = F.lit(False)
        for g in include:
            hit = hit | matches_glob(path, g)
        out = F.when(~hit, F.lit("Outside configured include patterns")).otherwise(out)
    return out


def related_test_candidates(path: Column) -> Column:
    """Where tests of a source file may lie, in order of preference."""
    p = normal(path)
    name = basename(p)
    s, e = stem(name), suffix(name)
    names = F.array(name, F.concat(F.lit("test_"), s, e), F.concat(s, F.lit("_test"), e), F.concat(s, F.lit(".test"), e), F.concat(s, F.lit(".spec"), e))
    up = parents(p)
    inner = F.when(F.get(up, F.lit(0)).isin(*SOURCE_ROOTS), F.slice(up, 2, F.greatest(F.size(up), F.lit(1)))).otherwise(up)
    below = [F.concat(up, F.array(F.lit(d))) for d in CANDIDATE_TEST_DIRS]
    beside = [F.concat(F.array(F.lit(d)), inner) for d in CANDIDATE_TEST_DIRS]
    dirs = F.transform(F.array(up, *below, *beside), lambda d: F.array_join(d, "/"))
    joined = F.flatten(F.transform(dirs, lambda d: F.transform(names, lambda n: F.when(d == "", n).otherwise(F.concat(d, F.lit("/"), n)))))
    return F.array_distinct(joined)


def source_keys(path: Column) -> Column:
    """A source's folder (0) and its folder without a source root (1), each with its name; one of
    them is among the test_keys of each of its related_test_candidates."""
    p = normal(path)
    up = parents(p)
    inner = F.when(F.get(up, F.lit(0)).isin(*SOURCE_ROOTS), F.slice(up, 2, F.greatest(F.size(up), F.lit(1)))).otherwise(up)
    key = lambda k, folder: F.struct(F.lit(k).alias("k"), F.array_join(folder, "/").alias("folder"), basename(p).alias("name"))
    return F.array(key(0, up), key(1, inner))


def test_keys(path: Column) -> Column:
    """The source_keys that a source may have of which a path is a candidate."""
    name, folder = basename(path), F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))
    mark = r"(?:_test|\.test|\.spec)"
    names = F.array_distinct(F.array(name, F.regexp_replace(name, "^test_", ""), F.regexp_replace(name, rf"{mark}\z", ""), F.regexp_replace(name, rf"{mark}(\.[^.]*)\z", "$1")))
    dirs = "|".join(CANDIDATE_TEST_DIRS)
    above = F.when(folder.rlike(rf"\A(?:{dirs})\z"), F.lit("")).when(folder.rlike(rf"/(?:{dirs})\z"), F.regexp_replace(folder, rf"/(?:{dirs})\z", ""))
    beside = F.when(folder.rlike(rf"\A(?:{dirs})\z"), F.lit("")).when(folder.rlike(rf"\A(?:{dirs})/"), F.regexp_replace(folder, rf"\A(?:{dirs})/", ""))
    key = lambda k, f: F.when(f.isNotNull(), F.struct(F.lit(k).alias("k"), f.alias("folder")))
    folders = F.array_compact(F.array(key(0, folder), key(0, above), key(1, beside)))
    return F.flatten(F.transform(folders, lambda f: F.transform(names, lambda n: F.struct(f["k"].alias("k"), f["folder"].alias("folder"), n.alias("name")))))
