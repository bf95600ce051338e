"""Budget packing (T1-T4, K2) and budget resolution."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESETS = dict(zip(("small", "medium", "large", "xlarge"), (2048, 4096, 8192, 12288), strict=True))
DEFAULT, AUTO = 8192, ("auto", "dynamic")
PADDING, EXPANSION, EXPANDED_MAX = 1024, 8, 16384
BIN_DIGITS = 12


def running_cost(rows: DataFrame, cost: str, rank: str, path: str, bins: int = 64) -> DataFrame:
    """rows with `spent`: the cost of a row and all better ones (rank descending, then path).

    Rows are cut into ranges of the rank whose costs are summed first; only inside a range are
    rows sorted and summed, so no task sees all of them."""
    edges = rows.select(F.percentile_approx(rank, [k / bins for k in range(1, bins)], 1000).alias("q")).first()["q"] or []
    slot = F.lit(0)
    for e in sorted(set(edges)):
        slot = slot + F.when(F.col(rank) < e, 1).otherwise(0)
    ranged = rows.withColumn("__slot", slot)
    ahead = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__slot").agg(F.sum(cost).alias("__c")).withColumn("__start", F.coalesce(F.sum("__c").over(ahead), F.lit(0))).drop("__c")
    inside = Window.partitionBy("__slot").orderBy(F.col(rank).desc(), F.col(path)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("__in", F.sum(cost).over(inside)).join(F.broadcast(starts), "__slot").withColumn("spent", F.col("__in") + F.col("__start")).drop("__slot", "__in", "__start")  # bins rows


def pack(rows: DataFrame, budget: int, cost: str = "cost", rank: str = "rank", path: str = "rel_path") -> DataFrame:
    """Rows with `included`: the longest prefix by rank that fits; if not even the first
    row fits, the same among rows that fit alone."""
    spent = running_cost(rows, cost, rank, path)
    if spent.filter(F.col("spent") <= budget).isEmpty():
        alone = running_cost(rows.filter(F.col(cost) <= budget), cost, rank, path).filter(F.col("spent") <= budget).select(path, F.lit(True).alias("__in"))
        return rows.join(alone, path, "left").withColumn("included", F.col("__in").isNotNull()).drop("__in")
    return spent.withColumn("included", F.col("spent") <= budget).drop("spent")


def words(text: Column) -> Column:
    """the default token count, white-space words."""
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def sampled_tokens(text: Column, count=words) -> Column:
    """exact below 200 characters; else every max(1, n // 100)-th line, scaled by length."""
    lines = F.split(text, "\n")
    step = F.greatest(F.lit(1), F.floor(F.size(lines) / 100).cast("int"))
    sample = F.array_join(F.filter(lines, lambda _, i: i % step == 0), "\n")
    scaled = F.floor(count(sample) / F.length(sample) * F.length(text)).cast("long")
    return F.when(F.length(text) < 200, count(text).cast("long")).otherwise(F.coalesce(F.when(F.length(sample) > 0, scaled), count(text).cast("long")))


@dataclass(frozen=True)
class Request:
    """what was asked for. Requests that can't be read fall back to the default with a diagnostic."""

    mode: str
    raw: str
    tokens: int | None = None
    hint: str | None = None
    diagnostic: str | None = None


@dataclass(frozen=True)
class Budget:
    """what a request comes to in a scope."""

    mode: str
    tokens: int
    preset: str | None = None
    reason: str = ""
    raw: str = ""
    requested: int | None = None
    diagnostic: str | None = None


def _positive(x) -> int | None:
    try:
        n = int(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if n > 0 else None


def parse_budget(value, default: int = DEFAULT) -> Request:
    """nothing, a number, text (a number, `auto`, `dynamic` or a preset) or a mapping."""
    if isinstance(value, Request):
        return value
    plain = Request("fixed", str(default), default)
    if value is None or value == "":
        return plain
    if isinstance(value, dict):
        return _from_mapping(value, default)
    if isinstance(value, (int, float)):
        n = _positive(value)
        return Request("fixed", str(n), n) if n else replace(plain, diagnostic=f"{value!r} isn't a positive number of tokens; using {default}.")
    if not isinstance(value, str):
        return replace(plain, diagnostic=f"a {type(value).__name__} isn't a budget; using {default}.")
    text = value.strip().lower()
    if not text:
        return plain
    if n := _positive(text):
        return Request("fixed", text, n)
    if text in AUTO:
        return Request("auto", text)
    if text in PRESETS:
        return Request("ai_guided", text, hint=text)
    return Request("fixed", text, default, diagnostic=f"{value!r} is neither a number, auto nor a preset; using {default}.")


def _from_mapping(value: dict, default: int) -> Request:
    raw = json.dumps(value, sort_keys=True)
    mode = str(value.get("mode") or "").strip().lower()
    hint = str(next((value[k] for k in ("hint", "size", "budget") if value.get(k)), "")).strip().lower() or None
    tokens = _positive(next((value[k] for k in ("requested_tokens", "tokens", "token_limit") if k in value), None))
    mode = mode or ("fixed" if tokens else "ai_guided" if hint in PRESETS else "auto")
    if mode in AUTO:
        return Request("auto", raw, hint=hint)
    if mode in ("ai", "ai_guided", "guided"):
        return Request("ai_guided", raw, tokens, hint if hint in PRESETS else "medium")
    if mode == "fixed":
        return Request("fixed", raw, tokens or default)
    return Request("fixed", raw, default, diagnostic=f"{mode!r} isn't a budget mode; using {default}.")


@dataclass(frozen=True)
class Scope:
    """What decides an automatic budget; numbers, or columns of them."""

    files: int | Column
    chat: int | Column = 0
    mentioned: int | Column = 0
    terms: int | Column = 0
    changed: int | Column = 0
    depth: int | Column = 0


#: F16: score, reason and condition; the conditions hold for numbers and for columns.
SCOPE_RULES = (
    (3, "very large repository", lambda s: s.files >= 5000),
    (2, "large repository", lambda s: (s.files >= 1000) & (s.files < 5000)),
    (1, "medium repository", lambda s: (s.files >= 250) & (s.files < 1000)),
    (-1, "small repository", lambda s: s.files <= 40),
    (1, "query of three or more terms", lambda s: s.terms >= 3),
    (1, "query of seven or more terms", lambda s: s.terms >= 7),
    (1, "three or more mentioned files", lambda s: s.mentioned >= 3),
    (-1, "changed files", lambda s: s.changed > 0),
    (1, "neighbours of changed files", lambda s: (s.changed > 0) & (s.depth > 0)),
    (-2, "chat files", lambda s: s.chat > 0),
)


def auto_preset(scope: Scope) -> tuple[str, str]:
    """F16: wide scopes get larger presets, pinned ones smaller; and the first four reasons."""
    hits = [(n, why) for n, why, rule in SCOPE_RULES if rule(scope)]
    score = sum(n for n, _ in hits)
    preset = "small" if score <= -1 else "medium" if score <= 1 else "large" if score <= 3 else "xlarge"
    return preset, ", ".join(why for _, why in hits[:4]) or "ordinary repository"


def resolve_budget(request: Request, scope: Scope, context_window: int | None = None, expansion: int = EXPANSION) -> Budget:
    """a fixed budget stays; others take a preset, and grow into the context window if no
    chat files are pinned."""
    preset, why = None, "as asked"
    if request.mode == "fixed":
        tokens = request.tokens or DEFAULT
    else:
        if request.mode == "auto":
            preset, why = auto_preset(scope)
        else:
            order = list(PRESETS)
            at = order.index(request.hint if request.hint in PRESETS else "medium")
            at = min(at + 1, len(order) - 1) if scope.files >= 5000 and not scope.chat else max(at - 1, 0) if scope.chat else at
            preset, why = order[at], f"guided by {request.hint}"
        tokens = PRESETS[preset]
        if not scope.chat and context_window:
            room = min(tokens * max(1, expansion), max(0, context_window - PADDING), EXPANDED_MAX)
            if room > tokens:
                tokens, why = room, why + "; expanded into the context window"
    return Budget(request.mode, tokens, preset, why, request.raw, request.tokens, request.diagnostic)


def request_columns(text: Column, default: int = DEFAULT) -> Column:
    """F15 over a column of texts: struct of mode, raw, tokens, hint and ignored."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    n = F.when(t.rlike(r"^\+?\d+(_\d+)*$"), F.regexp_replace(t, "[+_]", "").cast("long"))
    n = F.when(n > 0, n)
    guided, auto = t.isin(*PRESETS), t.isin(*AUTO)
    mode = F.when(n.isNotNull(), "fixed").when(auto, "auto").when(guided, "ai_guided").otherwise("fixed")
    return F.struct(
        mode.alias("mode"), F.when(t == "", F.lit(str(default))).otherwise(t).alias("raw"), F.when(mode == "fixed", F.coalesce(n, F.lit(default))).alias("tokens"),
        F.when(guided, t).alias("hint"), ((mode == "fixed") & n.isNull() & (t != "")).alias("ignored"),
    )


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once, so that generated code stays small."""
    return F.transform(F.array(value), use)[0]


def _tier(scope: Scope) -> Column:
    """F16: the preset's number, from 0."""
    score = sum((F.when(rule(scope), n).otherwise(0) for n, _, rule in SCOPE_RULES[1:]), F.when(SCOPE_RULES[0][2](scope), SCOPE_RULES[0][0]).otherwise(0))
    return _bound(score, lambda s: F.when(s <= -1, 0).when(s <= 1, 1).when(s <= 3, 2).otherwise(3))


def preset_column(scope: Scope) -> Column:
    """F16 over columns: struct of preset and reasons."""
    preset = F.element_at(F.array(*map(F.lit, PRESETS)), _tier(scope) + 1)
    why = F.slice(F.array_compact(F.array(*[F.when(rule(scope), F.lit(w)) for _, w, rule in SCOPE_RULES])), 1, 4)
    return F.struct(preset.alias("preset"), _bound(why, lambda w: F.when(F.size(w) > 0, F.array_join(w, ", ")).otherwise("ordinary repository")).alias("reasons"))


def resolved_column(request: Column, scope: Scope, context_window: Column, expansion: int = EXPANSION) -> Column:
    """F17 over columns: struct of preset (null for fixed budgets) and tokens."""
    names, sizes, chat = F.array(*map(F.lit, PRESETS)), F.array(*map(F.lit, PRESETS.values())), scope.chat > 0
    hinted = F.coalesce(F.nullif(F.array_position(names, request["hint"]), F.lit(0)), F.lit(2)).cast("int") - 1
    guided = _bound(hinted, lambda k: F.when((scope.files >= 5000) & ~chat, F.least(k + 1, F.lit(len(PRESETS) - 1))).when(chat, F.greatest(k - 1, F.lit(0))).otherwise(k))
    tier = F.when(request["mode"] == "auto", _tier(scope)).when(request["mode"] == "ai_guided", guided)
    grows = ~chat & (F.coalesce(context_window, F.lit(0)) != 0)
    limit = F.least(F.greatest(F.lit(0), context_window - PADDING), F.lit(EXPANDED_MAX))

    def struct(k: Column) -> Column:
        own = F.element_at(sizes, k + 1)
        tokens = F.when(k.isNull(), request["tokens"]).when(grows, F.greatest(own, F.least(own * max(1, expansion), limit))).otherwise(own)
        return F.struct(F.when(k.isNotNull(), F.element_at(names, k + 1)).alias("preset"), tokens.cast("long").alias("tokens"))

    return _bound(tier, struct)
