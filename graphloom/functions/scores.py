"""Ranking arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = frozenset("with which where when what was those this their the that its into how from for are and an a".split())
CHANGED = {0: (0.08, 8.0), 1: (0.03, 2.5)}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def scale_multiplier(m, w=1.0) -> Column:
    """The excess over 1, weighted."""
    return 1 + F.greatest(lit(m) - 1, F.lit(0.0)) * F.greatest(lit(w), F.lit(0.0))


def scale_floor(f, w=1.0) -> Column:
    """R2"""
    return F.greatest(lit(f), F.lit(0.0)) * F.greatest(lit(w), F.lit(0.0))


def query_terms(query: str) -> list[str]:
    """Lower-case terms of two letters or more, without stop words, first seen first."""
    parts = re.findall(r"[a-z0-9]+", query.lower())
    return list(dict.fromkeys(p for p in parts if len(p) > 1 and p not in STOP_WORDS))


def query_context(rank: Column, path_hits: Column, symbol_hits: Column, w: float = 1.0) -> tuple[Column, Column]:
    """(floored rank, boost)."""
    floor = (0.02 * path_hits + 0.05 * symbol_hits) * max(w, 0.0)
    boost = F.least((1 + 0.75 * path_hits * max(w, 0.0)) * (1 + 1.25 * symbol_hits * max(w, 0.0)), scale_multiplier(8.0, w))
    hit = (path_hits + symbol_hits) > 0
    return F.when(hit, F.greatest(rank, floor)).otherwise(rank), F.when(hit, boost).otherwise(F.lit(1.0))


def role_context(entry: Column, api: Column, is_test: Column, w_entry: float = 1.0, w_api: float = 1.0) -> tuple[Column, Column]:
    """(floor, boost) from the numbers of entrypoint and public-API signals."""
    damp_b, damp_f = F.when(is_test, 0.35).otherwise(1.0), F.when(is_test, 0.25).otherwise(1.0)

    def one(n: Column, base: float, step: float, top: float, floor: float, more: float, w: float) -> tuple[Column, Column]:
        boost = scale_multiplier(F.least(base + step * (n - 1), F.lit(top)), w)
        return F.when(n > 0, scale_floor(floor + more * F.least(n, F.lit(3)), w) * damp_f).otherwise(0.0), F.when(n > 0, 1 + (boost - 1) * damp_b).otherwise(1.0)

    f1, b1 = one(entry, 1.5, 0.15, 2.0, 0.05, 0.01, w_entry)
    f2, b2 = one(api, 1.3, 0.1, 1.8, 0.035, 0.005, w_api)
    return F.greatest(f1, f2), b1 * b2


def changed_context(distance: Column) -> tuple[Column, Column]:
    """(floor, boost) by distance from a changed file; null is (0, 1)."""
    d = distance
    floor = F.when(d.isNull(), 0.0).when(d == 0, CHANGED[0][0]).when(d == 1, CHANGED[1][0]).otherwise(0.015)
    boost = F.when(d.isNull(), 1.0).when(d == 0, CHANGED[0][1]).when(d == 1, CHANGED[1][1]).otherwise(F.greatest(F.lit(1.25), 2.25 - 0.25 * d))
    return floor, boost


def tag_score(rank: Column, is_ident: Column, is_file: Column, is_chat: Column, boost: Column, w_ident: float = 1.0, w_file: float = 1.0, w_chat: float = 1.0) -> Column:
    """R8"""
    one = F.lit(1.0)
    return (
        rank
        * F.when(is_ident, scale_multiplier(10.0, w_ident)).otherwise(one)
        * F.when(is_file, scale_multiplier(5.0, w_file)).otherwise(one)
        * F.when(is_chat, scale_multiplier(20.0, w_chat)).otherwise(one)
        * boost
    )


def action_confidence(kind: Column, distance: Column, hunk: Column, is_test: Column, is_config: Column, is_api: Column, is_entry: Column) -> Column:
    """R13, rounded half to even as the decimals stand."""
    base = F.lit(0.6)
    for k, v in (("start_here", 0.52), ("check_config_assumption", 0.64), ("open_direct_neighbor", 0.72), ("run_nearby_test", 0.82), ("open_changed_boundary", 0.9)):
        base = F.when(kind == k, v).otherwise(base)
    near = F.when(hunk == 0, 0.05).when(hunk == 1, 0.03).when(hunk >= 3, -0.04).otherwise(0.0)
    role = (
        F.when(is_test & (kind == "run_nearby_test"), 0.04).otherwise(0.0)
        + F.when(is_config & (kind == "check_config_assumption"), 0.04).otherwise(0.0)
        + F.when(is_api & (kind == "open_changed_boundary"), 0.03).otherwise(0.0)
        + F.when(is_entry & (kind == "open_direct_neighbor"), 0.02).otherwise(0.0)
    )
    score = base - F.greatest(distance - 1, F.lit(0)) * 0.05 + near + role
    return F.bround(F.greatest(F.least(score, F.lit(0.98)), F.lit(0.15)).cast("decimal(10,6)"), 2).cast("double")


def hunk_label(first: Column, last: Column) -> Column:
    """F14"""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
