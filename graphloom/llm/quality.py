"""Operator 8: quality rules and robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated 8-word windows of whole texts. On
top, each text's transformed statistics are a vector, and texts far from the robust centre of
their language and source are rejected. Centre and scatter are minimum-covariance-determinant
estimates: from three starts, each concentration step keeps the H nearest share of a group and takes
their mean and covariance, over all rows; the start of the least determinant goes on until the
determinant settles, and the least determinant met is the estimate. A step is one aggregation of
counts, sums and products by (group, distance bin), so a source with a third of all rows is summed
before it is shuffled; the share is met to a bin, about 3 % of a squared distance. Coordinates are
rounded to a grid of 1/256, which makes all sums exact and reruns equal. Variances have a floor, so a
statistic that hardly varies in a group can't reject alone.

Estimates are made for each (language, source), each language and all rows, and drawn towards those
of the group above by the weight of PRIOR rows, so that a small group is judged mostly as its language.

Nulls: a null text has no words (and so fails the base rules); null language and source are groups
like any other. Repeated rows count as often as they occur. Other columns of the input may have any
names; only those of the results give way. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, saved, small, small_batches, table

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
GRID = 256
#: How many rows the group above counts as when a group's estimates are drawn towards its.
PRIOR = 100
#: Share of a group that a concentration step keeps, and steps before the best start is chosen.
H, FIRST_STEPS = 0.75, 2
#: Steps end when no group's log determinant falls by more.
SETTLED = 1e-3
#: Squared distances are binned on a log scale, BINS_PER_E to a factor of e.
BINS_PER_E = 32
FLOOR = 0.02
#: Squared distance, scaled so that the group's median is a chi-square's, beyond which a text goes.
CUT = 200.0
DIMS = ("log_words", "word_length", "symbols", "uppercase", "punctuation", "distinct")
#: Median of chi-square with len(DIMS) degrees of freedom.
CHI2_MEDIAN = len(DIMS) * (1 - 2 / (9 * len(DIMS))) ** 3
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[0x80:0xC0] = 2  # continuation bytes
_KIND[list(SYMBOLS)] = 3
_KIND[65:91] = 4
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x not in SYMBOLS]] = 5
_SPREAD = np.random.default_rng(8).integers(1, 2**63, 1 << 16, dtype=np.uint64)


def repeat_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words inside windows that occur twice or more, and the number of distinct words."""
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, np.int64)
    distinct = int(codes.max()) + 1 if len(codes) else 0
    n = len(codes) - window + 1
    if n < 2:
        return 0, distinct
    x = codes.astype(np.uint64)
    x = (x + np.uint64(1)) * _SPREAD[0]
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += x[k : k + n] * _SPREAD[2 * k + 1]
    h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0, distinct
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), distinct


def statistics(text: str | None) -> tuple:
    """The five base statistics, then the coordinates on the grid."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    kind = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
    chars = int(len(raw) - kind[1] - kind[2])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, distinct = repeat_words(words)
    size = max(n, 1)
    point = (
        np.log1p(n),
        np.log1p(chars / size) * 2,
        np.sqrt(kind[3] / size) * 4,
        np.sqrt(kind[4] / max(chars, 1)) * 4,
        np.sqrt(kind[5] / size) * 2,
        np.log1p(distinct) / np.log1p(size) * 6,
    )
    return (n, chars, int(kind[3]), len(lines) - len(set(lines)), repeated, [float(np.rint(x * GRID) / GRID) for x in point])


def with_statistics(text: Column) -> Column:
    @lean
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([statistics(x) for x in batch], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "point"])

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, f"{BASE}, point array<double>")(F.coalesce(text, F.lit("")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def levels(lang: Column, source: Column) -> Column:
    """The keys of a row's groups: all rows, its language, its language and source."""
    l, s = (F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (lang, source))
    return F.array(F.lit("[]"), F.to_json(F.array(l)), F.to_json(F.array(l, s)))


def distance(point: Column, centre: Column, inverse: Column) -> Column:
    d = len(DIMS)
    delta = [point[i] - centre[i] for i in range(d)]
    terms = [inverse[i * d + j] * delta[i] * delta[j] * (1.0 if i == j else 2.0) for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i, len(DIMS))]


def square(row, name: str, total: float) -> np.ndarray:
    """The symmetric matrix of a row's columns <name>i_j, divided by total."""
    out = np.empty((len(DIMS), len(DIMS)))
    for i, j in pairs():
        out[i, j] = out[j, i] = row[f"{name}{i}_{j}"] / total
    return out


def fitted(group: str, start: int, n: int, centre: np.ndarray, cov: np.ndarray) -> tuple:
    cov = cov + np.eye(len(DIMS)) * FLOOR
    return group, start, int(n), float(np.linalg.slogdet(cov)[1]), centre.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist()


FIT = "g string, start int, n long, logdet double, centre array<double>, cov array<double>, inverse array<double>"
FIT_COLUMNS = [x.split()[0] for x in FIT.split(", ")]


def starts(rows: DataFrame) -> DataFrame:
    """Three starts of each group: medians with quartile ranges, medians with the scatter of the
    directions from them, and means with covariances. rows: g, point."""
    d = len(DIMS)
    quarters = [F.percentile(F.col("point")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(d)]
    middle = saved(rows.groupBy("g").agg(*quarters))  # grid values are few, so percentiles are exact and small
    x = [F.col("point")[i] for i in range(d)]
    off = [x[i] - F.col(f"q{i}")[1] for i in range(d)]
    scale = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR**0.5)) for i in range(d)]
    length = sum((F.pow(off[i] / scale[i], 2) for i in range(1, d)), F.pow(off[0] / scale[0], 2))
    whole = lambda c: F.round(c * (1 << 20)).cast("long")  # noqa: E731  (sums of whole numbers don't depend on their order)
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs()]
    sums += [F.sum(whole(off[i] * off[j] / F.greatest(length, F.lit(1e-3)))).alias(f"u{i}_{j}") for i, j in pairs()]
    got = rows.join(small(middle), "g").groupBy("g").agg(F.count("*").alias("n"), *sums).join(middle, "g")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                q = np.array([r[f"q{i}"] for i in range(d)], float)
                spread = ((q[:, 2] - q[:, 0]) / 1.349) ** 2
                mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                signs = square(r, "u", r["n"] * (1 << 20)) * d
                out.append(fitted(r["g"], 0, r["n"], q[:, 1], np.diag(spread)))
                out.append(fitted(r["g"], 1, r["n"], q[:, 1], signs))
                out.append(fitted(r["g"], 2, r["n"], mean, square(r, "p", r["n"]) - np.outer(mean, mean)))
            yield pd.DataFrame(out, columns=FIT_COLUMNS)

    return saved(got.mapInPandas(make, FIT))


def binned(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * BINS_PER_E).cast("int")


def concentrated(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step: estimates from the nearest share of each group, for each start."""
    d = len(DIMS)
    at = binned(distance(F.col("point"), F.col("centre"), F.col("inverse")))
    sums = [F.sum(F.col("point")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("point")[i] * F.col("point")[j]).alias(f"p{i}_{j}") for i, j in pairs()]
    bins = rows.join(small(fits.select("g", "start", "centre", "inverse")), "g").groupBy("g", "start", at.alias("bin")).agg(F.count("*").alias("n"), *sums)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy()
        near = pdf[np.cumsum(n) - n < H * n.sum()].drop(columns=["g", "start", "bin"]).sum()
        mean = np.array([near[f"s{i}"] for i in range(d)]) / near["n"]
        cov = square(near, "p", near["n"]) - np.outer(mean, mean)
        return pd.DataFrame([fitted(pdf["g"].iloc[0], pdf["start"].iloc[0], n.sum(), mean, cov)], columns=FIT_COLUMNS)

    return saved(bins.groupBy("g", "start").applyInPandas(fit, FIT))


def least(fits: DataFrame) -> DataFrame:
    """Of each group, the estimate of the least determinant."""
    rest = [c for c in FIT_COLUMNS if c not in ("g", "logdet", "start")]
    return fits.groupBy("g").agg(F.min(F.struct("logdet", "start", *rest)).alias("f")).select("g", "f.*")


def shrunk(fits: DataFrame, up: DataFrame) -> DataFrame:
    """Estimates drawn towards those of the group above (g, centre, cov), as if it had PRIOR rows here."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(DIMS)
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a, b = r["n"] / (r["n"] + PRIOR), PRIOR / (r["n"] + PRIOR)
                own, above = np.array(r["centre"]), np.array(r["up_centre"])
                cov = a * np.array(r["cov"]) + b * np.array(r["up_cov"]) + a * b * np.outer(own - above, own - above).ravel()
                out.append(fitted(r["g"], 0, r["n"], a * own + b * above, cov.reshape(d, d) - np.eye(d) * FLOOR))
            yield pd.DataFrame(out, columns=FIT_COLUMNS)

    over = small(up.select(F.col("g").alias("up"), F.col("centre").alias("up_centre"), F.col("cov").alias("up_cov")))
    return saved(fits.withColumn("up", above(F.col("g"))).join(over, "up").mapInPandas(draw, FIT))


def above(g: Column) -> Column:
    """The key of the group that holds a group."""
    parts = F.from_json(g, "array<string>")
    return F.when(F.size(parts) == 2, F.to_json(F.array(parts[0]))).otherwise(F.lit("[]"))


def estimates(points: DataFrame) -> DataFrame:
    """(g, centre, inverse, scale) of each language and source. points: keys, point."""
    rows = points.select(F.explode("keys").alias("g"), "point")
    fits = starts(rows)
    for _ in range(FIRST_STEPS):
        fits = concentrated(rows, fits)
    best = saved(least(fits))
    while True:
        new = saved(least(concentrated(rows, best).unionByName(best)))
        gain = new.select("g", F.col("logdet").alias("now")).join(best.select("g", "logdet"), "g").agg(F.max(F.col("logdet") - F.col("now"))).first()[0]
        best = new
        if gain is None or gain <= SETTLED:
            break
    size = F.size(F.from_json("g", "array<string>"))
    in_lang = shrunk(best.filter(size == 1), best.filter(size == 0))
    final = shrunk(best.filter(size == 2), in_lang)
    # the scale that puts a group's median distance where a normal group's would be
    at = binned(distance(F.col("point"), F.col("centre"), F.col("inverse")))
    own = points.withColumn("g", F.col("keys")[2]).join(small(final.select("g", "centre", "inverse")), "g")
    bins = own.groupBy("keys", at.alias("bin")).agg(F.count("*").alias("n")).select(F.explode("keys").alias("g"), "bin", "n").groupBy("g", "bin").agg(F.sum("n").alias("n"))

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].cumsum().to_numpy()
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [int(n[-1])], "m": [float((pdf["bin"].iloc[np.searchsorted(n, n[-1] / 2)] + 1) / BINS_PER_E)]})

    logs = saved(bins.groupBy("g").applyInPandas(middle, "g string, n long, m double"))
    for _ in range(2):  # languages towards all rows, then sources towards languages
        up = small(logs.select(F.col("g").alias("up"), F.col("m").alias("up_m")))
        logs = saved(logs.withColumn("up", above(F.col("g"))).join(up, "up").select("g", "n", F.when(F.col("g") == "[]", F.col("m")).otherwise((F.col("n") * F.col("m") + PRIOR * F.col("up_m")) / (F.col("n") + PRIOR)).alias("m")))
    return saved(final.select("g", "centre", "inverse").join(logs.select("g", F.greatest(F.exp("m") / CHI2_MEDIAN, F.lit(1e-3)).alias("scale")), "g"))


def far(fit: str) -> Column:
    """Squared distance of the row's point, scaled."""
    f = F.col(fit)
    return distance(F.col("point"), f["centre"], f["inverse"]) / f["scale"]


def with_fit(rows: DataFrame, keys: str, points: DataFrame, fit: str) -> DataFrame:
    """rows with the estimates of their language and source as a struct; points: keys, point."""
    (g,) = fresh(rows, "g")
    fits = estimates(points).select(F.col("g").alias(g), F.struct("centre", "inverse", "scale").alias(fit))
    return rows.join(small(fits), F.col(keys)[2] == F.col(g), "left").drop(g)


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the text, with statistics, base_failed, distance and kept; columns of docs with
    these names go."""
    small_batches(docs.sparkSession)
    keys, made_of, fit, inner = fresh(docs, "keys", "s", "fit", "row")
    made = {x.split()[0] for x in BASE.split(", ")} | {"point", "base_failed", "distance", "kept", text.lower()}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.struct(F.lit(0).alias(keys), *rest).alias(inner), levels(F.col(f"`{lang}`"), F.col(f"`{source}`")).alias(keys), with_statistics(F.col(f"`{text}`")).alias(made_of))
    rows = saved(rows.select(inner, keys, f"{made_of}.*").withColumn("base_failed", base_failed()))
    out = with_fit(rows, keys, rows.filter("not base_failed").select(F.col(keys).alias("keys"), "point"), fit).withColumn("distance", far(fit))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT)))
    return out.select(f"{inner}.*", *[c for c in out.columns if c not in (inner, keys, fit, "point")]).drop(keys)


def keep_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns. Statistics are made once: those that pass
    the base rules are held in the shared folder with their points until the estimates are made."""
    small_batches(docs.sparkSession)
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    rows = docs.select(row, levels(F.col(f"`{lang}`"), F.col(f"`{source}`")).alias("keys"), with_statistics(F.col(f"`{text}`")).alias("s")).select("row", "keys", "s.*").filter(~base_failed())
    rows = saved(rows.select("row", "keys", "point"))
    out = with_fit(rows, "keys", saved(rows.select("keys", "point")), "fit")
    return out.filter(far("fit").isNull() | (far("fit") <= CUT)).select([F.col(f"row.`{c}`").alias(c) for c in cols])


def op8_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
