"""Operator 2: MinHash near-duplicates with tensored banding.

A text's set is its distinct word shingles, as 64-bit hashes. COLLECTIONS small groups of ROWS
minhashes each are computed, and a table's key is a pair of collections, so COLLECTIONS hash groups
serve COLLECTIONS * (COLLECTIONS - 1) / 2 tables: a pair of texts meets in a table if it agrees in
two collections. At similarity 0.8 a pair is missed once in about 5000, at 0.85 once in 100,000.

1. Texts with equal sets are one class; everything below is about classes.
2. A collection value that only one class has can't meet anything and goes before pairing.
3. The classes of a table key are compared with its least class, the hub. Candidates must be near
   enough in size and in a sketch of 4-bit minhashes (which a linked pair fails less than once in
   100,000), and are confirmed on their full sets, remade from the texts. Each class is first compared
   with the hub that it meets most often; links give components, and only pairs that still lie in
   different components go on to the other hubs.
4. A key whose classes still lie in different components has a main one, the largest there. The
   others' classes (the outsiders) are compared with a few classes of the main component, drawn by
   hash, which joins nearly all that belong to it.
5. What is left over is compared in full: each key's remaining outsiders with all its classes of other
   components. The join itself compares sizes and fine sketches of FINE 1-bit minhashes (which a
   linked pair fails less than once in 100,000), so that it puts out only pairs close to the
   threshold, and only these are confirmed on their texts. So classes of one component are never
   paired with one another, every pair that meets in a table is either joined or compared, and no
   size changes that.

Counts and least ids per key are aggregated before they are joined back, so a key with a third of
all rows is split by adaptive joins; no group is gathered in one task. The last step looks at outsiders
times classes of a key, which is the least that can show that an outsider is linked with none of them;
it does so on 256 bytes a class inside the join, where no such pair is written or moved.

Nulls: a null or empty text, or one without words, has an empty set and is linked with nothing.
Repeated rows of one id are one text if their texts are equal; if they differ, the id stands for
the class of each, and its component is the least of them. A null id can't be named and stays a
component of its own (component_id null, kept true). Only the id and the text are read, so other
columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, released, saved, small, small_batches, table

OP_SHINGLE = 4
SHINGLE, SIMILARITY = 5, 80
COLLECTIONS, ROWS = 16, 3
HASHES = COLLECTIONS * ROWS
#: Of the HASHES 4-bit minhashes this many must agree; a pair at 0.8 has 39 +- 2.7.
SKETCH_AGREE = 26
#: 1-bit minhashes of the fine sketch, and how many standard deviations below a linked pair's mean pass.
FINE, FINE_SIGMAS = 2048, 4.5
#: Ids that are broadcast (a few MB), so that only the texts they name are shuffled.
FEW_IDS = 1 << 18
FINE_COLUMNS = [f"w{i}" for i in range(FINE // 64)]
#: Classes of a key's main component that its outsiders are compared with, and how often.
DRAWS, DRAW_ROUNDS = 3, 2
_rng = np.random.default_rng(2)
_ODD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_MIX = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_ODD = _rng.integers(0, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_XOR = _rng.integers(0, 2**64, FINE, dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts, one after the other, and each set's size."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    if not flat:
        return np.empty(0, np.uint64), np.zeros(len(words), np.int64)
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(unique, categorize=False)[codes]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    x = np.zeros(len(h), np.uint64)
    for j in range(k):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - j] = h[j:] if j else h
        x = _stir(x + part * _MIX[j % 8] + np.uint64(j))
    doc = np.repeat(np.arange(len(words)), counts)
    at = np.arange(len(h)) - starts[doc]
    whole = at <= counts[doc] - k
    sets_doc, sets_x = doc[whole], x[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = []
        for d in short:
            y = np.uint64([counts[d]])
            for v in h[starts[d] : starts[d] + counts[d]]:
                y = _stir(y * _MIX[7] + v)
            own.append(y[0])
        sets_doc, sets_x = np.concatenate([sets_doc, short]), np.concatenate([sets_x, np.array(own, np.uint64)])
    order = np.lexsort((sets_x, sets_doc))
    d, x = sets_doc[order], sets_x[order]
    first = np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])]
    return x[first], np.bincount(d[first], minlength=len(words))


def signatures(texts, k: int) -> pd.DataFrame:
    """n, two set hashes, collection values and sketch of each text."""
    with np.errstate(over="ignore"):
        x, n = shingle_sets(texts, k)
        has = np.flatnonzero(n > 0)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])[has].astype(np.int64)
        out = pd.DataFrame({"n": n, "set_a": np.int64(0), "set_b": np.int64(0)})
        lists: list = [None] * len(n)
        sketches: list = [None] * len(n)
        if len(has):
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            a[has] = np.add.reduceat(_stir(x), starts)
            b[has] = np.add.reduceat(_stir(x ^ _MIX[6]), starts)
            out["set_a"], out["set_b"] = a.view(np.int64), b.view(np.int64)
            mins = np.stack([np.minimum.reduceat((x ^ _XOR[j]) * _ODD[j], starts) for j in range(HASHES)])
            values = np.zeros((COLLECTIONS, len(has)), np.uint64)
            for r in range(ROWS):
                values = _stir(values + mins[r::ROWS])
            low = _stir(mins) & np.uint64(15)
            longs = [np.zeros(len(has), np.uint64) for _ in range(HASHES // 16)]
            for j in range(HASHES):
                longs[j // 16] |= low[j] << np.uint64(4 * (j % 16))
            values, longs = values.T.view(np.int64), np.stack(longs, axis=1).view(np.int64)
            for row, d in enumerate(has):
                lists[d], sketches[d] = values[row].tolist(), longs[row].tolist()
        out["u"], out["sketch"] = lists, sketches
        return out


def with_signatures(text: Column, k: int) -> Column:
    @lean
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.concat([signatures(batch.iloc[at : at + 512], k) for at in range(0, max(len(batch), 1), 512)], ignore_index=True)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, "n long, set_a long, set_b long, u array<long>, sketch array<long>")(F.coalesce(text, F.lit("")))


def alike(a: Column, b: Column) -> Column:
    """How many 4-bit minhashes of two sketches agree."""
    odd = F.lit(0)
    for i in range(HASHES // 16):
        odd = odd + F.bit_count(_nibbles(a[i].bitwiseXOR(b[i])))
    return F.lit(HASHES) - odd


def _nibbles(x: Column) -> Column:
    """One bit for each half byte that isn't 0."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))


def fine_bits(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and FINE bits as longs, of the texts that have words."""
    with np.errstate(over="ignore"):
        x, n = shingle_sets(texts, k)
        n = n[n > 0]
        if not len(n):
            return n, np.zeros((0, FINE // 64), np.int64)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        mins = np.stack([np.minimum.reduceat((x ^ _FINE_XOR[j]) * _FINE_ODD[j], starts) for j in range(FINE)])
        return n, np.ascontiguousarray(np.packbits((_stir(mins) & np.uint64(1)).astype(np.uint8).T, axis=1)).view(np.int64)


def fine_sketches(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, w0, w1, ...) of texts (id, text) that have words. An id with several texts has several rows."""

    @lean
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                own = pdf.iloc[at : at + 64]
                own = own[[bool((t or "").encode("utf-8", "surrogatepass").split()) for t in own["text"]]]
                n, bits = fine_bits(own["text"], k)
                yield pd.DataFrame({"id": own["id"].to_numpy(), "n": n} | {w: bits[:, i] for i, w in enumerate(FINE_COLUMNS)})

    return texts.select("id", "text").mapInPandas(each, "id long, n long, " + ", ".join(f"{w} long" for w in FINE_COLUMNS))


def close_pairs(rows: DataFrame, fine: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (a, b) of one key and two components, one of them not the key's main one, that are
    near enough in size and fine sketch. rows: key, id, component, main. All is judged inside the
    join, so pairs that aren't near are never put out."""
    full = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  never null, which keeps the join's code short
    known = rows.join(small(fine), "id").select("key", "component", "main", *[full(c) for c in ("id", "n", *FINE_COLUMNS)])
    x, y = known.filter("component <> main").alias("x"), known.alias("y")
    apart = F.lit(0)
    for w in FINE_COLUMNS:
        apart = apart + F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}")))
    p = (1 + similarity / 100) / 2
    most = math.ceil(FINE * (1 - p) + FINE_SIGMAS * math.sqrt(FINE * p * (1 - p)))
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    size = 100 * F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & size & (apart <= most))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over links (a, b); only ids that have links.
    Alternates large-star and small-star steps until nothing changes; every step aggregates by
    node before it is joined."""
    edges = saved(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    while True:
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").filter("hi <> lo").distinct()
        new = saved(small)
        tell = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if tell(new) == tell(edges):
            break
        edges = new
    return edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component"))


def relinked(mark: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) after more links between ids; only these are gone through."""
    known = labelled(links, mark)
    more = components(known.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = more.select(F.col("id").alias("component"), F.col("component").alias("new"))
    old = mark.join(joined, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(mark.select("id"), "id", "left_anti")
    fresh_ids = ids.join(more, "id")
    return saved(old.unionByName(fresh_ids.select("id", "component")))


def labelled(pairs: DataFrame, mark: DataFrame) -> DataFrame:
    """pairs (a, b) with their components ca, cb; an id without links is its own."""
    m = lambda x: mark.select(F.col("id").alias(x), F.col("component").alias("c" + x))
    both = pairs.join(m("a"), "a", "left").join(m("b"), "b", "left")
    return both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def near_pairs(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b, ...) near enough in size and sketch."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    ok = (100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")) & (alike(F.col("sa"), F.col("sb")) >= SKETCH_AGREE)
    return both.filter(ok).select(*pairs.columns)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, in percent. texts: id, text. The text
    of b is moved once per pair, that of a, which many pairs may share, once."""
    right = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    full = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    @lean
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    own = pdf.iloc[at : at + 256]
                    used = own.drop_duplicates(["a", "ta"])
                    sets = []
                    for c in (used["ta"], own["tb"]):
                        x, n = shingle_sets(c, k)
                        sets.append(np.split(x, np.cumsum(n)[:-1]))
                    of = dict(zip(zip(used["a"], used["ta"], strict=True), sets[0], strict=True))
                    keep = []
                    for a, ta, y in zip(own["a"], own["ta"], sets[1], strict=True):
                        x = of[a, ta]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(100 * both >= similarity * (len(x) + len(y) - both))
                    yield own.loc[keep, ["a", "b"]]

    return full.select("a", "ta", "b", "tb").mapInPandas(check, "a long, b long")


def linked_classes(classes: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """(id, component) of the classes that are linked. classes: id, n, u, sketch."""
    # collection values that two classes share
    values = classes.select("id", F.posexplode("u").alias("c", "v"))
    shared = values.groupBy("c", "v").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    live = saved(values.join(shared, ["c", "v"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("l")).filter(F.size("l") > 1))
    pair = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.xxhash64(x["c"], x["v"], y["c"], y["v"]))))
    keys = live.select("id", F.explode(pair).alias("key"))
    hubs = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).filter("m > 1").drop("m")
    rows = saved(keys.join(hubs, "key"))
    met = rows.filter("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("keys"))
    tried = saved(near_pairs(met, classes, similarity))
    best = tried.groupBy("b").agg(F.max(F.struct("keys", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = saved(confirm(saved(best), texts, k, similarity))
    released(classes.sparkSession)
    mark = saved(components(links))
    other = saved(labelled(tried.join(best, ["a", "b"], "left_anti"), mark).filter("ca <> cb").select("a", "b"))
    mark = joined_by(other, mark, texts, k, similarity)
    tried = tried.select("a", "b")
    rows = rows.select("id", "key")
    for turn in range(DRAW_ROUNDS + 1):
        own = rows.join(mark, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        parts = own.groupBy("key", "component").agg(F.count("*").alias("m"), *[F.min(F.struct(F.xxhash64("id", F.lit(f"{turn}/{d}")).alias("h"), F.col("id").alias("id"))).alias(f"d{d}") for d in range(DRAWS)])
        draws = F.array(*[F.col(f"d{d}.id") for d in range(DRAWS)]).alias("draws")
        main = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", F.col("component").alias("main"), draws)).alias("x")).filter("parts > 1").select("key", "x.main", "x.draws")
        rows = saved(own.join(main, "key"))  # keys of one component are done with
        if rows.isEmpty():
            break
        out = rows.filter("component <> main")
        if turn < DRAW_ROUNDS:
            pairs = out.select("id", F.explode(F.array_distinct("draws")).alias("other"))
            pairs = near_pairs(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), classes, similarity)
        else:
            fine = saved(fine_sketches(class_texts(texts, rows.select("id")), k))
            pairs = close_pairs(rows.drop("draws"), fine, similarity)
        new = saved(pairs.join(tried, ["a", "b"], "left_anti"))
        mark = joined_by(new, mark, texts, k, similarity)
        tried = saved(tried.unionByName(new)) if turn < DRAW_ROUNDS else tried
        rows = rows.select("id", "key")
    return mark


def confirm(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    return confirmed(pairs, class_texts(texts, pairs.select(F.explode(F.array("a", "b")).alias("id"))), k, similarity)


def joined_by(pairs: DataFrame, mark: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """mark after the links among the pairs."""
    if pairs.isEmpty():
        return mark
    links = saved(confirm(pairs, texts, k, similarity))
    released(pairs.sparkSession)
    return mark if links.isEmpty() else relinked(mark, links)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = saved(source.select("id", with_signatures(F.col("text"), k).alias("s")).select("id", "s.*"))
    named = signed.filter("id is not null and n > 0")
    classes = saved(named.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("id", "u", "sketch")).alias("r")).select("set_a", "set_b", "n", "r.*"))
    texts = source.filter("id is not null").withColumn("h", F.xxhash64("text"))
    mark = linked_classes(classes, texts, k, similarity)
    # ids whose rows have different texts tie classes together
    tie = named.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1")
    by_class = classes.select("set_a", "set_b", F.col("id").alias("class")).join(mark.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")).drop("class")
    out = signed.select("id", "n", "set_a", "set_b").join(by_class, ["set_a", "set_b"], "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    if not tie.isEmpty():
        out = tied(out, tie)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id")).withColumn("kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))


def tied(out: DataFrame, tie: DataFrame) -> DataFrame:
    """Components joined where one id has rows in several of them."""
    both = out.filter("n > 0").join(tie.select("id"), "id").groupBy("id").agg(F.min("component").alias("a"), F.collect_set("component").alias("all"))
    links = saved(both.select("a", F.explode("all").alias("b")).filter("a <> b").distinct())
    if links.isEmpty():
        return out
    more = components(links).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    return out.join(more, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")


def class_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the classes with these ids. A class's text is one of its id's texts; an id with
    several texts gives all of them."""
    ids = saved(ids.distinct())
    return texts.join(small(ids, FEW_IDS), "id").dropDuplicates(["id", "h"]).drop("h")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of near-duplicate texts: the one of the least id, null last. Grouping
    depends on texts only: rows that share an id, or have none, are told apart by their texts, and
    of rows with equal id and text one stays. Rows without words all stay."""
    key, h, own, low = fresh(docs, "id", "hash", "own", "low")
    keyed = docs.select(F.col(f"`{id_col}`").alias(key))
    odd = keyed.groupBy(key).agg(F.count("*").alias(own)).filter(F.col(key).isNull() | (F.col(own) > 1))
    if odd.isEmpty():
        gone = near_duplicates(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), id_col=id_col, text=text, **how).filter("not kept").select(F.col(f"`{id_col}`").alias(key))
        return docs.join(gone, F.col(f"`{id_col}`") == F.col(key), "left_anti")
    hashed = F.sha2(F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8"), 256)
    named = saved(docs.select(F.col(f"`{id_col}`").alias(key), hashed.alias(h), F.col(f"`{text}`").alias("text")).dropDuplicates([key, h]).withColumn("doc_id", F.monotonically_increasing_id()))
    groups = near_duplicates(named.select("doc_id", "text"), **how).join(named.select("doc_id", key, h), "doc_id")
    first = groups.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col(key).isNull().alias("none"), key, h)).alias(low)).select(F.col(low)[key].alias(key), F.col(low)[h].alias(h))
    words = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.col(own) == F.col(h))
    left = docs.filter(words).withColumn(own, hashed).join(first, same, "left_semi").dropDuplicates([id_col, own]).drop(own)
    return left.unionByName(docs.filter(~words))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), OP_SHINGLE)


OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {OP_SHINGLE} THEN [hash(w)]
    ELSE list_distinct(list_transform(range(1, len(w) - {OP_SHINGLE} + 2), lambda i: hash(w[i : i + {OP_SHINGLE} - 1]))) END AS s FROM w),
c AS MATERIALIZED (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY 1, 2),
x AS MATERIALIZED (SELECT id, n, unnest(s) AS h FROM c),
l AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= {SIMILARITY} * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {SIMILARITY} * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON r.id = e.a),
m AS (SELECT id, min(low) AS component FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component, c.id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, c.id, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.id = c.id
"""
