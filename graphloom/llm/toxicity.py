"""Operator 7: toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Words are compared by the normalised gap-weighted subsequence kernel of order 3: each three
letters that follow one another with gaps count DECAY to the length they span, up to MAX_SPAN, so
insults keep most of their kernel value with letters put in, left out or swapped endings. Marks
and digits inside a word are dropped and words spelt letter by letter are joined first. The
landmarks are the words that tell the classes best apart and the commonest clean words. A
sentence's features are its words' largest kernel values with each landmark, mapped by the inverse
root of the landmarks' kernel matrix; a linear SVM scores sentences, a text scores as its worst
sentence, and a logistic curve turns the margin into a probability.

Training sees labelled texts only: it starts with a text's largest values over all sentences, then
twice labels each toxic text's worst sentence and trains again. It uses the first SAMPLE texts of
each class by hash of the id, a bound that keeps the driver's part constant; document frequencies,
features and margins of the sample are computed on the executors.

Nulls: a null text is empty; an empty text has no words and gets the score of a sentence without
any. Label rows with a null are left out; a text with several labels is toxic if one says so. If
the labels hold only one class, its share is every score. Repeated documents are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, id_crc, id_text, lean, saved, small_batches, table

FOLDS, HELD_OUT = 5, 0
SAMPLE = 3000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 72, 24
DECAY, MAX_SPAN = 0.5, 6
ROUNDS = 2
COST = 100.0
#: Kernel values are raised to this power (one of 2), again a kernel, so that only near matches count.
POWER = 4
#: Letters are counted modulo this; the first code is the word's start.
LETTERS = 64
#: Bytes of kernel values that a worker remembers, and words; both are forgotten when one is full.
REMEMBERED_BYTES, REMEMBERED = 32 << 20, 150_000
#: Longer words are remembered by their hash, so that what is remembered has a bound in bytes.
HELD_LENGTH = 64
#: Letters of words that are compared at once; a word of more letters goes through them in spans.
AREA = 4096
#: Characters after which a group of texts is compared.
GROUP_CHARS = 400_000
#: Words whose values are gathered at once.
STEP = 20_000

_BREAK = re.compile(r"[.!?]+(?=\s|$)|\n+")
_DROP = re.compile(r"[^\w\s\x00]+|[\d_]+")
_SPELT = re.compile(r"(?<!\S)(?:\w\s+){3,}\w(?!\S)")
#: What _DROP drops of the first 256 characters, one byte each.
_LATIN = bytes(c for c in range(256) if _DROP.fullmatch(chr(c)))
GAPS = [(a, b) for b in range(2, MAX_SPAN) for a in range(1, b)]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; "\\0" ends a sentence."""
    t = _BREAK.sub(" \0 ", (text or "").lower())
    try:
        t = t.encode("latin-1").translate(None, _LATIN).decode("latin-1")
    except UnicodeEncodeError:
        t = _DROP.sub("", t)
    words = t.split()
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if b"\1\1\1\1" in single.tobytes():  # else no word is spelt letter by letter
        words = _SPELT.sub(lambda m: "".join(m[0].split()), t).split()
    return words


def ended(words: list[str]) -> list[str]:
    """With a mark after the last sentence."""
    return words if words and words[-1] == "\0" else [*words, "\0"]


def letters(words: list[str], width: int) -> np.ndarray:
    """Codes per word after a start mark; -1 beyond its end."""
    out = np.full((len(words), width + 1), -1, np.int64)
    out[:, 0] = 0
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % (LETTERS - 1) + 1
    r = np.repeat(np.arange(len(words)), n)
    out[r, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1] = flat
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) with one row per word and code."""
    c = letters(words, max(map(len, words)))
    keys = []
    for a, b in GAPS:
        if c.shape[1] <= b:
            continue
        x, y, z = c[:, :-b], c[:, a : a - b], c[:, b:]
        r, k = np.nonzero(z >= 0)
        keys.append((((r * LETTERS + x[r, k]) * LETTERS + y[r, k]) * LETTERS + z[r, k]) * 8 + b)
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    w, key = (DECAY ** np.arange(1, 9))[key & 7], key >> 3
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] // LETTERS**3, key[first] % LETTERS**3, np.add.reduceat(w, first)


def long_subsequences(word: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of one word of any length, summed span by span."""
    c = np.concatenate([np.zeros(1, np.uint8), *(letters([word[i : i + AREA]], len(word[i : i + AREA]))[0, 1:].astype(np.uint8) for i in range(0, len(word), AREA))])
    total = np.zeros(LETTERS**3)
    for at in range(0, len(c), AREA):
        for x, y in GAPS:
            ends = np.arange(max(y, at), min(at + AREA, len(c)))
            code = (c[ends - y].astype(np.int64) * LETTERS + c[ends - y + x]) * LETTERS + c[ends]
            total += np.bincount(code, minlength=LETTERS**3) * DECAY ** (y + 1)
    code = np.flatnonzero(total)
    return code, total[code]


def reduced(op: np.ufunc, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """op.reduceat over rows. The n-th rows of all segments are taken at once, which is faster
    unless one segment is very long."""
    size = np.diff(np.r_[starts, len(rows)])
    if 16 * size.max() > len(rows):
        return op.reduceat(rows, starts, axis=0)
    order = np.argsort(-size, kind="stable")
    first, left = starts[order], np.cumsum(np.bincount(size)[::-1])[::-1]  # left[k]: segments of k rows or more
    some = rows.take(first, axis=0)
    for k in range(1, len(left) - 1):
        n = left[k + 1]
        op(some[:n], rows.take(first[:n] + k, axis=0), out=some[:n])
    out = np.empty_like(some)
    out[order] = some
    return out


class Kernel:
    """Kernel values of words with landmarks, remembered per word."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, m = landmarks, len(landmarks)
        r, code, w = subsequences(landmarks)
        norm = np.sqrt(np.bincount(r, w * w, m))
        used, at = np.unique(code, return_inverse=True)
        self.row = np.zeros(LETTERS**3, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, m), np.float32)
        self.table[at + 1, r] = w / np.maximum(norm, 1e-12)[r]
        self.clear()

    def clear(self) -> None:
        """Row 0 is the end of a sentence, row 1 a word that shares no code with a landmark."""
        self.index: dict[str | bytes, int] = {"\0": 0}
        self.values = np.zeros((REMEMBERED_BYTES // (4 * len(self.landmarks)) + STEP, len(self.landmarks)), np.float32)
        self.used = 2

    def compute(self, words: list[str]) -> np.ndarray:
        """Kernel values of whole words. They are 0 for words that share no code with a landmark,
        whose products are left out."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(words[order[end]]) <= AREA:
                end += 1
            own = order[at:end]
            if len(words[own[-1]]) > AREA:
                code, w = long_subsequences(words[own[0]])
                r = np.zeros(len(code), np.int64)
            else:
                r, code, w = subsequences([words[k] for k in own])
            square = np.bincount(r, w * w, len(own))
            row = self.row[code]
            hit = row > 0
            if hit.any():
                r, row, w = r[hit], row[hit], (w[hit] / np.sqrt(square[r[hit]])).astype(np.float32)
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                terms = self.table.take(row, axis=0)
                terms *= w[:, None]
                out[np.array(own)[r[first]]] = reduced(np.add, terms, first)
            at = end
        for _ in range(POWER.bit_length() - 1):
            np.square(out, out=out)
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """Row numbers in self.values, by word; at most STEP words."""
        if len(self.index) > REMEMBERED or self.used + len(words) > len(self.values):
            self.clear()
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        lacks = np.flatnonzero(rows < 0)
        if not len(lacks):
            return rows
        words = [words[k] for k in lacks.tolist()]
        keys = [w if len(w) <= HELD_LENGTH else blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words]
        new = {k: w for k, w in zip(keys, words, strict=True) if k not in self.index}
        if new:
            k = self.compute(list(new.values()))
            like = k.max(axis=1) > 0
            n = int(like.sum())
            self.values[self.used : self.used + n] = k[like]
            at = np.ones(len(new), np.int64)
            at[like] = np.arange(self.used, self.used + n)
            self.index.update(zip(new, at.tolist(), strict=True))
            self.used += n
        rows[lacks] = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        return rows

    def spans(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of sentences' end marks, features of the sentences). The last word is a mark."""
        begun = np.zeros(len(self.landmarks), np.float32)
        for at in range(0, len(words), STEP):  # bounds the memory of one long text
            rows = self.of(words[at : at + STEP])
            values, ends = self.values.take(rows, axis=0), np.flatnonzero(rows == 0)
            if not len(ends):
                begun = np.maximum(begun, values.max(axis=0))
                continue
            out = reduced(np.maximum, values[: ends[-1] + 1], np.r_[0, ends[:-1] + 1])
            out[0] = np.maximum(out[0], begun)
            begun = values[ends[-1] :].max(axis=0)
            yield at + ends, out

    def sentences(self, text: str | None) -> np.ndarray:
        """Features of each sentence, one row of zeros if the text has no words."""
        return np.concatenate([x for _, x in self.spans(ended(words_of(text)))])

    def worst(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """The largest product of a sentence's features with the weights, by text."""
        split = [ended(words_of(t)) for t in texts]
        out = np.full(len(texts), -np.inf)
        ends = np.cumsum([len(own) for own in split])
        for at, x in self.spans([w for own in split for w in own]):
            np.maximum.at(out, np.searchsorted(ends, at, side="right"), x @ weights)
        return out


def root(k: np.ndarray) -> np.ndarray:
    """Inverse square root of a kernel matrix."""
    val, vec = np.linalg.eigh(k)
    return (vec / np.sqrt(np.maximum(val, 1e-3))) @ vec.T


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = COST) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; classes weigh the same. The last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    s = np.where(y > 0, 1.0, -1.0)
    c = cost * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * 100
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = s * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ s[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def train_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), ridged so that separable classes stay finite."""
    x, p = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (weight * (q - y)) + 1e-3 * len(y) * (p - [3.0, 0.0]) * [1, 0.01]
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-5]) * len(y)
        step = np.linalg.solve(hess, grad)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


class Model:
    """landmarks and weights on their kernel values; or a constant."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, a: float, b: float):
        self.landmarks, self.weights, self.bias, self.a, self.b = landmarks, weights, bias, a, b

    def scores(self, kernel: Kernel | None, texts) -> np.ndarray:
        texts = list(texts)
        margin = np.zeros(len(texts))
        if self.landmarks:
            at, size = 0, 0
            for k, t in enumerate(texts):  # texts of some length are compared at once
                size += len(t)
                if size > GROUP_CHARS or k + 1 == len(texts):
                    margin[at : k + 1] = kernel.worst(texts[at : k + 1], self.weights) + self.bias
                    at, size = k + 1, 0
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -500, 500)))


def sample_of(docs: DataFrame, labels: DataFrame, size: int, id_col: str) -> tuple[list, int, int]:
    """[(id, label)] of the first `size` training rows of each class by hash; and all counts."""
    train = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (id_crc(id_col) % FOLDS != HELD_OUT)).groupBy(id_col).agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.encode(id_text(id_col), "UTF-8"))
    ids = [(r[id_col], r["y"]) for y in (0, 1) if counts.get(y) for r in train.filter(F.col("y") == y).orderBy(order, id_col).limit(size).collect()]
    return ids, counts.get(0, 0), counts.get(1, 0)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> Model:
    spark = docs.sparkSession
    ids, clean, toxic = sample_of(docs, labels, size, id_col)
    if not clean or not toxic:
        share = toxic / (clean + toxic) if clean + toxic else 0.0
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    chosen = spark.createDataFrame(ids, f"`{id_col}` {dict(docs.dtypes)[id_col]}, y int")
    sample = saved(docs.select(id_col, text).join(F.broadcast(chosen), id_col).select(F.col(text).alias("text"), "y").repartition(spark.sparkContext.defaultParallelism))

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(w, y) for t, y in zip(pdf["text"], pdf["y"], strict=True) for w in set(words_of(t)) if w != "\0" and len(w) > 1]
            yield pd.DataFrame(pairs, columns=["w", "y"])

    df = sample.mapInPandas(count, "w string, y int").groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n0 or not n1:
        return Model([], np.zeros(0), 0.0, 0.0, 30.0 if n1 else -30.0)
    apart = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt((F.col("t") + F.col("c") + 2) / (n0 + n1))
    marks = [r["w"] for r in df.filter(apart > 0).orderBy(apart.desc(), "w").limit(TOXIC_LANDMARKS).collect()]
    marks += [r["w"] for r in df.filter(apart <= 0).orderBy(F.col("c").desc(), "w").limit(CLEAN_LANDMARKS).collect()]
    marks = list(dict.fromkeys(marks))
    if not marks:
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(toxic / clean)))
    kernel = Kernel(marks)
    to = root(kernel.compute(marks).astype(np.float64))

    def features(weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        @lean
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k = Kernel(marks)
            for pdf in batches:
                rows = []
                for t in pdf["text"]:
                    s = k.sentences(t)
                    rows.append((s.max(axis=0) if weights is None else s[np.argmax(s @ weights)]).tolist())
                yield pd.DataFrame({"x": rows, "y": pdf["y"]})

        got = sample.mapInPandas(each, "x array<float>, y int").toPandas()
        return np.array(got["x"].tolist(), float), got["y"].to_numpy()

    x, y = features(None)
    w = train_svm(x @ to, y)
    for _ in range(ROUNDS):
        x, y = features((to @ w[:-1]).astype(np.float32))
        w = train_svm(x @ to, y)
    v = to @ w[:-1]
    x, y = features(v.astype(np.float32))
    weight = np.where(y > 0, toxic / n1, clean / n0)
    a, b = train_curve(x @ v + w[-1], y, weight / weight.mean())
    return Model(marks, v.astype(np.float32), float(w[-1]), a, b)


def score_column(model: Model, text):
    @lean
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        k = Kernel(model.landmarks) if model.landmarks else None
        for batch in texts:
            yield pd.Series(model.scores(k, batch), dtype=float)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "double")(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SAMPLE) -> DataFrame:
    small_batches(docs.sparkSession)
    model = train(docs, labels, size, id_col, text)
    held = (F.coalesce(id_crc(id_col), F.lit(0)) % FOLDS == HELD_OUT).alias("held_out")
    out = docs.select(id_col, held, score_column(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, by a model trained on labelled documents."""
    small_batches(docs.sparkSession)
    model = train(labelled, labels, SAMPLE, id_col, text)
    (s,) = fresh(docs, "score")
    return docs.withColumn(s, score_column(model, F.col(f"`{text}`"))).filter(F.col(s) < 0.5).drop(s)


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
