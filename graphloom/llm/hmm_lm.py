"""Operator 10: hidden Markov language model.

Tokens are lower-cased words and one end per text. A token has a symbol: the end, each of the
TOP commonest training words, and for other words one of CLASSES classes by their last letters.
The model is p(text) = p(symbols) * product of p(word | its class), where p(symbols) is a hidden
Markov model over STATES latent states, and a class's words are smoothed counts,
(c + 1) / (class tokens + class words + 1), the last 1 being the words never seen. Baum-Welch
starts from a fit on texts chosen by hash over the whole table (SAMPLE_TOKENS; on the driver) and then
takes steps over all training texts until the likelihood settles (SETTLED). Their expected counts are
summed partition by partition, in sums of fixed size. Scoring runs the scaled forward recursion over the whole text, which is exact.

Word counts cover all training texts and never leave the executors. Texts come in chunks; a chunk
stores its distinct words once, as sorted 64-bit hashes, and each token as a position among them.
The chunks' counts meet by hash range: a chunk sends each range one packed slice and gets the
totals back in the same order, so common words cost no more than others, and ranges are as many
as their entries need (RANGE_ENTRIES each). Two words with the same 64-bit hash count as one.

Nulls: a null text is empty and is just the end; a null id is the empty text for the split. Equal
rows are scored alike and count each. Without training texts all counts are 0, base_score is
log10(1/1) per token, and symbols are equally likely. Only the id and the text are read, so other
columns may have any names. A text of any length takes AREA symbols of memory at a time beside its own
tokens. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, id_crc, lean, shared_dir, small_batches, table

FOLDS, HELD_OUT = 7, 2
STATES, TOP, CLASSES = 8, 1000, 512
SYMBOLS = 1 + TOP + CLASSES
SAMPLE_ROUNDS = 25
#: Baum-Welch over all training texts ends when a round gains less than this share of the log-likelihood.
SETTLED = 1e-4
#: The start takes whole texts by hash over the whole table, some SAMPLE_TOKENS tokens in all.
SAMPLE_TOKENS = 120_000
#: Texts of a chunk, and bytes after which a chunk ends.
CHUNK_TEXTS, CHUNK_BYTES = 4096, 12 << 20
RANGE_ENTRIES = 500_000
#: Chunks that a worker holds at once.
CHUNKS_AT_ONCE = 2
#: Sequences that step together, and symbols of them that are held at once.
LANES, AREA = 512, 1 << 17
END = np.uint64(0x9D5C0F1A3B7E2468)
_Z = zstandard.ZstdCompressor(level=1)
_U = zstandard.ZstdDecompressor()
CHUNK = "chunk long, ids binary, held binary, lengths binary, tokens binary, words binary, counts binary, classes binary, n long, n_train long"


@contextmanager
def few_rows(spark: SparkSession, rows: int = CHUNKS_AT_ONCE):
    """Arrow batches of a few rows, as a row here is a whole chunk."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def packed(x: np.ndarray) -> bytes:
    return _Z.compress(np.ascontiguousarray(x).tobytes())


def unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_U.decompress(x), kind)


def class_of(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % CLASSES


def chunk_of(texts: list[str], train: np.ndarray) -> dict:
    """Tokens as positions among the chunk's sorted distinct words, with training counts."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    flat = [w for own in words for w in own]
    codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, np.int64), np.empty(0, object))
    h = pd.util.hash_array(unique, categorize=False) if len(unique) else np.empty(0, np.uint64)
    classes = np.fromiter(map(class_of, unique), np.int64, len(unique))
    all_h = np.r_[h, END].astype(np.uint64)
    sorted_h, at, inverse = np.unique(all_h, return_index=True, return_inverse=True)
    tokens = np.full(int(lengths.sum()), inverse[-1], np.int64)
    ends = np.cumsum(lengths) - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = inverse[codes]
    seen = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(sorted_h))
    return {"lengths": lengths, "tokens": tokens.astype(np.uint32), "words": sorted_h, "counts": seen.astype(np.uint32), "classes": np.r_[classes, 0][at].astype(np.uint16), "n": int(lengths.sum()), "n_train": int(lengths[train].sum())}


def write_chunks(docs: DataFrame, folder: str) -> None:
    """docs: id, text, held (boolean)."""

    @lean
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for pdf in batches:
            sizes = pdf["text"].str.len().to_numpy()
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES, prepend=0))
            edges = sorted({0, len(pdf), *cut.tolist(), *range(0, len(pdf), CHUNK_TEXTS)})
            for a, b in zip(edges, edges[1:], strict=False):
                own = pdf.iloc[a:b]
                held = own["held"].to_numpy(bool)
                c = chunk_of(own["text"].tolist(), ~held)
                row = {"chunk": part << 32 | seq, "ids": packed(np.stack([own["id"].to_numpy(np.int64), own["no_id"].to_numpy(np.int64)])), "held": packed(held), "lengths": packed(c["lengths"])}
                row |= {k: packed(c[k]) for k in ("tokens", "words", "counts", "classes")} | {k: c[k] for k in ("n", "n_train")}
                seq += 1
                yield pd.DataFrame([row])

    whole = docs.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "text", "held")  # ids without nulls keep all digits
    whole.mapInPandas(each, CHUNK).write.parquet(f"{folder}/chunks")


def range_totals(chunks: DataFrame, ranges: int, folder: str) -> None:
    """Sum the chunks' counts by hash range. Writes rows of two kinds: the totals of a chunk's
    slice, in its order; and per range the number of words, the commonest and the class sums."""

    @lean
    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, words, counts, classes in zip(pdf["chunk"], pdf["words"], pdf["counts"], pdf["classes"], strict=True):
                w, c, k = unpacked(words, np.uint64), unpacked(counts, np.uint32), unpacked(classes, np.uint16)
                of = ((w >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
                yield pd.DataFrame([(chunk, int(of[a]), w[a:b].tobytes(), c[a:b].tobytes(), k[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)], columns=["chunk", "range", "w", "c", "k"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["w"]])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["c"]])
        k = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["k"]])
        unique, first, at = np.unique(w, return_index=True, return_inverse=True)
        sums = np.zeros(len(unique), np.int64)
        np.add.at(sums, at, c)
        edges = np.r_[0, np.cumsum([len(x) // 8 for x in pdf["w"]])]
        own = sums[at]
        rows = [(int(chunk), int(pdf["range"].iloc[0]), packed(own[a:b]), None, None) for chunk, a, b in zip(pdf["chunk"], edges, edges[1:], strict=False)]
        best = np.lexsort((unique, -sums))[: TOP + 1]
        best = best[sums[best] > 0]
        known = sums > 0
        kind = k[first][known]
        by_class = np.stack([np.bincount(kind, sums[known], CLASSES), np.bincount(kind, minlength=CLASSES)]).astype(np.int64)
        rows.append((-1, int(pdf["range"].iloc[0]), None, np.stack([unique[best].view(np.int64), sums[best], k[first][best]]).tobytes(), by_class.tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "range", "totals", "best", "by_class"])

    parts = chunks.select("chunk", "words", "counts", "classes").mapInPandas(slices, "chunk long, range int, w binary, c binary, k binary")
    parts.groupBy("range").applyInPandas(total, "chunk long, range int, totals binary, best binary, by_class binary").write.parquet(f"{folder}/totals")


def corpus_facts(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words (hash, count, class) and the tokens and words of each class. Ranges
    are folded in groups first, so the driver gets a fixed number of rows."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        best = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in pdf["best"]], axis=1)
        best = best[:, np.lexsort((best[0].view(np.uint64), -best[1]))[: TOP + 1]]
        return pd.DataFrame({"best": [best.tobytes()], "by_class": [sum(np.frombuffer(x, np.int64) for x in pdf["by_class"]).tobytes()]})

    rows = totals.filter("chunk = -1").groupBy(F.expr("range % 16")).applyInPandas(fold, "best binary, by_class binary").toPandas()
    if not len(rows):
        return np.zeros((3, 0), np.int64), np.zeros((2, CLASSES), np.int64)
    rows = fold(rows)
    return np.frombuffer(rows["best"][0], np.int64).reshape(3, -1), np.frombuffer(rows["by_class"][0], np.int64).reshape(2, CLASSES)


class Coder:
    """Symbols of words: 0 the end, then the commonest words, then the classes."""

    def __init__(self, best: np.ndarray, by_class: np.ndarray):
        top = best[:, best[0].view(np.uint64) != END][:, :TOP]
        order = np.argsort(top[0].view(np.uint64))
        self.hashes, self.symbol = top[0].view(np.uint64)[order], (np.arange(top.shape[1]) + 1)[order]
        tokens, words = by_class.copy()
        np.subtract.at(tokens, top[2], top[1])
        np.subtract.at(words, top[2], 1)
        end = best[:, best[0].view(np.uint64) == END]
        if end.shape[1]:
            tokens[end[2, 0]] -= end[1, 0]
            words[end[2, 0]] -= 1
        self.norm = np.zeros(SYMBOLS)
        self.norm[1 + TOP :] = np.log10(np.maximum(tokens + words + 1, 1))

    def symbols(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = 1 + TOP + classes.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            hit = self.hashes[at] == words
            out[hit] = self.symbol[at[hit]]
        out[words == END] = 0
        return out


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(seed: int = 10) -> Hmm:
        rng = np.random.default_rng(seed)
        move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        emit = rng.gamma(1.0, 1.0, (STATES, SYMBOLS)) + 0.1
        return Hmm(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def lanes(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, their starts, lengths) of texts that step together, longest first."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            yield own, starts[own], lengths[own]

    @staticmethod
    def block(symbols: np.ndarray, starts: np.ndarray, n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, live texts by step) of the steps from t on, at most AREA symbols or one step."""
        m = int((n > t).sum())
        steps = np.arange(t, min(n[0], t + max(1, AREA // m)))
        at = np.minimum(starts[None, :m] + steps[:, None], len(symbols) - 1)
        return symbols[at], np.searchsorted(-n, -steps, side="left")

    def forward(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence."""
        out = np.zeros(len(lengths))
        by_symbol = np.ascontiguousarray(self.emit.T)
        for own, starts, n in self.lanes(lengths):
            p, total, t = None, np.zeros(len(own)), 0
            while t < n[0]:
                x, live = self.block(symbols, starts, n, t)
                for row, m in zip(x, live, strict=True):
                    p = (self.start if p is None else p[:m] @ self.move) * by_symbol[row[:m]]
                    scale = p.sum(1)
                    p = p / scale[:, None]
                    total[:m] += np.log10(scale)
                t += len(x)
            out[own] = total
        return out

    def alphas(self, p: np.ndarray | None, x: np.ndarray, live: np.ndarray, by_symbol: np.ndarray) -> tuple[list, list]:
        """Scaled forward rows of a block's steps and their scales; p is the row before the block."""
        rows, scales = [], []
        for row, m in zip(x, live, strict=True):
            p = (self.start if p is None else p[:m] @ self.move) * by_symbol[row[:m]]
            scales.append(p.sum(1))
            p = p / scales[-1][:, None]
            rows.append(p)
        return rows, scales

    def expected(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions."""
        return self.expected_and_likelihood(symbols, lengths)[:3]

    def expected_and_likelihood(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """And the log10 likelihood of all sequences. Only the row before each block of steps is
        held; a block's rows are made again on the way back."""
        likelihood = 0.0
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES))
        by_symbol = np.ascontiguousarray(self.emit.T)
        for _, starts, n in self.lanes(lengths):
            before, p, t, rows = [], None, 0, None
            while t < n[0]:
                x, live = self.block(symbols, starts, n, t)
                before.append((t, p))
                rows, scales = self.alphas(p, x, live, by_symbol)
                p = rows[-1]
                likelihood += float(np.log10(np.concatenate(scales)).sum())
                t += len(x)
            ahead = None
            for k, (t, p) in enumerate(reversed(before)):
                if k:  # the last block is still at hand
                    x, live = self.block(symbols, starts, n, t)
                    rows, scales = self.alphas(p, x, live, by_symbol)
                gammas: list = [None] * len(x)
                for i in range(len(x) - 1, -1, -1):
                    beta = np.ones((live[i], STATES))
                    if ahead is not None:
                        move += rows[i][: len(ahead)].T @ ahead
                        beta[: len(ahead)] = ahead @ self.move.T
                    gammas[i] = rows[i] * beta
                    ahead = by_symbol[x[i, : live[i]]] * beta / scales[i][:, None]
                if t == 0:
                    start += gammas[0].sum(0)
                seen, g = np.concatenate([x[i, : live[i]] for i in range(len(x))]), np.concatenate(gammas)
                for s in range(STATES):
                    emit[:, s] += np.bincount(seen, g[:, s], SYMBOLS)
        return start, move * self.move, emit.T, likelihood

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        norm = lambda x: x / x.sum(-1, keepdims=True)
        return Hmm(norm(start + 0.1), norm(move + 0.1), norm(emit + 1e-2))

    def pack(self) -> bytes:
        return np.concatenate([self.start, self.move.ravel(), self.emit.ravel()]).tobytes()

    @staticmethod
    def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.frombuffer(x)
        return v[:STATES], v[STATES : STATES + STATES**2].reshape(STATES, STATES), v[STATES + STATES**2 :].reshape(STATES, SYMBOLS)


def encode_chunks(chunks: DataFrame, totals: DataFrame, coder: Coder, folder: str) -> None:
    """Per chunk: ids, split, lengths, symbols; and per text the sum of log10(c + 1) over all
    tokens and over tokens of classes, the latter less the classes' norms, and known tokens."""
    back = totals.filter("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("range", "totals"))).alias("t")).select("chunk", F.col("t.totals").alias("t"))
    joined = chunks.select("chunk", "ids", "held", "lengths", "tokens", "words", "classes").join(back, "chunk")

    @lean
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                counts = np.concatenate([unpacked(x, np.int64) for x in r["t"]])
                symbol = coder.symbols(unpacked(r["words"], np.uint64), unpacked(r["classes"], np.uint16))
                logs = np.log10(counts + 1.0)
                inner = np.where(symbol > TOP, logs - coder.norm[symbol], 0.0)
                tokens, lengths = unpacked(r["tokens"], np.uint32), unpacked(r["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                sums = np.stack([np.add.reduceat(x[tokens].astype(float), starts) for x in (logs, inner, counts > 0)])
                yield pd.DataFrame([(r["chunk"], r["ids"], r["held"], r["lengths"], packed(symbol[tokens].astype(np.uint16)), packed(sums))], columns=["chunk", "ids", "held", "lengths", "symbols", "sums"])

    joined.mapInPandas(each, "chunk long, ids binary, held binary, lengths binary, symbols binary, sums binary").write.parquet(f"{folder}/coded")


def training_part(held: bytes, lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    keep, n, s = ~unpacked(held, bool), unpacked(lengths, np.int64), unpacked(symbols, np.uint16)
    return s[np.repeat(keep, n)], n[keep]


def fit(coded: DataFrame, rounds: list[float] | None = None) -> Hmm:
    """The log10 likelihood of all training texts before each whole round is added to rounds."""
    rounds = [] if rounds is None else rounds
    rows = coded.select("held", "lengths", "symbols")
    model = Hmm.initial()
    sample_s, sample_n = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(int(training_part(*own)[1].sum()) for own in zip(pdf["held"], pdf["lengths"], pdf["symbols"], strict=True))]})

    tokens = rows.mapInPandas(sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = min(1.0, SAMPLE_TOKENS / max(tokens, 1))

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, held, lengths, symbols in zip(pdf["ids"], pdf["held"], pdf["lengths"], pdf["symbols"], strict=True):
                s, n = training_part(held, lengths, symbols)
                starts = np.cumsum(n) - n
                own_ids = unpacked(ids, np.int64).reshape(2, -1)[0][~unpacked(held, bool)]
                own_text = np.add.reduceat(pd.util.hash_array(s.astype(np.uint64) << np.uint64(32) | np.arange(len(s), dtype=np.uint64) - np.repeat(starts, n).astype(np.uint64)), starts) if len(n) else np.empty(0, np.uint64)
                at = pd.util.hash_array(pd.util.hash_array(own_ids.view(np.uint64)) ^ own_text) / 2.0**64
                pick = np.flatnonzero((at < share) & (n <= SAMPLE_TOKENS))  # longer ones wait for the whole rounds
                if len(pick):
                    own = np.concatenate([s[a : a + b] for a, b in zip(starts[pick], n[pick], strict=True)])
                    yield pd.DataFrame([(own.tobytes(), n[pick].tobytes())], columns=["s", "n"])

    for r in coded.select("ids", "held", "lengths", "symbols").mapInPandas(few, "s binary, n binary").collect():
        sample_s.append(np.frombuffer(r["s"], np.uint16))
        sample_n.append(np.frombuffer(r["n"], np.int64))
    s, n = np.concatenate(sample_s), np.concatenate(sample_n)
    for _ in range(SAMPLE_ROUNDS if len(n) else 0):  # no text may fit the sample
        model = Hmm.from_counts(*model.expected(s, n))

    def sums(model: Hmm):
        @lean
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, seen = None, 0
            for pdf in batches:
                for own in zip(pdf["held"], pdf["lengths"], pdf["symbols"], strict=True):
                    s, n = training_part(*own)
                    if len(n):
                        *c, likelihood = model.expected_and_likelihood(s, n)
                        v = np.r_[np.frombuffer(Hmm(*c).pack()), likelihood]
                        total, seen = (v if total is None else total + v), seen + len(n)
            if seen:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 16], "v": [total.tobytes()]})

        return each

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [sum(np.frombuffer(x) for x in pdf["v"]).tobytes()]})

    while True:
        parts = rows.mapInPandas(sums(model), "part int, v binary").groupBy("part").applyInPandas(fold, "v binary").collect()
        if not parts:  # no training texts
            return model
        v = sum(np.frombuffer(r["v"]) for r in parts)
        rounds.append(float(v[-1]))
        model = Hmm.from_counts(*Hmm.unpack(v[:-1].tobytes()))
        if len(rounds) > 1 and rounds[-1] - rounds[-2] <= SETTLED * abs(rounds[-2]):
            return model


def score_documents(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents under the model learnt from the training fold."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(id_crc(id_col), F.lit(0)) % FOLDS == HELD_OUT
    write_chunks(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), held.alias("held")), folder)
    chunks = spark.read.schema(CHUNK).parquet(f"{folder}/chunks")
    facts = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.sum(F.octet_length("words")).alias("b")).first()
    total, ranges = facts["n"], max(8, -(-(facts["b"] or 0) // (8 * RANGE_ENTRIES)))
    with few_rows(spark):
        range_totals(chunks, ranges, folder)
    totals = spark.read.schema("chunk long, range int, totals binary, best binary, by_class binary").parquet(f"{folder}/totals")
    best, by_class = corpus_facts(totals)
    vocabulary = int(by_class[1].sum())
    with few_rows(spark):
        encode_chunks(chunks, totals, Coder(best, by_class), folder)
    dropped(spark, f"{folder}/chunks")
    dropped(spark, f"{folder}/totals")
    coded = spark.read.schema("chunk long, ids binary, held binary, lengths binary, symbols binary, sums binary").parquet(f"{folder}/coded")
    model = fit(coded)
    norm = float(np.log10(total + vocabulary + 1))

    @lean
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                n, sums = unpacked(r["lengths"], np.int64), unpacked(r["sums"], float).reshape(3, -1)
                ids = unpacked(r["ids"], np.int64).reshape(2, -1)
                chain = model.forward(unpacked(r["symbols"], np.uint16), n)
                yield pd.DataFrame({"id": pd.array(ids[0], dtype="Int64").copy() if not ids[1].any() else pd.arrays.IntegerArray(ids[0].copy(), ids[1].astype(bool)), "held_out": unpacked(r["held"], bool), "n_tokens": n, "n_known": np.rint(sums[2]).astype(np.int64), "train_tokens": total, "base_score": sums[0] - n * norm, "score": chain + sums[1]})

    out = coded.mapInPandas(each, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/hmm-{uuid.uuid4().hex}")
