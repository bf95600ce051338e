"""Operator 4: BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state that loops on every single byte; each
merge (u, v) -> uv, in order, puts in a gadget: arcs labelled u now lead to a copy of their
target without the arc v, and wherever u could be read, uv can be read too, to where v led
(or, for u = v, to the old target of u). What it accepts then are exactly the sequences that
BPE produces, and a byte string has exactly one of them.

All arcs of one label share a target, so a state is the number of the merge that made it, from 1,
or ROOT, and its arcs follow from two small tables: which v were removed from the copies for u and when.
Tables by token, state and node are arrays and the trie is one table of arcs, because every worker, idle
ones too, holds an automaton. A pre-split
word is encoded by walking the trie of token bytes and stepping the automaton, longest tokens first:
a position has one state at most, so one from which the end can't be reached is left for good and
the walk is linear in the word. Decoding emits the arcs' byte labels.

Nulls: a null text is the empty text, which has no tokens. Strings of special tokens in a text
become these tokens, as the tokenizers library does. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, table

TOKENIZER = "byte_bpe_50k.json"
#: Words that a worker remembers, and their bytes each; others are encoded again.
REMEMBERED, HELD_LENGTH = 300_000, 64
ROOT = 0
#: Letters and numbers that Unicode has gained since the version that the tokenizers library follows (16).
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return out | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(3)
def splitter(top: int = sys.maxunicode) -> re.Pattern:
    """Byte-level BPE's pre-split pattern for texts of characters up to top, with the classes
    spelt out; small classes are matched much faster."""
    newer = {c for x in NEWER.split() for c in range(int(x.split("-")[0], 16), int(x.split("-")[-1], 16) + 1)}
    every = "".join(chr(c) if c not in newer else "\0" for c in [*range(0xD800), *range(0xE000, sys.maxunicode + 1)] if c <= top)

    def ranges(kind: str) -> str:
        runs = (m[0] for m in regex.finditer(rf"\p{{{kind}}}+", every))
        return "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x in runs)

    letter, number = ranges("L"), ranges("N")
    space = "\\t-\\r " + "\\x85\\xa0" * (top > 0x7F) + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000" * (top > 0xFF)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?(?:[{letter}]+|[{number}]+|[^{space}{letter}{number}]+)|[{space}]+(?![^{space}])|[{space}]+")


def pre_split(text: str) -> list[str]:
    if text.isascii():
        return splitter(0x7F).findall(text)
    return splitter(0xFF if max(text) <= "\xff" else sys.maxunicode).findall(text)


class Words(dict):
    """word -> its ids as decimal text; encodes what it lacks."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> str:
        out = ",".join(map(str, self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))))
        if len(word) <= HELD_LENGTH:
            self[word] = out
        return out


class Automaton:
    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.labels: dict[int, bytes] = {n: to_bytes(s) for s, n in vocab.items() if all(c in alphabet for c in s)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.labels |= {n: s.encode() for s, n in self.special.items()}
        self.decimal = {str(n): b for n, b in self.labels.items()}
        size = max(self.labels, default=-1) + 1
        self.born = array("i", [-1]) * size  # token -> its merge; bytes have none
        self.left = array("i", [-1]) * size
        self.made: dict[int, array] = {}  # label u -> merges that copied its target
        self.lost: dict[int, int] = {}  # label u << 20 | v -> merge that took the arc v away
        self.base: dict[int, int] = {}  # label u -> target before the first copy
        self.goes = array("i", [ROOT]) * size  # label -> target
        self.copied = array("i", [-1]) * (len(spec["model"]["merges"]) + 1)  # state -> label whose target it copies
        self.known: dict[int, bool] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            old = self.goes[u]
            if not self.steps(old, v):
                continue
            self.born[uv], self.left[uv] = r, u
            self.goes[uv] = self.goes[v] if u != v else old
            self.base.setdefault(u, old)
            self.made.setdefault(u, array("i")).append(r)
            self.lost[u << 20 | v] = r
            self.goes[u], self.copied[r + 1] = r + 1, u
        self.whole = {label: n for n, label in self.labels.items() if len(label) == 1 or self.born[n] >= 0}
        self.trie: dict[int, int] = {}  # first byte -> node
        self.arcs: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends = array("i")  # node -> token that ends there
        for label, n in self.whole.items():
            node = -1
            for x in label:
                arcs, key = (self.trie, x) if node < 0 else (self.arcs, node << 8 | x)
                node = arcs.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = n
        self.words = Words(self)
        special = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.split = pre_split

    def steps(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label."""
        while state != ROOT:
            u, now = self.copied[state], state - 1
            r = self.born[token]
            gone = self.lost.get(u << 20 | token)
            if gone is not None and gone <= now and gone > r:
                return False
            made = self.made[u]
            if r < made[0]:
                state = self.base[u]
            else:
                state, token = made[bisect_right(made, min(r, now)) - 1] + 1, self.left[token]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        if (whole := self.whole.get(word)) is not None:  # a token's bytes encode to it
            return [whole]
        n = len(word)
        known, target, trie, arcs, ends = self.known, self.goes, self.trie, self.arcs, self.ends
        if len(known) > 500_000:
            known.clear()
        out: list[int] = []
        left: list = []  # of each position before: it, its state's base and the tokens not tried there
        dead: set[int] = set()  # positions from which the end can't be reached
        at, base = 0, ROOT << 20
        while at < n:
            node, i, options = trie.get(word[at]), at, []
            while node is not None:
                i += 1
                token = ends[node]
                if token >= 0:
                    options.append((i, token))
                node = arcs.get(node << 8 | word[i]) if i < n else None
            while True:
                if not options:
                    dead.add(at)
                    out.pop()
                    at, base, options = left.pop()
                    continue
                i, token = options.pop()
                if i in dead:
                    continue
                ok = known.get(base + token)
                if ok is None:
                    ok = known[base + token] = self.steps(base >> 20, token)
                if ok:
                    break
            left.append((at, base, options))
            out.append(token)
            at, base = i, target[token] << 20
        return out

    def encode_text(self, text: str | None) -> str:
        """Ids as decimal text joined by commas."""
        if not text:
            return ""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        ids = self.words.__getitem__
        if self.cut is None or not self.cut.search(text):
            return ",".join(map(ids, self.split(text)))
        parts = []
        for n, part in enumerate(self.cut.split(text)):
            if n % 2:
                parts.append(str(self.special[part]))
            elif part:
                parts.extend(map(ids, self.split(part)))
        return ",".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_text(text).split(",") if x]

    def decode_text(self, ids: str) -> str:
        return b"".join(map(self.decimal.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids) -> str:
        return b"".join([self.labels[int(n)] for n in ids]).decode("utf-8", "replace")


@lru_cache(1)
def automaton(spec: bytes) -> Automaton:
    return Automaton(spec)


def with_automaton(spec, convert) -> Callable[[Iterator], Iterator]:
    """A worker's function that converts each batch by the automaton. At its end the words that were
    remembered go, and the automaton stays for the worker's next task."""

    @lean
    def each(batches: Iterator[pd.Series]) -> Iterator:
        a = automaton(spec.value)
        try:
            for batch in batches:
                yield convert(a, batch)
        finally:
            a.words.clear()
            a.known.clear()

    return each


def typed(f, out: str, made) -> Callable[[Column], Column]:
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[made]}
    return F.pandas_udf(f, out)


def read_spec(path: str | None = None) -> bytes:
    """The tokenizer's file, read once on the driver (its size is the vocabulary's)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    encode = typed(with_automaton(spec, lambda a, batch: batch.map(a.encode)), "array<int>", pd.Series)
    return docs.withColumn(out, encode(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def decode_documents(docs: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text of each list of ids; a null list is empty."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    decode = typed(with_automaton(spec, lambda a, batch: batch.map(lambda x: "" if x is None else a.decode(x))), "string", pd.Series)
    return docs.withColumn(out, decode(F.col(f"`{ids}`")))


def digests(a: Automaton, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for x in texts:
        ids = a.encode_text(x)
        rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(a.decode_text(ids).encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and the digests of ids and decoded text, made in one pass without moving the
    ids out of the worker."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    digest = typed(with_automaton(spec, digests), "n_tokens long, ids_sha256 string, decoded_sha256 string", pd.DataFrame)
    return docs.select(F.col(f"`{id_col}`"), digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("d")).select(f"`{id_col}`", "d.*")


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
