"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows, clashing columns, and on empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, hmm_lm, mixing, near_dup, quality, sharding, toxicity, url_filter, warc

DOC = "doc_id long, text string, lang string, source string, size long, row string"


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(60, 1)
    out = [
        (1, None, "en", "a", 5, "x"), (2, "", "en", "a", None, None), (3, " \t\n ", None, None, 1, "x"), (4, "one two", "fr", "b", 1, "x"), (5, "one  two", "fr", "b", 1, "x"), (6, base, "en", "a", 1, "x"), (7, base, "en", "c", 1, "x"),
        (8, base.replace(base.split()[30], "changed"), "en", "a", 1, "x"), (9, words(3000, 9), "en", "a", 1, "x"), (10, base, "en", "a", 1, "x"), (10, base, "en", "a", 1, "x"), (None, base, "en", None, 1, "x"), (11, "a<|endoftext|>b é ✓ 日本", "de", "é", 1, "x"), (12, base + " tail", "en", "b", 1, "x"),
    ]
    return out + [(100 + k, words(40 + k, k), "en", "abc"[k % 3], 1, "y") for k in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def count(t):
    return len((t or "").encode().split())


def test_mixing_meets_targets(docs, rows, empty):
    slim = docs.select("doc_id", "source", mixing.word_count("text").alias("n"))
    out = mixing.mix_to_targets(slim, F.col("n")).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += count(r[1])
    names = sorted([s for s in size if s is not None]) + [None]
    weight, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
    took = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(took[s] == math.floor(target[s] + 1e-9) for s in names)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_to_targets(slim.repartition(5), F.col("n")).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = {r[1] for r in rows}
    assert all(r["text"] in texts for r in mixed.collect())
    assert mixing.mixed_documents(empty).count() == 0


def brute_components(rows, k):
    sets = []
    for r in rows:
        w = [x.decode() for x in (r[1] or "").encode().lower().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] == rows[j][0] and rows[i][0] is not None
            if rows[i][0] is not None and rows[j][0] is not None and (same_id or (sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both))):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(sets[i]), low.get(find(i), -1) if r[0] is not None else -1) for i, r in enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(docs, rows, empty, k):
    out = near_dup.near_duplicates(docs, k).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in out)
    assert got == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    if k == 5:
        kept = near_dup.keep_one(docs)
        ids = [r["doc_id"] for r in kept.collect()]
        assert kept.columns == docs.columns and ids.count(6) == 1 and 10 not in ids and 7 not in ids
        assert near_dup.near_duplicates(empty, k).count() == 0


def test_crowded_keys_lose_no_link(spark):
    """Two large groups of near copies that are near one another, but not linked."""
    base, r = words(200, 3).split(), random.Random(4)
    rows = []
    for n in range(150):
        w = base[: 100 if n % 2 else 200] + words(0 if n % 2 == 0 else 60, 5).split()
        w[r.randrange(len(w))] = f"edit{n}"
        rows.append((n, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(d, 4).collect())
    assert got == brute_components(rows, 4)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 60
    rows = [(5, "http://a/\r\nx", big, "e"), (3, None, big, "e"), (3, None, big, "e"), (9, "u", None, "e"), (None, "u", big, "e"), (7, "u", "short", "e"), (8, "u", "short", "e"), (11, "u", "z" * 400_000, "e"), (12, "u", words(90_000, 2), "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "warc")
    index = warc.write_archives(pages, folder)
    out = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(index, folder).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = html == big and page != 3
        want.append((page or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert out == sorted(want, key=str)
    for r in index.collect():
        assert warc.read_record(folder, r["bundle"], r["frame"], r["offset"])[0] == r["record_id"]
    assert len({(r["bundle"], r["frame"]) for r in index.collect()}) > 1
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def test_bpe_equals_the_library(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    a = bpe.automaton(bpe.read_spec())
    r = random.Random(1)
    texts = [x[1] or "" for x in rows] + ["".join(r.choice("aeinrst 's\n\t!7é✓ ") for _ in range(60)) for _ in range(300)] + ["a" * 5000, " \n \n", "<|endoftext|>" * 3]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert a.encode(t) == ids
        assert a.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = {(x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.digest_documents(docs).collect()}
    want = set()
    for x in rows:
        ids = lib.encode(x[1] or "", add_special_tokens=False).ids
        want.add((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x[1] or "").encode()).hexdigest()))
    assert got == want
    both = bpe.decode_documents(bpe.encode_documents(docs)).select("text", "decoded").collect()
    assert all((x["text"] or "") == x["decoded"] for x in both)
    assert bpe.digest_documents(empty).count() == 0


def test_pre_split_classes_equal_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    p = ByteLevel(add_prefix_space=False)
    for c in [*range(0x3100), *range(0xA000, 0xD800), *range(0xE000, 0x11000, 3), *range(0x1E000, 0x20000, 7)]:
        s = f"a{chr(c)}1"
        assert bpe.splitter().findall(s) == [s[i:j] for _, (i, j) in p.pre_tokenize_str(s)], hex(c)


def test_url_filter(spark):
    link = lambda *h: "".join(f'<a class=x href="http://{x}/p">t</a>' for x in h)
    rows = [(1, "http://good.ORG/x?a", link("friend.net"), "h"), (2, "https://friend.net/", link("pal.net"), "h"), (3, "http://pal.net", None, "h"), (4, "http://bad.com/de/1", "", "h"), (5, "http://feeds-bad.net/q", link("bad.com"), "h"), (6, None, None, "h"), (7, "no scheme", "", "h"), (8, "http://x.example.org/en/12#f", "", "h"), (9, "http://example.org?q", "", "h"), (9, "http://example.org?q", "", "h"), (10, "http://a.com/fr/", "", "h")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string").drop("host")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(d).collect()}
    assert got[1] == ("good.org", "/x", "org/", "allow") and got[4] == ("bad.com", "/de/1", "com/de/", "block")
    assert got[8] == ("x.example.org", "/en/12", "example.org/en/1", "block") and got[10][2:] == ("com/fr/", "allow")
    assert got[2][2:] == (None, "allow") and got[3][3] == "allow" and got[5] == ("feeds-bad.net", "/q", None, "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[9][1:3] == ("", None)
    assert url_filter.judge_urls(d.limit(0)).count() == 0


def test_mass_of_hosts_without_links_restarts(spark):
    to = "".join(f'<a href="http://{h}.net/">' for h in ["s", *(f"leaf{k}" for k in range(9))])
    rows = [(1, "http://h.com/fr/a", to), (2, "http://h.com/de/a", ""), (3, "http://h.com/x", ""), (4, "http://s.net/", '<a href="http://h.com/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block"}
    links = url_filter.host_links(pages.select(url_filter.host_of(F.col("url")).alias("host"), "html"))
    seeds = spark.createDataFrame([("h.com", "trust", 1), ("h.com", "distrust", 1)], "host string, kind string, weight long")
    mass = {(r["host"], r["kind"]): r["mass"] for r in url_filter.propagate(links, seeds).collect()}
    trust, base = {"h.com": 1.0}, {"h.com": 1.0}
    out = {"h.com": ["s.net", *(f"leaf{k}.net" for k in range(9))], "s.net": ["h.com"]}
    for _ in range(url_filter.ROUNDS):
        lost, new = sum(m for h, m in trust.items() if h not in out), Counter()
        for h, m in trust.items():
            for d in out.get(h, []):
                new[d] += 0.85 * m / len(out[h])
        for h, b in base.items():
            new[h] += b * (0.15 + 0.85 * lost)
        trust = new
    assert all(mass[h, "trust"] == pytest.approx(m * url_filter.UNITS, rel=1e-6) for h, m in trust.items())
    assert sum(m for (_, k), m in mass.items() if k == "trust") == pytest.approx(url_filter.UNITS, rel=1e-6)


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[50:90] = v[10]  # ties
    rows = [(int(k), [float(x) for x in v[k]], "l") for k in range(700)] + [(700, None, "l"), (800, [0.0] * 8, "l"), (900, [1.0] * 7 + [float("nan")], "l"), (1000, [1.0, None] + [0.5] * 6, "l"), (None, [1.0] * 8, "l"), (300, [9.0] * 8, "l"), (1100, [1.0, 2.0], "l")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(d, F.pmod("vec_id", F.lit(100)) == 0, query_block=3, candidate_block=128).collect()}
    good = [(i, np.array(e, np.float64)) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all() and any(e)]
    for q in range(0, 1200, 100):
        own = sorted((e for i, e in good if i == q), key=lambda e: e.tolist())
        near = sorted((math.sqrt(((own[0] - e) ** 2).sum()), i) for i, e in good if i != q and len(e) == len(own[0]))[:10] if own else []
        for k, (score, i) in enumerate(near, 1):
            assert got[q, k][0] == i and got[q, k][1] == pytest.approx(score, rel=1e-12)
        assert (q, len(near) + 1) not in got
    assert ann.nearest(d.limit(0), F.lit(True)).count() == 0


def test_toxicity_learns_and_tolerates_gaps(spark):
    r, out, labels = random.Random(2), [], []
    syll = ["ran", "ter", "ion", "the", "and", "est", "ing", "ou", "al", "it"]
    for k in range(500):
        w = ["".join(r.choice(syll) for _ in range(r.randint(1, 3))) for _ in range(40)]
        bad = k % 3 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["moron", "stupid", "idiot"])
        out.append((k, " ".join(w) + ".", "c"))
        labels.append((k, int(bad)))
    out += [(1000, None, "c"), (1001, "", "c"), (1002, "the st*upid and", "c"), (1003, "the s t u p i d and", "c"), (1004, "ranter " * 20000 + "moron", "c"), (1005, "x" * 5000, "c")]
    labels += [(5000, None), (None, 1), (1, 0)]
    d, lab = spark.createDataFrame(out, "doc_id long, text string, y string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(d, lab, size=150).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k in held) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    assert sum(got[k]["predicted"] == labels[k][1] for k in held) >= 0.95 * len(held)
    assert [got[k]["predicted"] for k in (1000, 1001, 1002, 1003, 1004)] == [0, 0, 1, 1, 1]
    assert toxicity.score_toxicity(d.limit(3), lab.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(d.limit(0), lab).count() == 0


def test_kernel_values_are_whole_and_a_text_scores_as_its_worst_sentence():
    def weights(word):
        c, out = [0, *(ord(x) % (toxicity.LETTERS - 1) + 1 for x in word)], Counter()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + 6)):
                    out[c[i], c[j], c[k]] += 0.5 ** (k - i + 1)
        return out

    def value(a, b):
        a, b = weights(a), weights(b)
        return (sum(a[x] * b[x] for x in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))) ** 4

    marks, words = ["idiot", "moron"], ["idxixot", "ixdxiot", "idiot", "meron", "zzz", "i"]
    k = toxicity.Kernel(marks)
    expected = [[value(w, m) if weights(w) else 0.0 for m in marks] for w in words]
    assert np.allclose(k.compute(words), expected, rtol=1e-4, atol=0) and all(0 < x[0] < 0.03 for x in expected[:2])
    v = np.array([-1.0, -1.0], np.float32)
    texts = ["idiot. moron.", "idiot. zzz.", "", "moron"]
    assert np.allclose(k.worst(texts, v), [(k.sentences(t) @ v).max() for t in texts])
    assert k.worst(texts, v)[0] < -0.9 and k.worst(texts, v)[1] == 0 and k.worst(texts, v)[2] == 0


def test_words_and_segments_equal_the_plain_way():
    r = random.Random(5)
    texts = ["a b c d e rest. s p e l t", "x y z only", "É t é s été 1 2 3 4 5", "ж у к и жуки", "a\x1cb\x85c d\xa0e f", "", None, "A!!! b_c-d\n\n1a 2b"]
    texts += ["".join(r.choice("ab cÉß.!\n_9-\x00\x85ж " if n % 2 else "abC d.?\n7_") for _ in range(60)) for n in range(400)]
    for t in texts:
        plain = toxicity._DROP.sub("", toxicity._BREAK.sub(" \0 ", (t or "").lower()))
        assert toxicity.words_of(t) == toxicity._SPELT.sub(lambda m: "".join(m[0].split()), plain).split()
    rng = np.random.default_rng(1)
    rows = rng.random((2000, 5)).astype(np.float32)
    for longest in (2, 20, 900):
        starts = np.cumsum(np.r_[0, rng.integers(1, longest, 400)])
        starts = starts[starts < len(rows)]
        assert (toxicity.reduced(np.maximum, rows, starts) == np.maximum.reduceat(rows, starts, axis=0)).all()
        assert np.allclose(toxicity.reduced(np.add, rows, starts), np.add.reduceat(rows, starts, axis=0), rtol=1e-5)


def test_words_are_matched_without_a_pattern_pass_unless_spelt(monkeypatch):
    class Counted:
        def __init__(self, real):
            self.real, self.calls = real, 0

        def sub(self, *how):
            self.calls += 1
            return self.real.sub(*how)

    drop, spelt = Counted(toxicity._DROP), Counted(toxicity._SPELT)
    monkeypatch.setattr(toxicity, "_DROP", drop)
    monkeypatch.setattr(toxicity, "_SPELT", spelt)
    assert toxicity.words_of("Plain, and été") == ["plain", "and", "été"] and not drop.calls and not spelt.calls
    assert toxicity.words_of("b a d d") == ["badd"] and spelt.calls == 1


def test_quality_statistics_and_outliers(spark, docs, rows, empty):
    def brute(t):
        w = (t or "").encode().split()
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    for t in [r[1] for r in rows] + ["a b\n a b\na b\n\n", "x y z # | " * 12, words(200, 3, 3), "é ü " * 9]:
        assert quality.statistics(t)[:5] == brute(t)
    good = [(k, " ".join(words(r, k).split()[i] + (". " if i % 9 == 8 else "") for i in range(r)), "en", "a", 1, "x") for k in range(260) for r in [60 + k % 50]]
    odd = [(900 + k, " ".join(f"{x}***" for x in words(80, k).split()), "en", "a", 1, "x") for k in range(6)]
    out = quality.judge_quality(spark.createDataFrame(good + odd, DOC)).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[k] for k in range(260)) and not any(kept[900 + k] for k in range(6))
    q = quality.judge_quality(docs)
    assert q.count() == len(rows) and q.filter("n_words < 20 and kept").count() == 0
    k = quality.keep_quality(docs)
    assert k.columns == docs.columns and k.count() == q.filter("kept").count()
    assert quality.judge_quality(empty).count() == 0


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"key"}
    for s in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard_documents(empty).count() == 0


def test_weighted_tree_moves_rows_only_where_weights_change(spark):
    d = spark.range(20000).withColumnRenamed("id", "doc_id")
    one, two = sharding.topology(16), sharding.topology(16, weights={0: 2.0})
    got = d.select(sharding.shard_of("doc_id", one).alias("a"), sharding.shard_of("doc_id", two).alias("b")).groupBy("a", "b").count().collect()
    n = Counter()
    for r in got:
        n[r["b"]] += r["count"]
        assert r["a"] == r["b"] or r["b"] < 8  # only the region whose weight grew takes rows
    assert n[0] / 20000 == pytest.approx(2 / 17, rel=0.1) and n[15] / 20000 == pytest.approx(1 / 17, rel=0.1)


def test_language_model(spark, docs, rows, empty, tmp_path):
    out = hmm_lm.score_documents(docs, str(tmp_path / "a")).collect()
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for r in rows if not held(r[0]) for x in toks(r[1]))
    total, v = sum(c.values()), len(c)
    want = Counter((r[0], held(r[0]), len(toks(r[1])), sum(c[x] > 0 for x in toks(r[1])), total, round(sum(math.log10((c[x] + 1) / (total + v + 1)) for x in toks(r[1])), 6)) for r in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert hmm_lm.score_documents(empty, str(tmp_path / "b")).count() == 0


def test_a_training_text_longer_than_the_sample_is_learnt(spark, tmp_path):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    d = spark.createDataFrame([(i, "red blue " * 16000)], "doc_id long, text string")
    out = hmm_lm.score_documents(d, str(tmp_path / "long")).first()
    assert out["n_tokens"] == out["train_tokens"] == 32001
    assert out["score"] / out["n_tokens"] > -1  # the untrained model gives each word some 1 in 1500


def test_training_goes_on_until_the_likelihood_settles(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    text = lambda a: " ".join(r.choice(a) for _ in range(r.randint(5, 60)))
    out = [(k, text(["red", "blue", "green"] if k < 300 else ["up", "down", "left", "right"])) for k in range(600)]
    d = spark.createDataFrame(out, "doc_id long, text string").repartition(4)
    hmm_lm.score_documents(d, str(tmp_path / "c"))
    coded, rounds = spark.read.parquet(str(tmp_path / "c" / "coded")), []
    monkeypatch.setattr(hmm_lm, "SAMPLE_ROUNDS", 0)
    model = hmm_lm.fit(coded, rounds)
    gains = np.diff(rounds) / np.abs(rounds[:-1])
    assert len(rounds) > 3 and (gains[:-1] > hmm_lm.SETTLED).all() and gains[-1] <= hmm_lm.SETTLED
    x = [hmm_lm.training_part(*row) for row in coded.select("held", "lengths", "symbols").collect()]
    assert sum(model.forward(s, n).sum() for s, n in x) >= rounds[-1] - hmm_lm.SETTLED * abs(rounds[-1])


def test_forward_recursion_is_exact_and_counts_add_up():
    rng = np.random.default_rng(3)
    m = hmm_lm.Hmm.initial(1)
    lengths = np.array([1, 4, 7])
    s = rng.integers(0, hmm_lm.SYMBOLS, lengths.sum())
    got = m.forward(s, lengths)
    at = 0
    for k, n in enumerate(lengths):
        p = m.start * m.emit[:, s[at]]
        for x in s[at + 1 : at + n]:
            p = (p @ m.move) * m.emit[:, x]
        assert got[k] == pytest.approx(math.log10(p.sum()))
        at += n
    a, b, e = m.expected(s, lengths)
    assert a.sum() == pytest.approx(3) and b.sum() == pytest.approx(lengths.sum() - 3) and e.sum() == pytest.approx(lengths.sum())
    better = hmm_lm.Hmm.from_counts(a, b, e)
    assert better.forward(s, lengths).sum() > got.sum()


def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality") and len(corpus_pipeline.STAGES) == 5
    d = spark.createDataFrame(rows, DOC).drop("size", "row").withColumn("n_chars", F.length("text").cast("long"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, 1, 0), (101, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    assert out and all(r["decoded_sha256"] in texts for r in out)
    ids = {r["doc_id"] for r in out}
    assert not ids & {1, 2, 3, 4, 5, 7, 10}


BIG = 2**53 + 1


def test_ids_beyond_doubles_keep_all_digits(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(BIG, "u", big), (BIG + 2, "u", big), (BIG + 4, "u", "other"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    out = warc.read_archives(warc.write_archives(pages, str(tmp_path / "w")), str(tmp_path / "w")).collect()
    assert {(r["page_id"], r["refers_to"]) for r in out} == {(BIG, None), (BIG + 2, BIG), (BIG + 4, None), (None, None)}
    docs = spark.createDataFrame([(BIG, "a b"), (BIG + 2, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in hmm_lm.score_documents(docs, str(tmp_path / "h")).collect()} == {BIG, BIG + 2, None}
    assert {r["doc_id"] for r in near_dup.near_duplicates(docs).collect()} == {BIG, BIG + 2, None}


def test_archives_are_read_in_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else these few rows make one bundle
    pages = spark.createDataFrame([(k, "u", words(50, k)) for k in range(60)], "page_id long, url string, html string").repartition(6)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    spark.conf.unset(key)
    assert index.select("bundle").distinct().count() > 1
    assert warc.read_archives(index, str(tmp_path / "w")).rdd.getNumPartitions() > 1


def test_large_groups_of_near_copies_lose_no_link(spark):
    """Copies around the threshold of one text: hardly two are equal, and some lie outside."""
    base, r = words(60, 3).split(), random.Random(4)
    rows = []
    for n in range(1100):
        w = list(base)
        for k in r.sample(range(60), 1 if n % 3 else 3):
            w[k] = f"edit{n}-{k}"
        rows.append((n, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(d, 4).collect()}
    want = {i: c for i, _, c in brute_components(rows, 4)}
    assert len(set(want.values())) > 1 and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_outsiders_of_a_group_are_not_compared_by_text_with_all_its_members(spark, monkeypatch):
    base, r = words(300, 3).split(), random.Random(4)
    rows = []
    for n in range(160):
        w = list(base)
        for k in r.sample(range(300), 4 if n % 2 else 16):
            w[k] = f"edit{n}-{k}"
        rows.append((n, " ".join(w)))
    compared = []
    real = near_dup.confirm
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, *how: compared.append(pairs.count()) or real(pairs, *how))
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect())
    want = brute_components(rows, 4)
    assert got == want and sum(i == c for i, _, c in want) > 60
    assert sum(compared) < 2500


def test_fine_sketches_agree_as_sets_do():
    base, other = words(3000, 5).split(), words(3000, 6).split()
    for cut in (150, 300, 600):
        a, b = " ".join(base), " ".join(base[:-cut] + other[:cut])
        x, y = (set(near_dup.shingle_sets([t], 4)[0].tolist()) for t in (a, b))
        n, bits = near_dup.fine_bits([a, "", b], 4)
        same = near_dup.FINE - int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        assert n.tolist() == [len(x), len(y)] and abs(2 * same / near_dup.FINE - 1 - len(x & y) / len(x | y)) < 0.08


def test_one_row_per_group_of_texts_without_ids(spark):
    a, b = words(40, 1), words(40, 2)
    rows = [(None, a), (None, a), (None, b), (5, a + " tail"), (7, b), (7, words(40, 3)), (7, words(40, 3)), (None, ""), (None, ""), (9, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(5, a + " tail"), (7, b), (7, words(40, 3)), (None, ""), (None, ""), (9, None)], key=str)


def test_recursions_take_bounded_memory_and_equal_each_other(monkeypatch):
    import tracemalloc

    rng, m = np.random.default_rng(3), hmm_lm.Hmm.initial(1)
    lengths = np.array([1, 4, 7, 300, 2, 3000] + [40] * 600)
    s = rng.integers(0, hmm_lm.SYMBOLS, lengths.sum()).astype(np.uint16)
    whole = m.expected_and_likelihood(s, lengths)
    monkeypatch.setattr(hmm_lm, "AREA", 1000)
    assert all(np.allclose(a, b) for a, b in zip(whole, m.expected_and_likelihood(s, lengths), strict=True))
    assert m.forward(s, lengths).sum() == pytest.approx(whole[3])
    monkeypatch.undo()
    lengths = np.array([60_000] + [50] * 511)
    s = rng.integers(0, hmm_lm.SYMBOLS, lengths.sum()).astype(np.uint16)
    tracemalloc.start()
    m.expected(s, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all steps of all lanes at once would take 250 MB for the symbols alone


def test_language_model_score_equals_brute_force(spark, tmp_path):
    r = random.Random(7)
    vocab = [f"word{k}{'ab'[k % 2]}{k % 5}" for k in range(1500)]
    rows = [(k, " ".join(vocab[min(int(r.expovariate(1 / 300)), 1499)] for _ in range(r.randint(0, 60))) + (" unseen" if k % 9 == 0 else "")) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in hmm_lm.score_documents(d, str(tmp_path / "m")).collect()}
    model = hmm_lm.fit(spark.read.parquet(str(tmp_path / "m" / "coded")))
    toks = {i: t.encode().split() for i, t in rows}
    c = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    h = {w: int(hmm_lm.pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0]) for t in toks.values() for w in t}
    top = {w: k + 1 for k, w in enumerate(sorted(c, key=lambda w: (-c[w], h[w]))[: hmm_lm.TOP])}
    group = {w: zlib.crc32(w.rstrip(b".,;:!?")[-3:]) % hmm_lm.CLASSES for w in h}
    size, kinds = Counter(), Counter()
    for w, n in c.items():
        if w not in top:
            size[group[w]] += n
            kinds[group[w]] += 1
    assert len(top) == hmm_lm.TOP < len(c)
    for i in list(toks)[::7]:
        symbols = [top.get(w, 1 + hmm_lm.TOP + group[w]) for w in toks[i]] + [0]
        p, log = model.start, 0.0
        for n, x in enumerate(symbols):
            p = (p @ model.move if n else p) * model.emit[:, x]
            log += math.log10(p.sum())
            p = p / p.sum()
        log += sum(math.log10((c[w] + 1) / (size[group[w]] + kinds[group[w]] + 1)) for w in toks[i] if w not in top)
        assert got[i] == pytest.approx(log, rel=1e-9)


def brute_mcd(x: np.ndarray, starts: int = 40) -> float:
    """The least log determinant over random starts of exact concentration steps."""
    rng, h, best = np.random.default_rng(0), int(np.ceil(quality.H * len(x))), np.inf
    for _ in range(starts):
        own = x[rng.choice(len(x), 8, replace=False)]
        for _ in range(30):
            cov = np.cov(own.T, bias=True) + np.eye(x.shape[1]) * quality.FLOOR
            off = x - own.mean(0)
            own = x[np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))[:h]]
        best = min(best, np.linalg.slogdet(np.cov(own.T, bias=True) + np.eye(x.shape[1]) * quality.FLOOR)[1])
    return best


def test_covariance_estimate_is_near_the_least_determinant(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)), rng.normal(8, 0.3, (60, 6))])
    x = np.rint(x * quality.GRID) / quality.GRID
    rows = spark.createDataFrame([("g", p.tolist()) for p in x], "g string, point array<double>")
    fits = quality.starts(rows)
    for _ in range(8):
        fits = quality.concentrated(rows, fits)
    got = quality.least(fits).collect()[0]
    assert got["logdet"] <= brute_mcd(x) + 0.2 and len(fits.collect()) == 3
    assert np.linalg.norm(np.array(got["centre"]) - np.median(x[:300], axis=0)) < 1.5  # the cluster of outliers has no part


def test_small_groups_are_judged_as_their_language(spark):
    text = lambda k: " ".join(words(60 + k % 50, k).split())
    good = [(k, text(k), "en", f"s{k % 90}", 1, "x") for k in range(300)]
    odd = [(900, " ".join(f"{x}***###" for x in words(80, 1).split()), "en", "alone", 1, "x")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(good + odd, DOC)).collect()}
    assert not kept[900] and sum(kept[k] for k in range(300)) >= 297


def test_domain_edges_carry_mass_as_brute_force_says(spark):
    hosts = ["a.x.net", "b.x.net", "deep.b.x.net", "y.net", "." * 200 + "z" * 100]
    links = url_filter.domain_links(spark.createDataFrame([(h,) for h in hosts], "host string"))
    edges = {(r["src"], r["dst"]) for r in links.collect()}
    up = {("a.x.net", "x.net"), ("b.x.net", "x.net"), ("deep.b.x.net", "b.x.net")}
    assert edges == up | {(b, a) for a, b in up}
    seeds = spark.createDataFrame([("a.x.net", "trust", 3), ("y.net", "trust", 1), ("deep.b.x.net", "distrust", 1)], "host string, kind string, weight long")
    got = {(r["host"], r["kind"]): r["mass"] / url_filter.UNITS for r in url_filter.propagate(links, seeds).collect()}
    for kind, base in (("trust", {"a.x.net": 0.75, "y.net": 0.25}), ("distrust", {"deep.b.x.net": 1.0})):
        mass, out = dict(base), {}
        for a, b in edges:
            out.setdefault(a if kind == "trust" else b, []).append(b if kind == "trust" else a)
        for _ in range(url_filter.ROUNDS):
            new, lost = Counter(), sum(m for h, m in mass.items() if h not in out)
            for h, m in mass.items():
                for t in out.get(h, []):
                    new[t] += 0.85 * m / len(out[h])
            for h, b in base.items():
                new[h] += b * (0.15 + 0.85 * lost)
            mass = new
        assert all(got[h, kind] == pytest.approx(m, rel=1e-6, abs=1e-9) for h, m in mass.items())


def test_neighbours_of_any_size_and_in_several_groups(spark):
    rng = np.random.default_rng(1)
    v = [*(rng.normal(size=(40, 4)) * 1e160), *rng.normal(size=(40, 4)), *(rng.normal(size=(40, 4)) * 1e-170)]
    rows = [(k, [float(x) for x in e]) for k, e in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(d, F.pmod("vec_id", F.lit(5)) == 0, k=3, query_block=4, candidate_block=16, group_blocks=2).collect()}
    for q in range(0, 120, 5):
        near = sorted((math.dist(v[q], v[k]), k) for k in range(120) if k != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [k for _, k in near]


def test_sharding_equals_brute_force(docs, rows):
    def shard(i, shards):
        node, tree = "", sharding.children(sharding.topology(shards))
        for _ in range(3):
            draw = lambda p: (int(hashlib.md5(f"{i}|{p}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)
            node = min((-math.log(draw(p)) / w, p) for p, w in tree[node])[1]
        return int(node.split("/")[-1])

    for r in sharding.shard_documents(docs).collect():
        i = "" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (shard(i, 16), shard(i, 17))


CLASHES = ("source_size", "target", "taken", "size", "k", "b", "h", "id", "row", "run", "start", "g", "keys", "point", "centre", "inverse", "scale", "distance", "kept", "n_words", "fit", "s", "n", "bin", "hash", "slot", "shard", "score", "held_out", "host", "path", "rank", "component", "component_id", "u", "sketch", "held", "chunk", "payload", "digest", "url2", "d", "_", "__s", "__row", "__total", "y")


@pytest.mark.parametrize("op", range(1, 11))
def test_extra_columns_may_have_any_names(spark, rows, tmp_path, op):
    base = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    wide = base.select("*", *[F.lit(f"x{n}").alias(c) for n, c in enumerate(CLASHES)])
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.b.com/"), F.coalesce("lang", F.lit(""))).alias("url"), F.col("text").alias("html"), *d.columns[4:])
    vectors = lambda d: d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"), *d.columns[4:])
    labels = spark.createDataFrame([(100, 1), (101, 0), (102, 1), (103, 0)], "doc_id long, toxic int")
    folder = lambda d: str(tmp_path / str(len(d.columns)))
    run = {
        1: lambda d: mixing.mix_to_targets(d, mixing.word_count("text")).select("doc_id", "size", "taken"), 2: lambda d: near_dup.near_duplicates(d), 3: lambda d: warc.read_archives(warc.write_archives(pages(d), folder(d)), folder(d)).drop("record_id", "payload"),
        4: lambda d: bpe.digest_documents(d), 5: lambda d: url_filter.judge_urls(pages(d)), 6: lambda d: ann.nearest(vectors(d), F.lit(True)), 7: lambda d: toxicity.score_toxicity(d, labels), 8: lambda d: quality.judge_quality(d).select("doc_id", "n_words", "kept", "distance"),
        9: lambda d: sharding.shard_documents(d), 10: lambda d: hmm_lm.score_documents(d, folder(d)).drop("score"),
    }[op]
    assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(base).collect()))


def test_pipeline_takes_empty_tables_and_extra_columns(spark, tmp_path):
    import corpus_pipeline

    for name, n in (("none", 0), ("some", 40)):
        docs = spark.createDataFrame([(k, words(60 + k, k), "en", "a", 1, "x", "y") for k in range(40)], "doc_id long, text string, lang string, source string, score int, target string, kept string").limit(n)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").limit(n).write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (out.count() == 0) == (n == 0)
    assert corpus_pipeline.quality(spark, docs, "").columns == docs.columns


def shuffled(spark, run):
    """Rows that the stages of run() write to shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        every = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in (every.apply(i) for i in range(every.size()))}

    before = stages()
    run()
    return sum(v for k, v in stages().items() if k not in before)


def test_mixing_moves_only_the_bins_at_which_budgets_end(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_DIGITS", 1)
    docs = spark.createDataFrame([(k if k % 7 else k // 2, words(1 + k % 5, k), "abc"[k % 3]) for k in range(3000)], "doc_id long, text string, source string").repartition(2).cache()
    assert docs.count() == 3000  # now cached
    slim = docs.select("doc_id", "source", mixing.word_count("text").alias("n"))
    out = []
    # 3 sources of 16 bins, summed by 2 tasks, and the rows of 3 bins; not all rows
    assert shuffled(spark, lambda: out.extend(mixing.mix_to_targets(slim, F.col("n")).collect())) < 1500
    assert len(out) == 3000
    for s in "abc":
        own = [r for r in out if r["source"] == s]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"])
        # by brute force: rows in the order of their keys, the last budget ending inside one
        n, epochs = own[0]["source_size"], math.floor(own[0]["target"]) // own[0]["source_size"]
        left, want = math.floor(own[0]["target"]) - epochs * n, []
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{mixing.SEED}{r['doc_id']}".encode()).hexdigest()[:16], r["doc_id"], r["size"])):
            part = min(max(left, 0), r["size"])
            want.append((r["doc_id"], r["size"], epochs * r["size"] + part))
            left -= r["size"]
        assert sorted(want) == sorted((r["doc_id"], r["size"], r["taken"]) for r in own)
    whole = mixing.mixed_documents(docs).collect()
    monkeypatch.setattr(mixing, "SMALL", 0)  # as with many sources
    assert sorted(map(str, mixing.mix_to_targets(slim, F.col("n")).collect())) == sorted(map(str, out))
    assert sorted(map(str, mixing.mixed_documents(docs).collect())) == sorted(map(str, whole))


def test_quality_makes_statistics_once(docs, rows):
    kept = quality.keep_quality(docs)
    assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString()  # nothing is left to be made
    judged = {str(r["doc_id"]) for r in quality.judge_quality(docs).filter("kept").collect()}
    assert kept.columns == docs.columns and {str(r["doc_id"]) for r in kept.collect()} == judged


def test_bpe_encodes_longest_tokens_first():
    class Counted(dict):
        walks = 0

        def get(self, *a):
            Counted.walks += 1
            return super().get(*a)

    a = bpe.Automaton(bpe.read_spec())
    a.trie = Counted(a.trie)
    word = (" international" * 40).encode()
    ids = a.encode_word(word)
    assert b"".join(a.labels[n] for n in ids) == word
    assert Counted.walks < len(word) // 2  # not from every position


def test_bpe_automaton_is_small():
    import tracemalloc

    spec = bpe.read_spec()
    tracemalloc.start()
    try:
        a = bpe.Automaton(spec)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(a.labels) == 50257 and held < 36 << 20  # each of an executor's workers holds one


def test_pipeline_stages_trim_executors(spark, docs):
    import corpus_pipeline

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for name, stage in corpus_pipeline.STAGES[-2:]:
        before = full()
        stage(spark, docs, "")
        assert full() > before, name
