"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relweave.llm import bpe, bpe_codec, html_extract, jaccard_join, knn, langid, lm_score, packing, secrets, spotsigs, suffix_dedup
from relweave.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
VOCAB = bpe_codec.vocabulary()
RANKS = bpe_codec.vocabulary("byte_bpe_50k.tiktoken")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def clashing(df):
    """df with columns named like those the operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("k", "t", "row", "b", "n", "key", "spans", "ids", "rep", "next", "h", "g", "sigs", "part")})


def base_text():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()


ODD = [None, "", " ", "...", "a", "The cat", "The cat", "long " * 20_000, None]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


# --- language ID


def test_langid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9 and all(0 <= r["score"] <= 1 for r in got)


def test_langid_ties(spark):
    """With weights that say nothing all languages are equal, and the first in alphabetical order is taken; repeats are sampled alike."""
    model = langid.Model(["aa", "bb"], np.ones(langid.DIM), np.zeros((langid.DIM, 2)), 1.0)
    assert langid.predict(frame(spark, ["x y"]), model).first()["lang_pred"] == "aa"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = langid.train(docs, 60), langid.train(docs.orderBy("n_chars"), 60)
    assert (a.weights == b.weights).all() and a.weights.any()


def test_langid_edges(spark):
    docs = clashing(frame(spark, ODD, [None, *range(1, len(ODD))]))
    model = langid.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in langid.predict(docs, model).collect()}
    assert len(got) == len(ODD) and got[None] == ("und", False) and got[3][0] == "und" and got[7][0] == "en"
    assert {r["doc_id"] for r in langid.accepted(docs, model).collect()} == {4, 5, 6, 7}
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"} and langid.predict(docs.limit(0), nothing).count() == 0


# --- SpotSigs


def test_spotsigs(spark):
    texts = [t for t in base_text()[:60]] + [None, "", "...", "x"]
    ids = random.Random(1).sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(clashing(frame(spark, texts, ids))).collect()}
    order, by = sorted(ids, reverse=True), dict(zip(ids, (t or "" for t in texts), strict=True))
    prints = lambda s: set(s.split(",")) - {""}
    for i, k in enumerate(order):
        text, after, r = by[k], by[order[(i + 1) % len(order)]], got[k]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, near in ((r["fingerprint"], r["edited_fingerprint"], r["near_edited"]), (r["fingerprint"], got[order[(i + 1) % len(order)]]["fingerprint"], r["near_next"])):
            a, b = prints(a), prints(b)
            assert math.isclose(near, len(a & b) / len(a | b) if a | b else 1.0)


def test_spotsigs_edges(spark):
    docs = frame(spark, ["The cat sat on the mat", "The cat sat on the mat", "a b", "z"], [1, 1, None, 9])
    got = spotsigs.fingerprints(docs).collect()
    same = [r["fingerprint"] for r in got if r["doc_id"] == 1]
    assert len(got) == 4 and len(same) == 2 and same[0] == same[1]
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0
    one = spotsigs.fingerprints(frame(spark, ["the cat sat down"])).first()
    assert one["near_next"] == 1.0


def spots_brute(text):
    """Signatures of a text, by one walk over its words."""
    import regex

    words, common = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()), set(spotsigs.ANCHORS.split())
    found = set()
    for i, w in enumerate(words):
        follows = [x for x in words[i + 1 :] if x not in common][: spotsigs.CHAIN] if w in common else []
        if len(follows) == spotsigs.CHAIN:
            found.add(" ".join([w, *follows]))
    return found or set(words)


def spotted(n=160, seed=3):
    """Texts with near copies on both sides of the threshold, exact ones, long runs of common words, and odd ones."""
    rng = random.Random(seed)
    common, words = spotsigs.ANCHORS.split(), [f"w{i}" for i in range(60)]
    texts = [None, "", "the", "the of and", "the " * 40 + "cat sat", "cat sat", "x", "...", "the cat the", "The Cat, sat down"]
    for _ in range(n):
        if len(texts) > 15 and rng.random() < 0.7:
            copy = (rng.choice(texts[10:])).split()
            for _ in range(rng.choice([0, 1, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rng.choice(common if rng.random() < 0.5 else words) for _ in range(rng.choice([3, 40, 90, 160]))))
    return texts


def test_spots(spark):
    from pyspark.sql import functions as F

    texts = [t or "" for t in [*spotted(), *base_text()[:100]]]
    rows = frame(spark, texts).select("doc_id", spotsigs.spots(spotsigs.normal(F.col("text"))).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        brute = spots_brute(texts[r["doc_id"]])
        assert {x.replace(spotsigs.MARK, " ") for x in r["s"]} == (brute if any(" " in x for x in brute) else set())


@pytest.mark.parametrize("block", [256, 3])
def test_spotsigs_join(spark, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    texts = spotted()
    ids = random.Random(2).sample(range(1000), len(texts))
    ids[20], ids[21] = None, ids[22]
    got = spotsigs.near_duplicates(clashing(frame(spark, texts, ids))).collect()
    sets = [spots_brute(t) for t in texts]
    low, copies = {}, collections.Counter()
    for i, s in zip(ids, sets, strict=True):
        if i is not None:
            k = frozenset(s)
            low[k], copies[k] = min(i, low.get(k, i)), copies[k] + 1
    keys = list(low)
    linked = {k: [x for x in keys if x != k and k and x and len(k & x) >= spotsigs.TAU * len(k | x)] for k in keys}
    joined = {k: set(linked[k]) for k in keys}
    for i in set(ids) - {None}:
        of = [frozenset(s) for j, s in zip(ids, sets, strict=True) if j == i]
        for k in of:
            joined[k] |= set(of)

    def least(k):
        seen, todo = {k}, [k]
        while todo:
            for x in joined[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return min(low[x] for x in seen)

    want = [(None, None, None, 1, 0) if i is None else (i, least(k), low[k], copies[k], len(linked[k])) for i, k in zip(ids, map(frozenset, sets), strict=True)]
    order = lambda rows: sorted(rows, key=str)
    assert sum(len(x) for x in linked.values()) > 50 and any(copies[k] > 1 for k in keys)
    assert order(tuple(r) for r in got) == order(want)


def test_spotsigs_join_edges(spark):
    docs = frame(spark, ["the cat sat", None, "", "the cat sat"], [4, 7, 2, None])
    assert sorted(map(tuple, spotsigs.near_duplicates(docs).collect()), key=str) == [(2, 2, 2, 2, 0), (4, 4, 4, 1, 0), (7, 2, 2, 2, 0), (None, None, None, 1, 0)]
    assert spotsigs.near_duplicates(docs.limit(0)).count() == 0
    assert spotsigs.near_duplicates(docs.where("doc_id is null")).count() == 1


def test_length_partition(spark):
    from pyspark.sql import functions as F

    ns = spark.range(1, 3000).select("id", spotsigs.length_partition(F.col("id")).alias("p")).collect()
    part = {r["id"]: r["p"] for r in ns}
    assert all(0 <= part[math.floor(n / spotsigs.TAU)] - part[n] <= 1 for n in range(1, 2300))


def test_spotsigs_long(spark):
    """A very long text of common words only, and one of many signatures."""
    texts = ["the " * 300_000, "the of " * 150_000 + "cat sat", " ".join(f"the w{i} of v{i}" for i in range(40_000))]
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(frame(spark, texts)).collect()}
    assert got[0]["n_signatures"] == 1 and got[1]["n_signatures"] == 2 and 79_990 <= got[2]["n_signatures"] <= 80_000


def test_spotsigs_is_native(spark):
    docs = frame(spark, ["a b"])
    for df in (spotsigs.fingerprints(docs), spotsigs.near_duplicates(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


# --- BPE


def test_bpe_matches(spark, tokenizer):
    texts = [*base_text()[:40], *ODD, "ΑΣ ΣΑΣ", "it's 'sam I'LL", "<|startoftext|> Hi<|endoftext|>!", "a" * 9000, "x\x1cy z　w", "日本語 한국어🙂", "".join(random.Random(2).choice("etaoin") for _ in range(12_000))]
    got = {r["doc_id"]: r for r in bpe_codec.digests(clashing(frame(spark, texts)), VOCAB).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.digests(frame(spark, [None], [None]), VOCAB).first()["n_tokens"] == 0
    assert bpe_codec.digests(frame(spark, []), VOCAB).count() == 0


def test_bpe_unicode(tokenizer):
    """Every character between letters, alone and before a digit: characters of newer Unicode editions too."""
    own = bpe.Bpe.load(VOCAB)
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or 0x1C880 <= c < 0x20000 or 0x10000 <= c < 0x11000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids, text.encode("unicode-escape")


def test_bpe_round_trip(spark):
    docs = frame(spark, ["plain words, and é ü!", None, "🙂 ok"])
    got = bpe_codec.decode(bpe_codec.encode(docs, VOCAB), VOCAB, "plain").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["plain words , and é ü ! ", "", "🙂 ok "]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=400), st.integers(0, 1000))
def test_stream_equals_merge(word, seed):
    """A toy merge list, with a buffer that is much shorter than the word."""
    r = random.Random(seed)
    names, rules = ["a", "b", "c"], []
    for _ in range(6):
        x, y = r.choice(names), r.choice(names)
        if x + y not in names and len(x + y) <= 6:
            names.append(x + y)
            rules.append((x, y))
    b = bpe.Bpe.__new__(bpe.Bpe)
    number = {n: i for i, n in enumerate(names)}
    b.rank = {number[x] << 20 | number[y]: i for i, (x, y) in enumerate(rules)}
    b.made, b.name = [number[x + y] for x, y in rules], dict(enumerate(names))
    b.lookahead = bpe.lookahead(rules)
    b.buffer = 2 * b.lookahead
    symbols = [number[c] for c in word]
    assert list(b.stream(symbols)) == b.merge(list(symbols)) == b._merge_long(list(symbols))


# --- secrets


def test_secrets(spark):
    key = "Zx9Kq7Wv3Lp0Rt5Ny8Bm"
    texts = [
        "password: hunter22 and API_KEY='abc-123456'", "token = short", "AKIA" + "A1" * 8 + " AKIASHORT", "0" * 24 + " " + "f" * 23, f"see {key} here",
        "550e8400-e29b-41d4-a716-446655440000 " + "D41D8CD98F00B204E9800998ECF8427E", "internationalisation12 congratulations2024", *ODD,
    ]
    got = {r["doc_id"]: r for r in secrets.find_secrets(clashing(frame(spark, texts)), RANKS).collect()}
    assert got[0]["spans"] == "assign:0:18,assign:23:42" and got[1]["spans"] == "" and got[2]["spans"] == "access:0:20"
    assert got[3]["spans"] == "hex:0:24" and got[4]["spans"] == f"token:4:{4 + len(key)}" and got[5]["spans"] == "" and got[6]["spans"] == ""
    assert got[0]["n_assign"] == 2 and got[0]["base_sha256"] == hashlib.sha256(b"assign:0:18,assign:23:42").hexdigest()
    assert got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(got) == len(texts)
    clean = {r["doc_id"]: r for r in secrets.redacted(frame(spark, texts), RANKS).collect()}
    assert clean[4]["text"] == "see [SECRET] here" and clean[4]["n_chars"] == 17 and clean[7]["text"] is None and clean[12]["text"] == "The cat"


def test_secrets_letters_only():
    r = random.Random(5)
    for n in (16, 24, 40):
        keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n)) for _ in range(200)]
        found = sum(secrets.scan(f"see {k} here", RANKS)[1] == [("token", 4, 4 + n)] for k in keys)
        assert found >= 198
    for plain in ("internationalisation", "state-of-the-art-equipment", "1234567890123456789", "2024-10-11-12-13-14", "_" * 40, "=" * 17):
        assert secrets.scan(f"see {plain} here", RANKS)[1] == []


def test_secrets_parts():
    key, base64 = "Zx9Kq7Wv3Lp0Rt5Ny8Bm", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ9kLt3vGh"
    for before in ("session-key-production-", "https/example/download/files/", "config/settings/database/connection/", "a_name_of_some_length/"):
        for after in ("", "/download/the/whole/archive/directory"):
            at = 4 + len(before)
            assert [s for s in secrets.scan(f"see {before}{key}{after} here", RANKS)[1] if s[1] <= at and s[2] >= at + len(key)]
            assert secrets.scan(f"see {before}internationalisation{after} here", RANKS)[1] == []
    text = "AKIA" + "A1B2" * 4 + "/" + base64
    assert secrets.scan(text, RANKS)[1] == [("access", 0, 20), ("token", 21, len(text))]
    assert secrets.redact(text, secrets.scan(text, RANKS)[1]) == "[SECRET]/[SECRET]"
    assert secrets.scan(f"{key}/password=hunter22", RANKS)[1] == [("token", 0, 20), ("assign", 21, 38)]
    files = "config/settings/database/connection/550e8400-e29b-41d4-a716-446655440000"
    assert secrets.scan(files, RANKS)[1] == []


# --- top-k


def test_knn(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2050, [float("inf")] * 8), (None, [1.0] * 8), (3000, [0.5])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    data = knn.quantized(df)
    got = collections.defaultdict(list)
    for x in knn.top_k(data, data.where("vec_id % 50 = 0")).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    vectors = {i: np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), (0, 8 - len(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    queries = [i for i in vectors if i % 50 == 0]
    assert set(got) == set(queries)
    for q in queries:
        best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert knn.top_k(data.limit(0), data).count() == 0
    assert knn.top_k(data.where("vec_id in (0, 1)"), data.where("vec_id = 0")).count() == 1


def test_knn_groups(spark, monkeypatch):
    """Clusters far apart, with blocks that groups share and groups of many blocks; and most groups need not be seen."""
    r = np.random.default_rng(5)
    middles = r.normal(size=(12, 6)) * 40
    rows = [(i, [float(x) for x in middles[i % 12] * (1 if i % 12 else 0.01) + r.normal(size=6)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    vectors = {x["vec_id"]: np.array(x["v"]) for x in data.collect()}
    queries = [i for i in vectors if i % 50 == 0]
    for block in (7, 64, 5000):
        monkeypatch.setattr(knn, "BLOCK", block)
        got = collections.defaultdict(list)
        for x in knn.top_k(data, data.where("vec_id % 50 = 0")).collect():
            got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
        for q in queries:
            best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    sizes = [3, 4, 20, 1, 1, 6, 30, 2]
    places = knn.in_blocks(sizes, 8)
    assert all(many == -(-n // 8) for n, (_, many) in zip(sizes, places, strict=True))
    used = collections.Counter()
    for n, (first, many) in zip(sizes, places, strict=True):
        used.update({b: n / many for b in range(first, first + many)})
    assert max(used.values()) <= 8 and set(used) == set(range(max(used) + 1))


def test_knn_bounds():
    r = np.random.default_rng(6)
    x, q = r.integers(-500, 500, (400, 5)), r.integers(-500, 500, (30, 5)).astype(float)
    centres = x[:20].astype(float)
    group = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    far = np.array([np.sqrt(((x[group == g] - centres[g]) ** 2).sum(1)).max() for g in range(20)])
    norm = np.array([np.sqrt((x[group == g] ** 2).sum(1)).max() for g in range(20)])
    bound, scores = knn.group_bounds(q, centres, far, norm), q @ x.T
    assert all((scores[:, group == g] <= bound[:, [g]]).all() for g in range(20)) and (bound < scores.max(1)[:, None] / 2).any()
    assert knn.pivot_count(10**12, 64) * 64 * 8 <= knn.PIVOT_BYTES and knn.pivot_count(10_000, 64) == 101


# --- Jaccard join


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    rep = {}
    for i, s in enumerate(sets):
        rep.setdefault(s, i)
    root, n = {i: i for i in rep.values()}, collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = sorted(rep.values())
    for a in own:
        for b in own:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and sets[a] & sets[b]:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(rep[s]), rep[s], n[rep[s]]) for i, s in enumerate(sets)}


def near_copies(n, seed=5):
    r = random.Random(seed)
    words = [f"w{r.randrange(500)}" for _ in range(200)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = [*base_text()[:80], *near_copies(90), *ODD, "one two three", "One  two\nthree"]
    got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_links"]) for r in jaccard_join.near_duplicates(clashing(frame(spark, texts))).collect()}
    assert got == jaccard_brute(texts)
    kept = jaccard_join.deduplicated(frame(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _, _ in got.values()}


def drifting(n, seed=6):
    """Each text differs from the one before in a word, so that a chain joins texts with nothing in common."""
    r = random.Random(seed)
    words = [f"v{r.randrange(10**6)}" for _ in range(60)]
    out = []
    for i in range(n):
        words[i * 7 % 60] = f"y{i}"
        out.append(" ".join(words))
    return out


def test_jaccard_chains(spark, monkeypatch):
    """A component that only a chain holds together is compared by buckets, a group of near copies as a whole."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    texts = [*drifting(400), *near_copies(30), *ODD]
    docs = frame(spark, texts)
    found = jaccard_join.features(docs).withColumnRenamed("doc_id", "rep")
    dealt = jaccard_join.units(found.dropDuplicates(["key"])).collect()
    assert {r["rep"] for r in dealt if r["in_bucket"]} >= set(range(100, 300))
    assert {r["rep"] for r in dealt if not r["in_bucket"]} >= set(range(400, 420))
    got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == jaccard_brute(texts)


def test_jaccard_edges(spark):
    got = jaccard_join.near_duplicates(frame(spark, ["a b", "a b", "c"], [None, 4, 4])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in got) == [(-1, -1), (4, 4), (4, 4)]
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    least = jaccard_join.least_matches()
    assert all(a < b for a, b in zip(least.values(), list(least.values())[1:], strict=False)) and all(m < n for n, m in least.items())


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    loops = {i for i in root if find(i) == i and sum(find(j) == i for j in root) == 1}
    assert got == {i: find(i) for i in root if i not in loops}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix arrays


def repeats_brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def shared_passage(n, seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8)))
    passage = " ".join(word() for _ in range(40))
    return [" ".join([*(word() for _ in range(r.randrange(60))), passage, *(word() for _ in range(r.randrange(60)))]) for _ in range(n)]


def passages_brute(texts, words):
    """(runs of words that occur elsewhere as part of a run of so many words, their words) of each text."""
    lists = [(t or "").split() for t in texts]
    n = collections.Counter(tuple(w[i : i + words]) for w in lists for i in range(len(w) - words + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if n[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        out.append((sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), sum(gone), gone))
    return out


@pytest.mark.parametrize(("hot", "batch"), [(2000, 1 << 22), (5, 2000), (2000, 1500)])
def test_suffix(spark, monkeypatch, hot, batch):
    texts = [*shared_passage(60), *ODD[:7], "ab" * 400, "x" * 300, *shared_passage(3, 7), "é" * 200, *(" ".join(t.split()[20:45]) for t in shared_passage(9, 8))]
    original = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda docs, layers: original(docs, [x._replace(kgram=k) for x, k in zip(layers, (24, 3), strict=True)], batch, hot))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(clashing(frame(spark, texts)), 60, 12).collect()}
    want = [(*a, *b[:2]) for a, b in zip(repeats_brute(texts, 60), passages_brute(texts, 12), strict=True)]
    assert [got[i] for i in range(len(texts))] == want and any(w[1] == 0 < w[5] for w in want) | any(w[4] for w in want)


def test_suffix_whole(spark):
    texts = base_text()[:100]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [(*a, *b[:2]) for a, b in zip(repeats_brute(texts, 400), passages_brute(texts, 51), strict=True)]
    both = frame(spark, ["ab" * 300, "ab" * 300, "é" * 300], [None, 7, 8])
    assert {r["n_removed"] for r in suffix_dedup.digests(both).collect()} == {600}
    assert suffix_dedup.digests(both.limit(0)).count() == 0
    cut = {r["doc_id"]: r for r in suffix_dedup.without_repeats(frame(spark, ["x" + "é" * 200 + "y", "zz" + "é" * 200, "own", None])).collect()}
    assert cut[0]["text"] == "xy" and cut[0]["n_chars"] == 2 and cut[1]["text"] == "zz" and cut[2]["text"] == "own" and cut[3]["text"] is None


def test_suffix_pieces(spark, monkeypatch):
    """Texts that are taken in pieces, with repeats across the ends of those."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = letters(150)
    texts = [letters(n) + passage + letters(50) for n in (0, 20, 55, 99, 130, 333)] + ["z" * 500, passage[:61], ""]
    found = []
    raws = [t.encode() for t in texts]
    for data, parts in suffix_dedup.pieces_of(raws, 1, 60):
        first, last, _ = suffix_dedup.segments(np.frombuffer(data, np.uint8), 60, 24, [*(start for _, start, _ in parts[1:]), len(data)])
        for f, e in zip(first.tolist(), last.tolist(), strict=True):
            number, start, offset = [p for p in parts if p[1] <= f][-1]
            found += [(number, i - start + offset) for i in range(f, e + 1)]
            assert data[f : e + 60] == raws[number][f - start + offset : e - start + offset + 60]
    assert sorted(found) == sorted((k, i) for k, t in enumerate(raws) for i in range(len(t) - 59))
    long = letters(1_200_000) + passage * 3 + letters(1_000)
    got = {x["doc_id"]: tuple(x)[1:4] for x in suffix_dedup.digests(frame(spark, [long, passage * 3, letters(500)])).collect()}
    assert got[0][1:] == got[1][1:] == (450, 1) and got[2][1:] == (0, 0)


def test_prefix_ranks():
    r = np.random.default_rng(8)
    text = r.integers(97, 99, 500).astype(np.uint8)
    for length in (5, 8, 60, 100):
        padded = bytes(text) + b"\0" * 128
        want = sorted({padded[i : i + max(8, length)] for i in range(500)})
        place = {s: i for i, s in enumerate(want)}
        ranks = suffix_dedup.prefix_ranks(text, length)
        order = np.argsort(ranks, kind="stable")
        assert [place[padded[i : i + max(8, length)]] for i in order] == sorted(place[padded[i : i + max(8, length)]] for i in range(500))


# --- language model


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, order):
    texts = [*base_text()[:50], *ODD, *base_text()[:3]]
    docs = [(t or "").lower().split() for t in texts]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    total = [None, *(collections.Counter(g for w in docs for g in grams(w, k)) for k in range(1, order + 1))]
    words = sum(map(len, docs))
    got = {r["doc_id"]: r for r in lm_score.score(clashing(frame(spark, texts)), order, batch=5000).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(docs):
        own = [None, *(collections.Counter(grams(w, k)) for k in range(1, order + 1))]
        left = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        want = 0.0
        for j in range(len(w)):
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k > 1 and left(g) > 0:
                    want += math.log10(left(g) / left(g[:-1])) + (min(order, j + 1) - k) * math.log10(0.4)
                    break
                if k == 1:
                    want += math.log10(max(left(g), 0.5) / max(1, words - len(w))) + (min(order, j + 1) - 1) * math.log10(0.4)
        assert math.isclose(got[i]["log10_prob"], want, rel_tol=1e-9, abs_tol=1e-9) and got[i]["n_words"] == len(w)
        assert (got[i]["score"] is None) == (not w)


def test_lm_edges(spark):
    assert lm_score.score(frame(spark, [])).count() == 0
    assert [r["n_words"] for r in lm_score.score(frame(spark, ["a b"], [None])).collect()] == [2]


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home now</a></li></ul></nav><div class="ad">Buy this thing today</div>
<article><h1>The &amp; title</h1><p><b>First   line<br><p>Second&nbsp;line&#33;</p><aside>Not this</aside><p>Be.</p><section id="comments"><p>I disagree</p></section></article>
<footer>&copy; all of us <p>more</p></footer></body></html>"""
PLAIN = "<html><body><div id='nav'><a href=1>Home</a> <a href=2>About</a></div><div class='content'><h2>Big head line here</h2><p>Many words of real text stand here in a row.</p><p>And some more of them follow after that.</p></div><div class='sidebar'>Other things</div><form>Mail <input></form></body></html>"


def test_pages(spark):
    rows = [(i, "u", PAGE) for i in range(5)] + [(10, "u", None), (11, "u", ""), (12, None, "just words"), (13, "u", "<p>a < b"), (14, "u", PLAIN), (15, "u", PAGE[: PAGE.index("Be.")]), (16, "u", "<article><p>" + "word " * 50_000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in html_extract.extract(df, html_extract.train(df)).collect()}
    whole = "The & title\nFirst line\nSecond line!\nBe."
    assert got[0]["text"] == whole and got[0]["n_chars"] == len(whole)
    assert got[10]["text"] == "" and got[11]["text"] == "" and got[12]["text"] == "just words" and got[13]["text"] == "a < b"
    assert got[14]["text"] == "Big head line here\nMany words of real text stand here in a row.\nAnd some more of them follow after that."
    assert got[15]["text"] == whole[: -len("\nBe.")] and got[16]["n_chars"] == 249_999
    assert html_extract.extract(df.limit(0), html_extract.train(df.limit(0))).count() == 0


def test_pages_dotted_i():
    page = PAGE.replace("Be.", "Be. \u0130stanbul").replace("</script>", "</SCRIPT\n>")
    assert html_extract.main_text(page, {}) == "The & title\nFirst line\nSecond line!\nBe. \u0130stanbul"
    assert html_extract.main_text("<title>\u0130</tItle><p>some words</p><style>x", {}) == "some words"


def test_pages_frame_hints():
    text = lambda page: html_extract.main_text(page, {})
    whole, plain = text(PAGE), text(PLAIN)
    assert whole and plain
    for name in ("has-sidebar", "no-sidebar", "header-fixed"):
        assert text(PAGE.replace("<body>", f"<body class='{name}'>")) == whole
        assert text(PAGE.replace("<article>", f"<article class='post {name} no-comments'>")) == whole
        assert text(PAGE.replace("<article>", f"<main class='{name}'>").replace("</article>", "</main>")) == whole
        for inner in (f"<div id='page' class='{name}'>", f"<div class='{name}'><div class='{name} wide'>"):
            assert text(PLAIN.replace("<html>", f"<html class='{name}'>").replace("<body>", f"<body>{inner}")) == plain
    # comments, even if they are most of the page, or articles of their own
    long = "I disagree with it all. " * 30
    assert text(PAGE.replace("I disagree", long)) == whole
    assert text(f"<body><article><p>A short article stands here.</p></article><div class='comments'><article class='comment'><p>{long}</p></article></div></body>") == "A short article stands here."
    assert text("<body><article><p>A short article stands here.</p><article class='comment'><p>No.</p></article></article></body>") == "A short article stands here."


def test_pages_tags():
    text = lambda page: html_extract.main_text(page, {})
    assert text('<p>some <b title="5" tall">words</b> here and there</p>') == "some words here and there"
    assert text("<div>one two three</div><article><p>first text of some words</p></article><div>four</div><article><p>second text of some words</p></article>") == "first text of some words\nsecond text of some words"
    assert text("<p>words of a text <a href='x\" y='z'>and a link</a> stand here</p>") == "words of a text and a link stand here"
    assert text("<p title = \"a > b\" hidden=x/y>all of these words</p>") == "all of these words"
    assert text("<p>a < b and b <= c</p>") == "a < b and b <= c" and text("words before <a href") == "words before <a href"
    assert text("<article><p>words <!-- <p>not these</p> --> of it</p></article>") == "words of it"


@pytest.mark.parametrize("part", ["<a ", "<a b=\"", "<a b=\">\" ", "<a b='\" c=\"<a b='", "<!", "<", "</a ", "<a b=\"<a b='\" c='"])
def test_pages_time(part):
    """Time grows with the page and not with its square."""
    import time

    def took(n):
        began = time.perf_counter()
        html_extract.main_text(part * n, {})
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 20 * max(took(8_000), 0.01)


def test_sample_bound():
    from relweave.llm.common import hash_bound

    for n in (10**4, 10**9, 10**12, 10**15):
        share = (hash_bound(1000, n) + 2**63) / 2**64
        assert math.isclose(share, 1000 / n, rel_tol=1e-3)
    assert hash_bound(1000, 10) == 2**63 - 1


def test_best_region():
    r = random.Random(9)
    for _ in range(200):
        s = [r.randrange(-5, 6) for _ in range(12)]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13)))


# --- packing


def test_packing(spark, tokenizer):
    texts = [*base_text()[:60], *ODD, "word " * 5000]
    rows = packing.pack_documents(clashing(frame(spark, texts)), VOCAB).collect()
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    by = collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids)) and len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) * 2048 < 1.1 * sum(map(len, ids)) + 2048
    assert packing.pack_documents(frame(spark, []), VOCAB).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(lengths):
    """The same windows as a search of all open ones for the tightest."""
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if fits:
            w = min(fits)[1]
        else:
            room.append(64)
            w = len(room) - 1
        want[i] = 64 - room[w]
        room[w] -= lengths[i]
    got = packing.best_fit_decreasing(lengths, 64)
    assert sorted(len([1 for w, _ in got if w == v]) and sum(n for n, (w, _) in zip(lengths, got, strict=True) if w == v) for v in {w for w, _ in got}) == sorted(64 - r for r in room)
