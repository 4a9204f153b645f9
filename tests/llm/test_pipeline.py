"""The corpus pipeline against brute force on a small table."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    from tests.llm.test_operators import DOCS, base_text, jaccard_brute, near_copies, passages_brute, repeats_brute

    key = "Zx9Kq7Wv3Lp0Rt5Ny8Bm"
    texts = [*base_text()[:60], *near_copies(12), None, "...", f"the key of this is {key} and that is it", "the end of it"]
    rows = [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if name == "near_duplicates":
            own = sorted((r["doc_id"], r["text"]) for r in before.collect())
            classes = jaccard_brute([t for _, t in own])
            assert set(kept[-1]) == {own[c][0] for c, _, _ in classes.values()}
        if name == "repeated_passages":
            own = sorted((r["doc_id"], r["text"]) for r in before.collect())
            gone = repeats_brute([t for _, t in own], 400)
            for (i, text), (n, bytes_, _, _), (_, n_words, words) in zip(own, gone, passages_brute([t for _, t in own], 51), strict=True):
                left = kept[-1][i]["text"]
                if not bytes_:
                    assert left.split() == [w for w, g in zip(text.split(), words, strict=True) if not g]
                elif not n_words:
                    assert n - bytes_ <= len(left.encode()) <= n - bytes_ + 6
                else:
                    assert len(left.encode()) <= n - bytes_ + 6 and len(left.split()) <= len(text.split()) - n_words
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    letters = {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert set(kept[0]) == letters
    assert all(key not in r["text"] for r in kept[3].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in docs.collect())


def test_short_passages(spark, tmp_path):
    from tests.llm.test_operators import frame

    passage = [f"w{i % 10}{chr(97 + i % 7)}" for i in range(51)]
    short, own = " ".join(passage), [" ".join(f"{c}{i}" for i in range(60)) for c in "pqrs"]
    texts = [f"{own[0]} {short} é end", f"{own[1]}  {short.replace(' ', chr(10), 7)}\u3000last words", f"{own[2]} {' '.join(passage[:50])} other", f"{own[3]} alone", None]
    docs = frame(spark, texts)
    assert corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).count() == len(texts)
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert len(short.encode()) < 400 and len(got) == len(texts)
    assert got[0]["text"] == f"{own[0]}  é end" and got[0]["n_chars"] == len(own[0]) + 7
    assert got[1]["text"] == f"{own[1]}  \u3000last words"
    assert [got[i]["text"] for i in (2, 3, 4)] == texts[2:]


@pytest.mark.parametrize("n_words", [51, 60, 90, 120])
def test_passages_by_length(spark, tmp_path, n_words):
    """Passages on both sides of 400 bytes, in few and in many documents: every place is cut, other documents stay."""
    import random

    from tests.llm.test_operators import frame

    r = random.Random(n_words)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(1, 11)))
    passages = [" ".join(word() for _ in range(n_words)) for _ in range(4)]
    around = lambda: " ".join(word() for _ in range(r.randrange(30, 90)))
    texts, want = [], []
    for number, copies in enumerate((2, 3, 12, 40)):
        for _ in range(copies):
            a, b = around(), around()
            texts.append(f"{a} {passages[number]} {b}")
            want.append(f"{a} {b}".split())
    texts += [(t := around()) for _ in range(20)]
    want += [t.split() for t in texts[len(want) :]]
    got = {x["doc_id"]: x["text"].split() for x in corpus_pipeline.repeated_passages(spark, frame(spark, texts), str(tmp_path)).collect()}
    # a window of bytes may begin inside the word before a passage, or end inside the one after it
    for i, w in enumerate(want):
        assert got[i] == w or len(" ".join(w)) - len(" ".join(got[i])) < 6, i


def edge_rows():
    long = " ".join(f"long{i % 977}" for i in range(150_000))
    some = "The cat sat on the mat and looked at all of the birds in the tree"
    return [
        (None, some, "en", "s", 1), (None, None, None, None, None), (1, some, "en", "s", 1), (1, some, "en", "s", 1), (1, "Quite another text of the same number, which must not get lost here", "en", "s", 2),
        (2, None, "en", None, None), (3, "", None, "s", 0), (4, "   ", "en", "s", 3), (5, "...", "en", "s", 3), (6, long, "en", "s", len(long)), (7, "Une phrase de quelques mots dans la langue de la France", "fr", "t", None),
        (8, "a", "fr", "t", 1), (9, some + " again", None, None, -1),
    ]


def test_stages_edges(spark, tmp_path):
    """Nulls in any column, repeated rows, shared ids, long texts, ties, clashing columns: no stage crashes or loses a text."""
    from tests.llm.test_operators import DOCS, clashing

    docs = clashing(spark.createDataFrame(edge_rows(), DOCS))
    texts = lambda df: sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    by = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "pack" or empty.columns == ["doc_id", "text", "lang", "source", "n_chars"])
    kept = texts(by["language"](spark, docs, str(tmp_path)))
    assert {t for _, t in kept} <= {t for _, t in texts(docs)} and not {2, 3, 4, 5} & {i for i, _ in kept} and {1, 6, 7, -1} <= {i for i, _ in kept}
    kept = texts(by["near_duplicates"](spark, docs, str(tmp_path)))
    assert {t for _, t in kept} == {t for _, t in texts(docs)} - {"   ", edge_rows()[-1][1]}
    assert [t for i, t in kept if i == 1] == sorted({r[1] for r in edge_rows() if r[0] == 1}) and len([i for i, _ in kept if i == -1]) == 2
    for name in ("repeated_passages", "secret_scan"):
        got = by[name](spark, docs, str(tmp_path)).collect()
        assert sorted((r["doc_id"] or -1, r["lang"] or "", r["source"] or "") for r in got) == sorted((r[0] or -1, r[2] or "", r[3] or "") for r in edge_rows())
        assert sum(r["text"] is None for r in got) == 2
    pieces = by["pack"](spark, docs, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(edge_rows()) and sum(r["length"] == 1 for r in pieces if r["doc_id"] in (2, 3, 4)) == 3


@pytest.mark.parametrize(("hot", "batch"), [(2000, 1 << 22), (5, 2000)])
def test_repeated_words(spark, hot, batch):
    import collections
    import random

    from relweave.llm import suffix_dedup
    from tests.llm.test_operators import frame

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    shared = [[word() for _ in range(70)] for _ in range(3)]
    lists = []
    for i in range(90):
        a = r.randrange(15)
        lists.append([*(word() for _ in range(r.randrange(40))), *shared[i % 3][a : a + r.randrange(45, 56)], *(word() for _ in range(r.randrange(40)))])
    lists += [["so"] * 300, [], ["The", "cat"]]
    n = collections.Counter(tuple(w[i : i + 51]) for w in lists for i in range(len(w) - 50))
    want = {(k, i) for k, w in enumerate(lists) for i in range(len(w) - 50) if n[tuple(w[i : i + 51])] > 1}
    docs = frame(spark, [" ".join(w) for w in lists])
    spans = suffix_dedup.repeated_spans(docs, [suffix_dedup.PASSAGES], batch, hot).join(docs.select("doc_id", *suffix_dedup.row_key()), suffix_dedup.KEY).collect()
    assert want and {(s["doc_id"], i) for s in spans for i in range(s["first"], s["last"] + 1)} == want


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
