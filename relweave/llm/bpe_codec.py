"""BPE encoding and decoding of documents (see bpe.py for the transducer).

Edge cases: a null text is empty; an empty text has no tokens and decodes to the empty text; rows with a null
or repeated doc_id are encoded like any other, one row out for each row in; other columns are ignored.
Words of any length are streamed with constant memory. Character classes are those of the installed Unicode tables.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.bpe import MARKS, Bpe, ChunkCache, Decoder
from relweave.llm.common import map_arrow, read, worker_cache


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        bpe = Bpe.load(path)
        return {"doc_id": cols["k"], "ids": [bpe.encode(t or "") for t in cols["t"]]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, style: str = "listed") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); styles as in Decoder. Null ids decode to the empty text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = []
        for ids in cols["ids"]:
            d = Decoder(Bpe.load(path), style)
            out.append(d.feed(ids or []) + d.end())
        return {"doc_id": cols["doc_id"], "text": out}

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def _digest_cache(path: str) -> ChunkCache:
    """Chunk to (tokens, ids as text, decoded text); all three concatenate over chunks with single spaces."""
    bpe = Bpe.load(path)

    def make(c: str | int) -> tuple[int, str, str]:
        if isinstance(c, str) and not c.isalpha() and (core := c.rstrip(MARKS)) != c and core.isalpha():
            a, b = cache[core], cache[c[len(core) :]]
            return a[0] + b[0], f"{a[1]} {b[1]}", f"{a[2]} {b[2]}"
        ids = [c] if isinstance(c, int) else bpe.chunk(c)
        d = Decoder(bpe)
        return len(ids), " ".join(map(str, ids)), d.feed(ids) + d.end()

    cache = ChunkCache(make, 250_000)
    return cache


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        held = worker_cache("bpe")
        cache = held.get(("digests", path)) or held.setdefault(("digests", path), _digest_cache(path))
        bpe = Bpe.load(path)
        out: dict[str, list] = {"doc_id": cols["k"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols["t"]:
            got = [cache[c] for c in bpe.chunks(text or "")]
            out["n_tokens"].append(sum([g[0] for g in got]))
            out["ids_sha256"].append(hashlib.sha256(" ".join([g[1] for g in got]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(" ".join([g[2] for g in got]).encode()).hexdigest())
        return out

    kept = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return map_arrow(kept, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary())
