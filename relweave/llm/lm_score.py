"""Stupid-backoff scores from n-gram counts of the corpus itself.

Documents are dealt into batches by a hash of doc_id. A batch sends each of its distinct n-grams once, as a 64-bit
hash with its count in the batch, to the part of the count table that the hash falls into; so a common n-gram
costs one entry a batch, not one a document. The count table adds up the entries and returns the totals to each
batch that asked, where they are joined to the n-grams of its documents and the scores are summed per document.
Entries travel packed: sorted hashes as differences, counts compressed.

A document is scored against all others: its own n-grams are taken off the totals first. With c the counts left
and N the words left, word i of a document scores log10(c(w[i-k+1..i]) / c(w[i-k+1..i-1])) for the longest k up to
ORDER whose n-gram is left, or log10(c(w[i]) / N) for k = 1, plus log10(ALPHA) for each order skipped; a word that
is left nowhere counts as half an occurrence. Words are the lower-cased text split at white space.

Edge cases: a null or empty text has no words, log10 probability 0 and a null score; null doc_ids share a batch
and are scored like others; equal texts count as evidence for each other; an empty table gives no rows; with no
other document N is 0 and counts as 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import arrow_fields, map_groups, read, shuffle_partitions
from relweave.llm.jaccard_join import MIX, mixed, word_hashes

ORDER, ALPHA = 2, 0.4
#: Bytes of text of a batch, on average.
BATCH = 32 << 20
#: The hash under which a batch sends its number of words.
WORDS = np.uint64(0)


def gram_keys(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order k, hashes of the n-grams from each start that has k words. Never WORDS."""
    out = [mixed(words * MIX[0] + np.uint64(1)) | np.uint64(1)]
    for k in range(2, order + 1):
        n = max(0, len(words) - k + 1)
        out.append(mixed(out[-1][:n] * MIX[0] + words[k - 1 :] + np.uint64(k)) | np.uint64(1))
    return out


def batch_table(texts: list[str | None], order: int) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
    """(keys of each document by order, distinct keys in order, their counts); the first key is WORDS."""
    docs = [gram_keys(word_hashes((t or "").lower().split()), order) for t in texts]
    keys, counts = np.unique(np.concatenate([k for d in docs for k in d]), return_counts=True)
    return docs, np.concatenate(([WORDS], keys)), np.concatenate(([sum(len(d[0]) for d in docs)], counts))


def pack_keys(keys: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = 8 if len(gaps) and int(gaps.max()) >> 48 else 6
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u8").astype(np.int64)


def score_document(keys: list[np.ndarray], table: np.ndarray, totals: np.ndarray, alpha: float) -> tuple[int, int, float]:
    """(words, words scored at the highest order, log10 probability) of a document, itself left out."""
    n = len(keys[0])
    if not n:
        return 0, 0, 0.0
    left = []
    for k in keys:
        distinct, inverse, own = np.unique(k, return_inverse=True, return_counts=True)
        left.append((totals[np.searchsorted(table, distinct)] - own)[inverse])
    rest, score, open_ = max(1, int(totals[0]) - n), np.zeros(n), np.ones(n, bool)
    possible = np.minimum(np.arange(n) + 1, len(keys))
    top = 0
    for k in range(len(keys), 0, -1):
        at = np.arange(k - 1, n)
        found = open_[at] & (left[k - 1] > 0) if k > 1 else open_[at]
        at = at[found]
        above = left[k - 1][at - k + 1].astype(float) if k > 1 else np.maximum(left[0][at], 0.5)
        below = left[k - 2][at - k + 1] if k > 1 else rest
        score[at] = np.log10(above / below) + (possible[at] - k) * np.log10(alpha)
        open_[at] = False
        top += len(at) if k == len(keys) else 0
    return n, top, float(score.sum())


def in_arrow(fn, layout: pa.Schema):
    """A function of (key, columns) that yields columns once, as one of Arrow tables."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (got,) = fn(tuple(k.as_py() for k in key), table.to_pydict())
        return pa.Table.from_arrays([pa.array(got[f.name], f.type) for f in layout], schema=layout)

    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_words, n_top, log10_prob, score) of every row; score is log10_prob a word."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(parts, -(-size // batch))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("b"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def ask(key: tuple, cols: dict[str, list]) -> Iterator[dict[str, list]]:
        _, keys, counts = batch_table(cols["text"], order)
        place = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(place, np.arange(parts + 1))
        rows = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
        yield {
            "p": rows, "b": [key[0]] * len(rows),
            "keys": [pack_keys(keys[cuts[i] : cuts[i + 1]]) for i in rows], "counts": [pack_counts(counts[cuts[i] : cuts[i + 1]]) for i in rows],
        }

    def add_up(key: tuple, cols: dict[str, list]) -> Iterator[dict[str, list]]:
        keys = [unpack_keys(k) for k in cols["keys"]]
        every = np.concatenate(keys)
        _, inverse = np.unique(every, return_inverse=True)
        total = np.zeros(inverse.max() + 1, np.int64)
        np.add.at(total, inverse, np.concatenate([unpack_counts(c) for c in cols["counts"]]))
        at = 0
        for b, k in zip(cols["b"], keys, strict=True):
            yield {"b": [b], "p": [key[0]], "totals": [pack_counts(total[inverse[at : at + len(k)]])]}
            at += len(k)

    # grouped by the same key in the same way, so that the exchange of the texts is made once and reused
    texts = dealt.groupBy("b")
    entry = "p int, b int, keys binary, counts binary"
    asked = texts.applyInArrow(in_arrow(ask, pa.schema(arrow_fields(spark, entry))), entry)
    told = map_groups(asked, ["p"], add_up, "b int, p int, totals binary", sort=["b"])
    out = "doc_id long, n_words long, n_top long, log10_prob double, score double"
    schema = pa.schema(arrow_fields(spark, out))

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_, table, _ = batch_table(left.column("text").to_pylist(), order)
        answers = sorted(zip(right.column("p").to_pylist(), right.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([unpack_counts(t) for _, t in answers])
        got = [score_document(d, table, totals, alpha) for d in docs_]
        cols = [left.column("doc_id").to_pylist(), *([g[i] for g in got] for i in range(3)), [g[2] / g[0] if g[0] else None for g in got]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return texts.cogroup(told.groupBy("b")).applyInArrow(sum_up, out)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
