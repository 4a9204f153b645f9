"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters (other characters count as one space) are hashed into DIM
features. Document frequencies come from every training row. The classifier is fitted on at most SAMPLE labelled
rows, in expectation, spread evenly over the languages and chosen by a hash of doc_id: follow-the-regularised-
leader with L1 and L2 penalties, a rate for each coordinate. A temperature, fitted on a fifth of the sample that
the weights have not seen, calibrates the scores.

Edge cases: a text that is null or has no letter is `und` with score 0; rows with a null lang, or a null doc_id,
are predicted but teach nothing; with no labelled row at all everything is `und`; repeated rows are predicted
once each; among equal scores the first language in alphabetical order wins; other columns are ignored. Whole
texts are used, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import hash_below, map_arrow, read, worker_cache

#: Hashed features.
DIM = 1 << 16
#: Labelled rows that the classifier sees, in expectation.
SAMPLE = 4000
#: Rate and smoothing of the leader, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
EPOCHS = 3
#: Characters that are hashed at a time.
PIECE = 1 << 20
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    held = worker_cache("langid")
    if "letters" not in held:
        held["letters"] = np.fromiter((c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return held["letters"]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature numbers, counts) of a text; None if it has no letter."""
    if not text:
        return None
    counts, any_letter, low = np.zeros(DIM, np.int64), False, text.lower()
    for at in range(0, len(low), PIECE):
        # pieces overlap by two characters so that n-grams across their ends are counted once
        a = letters()[np.frombuffer(low[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = a == 32
        any_letter |= not gap.all()
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        a = np.concatenate(([np.uint32(32)], a[keep], [np.uint32(32)])) * MULTIPLIERS[0]
        b = a[:-1] * MULTIPLIERS[1] ^ a[1:]
        c = b[:-1] * MULTIPLIERS[2] ^ a[2:]
        for h in (a, b * MULTIPLIERS[0], c * MULTIPLIERS[0]):
            counts += np.bincount(h >> np.uint32(16), minlength=DIM)
    if not any_letter:
        return None
    which = np.flatnonzero(counts)
    return which, counts[which]


@dataclass
class Model:
    """weights: (DIM, languages); idf: (DIM,)."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[which]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(which, counts) @ self.weights[which]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (f := features(text)) is None:
            return "und", 0.0
        p = softmax(self.logits(*f) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts hold each feature. Every task counts its own rows; at most DIM rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (f := features(text)) is not None:
                    total[f[0]] += 1
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(total[which], pa.int64())], names=["feature", "n"])

    out = np.zeros(DIM, np.int64)
    for feature, n in docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n
    return out


def sample(train: DataFrame, counts: dict[str, int], size: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About size labelled rows as (lang, feature numbers, counts), as many of each language, by a hash of doc_id.

    Were there twice as many, which chance does not bring about, those of the smallest hashes would be taken."""
    limit = F.lit(False)
    order = F.xxhash64("doc_id", F.lit("langid"))
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, hash_below(order, size / max(1, len(counts)), n)).otherwise(limit)
    rows = train.where(limit).select("doc_id", "lang", "text")

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = [features(t) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"], "lang": cols["lang"],
            "which": [f and f[0].astype("<u2").tobytes() for f in got], "counts": [f and f[1].astype("<u4").tobytes() for f in got],
        }

    found = map_arrow(rows, run, "doc_id long, lang string, which binary, counts binary").where("which is not null").orderBy(order, "doc_id").limit(2 * size).collect()
    found.sort(key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["doc_id"]))
    return [(r["lang"], np.frombuffer(r["which"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4")) for r in found]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int) -> Model:
    languages = sorted({r[0] for r in rows})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    k = len(languages)
    model = Model(languages, idf, np.zeros((DIM, k)), 1.0)
    label = {v: i for i, v in enumerate(languages)}
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))

    def lead(which: np.ndarray) -> np.ndarray:
        zi = z[which]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[which])) / ALPHA + L2))

    data = [(label[r[0]], r[1], model.vector(r[1], r[2])) for r in rows]
    check = [d for i, d in enumerate(data) if i % 5 == 4]
    learn = [d for i, d in enumerate(data) if i % 5 != 4] or data
    for _ in range(EPOCHS):
        for y, which, x in learn:
            w = lead(which)
            g = softmax(x @ w)
            g[y] -= 1
            g = np.outer(x, g)
            ni = n[which]
            z[which] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[which] = ni + g * g
    model.weights = lead(np.arange(DIM)) if k else model.weights
    if check:
        scores = np.array([x @ model.weights[which] for _, which, x in check])
        truth = np.array([y for y, _, _ in check])
        loss = lambda t: -np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 10, 60), key=loss))
    return model


def train(docs: DataFrame, size: int = SAMPLE) -> Model:
    """A model from text and non-null lang of the rows that are not held out."""
    own = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.ones(DIM), np.zeros((DIM, 0)), 1.0)
    return fit(sample(own, counts, size), document_frequencies(own), sum(counts.values()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row. The model has DIM rows of one number a language."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature))

    def run(cols: dict[str, list]) -> dict[str, list]:
        m = Model(*sent.value)
        got = [m.predict(t) for t in cols["t"]]
        return {"doc_id": cols["k"], "held_out": cols["h"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    kept = docs.select(F.col("doc_id").cast("long").alias("k"), held_out(F.col("doc_id")).alias("h"), F.col("text").alias("t"))
    return map_arrow(kept, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """documents whose language is found with a calibrated score of at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature))

    def run(cols: dict[str, list]) -> dict[str, list]:
        m = Model(*sent.value)
        got = [m.predict(t) for t in cols["text"]]
        keep = [i for i, (lang, score) in enumerate(got) if lang != "und" and score >= least]
        return {k: [v[i] for i in keep] for k, v in cols.items()}

    kept = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return map_arrow(kept, run, "doc_id long, text string, lang string, source string, n_chars long")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
