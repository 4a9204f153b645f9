"""Near-duplicate join on word shingles with Bayesian candidate pruning.

Documents with the same set of shingles are one class; only class representatives are compared. MinHash bands
(BANDS of ROWS values) bring together representatives; a pair of similarity 0.8 shares no band with probability
3e-6. Each band bucket links its members to its smallest one, so buckets cost their size and not its square; every
candidate pair lies in one component of these links. What is compared inside, the unit, is a whole component or each of
its buckets, whichever copies fewer rows: a group of near copies shares most of its buckets and is one unit, while texts
that only chains of unlike ones hold together are compared bucket by bucket, each pair in the first bucket that it
shares. Both ways find every pair that shares a band. Units are cut into blocks, a task compares two blocks.

Candidates are pruned as MinHash values are read, STEP at a time: with m of n values equal and a flat prior, the
probability that the similarity is at least t is P(Bin(n + 1, t) <= m); a pair is dropped once that is below
TOLERANCE. What is left is verified exactly on the shingle sets. A task returns counts of links and a spanning
forest of them, never all pairs.

Words are the lower-cased text split at white space; a shingle is five of them, and a text of fewer words is one
shingle. Edge cases: a null or empty text has no shingle, such texts are copies of each other and link to nothing;
rows with a null doc_id take no part and return a null class; repeated rows are copies; rows that share a doc_id
are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.bpe import ChunkCache
from relweave.llm.common import connected_components, map_arrow, map_groups, materialize, read, worker_cache

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 32, 5, 32
TOLERANCE = 1e-6
#: Members of a block, on average.
BLOCK = 256
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def word_hashes(words: list[str]) -> np.ndarray:
    held = worker_cache("jaccard")
    cache = held.get("words") or held.setdefault("words", ChunkCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), 300_000))
    return np.array([cache[w] for w in words], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * MIX[0] + w[i : len(w) - size + 1 + i]
    return np.unique(mixed(h))


def minhash(s: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    held = worker_cache("jaccard")
    if ("minhash", n) not in held:
        r = np.random.Generator(np.random.PCG64(20240229))
        held["minhash", n] = r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)
    a, b = held["minhash", n]
    low = np.full(n, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 1024):
        low = np.minimum(low, ((s[at : at + 1024, None] * a + b) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    part = signature.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * MIX[0] + part[:, i])
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = BANDS * ROWS, step: int = STEP) -> dict[int, int]:
    """For each number of values read, the fewest equal ones with which a pair is kept."""
    out = {}
    for read_ in range(step, n + 1, step):
        total, m = 0.0, 0
        while (total := total + math.comb(read_ + 1, m) * threshold**m * (1 - threshold) ** (read_ + 1 - m)) < tolerance:
            m += 1
        out[read_] = m
    return out


def compare(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray | None, threshold: float, band: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each i of first, its links among second, or among the later ones of first if second is None.

    band: the bucket that all sets are in; links whose first common bucket is another one are left to that one."""
    signs = np.stack([minhash(s) for s in sets])
    bands = None if band is None else np.stack([band_keys(s) for s in signs])
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts, least = ends - sizes, least_matches(threshold)
    mark = np.zeros(int(codes.max()) + 1, bool)
    for at, i in enumerate(first):
        alive = first[at + 1 :] if second is None else second
        alive = alive[np.minimum(sizes[alive], sizes[i]) >= threshold * np.maximum(sizes[alive], sizes[i]) - 1e-9]
        equal = np.zeros(len(alive), np.int64)
        for n, m in least.items():
            equal += (signs[alive, n - STEP : n] == signs[i, n - STEP : n]).sum(axis=1)
            alive, equal = alive[equal >= m], equal[equal >= m]
            if not len(alive):
                break
        if bands is not None and len(alive):
            alive = alive[bands[i][(bands[alive] == bands[i]).argmax(axis=1)] == band]
        if not len(alive):
            continue
        own = codes[starts[i] : ends[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[codes], starts)[alive] if 3 * len(alive) > len(sets) else np.array([mark[codes[starts[j] : ends[j]]].sum() for j in alive])
        mark[own] = False
        linked = alive[shared >= threshold * (sizes[alive] + sizes[i] - shared) - 1e-9]
        if len(linked):
            yield int(i), linked


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, bands) of every row with a doc_id; key stands for the shingle set."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["k"], "key": [], "n_shingles": [], "bands": []}
        for text in cols["t"]:
            s = shingles(text)
            out["key"].append(xxhash.xxh3_128_digest(s.tobytes()))
            out["n_shingles"].append(len(s))
            out["bands"].append(band_keys(minhash(s)) if len(s) else None)
        return out

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t"))
    return map_arrow(kept, run, "doc_id long, key binary, n_shingles int, bands array<long>")


def units(classes: DataFrame) -> DataFrame:
    """(rep, unit, in_bucket, blocks): the units that each representative is compared in, and their numbers of blocks.

    unit is a component's smallest member, or a bucket's key where in_bucket."""
    most = BANDS * classes.count()
    blocks = F.ceil(F.col("n") / BLOCK)
    banded = classes.where("n_shingles > 0").select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets, "bands", most)
    edges = banded.join(buckets, "band").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    parts = connected_components(edges, most=most)
    by_bucket = buckets.join(parts, F.col("low") == F.col("node")).groupBy("component").agg(F.sum(F.col("n") * blocks).alias("by_bucket"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).join(by_bucket, "component")
    sizes = materialize(sizes.select("component", blocks.cast("int").alias("blocks"), (F.col("n") * blocks <= F.col("by_bucket")).alias("whole")), "units", most)
    parts = parts.join(sizes, "component")
    out = parts.where("whole").select(F.col("node").alias("rep"), F.col("component").alias("unit"), F.lit(False).alias("in_bucket"), "blocks")
    if sizes.where("not whole").isEmpty():
        return out
    chained = classes.join(parts.where("not whole").select(F.col("node").alias("rep")), "rep").select("rep", F.explode("bands").alias("band"))
    return out.union(chained.join(buckets, "band").select("rep", F.col("band").alias("unit"), F.lit(True).alias("in_bucket"), blocks.cast("int").alias("blocks")))


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (a, b, n): n links of a where b is null, else an edge of a spanning forest of links."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = units(classes).withColumn("own", block).join(classes.select("rep", "key"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(placed, "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.withColumn("other", other).select("unit", "in_bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "key", "text")

    def solve(key: tuple, cols: dict[str, list]) -> Iterator[dict[str, list]]:
        ids, sets, own = [], [], []
        seen: set[int] = set()
        for rep, k, text, o in zip(cols["rep"], cols["key"], cols["text"], cols["own"], strict=True):
            if rep in seen:
                continue
            s = shingles(text)
            if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == bytes(k):
                seen.add(rep)
                ids.append(rep)
                sets.append(s)
                own.append(o)
        unit, in_bucket, x, y = key
        where = np.array(own)
        if len(ids) < 2 or x != y and not ((where == x).any() and (where == y).any()):
            return
        count, root = [0] * len(ids), list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i, linked in compare(sets, np.flatnonzero(where == x), None if x == y else np.flatnonzero(where == y), threshold, unit if in_bucket else None):
            count[i] += len(linked)
            for j in linked.tolist():
                count[j] += 1
                if (p := find(i)) != (q := find(j)):
                    root[p] = q
                    a.append(ids[i])
                    b.append(ids[j])
        some = [i for i, n in enumerate(count) if n]
        if some:
            yield {"a": [ids[i] for i in some] + a, "b": [None] * len(some) + b, "n": [count[i] for i in some] + [0] * len(a)}

    return map_groups(dealt, ["unit", "in_bucket", "x", "y"], solve, "a long, b long, n long", sort=["rep"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, rep_id, n_copies, n_links) of every row.

    rep_id is the smallest doc_id with the same shingles and n_copies how many have them; n_links is the number of
    other representatives with a similarity of at least threshold; class_id is the smallest doc_id that links lead to.
    """
    found = materialize(features(docs), "shingles")
    out = classified(docs, found, threshold)
    none = F.lit(None).cast("long")
    lost = docs.where("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("rep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return out.union(lost)


def classified(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """near_duplicates of the rows with a doc_id; found is a table of their features."""
    classes = found.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # a row holds BANDS numbers, so fewer rows a task
    classes = materialize(classes, "classes", found.count(), rows=10_000)
    got = materialize(links(docs, classes, threshold), "links")
    n_links = got.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    parts = connected_components(got.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.select("key", "rep", "n_copies").join(n_links, "rep", "left").join(parts, "rep", "left")
    known = known.select("key", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("rep_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = found.select("doc_id", "key").join(known, "key")
    return out.select("doc_id", "class_id", "rep_id", "n_copies", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """documents without those that have a near duplicate of smaller doc_id in their class.

    Rows that share a doc_id but not a shingle set cannot be told apart by class, so they are all kept, each text once;
    repeated rows are one; rows without a doc_id are kept."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *cols[1:])
    found = materialize(features(docs), "shingles")
    clash = found.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    keep = classified(docs, found).where("doc_id = class_id").select("doc_id").union(clash).distinct()
    kept = docs.join(keep, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return kept.select(*cols).union(docs.where("doc_id is null").select(*cols))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
