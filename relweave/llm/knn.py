"""Exact top-k by inner product: a Voronoi kNN join.

Rows are grouped by their nearest pivot; there are about sqrt(n) pivots, as many as PIVOT_BYTES hold at most. Each
group's summary is its size, its radius and its longest vector. For a query q, a group with pivot p, radius r and
longest length m cannot score above any of q.p + |q| r, |q| m and (|q|^2 + m^2 - max(0, |q - p| - r)^2) / 2; the k-th
best score of q against the pivots, which are rows themselves, bounds its k-th best result from below. So q goes to
the groups whose bound reaches that, and no others. Large groups are split into blocks of about BLOCK rows, small ones
share a block; a query comes to a block once, with the groups that it has to see there. Queries stream past a block
in batches, and a block returns at most k rows a query, none below the query's bound.

Edge cases: vectors that are null, or hold a null or a non-finite component, and rows with a null vec_id take no
part; shorter vectors count as filled up with zeros; ties go to the smaller vec_id; a row with the query's own
vec_id is never its candidate; repeated query rows count once, repeated candidates once each; an empty table
gives no rows. Scores are exact while they and the components fit in 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.llm.common import map_arrow, materialize, read, shuffle_partitions

#: Bytes of all pivots together at most, as every task gets them; rows of a block on average.
PIVOT_BYTES, BLOCK = 32 << 20, 1024


def quantized(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as 64-bit integers, of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return df.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T; by floating point where no sum can leave its exact range."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def matrix(vectors: list[list[int]], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by falling score, then rising id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def pivot_count(n: int, dim: int) -> int:
    return max(1, min(math.isqrt(n) + 1, PIVOT_BYTES // (8 * max(1, dim))))


def in_blocks(sizes: list[int], block: int) -> list[tuple[int, int]]:
    """(first block, blocks) of each group: neighbours that are small together share one."""
    out, at, held = [], 0, 0
    for n in sizes:
        if n > block or held + n > block:
            at, held = at + (held > 0), 0
        many = -(-n // block)
        out.append((at, many))
        at, held = (at + many, 0) if many > 1 else (at, held + n)
    return out


def group_bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each query and group a number that no score in the group is above."""
    norm, dots = np.sqrt((q * q).sum(1))[:, None], q @ centres.T
    apart = np.sqrt(np.maximum(norm**2 - 2 * dots + (centres * centres).sum(1), 0))
    bound = np.minimum(dots + norm * radius, norm * longest)
    bound = np.minimum(bound, (norm**2 + longest**2 - np.maximum(0, apart - radius) ** 2) / 2)
    # rounding of squares that are subtracted
    return bound + 1 + 1e-9 * (norm**2 + longest**2)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from two frames of (vec_id, v array<long>)."""
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = materialize(data, "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_count(n, dim)).collect()
    pivot_ids, pivots = np.array([r["vec_id"] for r in chosen]), matrix([r["v"] for r in chosen], dim)
    centres = np.unique(pivots, axis=0).astype(np.float64)
    sent = spark.sparkContext.broadcast((pivot_ids, pivots, centres))

    def nearest(cols: dict[str, list]) -> dict[str, list]:
        x, c = matrix(cols["v"], dim).astype(np.float64), sent.value[2]
        square = (x * x).sum(1)
        g = (square[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        return {"vec_id": cols["vec_id"], "v": cols["v"], "g": g, "far": np.sqrt(((x - c[g]) ** 2).sum(1)), "norm": np.sqrt(square)}

    dealt = materialize(map_arrow(rows, nearest, "vec_id long, v array<long>, g int, far double, norm double"), "dealt")
    # a row a group, and there are no more groups than pivots
    groups = dealt.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).orderBy("g").collect()
    names, places = [r["g"] for r in groups], in_blocks([r["n"] for r in groups], BLOCK)
    summary = spark.sparkContext.broadcast((names, places, np.array([r["far"] for r in groups]), np.array([r["norm"] for r in groups])))

    def route(cols: dict[str, list]) -> dict[str, list]:
        (ids, pivot, c), (names, places, radius, longest) = sent.value, summary.value
        q = matrix(cols["v"], dim)
        own = products(q, pivot)
        bound = group_bounds(q.astype(np.float64), c[names], radius, longest)
        out: dict[str, list] = {n: [] for n in ("b", "kind", "g", "vec_id", "v", "least", "see")}
        for i, qid in enumerate(cols["vec_id"]):
            others = np.sort(own[i][ids != qid])
            least = int(others[-k]) if len(others) >= k else None
            seen: dict[int, list[int]] = {}
            for j in range(len(names)) if least is None else np.flatnonzero(bound[i] >= least).tolist():
                first, many = places[j]
                for b in range(first, first + many):
                    seen.setdefault(b, []).append(names[j])
            for b, see in seen.items():
                for name, value in zip(out, (b, 1, None, qid, cols["v"][i], least, see), strict=True):
                    out[name].append(value)
        return out

    layout = "b int, kind int, g int, vec_id long, v array<long>, least long, see array<int>"
    asked = map_arrow(queries.dropDuplicates(["vec_id"]), route, layout, rows=256)
    blocks = F.broadcast(spark.createDataFrame([(g, first, many) for g, (first, many) in zip(names, places, strict=True)], "g int, first int, many int"))
    own_block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")
    stored = dealt.join(blocks, "g").select(own_block.alias("b"), F.lit(0).alias("kind"), "g", "vec_id", "v", F.lit(None).cast("long").alias("least"), F.lit(None).cast("array<int>").alias("see"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            cols = batch.to_pydict()
            q_at: list[int] = []
            marks = cols["b"]
            for i in range(len(marks) + 1):
                if q_at and (i == len(marks) or marks[i] != block):
                    yield answer(cols, q_at, ready)
                    q_at = []
                if i == len(marks):
                    break
                if marks[i] != block:
                    block, held, ready = marks[i], [], None
                if cols["kind"][i] == 0:
                    held.append((cols["vec_id"][i], cols["g"][i], cols["v"][i]))
                else:
                    ready = ready or (np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), matrix([h[2] for h in held], dim))
                    q_at.append(i)

    def answer(cols: dict[str, list], at: list[int], ready: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        ids, group, x = ready
        here = len(np.unique(group))
        out: list[list[int]] = [[], [], []]
        for lo in range(0, len(at), 512):
            part = at[lo : lo + 512]
            scores = products(matrix([cols["v"][i] for i in part], dim), x)
            for row, i in zip(scores, part, strict=True):
                ok = ids != cols["vec_id"][i]
                if cols["least"][i] is not None:
                    ok &= row >= cols["least"][i]
                if len(cols["see"][i]) < here:
                    ok &= np.isin(group, cols["see"][i])
                can = np.flatnonzero(ok)
                for j in can[best(row[can], ids[can], k)]:
                    for o, value in zip(out, (cols["vec_id"][i], int(ids[j]), int(row[j])), strict=True):
                        o.append(value)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    both = stored.union(asked).repartition(shuffle_partitions(spark), "b").sortWithinPartitions("b", "kind")
    found = both.mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = quantized(read(spark, sf_dir, "embeddings"))
    return top_k(data, data.where("vec_id % 50 = 0"))
