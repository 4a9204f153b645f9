"""Helpers shared by the training-data operators: checkpoints, streaming groups, components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one where that is unset and all is one process (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="relweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows that a task writes at least, where a table's size is bounded and too small to fill all partitions.
ROWS = 100_000


def materialize(df: DataFrame, name: str, bound: int | None = None, rows: int = ROWS) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    bound: the most rows it can have. A small table is then written by fewer tasks, not as a tiny file from each
    partition; only for plans whose last stage does little work a row."""
    spark = df.sparkSession
    if bound is not None and (parts := max(1, -(-bound // rows))) < shuffle_partitions(spark):
        df = df.coalesce(parts)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_bound(wanted: float, n: int) -> int:
    """The signed 64-bit number that wanted of n hashes are below, in expectation; exact at any n."""
    share = int(wanted) / max(1, n) if wanted < n else 1.0
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def hash_below(hashed: Column, wanted: float, n: int) -> Column:
    """Whether a row of n is among about wanted ones, all if there are no more."""
    return F.lit(True) if wanted >= n else hashed < F.lit(hash_bound(wanted, n)).cast("long")


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, so tables are built once a worker and not once a task.

    A worker is used again by later stages: the tables of one owner go when another asks for its own, so that memory is
    that of the operator at work and not of all before it."""
    holder = sys.modules.setdefault("_relweave_worker", types.ModuleType("_relweave_worker")).__dict__
    if holder.get("owner") != owner:
        holder["owner"], holder["cache"] = owner, {}
    return holder["cache"]


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with column lists in and out, at most `rows` rows at a time so that whole texts fit in memory."""
    spark = df.sparkSession
    out_schema = pa.schema(arrow_fields(spark, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows).to_pydict())
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def arrow_fields(spark: SparkSession, ddl: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(ddl)))


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Groups of an input that is sorted by its keys; only one group is in memory."""
    current, held = None, None
    for batch in batches:
        cols = batch.to_pydict()
        names = list(cols)
        marks = list(zip(*(cols[k] for k in keys), strict=True))
        at = 0
        while at < len(marks):
            end = at + 1
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            if held is not None and marks[at] == current:
                for n in names:
                    held[n].extend(cols[n][at:end])
            else:
                if held is not None:
                    yield current, held
                current, held = marks[at], {n: cols[n][at:end] for n in names}
            at = end
    if held is not None:
        yield current, held


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, dict[str, list]], Iterator[dict[str, list]]], schema: str, sort: list[str] | None = None) -> DataFrame:
    """fn over each group of keys, with less overhead a group than applyInPandas.

    The caller bounds the groups (salts or blocks are part of the keys)."""
    n = shuffle_partitions(df.sparkSession)
    out_schema = pa.schema(arrow_fields(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in streamed_groups(batches, keys):
            for got in fn(key, group):
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(sort or [])).mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is the smallest node.

    Alternating large-star and small-star steps. Each step groups by a node and needs that node's smallest
    neighbour only, which is a partial aggregate; that is a table of its own, so adaptive execution can split the
    join back and a hub does not land in one task. Lineage is cut after each round by a written table. A round never
    has more edges than there were at first, so their count bounds the files of each table: a small graph does
    not become thousands of tiny files; most bounds the edges given, if known. Nulls and loops are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges", most)
    bound = e.count()
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m")), "low", 2 * bound)
        # large star: every larger neighbour of a node points at the node's smallest neighbour
        e = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(e.where("a <> b").distinct(), "edges", bound)
        # small star: every smaller neighbour, and the node, point at the smallest
        low = materialize(e.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "low", bound)
        small = e.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = small.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        e = materialize(e, "edges", bound)
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
