"""The graph of foreign keys as DataFrames: neighbours, relationships, paths, star plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.sources.manifest import Manifest


def edges(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Declared foreign keys; every target must be declared and have a primary key."""
    for source, key in manifest.foreign_keys():
        if key.target_table not in manifest.tables:
            raise ValueError(f"{source}.{key.column} points at undeclared table {key.target_table!r}")
        if key.target_column is None:
            raise ValueError(f"{source}.{key.column} points at {key.target_table!r}, which has no primary key")
    return manifest.fks_df(spark)


def reverse(e: DataFrame) -> DataFrame:
    return e.select("ordinal", F.col("target_table").alias("source_table"), F.col("target_column").alias("source_column"), F.col("source_table").alias("target_table"), F.col("source_column").alias("target_column"))


def neighbors(e: DataFrame) -> DataFrame:
    """(table_name, neighbor, position): adjacent tables of each, in order of declaration, each once."""
    way = e.select("ordinal", F.col("source_table").alias("table_name"), F.col("target_table").alias("neighbor"))
    both = way.union(e.select("ordinal", "target_table", "source_table"))
    first = both.groupBy("table_name", "neighbor").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(W.partitionBy("table_name").orderBy("ordinal", "neighbor"))
    return first.select("table_name", "neighbor", place.alias("position"))


def relationships(e: DataFrame, a: str, b: str) -> DataFrame:
    """Foreign keys between two tables, either way, as declared."""
    return e.where(((F.col("source_table") == a) & (F.col("target_table") == b)) | ((F.col("source_table") == b) & (F.col("target_table") == a))).orderBy("ordinal")


def relationship(e: DataFrame, a: str, b: str):
    """The one foreign key between two tables, or None; several are an error."""
    found = relationships(e, a, b).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"several foreign keys join {a} and {b}")
    return found[0] if found else None


def paths(e: DataFrame, max_hops: int = 2) -> DataFrame:
    """(root, path, hops, turns): simple paths of 1..max_hops steps. Sorting by turns gives depth-first order."""
    step = neighbors(e).where("table_name <> neighbor")
    start = step.select("table_name").distinct().select(F.col("table_name").alias("root"), F.array("table_name").alias("path"), F.array().cast("array<int>").alias("turns"))
    level, out = start, None
    for _ in range(max(0, max_hops)):
        at = F.element_at("path", -1) == F.col("table_name")
        level = level.join(step, at & ~F.array_contains("path", F.col("neighbor")))
        level = level.select("root", F.array_append("path", F.col("neighbor")).alias("path"), F.array_append("turns", F.col("position")).alias("turns"))
        out = level if out is None else out.union(level)
    out = start.limit(0) if out is None else out
    return out.withColumn("hops", F.size("path") - 1)


def star_plan(manifest: Manifest) -> tuple[str, dict[str, list[str]]]:
    """(fact table, foreign-key columns by dimension) if the tables form a star."""
    sources = {s for s, _ in manifest.foreign_keys()}
    if len(sources) != 1:
        raise ValueError("a star has one table with foreign keys")
    (fact,) = sources
    links: dict[str, list[str]] = {}
    for _, key in manifest.foreign_keys():
        if key.target_table == fact:
            raise ValueError(f"{fact} refers to itself")
        links.setdefault(key.target_table, []).append(key.column)
    if missing := set(manifest.tables) - {fact} - set(links):
        raise ValueError(f"{fact} does not refer to {', '.join(sorted(missing))}")
    return fact, links


def describe_path(manifest: Manifest, path: list[str]) -> str:
    """A path with the foreign key of each step and its direction; each step needs exactly one."""
    out = [path[0]]
    for a, b in zip(path, path[1:], strict=False):
        found = [(s, k) for s, k in manifest.foreign_keys() if {s, k.target_table} == {a, b} and (s != k.target_table or a == b)]
        if len(found) != 1:
            raise ValueError(f"{a} and {b} are joined by {len(found)} foreign keys")
        s, k = found[0]
        near, arrow, far = ((s, k.column), "→", (b, k.target_column)) if s == a else ((a, k.target_column), "←", (s, k.column))
        out.append(f"--{near[0]}.{near[1]}{arrow}{far[0]}.{far[1]}-- {b}")
    return " ".join(out)
