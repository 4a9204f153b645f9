"""Signal candidates: columns and relationships that can be reached from a root table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.scalars import provenance, signal_id
from relweave.operators.graph import describe_path, edges, paths
from relweave.sources.dataset import RelationalDataset
from relweave.sources.manifest import Manifest


def structural_columns(dataset: RelationalDataset) -> DataFrame:
    """(table_name, column_name) of primary and foreign keys; time columns stay signals."""
    m = dataset.manifest
    rows = [(t.name, t.primary_key) for t in m.tables.values() if t.primary_key] + [(s, k.column) for s, k in m.foreign_keys()]
    return dataset.spark.createDataFrame(rows, "table_name string, column_name string").distinct()


def enumerate_candidates(dataset: RelationalDataset, source_tables: list[str] | None = None, max_hops: int = 2, include_relationships: bool = True, include_structural: bool = False) -> DataFrame:
    """(candidate_id, kind, root, path, hops, attribute_table, attribute_column), each id once."""
    if max_hops < 0:
        raise ValueError("max_hops is negative")
    names = dataset.table_names()
    roots = list(source_tables or names)
    if unknown := set(roots) - set(names):
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
    spark = dataset.spark
    own = spark.createDataFrame([(r, [r], []) for r in roots], "root string, path array<string>, turns array<int>")
    every = own.union(paths(edges(spark, dataset.manifest), max_hops).where(F.col("root").isin(roots)).select("root", "path", "turns"))
    columns = dataset.columns_df()
    if not include_structural:
        columns = columns.join(F.broadcast(structural_columns(dataset)), ["table_name", "column_name"], "left_anti")
    none = F.lit(None).cast("string")
    found = every.join(columns, F.element_at("path", -1) == F.col("table_name")).select(F.lit("attribute").alias("kind"), "root", "path", "turns", F.col("table_name").alias("attribute_table"), F.col("column_name").alias("attribute_column"), F.col("ordinal").alias("place"))
    if include_relationships:
        found = found.union(every.where(F.size("path") > 1).select(F.lit("relationship"), "root", "path", "turns", none, none, F.lit(-1)))
    found = found.withColumn("candidate_id", signal_id(F.col("kind"), F.col("root"), F.col("path"), F.col("attribute_table"), F.col("attribute_column")))
    first = F.row_number().over(W.partitionBy("candidate_id").orderBy("turns", "place"))
    return found.withColumn("n", first).where("n = 1").select("candidate_id", "kind", "root", "path", (F.size("path") - 1).alias("hops"), "attribute_table", "attribute_column", "turns", "place")


def describe(manifest: Manifest, kind: str, path: list[str], table: str | None = None, column: str | None = None) -> str:
    where = describe_path(manifest, path)
    return f"Attribute {table}.{column}; path: {where}." if kind == "attribute" else f"Relationship path: {where}."


def provenance_of() -> Column:
    """What a candidate of a frame of candidates rests on."""
    return provenance(F.col("kind"), F.col("path"), F.col("attribute_table"), F.col("attribute_column"))


def fingerprint(candidates: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids, one a line. Ids are few: one for each column that a schema can reach."""
    return candidates.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("candidate_id")), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def schema_text(candidates: DataFrame, manifest: Manifest, nothing: str = "(no candidate attributes)") -> str:
    """Tables with their attributes, and relationships, for a prompt."""
    got = candidates.where("kind = 'attribute'").groupBy("attribute_table").agg(F.array_join(F.array_sort(F.collect_set("attribute_column")), ", ").alias("names")).collect()
    names = {r["attribute_table"]: r["names"] for r in got}
    lines = ["Tables and attributes:", *(f"- {t}: {names.get(t) or nothing}" for t in manifest.tables), "Relationships:"]
    links = [f"- {s}.{k.column} references {k.target_table}.{k.target_column}" for s, k in manifest.foreign_keys()]
    return "\n".join(lines + (links or ["- none declared"]))
