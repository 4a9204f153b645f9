"""Checks and statistics of a star of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.scalars import jaccard


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.union, one)


def key_uniqueness(df: DataFrame, table: str, key: str) -> DataFrame:
    """Non-null, distinct and surplus values of a key; nulls are no duplicates."""
    got = df.agg(F.count(key).alias("non_null"), F.count_distinct(key).alias("n_distinct"))
    return got.select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"), "non_null", "n_distinct", (F.col("non_null") - F.col("n_distinct")).alias("duplicates"))


def dangling_rows(fact: DataFrame, column: str, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose non-null foreign key has no match."""
    return fact.where(F.col(column).isNotNull()).join(dim.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def rows_per_key(df: DataFrame, column: str) -> DataFrame:
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("n_min"), F.median("n").alias("n_median"), F.avg("n").alias("n_avg"), F.max("n").alias("n_max"))


def time_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("t_min"), F.max(column).alias("t_max"))


def entity_links(fact: DataFrame, entity: str, link: str) -> DataFrame:
    both = fact.select(F.col(entity).alias("entity"), F.col(link).alias("link"))
    return both.where("entity is not null and link is not null").distinct()


def bridging_links(links: DataFrame) -> DataFrame:
    """(link, n_entities) of links that join two entities or more."""
    return links.groupBy("link").agg(F.count("*").alias("n_entities")).where("n_entities >= 2")


def overlap_pairs(links: DataFrame, block: int = 1024) -> DataFrame:
    """(left_entity, right_entity, shared). Links of a single entity are dropped before the self join.

    The entities of a link are dealt into blocks by hash, about block in each, and a join task meets two blocks of a
    link; so a link that most entities have is spread over many tasks. Pairs are counted in part before the shuffle."""
    useful = links.join(bridging_links(links), "link")
    blocks = F.ceil(F.col("n_entities") / block).cast("int")
    own = useful.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = own.select("link", F.col("entity").alias("left_entity"), F.col("own").alias("x"), every.alias("y"))
    b = own.select("link", F.col("entity").alias("right_entity"), F.col("own").alias("y"), every.alias("x"))
    return a.join(b, ["link", "x", "y"]).where("left_entity < right_entity").groupBy("left_entity", "right_entity").agg(F.count("*").alias("shared"))


def median_of_counts(counts: DataFrame, value: str, name: str) -> DataFrame:
    """One row, the median of values that occur n times each; null without any. Different values are sorted, not rows."""
    total = counts.agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.withColumn("upto", upto).crossJoin(total)
    middle = lambda at: F.min(F.when(F.col("upto") >= at, F.col(value)))
    return placed.agg(((middle(F.floor((F.col("total") + 1) / 2)) + middle(F.floor(F.col("total") / 2) + 1)) / 2).alias(name))


def overlap_summary(fact: DataFrame, entity: str, link: str) -> DataFrame:
    """One row: entities, connected ones, pairs, bridging links, shared links of a pair, median Jaccard, share of pairs.

    Pairs are reduced to how often each (shared, Jaccard) occurs; of those there are few."""
    links = entity_links(fact, entity, link)
    pairs, sizes = overlap_pairs(links), links.groupBy("entity").agg(F.count("*").alias("n"))
    left, right = sizes.select(F.col("entity").alias("left_entity"), F.col("n").alias("n_left")), sizes.select(F.col("entity").alias("right_entity"), F.col("n").alias("n_right"))
    known = pairs.join(left, "left_entity").join(right, "right_entity")
    kinds = known.groupBy("shared", (F.col("n_left") + F.col("n_right")).alias("both")).agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("j", jaccard(F.col("shared"), F.col("both"), F.lit(0)))
    stats = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), (F.sum(F.col("n") * F.col("shared")) / F.sum("n")).alias("shared_avg"), F.max("shared").alias("shared_max"))
    for value, name in (("shared", "shared_median"), ("j", "jaccard_median")):
        stats = stats.crossJoin(median_of_counts(kinds.groupBy(value).agg(F.sum("n").alias("n")), value, name))
    connected = pairs.select("left_entity").union(pairs.select("right_entity")).distinct().agg(F.count("*").alias("connected"))
    out = stats.crossJoin(connected).crossJoin(bridging_links(links).agg(F.count("*").alias("bridging"))).crossJoin(fact.agg(F.count_distinct(entity).alias("entities")))
    possible = F.col("entities") * (F.col("entities") - 1) / 2
    return out.withColumn("pair_fraction", F.when(possible > 0, F.col("pairs") / possible).otherwise(F.lit(0.0)))


def checks(tables: dict[str, DataFrame | None], fact: str, keys: dict[str, str], links: list[tuple[str, str]], most_rows: int) -> DataFrame:
    """(name, passed, detail) of a subset: tables there and not empty, fact rows bounded, keys unique, links closed.

    tables maps a missing table to None; checks that need it are left out. links are (fact column, dimension)."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    there = {n: df for n, df in tables.items() if df is not None}
    layout = "name string, passed boolean, detail string"
    out = [spark.createDataFrame([(f"table {n} exists", df is not None, "" if df is not None else n) for n, df in tables.items()], layout)]
    counts = row_counts(there)
    out.append(counts.select(F.concat(F.lit("table "), "table_name", F.lit(" is not empty")), F.col("n_rows") > 0, F.lit("")))
    if fact in there:
        bounded = counts.where(F.col("table_name") == fact)
        out.append(bounded.select(F.lit(f"{fact} has at most {most_rows:,} rows"), F.col("n_rows") <= most_rows, F.concat(F.format_number("n_rows", 0), F.lit(" rows"))))
    for n, key in keys.items():
        if n in there:
            one = key_uniqueness(there[n], n, key)
            out.append(one.select(F.lit(f"{n}.{key} is unique"), F.col("duplicates") == 0, F.when(F.col("duplicates") > 0, F.concat(F.format_number("duplicates", 0), F.lit(" duplicate values"))).otherwise("")))
    for column, dim in links:
        if fact in there and dim in there:
            lost = dangling_rows(there[fact], column, there[dim], keys[dim]).agg(F.count("*").alias("n"))
            out.append(lost.select(F.lit(f"{fact}.{column} -> {dim}.{keys[dim]}"), F.col("n") == 0, F.when(F.col("n") > 0, F.concat(F.format_number("n", 0), F.lit(" rows without a match"))).otherwise("")))
    return reduce(DataFrame.union, out)
