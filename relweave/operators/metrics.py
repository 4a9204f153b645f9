"""Ranking quality against graded labels. Rankings are (cond, cand, rank), labels (cond, cand, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.scalars import gain

CUTOFFS = (1, 3, 5, 10)


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """Ranks by falling score, then rising candidate."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("cond").orderBy(F.desc(score), F.asc("cand"))))


def graded(ranking: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranking with grades; unknown candidates count as 0."""
    return ranking.select("cond", "cand", "rank").join(labels.select("cond", "cand", "grade"), ["cond", "cand"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def condensed(ranking: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranking without unlabelled candidates, ranked anew."""
    kept = ranking.join(labels.select("cond", "cand"), ["cond", "cand"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("cond").orderBy("rank")))


def _at_cutoffs(rows: DataFrame, cutoffs: tuple[int, ...], aggregate) -> DataFrame:
    """One aggregation with a column for each cutoff, unpivoted; rows are read once."""
    got = rows.groupBy("cond").agg(*(aggregate(k).alias(f"k{k}") for k in cutoffs))
    return got.unpivot("cond", [f"k{k}" for k in cutoffs], "k", "v").select("cond", F.substring("k", 2, 9).cast("int").alias("k"), "v")


def dcg(rows: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    g = gain(F.col("grade"), F.col("rank"))
    return _at_cutoffs(rows, cutoffs, lambda k: F.sum(F.when(F.col("rank") <= k, g).otherwise(0.0)))


def ndcg(ranking: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(cond, k, ndcg); the ideal ranks all labels, so what was not found is a miss. 0 where the ideal is 0."""
    ideal = labels.withColumn("rank", F.row_number().over(W.partitionBy("cond").orderBy(F.desc("grade"))))
    best = dcg(ideal, cutoffs).withColumnRenamed("v", "ideal")
    got = dcg(graded(ranking, labels), cutoffs).withColumnRenamed("v", "own")
    return best.join(got, ["cond", "k"], "left").select("cond", "k", F.when(F.col("ideal") == 0, 0.0).otherwise(F.coalesce("own", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def recall(ranking: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, least: int = 3) -> DataFrame:
    """(cond, k, recall) of labels with a grade of at least least; 0 where there is none."""
    all_ = labels.groupBy("cond").agg(F.sum((F.col("grade") >= least).cast("long")).alias("n"))
    hits = _at_cutoffs(graded(ranking, labels), cutoffs, lambda k: F.sum(((F.col("rank") <= k) & (F.col("grade") >= least)).cast("long")))
    return hits.join(all_, "cond").select("cond", "k", F.when(F.col("n") == 0, 0.0).otherwise(F.col("v") / F.col("n")).alias("recall"))


def precision(ranking: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, least: int = 2) -> DataFrame:
    """(cond, k, precision) among the candidates that were returned up to k."""
    good = F.col("grade") >= least
    both = _at_cutoffs(graded(ranking, labels), cutoffs, lambda k: F.avg(F.when(F.col("rank") <= k, good.cast("double"))))
    return both.select("cond", "k", F.coalesce("v", F.lit(0.0)).alias("precision"))


def mrr(ranking: DataFrame, labels: DataFrame, least: int = 3, within: int | None = None) -> DataFrame:
    """(cond, mrr) of the first good candidate; 0 without one."""
    good = (F.col("grade") >= least) & (F.lit(True) if within is None else F.col("rank") <= within)
    return graded(ranking, labels).groupBy("cond").agg(F.coalesce(1 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def soft(ranking: DataFrame, labels: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranking and labels by provenance key (keys: cand, key): the best grade of a key, credited where it first appears.

    Later appearances keep their rank and get a key of their own that no label has."""
    of_key = labels.join(keys, "cand").groupBy("cond", "key").agg(F.max("grade").alias("grade")).withColumnRenamed("key", "cand")
    n = F.row_number().over(W.partitionBy("cond", "key").orderBy("rank"))
    rows = ranking.join(keys, "cand").withColumn("n", n)
    return rows.select("cond", F.when(F.col("n") == 1, F.col("key")).otherwise(F.concat("key", F.lit("#"), "n")).alias("cand"), "rank"), of_key


def macro_average(metric: DataFrame, value: str, by: list[str]) -> DataFrame:
    return metric.groupBy(*by).agg(F.avg(value).alias(f"avg_{value}"), F.count("*").alias("n_conditions"))


def coverage(judgments: DataFrame) -> DataFrame:
    """(cond, expected, judged, coverage) of rows (cond, cand, status, grade)."""
    ok = F.coalesce((F.col("status") == "judged") & F.col("grade").isin(0, 1, 2, 3), F.lit(False))
    got = judgments.groupBy("cond").agg(F.count("*").alias("expected"), F.sum(ok.cast("long")).alias("judged"))
    return got.withColumn("coverage", F.col("judged") / F.col("expected"))
