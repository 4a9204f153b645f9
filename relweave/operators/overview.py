"""Tables behind overviews and plots of results, judgments and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.operators import agreement, metrics


def share_table(df: DataFrame, row: str, column: str, values: Sequence, prefix: str = "") -> DataFrame:
    """A row for each value of row: how many there are of each value of column, in all, and what percentage each is."""
    n = lambda v: F.sum((F.col(column) == F.lit(v)).cast("long"))
    got = df.groupBy(row).agg(*(F.coalesce(n(v), F.lit(0)).alias(f"{prefix}{v}") for v in values), F.count("*").alias("total"))
    return got.withColumns({f"pct_{prefix}{v}": 100 * F.col(f"{prefix}{v}") / F.col("total") for v in values})


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def wide(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """The value of each row by column, of several the first in order, null where there is none."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.min(value))


def common_macro_mean(rows: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """(by, metric, mean, n) of the metrics that every row of a group has; rows hold a map from metric to value."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    each = rows.select(by, F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull() & F.col("metric").isin(*names))
    got = each.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("known"))
    return got.join(n, by).where("known = n").select(by, "metric", "mean", "n")


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """How many different values a group has, their mean and sample standard deviation; nulls are left out."""
    return df.groupBy(by).agg(F.count_distinct(value).alias("n_distinct"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def returned_range(results: DataFrame) -> DataFrame:
    """(method, conditions, least, most): how many signals a method returns; results are (method, cond, signals)."""
    n = F.size("signals")
    return results.groupBy("method").agg(F.count("*").alias("conditions"), F.min(n).alias("least"), F.max(n).alias("most"))


def task_summary(tasks: DataFrame) -> DataFrame:
    """(n_tasks, reasoning_types): different tasks, and their kinds in order."""
    return tasks.agg(F.count_distinct("id").alias("n_tasks"), F.array_join(F.array_sort(F.collect_set("reasoning_type")), ",").alias("reasoning_types"))


def shared_conditions(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Conditions that every one of the methods has."""
    got = results.where(F.col("method").isin(*methods)).select("cond", "method").distinct().groupBy("cond").agg(F.count("*").alias("n"))
    return got.where(F.col("n") == len(set(methods))).select("cond")


def last_by_method(rows: DataFrame, order: Sequence[str], position: str) -> DataFrame:
    """The last row of each method with place, the method's place in order; methods that order does not name come last."""
    n = F.row_number().over(W.partitionBy("method").orderBy(F.desc(position)))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    last = rows.withColumn("__n", n).where("__n = 1").drop("__n")
    return last.withColumn("place", F.when(place > 0, place.cast("int"))).orderBy(F.asc_nulls_last("place"), "method")


def top_by_probability(weights: DataFrame) -> DataFrame:
    """(cond, method, cand) of the largest weight; of equal ones the largest candidate."""
    return weights.groupBy("cond", "method").agg(F.max_by("cand", F.struct("w", "cand")).alias("cand"))


def top_by_score(scores: DataFrame) -> DataFrame:
    """(cond, method, cand) of the largest score; of equal ones the first by place."""
    return scores.groupBy("cond", "method").agg(F.max_by("cand", F.struct(F.col("w"), -F.col("place"))).alias("cand"))


def condition_overview(top: DataFrame, conditions: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The intent of each condition and the best candidate of each method, a column each."""
    best = top.groupBy("cond").pivot("method", list(methods)).agg(F.first("cand"))
    return conditions.select("cond", "intent").join(best, "cond")


def has_full_distribution(results: DataFrame, guided: str = "graph") -> DataFrame:
    """results (method, n_probabilities, n_signals, candidate_count) with is_full: no guided search, and a weight for every candidate."""
    known = (F.col("n_probabilities") > 0) | (F.col("n_signals") >= F.coalesce("candidate_count", "n_signals"))
    return results.withColumn("is_full", ~F.coalesce(F.col("method").contains(guided), F.lit(False)) & known)


def candidate_weights(rows: DataFrame) -> DataFrame:
    """rows (cond, method, cand, probability, logit, score) with p: probabilities cut at 0 and normalised, else a softmax.

    A method with any probability in a condition uses these. Otherwise a logit is used, or that of the clipped score.
    A group without mass has null weights."""
    group = W.partitionBy("cond", "method")
    by_p = F.max(F.col("probability").isNotNull().cast("int")).over(group) == 1
    clipped = F.greatest(F.lit(1e-12), F.least(F.coalesce("score", F.lit(0.0)), F.lit(1 - 1e-12)))
    logit = F.coalesce("logit", F.log(clipped) - F.log1p(-clipped))
    rows = rows.withColumns({"__by": by_p, "__logit": logit})
    rows = rows.withColumn("__m", F.when(F.col("__by"), F.greatest(F.coalesce("probability", F.lit(0.0)), F.lit(0.0))).otherwise(F.exp(F.col("__logit") - F.max("__logit").over(group))))
    total = F.sum("__m").over(group)
    return rows.withColumn("p", F.when(total > 0, F.col("__m") / total)).drop("__by", "__logit", "__m")


def all_pairs(weights: DataFrame) -> DataFrame:
    """(cond, method_a, method_b, n, rho, jsd, shared_mass) for every two methods, over the candidates that both have.

    Weights hold the candidates of a condition for each method, so a condition's rows meet only those of its own."""
    a = weights.select("cond", "cand", F.col("method").alias("method_a"), F.col("w").alias("wa"))
    b = weights.select("cond", "cand", F.col("method").alias("method_b"), F.col("w").alias("wb"))
    both = a.join(b, ["cond", "cand"]).where("method_a < method_b")
    keys = ["cond", "method_a", "method_b"]
    group = W.partitionBy(*keys)
    both = both.withColumns({f"r{s}": F.row_number().over(group.orderBy(F.desc(f"w{s}"), "cand")) for s in "ab"})
    both = both.withColumns({f"p{s}": F.greatest(f"w{s}", F.lit(0.0)) for s in "ab"}).withColumns({f"p{s}": F.col(f"p{s}") / F.sum(f"p{s}").over(group) for s in "ab"})
    m = (F.col("pa") + F.col("pb")) / 2
    part = lambda c: F.when(F.col(c) > 0, 0.5 * F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    got = both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("ra") - F.col("rb"), 2)).alias("d"), F.sum(part("pa") + part("pb")).alias("jsd"), F.sum(F.least("pa", "pb")).alias("shared_mass"))
    n = F.col("n").cast("double")
    return got.select(*keys, "n", F.when(n > 1, 1 - 6 * F.col("d") / (n * (n * n - 1))).alias("rho"), "jsd", "shared_mass")


def pair_summary(pairs: DataFrame, value: str) -> DataFrame:
    """(method_a, method_b, n, mean, sd) of a value over conditions, nulls left out."""
    return pairs.groupBy("method_a", "method_b").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def nulls_last(compared: DataFrame) -> DataFrame:
    """A full comparison (cond, cand, rank_a, rank_b) with place: by the first rank, then the second, absent ones last."""
    order = W.partitionBy("cond").orderBy(F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"), "cand")
    return compared.withColumn("place", F.row_number().over(order))


def consensus_histograms(agreed: DataFrame) -> DataFrame:
    """(how, grade, support, n) of agreement.consensus: how pairs were settled, on which grade, by how many votes."""
    return agreed.groupBy("how", "grade", "support").agg(F.count("*").alias("n"))


def unresolved_concentration(judgments: DataFrame) -> DataFrame:
    """(most, n): pairs without a consensus by the most votes that any grade has."""
    open_ = agreement.consensus(judgments).where("grade is null").select("pair")
    votes = judgments.join(open_, "pair", "left_semi").groupBy("pair", "grade").agg(F.count("*").alias("v"))
    return votes.groupBy("pair").agg(F.max("v").alias("most")).groupBy("most").agg(F.count("*").alias("n"))


def search_overview(searches: DataFrame) -> DataFrame:
    """(task, calls, n_signals, stop_reason, can_traverse) of searches (task, calls, signals, stop_reason, trace).

    can_traverse counts decisions at which a step to another table was legal."""
    able = F.filter("trace", lambda s: F.exists(s["legal"], lambda a: a["kind"] == "traverse"))
    return searches.select("task", "calls", F.size("signals").alias("n_signals"), "stop_reason", F.size(able).alias("can_traverse"))


def chosen_kinds(searches: DataFrame) -> DataFrame:
    """(kind, n) of the actions that were chosen."""
    step = searches.select(F.explode("trace").alias("s"))
    picked = step.select(F.filter("s.legal", lambda a: a["option"] == F.col("s.choice")).alias("a")).where(F.size("a") > 0)
    return picked.groupBy(F.col("a")[0]["kind"].alias("kind")).agg(F.count("*").alias("n"))


def browse(ranked: DataFrame, score: Column, probability: Column) -> DataFrame:
    """Ranked rows (cond, rank, cand, kind, path, attribute_table, attribute_column) with a label and the score, or else the probability."""
    label = F.when(F.col("kind") == "attribute", F.concat("attribute_table", F.lit("."), "attribute_column")).otherwise("relationship")
    return ranked.select("cond", "rank", "cand", "kind", label.alias("signal"), F.concat_ws(" → ", "path").alias("path"), F.coalesce(score, probability).alias("value"))


def dual_metrics(ranking: DataFrame, labels: DataFrame, keys: DataFrame, cutoffs: Sequence[int] = (1, 3, 5), least: int = 3) -> DataFrame:
    """(cond, k, exact_ndcg, exact_recall, exact_mrr, soft_ndcg, soft_recall, soft_mrr): by candidate, and by what candidates rest on."""
    out = None
    soft_rows, soft_labels = metrics.soft(ranking, labels, keys)
    for name, rows, known in (("exact", ranking, labels), ("soft", soft_rows, soft_labels)):
        one = metrics.ndcg(rows, known, tuple(cutoffs)).join(metrics.recall(rows, known, tuple(cutoffs), least), ["cond", "k"], "left").join(metrics.mrr(rows, known, least), "cond", "left")
        one = one.select("cond", "k", *(F.coalesce(c, F.lit(0.0)).alias(f"{name}_{c}") for c in ("ndcg", "recall", "mrr")))
        out = one if out is None else out.join(one, ["cond", "k"])
    return out


def macro_dual_metrics(top: DataFrame, labels: DataFrame, keys: DataFrame, cutoffs: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Dual metrics of saved top signals (scorer, cond, cand, rank), averaged over conditions for each scorer and cut-off."""
    tagged = top.withColumn("cond", F.struct("scorer", "cond"))
    of_scorer = top.select("scorer", "cond").distinct().join(labels, "cond").select(F.struct("scorer", "cond").alias("cond"), "cand", "grade")
    got = dual_metrics(tagged.select("cond", "cand", "rank"), of_scorer, keys, cutoffs)
    names = [c for c in got.columns if c not in ("cond", "k")]
    return got.groupBy(F.col("cond.scorer").alias("scorer"), "k").agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("n"))
