"""Agreement of raters and methods. Judgments are (pair, model, grade); weights are (cond, cand, method, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = (0, 1, 2, 3)


def model_pairs(judgments: DataFrame) -> DataFrame:
    """(model_a, model_b, pair, ga, gb) for every two raters of a pair."""
    a = judgments.select("pair", F.col("model").alias("model_a"), F.col("grade").alias("ga"))
    b = judgments.select("pair", F.col("model").alias("model_b"), F.col("grade").alias("gb"))
    return a.join(b, "pair").where("model_a < model_b")


def kappa(pairs: DataFrame, power: int = 1) -> DataFrame:
    """(model_a, model_b, n, kappa): weighted by (|a - b| / 3) ** power; null where chance alone explains nothing.

    Only the 16 cells of each table of grades are joined with its margins."""
    cells = pairs.groupBy("model_a", "model_b", "ga", "gb").agg(F.count("*").alias("c"))
    weight = F.pow(F.abs(F.col("ga") - F.col("gb")) / 3.0, power)
    rows = cells.groupBy("model_a", "model_b", "ga").agg(F.sum("c").alias("ca"))
    cols = cells.groupBy("model_a", "model_b", "gb").agg(F.sum("c").alias("cb"))
    observed = cells.groupBy("model_a", "model_b").agg(F.sum("c").alias("n"), F.sum(F.col("c") * weight).alias("o"))
    chance = rows.join(cols, ["model_a", "model_b"]).groupBy("model_a", "model_b").agg(F.sum(F.col("ca") * F.col("cb") * weight).alias("e"))
    e = F.col("e") / F.col("n")
    got = observed.join(chance, ["model_a", "model_b"])
    return got.select("model_a", "model_b", "n", F.when(e == 0, F.when(F.col("o") == 0, F.lit(1.0) if power == 1 else F.lit(None).cast("double"))).otherwise(1 - F.col("o") / e).alias("kappa"))


def pairwise(pairs: DataFrame) -> DataFrame:
    """(model_a, model_b, n, exact, binary, gap): equal grades, equal sides of 2, mean distance."""
    same = (F.col("ga") == F.col("gb")).cast("double")
    side = ((F.col("ga") >= 2) == (F.col("gb") >= 2)).cast("double")
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg(same).alias("exact"), F.avg(side).alias("binary"), F.avg(F.abs(F.col("ga") - F.col("gb"))).alias("gap"))


def peers(agreement: DataFrame, value: str) -> DataFrame:
    """(model, mean, place): mean over the pairs that a rater is in, best first."""
    both = agreement.select(F.col("model_a").alias("model"), value).union(agreement.select("model_b", value))
    got = both.groupBy("model").agg(F.avg(value).alias("mean"))
    return got.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean"), "model")))


def widest_gaps(judgments: DataFrame, gap: int = 3) -> DataFrame:
    """Pairs whose raters are `gap` grades apart."""
    got = judgments.groupBy("pair").agg(F.count("*").alias("n"), F.min("grade").alias("low"), F.max("grade").alias("high"))
    return got.where((F.col("n") >= 2) & (F.col("high") - F.col("low") == gap))


def consensus(judgments: DataFrame) -> DataFrame:
    """(pair, n, grade, how, support): a strict majority, else the one grade with the least total distance, else none."""
    votes = judgments.groupBy("pair", "grade").agg(F.count("*").alias("v"))
    place = F.struct(F.col("v"), F.col("grade"))
    top = votes.groupBy("pair").agg(F.sum("v").alias("n"), F.max("v").alias("most"), F.max_by("grade", place).alias("mode"), F.collect_list(F.struct("grade", "v")).alias("votes"))
    distance = lambda g: F.aggregate("votes", F.lit(0).cast("long"), lambda a, x: a + x["v"] * F.abs(x["grade"] - g))
    far = top.withColumn("far", F.array(*(distance(F.lit(g)) for g in GRADES)))
    far = far.withColumn("least", F.array_min("far")).withColumn("ties", F.size(F.filter("far", lambda x: x == F.col("least"))))
    strict, ordinal = F.col("most") * 2 > F.col("n"), F.col("ties") == 1
    grade = F.when(strict, F.col("mode")).when(ordinal, (F.array_position("far", F.col("least")) - 1).cast("int"))
    how = F.when(strict, "majority").when(ordinal, "ordinal").otherwise("unresolved")
    out = far.select("pair", "n", "votes", grade.cast("int").alias("grade"), how.alias("how"))
    support = F.aggregate("votes", F.lit(0).cast("long"), lambda a, x: a + F.when(x["grade"] == F.col("grade"), x["v"]).otherwise(F.lit(0).cast("long")))
    return out.withColumn("support", support).drop("votes")


def against_consensus(judgments: DataFrame, agreed: DataFrame) -> DataFrame:
    """(model, n, exact, gap) of each rater against the resolved grades."""
    both = judgments.join(agreed.where("grade is not null").select("pair", F.col("grade").alias("c")), "pair")
    return both.groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("grade") == F.col("c")).cast("double")).alias("exact"), F.avg(F.abs(F.col("grade") - F.col("c"))).alias("gap"))


def normalized(weights: DataFrame) -> DataFrame:
    """Weights clipped at 0 and divided by their sum within condition and method."""
    w = F.greatest(F.col("w"), F.lit(0.0))
    return weights.withColumn("p", w / F.sum(w).over(W.partitionBy("cond", "method")))


def softmax(scores: DataFrame) -> DataFrame:
    """p from logits w within condition and method, shifted by the largest."""
    group = W.partitionBy("cond", "method")
    e = F.exp(F.col("w") - F.max("w").over(group))
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(group)).drop("e")


def divergence(weights: DataFrame, a: str, b: str) -> DataFrame:
    """(cond, jsd, shared_mass, n): base-2 Jensen-Shannon divergence and common mass over shared candidates."""
    one = lambda m, p: weights.where(F.col("method") == m).select("cond", "cand", F.col("w").alias(p))
    both, group = one(a, "p").join(one(b, "q"), ["cond", "cand"]), W.partitionBy("cond")
    both = both.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in "pq"}).withColumns({c: F.col(c) / F.sum(c).over(group) for c in "pq"})
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, 0.5 * F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.groupBy("cond").agg(F.sum(part("p") + part("q")).alias("jsd"), F.sum(F.least("p", "q")).alias("shared_mass"), F.count("*").alias("n"))


def rerank(weights: DataFrame) -> DataFrame:
    return weights.withColumn("rank", F.row_number().over(W.partitionBy("cond", "method").orderBy(F.desc("w"), "cand")))


def spearman(weights: DataFrame, a: str, b: str) -> DataFrame:
    """(cond, n, rho) over shared candidates, ranked anew on each side; null for fewer than two."""
    one = lambda m, p: weights.where(F.col("method") == m).select("cond", "cand", F.col("w").alias(p))
    both = one(a, "wa").join(one(b, "wb"), ["cond", "cand"])
    both = both.withColumns({f"r{s}": F.row_number().over(W.partitionBy("cond").orderBy(F.desc(f"w{s}"), "cand")) for s in "ab"})
    got = both.groupBy("cond").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("ra") - F.col("rb"), 2)).alias("d"))
    n = F.col("n").cast("double")
    return got.select("cond", "n", F.when(n > 1, 1 - 6 * F.col("d") / (n * (n * n - 1))).alias("rho"))


def topk_overlap(weights: DataFrame, a: str, b: str, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(cond, k, overlap): common candidates of two top k, over min(k, both sizes)."""
    r = rerank(weights)
    sizes = r.groupBy("cond").agg(*(F.sum((F.col("method") == m).cast("long")).alias(n) for m, n in ((a, "na"), (b, "nb"))))
    one = lambda m, p: r.where(F.col("method") == m).select("cond", "cand", F.col("rank").alias(p))
    both = one(a, "ra").where(F.col("ra") <= max(ks)).join(one(b, "rb").where(F.col("rb") <= max(ks)), ["cond", "cand"])
    hits = both.groupBy("cond").agg(*(F.sum(((F.col("ra") <= k) & (F.col("rb") <= k)).cast("long")).alias(f"k{k}") for k in ks))
    got = sizes.where("na > 0 and nb > 0").join(hits, "cond", "left").unpivot(["cond", "na", "nb"], [f"k{k}" for k in ks], "k", "hits")
    k = F.substring("k", 2, 9).cast("int")
    return got.select("cond", k.alias("k"), (F.coalesce("hits", F.lit(0)) / F.least(k, "na", "nb")).alias("overlap"))


def full_comparison(weights: DataFrame, a: str, b: str) -> DataFrame:
    """(cond, cand, rank_a, rank_b) over the candidates of either method; null where absent."""
    r = rerank(weights)
    one = lambda m, p: r.where(F.col("method") == m).select("cond", "cand", F.col("rank").alias(p))
    return one(a, "rank_a").join(one(b, "rank_b"), ["cond", "cand"], "full")


def top_p(weights: DataFrame, p: float) -> DataFrame:
    """The shortest prefix of each distribution that reaches mass p."""
    group = W.partitionBy("cond", "method").orderBy(F.desc("p"), "cand")
    before = F.coalesce(F.sum("p").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return normalized(weights).withColumn("before", before).where(F.col("before") < p)


def paired_delta(metric: DataFrame, value: str, a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """Mean of b - a over tasks that both methods have, and how many improved, stayed and fell; rows (task, method, value)."""
    one = lambda m, v: metric.where(F.col("method") == m).select("task", F.col(value).alias(v))
    d = F.col("vb") - F.col("va")
    both = one(a, "va").join(one(b, "vb"), "task").where("va is not null and vb is not null").withColumn("d", d)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), n(F.col("d") > eps).alias("improved"), n(F.abs("d") <= eps).alias("unchanged"), n(F.col("d") < -eps).alias("regressed"))
