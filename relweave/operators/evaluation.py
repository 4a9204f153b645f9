"""Controlled tasks, judging with retries, evaluation of result files, root choices and overviews."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators import labels as L
from relweave.operators import metrics as M
from relweave.operators.candidates import fingerprint

TASK_FIELDS = ("id", "condition", "source_table", "reasoning_type", "oracle_rationale")


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Controlled tasks of a JSONL file: text fields that are not empty, and grades 0..3 by candidate."""
    rows = []
    for n, value in enumerate(L.read_lines(path), 1):
        texts = [str(value.get(f) or "").strip() for f in TASK_FIELDS]
        grades = value.get("signal_grades")
        if not all(texts) or not isinstance(grades, dict) or not grades:
            raise ValueError(f"{path}:{n}: {', '.join(TASK_FIELDS)} and signal_grades have to be there")
        grades = {str(k): int(v) for k, v in grades.items()}
        if not set(grades.values()) <= {0, 1, 2, 3}:
            raise ValueError(f"{path}:{n}: grades have to be 0 to 3")
        rows.append((*texts, grades))
    if not rows:
        raise ValueError(f"{path}: no tasks")
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in TASK_FIELDS) + ", signal_grades map<string,int>")


def require_current(metadata: dict, version: str, candidates: DataFrame, tasks: DataFrame) -> None:
    """Error if a benchmark's version, candidates or tasks are not those it was built with."""
    if metadata.get("benchmark_version") != version:
        raise ValueError(f"benchmark version is {metadata.get('benchmark_version')!r}, not {version}")
    now = fingerprint(candidates).first()
    if metadata.get("candidate_id_sha256") not in tuple(now):
        raise ValueError("the candidates have changed; build the benchmark again")
    ids = candidates.select(F.col("candidate_id").alias("cand"))
    graded = tasks.select("id", F.explode("signal_grades").alias("cand", "grade"))
    unknown = graded.join(ids, "cand", "left_anti").select("id")
    # few tasks with a grade for each of a few candidates
    missing = tasks.select("id").crossJoin(ids).join(graded, ["id", "cand"], "left_anti").select("id")
    central = graded.groupBy("id").agg(F.max("grade").alias("top")).where("top < 3").select("id")
    if bad := unknown.union(missing).union(central).first():
        raise ValueError(f"task {bad['id']!r} does not match the candidates, or has no grade 3")


def judge(tasks: DataFrame, respond: Callable[[list[str]], list[str]], path: str, key: list[str], attempts: int = 2) -> DataFrame:
    """Judgments of tasks (key, prompt): status, grade, reason, parse_error and attempt for each key.

    respond answers a batch of prompts. Answers that cannot be read are asked for again, up to `attempts` times. Each
    pass is written below path before the next, so a finished pass is not asked again; a task lost inside a pass is.
    """
    spark = tasks.sparkSession
    layout = ", ".join(f"{k} {tasks.schema[k].dataType.simpleString()}" for k in key)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[key].assign(raw=respond(b["prompt"].tolist()))

    left, out = tasks.select(*key, "prompt"), None
    for n in range(1, attempts + 1):
        answered = L.parse_judgment(left.mapInPandas(ask, f"{layout}, raw string")).withColumn("attempt", F.lit(n))
        answered.write.mode("overwrite").parquet(f"{path}/pass-{n}")
        got = spark.read.schema(answered.schema).parquet(f"{path}/pass-{n}")
        out = got if out is None else L.upsert(out, got, key)
        invalid = got.where("status = 'invalid_response'").select(*key)
        if invalid.isEmpty():
            break
        left = left.join(invalid, key, "left_semi")
    return out


def evaluate_results(results: DataFrame, judgments: DataFrame, allow_incomplete: bool = False, cutoffs: tuple[int, ...] = M.CUTOFFS, least: int = 2) -> DataFrame:
    """(cond, k, coverage, ndcg, recall, precision, mrr) of results (cond, signals: ranked candidates).

    Conditions without a graded judgment are left out. Those that are judged in part are an error, unless that is
    allowed; then candidates without a grade are taken out of the ranking.
    """
    covered = M.coverage(judgments).where("judged > 0").join(results.select("cond"), "cond", "left_semi")
    if not allow_incomplete and (bad := covered.where("coverage < 1").first()):
        raise ValueError(f"{bad['cond']!r} is judged to {bad['coverage']:.1%} only")
    qrels = judgments.where("status = 'judged' and grade between 0 and 3").select("cond", "cand", "grade").join(covered, "cond", "left_semi")
    ranking = results.join(covered, "cond", "left_semi").select("cond", F.posexplode("signals").alias("pos", "cand")).select("cond", "cand", (F.col("pos") + 1).alias("rank"))
    if allow_incomplete:
        ranking = M.condensed(ranking, qrels)
    out = M.ndcg(ranking, qrels, cutoffs).join(covered.select("cond", "coverage"), "cond")
    for metric in (M.recall(ranking, qrels, cutoffs, least), M.precision(ranking, qrels, cutoffs, least)):
        out = out.join(metric, ["cond", "k"], "left")
    return out.join(M.mrr(ranking, qrels), "cond", "left").na.fill(0.0, ["recall", "precision", "mrr"]).select("cond", "k", "coverage", "ndcg", "recall", "precision", "mrr")


def root_selection(tasks: DataFrame) -> DataFrame:
    """tasks (task, expected, explored: tables expanded at the root, the first choice first) with choice, correct and explored_correct."""
    choice = F.try_element_at("explored", F.lit(1))
    is_in = F.coalesce(F.array_contains("explored", F.col("expected")), F.lit(False))
    return tasks.withColumns({"choice": choice, "correct": F.coalesce(choice == F.col("expected"), F.lit(False)), "explored_correct": is_in})


def root_rates(chosen: DataFrame) -> DataFrame:
    """(n, correct, accuracy, explored_correct, hit_rate); rates are 0 without tasks."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    got = chosen.agg(F.count("*").alias("n"), n("correct").alias("correct"), n("explored_correct").alias("explored_correct"))
    rate = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(F.col(c) / F.col("n"))
    return got.select("n", "correct", rate("correct").alias("accuracy"), "explored_correct", rate("explored_correct").alias("hit_rate"))


def condition_overview(weights: DataFrame, methods: list[str]) -> DataFrame:
    """The best candidate of each method, a column each, by condition; of equal weights the largest candidate."""
    best = weights.groupBy("cond", "method").agg(F.max_by("cand", F.struct("w", "cand")).alias("cand"))
    return best.groupBy("cond").pivot("method", methods).agg(F.first("cand"))


def top_signals(scores: DataFrame, k: int = 5) -> DataFrame:
    """(cond, rank, cand, score): the k best of each condition."""
    return M.ranked(scores).where(F.col("rank") <= k).select("cond", "rank", "cand", "score")


def heatmap(metric: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """The mean of value for each row, by column."""
    return metric.groupBy(row).pivot(column, columns).agg(F.avg(value))


def tree_links(steps: DataFrame) -> DataFrame:
    """(task, branch, parent, action) of the search tree; steps are (task, branch, parent, history), the root's parent is null.

    A branch whose parent took no step hangs below the root."""
    known = steps.select("task", F.col("branch").alias("parent"), F.lit(True).alias("known"))
    got = steps.join(known, ["task", "parent"], "left")
    return got.select("task", "branch", F.when(F.col("known"), F.col("parent")).alias("parent"), F.try_element_at("history", F.lit(-1)).alias("action"))
