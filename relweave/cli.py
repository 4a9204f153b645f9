"""Command lines: python -m relweave.cli COMMAND. Exit status 0: done, 1: a check failed, 2: an error.

Models are no part of the engine: --scorer and --engine name a function as module:function.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators import annotation as H
from relweave.operators import candidates as C
from relweave.operators import evaluation as E
from relweave.operators import labels as L
from relweave.operators import metrics as M
from relweave.operators import overview as O
from relweave.operators import prompts as P
from relweave.operators import reports as R
from relweave.operators import sampling as S
from relweave.operators import search as N
from relweave.sources.dataset import RelationalDataset
from relweave.sources.manifest import load_manifest


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("relweave").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def named_function(name: str) -> Callable:
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name!r} is not module:function")
    return getattr(importlib.import_module(module), function)


def dataset(args: argparse.Namespace) -> RelationalDataset:
    return RelationalDataset(spark_session(), load_manifest(args.manifest or f"{args.root}/manifest.yaml"), args.root)


def scored(args: argparse.Namespace, pairs: DataFrame) -> DataFrame:
    """(cond, cand, score) by the scorer named, or by the seeded baseline."""
    return N.hash_scorer(pairs, args.seed) if args.scorer == "random" else N.score_with(pairs, named_function(args.scorer))


def described(d: RelationalDataset, hops: int) -> tuple[DataFrame, DataFrame]:
    """Candidates, and (cand, description) of each."""
    found = C.enumerate_candidates(d, max_hops=hops)
    rows = [(r["id"], r["description"]) for r in R.candidate_rows(found, d.manifest)]
    return found, d.spark.createDataFrame(rows, "cand string, description string")


def inspect_manifest(args: argparse.Namespace) -> int:
    manifest = load_manifest(args.path)
    print(json.dumps(R.manifest_document(manifest), indent=2, ensure_ascii=False) if args.json else R.manifest_text(manifest))
    return 0


def build_subset(args: argparse.Namespace) -> int:
    config = S.SubsetConfig(args.entity, args.link, args.entities, args.least, args.most, args.row_groups, args.seed, args.mode)
    for name, n in S.build_subset(dataset(args), config, args.output, args.manifest or f"{args.root}/manifest.yaml").items():
        print(f"{n:>12,} rows  {name}")
    return 0


def validate_subset(args: argparse.Namespace) -> int:
    report = R.subset_report(dataset(args), args.entities * args.most, args.entity, args.link, args.manifest or f"{args.root}/manifest.yaml")
    print(report.text())
    return report.exit_status


def discover(args: argparse.Namespace) -> int:
    d = dataset(args)
    conditions = L.load_conditions(d.spark, args.conditions, unique=False)
    found, texts = described(d, args.hop_limit)
    if args.method == "rank":
        pairs = conditions.select(F.col("id").alias("cond"), "condition").crossJoin(texts)
        rows = M.ranked(scored(args, pairs)).orderBy("cond", "rank").collect()
    else:
        navigator = N.Navigator(named_function(args.scorer), args.hop_limit, args.max_decisions, args.branch_width, args.max_signals)
        asked = conditions.select(F.col("id").alias("task"), F.col("condition").alias("intent"))
        rows = N.search_all(asked, N.signals_of(found), d.manifest, navigator).orderBy("task").collect()
    R.print_lines([r.asDict(recursive=True) for r in rows], args.output)
    return 0


def build_benchmark(args: argparse.Namespace) -> int:
    d = dataset(args)
    rows = [(*(str(r.get(f) or "") for f in E.TASK_FIELDS), {str(k): int(v) for k, v in r["grades"].items()}) for r in L.read_lines(args.specs)]
    specs = d.spark.createDataFrame(rows, ", ".join(f"{f} string" for f in E.TASK_FIELDS) + ", grades map<string,int>")
    made = R.build_benchmark(d, specs, args.output, args.version, S.schema_only)
    print(f"{made['task_count']} tasks over {made['candidate_count']} candidates in {args.output}")
    return 0


def evaluate_controlled(args: argparse.Namespace) -> int:
    d = dataset(args)
    tasks = E.load_tasks(d.spark, f"{args.benchmark}/tasks.jsonl")
    found, texts = described(d, 2)
    E.require_current(R.read_document(f"{args.benchmark}/benchmark.json"), args.version, found, tasks)
    qrels = tasks.select(F.col("id").alias("cond"), F.explode("signal_grades").alias("cand", "grade"))
    ranking = M.ranked(scored(args, tasks.select(F.col("id").alias("cond"), "condition").crossJoin(texts)))
    keys = found.select(F.col("candidate_id").alias("cand"), C.provenance_of().alias("key"))
    each = O.dual_metrics(ranking, qrels, keys).orderBy("cond", "k").collect()
    names = [n for n in each[0].__fields__ if n not in ("cond", "k")]
    summary = {f"{n}@{k}": sum(r[n] for r in each if r["k"] == k) / len({r["cond"] for r in each}) for n in names for k in {r["k"] for r in each}}
    R.write_summary({"scorer": args.scorer, "metrics": summary}, [r.asDict() for r in each], args.output)
    print(f"exact nDCG@3 {summary['exact_ndcg@3']:.4f}, soft nDCG@3 {summary['soft_ndcg@3']:.4f}")
    return 0


def judge(args: argparse.Namespace) -> int:
    d = dataset(args)
    found, texts = described(d, args.hop_limit)
    conditions = L.load_conditions(d.spark, args.conditions).select(F.col("id").alias("condition_id"), "condition")
    schema = P.schema_version(d.manifest, [r["candidate_id"] for r in found.orderBy("root", "turns", "place").collect()], {"hop_limit": args.hop_limit})
    settings = P.JudgeSettings(args.model_name, seed=args.seed)
    pairs = P.cache_keys(conditions.crossJoin(texts.withColumnRenamed("cand", "candidate_id")), schema, settings)
    before = L.load_existing(d.spark, args.output)
    left = pairs.join(before.where(F.col("status").isin(*L.DONE)).select("cache_key"), "cache_key", "left_anti")
    asked = P.judge_prompts(left, C.schema_text(found, d.manifest)).select("cache_key", "condition_id", "candidate_id", "prompt")
    new = E.judge(asked, P.responder(settings, named_function(args.engine)), f"{args.output}.passes", ["cache_key", "condition_id", "candidate_id"], args.attempts)
    rows = L.upsert(before, new, ["cache_key"]).collect()
    L.write_lines([r.asDict() for r in rows], args.output, ["condition_id", "candidate_id", "cache_key"])
    R.write_document({"status": {r["status"]: r["n"] for r in O.counts_by(new, "status").collect()}, "at": R.utc_now()}, f"{args.output}.metrics.json")
    return 0


def annotate(args: argparse.Namespace) -> int:
    d = dataset(args)
    _, texts = described(d, args.hop_limit)
    conditions = L.load_conditions(d.spark, args.conditions).select(F.col("id").alias("condition_id"), "condition")
    prior = L.read_lines(args.output)
    known = d.spark.createDataFrame([(r["condition_id"], r["candidate_id"], r["status"]) for r in prior], "condition_id string, candidate_id string, status string")
    order = H.open_tasks(conditions, texts.withColumnRenamed("cand", "candidate_id"), known, args.annotator, args.seed)
    tasks = order.join(conditions, "condition_id").join(texts.withColumnRenamed("cand", "candidate_id"), "candidate_id").orderBy("place").drop("place").collect()
    H.session((t.asDict() for t in tasks), args.annotator, lambda t: input(f"{t['condition']}\n{t['description']}\n0-3, u, s, q: "), prior, args.output)
    return 0


def compare_annotations(args: argparse.Namespace) -> int:
    spark, rows = spark_session(), []
    for path in args.files:
        own = L.read_lines(path)
        if len({r.get("annotator") for r in own}) != 1:
            raise ValueError(f"{path}: one annotator is expected")
        rows += [(r["condition_id"], r["candidate_id"], r["annotator"], r.get("grade"), r["status"]) for r in own]
    every = spark.createDataFrame(rows, "condition_id string, candidate_id string, annotator string, grade int, status string")
    for r in H.compared(every).orderBy("left", "right").collect():
        print(f"{r['left']} and {r['right']}: {r['overlap']} in common, {r['exact']:.3f} equal, kappa {'undefined' if r['kappa'] is None else round(r['kappa'], 4)}")
    if args.disagreements:
        L.write_lines([r.asDict() for r in H.disagreements(every).collect()], args.disagreements, [*H.KEY, "left", "right"])
    return 0


def evaluate_judged(args: argparse.Namespace) -> int:
    spark = spark_session()
    judged = spark.createDataFrame([(r["condition_id"], r["candidate_id"], r.get("status"), r.get("grade")) for r in L.read_lines(args.judgments)], "cond string, cand string, status string, grade int")
    out = None
    for path in args.results:
        rows = [(r["condition_id"], [s["id"] if isinstance(s, dict) else s for s in r["signals"]]) for r in L.read_lines(path)]
        one = E.evaluate_results(spark.createDataFrame(rows, "cond string, signals array<string>"), judged, args.allow_incomplete, least=args.relevant_grade).withColumn("method", F.lit(Path(path).stem))
        out = one if out is None else out.union(one)
    out = out.cache()
    print(R.metrics_text(out))
    R.write_document({"relevant_grade": args.relevant_grade, "allow_incomplete": args.allow_incomplete, "rows": [r.asDict() for r in out.orderBy("method", "cond", "k").collect()]}, args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="relweave", description=__doc__)
    commands = top.add_subparsers(required=True)

    def add(name: str, run: Callable[[argparse.Namespace], int], *options: tuple) -> None:
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        for flags, settings in options:
            one.add_argument(*flags.split(), **settings)

    need, number = (lambda flag: (flag, {"required": True})), (lambda flag, n: (flag, {"type": int, "default": n}))
    root = [need("--root"), ("--manifest", {})]
    star = [need("--entity"), ("--link", {}), number("--entities", 500), number("--most", 100)]
    add("inspect-manifest", inspect_manifest, ("path", {}), ("--json", {"action": "store_true"}))
    add("build-subset", build_subset, *root, *star, number("--least", 20), number("--row-groups", 10), number("--seed", 0), ("--mode", {"choices": S.MODES, "default": S.MODES[0]}), need("--output"))
    add("validate-subset", validate_subset, *root, *star)
    add("discover", discover, *root, need("--conditions"), ("--output", {}), ("--scorer", {"default": "random"}), ("--method", {"choices": ("rank", "graph"), "default": "rank"}), number("--hop-limit", 2), number("--max-decisions", 12), number("--branch-width", 2), number("--max-signals", 10), number("--seed", 0))
    add("build-benchmark", build_benchmark, *root, need("--specs"), need("--output"), ("--version", {"default": "1"}))
    add("evaluate-controlled", evaluate_controlled, *root, need("--benchmark"), need("--output"), ("--version", {"default": "1"}), ("--scorer", {"default": "random"}), number("--seed", 0))
    add("judge", judge, *root, need("--conditions"), need("--output"), need("--engine"), need("--model-name"), number("--hop-limit", 2), number("--attempts", 2), number("--seed", 0))
    add("annotate", annotate, *root, need("--conditions"), need("--output"), need("--annotator"), number("--hop-limit", 2), number("--seed", 0))
    add("compare-annotations", compare_annotations, ("files", {"nargs": "+"}), ("--disagreements", {}))
    add("evaluate-judged", evaluate_judged, need("--judgments"), ("--results", {"action": "append", "required": True}), need("--output"), ("--allow-incomplete", {"action": "store_true"}), ("--relevant-grade", {"type": int, "choices": (1, 2, 3), "default": 2}))
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        return args.run(args)
    except (OSError, ValueError, KeyError, RuntimeError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
