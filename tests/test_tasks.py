"""Controlled tasks, judging with retries and the checks of result evaluation."""

import json

import pytest
from pyspark.sql import functions as F

from relweave.operators import evaluation as E
from relweave.operators.candidates import fingerprint

TASK = {"id": "t", "condition": "c", "source_table": "a", "reasoning_type": "r", "oracle_rationale": "o", "signal_grades": {"x": 3, "y": "0"}}


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_tasks(spark, tmp_path):
    tasks = E.load_tasks(spark, write(tmp_path / "t.jsonl", [TASK]))
    assert tasks.first()["signal_grades"] == {"x": 3, "y": 0}
    for bad in ([], [TASK | {"condition": " "}], [TASK | {"signal_grades": {"x": 4}}], [TASK | {"signal_grades": None}]):
        with pytest.raises(ValueError):
            E.load_tasks(spark, write(tmp_path / "b.jsonl", bad))
    ids = spark.createDataFrame([("x",), ("y",)], "candidate_id string")
    known = {"benchmark_version": "1", "candidate_id_sha256": next(v for v in fingerprint(ids).first() if isinstance(v, str))}
    E.require_current(known, "1", ids, tasks)
    more = ids.union(spark.createDataFrame([("z",)], "candidate_id string"))
    low = tasks.withColumn("signal_grades", F.transform_values("signal_grades", lambda k, v: F.lit(2)))
    for args in ((known, "2", ids, tasks), (known, "1", more, tasks), (known, "1", ids, low), (known | {"candidate_id_sha256": next(v for v in fingerprint(more).first() if isinstance(v, str))}, "1", more, tasks)):
        with pytest.raises(ValueError):
            E.require_current(*args)


def test_judge_asks_again(spark, tmp_path):
    asked = tmp_path / "asked"

    def respond(prompts):
        again = asked.exists()
        out = ['{"status": "judged", "grade": 2, "reason": "r"}' if p == "good" or again and p == "slow" else "?" for p in prompts]
        if "slow" in prompts:
            asked.touch()
        return out

    tasks = spark.createDataFrame([(1, "good"), (2, "slow"), (3, "never")], "k long, prompt string").coalesce(1)
    got = {r["k"]: (r["status"], r["grade"], r["attempt"]) for r in E.judge(tasks, respond, str(tmp_path / "passes"), ["k"]).collect()}
    assert got == {1: ("judged", 2, 1), 2: ("judged", 2, 2), 3: ("invalid_response", None, 2)}


def test_incomplete_results(spark):
    results = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["x"])], "cond string, signals array<string>")
    judged = spark.createDataFrame([("a", "x", "judged", 3), ("a", "y", "unable_to_judge", None), ("b", "x", "judged", 3)], "cond string, cand string, status string, grade int")
    with pytest.raises(ValueError):
        E.evaluate_results(results, judged)
    got = {(r["cond"], r["k"]): r for r in E.evaluate_results(results, judged, True).collect()}
    assert set(got) == {(c, k) for c in "ab" for k in (1, 3, 5, 10)}
    assert got["a", 1]["ndcg"] == got["a", 1]["mrr"] == 1.0 and got["a", 1]["coverage"] == 0.5 and got["b", 10]["recall"] == got["b", 10]["mrr"] == 0.0


def test_root_rates(spark):
    rows = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "a", ["b", "a"]), (3, "a", []), (4, None, ["a"])], "task long, expected string, explored array<string>")
    r = E.root_rates(E.root_selection(rows)).first()
    assert (r["n"], r["correct"], r["explored_correct"], r["accuracy"], r["hit_rate"]) == (4, 1, 2, 0.25, 0.5)
    assert E.root_rates(E.root_selection(rows.limit(0))).first()["accuracy"] == 0.0
