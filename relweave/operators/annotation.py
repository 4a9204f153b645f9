"""Labels given by people: the order in which a person sees tasks, records, and the comparison of two people."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.scalars import seeded_order
from relweave.operators import agreement
from relweave.operators.labels import upsert, write_lines
from relweave.operators.prompts import GRADES, RUBRIC_VERSION

KEY = ["condition_id", "candidate_id"]


def complete(annotations: DataFrame) -> DataFrame:
    """Annotations that are finished and hold a grade."""
    return annotations.where((F.col("status") == "complete") & F.col("grade").isin(*GRADES))


def annotator_seed(annotator: str, seed: int) -> int:
    """A number of its own for each person."""
    return int.from_bytes(hashlib.sha256(annotator.encode()).digest()[:8], "big") ^ seed


def open_tasks(conditions: DataFrame, candidates: DataFrame, prior: DataFrame, annotator: str, seed: int = 0) -> DataFrame:
    """(place, condition_id, candidate_id) that a person has not completed, conditions and their candidates in an order of that person's own.

    Conditions and candidates are lists a person works through, not data."""
    own = annotator_seed(annotator, seed)
    done = prior.where("status = 'complete'").select(*KEY).distinct()
    left = conditions.select("condition_id").crossJoin(candidates.select("candidate_id")).join(done, KEY, "left_anti")
    order = [seeded_order(own, F.col("condition_id")), F.col("condition_id"), seeded_order(own, *map(F.col, KEY)), F.col("candidate_id")]
    return left.select(F.row_number().over(W.orderBy(*order)).alias("place"), *KEY)


def record(annotator: str, task: dict, grade: int | None, rationale: str = "", now: Callable[[], dt.datetime] | None = None) -> dict:
    """One annotation; without a grade the person is unsure."""
    if grade is not None and grade not in GRADES:
        raise ValueError(f"a grade is one of {', '.join(map(str, GRADES))}")
    at = (now or (lambda: dt.datetime.now(dt.UTC)))()
    return task | {"annotator": annotator, "grade": grade, "status": "unsure" if grade is None else "complete", "rationale": rationale.strip(), "rubric_version": RUBRIC_VERSION, "annotated_at": at.isoformat()}


def session(tasks: Iterable[dict], annotator: str, ask: Callable[[dict], str], prior: list[dict], path: str) -> list[dict]:
    """Asks for each task and writes the file after each answer: a grade, u for unsure, s to skip, q to stop.

    prior are the rows of the person's file; those of somebody else are an error."""
    if other := {r.get("annotator") for r in prior} - {annotator}:
        raise ValueError(f"the file holds annotations of {', '.join(map(str, sorted(map(str, other))))}")
    rows = {tuple(r[k] for k in KEY): r for r in prior}
    for task in tasks:
        while (answer := ask(task).strip().lower()) not in {*map(str, GRADES), "u", "s", "q"}:
            pass
        if answer == "q":
            break
        if answer != "s":
            rows[tuple(task[k] for k in KEY)] = record(annotator, task, None if answer == "u" else int(answer))
            write_lines(list(rows.values()), path, KEY)
    return list(rows.values())


def merged(prior: DataFrame, new: DataFrame) -> DataFrame:
    """New annotations over older ones of the same pair and person."""
    return upsert(prior, new, ["annotator", *KEY])


def _judgments(annotations: DataFrame) -> DataFrame:
    return complete(annotations).select(F.struct(*KEY).alias("pair"), F.col("annotator").alias("model"), "grade")


def compared(annotations: DataFrame) -> DataFrame:
    """(left, right, overlap, exact, n_exact, kappa) for every two people who completed a pair in common."""
    pairs = agreement.model_pairs(_judgments(annotations))
    same = pairs.groupBy("model_a", "model_b").agg(F.sum((F.col("ga") == F.col("gb")).cast("long")).alias("n_exact"))
    got = agreement.kappa(pairs, 1).join(same, ["model_a", "model_b"])
    return got.select(F.col("model_a").alias("left"), F.col("model_b").alias("right"), F.col("n").alias("overlap"), (F.col("n_exact") / F.col("n")).alias("exact"), "n_exact", "kappa")


def disagreements(annotations: DataFrame) -> DataFrame:
    """(condition_id, candidate_id, left, right, left_grade, right_grade) where two people's grades differ."""
    pairs = agreement.model_pairs(_judgments(annotations)).where("ga <> gb")
    return pairs.select("pair.condition_id", "pair.candidate_id", F.col("model_a").alias("left"), F.col("model_b").alias("right"), F.col("ga").alias("left_grade"), F.col("gb").alias("right_grade"))
