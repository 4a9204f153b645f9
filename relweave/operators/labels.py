"""Conditions, judgments and other graded labels: readers, strict parsing, keyed upserts, tasks."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.scalars import signal_key

DONE = ("judged", "unable_to_judge")


def read_lines(path: str | Path) -> list[dict]:
    """Objects of a JSONL file; a missing file has none."""
    if not Path(path).exists():
        return []
    out = []
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if line.strip():
            value = json.loads(line)
            if not isinstance(value, dict):
                raise ValueError(f"{path}:{n}: not an object")
            out.append(value)
    return out


def load_conditions(spark: SparkSession, path: str, unique: bool = True, blank: bool = False) -> DataFrame:
    """(line, id, condition); bad lines are errors with their number, and so are repeated ids if unique."""
    rows = []
    for n, value in enumerate(read_lines(path), 1):
        pair = value.get("id"), value.get("condition")
        if not all(isinstance(v, str) and (blank or v.strip()) for v in pair):
            raise ValueError(f"{path}:{n}: id and condition have to be strings" + ("" if blank else " that are not empty"))
        rows.append((n, *pair))
    if unique and len({r[1] for r in rows}) < len(rows):
        raise ValueError(f"{path}: repeated ids")
    if not rows:
        raise ValueError(f"{path}: no conditions")
    return spark.createDataFrame(rows, "line int, id string, condition string")


def read_result_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines of the files that exist, united by column name, with the file's stem as model; no rows if none does."""
    there = [p for p in paths if Path(p).exists()]
    out = None
    for p in there:
        df = spark.read.json(p).withColumn("model", F.lit(Path(p).stem))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], "condition_id string, model string") if out is None else out


def load_existing(spark: SparkSession, path: str, key: str = "cache_key") -> DataFrame:
    """Earlier judgments of a JSONL file, the last of each key; a row without a key is an error, a missing file has none."""
    rows = read_lines(path)
    for n, row in enumerate(rows, 1):
        if not isinstance(row.get(key), str) or not row[key]:
            raise ValueError(f"{path}:{n}: no {key}")
    kept = {row[key]: row for row in rows}
    layout = f"{key} string, condition_id string, candidate_id string, status string, grade int, reason string"
    names = [c.split()[0] for c in layout.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in kept.values()], layout)


def latest(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(position)))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def pending(conditions: DataFrame, candidates: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """Every condition with every candidate, without keys that are done. Both inputs are label tables, not data."""
    done = judged.where(F.col("status").isin(*DONE)).select(*key).distinct()
    return conditions.crossJoin(candidates).join(done, key, "left_anti")


def unfenced(raw: Column) -> Column:
    """Text inside a Markdown code fence, else the text."""
    return F.trim(F.regexp_replace(F.trim(raw), r"(?s)^```[^\n]*\n\s*(.*?)\s*\n\s*```[^\n]*$", "$1"))


def parse_judgment(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with status, grade, reason and parse_error; nothing is coerced.

    judged needs an integer grade 0..3 and a reason, unable_to_judge a null or absent grade and a reason."""
    v = F.try_parse_json(unfenced(F.col(raw)))
    kind = F.schema_of_variant(v)
    field = lambda p, t: F.try_variant_get(v, f"$.{p}", t)
    type_of = lambda p: F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant"))
    reason = F.when(type_of("reason") == "STRING", F.trim(field("reason", "string")))
    status = F.when(type_of("status") == "STRING", field("status", "string"))
    grade = F.when(type_of("grade") == "BIGINT", field("grade", "bigint"))
    no_grade = F.coalesce(type_of("grade"), F.lit("VOID")) == "VOID"
    judged = (status == "judged") & grade.between(0, 3)
    unable = (status == "unable_to_judge") & no_grade
    has = F.coalesce(reason, F.lit("")) != ""
    ok, is_object = F.coalesce((judged | unable) & has, F.lit(False)), F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    error = F.when(ok, F.lit(None)).when(v.isNull(), "not JSON").when(~is_object, "not a JSON object").when(F.coalesce(judged | unable, F.lit(False)), "no reason").otherwise("expected a grade 0..3, or unable_to_judge and no grade")
    return df.withColumns({"status": F.when(ok, status).otherwise("invalid_response"), "grade": F.when(ok & judged, grade.cast("int")), "reason": F.when(ok, reason), "parse_error": error})


def canonical(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, ensure_ascii=False)


def digest(payload: dict) -> str:
    """SHA-256 of a payload's canonical JSON: cache keys and schema versions."""
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of existing with other keys."""
    return existing.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_lines(rows: list[dict], path: str, key: list[str]) -> None:
    """A sorted JSONL file, replaced in one step. Label files are small and stay on the driver."""
    rows = sorted(rows, key=lambda r: tuple(str(r.get(k)) for k in key))
    part = Path(f"{path}.part")
    part.write_text("".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    os.replace(part, path)


def throughput(pairs: int, tokens: int, seconds: float) -> dict[str, float]:
    return {"pairs_per_s": pairs / seconds if seconds else 0.0, "tokens_per_s": tokens / seconds if seconds else 0.0, "tokens_per_pair": tokens / pairs if pairs else 0.0}


def materialize_tasks(specs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, candidate_id, grade): each task's grades (a map from signal key to grade) over all candidates, 0 where absent."""
    key = signal_key("kind", "path", "attribute_table", "attribute_column")
    return specs.crossJoin(candidates.select("candidate_id", key.alias("signal_key"))).select("id", "candidate_id", F.coalesce(F.try_element_at("grades", F.col("signal_key")), F.lit(0)).alias("grade"))
