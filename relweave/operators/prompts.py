"""Texts that are sent to a model, the settings of a judge, and the keys under which its answers are kept."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.operators.labels import digest
from relweave.operators.search import Found
from relweave.sources.manifest import Manifest

#: What a grade stands for, and the versions of prompt and rubric.
GRADES = {0: "irrelevant", 1: "weak or indirect", 2: "useful but not central", 3: "direct or central"}
PROMPT_VERSION, RUBRIC_VERSION = "judge-1", "grades-0-3"

#: The form of an answer. Nothing beyond these fields is taken.
ANSWER_SCHEMA = {
    "type": "object",
    "properties": {"status": {"enum": ["judged", "unable_to_judge"]}, "grade": {"anyOf": [{"type": "integer", "minimum": 0, "maximum": 3}, {"type": "null"}]}, "reason": {"type": "string", "minLength": 1}},
    "required": ["status", "grade", "reason"],
    "additionalProperties": False,
}

JUDGE_SYSTEM = (
    "You grade how useful one signal of a relational schema is for one intent. All that you know is the schema, the intent and the signal; "
    "values and distributions of the data are unknown, and so is where the signal comes from.\n"
    + "\n".join(f"{g}: {text}" for g, text in GRADES.items())
    + "\nIf schema and intent allow no decision, the status is unable_to_judge and the grade null. Answer with one JSON object of status, grade and reason."
)


@dataclass(frozen=True)
class JudgeSettings:
    """A judge's model and how it is asked; max_tokens and family do not change what a label means."""

    model_name: str
    model_revision: str = "main"
    prompt_version: str = PROMPT_VERSION
    rubric_version: str = RUBRIC_VERSION
    seed: int = 0
    temperature: float = 0.0
    reasoning_effort: str = "none"
    max_tokens: int = 256
    family: str = "generic"

    def __post_init__(self):
        if self.max_tokens < 1 or self.temperature < 0:
            raise ValueError("max_tokens has to be positive and temperature not negative")

    def sampling(self) -> dict:
        """How the engine should sample: the same answer each time, in the answer's form."""
        return {"temperature": self.temperature, "seed": self.seed, "max_tokens": self.max_tokens, "json_schema": ANSWER_SCHEMA}


def responder(settings: JudgeSettings, engine: Callable[[list[str], dict], list[str]]) -> Callable[[list[str]], list[str]]:
    """An engine, which takes prompts and sampling settings, as a function of prompts alone."""

    def respond(prompts: list[str]) -> list[str]:
        answers = engine(prompts, settings.sampling())
        if len(answers) != len(prompts):
            raise RuntimeError(f"{len(prompts)} prompts, {len(answers)} answers")
        return answers

    return respond


def judge_messages(condition: str, description: str, schema: str) -> list[dict[str, str]]:
    """The two messages of one judgment; no method, rank or score is shown."""
    asked = f"Schema:\n{schema}\n\nIntent:\n{condition}\n\nSignal:\n{description}\n\nGrade the signal."
    return [{"role": "system", "content": JUDGE_SYSTEM}, {"role": "user", "content": asked}]


def judge_prompts(pairs: DataFrame, schema: str) -> DataFrame:
    """pairs (condition, description) with the column prompt, system and user message in one text."""
    asked = F.concat(F.lit(f"{JUDGE_SYSTEM}\n\nSchema:\n{schema}\n\nIntent:\n"), "condition", F.lit("\n\nSignal:\n"), "description", F.lit("\n\nGrade the signal."))
    return pairs.withColumn("prompt", asked)


KEY_FIELDS = ("condition_id", "condition", "candidate_id", "schema_version", "model_name", "model_revision", "prompt_version", "rubric_version", "seed", "temperature", "reasoning_effort")


def cache_key(condition_id: str, condition: str, candidate_id: str, schema: str, settings: JudgeSettings) -> str:
    """Digest of all that a label depends on."""
    known = asdict(settings) | {"condition_id": condition_id, "condition": condition, "candidate_id": candidate_id, "schema_version": schema}
    return digest({f: known[f] for f in KEY_FIELDS})


def json_value(value: Column) -> Column:
    """A value as JSON: a string quoted and escaped, a number as it is."""
    return F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", "$1")


def canonical_json(fields: dict[str, Column]) -> Column:
    """One JSON object, keys in order, with a space after each colon and comma."""
    parts = [F.concat(F.lit(f'"{name}": '), json_value(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def cache_keys(pairs: DataFrame, schema: str, settings: JudgeSettings) -> DataFrame:
    """pairs (condition_id, condition, candidate_id) with cache_key, made without Python workers."""
    fixed = {f: v for f, v in asdict(settings).items() if f in KEY_FIELDS} | {"schema_version": schema}
    fields = {f: F.lit(v) for f, v in fixed.items()} | {f: F.col(f) for f in ("condition_id", "condition", "candidate_id")}
    return pairs.withColumn("cache_key", F.sha2(canonical_json(fields), 256))


def schema_version(manifest: Manifest, candidate_ids: list[str], config: dict) -> str:
    """Digest of tables, keys, candidates in their order, and how these were made; no row of data."""
    return digest({"graph": graph_document(manifest), "candidate_ids": list(candidate_ids), "candidate_config": dict(config)})


def graph_document(manifest: Manifest) -> dict:
    """Tables and foreign keys as plain values."""
    tables = [{"name": t.name, "primary_key": t.primary_key, "time_column": t.time_column} for t in manifest.tables.values()]
    return {"tables": tables, "edges": [{"source_table": s, "source_column": k.column, "target_table": k.target_table, "target_column": k.target_column} for s, k in manifest.foreign_keys()]}


def intent_context(intent: str, schema: str) -> str:
    """What every scorer is told before it sees candidates."""
    return f"Useful signals of a relational schema are sought for retrieval or ranking. A path names the joins that lead to a signal; any table may be the one that is searched.\n\nSchema:\n{schema}\n\nIntent: {intent}"


def rerank_context(intent: str, history: str) -> str:
    """What the last ranking of a shortlist is told: the search that was made, and not the schema."""
    if not history.strip():
        raise ValueError("a ranking by history needs a history")
    return f"A search of a schema is over. Rank the offered signals, and no others, by their use for the intent.\n\nIntent: {intent}\n\nSearch:\n{history}\n\nWhich of the offered signals helps most?"


def history_text(found: Found, descriptions: dict[str, str], given_root: str | None = None) -> str:
    """A search as text: each decision with what was kept, and the signals; the states, which hold the schema, are left out."""
    lines = [f"Start table given: {given_root}"] if given_root is not None else []
    for step in found.trace:
        place = "choice of a start table" if step["path"] is None else "path " + " → ".join(step["path"])
        lines.append(f"Decision {step['decision']} ({place}): chosen: {step['choice'] or 'nothing'}")
        lines += [f"  kept: {a['option']} (probability {a['p']:.4f})" for a in step["expanded"]]
    lines += ["Signals found:", *(f"- {descriptions.get(s.id, s.id)}" for s in found.signals)] if found.signals else ["No signal was found."]
    return "\n".join(lines)


def history_texts(traces: DataFrame) -> DataFrame:
    """(task, history): the decisions of many traces (task, trace array<struct<decision, path, choice, expanded>>) as text."""
    kept = F.transform("s.expanded", lambda a: F.concat(F.lit("  kept: "), a["option"], F.lit(" (probability "), F.format_string("%.4f", a["p"]), F.lit(")")))
    place = F.when(F.col("s.path").isNull(), "choice of a start table").otherwise(F.concat(F.lit("path "), F.concat_ws(" → ", "s.path")))
    head = F.concat(F.lit("Decision "), F.col("s.decision").cast("string"), F.lit(" ("), place, F.lit("): chosen: "), F.coalesce("s.choice", F.lit("nothing")))
    steps = traces.select("task", F.explode("trace").alias("s")).select("task", F.col("s.decision").alias("n"), F.array_join(F.concat(F.array(head), kept), "\n").alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return steps.groupBy("task").agg(F.array_join(ordered, "\n").alias("history"))


def without_fence(text: str) -> str:
    """The driver's form of labels.unfenced."""
    found = re.fullmatch(r"```[^\n]*\n\s*(.*?)\s*\n\s*```[^\n]*", text.strip(), re.S)
    return found[1] if found else text.strip()
