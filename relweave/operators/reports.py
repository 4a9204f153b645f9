"""JSON documents, benchmark folders and text reports. They describe results and stay on the driver; data is written by Spark."""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.operators import validate as V
from relweave.operators.candidates import describe, enumerate_candidates, fingerprint
from relweave.operators.graph import star_plan
from relweave.operators.labels import materialize_tasks
from relweave.operators.prompts import graph_document
from relweave.sources.dataset import RelationalDataset
from relweave.sources.manifest import Manifest


def utc_now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


def read_document(path: str | Path) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_document(value: object, path: str | Path) -> None:
    """A JSON file, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_text(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(part, target)


def print_lines(rows: Iterable[dict], path: str | Path | None = None) -> None:
    """JSON lines with sorted keys, in the order given, to a file or to standard output."""
    text = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows)
    if path is None:
        sys.stdout.write(text)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")


def write_summary(summary: dict, tasks: Iterable[dict], path: str | Path) -> Path:
    """The summary at path and the rows of its tasks beside it; returns where those are."""
    write_document(summary, path)
    beside = Path(path).with_name(f"{Path(path).stem}-tasks.jsonl")
    print_lines(tasks, beside)
    return beside


def manifest_document(manifest: Manifest) -> dict:
    """A manifest as plain values."""
    tables = {
        t.name: {"primary_key": t.primary_key, "time_column": t.time_column, "columns": None if t.columns is None else list(t.columns), "foreign_keys": [{"column": k.column, "target_table": k.target_table, "target_column": k.target_column} for k in t.foreign_keys]}
        for t in manifest.tables.values()
    }
    return {"name": manifest.name, "manifest_version": manifest.version, "description": manifest.description, "val_timestamp": manifest.val_timestamp, "test_timestamp": manifest.test_timestamp, "tables": tables}


def graph_json(manifest: Manifest) -> str:
    return json.dumps(graph_document(manifest), sort_keys=True, ensure_ascii=False)


def candidate_rows(candidates: DataFrame, manifest: Manifest) -> list[dict]:
    """A JSON row for each candidate, in the order in which they are enumerated."""
    out = []
    for r in candidates.orderBy("root", "turns", "place").collect():
        row = {"id": r["candidate_id"], "kind": r["kind"], "source_table": r["root"], "path": list(r["path"]), "hops": r["hops"], "attribute_table": r["attribute_table"], "attribute_column": r["attribute_column"]}
        out.append(row | {"description": describe(manifest, r["kind"], list(r["path"]), r["attribute_table"], r["attribute_column"])})
    return out


def build_benchmark(dataset: RelationalDataset, specs: DataFrame, out: str, version: str, write_schema: Callable[[RelationalDataset, str], None]) -> dict:
    """A benchmark's folder: tables without rows, the catalogue of candidates, graded tasks and metadata.

    specs are (id, condition, source_table, reasoning_type, oracle_rationale, grades: a map from signal key to grade);
    grades of signals that do not exist, and tasks without a grade 3, are errors."""
    candidates = enumerate_candidates(dataset).cache()
    rows = candidate_rows(candidates, dataset.manifest)
    graded: dict[str, dict[str, int]] = {}
    for r in materialize_tasks(specs, candidates).collect():
        graded.setdefault(r["id"], {})[r["candidate_id"]] = r["grade"]
    known = {key_of(r) for r in rows}
    tasks = []
    for s in sorted(specs.collect(), key=lambda s: s["id"]):
        if unknown := set(s["grades"]) - known:
            raise ValueError(f"task {s['id']!r} grades signals that do not exist: {', '.join(sorted(unknown))}")
        if 3 not in s["grades"].values():
            raise ValueError(f"task {s['id']!r} has no grade 3")
        tasks.append({f: s[f] for f in ("id", "condition", "source_table", "reasoning_type", "oracle_rationale")} | {"signal_grades": graded[s["id"]]})
    digest = fingerprint(candidates).first()
    candidates.unpersist()
    metadata = {"benchmark_version": version, "candidate_count": digest["n"], "candidate_id_sha256": digest["fingerprint"], "task_count": len(tasks), "reasoning_types": sorted({t["reasoning_type"] for t in tasks})}
    write_schema(dataset, out)
    write_document(rows, f"{out}/candidate_catalog.json")
    print_lines(tasks, f"{out}/tasks.jsonl")
    write_document(metadata, f"{out}/benchmark.json")
    return metadata


def key_of(row: dict) -> str:
    """A candidate's key without its source table."""
    where = f"{row['kind']}:{'>'.join(row['path'])}"
    return f"{where}:{row['attribute_table']}.{row['attribute_column']}" if row["attribute_table"] else where


@dataclass
class SubsetReport:
    """Statistics and checks of a subset."""

    checks: list[tuple[str, bool, str]] = field(default_factory=list)
    statistics: list[tuple[str, object]] = field(default_factory=list)

    @property
    def failures(self) -> list[str]:
        return [name for name, passed, _ in self.checks if not passed]

    @property
    def ok(self) -> bool:
        return not self.failures

    @property
    def exit_status(self) -> int:
        return 0 if self.ok else 1

    def text(self) -> str:
        width = max((len(n) for n, _ in self.statistics), default=0)
        lines = [f"{n:<{width}}  {v:,}" if isinstance(v, int) else f"{n:<{width}}  {v}" for n, v in self.statistics]
        lines += [f"{'PASS' if passed else 'FAIL'}  {name}" + (f"  ({detail})" if detail else "") for name, passed, detail in self.checks]
        return "\n".join([*lines, "OK" if self.ok else f"FAILED: {len(self.failures)} checks"])


def subset_report(dataset: RelationalDataset, most_rows: int, entity: str | None = None, link: str | None = None, manifest_path: str | None = None) -> SubsetReport:
    """Checks every table, key and link of a subset, and describes it. A table that cannot be read is a failed check."""
    spark, manifest = dataset.spark, dataset.manifest
    fact, links = star_plan(manifest)
    tables = {n: dataset.table(n) if dataset.exists(n) else None for n in dataset.table_names()}
    out = SubsetReport()
    if manifest_path is not None:
        out.checks.append(("manifest exists", Path(manifest_path).is_file(), "" if Path(manifest_path).is_file() else str(manifest_path)))
    if not any(df is not None for df in tables.values()):
        out.checks += [(f"table {n} exists", False, n) for n in tables]
        return out
    keys = {n: t.primary_key for n, t in manifest.tables.items() if t.primary_key}
    out.checks += [tuple(r) for r in V.checks(tables, fact, keys, [(c, d) for d, cs in links.items() for c in cs], most_rows).collect()]
    there = {n: df for n, df in tables.items() if df is not None}
    out.statistics += [(f"{r['table_name']} rows", r["n_rows"]) for r in V.row_counts(there).collect()]
    if fact not in there:
        return out
    for dim, columns in links.items():
        r = V.rows_per_key(there[fact], columns[-1]).first()
        out.statistics.append((f"{fact} rows a {dim} (min, median, mean, max)", " / ".join("-" if v is None else f"{v:,.1f}" for v in r)))
    if manifest.tables[fact].time_column:
        out.statistics.append(("time range", " .. ".join(map(str, V.time_range(there[fact], manifest.tables[fact].time_column).first()))))
    if entity in links and link in links:
        r = V.overlap_summary(there[fact], links[entity][0], links[link][0]).first()
        out.statistics += [(name, r[name] if isinstance(r[name], int) else str(r[name])) for name in ("entities", "connected", "pairs", "pair_fraction", "bridging", "shared_median", "shared_avg", "shared_max", "jaccard_median")]
    return out


def manifest_text(manifest: Manifest) -> str:
    """Tables, keys and split times for a person."""
    lines = [manifest.name + (f" (manifest {manifest.version})" if manifest.version else "")]
    lines += [manifest.description] if manifest.description else []
    lines += [f"validation from {manifest.val_timestamp or '-'}, test from {manifest.test_timestamp or '-'}"]
    for t in manifest.tables.values():
        lines.append(f"{t.name}: key {t.primary_key or '-'}, time {t.time_column or '-'}")
        lines += [f"  {k.column} -> {k.target_table}" + (f".{k.target_column}" if k.target_column else "") for k in t.foreign_keys]
    lost = manifest.dangling()
    return "\n".join([*lines, *(f"undeclared table: {k.target_table} (from {s}.{k.column})" for s, k in lost)])


def metrics_text(rows: DataFrame) -> str:
    """A line for each method: conditions, coverage and nDCG, recall at 5; rows are (method, cond, k, coverage, ndcg, recall)."""
    got = rows.where("k = 5").groupBy("method").agg(F.count("*").alias("n"), F.avg("coverage").alias("coverage"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall")).orderBy("method").collect()
    return "\n".join(f"{r['method']}: {r['n']} conditions, coverage {r['coverage']:.1%}, nDCG@5 {r['ndcg']:.4f}, recall@5 {r['recall']:.4f}" for r in got)
