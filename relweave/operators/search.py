"""Scoring of candidates and guided search of the schema graph, with an injected decider.

No model is part of this: a scorer or decider is a callable. `hash_scorer` is a baseline, not a model.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions.scalars import seeded_order
from relweave.operators.graph import describe_path
from relweave.sources.manifest import Manifest

#: decide(state, question, options) -> (chosen option or None, probability by option)
Decide = Callable[[str, str, list[str]], tuple[str | None, dict[str, float]]]
MOST_OPTIONS = 255


def hash_scorer(tasks: DataFrame, seed: int = 0) -> DataFrame:
    """(cond, cand, score): a pseudo-random score from seed, condition and candidate."""
    order = seeded_order(seed, F.col("cond"), F.col("cand"))
    return tasks.select("cond", "cand", (F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("score"))


def score_with(tasks: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """(cond, cand, score) of rows (cond, cand, condition, description), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["cond", "cand"]].assign(score=scorer(b["condition"].tolist(), b["description"].tolist()))

    return tasks.select("cond", "cand", "condition", "description").mapInPandas(run, "cond string, cand string, score double")


def choose(decide: Decide, state: str, question: str, options: list[str]) -> dict[str, float]:
    """Probability of each option; a single one is certain and is not asked about, absent ones are 0."""
    if len(options) == 1:
        return {options[0]: 1.0}
    if len(options) > MOST_OPTIONS:
        raise ValueError(f"at most {MOST_OPTIONS} options")
    got = decide(state, question, options)[1]
    return {o: got.get(o, 0.0) for o in options}


def task_seed(seed: int, task: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{task}".encode()).digest()[:8], "big")


@dataclass
class Signal:
    id: str
    kind: str
    root: str
    path: tuple[str, ...]
    table: str | None = None
    column: str | None = None


@dataclass
class Action:
    kind: str
    option: str
    table: str | None = None
    signal: Signal | None = None


@dataclass
class Branch:
    number: int
    parent: int | None
    path: tuple[str, ...]
    taken: frozenset = frozenset()
    history: tuple[str, ...] = ()
    log_p: float = 0.0


@dataclass
class Found:
    signals: list[Signal]
    trace: list[dict] = field(default_factory=list)
    calls: int = 0
    stop_reason: str = "frontier_exhausted"


END_BRANCH, END_SEARCH = "Stop this path and go on with others.", "Finish the search."


@dataclass
class Navigator:
    """Best-first search in which a decider picks among legal actions; bounded by decisions and signals.

    One search is a sequence of decisions and runs where it is called; `search_all` runs many conditions in parallel."""

    decide: Decide
    max_hops: int = 2
    max_decisions: int = 12
    width: int = 2
    max_signals: int = 10
    relationships: bool = True

    def run(self, intent: str, signals: list[Signal], manifest: Manifest, root: str | None = None) -> Found:
        tables = list(manifest.tables)
        self._check(signals, tables, root, any(True for _ in manifest.foreign_keys()))
        by_place: dict[tuple, list[Signal]] = {}
        for s in signals:
            by_place.setdefault((s.kind, s.path), []).append(s)
        found, known, number = Found([]), {}, 0
        frontier: list[tuple[float, int, Branch]] = []

        def push(branch: Branch) -> None:
            heapq.heappush(frontier, (-branch.log_p, branch.number, branch))

        def ask(branch: Branch | None, question: str, actions: list[Action]) -> tuple[str | None, list[tuple[Action, float]]]:
            options = [a.option for a in actions]
            if len(set(options)) < len(options) or not 2 <= len(options) <= MOST_OPTIONS:
                raise ValueError(f"a decision needs 2 to {MOST_OPTIONS} different options")
            state = self._state(intent, manifest, branch, list(known.values()))
            answer, p = self.decide(state, question, options)
            if answer is not None and answer not in options:
                raise RuntimeError(f"{answer!r} is not among the legal actions")
            order = sorted(range(len(options)), key=lambda i: (options[i] != answer, -max(0.0, p.get(options[i], 0.0)), i))
            best = [(actions[i], p.get(options[i], 0.0)) for i in order[: self.width]]
            found.calls += 1
            found.trace.append({
                "decision": found.calls, "branch": branch and branch.number, "parent": branch and branch.parent, "path": list(branch.path) if branch else None,
                "history": list(branch.history) if branch else [], "choice": answer, "legal": [{"kind": a.kind, "option": a.option, "p": p.get(a.option, 0.0)} for a in actions],
                "expanded": [{"kind": a.kind, "option": a.option, "p": q} for a, q in best],
            })
            return answer, best

        budget = self.max_decisions
        if root is not None:
            budget -= 1
            number = 1
            push(Branch(1, None, (root,), history=(f"Start table given: {root}",)))
        else:
            actions = [Action("start", f"Start from table: {t}", t) for t in tables] + [Action("stop_search", END_SEARCH)]
            answer, best = ask(None, "Which table is the best start?", actions)
            if answer == END_SEARCH:
                found.stop_reason = "model_stopped_search"
                return found
            for a, p in best:
                if a.kind == "start":
                    number += 1
                    push(Branch(number, None, (a.table,), history=(a.option,), log_p=_log(p)))
        seen: set[tuple] = set()
        while frontier and found.calls < budget and len(known) < self.max_signals:
            branch = heapq.heappop(frontier)[2]
            if (mark := (branch.path, branch.taken)) in seen:
                continue
            seen.add(mark)
            answer, best = ask(branch, "Which action helps most?", self.legal(branch, by_place, manifest, known))
            for a, p in best:
                if a.kind == "stop_branch" or a.kind == "stop_search" and a.option != answer:
                    continue
                if a.kind == "stop_search":
                    found.stop_reason = "model_stopped_search"
                    frontier.clear()
                    break
                taken, path = branch.taken, branch.path
                if a.signal is not None:
                    known.setdefault(a.signal.id, a.signal)
                    taken = taken | {a.signal.id}
                    if len(known) >= self.max_signals:
                        break
                else:
                    path = (*path, a.table)
                number += 1
                push(Branch(number, branch.number, path, taken, (*branch.history, a.option), branch.log_p + _log(p)))
        if len(known) >= self.max_signals:
            found.stop_reason = "max_signals_reached"
        elif frontier and found.calls >= budget:
            found.stop_reason = "max_decisions_reached"
        found.signals = list(known.values())
        return found

    def legal(self, branch: Branch, by_place: dict, manifest: Manifest, known: dict) -> list[Action]:
        """New signals at the path, steps to unvisited neighbours while hops remain, and the two ways to stop."""
        where = describe_path(manifest, list(branch.path))
        out = [Action("select_attribute", f"Select attribute: {s.table}.{s.column} (path: {where})", signal=s) for s in by_place.get(("attribute", branch.path), []) if s.id not in known]
        if self.relationships and len(branch.path) > 1:
            out += [Action("select_relationship", f"Select relationship path: {where}", signal=s) for s in by_place.get(("relationship", branch.path), []) if s.id not in known]
        if len(branch.path) <= self.max_hops:
            here = branch.path[-1]
            near = dict.fromkeys(k.target_table if s == here else s for s, k in manifest.foreign_keys() if here in (s, k.target_table))
            out += [Action("traverse", f"Traverse: {describe_path(manifest, [here, t])}", t) for t in near if t not in branch.path]
        return [*out, Action("stop_branch", END_BRANCH), Action("stop_search", END_SEARCH)]

    def _check(self, signals: list[Signal], tables: list[str], root: str | None, linked: bool) -> None:
        if root is not None and root not in tables:
            raise ValueError(f"unknown start table {root!r}")
        if root is not None and self.max_decisions < 2:
            raise ValueError("a given start table needs two decisions")
        if missing := set(tables) - {s.root for s in signals if s.kind == "attribute" and len(s.path) == 1}:
            raise ValueError(f"no attribute of {', '.join(sorted(missing))} is a candidate")
        if self.relationships and self.max_hops > 0 and linked and not any(s.kind == "relationship" for s in signals):
            raise ValueError("relationships are wanted, and none is a candidate")

    def _state(self, intent: str, manifest: Manifest, branch: Branch | None, known: list[Signal]) -> str:
        return "\n".join([f"Intent: {intent}", f"Tables: {', '.join(manifest.tables)}", f"Path: {'>'.join(branch.path) if branch else '-'}", f"History: {' | '.join(branch.history) if branch else '-'}", f"Found: {', '.join(s.id for s in known) or '-'}", f"Signals left: {self.max_signals - len(known)}"])


def _log(p: float) -> float:
    return math.log(max(p, 1e-12))


ACTION = "array<struct<kind: string, option: string, p: double>>"
SEARCH = f"task string, calls int, stop_reason string, signals array<string>, trace array<struct<decision: int, branch: int, parent: int, path: array<string>, history: array<string>, choice: string, legal: {ACTION}, expanded: {ACTION}>>"


def signals_of(candidates: DataFrame) -> list[Signal]:
    """Candidates of a schema in the order of their enumeration; there are few, one for each column that can be reached."""
    rows = candidates.orderBy("root", "turns", "place").collect()
    return [Signal(r["candidate_id"], r["kind"], r["root"], tuple(r["path"]), r["attribute_table"], r["attribute_column"]) for r in rows]


def search_all(conditions: DataFrame, signals: list[Signal], manifest: Manifest, navigator: Navigator) -> DataFrame:
    """A search for each row of conditions (task, intent, and root if start tables are given), side by side in tasks."""
    given = "root" in conditions.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                got = navigator.run(r.intent, signals, manifest, r.root if given else None)
                rows.append((str(r.task), got.calls, got.stop_reason, [s.id for s in got.signals], got.trace))
            yield pd.DataFrame(rows, columns=["task", "calls", "stop_reason", "signals", "trace"])

    return conditions.select("task", "intent", *["root"] * given).mapInPandas(run, SEARCH)


def trace_actions(traces: DataFrame) -> DataFrame:
    """(kind, n_legal, n_expanded) over exploded traces (trace array<struct<legal, expanded>>)."""
    step = traces.select(F.explode("trace").alias("t"))
    one = lambda c, n: step.select(F.explode(f"t.{c}").alias("a")).groupBy(F.col("a.kind").alias("kind")).agg(F.count("*").alias(n))
    return one("legal", "n_legal").join(one("expanded", "n_expanded"), "kind", "full").na.fill(0)
