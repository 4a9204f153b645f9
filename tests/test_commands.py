"""Command lines, JSON documents, people's labels and prompts."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from relweave import cli
from relweave.operators import annotation as H
from relweave.operators import labels as L
from relweave.operators import prompts as P
from relweave.operators import reports as R
from relweave.operators import search as N

MANIFEST = "name: museum\ntables:\n  visit: {time_col: at, fkeys: {guest: guest, work: work}}\n  guest: {pkey: id}\n  work: {pkey: code}\n"


def engine(prompts, sampling):
    assert sampling["temperature"] == 0
    return ['{"status": "judged", "grade": 2, "reason": "fits"}' if "work" in p.rsplit("Signal:", 1)[1] else "what?" for p in prompts]


def first(state, question, options):
    return options[0], {options[0]: 1.0}


@pytest.fixture
def museum(tmp_path, spark):
    (tmp_path / "manifest.yaml").write_text(MANIFEST)
    start = dt.datetime(2022, 1, 1)
    pq.write_table(pa.table({"at": [start + dt.timedelta(days=i) for i in range(120)], "guest": [i * 7 % 25 for i in range(120)], "work": [i * i % 11 for i in range(120)]}), tmp_path / "visit.parquet", row_group_size=30)
    pq.write_table(pa.table({"id": list(range(25)), "town": [f"town {i}" for i in range(25)]}), tmp_path / "guest.parquet")
    pq.write_table(pa.table({"code": list(range(11)), "title": [f"work {i}" for i in range(11)]}), tmp_path / "work.parquet")
    (tmp_path / "conditions.jsonl").write_text('{"id": "c1", "condition": "works seen together"}\n\n{"id": "c2", "condition": "guests from one town"}\n')
    return tmp_path


def lines(path):
    return [json.loads(x) for x in path.read_text().splitlines()]


def test_subset_commands(museum, capsys):
    root = ["--root", str(museum)]
    assert cli.main(["inspect-manifest", str(museum / "manifest.yaml")]) == 0 and "visit: key -, time at" in capsys.readouterr().out
    assert cli.main(["inspect-manifest", str(museum / "manifest.yaml"), "--json"]) == 0 and json.loads(capsys.readouterr().out)["tables"]["work"]["primary_key"] == "code"
    assert cli.main(["inspect-manifest", str(museum / "none.yaml")]) == 2
    star = ["--entity", "work", "--link", "guest", "--entities", "3", "--most", "12"]
    assert cli.main(["build-subset", *root, *star, "--least", "4", "--row-groups", "4", "--mode", "overlap_aware", "--output", str(museum / "sub")]) == 0
    assert cli.main(["validate-subset", "--root", str(museum / "sub"), *star]) == 0 and "OK" in capsys.readouterr().out
    assert cli.main(["validate-subset", "--root", str(museum / "sub"), *star[:-1], "1"]) == 1 and "FAIL  visit has at most 3 rows" in capsys.readouterr().out
    assert cli.main(["validate-subset", "--root", str(museum / "nowhere"), *star]) == 2
    assert cli.main(["build-subset", *root, "--entity", "nothing", "--output", str(museum / "x")]) == 2


def test_search_and_judge_commands(museum, capsys):
    root, here = ["--root", str(museum), "--conditions", str(museum / "conditions.jsonl")], "tests.test_commands"
    assert cli.main(["discover", *root, "--output", str(museum / "ranked.jsonl")]) == 0
    ranked = lines(museum / "ranked.jsonl")
    assert {r["cond"] for r in ranked} == {"c1", "c2"} and [r["rank"] for r in ranked if r["cond"] == "c1"] == list(range(1, len(ranked) // 2 + 1))
    assert cli.main(["discover", *root, "--method", "graph", "--scorer", f"{here}:first", "--max-signals", "2"]) == 0
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [len(r["signals"]) for r in found] == [2, 2] and found[0]["stop_reason"] == "max_signals_reached"
    labels = museum / "labels.jsonl"
    judge = ["judge", *root, "--engine", f"{here}:engine", "--model-name", "m", "--output", str(labels)]
    assert cli.main(judge) == 0
    first_time = lines(labels)
    assert {r["status"] for r in first_time} == {"judged", "invalid_response"} and json.loads((museum / "labels.jsonl.metrics.json").read_text())["status"]["judged"]
    assert cli.main(judge) == 0 and {r["cache_key"] for r in lines(labels)} == {r["cache_key"] for r in first_time}
    (museum / "method.jsonl").write_text("".join(json.dumps({"condition_id": c, "signals": [{"id": r["cand"]} for r in ranked if r["cond"] == c]}) + "\n" for c in ("c1", "c2")))
    measure = ["evaluate-judged", "--judgments", str(labels), "--results", str(museum / "method.jsonl"), "--output", str(museum / "out.json")]
    assert cli.main(measure) == 2 and cli.main([*measure, "--allow-incomplete"]) == 0
    rows = json.loads((museum / "out.json").read_text())["rows"]
    assert rows and all(r["precision"] in (0.0, 1.0) for r in rows)


def test_benchmark_commands(museum):
    root = ["--root", str(museum)]
    spec = {"id": "t1", "condition": "c", "source_table": "work", "reasoning_type": "direct", "oracle_rationale": "r", "grades": {"attribute:work:work.title": 3, "attribute:visit>work:work.title": 2}}
    (museum / "specs.jsonl").write_text(json.dumps(spec) + "\n")
    made = ["build-benchmark", *root, "--specs", str(museum / "specs.jsonl"), "--output", str(museum / "bench")]
    assert cli.main(made) == 0
    task = lines(museum / "bench/tasks.jsonl")[0]
    catalogue = json.loads((museum / "bench/candidate_catalog.json").read_text())
    assert set(task["signal_grades"]) == {r["id"] for r in catalogue} and sorted(set(task["signal_grades"].values())) == [0, 2, 3]
    assert cli.main(["evaluate-controlled", *root, "--benchmark", str(museum / "bench"), "--output", str(museum / "summary.json")]) == 0
    assert lines(museum / "summary-tasks.jsonl") and json.loads((museum / "summary.json").read_text())["metrics"]["exact_recall@5"] >= 0
    assert cli.main(["evaluate-controlled", *root, "--benchmark", str(museum / "bench"), "--version", "2", "--output", str(museum / "s.json")]) == 2
    for bad in ({"attribute:work:work.colour": 3}, {"attribute:work:work.title": 2}):
        (museum / "specs.jsonl").write_text(json.dumps(spec | {"grades": bad}) + "\n")
        assert cli.main(made) == 2


def test_annotate_commands(museum, monkeypatch, capsys):
    root = ["--root", str(museum), "--conditions", str(museum / "conditions.jsonl"), "--hop-limit", "0"]
    for name, answers in (("ann", ["3", "x", "u", "1", "q"]), ("bob", ["0"] * 9)):
        given = iter(answers)
        monkeypatch.setattr("builtins.input", lambda _, given=given: next(given))
        assert cli.main(["annotate", *root, "--annotator", name, "--output", str(museum / f"{name}.jsonl")]) == 0
    rows = lines(museum / "ann.jsonl")
    assert sorted((r["status"], r["grade"] or 0) for r in rows) == [("complete", 1), ("complete", 3), ("unsure", 0)]
    capsys.readouterr()
    files = [str(museum / "ann.jsonl"), str(museum / "bob.jsonl")]
    assert cli.main(["compare-annotations", *files, "--disagreements", str(museum / "d.jsonl")]) == 0
    assert "ann and bob: 2 in common" in capsys.readouterr().out and len(lines(museum / "d.jsonl")) == 2
    with pytest.raises(ValueError, match="ann"):
        H.session([], "bob", str, rows, str(museum / "x.jsonl"))


def test_prompts():
    found = N.Found([N.Signal("s1", "attribute", "a", ("a",), "a", "x")], [{"decision": 1, "path": None, "choice": None, "expanded": []}, {"decision": 2, "path": ["a", "b"], "choice": "go", "expanded": [{"option": "go", "p": 0.25}]}])
    assert P.history_text(found, {"s1": "the x"}, "a").splitlines() == [
        "Start table given: a", "Decision 1 (choice of a start table): chosen: nothing", "Decision 2 (path a → b): chosen: go", "  kept: go (probability 0.2500)", "Signals found:", "- the x",
    ]
    assert P.history_text(N.Found([]), {}) == "No signal was found."
    assert "the x" in P.rerank_context("i", "the x") and "Schema:\ns" in P.intent_context("i", "s")
    with pytest.raises(ValueError):
        P.rerank_context("i", " \n")
    one = P.JudgeSettings("m")
    key = lambda s: P.cache_key("c", "text", "k", "v", s)
    assert key(one) == key(P.JudgeSettings("m", max_tokens=9, family="f")) and len({key(s) for s in (one, P.JudgeSettings("n"), P.JudgeSettings("m", seed=1), P.JudgeSettings("m", reasoning_effort="low"))}) == 4
    messages = P.judge_messages("c", "d", "s")
    assert [m["role"] for m in messages] == ["system", "user"] and "unable_to_judge" in messages[0]["content"]
    with pytest.raises(RuntimeError):
        P.responder(one, lambda prompts, sampling: [])(["p"])


def test_cache_keys_agree(spark):
    settings = P.JudgeSettings("m", temperature=0.5)
    odd = 'a "quoted" \\ text\nwith é and 日本'
    df = P.cache_keys(spark.createDataFrame([("c", odd, "k")], "condition_id string, condition string, candidate_id string"), "v", settings)
    assert df.first()["cache_key"] == P.cache_key("c", odd, "k", "v", settings)


def test_existing(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    assert L.load_existing(spark, str(path)).count() == 0
    path.write_text('{"cache_key": "a", "status": "judged", "grade": 1}\n{"cache_key": "a", "status": "judged", "grade": 3}\n')
    assert [r["grade"] for r in L.load_existing(spark, str(path)).collect()] == [3]
    path.write_text('{"status": "judged"}\n')
    with pytest.raises(ValueError, match="cache_key"):
        L.load_existing(spark, str(path))
    assert L.read_result_files(spark, [str(tmp_path / "none")]).count() == 0


def test_documents(tmp_path, capsys):
    R.write_document({"b": 1, "a": "é"}, tmp_path / "deep/x.json")
    assert R.read_document(tmp_path / "deep/x.json") == {"a": "é", "b": 1} and [p.name for p in (tmp_path / "deep").iterdir()] == ["x.json"]
    R.print_lines([{"b": 1, "a": 2}])
    assert capsys.readouterr().out == '{"a": 2, "b": 1}\n'
