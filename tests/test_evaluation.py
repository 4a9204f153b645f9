"""Labels, metrics, agreement, search, streaming."""

import json
import math
import random

import pytest

from relweave.functions import scalars as X
from relweave.operators import agreement as A
from relweave.operators import labels as L
from relweave.operators import metrics as M
from relweave.operators import search as N
from relweave.sources.manifest import parse_manifest
from relweave.streaming.upsert import event_counts, upsert_stream


def test_parse(spark):
    cases = {
        '{"status": "judged", "grade": 3, "reason": " fits "}': ("judged", 3, "fits"),
        '```json\n{"status": "judged", "grade": 0, "reason": "x"}\n```': ("judged", 0, "x"),
        '{"status": "unable_to_judge", "grade": null, "reason": "x"}': ("unable_to_judge", None, "x"),
        '{"status": "unable_to_judge", "reason": "x"}': ("unable_to_judge", None, "x"),
        **dict.fromkeys(['{"status": "judged", "grade": 4, "reason": "x"}', '{"status": "judged", "grade": "3", "reason": "x"}', '{"status": "judged", "grade": true, "reason": "x"}',
                         '{"status": "judged", "grade": 2, "reason": " "}', '{"status": "unable_to_judge", "grade": 1, "reason": "x"}', "not json", "[1]", "", "null"], ("invalid_response", None, None)),
    }
    rows = L.parse_judgment(spark.createDataFrame([(c,) for c in cases], "raw string")).collect()
    assert {r["raw"]: (r["status"], r["grade"], r["reason"]) for r in rows} == cases
    assert all((r["parse_error"] is None) == (r["status"] != "invalid_response") for r in rows)
    assert L.parse_judgment(spark.createDataFrame([(None,)], "raw string")).first()["status"] == "invalid_response"


def test_label_files(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "a", "condition": "x"}\n{"id": "a", "condition": "y"}\n')
    assert L.load_conditions(spark, path, unique=False).count() == 2
    with pytest.raises(ValueError, match="repeated"):
        L.load_conditions(spark, path)
    path.write_text('{"id": "a", "condition": " "}\n')
    with pytest.raises(ValueError, match=":1:"):
        L.load_conditions(spark, path)
    assert L.load_conditions(spark, path, blank=True).count() == 1
    assert L.read_lines(tmp_path / "none.jsonl") == []
    L.write_lines([{"k": "b", "v": "é"}, {"v": 1, "k": "a"}], str(path), ["k"])
    assert path.read_text() == '{"k": "a", "v": 1}\n{"k": "b", "v": "é"}\n'
    got = L.read_result_files(spark, [str(path), str(tmp_path / "none.jsonl")])
    assert {r["model"] for r in got.collect()} == {"c"}
    assert L.digest({"b": 1, "a": "é"}) == L.digest({"a": "é", "b": 1}) and L.throughput(4, 8, 0)["pairs_per_s"] == 0
    old = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v long")
    assert {tuple(r) for r in L.upsert(old, spark.createDataFrame([("x", 2)], "k string, v long"), ["k"]).collect()} == {("x", 2), ("y", 1)}


def test_tasks(spark):
    specs = spark.createDataFrame([("t", {"attribute:a:a.c": 3})], "id string, grades map<string,int>")
    cands = spark.createDataFrame([("1", "attribute", ["a"], "a", "c"), ("2", "relationship", ["a", "b"], None, None)], "candidate_id string, kind string, path array<string>, attribute_table string, attribute_column string")
    assert {tuple(r) for r in L.materialize_tasks(specs, cands).collect()} == {("t", "1", 3), ("t", "2", 0)}


def measured(order, grades, k, least_recall=3, least_precision=2):
    """nDCG, recall, precision at k and the reciprocal rank, by the definitions."""
    gain = lambda gs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gs[:k]))
    own, best = [grades.get(c, 0) for c in order], sorted(grades.values(), reverse=True)
    wanted = sum(g >= least_recall for g in best)
    return (
        gain(own) / gain(best) if gain(best) else 0.0, sum(g >= least_recall for g in own[:k]) / wanted if wanted else 0.0,
        sum(g >= least_precision for g in own[:k]) / len(own[:k]), next((1 / (i + 1) for i, g in enumerate(own) if g >= 3), 0.0),
    )


def rankings(seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    grades = {c: {n: r.choice([0, 0, 1, 2, 3]) for n in r.sample(names, r.randrange(1, 12))} for c in "uvwx"}
    grades["x"] = dict.fromkeys(grades["x"], 0)
    return {c: r.sample(names, r.randrange(1, 14)) for c in "uvwx"}, grades


def frames(spark, orders, grades):
    rank = spark.createDataFrame([(c, n, i + 1) for c, order in orders.items() for i, n in enumerate(order)], "cond string, cand string, rank int")
    return rank, spark.createDataFrame([(c, n, g) for c, gs in grades.items() for n, g in gs.items()], "cond string, cand string, grade int")


@pytest.mark.parametrize("seed", range(3))
def test_metrics(spark, seed):
    orders, grades = rankings(seed)
    rank, labels = frames(spark, orders, grades)
    got = [{(r["cond"], r["k"]): r[n] for r in df.collect()} for n, df in (("ndcg", M.ndcg(rank, labels)), ("recall", M.recall(rank, labels)), ("precision", M.precision(rank, labels)))]
    first = {r["cond"]: r["mrr"] for r in M.mrr(rank, labels).collect()}
    for c in orders:
        for k in M.CUTOFFS:
            assert [*(g[c, k] for g in got), first[c]] == pytest.approx(measured(orders[c], grades[c], k))
    kept = {(r["cond"], r["cand"]): r["rank"] for r in M.condensed(rank, labels).collect()}
    assert kept == {(c, n): i + 1 for c, order in orders.items() for i, n in enumerate([n for n in order if n in grades[c]])}


@pytest.mark.parametrize("seed", range(3))
def test_soft(spark, seed):
    """A key counts once, where it is first returned, with the best grade of its candidates."""
    orders, grades = rankings(seed)
    key = {f"n{i}": f"k{i % 5}" for i in range(14)}
    rank, labels = frames(spark, orders, grades)
    rows, of_key = M.soft(rank, labels, spark.createDataFrame(list(key.items()), "cand string, key string"))
    got = {(r["cond"], r["k"]): r["recall"] for r in M.recall(rows, of_key).collect()}
    value = {(r["cond"], r["k"]): r["ndcg"] for r in M.ndcg(rows, of_key).collect()}
    for c, order in orders.items():
        best = {}
        for n, g in grades[c].items():
            best[key[n]] = max(best.get(key[n], 0), g)
        once = [key[n] if key[n] not in [key[o] for o in order[:i]] else f"again {i}" for i, n in enumerate(order)]
        for k in M.CUTOFFS:
            want = measured(once, best, k)
            assert (value[c, k], got[c, k]) == pytest.approx(want[:2])


def test_kappa_and_consensus(spark):
    rows = [(i, m, g) for i, (a, b, c) in enumerate([(0, 0, 0), (3, 2, 3), (1, 2, 0), (0, 3, 1), (0, 3, 3)]) for m, g in (("a", a), ("b", b), ("c", c))]
    j = spark.createDataFrame(rows, "pair long, model string, grade int")
    same = spark.createDataFrame([(1, "a", 2), (1, "b", 2)], "pair long, model string, grade int")
    assert A.kappa(A.model_pairs(same)).first()["kappa"] == 1.0 and A.kappa(A.model_pairs(same), 2).first()["kappa"] is None
    got = {r["pair"]: (r["grade"], r["how"], r["support"]) for r in A.consensus(j).collect()}
    assert got[0] == (0, "majority", 3) and got[1] == (3, "majority", 2) and got[2] == (1, "ordinal", 1) and got[4] == (3, "majority", 2)
    two = spark.createDataFrame([(1, "a", 0), (1, "b", 3)], "pair long, model string, grade int")
    assert A.consensus(two).first()["how"] == "unresolved" and A.widest_gaps(two).count() == 1


def test_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(X.sigmoid(F.col("x")).alias("s"), X.log_odds(F.col("x")).alias("l"))
    assert [r["s"] for r in df.collect()] == [0.0, 0.5, 1.0]
    logits = spark.createDataFrame([([-2.0],), ([1.0, 3.0],), ([4.0, 2.0],)], "l array<double>")
    assert [r[0] for r in logits.select(X.relevance_log_odds(F.col("l"))).collect()] == [-2.0, 2.0, -2.0]


M3 = parse_manifest({"name": "m", "tables": {"review": {"fkeys": {"p": "product"}}, "product": {"pkey": "id"}}})
SIGNALS = [N.Signal("r.rating", "attribute", "review", ("review",), "review", "rating"), N.Signal("p.title", "attribute", "product", ("product",), "product", "title"), N.Signal("rp.title", "attribute", "review", ("review", "product"), "product", "title"), N.Signal("rp", "relationship", "review", ("review", "product"))]


def first_of(*wanted):
    def decide(state, question, options):
        pick = next((o for w in wanted for o in options if o.startswith(w)), options[-1])
        return pick, {o: 0.8 if o == pick else 0.2 / (len(options) - 1) for o in options}

    return decide


def test_navigator():
    found = N.Navigator(first_of("Start from table: review", "Select", "Traverse"), width=1).run("x", SIGNALS, M3)
    assert [s.id for s in found.signals] == ["r.rating", "rp.title", "rp"] and found.stop_reason == "model_stopped_search"
    assert found.calls == len(found.trace) and found.trace[0]["path"] is None
    few = N.Navigator(first_of("Start from table: review", "Select"), width=1, max_decisions=2).run("x", SIGNALS, M3)
    assert few.stop_reason == "max_decisions_reached" and few.calls == 2
    one = N.Navigator(first_of("Select"), max_signals=1).run("x", SIGNALS, M3, root="review")
    assert one.stop_reason == "max_signals_reached" and one.trace[0]["branch"] == 1
    assert N.Navigator(first_of("Finish")).run("x", SIGNALS, M3).signals == []
    with pytest.raises(RuntimeError):
        N.Navigator(lambda *a: ("elsewhere", {})).run("x", SIGNALS, M3)
    for bad in ({"root": "x"}, {"signals": SIGNALS[:1]}):
        with pytest.raises(ValueError):
            N.Navigator(first_of()).run("x", bad.get("signals", SIGNALS), M3, root=bad.get("root"))


def test_choices():
    assert N.choose(None, "", "", ["only"]) == {"only": 1.0}
    assert N.choose(lambda *a: ("a", {"a": 0.7}), "", "", ["a", "b"]) == {"a": 0.7, "b": 0.0}
    with pytest.raises(ValueError):
        N.choose(None, "", "", [str(i) for i in range(256)])


def test_scorer(spark):
    tasks = spark.createDataFrame([("c", "s1", "long text", "abc"), ("c", "s2", "x", "de")], "cond string, cand string, condition string, description string")
    got = M.ranked(N.score_with(tasks, lambda a, b: [float(len(x)) for x in b])).collect()
    assert [(r["cand"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("s1", 1), ("s2", 2)]
    assert N.hash_scorer(tasks).collect() == N.hash_scorer(tasks).collect()


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, value in enumerate((1, 2)):
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"k": k, "pos": n, "v": value}) + "\n" for k in ("a", "b")[: n + 1]))
        rows = spark.readStream.schema("k string, pos long, v long").json(str(tmp_path / "in"))
        upsert_stream(rows, spark, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "pos").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()} == {("a", 1, 2), ("b", 1, 2)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    live = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = live.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == event_counts(events).count()
