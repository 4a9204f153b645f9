"""Manifests, graph, dataset, sampling, checks, candidates, over a small lending library."""

import datetime as dt
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException

from relweave.operators import candidates as C
from relweave.operators import graph as G
from relweave.operators import sampling as S
from relweave.operators import validate as V
from relweave.sources import rowgroups
from relweave.sources.dataset import RelationalDataset
from relweave.sources.manifest import ManifestError, load_manifest, parse_manifest

LIBRARY = {
    "name": "library", "val_timestamp": dt.datetime(2021, 3, 1, 12), "manifest_version": 2,
    "tables": {"loan": {"time_col": "taken", "fkeys": {"reader": "reader", "book": "book"}}, "book": {"pkey": "isbn"}, "reader": {"pkey": "card"}},
}
START = dt.datetime(2020, 6, 1)


def schema(**tables):
    return parse_manifest({"name": "m", "tables": tables})


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """600 loans in 12 row groups, some without a reader; a few popular books and readers."""
    root, r = tmp_path_factory.mktemp("library"), random.Random(20)
    loans = [(START + dt.timedelta(hours=i), None if r.random() < 0.05 else int(r.paretovariate(0.6)) % 90, min(int(r.expovariate(0.12)), 59)) for i in range(600)]
    taken, reader, book = zip(*loans, strict=True)
    pq.write_table(pa.table({"taken": pa.array(taken, pa.timestamp("us")), "reader": pa.array(reader, pa.int64()), "book": pa.array(book, pa.int64())}), root / "loan.parquet", row_group_size=50)
    pq.write_table(pa.table({"isbn": list(range(60)), "name": [f"book {i}" for i in range(60)]}), root / "book.parquet")
    pq.write_table(pa.table({"card": list(range(90))}), root / "reader.parquet")
    return root


@pytest.fixture
def dataset(spark, library):
    return RelationalDataset(spark, parse_manifest(LIBRARY), str(library))


def test_manifest(tmp_path):
    m = parse_manifest(LIBRARY)
    assert m.val_timestamp == "2021-03-01T12:00:00" and m.version == 2 and m.tables["loan"].referenced == ("taken", "reader", "book")
    assert [(s, k.target_column) for s, k in m.foreign_keys()] == [("loan", "card"), ("loan", "isbn")]
    (tmp_path / "m.yaml").write_text("name: x\ntables: {p: null, q: {pkey: k, columns: [{name: k}, z, 7]}}")
    assert load_manifest(tmp_path / "m.yaml").tables["q"].columns == ("k", "z", "7")
    assert schema(p={"fkeys": {"x": "gone"}}).dangling()[0][1].target_column is None and schema().tables == {}
    for bad in (3, {"tables": {"p": {}}}, {"name": "", "tables": {"p": {}}}, {"name": "x"}, {"name": "x", "tables": "p"}, {"name": "x", "tables": {"p": {"columns": 1}}}, {"name": "x", "tables": {"p": {"columns": [{}]}}}):
        with pytest.raises(ManifestError):
            parse_manifest(bad)


def listed(spark, m, hops, root):
    return [r["path"] for r in G.paths(G.edges(spark, m), hops).where(f"root = '{root}'").orderBy("turns").collect()]


def walks(m, hops, root):
    """Simple paths by plain recursion, neighbours in order of declaration."""
    near = {}
    for s, k in m.foreign_keys():
        near.setdefault(s, {})[k.target_table] = None
        near.setdefault(k.target_table, {})[s] = None

    def on(path):
        if len(path) <= hops:
            for t in near.get(path[-1], ()):
                if t not in path:
                    yield [*path, t]
                    yield from on([*path, t])

    return list(on([root]))


@pytest.mark.parametrize("seed", range(4))
def test_paths(spark, seed):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(6)]
    m = schema(**{n: {"pkey": "k", "fkeys": {f"to_{o}_{i}": o for i, o in enumerate(r.sample(names, r.randrange(3)))}} for n in names})
    for root, hops in itertools.product(names[:3], (0, 1, 3)):
        assert listed(spark, m, hops, root) == walks(m, hops, root)


def test_relationships(spark):
    m = schema(flight={"fkeys": {"origin": "port", "goal": "port", "next": "flight"}, "pkey": "no"}, port={"pkey": "code"}, lone={"pkey": "x"})
    e = G.edges(spark, m)
    assert [r["source_column"] for r in G.relationships(e, "port", "flight").collect()] == ["origin", "goal"] and G.relationship(e, "lone", "port") is None
    assert listed(spark, m, 2, "flight") == [["flight", "port"]] and {r["neighbor"] for r in G.neighbors(e).where("table_name = 'flight'").collect()} == {"port", "flight"}
    with pytest.raises(ValueError, match="several"):
        G.relationship(e, "flight", "port")
    with pytest.raises(ValueError, match="2 foreign keys"):
        G.describe_path(m, ["port", "flight"])
    assert G.describe_path(parse_manifest(LIBRARY), ["book", "loan", "reader"]) == "book --book.isbn←loan.book-- loan --loan.reader→reader.card-- reader"
    for bad in (schema(p={"fkeys": {"x": "q"}}), schema(p={"fkeys": {"x": "q"}}, q={})):
        with pytest.raises(ValueError):
            G.edges(spark, bad)


def test_star():
    assert G.star_plan(parse_manifest(LIBRARY)) == ("loan", {"reader": ["reader"], "book": ["book"]})
    for bad in (schema(p={"pkey": "k"}), schema(p={"pkey": "k", "fkeys": {"up": "p"}}), schema(p={"fkeys": {"x": "q"}}, q={"pkey": "k"}, alone={"pkey": "k"})):
        with pytest.raises(ValueError):
            G.star_plan(bad)


def test_dataset(spark, dataset, library, tmp_path):
    assert dataset.columns("book") == ["isbn", "name"] and dataset.table("loan") is dataset.table("loan")
    books = pq.read_table(library / "loan.parquet")["book"].to_pylist()
    assert dataset.entity("book", 5)["name"] == "book 5" and dataset.rows("loan", "book", 2).count() == books.count(2)
    for call, error in ((lambda: dataset.table("x"), KeyError), (lambda: dataset.entity("loan", 1), ValueError), (lambda: dataset.entity("book", -1), KeyError), (lambda: dataset.rows("book", "x", 1), KeyError)):
        with pytest.raises(error):
            call()
    pq.write_table(pa.table({"a.b": [1, 1], "c`d": [2, 3]}), tmp_path / "odd.parquet")
    odd = RelationalDataset(spark, schema(odd={"pkey": "a.b"}, gone={}), str(tmp_path))
    assert odd.rows("odd", "a.b", 1).count() == 2 and odd.rows("odd", "c`d", 3).count() == 1 and odd.exists("odd") and not odd.exists("gone")
    with pytest.raises(ValueError, match="not unique"):
        odd.entity("odd", 1)


def test_row_groups(spark, library):
    path = str(library / "loan.parquet")
    assert rowgroups.row_group_sizes(path) == [50] * 12 == rowgroups.row_group_sizes(f"file://{path}")
    for count, chosen in itertools.product(range(1, 25), range(1, 25)):
        got = rowgroups.evenly_spaced(count, chosen)
        assert len(got) == len(set(got)) == min(count, chosen) and got == sorted(got) and 0 <= got[0] and got[-1] < count
        assert chosen == 1 or (got[0], got[-1]) == (0, count - 1)
    got = rowgroups.scan_row_groups(spark, path, [1, 4], ["book"]).orderBy("position")
    assert got.columns == ["position", "book"] and [r["position"] for r in got.collect()] == [*range(50, 100), *range(200, 250)]
    whole = spark.read.parquet(path)
    assert rowgroups.scan_row_groups(spark, path, [0]).drop("position").schema == whole.schema


def test_row_groups_by_http(spark, tmp_path):
    """Only the footer and the chosen groups are sent."""
    import http.server
    import threading

    r = np.random.default_rng(1)
    pq.write_table(pa.table({"x": r.integers(0, 1 << 60, 400_000), "y": r.integers(0, 1 << 60, 400_000)}), tmp_path / "t.parquet", row_group_size=20_000)
    data, sent = (tmp_path / "t.parquet").read_bytes(), []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            sent.append(b + 1 - a)
            self.send_response(206)
            self.send_header("Content-Length", str(b + 1 - a))
            self.end_headers()
            self.wfile.write(data[a : b + 1])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/t.parquet"
        got = rowgroups.scan_row_groups(spark, url, [3, 17], ["x"]).orderBy("position").collect()
    finally:
        server.shutdown()
    want = pq.read_table(tmp_path / "t.parquet")["x"].to_pylist()
    assert [tuple(r) for r in got] == [(i, want[i]) for g in (3, 17) for i in range(20_000 * g, 20_000 * (g + 1))]
    assert sum(sent) < len(data) / 5


@pytest.mark.parametrize("mode", S.MODES)
def test_subset(spark, dataset, tmp_path, mode):
    config = S.SubsetConfig("book", "reader", entities=8, least=5, most=9, row_groups=6, mode=mode)
    counts = S.build_subset(dataset, config, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "loan.parquet")).toPandas()
    assert 0 < counts["loan"] <= config.most_rows and got.groupby("book").size().max() <= 9 and got.book.nunique() <= 8
    hours = (got.taken - START).dt.total_seconds() // 3600
    assert hours.is_monotonic_increasing and set(hours // 50) <= set(rowgroups.evenly_spaced(12, 6))
    assert counts["book"] == got.book.nunique() and counts["reader"] == got.reader.nunique()
    assert S.sample_fact(dataset, config).toPandas().equals(got)
    tables = {t: spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in dataset.table_names()}
    checks = V.checks(tables, "loan", {"book": "isbn", "reader": "card"}, [("book", "book"), ("reader", "reader")], config.most_rows)
    assert checks.where("not passed").count() == 0 and checks.count() == 11
    S.schema_only(dataset, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty/loan.parquet")).count() == 0


def test_config():
    for bad in ({"entities": 0}, {"least": 5, "most": 4}, {"mode": "x"}, {"row_groups": 0}):
        with pytest.raises(ValueError):
            S.SubsetConfig("a", "b", **bad)


def greedy(order, links, limit):
    """By the definition: count the links with picked entities anew for every pick."""
    of = {e: {x for y, x in links if y == e} for e in order}
    picked = []
    while len(picked) < min(limit, len(order)):
        seen = set().union(*(of[e] for e in picked))
        picked.append(max((e for e in order if e not in picked), key=lambda e: (len(of[e] & seen), -order.index(e))))
    return picked


@pytest.mark.parametrize("seed", range(6))
def test_connected_selection(spark, seed):
    r = random.Random(seed)
    entities = [f"e{i}" for i in range(14)]
    links = sorted({(r.choice([*entities, "stranger"]), r.randrange(4 + 6 * seed)) for _ in range(40)})
    eligible = spark.createDataFrame([(e,) for e in entities], "entity string")
    joint = spark.createDataFrame(links, "entity string, link long")
    known = S.seeds(eligible, joint, 3)
    order = [x["entity"] for x in S.seed_order(eligible, joint, 3).collect()]
    want = greedy(order, links, 9)
    for held in (100, 0):
        assert [x["entity"] for x in S.connected_selection(known, joint, 9, held).orderBy("position").collect()] == want
    place = {e: i for i, e in enumerate(order)}
    own = [(place[e], x) for e, x in links if e in place]
    numbers = S.pick_connected(np.array([a for a, _ in own]), np.array([b for _, b in own]), len(order), 99)
    assert [order[i] for i in numbers] == greedy(order, links, 99)


def test_no_links(spark):
    eligible = spark.createDataFrame([("a",), ("b",)], "entity string")
    none = spark.createDataFrame([], "entity string, link long")
    for held in (10, 0):
        assert S.connected_selection(S.seeds(eligible, none, 0), none, 5, held).count() == 2


def test_checks_fail(spark):
    loan = spark.createDataFrame([(4, 1), (4, 2), (6, None), (8, 2)], "reader long, book long")
    book = spark.createDataFrame([(1,), (1,), (2,)], "isbn long")
    reader = spark.createDataFrame([(4,), (5,)], "card long")
    keys, links = {"book": "isbn", "reader": "card"}, [("book", "book"), ("reader", "reader")]
    failed = lambda t, n=9: {r["name"]: r["detail"] for r in V.checks(t, "loan", keys, links, n).where("not passed").collect()}
    assert failed({"loan": loan, "book": book, "reader": reader}, 3) == {"loan has at most 3 rows": "4 rows", "book.isbn is unique": "1 duplicate values", "loan.reader -> reader.card": "2 rows without a match"}
    assert set(failed({"loan": loan, "book": None, "reader": reader.union(spark.createDataFrame([(6,), (8,)], "c long"))})) == {"table book exists"}
    assert V.rows_per_key(loan, "book").first() == (1, 1.5, 1.5, 2)


@pytest.mark.parametrize("block", [2, 1024])
def test_overlap(spark, block, monkeypatch):
    r = random.Random(8)
    rows = sorted({(r.randrange(12), r.choice([0, 0, 0, *range(1, 9)])) for _ in range(60)})
    links = spark.createDataFrame(rows, "entity long, link long")
    of = {e: {x for y, x in rows if y == e} for e, _ in rows}
    want = {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b]}
    assert {(x[0], x[1]): x[2] for x in V.overlap_pairs(links, block).collect()} == want
    one = V.overlap_summary(links, "entity", "link").first()
    jaccard = [n / len(of[a] | of[b]) for (a, b), n in want.items()]
    assert (one["pairs"], one["shared_median"], one["shared_max"], one["entities"]) == (len(want), np.median(list(want.values())), max(want.values()), len(of))
    assert one["jaccard_median"] == pytest.approx(np.median(jaccard)) and one["shared_avg"] == pytest.approx(np.mean(list(want.values())))
    none = V.overlap_summary(links.where("entity = 3"), "entity", "link").first()
    assert none["pairs"] == 0 and none["shared_median"] is None and none["pair_fraction"] == 0


def test_candidates(spark, dataset):
    got = {r["candidate_id"] for r in C.enumerate_candidates(dataset).collect()}
    want = set()
    for root in ("loan", "book", "reader"):
        for path in [[root], *walks(dataset.manifest, 2, root)]:
            where = ">".join(path)
            want |= {f"relationship:{root}:{where}"} if len(path) > 1 else set()
            want |= {f"attribute:{root}:{where}:{path[-1]}.{c}" for c in {"loan": ["taken"], "book": ["name"], "reader": []}[path[-1]]}
    assert got == want
    assert C.enumerate_candidates(dataset, ["book"], 0, include_structural=True).count() == 2
    assert "- reader: (no candidate attributes)" in C.schema_text(C.enumerate_candidates(dataset), dataset.manifest)
    for bad in ({"max_hops": -1}, {"source_tables": ["x"]}):
        with pytest.raises(ValueError):
            C.enumerate_candidates(dataset, **bad)


def test_relevance_log_odds(spark):
    from pyspark.sql import functions as F

    from relweave.functions.scalars import relevance_log_odds

    odds = lambda rows: [r[0] for r in spark.createDataFrame(rows, "z array<double>").select(relevance_log_odds(F.col("z"))).collect()]
    assert odds([([2.0],), ([1.0, 4.0],)]) == [2.0, 3.0]
    with pytest.raises(PySparkException):
        odds([([1.0, 2.0, 3.0],)])
