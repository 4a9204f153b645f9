"""Every query of the catalogue gives the rows of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from relweave.plans import catalogue, more

QUERIES, SQL = catalogue.QUERIES | more.QUERIES, catalogue.SQL | more.SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    expected = plain(want.fetchall(), names)
    got = plain(rows, df.columns)
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert all(a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-6 for a, b in zip(g, e, strict=True)), (g, e)


@pytest.mark.parametrize("name", ["seed_order", "condensed_ranking"])
def test_no_row_is_left_out(spark, duck, name):
    from relweave.operators import sampling

    if name == "seed_order":
        every = sampling.eligible_entities(catalogue.pool(spark, SF), catalogue.LEAST).count()
    else:
        every = catalogue.ranking(spark, SF).join(catalogue.qrels(spark, SF).select("cond", "cand"), ["cond", "cand"], "left_semi").count()
    assert every and QUERIES[name](spark, SF).count() == every == duck.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0]


@pytest.fixture(scope="module")
def grouped(tmp_path_factory):
    """The tables, with lineitem in 12 row groups of 500 rows: more than the subset's configuration would choose."""
    root = tmp_path_factory.mktemp("grouped")
    for p in Path(SF).glob("*.parquet"):
        if p.stem == "lineitem":
            pq.write_table(pq.read_table(p), root / p.name, row_group_size=500)
        else:
            (root / p.name).symlink_to(p)
    return str(root)


@pytest.mark.parametrize("name", ["row_group_scan", "subset_entity_centred", "subset_overlap_aware"])
def test_every_row_group(spark, duck, grouped, name):
    """Row groups are how a file is laid out: the rows are those of the SQL over the whole table, whatever their number."""
    df = QUERIES[name](spark, grouped)
    want = duck.execute(SQL[name])
    expected = plain(want.fetchall(), [c[0] for c in want.description])
    assert plain([tuple(r) for r in df.collect()], df.columns) == expected


def test_sizes_of_row_groups(spark, duck, grouped):
    """Several row groups are several rows, as the footer has them; together they are the rows that the SQL counts."""
    footer = duck.execute(f"SELECT row_group_id, any_value(row_group_num_rows) FROM parquet_metadata('{grouped}/lineitem.parquet') GROUP BY ALL ORDER BY ALL").fetchall()
    got = [tuple(r) for r in QUERIES["row_group_sizes"](spark, grouped).orderBy("row_group").collect()]
    assert len(got) == 12 and [r[:2] for r in got] == footer and [r[2] for r in got] == list(range(0, 6000, 500))
    assert sum(r[1] for r in got) == duck.execute(SQL["row_group_sizes"]).fetchone()[1]
