"""The query catalogue: each query over the operators, and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.scalars import provenance, seeded_order
from relweave.operators import agreement as A
from relweave.operators import candidates as C
from relweave.operators import evaluation as E
from relweave.operators import graph as G
from relweave.operators import labels as L
from relweave.operators import metrics as M
from relweave.operators import sampling as S
from relweave.operators import search as N
from relweave.operators import validate as V
from relweave.sources.dataset import RelationalDataset
from relweave.sources.manifest import parse_manifest
from relweave.streaming.upsert import event_counts

#: The star of the test tables.
STAR = parse_manifest({
    "name": "star",
    "tables": {
        "lineitem": {"pkey": None, "time_col": "l_shipdate", "fkeys": {"l_partkey": "part", "l_orderkey": "orders", "l_suppkey": "supplier"}},
        "part": {"pkey": "p_partkey"},
        "orders": {"pkey": "o_orderkey", "time_col": "o_orderdate"},
        "supplier": {"pkey": "s_suppkey"},
    },
})
SEED, LEAST, LIMIT, MOST = 0, 20, 50, 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function as a query by its name, with the SQL to hold it against."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def star(spark: SparkSession, sf: str) -> RelationalDataset:
    return RelationalDataset(spark, STAR, sf)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


# --- statistics and checks of the star


@query("""SELECT min(n) n_min, median(n) n_median, round(avg(n), 6) n_avg, max(n) n_max
FROM (SELECT count(*) n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey)""")
def rows_per_key_part(spark, sf):
    return rounded(V.rows_per_key(table(spark, sf, "lineitem"), "l_partkey"), "n_avg")


@query(" UNION ALL ".join(f"SELECT '{t}' table_name, count(*) n_rows FROM {t}" for t in STAR.tables))
def table_counts(spark, sf):
    d = star(spark, sf)
    return V.row_counts({t: d.table(t) for t in d.table_names()})


@query(" UNION ALL ".join(
    f"SELECT '{t.name}' table_name, '{t.primary_key}' key_column, count({t.primary_key}) non_null, count(DISTINCT {t.primary_key}) n_distinct, count({t.primary_key}) - count(DISTINCT {t.primary_key}) duplicates FROM {t.name}"
    for t in STAR.tables.values() if t.primary_key))
def pk_uniqueness(spark, sf):
    d, out = star(spark, sf), None
    for t in STAR.tables.values():
        if t.primary_key:
            one = V.key_uniqueness(d.table(t.name), t.name, t.primary_key)
            out = one if out is None else out.union(one)
    return out


@query(" UNION ALL ".join(
    f"SELECT '{k.column}' fk, count(*) dangling FROM lineitem s WHERE s.{k.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.target_table} t WHERE t.{k.target_column} = s.{k.column})"
    for _, k in STAR.foreign_keys()))
def fk_dangling(spark, sf):
    d, out = star(spark, sf), None
    for source, k in STAR.foreign_keys():
        one = V.dangling_rows(d.table(source), k.column, d.table(k.target_table), k.target_column).agg(F.count("*").alias("dangling")).select(F.lit(k.column).alias("fk"), "dangling")
        out = one if out is None else out.union(one)
    return out


def checks_sql(most: int) -> str:
    out = [f"SELECT 'table {t} exists' AS name, true AS passed, '' AS detail" for t in STAR.tables]
    out += [f"SELECT 'table {t} is not empty', (SELECT count(*) > 0 FROM {t}), ''" for t in STAR.tables]
    out.append(f"SELECT 'lineitem has at most {most:,} rows', count(*) <= {most}, format('{{:,}}', count(*)) || ' rows' FROM lineitem")
    out += [f"SELECT '{t.name}.{t.primary_key} is unique', count({t.primary_key}) = count(DISTINCT {t.primary_key}), '' FROM {t.name}" for t in STAR.tables.values() if t.primary_key]
    out += [f"SELECT 'lineitem.{k.column} -> {k.target_table}.{k.target_column}', count(*) = 0, '' FROM lineitem WHERE {k.column} NOT IN (SELECT {k.target_column} FROM {k.target_table})" for _, k in STAR.foreign_keys()]
    return " UNION ALL ".join(out)


@query(checks_sql(1000))
def subset_checks(spark, sf):
    d = star(spark, sf)
    keys = {t.name: t.primary_key for t in STAR.tables.values() if t.primary_key}
    return V.checks({t: d.table(t) for t in d.table_names()}, "lineitem", keys, [(k.column, k.target_table) for _, k in STAR.foreign_keys()], 1000)


@query("SELECT min(l_shipdate) t_min, max(l_shipdate) t_max FROM lineitem")
def fact_time_range(spark, sf):
    return V.time_range(table(spark, sf, "lineitem"), "l_shipdate")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 7")
def entity_rows(spark, sf):
    return star(spark, sf).rows("part", "p_partkey", 7).select("p_partkey", "p_name", "p_brand")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey = 7")
def rows_by_fk(spark, sf):
    return star(spark, sf).rows("lineitem", "l_partkey", 7).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


LINKS = "links AS (SELECT DISTINCT l_partkey entity, l_orderkey link FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL)"
PAIRS = f"{LINKS}, pairs AS (SELECT a.entity left_entity, b.entity right_entity, count(*) shared FROM links a JOIN links b ON a.link = b.link AND a.entity < b.entity GROUP BY ALL)"


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def overlap_pairs(spark, sf):
    return V.overlap_pairs(V.entity_links(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey"))


@query(f"""WITH {PAIRS}, sizes AS (SELECT entity, count(*) n FROM links GROUP BY entity),
s AS (SELECT count(*) pairs, median(shared) shared_median, round(avg(shared), 6) shared_avg, max(shared) shared_max, round(median(shared / (f.n + g.n - shared)), 6) jaccard_median
 FROM pairs JOIN sizes f ON f.entity = left_entity JOIN sizes g ON g.entity = right_entity),
e AS (SELECT count(DISTINCT l_partkey) entities FROM lineitem)
SELECT s.*, (SELECT count(*) FROM (SELECT left_entity FROM pairs UNION SELECT right_entity FROM pairs)) connected,
 (SELECT count(*) FROM (SELECT link FROM links GROUP BY link HAVING count(*) >= 2)) bridging, e.entities,
 round(CASE WHEN entities > 1 THEN pairs / (entities * (entities - 1) / 2) ELSE 0 END, 6) pair_fraction FROM s, e""")
def overlap_summary(spark, sf):
    got = V.overlap_summary(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")
    return rounded(got, "shared_avg", "jaccard_median", "pair_fraction")


@query(f"WITH {LINKS} SELECT link, count(*) n_entities FROM links GROUP BY link HAVING count(*) >= 2")
def bridging_links(spark, sf):
    return V.bridging_links(V.entity_links(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey"))


# --- sampling


def pool(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("link"), "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")


ELIGIBLE = f"eligible AS (SELECT l_partkey entity, count(*) n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey HAVING count(*) >= {LEAST})"
CHOSEN = f"{ELIGIBLE}, chosen AS (SELECT entity FROM eligible ORDER BY md5_number(concat({SEED}, ':', entity)), entity LIMIT {LIMIT})"
POOL = "pool AS (SELECT l_partkey entity, l_orderkey link, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"
ROW_ORDER = f"md5_number(concat({SEED}, ':', link, ':', l_linenumber, ':', l_suppkey)), link, l_linenumber, l_suppkey, l_quantity, l_extendedprice"


def row_order():
    return [seeded_order(SEED, F.col("link"), F.col("l_linenumber"), F.col("l_suppkey")), *map(F.col, ("link", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))]


@query(f"WITH {ELIGIBLE} SELECT entity, n FROM eligible")
def eligible_entities(spark, sf):
    return S.eligible_entities(pool(spark, sf), LEAST)


@query(f"WITH {CHOSEN} SELECT entity FROM chosen")
def sample_entities(spark, sf):
    return S.sample_entities(S.eligible_entities(pool(spark, sf), LEAST), SEED, LIMIT)


@query(f"WITH {CHOSEN}, {POOL} SELECT entity, link, l_linenumber, l_suppkey, l_quantity FROM pool WHERE entity IN (SELECT entity FROM chosen) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY {ROW_ORDER}) <= {MOST}")
def sample_rows(spark, sf):
    p = pool(spark, sf)
    chosen = S.sample_entities(S.eligible_entities(p, LEAST), SEED, LIMIT)
    return S.cap_rows(p, chosen, MOST, row_order()).select("entity", "link", "l_linenumber", "l_suppkey", "l_quantity")


SHARED = "shared AS (SELECT link FROM pool WHERE link IS NOT NULL AND entity IN (SELECT entity FROM chosen) GROUP BY link HAVING count(DISTINCT entity) >= 2)"


@query(f"""WITH {CHOSEN}, {POOL}, {SHARED} SELECT p.entity, p.link, l_linenumber, l_suppkey, (s.link IS NULL)::INT alone FROM pool p LEFT JOIN shared s ON p.link = s.link
WHERE p.entity IN (SELECT entity FROM chosen) QUALIFY row_number() OVER (PARTITION BY p.entity ORDER BY s.link IS NULL, {ROW_ORDER.replace("':', link", "':', p.link").replace(", link,", ", p.link,")}) <= {MOST}""")
def shared_first_truncation(spark, sf):
    p = pool(spark, sf)
    chosen = S.sample_entities(S.eligible_entities(p, LEAST), SEED, LIMIT)
    flagged = S.shared_first(p, S.shared_links(p, chosen))
    return S.cap_rows(flagged, chosen, MOST, [F.col("alone"), *row_order()]).select("entity", "link", "l_linenumber", "l_suppkey", "alone")


BRIDGES = f"{ELIGIBLE}, b AS (SELECT DISTINCT l_partkey entity, l_orderkey link FROM lineitem WHERE l_partkey IN (SELECT entity FROM eligible) AND l_orderkey IS NOT NULL), bridges AS (SELECT entity, link FROM b QUALIFY count(*) OVER (PARTITION BY link) >= 2)"


@query(f"WITH {BRIDGES} SELECT entity, link FROM bridges")
def bridges(spark, sf):
    p = pool(spark, sf)
    return S.bridges(p, S.eligible_entities(p, LEAST))


@query(f"""WITH {BRIDGES}, c AS (SELECT entity, count(*) k FROM bridges GROUP BY entity)
SELECT entity, coalesce(k, 0) n_links, row_number() OVER (ORDER BY coalesce(k, 0) DESC, md5_number(concat({SEED}, ':', entity)), entity) place FROM eligible LEFT JOIN c USING (entity)""")
def seed_order(spark, sf):
    p = pool(spark, sf)
    eligible = S.eligible_entities(p, LEAST)
    order = S.seed_order(eligible, S.bridges(p, eligible), SEED)
    return order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)).toDF("entity long, n_links long, place long")


def greedy_sql(limit: int) -> str:
    """A step for each pick: most links that picked entities have, then the place in seed order."""
    steps = [f"""place AS MATERIALIZED (SELECT entity, row_number() OVER (ORDER BY coalesce(k, 0) DESC, md5_number(concat({SEED}, ':', entity)), entity) place
 FROM eligible LEFT JOIN (SELECT entity, count(*) k FROM bridges GROUP BY entity) USING (entity)), s0 AS MATERIALIZED (SELECT 0 AS position, entity FROM place WHERE place = 1)"""]
    for i in range(1, limit):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL (SELECT {i}, entity FROM place LEFT JOIN (SELECT entity, count(*) n FROM bridges
 WHERE link IN (SELECT link FROM bridges WHERE entity IN (SELECT entity FROM s{i - 1})) GROUP BY entity) USING (entity) WHERE entity NOT IN (SELECT entity FROM s{i - 1}) ORDER BY coalesce(n, 0) DESC, place LIMIT 1))""")
    return ", ".join(steps)


@query(f"WITH {BRIDGES.replace('bridges AS (', 'bridges AS MATERIALIZED (')}, {greedy_sql(LIMIT)} SELECT position, entity FROM s{LIMIT - 1}")
def connected_selection(spark, sf):
    p = pool(spark, sf)
    eligible = S.eligible_entities(p, LEAST)
    joint = S.bridges(p, eligible)
    return S.connected_selection(S.seeds(eligible, joint, SEED), joint, LIMIT)


@query(f"WITH {CHOSEN} SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (SELECT entity FROM chosen)")
def closed_dimension_part(spark, sf):
    p = pool(spark, sf)
    chosen = S.sample_entities(S.eligible_entities(p, LEAST), SEED, LIMIT).withColumnRenamed("entity", "l_partkey")
    return S.closed_dimension(table(spark, sf, "part"), "p_partkey", chosen, ["l_partkey"]).select("p_partkey", "p_name", "p_brand")


# --- schema graph and candidates

EDGES = "e(ord, src, tgt) AS (VALUES " + ", ".join(f"({i}, '{s}', '{k.target_table}')" for i, (s, k) in enumerate(STAR.foreign_keys())) + ")"
STEPS = f"{EDGES}, n AS (SELECT src a, tgt b, ord FROM e UNION ALL SELECT tgt, src, ord FROM e), step AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY ord) pos FROM n)"
PATHS = f"""{STEPS}, p(root, path, hops) AS (SELECT DISTINCT a, [a], 0 FROM step UNION ALL SELECT root, list_append(path, b), hops + 1 FROM p JOIN step ON path[-1] = a WHERE hops < 2 AND NOT list_contains(path, b))"""


@query(f"WITH {STEPS} SELECT a table_name, b neighbor, pos::INT AS position FROM step")
def schema_neighbors(spark, sf):
    return G.neighbors(G.edges(spark, STAR))


@query(f"WITH {EDGES} SELECT src source_table, tgt target_table FROM e WHERE src IN ('part', 'lineitem') AND tgt IN ('part', 'lineitem')")
def schema_relationships(spark, sf):
    return G.relationships(G.edges(spark, STAR), "part", "lineitem").select("source_table", "target_table")


@query(f"WITH RECURSIVE {PATHS} SELECT root, array_to_string(path, '>') path, hops FROM p WHERE hops > 0")
def schema_paths(spark, sf):
    return G.paths(G.edges(spark, STAR), 2).select("root", F.concat_ws(">", "path").alias("path"), "hops")


COLUMNS = "cols(t, c) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in {
    "lineitem": "l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "part": "p_name p_brand p_type p_size p_retailprice",
    "orders": "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "supplier": "s_name s_nationkey s_acctbal"}.items() for c in cs.split()) + ")"
SIGNALS = f"""{PATHS}, {COLUMNS}, signals AS (SELECT 'attribute:' || root || ':' || array_to_string(path, '>') || ':' || t || '.' || c AS candidate_id, 'attribute' AS kind, root, path, hops, t, c FROM p JOIN cols ON path[-1] = t
UNION ALL SELECT 'relationship:' || root || ':' || array_to_string(path, '>'), 'relationship', root, path, hops, NULL, NULL FROM p WHERE hops > 0)"""


@query(f"WITH RECURSIVE {SIGNALS} SELECT candidate_id, kind, root, hops, t attribute_table, c attribute_column FROM signals")
def signal_candidates(spark, sf):
    return C.enumerate_candidates(star(spark, sf)).select("candidate_id", "kind", "root", "hops", "attribute_table", "attribute_column")


@query(f"WITH RECURSIVE {SIGNALS} SELECT sha256(string_agg(candidate_id, chr(10) ORDER BY candidate_id)) fingerprint, count(*) n FROM signals")
def candidate_fingerprint(spark, sf):
    return C.fingerprint(C.enumerate_candidates(star(spark, sf)))


@query(f"""WITH RECURSIVE {SIGNALS}, k AS (SELECT CASE WHEN kind = 'attribute' THEN 'attribute|' || t || '.' || c ELSE 'relationship|' || array_to_string(list_sort(list_transform(range(1, len(path)), lambda i: array_to_string(list_sort(path[i:i+1]), '~'))), ',') END AS key FROM signals)
SELECT key, count(*) n FROM k GROUP BY key""")
def provenance_keys(spark, sf):
    key = provenance(F.col("kind"), F.col("path"), F.col("attribute_table"), F.col("attribute_column"))
    return C.enumerate_candidates(star(spark, sf)).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {STEPS} SELECT a root, count(*) n FROM step GROUP BY a")
def neighbor_counts(spark, sf):
    return G.neighbors(G.edges(spark, STAR)).groupBy(F.col("table_name").alias("root")).agg(F.count("*").alias("n"))


# --- labels

JUDGED = "j AS (SELECT l.doc_id, d.lang, CASE WHEN l.doc_id % 3 = 0 THEN 'judged' WHEN l.doc_id % 3 = 1 THEN 'unable_to_judge' ELSE 'invalid_response' END AS status FROM labels l JOIN documents d USING (doc_id))"


def judged(spark, sf):
    m = F.col("doc_id") % 3
    status = F.when(m == 0, "judged").when(m == 1, "unable_to_judge").otherwise("invalid_response")
    return table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("status", status)


@query(f"WITH {JUDGED} SELECT c.lang, k.doc_id FROM (SELECT DISTINCT lang FROM documents) c CROSS JOIN labels k WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.lang = c.lang AND j.doc_id = k.doc_id AND status IN ('judged', 'unable_to_judge'))")
def judge_tasks_pending(spark, sf):
    conditions = table(spark, sf, "documents").select("lang").distinct()
    return L.pending(conditions, table(spark, sf, "labels").select("doc_id"), judged(spark, sf), ["lang", "doc_id"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def keyed_upsert_latest(spark, sf):
    return L.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND CAST(props->>'k' AS INT) BETWEEN 0 AND 3 THEN 'judged' WHEN event_id % 4 = 2 THEN 'unable_to_judge' ELSE 'invalid_response' END AS status,
CASE WHEN event_id % 4 = 0 AND CAST(props->>'k' AS INT) BETWEEN 0 AND 3 THEN CAST(props->>'k' AS DOUBLE) END AS grade FROM events""")
def strict_json_grade(spark, sf):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('```json\n{"status": "judged", "grade": '), k, F.lit(', "reason": " because "}\n```')))
    raw = raw.when(kind == 1, F.concat(F.lit('{"status": "judged", "grade": "'), k, F.lit('", "reason": "as text"}'))).when(kind == 2, F.lit('{"status": "unable_to_judge", "grade": null, "reason": "unclear"}')).otherwise("not json")
    return L.parse_judgment(table(spark, sf, "events").select("event_id", raw.alias("raw"))).select("event_id", "status", F.col("grade").cast("double").alias("grade"))


@query(f"WITH {JUDGED} SELECT lang, count(*) FILTER (status = 'judged') judged, count(*) FILTER (status = 'unable_to_judge') unable_to_judge, count(*) FILTER (status = 'invalid_response') invalid_response, count(*) total FROM j GROUP BY lang")
def status_pivot(spark, sf):
    got = judged(spark, sf).groupBy("lang").pivot("status", ["judged", "unable_to_judge", "invalid_response"]).count().na.fill(0)
    return got.withColumn("total", F.col("judged") + F.col("unable_to_judge") + F.col("invalid_response"))


# --- ranking metrics: conditions are languages, candidates documents

QRELS = "q AS (SELECT d.lang cond, d.doc_id cand, 2 * l.quality + 1 - l.toxic AS grade FROM labels l JOIN documents d USING (doc_id))"
RANKED = f"{QRELS}, r AS (SELECT lang cond, doc_id cand, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"
RG = f"{RANKED}, g AS (SELECT r.cond, r.cand, rank, coalesce(grade, 0) grade FROM r LEFT JOIN q ON q.cond = r.cond AND q.cand = r.cand), ks(k) AS (VALUES (1), (3), (5), (10))"


def qrels(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return table(spark, sf, "documents").select(F.col("lang").alias("cond"), "doc_id").join(labels, "doc_id").withColumnRenamed("doc_id", "cand")


def ranking(spark, sf):
    return M.ranked(table(spark, sf, "documents").select(F.col("lang").alias("cond"), F.col("doc_id").alias("cand"), F.col("n_chars").alias("score")))


@query(f"""WITH {RG}, own AS (SELECT cond, k, sum((pow(2, grade) - 1) / log2(rank + 1)) v FROM g, ks WHERE rank <= k GROUP BY cond, k),
i AS (SELECT cond, grade, row_number() OVER (PARTITION BY cond ORDER BY grade DESC) rank FROM q), best AS (SELECT cond, k, sum((pow(2, grade) - 1) / log2(rank + 1)) v FROM i, ks WHERE rank <= k GROUP BY cond, k)
SELECT best.cond, best.k, round(CASE WHEN best.v = 0 THEN 0 ELSE coalesce(own.v, 0) / best.v END, 6) ndcg FROM best LEFT JOIN own USING (cond, k)""")
def ndcg_at_k(spark, sf):
    return rounded(M.ndcg(ranking(spark, sf), qrels(spark, sf)), "ndcg")


@query(f"""WITH {RG}, n AS (SELECT cond, sum((grade >= 3)::INT) n FROM q GROUP BY cond)
SELECT cond, k, round(CASE WHEN n = 0 THEN 0 ELSE sum((rank <= k AND grade >= 3)::INT) / n END, 6) recall FROM g JOIN n USING (cond), ks GROUP BY cond, k, n""")
def recall_at_k(spark, sf):
    return rounded(M.recall(ranking(spark, sf), qrels(spark, sf)), "recall")


@query(f"WITH {RG} SELECT cond, k, round(avg((grade >= 2)::INT), 6) AS precision FROM g, ks WHERE rank <= k GROUP BY cond, k")
def precision_at_k(spark, sf):
    return rounded(M.precision(ranking(spark, sf), qrels(spark, sf)), "precision")


@query(f"WITH {RG} SELECT cond, round(coalesce(1 / min(rank) FILTER (grade >= 3), 0), 6) mrr FROM g GROUP BY cond")
def mrr(spark, sf):
    return rounded(M.mrr(ranking(spark, sf), qrels(spark, sf)), "mrr")


@query(f"""WITH {RANKED} SELECT r.cond, r.cand, (row_number() OVER (PARTITION BY r.cond ORDER BY rank))::INT AS rank FROM r WHERE EXISTS (SELECT 1 FROM q WHERE q.cond = r.cond AND q.cand = r.cand)""")
def condensed_ranking(spark, sf):
    return M.condensed(ranking(spark, sf), qrels(spark, sf)).select("cond", "cand", "rank")


@query(f"""WITH {RANKED}, keys AS (SELECT doc_id cand, source AS key FROM documents), sq AS (SELECT cond, key, max(grade) grade FROM q JOIN keys USING (cand) GROUP BY cond, key),
f AS (SELECT cond, key, rank FROM r JOIN keys USING (cand) QUALIFY row_number() OVER (PARTITION BY cond, key ORDER BY rank) = 1),
n AS (SELECT cond, sum((grade >= 3)::INT) n FROM sq GROUP BY cond), ks(k) AS (VALUES (1), (3), (5), (10))
SELECT n.cond, k, round(CASE WHEN n = 0 THEN 0 ELSE coalesce(sum((rank <= k AND grade >= 3)::INT), 0) / n END, 6) recall FROM n CROSS JOIN ks LEFT JOIN (SELECT f.cond, rank, grade FROM f JOIN sq ON f.cond = sq.cond AND f.key = sq.key) h ON h.cond = n.cond GROUP BY n.cond, k, n""")
def soft_metrics(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("cand"), F.col("source").alias("key"))
    rows, of_key = M.soft(ranking(spark, sf), qrels(spark, sf), keys)
    return rounded(M.recall(rows, of_key), "recall")


@query(SQL["precision_at_k"].replace("SELECT cond, k, round(avg((grade >= 2)::INT), 6) AS precision FROM g, ks WHERE rank <= k GROUP BY cond, k", "SELECT k, round(avg(p), 6) avg_precision, count(*) n_conditions FROM (SELECT cond, k, avg((grade >= 2)::INT) p FROM g, ks WHERE rank <= k GROUP BY cond, k) GROUP BY k"))
def macro_average(spark, sf):
    return rounded(M.macro_average(M.precision(ranking(spark, sf), qrels(spark, sf)), "precision", ["k"]), "avg_precision")


@query(f"WITH {JUDGED} SELECT lang cond, count(*) expected, sum((status = 'judged')::INT)::BIGINT judged, round(avg((status = 'judged')::INT), 6) coverage FROM j GROUP BY lang")
def qrel_coverage(spark, sf):
    rows = judged(spark, sf).select(F.col("lang").alias("cond"), F.col("doc_id").alias("cand"), "status", F.lit(1).alias("grade"))
    return rounded(M.coverage(rows), "coverage")


# --- agreement: three raters of the labelled documents

JUDGES = """j AS (SELECT doc_id AS pair, 'J1' AS model, 2 * quality + 1 - toxic AS grade FROM labels UNION ALL SELECT doc_id, 'J2', (n_chars % 4)::INT FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'J3', ((7 * doc_id + n_chars) % 4)::INT FROM labels JOIN documents USING (doc_id))"""
GRADE_PAIRS = f"{JUDGES}, p AS (SELECT a.pair, a.model model_a, b.model model_b, a.grade ga, b.grade gb FROM j a JOIN j b ON a.pair = b.pair AND a.model < b.model)"


def judges(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    grades = {"J1": 2 * F.col("quality") + 1 - F.col("toxic"), "J2": F.col("n_chars") % 4, "J3": (7 * F.col("doc_id") + F.col("n_chars")) % 4}
    stacked = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), g.cast("int").alias("grade")) for m, g in grades.items())))
    return rows.select(F.col("doc_id").alias("pair"), stacked.alias("x")).select("pair", "x.model", "x.grade")


@query(f"WITH {JUDGES} SELECT model, count(*) FILTER (grade = 0) g0, count(*) FILTER (grade = 1) g1, count(*) FILTER (grade = 2) g2, count(*) FILTER (grade = 3) g3, round(avg(grade), 6) mean_grade FROM j GROUP BY model")
def grade_distribution(spark, sf):
    j = judges(spark, sf)
    n = [F.sum((F.col("grade") == g).cast("long")).alias(f"g{g}") for g in A.GRADES]
    return rounded(j.groupBy("model").agg(*n, F.avg("grade").alias("mean_grade")), "mean_grade")


def kappa_sql(power: int) -> str:
    w = f"pow(abs(x.ga - y.gb) / 3, {power})"
    return f"""WITH {GRADE_PAIRS}, n AS (SELECT model_a, model_b, count(*) n, sum(pow(abs(ga - gb) / 3, {power})) o FROM p GROUP BY ALL),
x AS (SELECT model_a, model_b, ga, count(*) c FROM p GROUP BY ALL), y AS (SELECT model_a, model_b, gb, count(*) c FROM p GROUP BY ALL),
e AS (SELECT x.model_a, x.model_b, sum(x.c * y.c * {w}) e FROM x JOIN y ON x.model_a = y.model_a AND x.model_b = y.model_b GROUP BY ALL)
SELECT n.model_a, n.model_b, n.n, round(1 - o / (e / n.n), 6) kappa FROM n JOIN e ON n.model_a = e.model_a AND n.model_b = e.model_b"""


@query(kappa_sql(1))
def linear_kappa(spark, sf):
    return rounded(A.kappa(A.model_pairs(judges(spark, sf)), 1), "kappa")


@query(kappa_sql(2))
def quadratic_kappa(spark, sf):
    return rounded(A.kappa(A.model_pairs(judges(spark, sf)), 2), "kappa")


AGREE = f"{GRADE_PAIRS}, a AS (SELECT model_a, model_b, count(*) n, avg((ga = gb)::INT) exact, avg(((ga >= 2) = (gb >= 2))::INT) AS binary, avg(abs(ga - gb)) gap FROM p GROUP BY ALL)"


@query(f"WITH {AGREE} SELECT model_a, model_b, n, round(exact, 6) exact, round(a.binary, 6) AS binary, round(gap, 6) gap FROM a")
def pairwise_agreement(spark, sf):
    return rounded(A.pairwise(A.model_pairs(judges(spark, sf))), "exact", "binary", "gap")


@query(f"WITH {AGREE}, b AS (SELECT model_a model, exact FROM a UNION ALL SELECT model_b, exact FROM a), m AS (SELECT model, avg(exact) mean FROM b GROUP BY model) SELECT model, round(mean, 6) mean, row_number() OVER (ORDER BY mean DESC, model)::INT place FROM m")
def peer_summary(spark, sf):
    return rounded(A.peers(A.pairwise(A.model_pairs(judges(spark, sf))), "exact"), "mean")


@query(f"WITH {JUDGES} SELECT pair, count(*) n, min(grade) low, max(grade) high FROM j GROUP BY pair HAVING count(*) >= 2 AND max(grade) - min(grade) = 3")
def max_gap_disagreements(spark, sf):
    return A.widest_gaps(judges(spark, sf))


CONSENSUS = f"""{JUDGES}, v AS (SELECT pair, grade, count(*) v FROM j GROUP BY ALL), t AS (SELECT pair, sum(v)::BIGINT n, max(v) most, arg_max(grade, v * 10 + grade) AS top FROM v GROUP BY pair),
d AS (SELECT pair, g, sum(abs(grade - g)) far FROM j, (VALUES (0), (1), (2), (3)) gs(g) GROUP BY pair, g),
m AS (SELECT pair, min(g) g, count(*) ties FROM (SELECT *, min(far) OVER (PARTITION BY pair) least FROM d) WHERE far = least GROUP BY pair),
c AS (SELECT pair, n, CASE WHEN most * 2 > n THEN top WHEN ties = 1 THEN g END AS grade, CASE WHEN most * 2 > n THEN 'majority' WHEN ties = 1 THEN 'ordinal' ELSE 'unresolved' END AS how FROM t JOIN m USING (pair))"""


@query(f"WITH {CONSENSUS} SELECT c.pair, n, c.grade, how, coalesce(v.v, 0) support FROM c LEFT JOIN v ON v.pair = c.pair AND v.grade = c.grade")
def ordinal_consensus(spark, sf):
    return A.consensus(judges(spark, sf))


@query(f"WITH {CONSENSUS} SELECT model, count(*) n, round(avg((j.grade = c.grade)::INT), 6) exact, round(avg(abs(j.grade - c.grade)), 6) gap FROM j JOIN c ON j.pair = c.pair WHERE c.grade IS NOT NULL GROUP BY model")
def model_vs_consensus(spark, sf):
    j = judges(spark, sf)
    return rounded(A.against_consensus(j, A.consensus(j)), "exact", "gap")


# --- method comparison: conditions are event types, candidates users

WEIGHTS = "w AS (SELECT event_type cond, user_id cand, 'A' AS method, count(*)::DOUBLE w FROM events GROUP BY ALL UNION ALL SELECT event_type, user_id, 'B', round(sum(value), 4) FROM events GROUP BY ALL)"
BOTH = "s AS (SELECT a.cond, a.cand, greatest(a.w, 0) p, greatest(b.w, 0) q FROM w a JOIN w b ON a.cond = b.cond AND a.cand = b.cand WHERE a.method = 'A' AND b.method = 'B')"
RERANK = f"{WEIGHTS}, r AS (SELECT cond, cand, method, row_number() OVER (PARTITION BY cond, method ORDER BY w DESC, cand) AS rank FROM w)"


def weights(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("cond"), F.col("user_id").alias("cand")).agg(F.count("*").cast("double").alias("A"), F.round(F.sum("value"), 4).alias("B"))
    return g.unpivot(["cond", "cand"], ["A", "B"], "method", "w")


@query(f"""WITH {WEIGHTS}, {BOTH}, n AS (SELECT cond, p / sum(p) OVER (PARTITION BY cond) p, q / sum(q) OVER (PARTITION BY cond) q FROM s)
SELECT cond, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) jsd, round(sum(least(p, q)), 6) shared_mass, count(*) n FROM n GROUP BY cond""")
def jsd_shared_mass(spark, sf):
    return rounded(A.divergence(weights(spark, sf), "A", "B"), "jsd", "shared_mass")


SPEARMAN = f"{RERANK}, k AS (SELECT cond, a.rank ra, b.rank rb FROM r a JOIN r b USING (cond, cand) WHERE a.method = 'A' AND b.method = 'B')"


@query(f"WITH {SPEARMAN} SELECT cond, count(*) n, round(CASE WHEN count(*) > 1 THEN corr(ra, rb) END, 6) rho FROM k GROUP BY cond")
def spearman(spark, sf):
    return rounded(A.spearman(weights(spark, sf), "A", "B"), "rho")


@query(f"""WITH {RERANK}, n AS (SELECT cond, count(*) FILTER (method = 'A') na, count(*) FILTER (method = 'B') nb FROM r GROUP BY cond), ks(k) AS (VALUES (5), (10)),
h AS (SELECT a.cond, k, count(*) hits FROM r a JOIN r b ON a.cond = b.cond AND a.cand = b.cand AND a.method = 'A' AND b.method = 'B', ks WHERE a.rank <= k AND b.rank <= k GROUP BY a.cond, k)
SELECT n.cond, ks.k, round(coalesce(hits, 0) / least(ks.k, na, nb), 6) overlap FROM n CROSS JOIN ks LEFT JOIN h ON h.cond = n.cond AND h.k = ks.k""")
def topk_overlap(spark, sf):
    return rounded(A.topk_overlap(weights(spark, sf), "A", "B"), "overlap")


@query(f"WITH {RERANK} SELECT coalesce(a.cond, b.cond) cond, coalesce(a.cand, b.cand) cand, a.rank::INT rank_a, b.rank::INT rank_b FROM (SELECT * FROM r WHERE method = 'A') a FULL JOIN (SELECT * FROM r WHERE method = 'B') b ON a.cond = b.cond AND a.cand = b.cand")
def full_comparison(spark, sf):
    return A.full_comparison(weights(spark, sf), "A", "B")


@query(f"""WITH {WEIGHTS}, n AS (SELECT cond, cand, method, greatest(w, 0) / sum(greatest(w, 0)) OVER (PARTITION BY cond, method) p FROM w),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY cond, method ORDER BY p DESC, cand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM n)
SELECT cond, method, cand, round(p, 6) p FROM c WHERE before < 0.5 - 1e-9""")
def top_p_selection(spark, sf):
    return rounded(A.top_p(weights(spark, sf), 0.5 - 1e-9).select("cond", "method", "cand", "p"), "p")


@query(f"WITH {WEIGHTS} SELECT method, count(DISTINCT cand) n_distinct, round(avg(w), 6) mean, round(stddev_samp(w), 6) sd FROM w GROUP BY method")
def method_summary(spark, sf):
    got = weights(spark, sf).groupBy("method").agg(F.count_distinct("cand").alias("n_distinct"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"))
    return rounded(got, "mean", "sd")


@query(f"""WITH {WEIGHTS}, t AS (SELECT cand task, method, avg(w) v FROM w GROUP BY ALL), d AS (SELECT b.v - a.v d FROM t a JOIN t b ON a.task = b.task WHERE a.method = 'A' AND b.method = 'B')
SELECT count(*) n, round(avg(d), 6) mean_delta, count(*) FILTER (d > 1e-12) improved, count(*) FILTER (abs(d) <= 1e-12) unchanged, count(*) FILTER (d < -1e-12) regressed FROM d""")
def paired_delta(spark, sf):
    tasks = weights(spark, sf).groupBy(F.col("cand").alias("task"), "method").agg(F.avg("w").alias("v"))
    return rounded(A.paired_delta(tasks, "v", "A", "B"), "mean_delta")


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) % 2 = 0 AS kept FROM conversations)
SELECT role AS kind, count(*) n_legal, count(*) FILTER (kept) n_expanded FROM t GROUP BY role""")
def trace_explode(spark, sf):
    action = F.struct(F.col("role").alias("kind"), F.col("turn").cast("string").alias("option"))
    even = F.length("text") % 2 == 0
    steps = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.collect_list(action).alias("legal"), F.collect_list(F.when(even, action)).alias("expanded"))
    return N.trace_actions(steps.select(F.array(F.struct("legal", "expanded")).alias("trace")))


@query("SELECT cond, cand, round((('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT) / 4294967296.0, 6) score FROM (SELECT d.lang cond, l.doc_id cand, array_to_string(list_reverse(regexp_extract_all(md5(concat('0:', d.lang, ':', l.doc_id)), '..')), '') AS hx, substr(hx, 7, 2) || substr(hx, 5, 2) || substr(hx, 3, 2) || substr(hx, 1, 2) AS h FROM labels l JOIN documents d USING (doc_id))")
def random_baseline(spark, sf):
    tasks = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("cond"), F.col("doc_id").alias("cand"))
    return rounded(N.hash_scorer(tasks, 0), "score")


@query(f"""WITH {RANKED}, jq AS (SELECT q.* FROM q WHERE cand % 3 = 0), cov AS (SELECT cond, count(*) FILTER (cand % 3 = 0) / count(*) coverage FROM q GROUP BY cond HAVING count(*) FILTER (cand % 3 = 0) > 0),
c AS (SELECT r.cond, r.cand, grade, row_number() OVER (PARTITION BY r.cond ORDER BY rank) rank FROM r JOIN jq ON r.cond = jq.cond AND r.cand = jq.cand), ks(k) AS (VALUES (1), (3), (5), (10)),
n AS (SELECT cond, sum((grade >= 2)::INT) n FROM jq GROUP BY cond)
SELECT cov.cond, k, round(coverage, 6) coverage, round(CASE WHEN n = 0 THEN 0 ELSE coalesce(sum((rank <= k AND grade >= 2)::INT), 0) / n END, 6) recall, round(coalesce(avg((grade >= 2)::INT) FILTER (rank <= k), 0), 6) AS precision,
round(coalesce(1 / min(rank) FILTER (grade >= 3), 0), 6) mrr FROM cov JOIN n ON n.cond = cov.cond CROSS JOIN ks LEFT JOIN c ON c.cond = cov.cond GROUP BY cov.cond, k, coverage, n""")
def result_evaluation(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"])
    results = ranking(spark, sf).groupBy("cond").agg(ordered.alias("signals"))
    status = F.when(F.col("cand") % 3 == 0, "judged").otherwise("unable_to_judge")
    return rounded(E.evaluate_results(results, qrels(spark, sf).withColumn("status", status), True).drop("ndcg"), "coverage", "recall", "precision", "mrr")


@query("SELECT count(*) n, count(*) FILTER (event_id % 3 = 0) correct, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) accuracy, count(*) FILTER (event_id % 3 = 0 OR event_id % 5 = 0) explored_correct, round(count(*) FILTER (event_id % 3 = 0 OR event_id % 5 = 0) / count(*), 6) hit_rate FROM events")
def root_rates(spark, sf):
    own = lambda m: F.when(F.col("event_id") % m == 0, F.col("event_type")).otherwise("elsewhere")
    tasks = table(spark, sf, "events").select(F.col("event_id").alias("task"), F.col("event_type").alias("expected"), F.array(own(3), own(5)).alias("explored"))
    return rounded(E.root_rates(E.root_selection(tasks)), "accuracy", "hit_rate")


@query(f"WITH {WEIGHTS}, best AS (SELECT * FROM w QUALIFY w = max(w) OVER (PARTITION BY cond, method)) SELECT cond, max(cand) FILTER (method = 'A') AS a_top, max(cand) FILTER (method = 'B') AS b_top FROM best GROUP BY cond")
def condition_overview(spark, sf):
    return E.condition_overview(weights(spark, sf), ["A", "B"]).select("cond", F.col("A").alias("a_top"), F.col("B").alias("b_top"))


@query(f"WITH {RERANK} SELECT r.cond, r.rank::INT AS rank, r.cand, w.w score FROM r JOIN w USING (cond, cand, method) WHERE r.method = 'A' AND r.rank <= 5")
def top_signals(spark, sf):
    return E.top_signals(weights(spark, sf).where("method = 'A'").select("cond", "cand", F.col("w").alias("score")))


@query(f"WITH {WEIGHTS} SELECT cond, round(avg(w) FILTER (method = 'A'), 6) mean_a, round(avg(w) FILTER (method = 'B'), 6) mean_b FROM w GROUP BY cond")
def score_heatmap(spark, sf):
    return rounded(E.heatmap(weights(spark, sf), "cond", "method", "w", ["A", "B"]).select("cond", F.col("A").alias("mean_a"), F.col("B").alias("mean_b")), "mean_a", "mean_b")


@query("SELECT conv_id task, turn branch, CASE WHEN turn % 4 <> 0 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1) THEN turn - 1 END parent, role AS action FROM (SELECT DISTINCT conv_id, turn, min(role) OVER (PARTITION BY conv_id, turn) AS role FROM conversations) c")
def search_tree(spark, sf):
    steps = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("task"), F.col("turn").alias("branch")).agg(F.array(F.lit("start"), F.min("role")).alias("history"))
    return E.tree_links(steps.withColumn("parent", F.when(F.col("branch") % 4 != 0, F.col("branch") - 1)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) w_start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    return event_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
