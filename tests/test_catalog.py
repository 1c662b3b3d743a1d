"""Every query of the catalog against its SQL on the smallest tables."""

import decimal

import pytest

from millrace import catalog

from .conftest import DATA


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return format(round(float(v), 6) + 0.0, ".6f")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(v[i]) for i in order] for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    if name in catalog.ORACLES:
        r = duck.sql(catalog.ORACLES[name])
        assert got == rows(r.columns, r.fetchall())


def test_components_of_the_graph(spark):
    from millrace.operators import graph
    from millrace.sources import relations as rel

    edges, nodes = rel.kg_edges(spark, str(DATA)), rel.kg_nodes(spark, str(DATA))
    parent = {r[0]: r[0] for r in nodes.select("id").collect()}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges.select("src", "dst").collect():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {r["id"]: r["component"] for r in graph.components(edges, nodes).collect()} == {x: root(x) for x in list(parent)}


def test_shortest_paths_have_no_bound(spark):
    from millrace.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n0"), ("n0", "n2")], "src string, dst string")
    ids = spark.createDataFrame([("n0",), ("n9",), ("alone",)], "id string")
    out = graph.shortest_paths(edges, ids.where("id = 'n0'"), ids).collect()
    assert sorted(tuple(r) for r in out) == [("n0", "n0", 0), ("n0", "n9", 8)]


def test_graphs_of_any_depth(spark):
    """A chain of 50, a cycle of 20 with a chain behind it, and a root beside it."""
    from millrace.operators import dag as dg

    rows = [("chain", f"c{i}", [f"c{i - 1}"] if i else [], 1.0) for i in range(50)]
    rows += [("ring", f"r{i:02}", [f"r{(i - 1) % 20:02}"], 1.0) for i in range(20)] + [("ring", f"s{i}", [f"s{i - 1}" if i else "r00"], 1.0) for i in range(10)] + [("ring", "free", [], 1.0)]
    dag = spark.createDataFrame(rows, "dag_id string, task_id string, depends_on array<string>, est_time double")
    level = {(r.dag_id, r.task_id): r.level for r in dg.levels(dag).collect()}
    assert all(level["chain", f"c{i}"] == i for i in range(50))
    assert {v for k, v in level.items() if k[0] == "ring" and k[1] != "free"} == {1} and level["ring", "free"] == 0
    assert {tuple(r) for r in dg.cycles(dag).collect()} == {("ring", f"r{i:02}") for i in range(20)}
    kept = {tuple(r) for r in dg.remove_back_edges(dag).collect()}
    assert ("ring", "r00", "r19") not in kept and ("ring", "r05", "r04") in kept and len(kept) == 49 + 19 + 10
    acyclic = spark.createDataFrame([("ring", a, [b], 1.0) for _, a, b in kept if _ == "ring"] + [("ring", "r00", [], 1.0)], dag.schema)
    assert dg.cycles(acyclic).isEmpty()


def test_means_that_tie_round_as_in_sql(spark, duck, tmp_path):
    """Means of 64 tasks whose seventh and last decimal is 5."""
    import duckdb

    duck.sql(f"COPY (SELECT e.* REPLACE ((i * 7 + u * (i // 9)) AS event_id, u AS user_id) FROM (SELECT * FROM events LIMIT 1) AS e, range(64) AS a(i), range(1, 31) AS b(u)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = {r[0]: r for r in con.sql(catalog.ORACLES["workflow_estimates"]).fetchall()}
    tied = con.sql("SELECT count(*) FROM (SELECT sum(CASE (1 + event_id % 30) % 5 WHEN 0 THEN 70 WHEN 1 THEN 80 WHEN 2 THEN 90 WHEN 3 THEN 95 ELSE 80 END) % 4 AS m FROM events GROUP BY user_id) WHERE m = 2").fetchall()[0][0]
    assert tied > 3
    assert {r[0]: tuple(r) for r in catalog.QUERIES["workflow_estimates"](spark, str(tmp_path)).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
