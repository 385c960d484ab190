"""Rings of many origins: no shuffle of the pairs that the last step makes, and each pair once."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import graph, reach
from tessella.plans import catalog


def brute(links, starts, k):
    near, rows = {}, set()
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for o in starts:
        found = {o: 0}
        for r in range(1, k + 1):
            found |= {n: r for m in list(found) if m is not None for n in near.get(m, ()) if n not in found}
        rows |= {(o, n, r) for n, r in found.items()}
    return rows


def test_pairs_are_not_shuffled(spark):
    """a hub of 1,500 nodes makes 2,250,000 pairs; what is shuffled is edges, packed, not pairs."""
    e = spark.range(1500).selectExpr("id a", "-1L b")
    start = spark.range(1500).selectExpr("id node")
    got = graph.rings(e, start, 2)
    assert "hashpartitioning(origin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.groupBy("ring").count().collect())) == [(0, 1500), (1, 1500), (2, 1500 * 1499)]
    assert got.filter("ring = 2").distinct().count() == 1500 * 1499


@pytest.mark.parametrize(("kind", "held"), [("long", 12), ("string", 40), ("int", 10**6)])
def test_rings_equal_search(spark, monkeypatch, kind, held):
    """in one block or many, with hubs, loops, copies, null nodes, strings and starts that no edge has."""
    monkeypatch.setattr(reach, "HELD", held)
    rnd = np.random.default_rng(held)
    links = [(0, int(n)) for n in rnd.integers(1, 30, 12)] + rnd.integers(0, 40, (25, 2)).tolist() + [(3, 3), (50, 51), (5, None), (None, 6), (0, None)]
    starts = [0, 3, 5, 6, 17, 50, 99, 99, -2]
    to = (lambda v: None if v is None else f"n{v}") if kind == "string" else lambda v: v
    links, starts = [(to(a), to(b)) for a, b in links], [to(v) for v in starts]
    e, start = spark.createDataFrame(links, f"a {kind}, b {kind}"), spark.createDataFrame([(v,) for v in starts], f"node {kind}")
    for k in (0, 2, 4):
        got = list(map(tuple, graph.rings(e, start, k).collect()))
        assert len(got) == len(set(got)) and set(got) == brute(links, starts, k)


def test_two_rings_of_null_customers_equal_sql(spark, tmp_path):
    rows = [(1, 10), (1, 11), (4001, 12), (2, 10), (2, None), (7, None), (None, 11), (8, 13), (8, 13)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = catalog.QUERIES["two_rings"](spark, str(tmp_path)).select("origin", "node", "ring").collect()
    want = c.execute(f"SELECT origin, node, ring FROM ({catalog.ORACLE_SQL['two_rings']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("ways", [1, 9, 10**6])
def test_block_is_the_same_in_any_portions(monkeypatch, ways):
    monkeypatch.setattr(reach, "WAYS", ways)
    rnd = np.random.default_rng(4)
    seen = {(int(o), int(m)): bool(x) for (o, m), x in zip(rnd.integers(0, 12, (60, 2)), rnd.integers(0, 3, 60), strict=True)}
    edges = {(int(m), int(n)) for m, n in rnd.integers(2, 14, (50, 2))}
    want = {(o, n) for (o, m), last in seen.items() if last for x, n in edges if x == m} - seen.keys()
    a = pa.table({"origin": [o for o, _ in seen], "node": [m for _, m in seen], "last": list(seen.values())})
    b = pa.table({"mid": [m for m, _ in edges], "node": [n for _, n in edges]})
    got = [(o, n) for x in reach._pairs(a, b) for o, nodes in zip(*(c.to_pylist() for c in x.columns), strict=True) for n in nodes]
    assert len(got) == len(set(got)) and set(got) == want
