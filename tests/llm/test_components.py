import random

from tests.llm.helpers import classes
from vectorloom.llm import components as cc
from vectorloom.llm.components import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    edges += [(i, i + 1) for i in range(200, 260)] + [(300, j) for j in range(301, 340)] + [(5, 5)]
    want = classes(340, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_large_tables_split_their_hubs(spark, monkeypatch):
    """The same components when the minima aren't broadcast: a hub, chains and loose edges."""
    rng = random.Random(2)
    linked = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(70, 90)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    edges = spark.createDataFrame(linked, "a bigint, b bigint").repartition(3)
    want = {(r.node, r.component) for r in cc.components(edges).collect()}
    monkeypatch.setattr(cc, "SMALL_ROWS", 10)
    monkeypatch.setattr(cc, "HEAVY", 8)
    assert {(r.node, r.component) for r in cc.components(edges).collect()} == want
    names = classes(160, [e for e in linked if e[0] != e[1]])
    assert want == {(n, names[n]) for e in linked for n in e if e[0] != e[1]}
