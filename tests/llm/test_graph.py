import random

import pytest

from marlstone.llm import graph


@pytest.fixture
def edges(spark):
    rng = random.Random(4)
    pairs = {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)} | {(200 + k, 200) for k in range(1, 40)} | {(300 + k, 301 + k) for k in range(20)}
    return spark.createDataFrame(sorted((max(p), min(p)) for p in pairs if p[0] != p[1]), "a long, b long").distinct()


def test_a_round_over_few_edges_has_a_short_plan(spark, edges):
    """The driver keeps the plan of each of the last 1,000 queries, so that of every round counts."""
    plan = graph._round(edges, edges.count())._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") <= 2


def test_rounds_of_either_kind_agree(spark, edges, monkeypatch):
    few = sorted(map(tuple, graph._round(edges, edges.count()).collect()))
    monkeypatch.setattr(graph, "HUB_EDGES", 5)
    many = sorted(map(tuple, graph._round(edges, edges.count()).collect()))
    assert few == many and len(set(few)) == len(few) and all(a > b for a, b in few)
