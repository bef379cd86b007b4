import collections
import random

import pytest

from sparkloom.operators import graph, rank_blocks


def plain(nodes, edges, rounds, rank=None):
    n, out = len(nodes), collections.Counter(s for s, _ in edges)
    rank = rank or dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.15 / n + 0.85 * sum(r for i, r in rank.items() if not out[i]) / n)
        for s, d in edges:
            new[d] += 0.85 * rank[s] / out[s]
        rank = new
    return rank


@pytest.mark.parametrize("once", [False, True])
def test_ranks_of_many_blocks_and_tiles(spark, monkeypatch, once):
    monkeypatch.setattr(rank_blocks, "BLOCK", 20)
    monkeypatch.setattr(rank_blocks, "TILE", 16)
    monkeypatch.setattr(rank_blocks, "BROADCAST_NODES", 0 if once else 1000)
    dice = random.Random(7)
    nodes = [f"n{i}" for i in range(300)]
    edges = [(dice.choice(nodes[:250]), dice.choice(nodes)) for _ in range(900)]
    edges += edges[:200] + [("n0", x) for x in nodes] + [(x, "n1") for x in nodes[:250]]
    unknown = [("n3", "x"), ("y", "n4"), ("x", "y"), ("n5", None), (None, "n5")]
    table = spark.createDataFrame(edges + unknown, "src string, dst string")
    got = graph.page_rank(spark.createDataFrame([(x,) for x in [*nodes, *nodes]], "id string"), table, iterations=3, tolerance=0.0, once=once).collect()
    want = plain(nodes, sorted(set(edges)) if once else edges, 3)
    assert len(got) == 300 and all(abs(r.rank - want[r.id]) < 1e-12 for r in got)


def test_a_start_that_does_not_sum_to_one(spark):
    nodes, edges = ["a", "b", "c"], [("a", "b"), ("b", "a"), ("a", "c")]
    start = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("gone", 9.0)], "id string, rank double")
    tables = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
    total = 0.75 + 1 / 3
    first = {"a": 0.5 / total, "b": 0.25 / total, "c": 1 / 3 / total}
    for rounds in (0, 2):
        want = plain(nodes, edges, rounds, first)
        got = graph.page_rank(*tables, iterations=rounds, tolerance=0.0, start=start).collect()
        assert all(abs(r.rank - want[r.id]) < 1e-12 for r in got) and len(got) == 3


def test_a_round_shuffles_ranks_and_sums_but_no_edges(spark):
    ids = spark.createDataFrame([(f"n{i}",) for i in range(50)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 50}") for i in range(50)], "src string, dst string")
    numbered, parts = rank_blocks.numbered(ids, 50)
    with rank_blocks.tiles(numbered, 50, edges, parts, False) as tiles:
        ranks = rank_blocks.begun(numbered.selectExpr("*", "0.02d as first"), tiles)
        sums = rank_blocks.moved(tiles, ranks, 0.003, 0.85, 1.0)
        plan = sums._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, line in enumerate(plan) if "rank_tiles" in line and "Bucketed: true" in line)
        join = max(i for i, line in enumerate(plan[:scan]) if "ShuffledHashJoin" in line)
        assert not any("Exchange" in line for line in plan[join:scan])
        assert abs(sums.selectExpr("sum(total)").first()[0]) < 0.2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rank_tiles")]
