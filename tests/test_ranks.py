"""Ranks within groups, segmented lists and scaling, against plain versions."""

from collections import defaultdict

import numpy as np
import pytest

from tessera.functions.tables import cut, ranks_within
from tessera.operators import align, graph, metrics, similarity


@pytest.mark.parametrize("tasks", [1, 7])
def test_ranks_within_groups(spark, tasks):
    rows = [("hot", k) for k in range(3000)] + [(f"g{k % 40}", k) for k in range(400)] + [(None, k) for k in range(5)] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(tasks)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        got = {(r.g, r.v): r.at for r in ranks_within(df, ["g"], ["v"], "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    of = defaultdict(list)
    for g, v in rows:
        of[g].append(v)
    assert got == {(g, v): sorted(of[g], key=lambda x: (x is not None, x)).index(v) for g, v in rows}


def test_ranks_of_nothing(spark):
    assert ranks_within(spark.createDataFrame([], "g string, v long"), ["g"], ["v"], "at").collect() == []


def test_segments_hold_all_and_are_bounded(spark):
    rows = [("hub", k) for k in range(1234)] + [("leaf", 1), ("leaf", 1), ("other", 5)]
    lists = graph.segments(spark.createDataFrame(rows, "key string, v long"), ["key"], "v", "vs", 100).cache()
    got = lists.collect()
    assert max(len(r.vs) for r in got) == 100
    assert {r.segment for r in got if r.key == "hub"} == set(range(13))
    assert sum((r.vs for r in sorted(got, key=lambda r: r.segment) if r.key == "hub"), []) == list(range(1234))
    assert sorted(tuple(r) for r in graph.of_segments(lists, "vs", "v").collect()) == sorted(set(rows))


def test_isolated_and_repeated_edges(spark):
    triples = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("a", "r", "a"), ("c", "r", "a")], "h string, r string, t string")
    ents = spark.createDataFrame([(e,) for e in "abcda"], "ent string")
    got = {(r.ent, r.segment): r.neighbours for r in graph.adjacency_segments(triples, ents, 2).collect()}
    assert got == {("a", 0): ["a", "b"], ("a", 1): ["c"], ("b", 0): ["a"], ("c", 0): ["a"], ("d", 0): []}
    sides = {(r.r, r.side, r.segment): r.ents for r in graph.head_tail_segments(triples, 1).collect()}
    assert sides == {("r", "head", 0): ["a"], ("r", "head", 1): ["c"], ("r", "tail", 0): ["a"], ("r", "tail", 1): ["b"], ("s", "head", 0): ["a"], ("s", "tail", 0): ["b"]}


def test_scaled_within_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0), (1, None)], "p int, x double")
    assert sorted(metrics.min_max(df, ["p"], "x").collect(), key=str) == sorted([(None, 0.0), (None, 1.0), (1, 0.0), (1, 0.0)], key=str)


def test_context_of_any_size_is_ranked_in_range_partitions(spark):
    rows = [(0, f"e{k:03}", float(k % 7)) for k in range(90)] + [(1, f"e{k:03}", 1.0) for k in range(3)]
    benefit = spark.createDataFrame(rows, "part_id long, ent string, benefit double")
    unmatched = spark.createDataFrame([(0, "e000"), (0, "x"), (1, "y")], "part_id long, ent string")
    found = align.first_context(benefit, unmatched, 60)
    assert "Window [row_number" not in found._jdf.queryExecution().toString()
    own = sorted((-b, e) for p, e, b in rows if p == 0 and e != "e000")
    want = [(0, e, -b, k + 1) for k, (b, e) in enumerate(own[:58])] + [(1, f"e{k:03}", 1.0, k + 1) for k in range(3)]
    assert sorted((r.part_id, r.ent, r.benefit, r["rank"]) for r in found.collect()) == sorted(want)


def test_induced_triples_are_not_sorted(spark):
    triples = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("a", "s", "c"), ("a", "r", None), ("b", "r", "b")], "h string, r string, t string")
    found = graph.induced(triples, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "ent string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "r", "b"), ("a", "r", "b"), ("b", "r", "b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_both_directions_from_one_pass(spark, monkeypatch):
    """The ranks of both directions are those of two passes, and each two rows are scored once; ties, rows without a pair or with several, absent ends."""
    draw = np.random.default_rng(8)
    rows = lambda at, n: spark.createDataFrame([(at + k, [float(v) for v in draw.integers(0, 3, 3)]) for k in range(n)], "id long, vec array<double>")
    left, right = cut(rows(0, 70)), cut(rows(1000, 50))
    gold = spark.createDataFrame([(k % 65, 1000 + (k * 7) % 45) for k in range(80)] + [(1, 5000), (900, 1001)], "e1 long, e2 long")
    for metric in ("dot", "l1", "l2"):
        forth = similarity.gold_ranks(left, right, gold, metric)
        back = similarity.transposed(similarity.gold_ranks(right, left, similarity.transposed(gold), metric))
        want = {("forth", *r) for r in forth.select("e1", "e2", "rank").collect()} | {("back", *r) for r in back.select("e1", "e2", "rank").collect()}
        assert {tuple(r) for r in similarity.both_gold_ranks(left, right, gold, metric, 20).collect()} == want
