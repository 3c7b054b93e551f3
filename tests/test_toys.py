"""Operators on small graphs with known numbers."""

import numpy as np
import pytest

from tessera.operators import adjacency, align, encode, evidence, graph, metrics, partition, similarity
from tessera.plans import catalogue, loop
from tessera.sources import demo

TOY = [(0, "r0", 1), (1, "r0", 2), (1, "r1", 2), (2, "r0", 3), (4, "r0", 1)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "h long, r string, t long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(k,) for k in range(5)], "ent long")


def test_functionality(toy):
    rows = {r.r: (r.func, r.ifunc) for r in adjacency.functionality(toy).collect()}
    assert rows == {"r0": (1.0, 0.75), "r1": (1.0, 1.0)}


def test_weighted_adjacency(toy):
    rows = {(r.j, r.i): r.w for r in adjacency.weighted(toy).collect()}
    assert rows == {(0, 1): 0.75, (1, 0): 1.0, (1, 2): 1.75, (2, 1): 2.0, (2, 3): 0.75, (3, 2): 1.0, (4, 1): 0.75, (1, 4): 1.0}


@pytest.mark.parametrize("layers, n1, base, want", [(1, [1, 1, 1, 1, 0], 1.523188, [1.061071, 1.061071, 0.761594, 0.299477, 0.761594]), (2, [2, 4, 4, 2, 1], 1.523188, [0.724275, 1.324999, 0.984763, 0.342349, 0.819283])])
def test_evidence(spark, toy, nodes, layers, n1, base, want):
    edges = evidence.evidence_edges(toy, nodes)
    anchors = spark.createDataFrame([(0,), (3,)], "ent long")
    unmatched = spark.createDataFrame([(0, 2), (0, 4)], "part_id long, ent long")
    counts = {r.ent: r.x for r in evidence.counts(anchors, edges, layers).collect()}
    assert [counts.get(k, 0) for k in range(5)] == n1
    assert evidence.base(anchors, unmatched, edges, layers, 2.0).first().base == pytest.approx(base, abs=1e-6)
    got = {r.ent: r.benefit for r in evidence.benefits(anchors, unmatched, nodes, edges, layers, 2.0).collect()}
    assert [got.get(k, 0) for k in range(5)] == pytest.approx(want, abs=1e-6)


def test_benefit_is_ablation(spark):
    rng = np.random.default_rng(3)
    n, layers = 25, 2
    triples = [(int(a), "r", int(b)) for a, b in rng.integers(0, n, (40, 2))]
    m = np.eye(n)
    for h, _, t in triples:
        m[t, h] += 1
        m[h, t] += 1
    f = lambda x: 2 / (1 + np.exp(-2 * x)) - 1

    def spread(x, e):
        for _ in range(layers):
            x = m @ (x * e)
        return x * e

    h0, one = np.isin(np.arange(n), [0, 3, 7]).astype(float), np.ones(n)
    n1 = spread(h0, one)
    n2 = spread(f(n1 / (n1 + 1e-8)), one)
    parts = {0: [1, 2, 5], 1: [8, 9]}
    want = {}
    for c in range(n):
        e = one.copy()
        e[c] = 0
        p = f(spread(f(spread(h0, e) / (n1 + 1e-8)), e) / (n2 + 1e-8))
        for k, u in parts.items():
            want[c, k] = (f(n2 / (n2 + 1e-8)) - p)[u].sum()
    nodes = spark.createDataFrame([(k,) for k in range(n)], "ent long")
    edges = evidence.evidence_edges(spark.createDataFrame(triples, "h long, r string, t long"), nodes)
    unmatched = spark.createDataFrame([(k, u) for k, us in parts.items() for u in us], "part_id long, ent long")
    got = {(r.ent, r.part_id): r.benefit for r in evidence.benefits(spark.createDataFrame([(0,), (3,), (7,)], "ent long"), unmatched, nodes, edges, layers).collect()}
    assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want, abs=1e-9)


def test_csls(spark):
    s = [[0.9, 0.8, 0.1], [0.7, 0.6, 0.2], [0.3, 0.4, 0.5]]
    left = spark.createDataFrame([(k, [float(i == k) for i in range(3)]) for k in range(3)], "id long, vec array<double>")
    right = spark.createDataFrame([(k, [s[i][k] for i in range(3)]) for k in range(3)], "id long, vec array<double>")
    got = {(r.e1, r.e2): r.sim for r in similarity.csls_best(left, right, 2, 3).collect()}
    want = [[0.15, 0.05, -1.0], [-0.05, -0.15, -0.60], [-0.65, -0.35, 0.20]]
    assert got == pytest.approx({(i, j): want[i][j] for i in range(3) for j in range(3)})
    gold = spark.createDataFrame([(k, k) for k in range(3)], "e1 long, e2 long")
    m = metrics.rank_metrics(similarity.gold_ranks(*similarity.csls_vectors(left, right, 2), gold)).first()
    assert (m.mr, m.mrr, m.recall_1) == pytest.approx((4 / 3, 5 / 6, 2 / 3))
    assert sorted((r.e1, r.e2) for r in similarity.mutual_nearest(left, right, 2).collect()) == [(0, 0), (2, 2)]
    missing = spark.createDataFrame([(0, 9)], "e1 long, e2 long")
    assert similarity.gold_ranks(left, right, missing).first()["rank"] is None


def test_blocks_agree(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in range(40)], "id long, vec array<double>")
    one = sorted((r.e1, r.e2, r["rank"]) for r in similarity.best(v, v, 3).collect())
    assert one == sorted((r.e1, r.e2, r["rank"]) for r in similarity.best(v, v, 3, block=7).collect())


def test_hops(spark, toy):
    seeds = spark.createDataFrame([(0, 0), (1, 3)], "part_id long, ent long")
    got = {(r.part_id, r.ent): r.hop for r in graph.hop_levels(graph.undirected(toy), seeds, 3).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 4): 2, (0, 3): 3, (1, 2): 1, (1, 1): 2, (1, 0): 3, (1, 4): 3}
    anchors = spark.createDataFrame([(2,), (4,)], "ent long")
    met = graph.anchor_hop(graph.undirected(toy), spark.createDataFrame([(0, 0)], "part_id long, ent long"), anchors, 2)
    assert sorted(r.ent for r in met.collect()) == [1, 2, 4]


def test_no_anchors_no_counterparts(spark, toy):
    none = spark.createDataFrame([], "part_id long, ent long")
    assert align.counterparts(graph.undirected(toy), none, 3, 1).count() == 0


def test_partitions(spark):
    nodes = spark.createDataFrame([(k,) for k in range(103)], "ent long")
    rows = partition.hash_chunks(nodes, 5).collect()
    assert sorted(r.ent for r in rows) == list(range(103))
    sizes = [sum(r.part_id == p for r in rows) for p in range(5)]
    assert sizes == [20, 20, 20, 20, 23]
    ring = spark.createDataFrame([(k, "r", (k + 1) % 103) for k in range(103)] + [(k, "r", (k + 2) % 103) for k in range(103)], "h long, r string, t long")
    und = graph.undirected(ring)
    found = partition.balanced(und, nodes, 5)
    rows = found.collect()
    assert sorted(r.ent for r in rows) == list(range(103))
    assert max(sum(r.part_id == p for r in rows) for p in range(5)) <= 1.05 * 103 / 5 + 3
    assert partition.cut_edges(und, found).first()["cut"] < partition.cut_edges(und, partition.hash_chunks(nodes, 5)).first()["cut"]


def test_sizes_and_seeds(spark):
    assert encode.subtask_size(1.0, 100, 140, 5, 0.4) == (48, 19, 29)
    assert encode.subtask_size(60, 1, 1, 5, 0.5) == (60, 30, 30)
    old = spark.createDataFrame([(0, 1, 2)], "part_id long, e1 long, e2 long")
    new = spark.createDataFrame([(0, 1, 3), (0, 4, 5)], "part_id long, e1 long, e2 long")
    rows = lambda p: sorted(tuple(r) for r in align.merged_seeds(old, new, p).collect())
    assert rows("first_wins") == [(0, 1, 2), (0, 4, 5)]
    assert rows("accumulate") == [(0, 1, 2), (0, 1, 3), (0, 4, 5)]


def test_loop_finds_counterparts(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (220, 2)) if a != b}
    g = lambda p: spark.createDataFrame([(f"{p}{a}", "r", f"{p}{b}") for a, b in sorted(edges)], "h string, r string, t string")
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}", "train" if k % 2 else "test") for k in range(60)], "e1 string, e2 string, split string")
    out = loop.run(g("a"), g("b"), pairs, loop.Config(parts=2, iterations=2, size=120))
    rows = sorted(out.history.collect(), key=lambda r: r.iteration)
    assert len(rows) == 2 and rows[0].seeds <= rows[1].seeds
    assert rows[1].right > 0.6 * rows[1].seeds


def test_chebyshev_basis_covers_the_graph(spark):
    from tessera.plans import catalogue

    w = catalogue.World(spark, "/root/testdata/sf0.001")
    found = catalogue.QUERIES["chebyshev_basis"](spark, w.sf_dir).select("i").distinct()
    assert w.nodes1.join(found, w.nodes1.ent == found.i, "left_anti").count() == 0


def test_undirected_shuffles_an_edge_once(spark):
    rows = [("a", "r", "b"), ("b", "s", "a"), ("a", "r", "a"), ("c", "r", "b"), ("c", "s", "b"), (None, "r", "c"), ("c", "r", None)]
    found = graph.undirected(spark.createDataFrame(rows, "h string, r string, t string"))
    want = {e for h, _, t in rows for e in ((h, t), (t, h))}
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # both directions are made after the shuffle


def test_evidence_edges_are_shuffled_once(spark):
    """An edge, its way back and its copies are one row of the shuffle; a loop counts once for each end, and once more as a node."""
    triples = spark.createDataFrame([("b", "r", "a"), ("a", "s", "b"), ("a", "r", "b"), ("c", "r", "c"), (None, "r", "a")], "h string, r string, t string")
    edges = evidence.evidence_edges(triples, spark.createDataFrame([(e,) for e in "abc"], "ent string"))
    want = {("a", "a"): 1, ("a", "b"): 3, ("b", "a"): 3, ("b", "b"): 1, ("c", "c"): 3, (None, "a"): 1, ("a", None): 1}
    assert {(r.src, r.dst): r.mult for r in edges.collect()} == want
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate ") < plan.index("Aggregate ")


def test_shared_entities_are_found_once_and_stored(spark, tmp_path):
    one = spark.createDataFrame([("a", "r", "b"), ("b", "r", None)], "h string, r string, t string")
    two = spark.createDataFrame([("b", "r", "c"), (None, "r", "b")], "h string, r string, t string")
    assert [r.uri for r in demo.shared(one, two).collect()] == ["b"]
    world = catalogue.World(spark, "/root/testdata/sf0.001")
    for part in (world.anchor_nodes, world.unmatched, world.candidates):
        assert "lineitem" not in "".join(part.inputFiles())


def test_chebyshev_products_are_not_shuffled(spark, monkeypatch):
    """The recurrence against dense matrices, with a hub, loops, a row in no other, and rows of one cell in several pieces; nothing is shuffled after the products are made."""
    rng, n = np.random.default_rng(4), 60
    entries = {(0, k) for k in range(n)} | {(k, 0) for k in range(1, n)} | {(k, k) for k in range(n)} | {tuple(map(int, e)) for e in rng.integers(0, n, (90, 2))}
    s = np.zeros((n, n))
    for i, j in entries:
        s[i, j] = rng.normal()
    table = lambda m, at: spark.createDataFrame([(f"e{i}", f"e{j}", float(m[i, j])) for i, j in sorted(at)], "i string, j string, w double")
    scaled, eye = table(s, entries), table(np.eye(n), {(k, k) for k in range(n)})
    names = lambda found: {(int(r.i[1:]), int(r.j[1:])): r.w for r in found.collect()}
    for products in (1, 100, adjacency.PRODUCTS):
        monkeypatch.setattr(adjacency, "PRODUCTS", products)
        second = adjacency.recurrence(scaled, scaled, eye)
        rows = second.collect()
        got = {(int(r.i[1:]), int(r.j[1:])): r.w for r in rows}
        want = 2 * s @ s - np.eye(n)
        assert len(rows) == len(got) and set(got) == {(i, j) for i, k in entries for k2, j in entries if k == k2} | {(k, k) for k in range(n)}
        assert got == pytest.approx({e: want[e] for e in got}, abs=1e-9)
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")
    third = names(adjacency.recurrence(scaled, second, scaled))
    assert third == pytest.approx({e: (2 * s @ want - s)[e] for e in third}, abs=1e-8)


def test_connectors_of_one_layer(spark, monkeypatch):
    """The same as by the general way, with loops, copies of edges, missing ends, entities in several parts and both kinds at once; triples are shuffled once by each end."""
    rng = np.random.default_rng(9)
    edges = [(int(a), "r", int(b)) for a, b in rng.integers(0, 40, (130, 2))] + [(3, "r", 3), (3, "s", 3), (5, "r", 6), (5, "s", 6), (6, "r", 5), (None, "r", 4), (4, "r", None)]
    triples = spark.createDataFrame(edges, "h long, r string, t long")
    some = lambda n: spark.createDataFrame([(int(p), int(e)) for p, e in zip(rng.integers(0, 3, n), rng.integers(0, 40, n))] + [(0, 3), (1, 3), (0, 99)], "part_id long, ent long")
    unmatched, anchors = some(30), some(15)
    rows = lambda found: {(r.part_id, r.ent): r.benefit for r in found.collect()}
    got = rows(align.connectors(triples, unmatched, anchors, 1000))
    met = align.hop_levels
    hops = []
    monkeypatch.setattr(align, "hop_levels", lambda *a: hops.append(1) or met(*a))
    general = rows(align.connectors(triples, unmatched, anchors, 1000, _One(1)))
    assert hops and got == pytest.approx(general, abs=1e-9) and any(v > 0 for v in got.values())
    hops.clear()
    align.connectors(triples, unmatched, anchors, 1000)
    assert not hops


class _One(int):
    """A 1 that takes the general way."""

    def __eq__(self, other):
        return False

    __hash__ = int.__hash__
