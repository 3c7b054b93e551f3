"""Training and the blocks of the similarity join, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import adjacency, encoder, similarity


def table(spark, m):
    return spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(m) for k, v in enumerate(row)], "ent long, dim long, x double")


def test_gradient_and_descent(spark):
    rng = np.random.default_rng(1)
    n, dims, margin = 12, 5, 3.0
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.4) + np.eye(n)
    w = rng.normal(size=(n, dims))
    quads = [(0, 6, 3, 9), (1, 7, 4, 10), (2, 8, 5, 11), (0, 6, 1, 1)]
    out = a @ np.maximum(a @ w, 0)

    def loss(o):
        d = lambda p, q: np.abs(o[p] - o[q]).sum()
        return sum(max(0, margin + d(p, q) - d(p, y)) + max(0, margin + d(p, q) - d(x, q)) for p, q, x, y in quads) / (2 * len(quads))

    rows = encoder.loss_gradient(spark.createDataFrame(quads, "e1 long, e2 long, f1 long, f2 long"), table(spark, out), margin).collect()
    assert rows[0].loss == pytest.approx(loss(out))
    got = np.zeros((n, dims))
    for r in rows:
        got[r.ent, r.dim] = r.g
    for p in range(n):
        for k in range(dims):
            up, down = out.copy(), out.copy()
            up[p, k] += 1e-6
            down[p, k] -= 1e-6
            assert got[p, k] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-4)
    adj = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "i long, j long, w double")
    pairs = spark.createDataFrame([(0, 6), (1, 7), (2, 8)], "e1 long, e2 long")
    trained, losses = encoder.trained_convolutions(adj, table(spark, w), pairs, 6, rate=0.05, margin=margin, k=2)
    assert losses[-1] < losses[0] and trained.count() == n * dims


def test_start_vectors(spark):
    ents = spark.createDataFrame([("a",), ("b",)], "ent string")
    flat = {k: [r.x for r in encoder.start_vectors(ents, 16, k).collect()] for k in ("zeros", "ones", "uniform", "glorot", "normal")}
    assert set(flat["zeros"]) == {0.0} and set(flat["ones"]) == {1.0}
    assert max(map(abs, flat["glorot"])) <= (6 / 18) ** 0.5 and sum(x * x for x in flat["normal"]) == pytest.approx(2)


@pytest.mark.parametrize("block", [7, 16384])
def test_blocks_ties_and_parts(spark, block):
    rng = np.random.default_rng(2)
    make = lambda n: [(int(i % 2), int(i), [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(n)]
    one, two = make(31), make(40)
    left, right = (spark.createDataFrame(r + [(0, 99, None)], "part_id long, id long, vec array<double>") for r in (one, two))
    got = sorted((r.e1, r["rank"], r.e2) for r in similarity.best(left, right, 3, block=block, by=("part_id",)).collect())
    want = []
    for p, i, x in one:
        near = sorted(((-float(np.dot(x, y)), j) for q, j, y in two if q == p))[:3]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == sorted(want)
    thr = {(r.side, r.id): r.thr for r in similarity.both_thresholds(left, right, 3, block, ("part_id",)).collect()}
    for side, own, other in ((0, one, two), (1, two, one)):
        for p, i, x in own:
            assert thr[side, i] == pytest.approx(np.mean(sorted(np.dot(x, y) for q, _, y in other if q == p)[-3:]))
    gold = spark.createDataFrame([(i, i) for i in range(31)] + [(0, 77)], "e1 long, e2 long")
    ranks = {(r.e1, r.e2): r["rank"] for r in similarity.gold_ranks(left, right, gold, "l1", block).collect()}
    assert ranks.pop((0, 77)) is None
    for (i, g), k in ranks.items():
        far = lambda j: np.abs(np.array(one[i][2]) - two[j][2]).sum()
        assert k == 1 + sum((far(j), j) < (far(g), g) for j in range(40))


def test_arrays_equal_rows(spark):
    """Layers over arrays give what those over rows give, and join, sort and sum a node as one row."""
    names = spark.createDataFrame([(f"n{k}",) for k in range(7)], "ent string")
    triples = spark.createDataFrame([("n0", "r", "n1"), ("n0", "s", "n2"), ("n0", "r", "n1"), ("n3", "s", "n0"), ("n3", "r", "n4"), ("n5", "s", "n6")], "h string, r string, t string")
    rels = spark.createDataFrame([("r",), ("s",)], "ent string")
    adj = adjacency.symmetric_norm(adjacency.weighted(triples), names)
    rows, arrays = encoder.hashed_vectors(names, 3), encoder.hashed_arrays(names, 3)
    kernel = spark.createDataFrame([(p, k, x * (k + 1)) for p, x in (("self", 0.3), ("near", 2.0), ("relation", 0.7)) for k in range(3)], "place string, dim long, k double")
    part = lambda x: [x * (k + 1) for k in range(3)]
    one = encoder.array_convolution(adj, arrays, 3, True)
    attended = encoder.array_attention(triples, arrays, encoder.hashed_arrays(rels, 3), part(0.3), part(2.0), part(0.7))
    for got, want in ((arrays, rows), (one, encoder.convolution(adj, rows, True)), (encoder.array_convolution(adj, one, 3, False), encoder.two_convolutions(adj, rows)), (attended, encoder.attention(triples, rows, encoder.hashed_vectors(rels, 3), kernel))):
        found, known = ({(r.ent, r.dim): r.x for r in t.collect()} for t in (encoder.flat(got), want))
        assert found == pytest.approx(known)
    assert one.columns == ["ent", "v"] and one.count() == 7


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    some = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert similarity.best(none, some, 2).count() == 0 and similarity.mutual_nearest(some, none, 2).count() == 0
    assert similarity.gold_ranks(some, none, some.select(F.col("id").alias("e1"), F.col("id").alias("e2"))).first()["rank"] is None


@pytest.mark.parametrize("kind", ["dense", "path", "negative", "two blocks"])
def test_largest_eigenvalue(spark, kind):
    """Against numpy; a vector of ones is an eigenvector of neither."""
    rng = np.random.default_rng(3)
    n = 14
    if kind == "path":
        m = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    else:
        m = rng.normal(size=(n, n))
        m = m + m.T - (12 * np.eye(n) if kind == "negative" else 0)
        if kind == "two blocks":
            m[:7, 7:], m[7:, :7] = 0, 0
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i long, j long, w double")
    values = np.linalg.eigvalsh(m)
    assert abs(adjacency.largest_eigenvalue(a)) == pytest.approx(np.abs(values).max(), abs=1e-6)
    if kind == "dense":
        with pytest.raises(ValueError, match="rounds"):
            adjacency.largest_eigenvalue(a, rounds=2)
        assert adjacency.largest_eigenvalue(a.limit(0)) == 0.0


@pytest.mark.parametrize("metric", ["dot", "l1", "l2"])
def test_tiles(metric, monkeypatch):
    """The best of each row in tiles equal those over all at once, with ties; scores of a tile stay within its size."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(-1, 2, (20, 3)).astype(float), rng.integers(-1, 2, (50, 3)).astype(float)
    monkeypatch.setattr(similarity, "STEP", 8)
    plain, most = similarity._scores, []
    monkeypatch.setattr(similarity, "_scores", lambda a, b, m: most.append(len(b)) or plain(a, b, m))
    row, col, sim = similarity._near(x, y, 4, metric)
    assert max(most) == 8
    s = {"dot": x @ y.T, "l1": -np.abs(x[:, None] - y).sum(2), "l2": -np.sqrt(((x[:, None] - y) ** 2).sum(2))}[metric]
    want = [(i, j) for i in range(20) for j in sorted(range(50), key=lambda j: (-round(s[i, j], 9), j))[:4]]
    assert list(zip(row.tolist(), col.tolist())) == want
    assert np.allclose(sim, s[row, col])


@pytest.mark.parametrize("edges, want", [([(0, 1), (1, 2), (0, 3)], True), ([(0, 1), (1, 2), (2, 0), (4, 5)], True), ([(0, 1), (1, 2), (2, 0), (2, 3)], False)])
def test_alternates(spark, edges, want):
    make = lambda rows: spark.createDataFrame(rows, "i string, j string, w double")
    both = [(f"n{a}", f"n{b}", 1.0) for a, b in edges] + [(f"n{b}", f"n{a}", 0.3) for a, b in edges]
    assert adjacency.alternates(make(both)) is want
    assert adjacency.alternates(make([*both, ("n5", "end", 1.0), ("n1", "end", 1.0)])) is False  # the row of end has no sum
    assert adjacency.alternates(make(both), rounds=1) is None


@pytest.mark.parametrize("closed", [False, True])
def test_chebyshev_of_unlike_weights(spark, closed):
    """T_2 where the weights of both ways differ, so that A_norm isn't symmetric."""
    edges = [(0, 1), (1, 2), (1, 3), (3, 4)] + [(0, 2)] * closed
    a = np.zeros((5, 5))
    for i, j in edges:
        a[i, j], a[j, i] = 1.0, 0.3
    ents = spark.createDataFrame([(k,) for k in range(5)], "ent long")
    adj = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(5) for j in range(5) if a[i, j]], "i long, j long, w double")
    s = a.sum(1) ** -0.5
    laplacian = np.eye(5) - s[:, None] * a.T * s
    scaled = 2 / np.abs(np.linalg.eigvals(laplacian)).max() * laplacian - np.eye(5)
    got = np.zeros((5, 5))
    for r in adjacency.chebyshev(adj, ents, 2)[2].collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, 2 * scaled @ scaled - np.eye(5), atol=1e-6)
