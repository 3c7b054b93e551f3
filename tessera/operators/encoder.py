"""Forward passes of graph encoders as edge joins; vectors are rows (ent, dim, x), so layers are sums by entity and dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tables import cut, dense_ids
from tessera.functions.vectors import l1


def hashed_vectors(ents: DataFrame, dims: int, key: str = "ent") -> DataFrame:
    """(ent, dim, x): reproducible start values in -1..1, from the md5 of the key and the dimension."""
    h = F.conv(F.substring(F.md5(F.concat_ws("#", F.col(key).cast("string"), "dim")), 1, 8), 16, 10).cast("double")
    return ents.select(F.col(key).alias("ent"), F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")).select(F.col("ent").alias(key), "dim").select(F.col(key).alias("ent"), F.col("dim").cast("long").alias("dim"), (h / F.lit(4294967295.0) * 2 - 1).alias("x"))


def hashed_arrays(ents: DataFrame, dims: int, key: str = "ent") -> DataFrame:
    """(ent, v): the values of hashed_vectors() as one array for each entity."""
    h = lambda k: F.conv(F.substring(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("double")
    return ents.select(F.col(key).alias("ent"), F.array(*[h(k) / F.lit(4294967295.0) * 2 - 1 for k in range(dims)]).alias("v"))


def flat(vectors: DataFrame) -> DataFrame:
    """(ent, dim, x) of rows (ent, v)."""
    return vectors.select("ent", F.posexplode("v").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))


def start_vectors(ents: DataFrame, dims: int, kind: str = "uniform", scale: float = 1.0) -> DataFrame:
    """(ent, dim, x): start values of `dims` elements, reproducible from the entity. kind: zeros, ones, uniform (-scale..scale),
    glorot (uniform, bounded by sqrt(6 / (rows + dims))), or normal (rows of normal values cut at two deviations, at length 1)."""
    flat = hashed_vectors(ents, dims)
    if kind in ("zeros", "ones"):
        return flat.withColumn("x", F.lit(float(kind == "ones")))
    if kind in ("uniform", "glorot"):
        return flat.withColumn("x", F.col("x") * (scale if kind == "uniform" else (6.0 / (ents.count() + dims)) ** 0.5))
    other = (F.conv(F.substring(F.md5(F.concat_ws("#", F.col("ent").cast("string"), "dim")), 9, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)
    # |z| of Box-Muller is at most 2 where the uniform number is exp(-2) or more
    drawn = F.sqrt(-2 * F.log(F.exp(F.lit(-2.0)) + (1 - F.exp(F.lit(-2.0))) * other)) * F.cos(F.col("x") * F.lit(3.141592653589793))
    return unit(flat.withColumn("x", drawn))


def dense(vectors: DataFrame, weights: DataFrame, relu: bool = False) -> DataFrame:
    """(ent, dim, x): vectors times a matrix (dim, out, w)."""
    out = vectors.join(F.broadcast(weights), "dim").groupBy("ent", F.col("out").alias("dim")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    return out.withColumn("x", F.greatest("x", F.lit(0.0))) if relu else out


def neighbour_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ent, dim, x): the mean over neighbours, edges (a, b) from a to b's vector."""
    return edges.join(vectors.withColumnRenamed("ent", "b"), "b").groupBy(F.col("a").alias("ent"), "dim").agg(F.avg("x").alias("x"))


def convolution(adj: DataFrame, vectors: DataFrame, relu: bool) -> DataFrame:
    """(ent, dim, x): the matrix (i, j, w) times the vectors, with negative sums set to 0 if relu."""
    out = adj.join(vectors.withColumnRenamed("ent", "j"), "j").groupBy(F.col("i").alias("ent"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return out.withColumn("x", F.greatest("x", F.lit(0.0))) if relu else out


def two_convolutions(adj: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ent, dim, x): the matrix times the rectified product of the matrix and the vectors; no weights in between."""
    return convolution(adj, convolution(adj, vectors, True), False)


def array_convolution(adj: DataFrame, vectors: DataFrame, dims: int, relu: bool) -> DataFrame:
    """(ent, v): convolution() of arrays (ent, v) of `dims` elements: a node is one row in the join, the sort and the sum, not one for each element."""
    own = vectors.select(F.col("ent").alias("j"), *[F.col("v")[k].alias(f"x{k}") for k in range(dims)])
    sums = adj.join(own, "j").groupBy(F.col("i").alias("ent")).agg(*[F.sum(F.col("w") * F.col(f"x{k}")).alias(f"x{k}") for k in range(dims)])
    return sums.select("ent", F.array(*[F.greatest(f"x{k}", F.lit(0.0)) if relu else F.col(f"x{k}") for k in range(dims)]).alias("v"))


def unit(vectors: DataFrame, key: str = "ent") -> DataFrame:
    """Vectors at length 1; zero vectors stay."""
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return vectors.withColumn("x", F.when(n > 0, F.col("x") / n).otherwise(F.col("x")))


def reflections(triples: DataFrame, vectors: DataFrame, relation_vectors: DataFrame) -> DataFrame:
    """(h, r, t, dim, x): the tail's vector reflected at the hyperplane of its relation's unit vector: n - 2 (n.r) r."""
    r = unit(relation_vectors.withColumnRenamed("ent", "r"), "r").withColumnRenamed("x", "rx")
    both = triples.select("h", "r", "t").distinct().join(vectors.withColumnRenamed("ent", "t"), "t").join(r, ["r", "dim"])
    dot = F.sum(F.col("x") * F.col("rx")).over(Window.partitionBy("h", "r", "t"))
    return both.select("h", "r", "t", "dim", (F.col("x") - 2 * dot * F.col("rx")).alias("x"))


def attention(triples: DataFrame, vectors: DataFrame, relation_vectors: DataFrame, kernel: DataFrame) -> DataFrame:
    """(ent, dim, x): one layer of relational-reflection attention. kernel (place, dim, k) weighs the head
    ('self'), the reflected tail ('near') and the relation ('relation'); a head's logits go through a softmax."""
    part = lambda p: kernel.where(F.col("place") == p).select("dim", "k")
    reflected = reflections(triples, vectors, relation_vectors)
    near = reflected.join(part("near"), "dim").groupBy("h", "r", "t").agg(F.sum(F.col("x") * F.col("k")).alias("near"))
    own = vectors.join(part("self"), "dim").groupBy(F.col("ent").alias("h")).agg(F.sum(F.col("x") * F.col("k")).alias("own"))
    rel = unit(relation_vectors.withColumnRenamed("ent", "r"), "r").join(part("relation"), "dim").groupBy("r").agg(F.sum(F.col("x") * F.col("k")).alias("rel"))
    logit = near.join(own, "h").join(rel, "r").select("h", "r", "t", (F.col("near") + F.col("own") + F.col("rel")).alias("z"))
    top = F.max("z").over(Window.partitionBy("h"))
    e = logit.withColumn("e", F.exp(F.col("z") - top))
    share = e.select("h", "r", "t", (F.col("e") / F.sum("e").over(Window.partitionBy("h"))).alias("share"))
    return reflected.join(share, ["h", "r", "t"]).groupBy(F.col("h").alias("ent"), "dim").agg(F.sum(F.col("x") * F.col("share")).alias("x"))


def array_attention(triples: DataFrame, vectors: DataFrame, relation_vectors: DataFrame, own: list[float], near: list[float], relation: list[float]) -> DataFrame:
    """(ent, v): attention() of arrays (ent, v), with the kernel's three parts as lists: a triple is one row, and its head's rows meet once."""
    dims = range(len(own))
    along = lambda xs, ys: reduce(lambda a, b: a + b, [x * y for x, y in zip(xs, ys)])
    numbers = lambda xs: [F.lit(float(x)) for x in xs]
    named = lambda t, key, x: t.select(F.col("ent").alias(key), *[F.col("v")[k].alias(f"{x}{k}") for k in dims])
    of = lambda x: [F.col(f"{x}{k}") for k in dims]
    r = named(relation_vectors, "r", "r")
    length = F.sqrt(along(of("r"), of("r")))
    r = r.select("r", *[F.when(length > 0, c / length).otherwise(c).alias(f"r{k}") for k, c in zip(dims, of("r"))])
    rows = triples.select("h", "r", "t").distinct().join(named(vectors, "t", "x"), "t").join(r, "r").withColumn("dot", along(of("x"), of("r")))
    rows = rows.select("h", (along(of("r"), numbers(relation))).alias("far"), *[(x - 2 * F.col("dot") * u).alias(f"n{k}") for k, x, u in zip(dims, of("x"), of("r"))])
    heads = named(vectors, "h", "x").select("h", along(of("x"), numbers(own)).alias("own"))
    logit = rows.join(heads, "h").select("h", (along(of("n"), numbers(near)) + F.col("own") + F.col("far")).alias("z"), *of("n"))
    e = logit.withColumn("e", F.exp(F.col("z") - F.max("z").over(Window.partitionBy("h"))))
    return e.groupBy(F.col("h").alias("ent")).agg(F.array(*[F.sum(F.col("e") * n) / F.sum("e") for n in of("n")]).alias("v"))


def encode(triples: DataFrame, vectors: DataFrame, relation_vectors: DataFrame, kernels: list[DataFrame]) -> DataFrame:
    """(ent, layer, dim, x): the start vectors and those of each attention layer, which together are the entity's encoding."""
    out = vectors.withColumn("layer", F.lit(0))
    for k, kernel in enumerate(kernels, 1):
        vectors = attention(triples, vectors, relation_vectors, kernel).withColumn("x", F.tanh("x"))
        out = out.unionByName(vectors.withColumn("layer", F.lit(k)))
    return out


def alignment_loss(pairs: DataFrame, left: DataFrame, right: DataFrame, margin: float, k: int) -> DataFrame:
    """(total, loss) of pairs (e1, e2) of rows (id, vec) of both sides: k random rows stand for each pair's e1 and k for its e2;
    hinges of margin + L1(pair) - L1(pair with a random row). total: the sum of both sides' hinges over the pairs times k; loss: the mean over hinges.

    The pairs' vectors are fetched by joins, so no pair meets all rows."""
    n1, n2 = left.count(), right.count()
    places1, places2 = (dense_ids(t.select("id", "vec"), ["id"], "at") for t in (left, right))
    vectors = lambda t, key, name: t.select(F.col(key[0]).alias(key[1]), F.col("vec").alias(name))
    drawn = negatives(pairs, n1, k, 1).withColumnRenamed("negative", "f1").join(negatives(pairs, n2, k, 2).withColumnRenamed("negative", "f2"), ["e1", "e2", "draw"])
    all4 = drawn.join(vectors(left, ("id", "e1"), "a"), "e1").join(vectors(right, ("id", "e2"), "b"), "e2").join(vectors(places1, ("at", "f1"), "x"), "f1").join(vectors(places2, ("at", "f2"), "y"), "f2")
    hinge = lambda p, q: F.greatest(margin + l1("a", "b") - l1(p, q), F.lit(0.0))
    both = (hinge("a", "y") + hinge("x", "b")).alias("h")
    return all4.select(both).agg(F.avg("h").alias("total"), (F.avg("h") / 2).alias("loss"))


def loss_gradient(drawn: DataFrame, vectors: DataFrame, margin: float) -> DataFrame:
    """(ent, dim, g, loss) of alignment_loss() over rows (e1, e2, f1, f2), a pair and a random node for each side; loss is the same in each row.

    Each end's vector is joined as one array, so a pair costs four lookups and its gradient one sum by node and element."""
    packed = vectors.groupBy("ent").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("v"))
    for end, name in (("e1", "a"), ("e2", "b"), ("f1", "x"), ("f2", "y")):
        drawn = drawn.join(packed.select(F.col("ent").alias(end), F.col("v").alias(name)), end)
    right, left = margin + l1("a", "b") - l1("a", "y"), margin + l1("a", "b") - l1("x", "b")
    scored = cut(drawn.withColumns({"right": right, "left": left}))
    total = scored.agg((F.sum(F.greatest("right", F.lit(0.0)) + F.greatest("left", F.lit(0.0))) / (2 * F.count("*"))).alias("loss"), F.count("*").alias("n"))
    signs = lambda p, q, s: F.zip_with(p, q, lambda u, v: s * F.signum(u - v))
    pulls = []
    for active, p, q in (("right", ("e1", "a"), ("f2", "y")), ("left", ("f1", "x"), ("e2", "b"))):
        for (one, u), (two, v), s in ((("e1", "a"), ("e2", "b"), 1.0), (p, q, -1.0)):
            on = scored.where(F.col(active) > 0)
            pulls += [on.select(F.col(one).alias("ent"), signs(u, v, s).alias("d")), on.select(F.col(two).alias("ent"), signs(v, u, s).alias("d"))]
    flat = reduce(DataFrame.unionByName, pulls).select("ent", F.posexplode("d").alias("dim", "g"))
    summed = flat.groupBy("ent", F.col("dim").cast("long").alias("dim")).agg(F.sum("g").alias("g"))
    return total.join(summed, F.lit(True), "left").select("ent", "dim", (F.col("g") / (2 * F.col("n"))).alias("g"), "loss")


def trained_convolutions(adj: DataFrame, start: DataFrame, pairs: DataFrame, epochs: int, rate: float = 20.0, margin: float = 3.0, k: int = 5, fresh: int = 10) -> tuple[DataFrame, list[float]]:
    """Vectors (ent, dim, x) of two_convolutions() after gradient descent on the start values, and each epoch's loss before its step.

    pairs (e1, e2) are nodes of the one graph adj (i, j, w), whose start vectors have all dims; nodes are drawn anew every `fresh`
    epochs. Each epoch is four products with the matrix and one loss, as jobs; its vectors are written before the next."""
    back = adj.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    places = cut(dense_ids(start.select("ent").distinct(), ["ent"], "at"))
    n, w, losses, drawn = places.count(), cut(start.select("ent", "dim", "x")), [], None
    named = lambda c, f: places.select(F.col("at").alias(c), F.col("ent").alias(f))
    for epoch in range(epochs):
        if epoch % fresh == 0:
            one, two = (negatives(pairs, n, k, 2 * epoch + s).withColumnRenamed("negative", f"n{s}") for s in (1, 2))
            drawn = cut(one.join(two, ["e1", "e2", "draw"]).join(named("n1", "f1"), "n1").join(named("n2", "f2"), "n2").select("e1", "e2", "f1", "f2"))
        hidden = cut(convolution(adj, w, False))
        out = cut(convolution(adj, hidden.withColumn("x", F.greatest("x", F.lit(0.0))), False))
        grad = cut(loss_gradient(drawn, out, margin))
        losses.append(float(grad.agg(F.max("loss")).first()[0] or 0.0))
        up = convolution(back, grad.where("ent IS NOT NULL").select("ent", "dim", F.col("g").alias("x")), False)
        passed = up.join(hidden.where("x > 0").select("ent", "dim"), ["ent", "dim"], "left_semi")
        step = convolution(back, passed, False).withColumnRenamed("x", "g")
        w = cut(w.join(step, ["ent", "dim"], "left").select("ent", "dim", (F.col("x") - rate * F.coalesce("g", F.lit(0.0))).alias("x")))
    return two_convolutions(adj, w), losses


def negatives(pairs: DataFrame, n_nodes: int, k: int, seed: int = 12306) -> DataFrame:
    """(e1, e2, draw, negative): k reproducible random nodes for each pair."""
    draws = pairs.select("e1", "e2", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    h = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(seed).cast("string"), "e1", "e2", "draw")), 1, 8), 16, 10).cast("long")
    return draws.select("e1", "e2", F.col("draw").cast("long").alias("draw"), (h % F.lit(n_nodes)).alias("negative"))


def cross_entropy(scores: DataFrame) -> DataFrame:
    """(loss, accuracy) of rows (row, class, z, label, mask): masked softmax cross-entropy and share of right top classes."""
    top = F.max("z").over(Window.partitionBy("row"))
    log_sum = top + F.log(F.sum(F.exp(F.col("z") - top)).over(Window.partitionBy("row")))
    first = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("z"), "class"))
    rows = scores.select("row", "class", "label", "mask", (log_sum - F.col("z")).alias("nll"), first.alias("first"))
    per = rows.groupBy("row").agg(F.max("mask").alias("mask"), F.sum(F.when(F.col("class") == F.col("label"), F.col("nll"))).alias("nll"), F.max(F.when(F.col("first") == 1, (F.col("class") == F.col("label")).cast("double"))).alias("hit"))
    return per.agg((F.sum(F.col("mask") * F.col("nll")) / F.sum("mask")).alias("loss"), (F.sum(F.col("mask") * F.col("hit")) / F.sum("mask")).alias("accuracy"))
