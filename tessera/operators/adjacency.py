"""Relation weights and adjacency matrices in coordinate form (i, j, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tables import Scratch, cut, dense_ids


def functionality(triples: DataFrame) -> DataFrame:
    """(r, func, ifunc): distinct heads, and distinct tails, over triples."""
    n = F.count("*").cast("double")
    return triples.groupBy("r").agg((F.countDistinct("h") / n).alias("func"), (F.countDistinct("t") / n).alias("ifunc"))


def weighted(triples: DataFrame, least: float = 0.3) -> DataFrame:
    """(i, j, w): row i receives from column j. A triple adds its relation's ifunc to (t, h) and func to (h, t); loops are skipped."""
    f = functionality(triples)
    own = triples.where("h <> t").join(F.broadcast(f), "r")  # one row per relation name
    forth = own.select(F.col("t").alias("i"), F.col("h").alias("j"), F.greatest("ifunc", F.lit(least)).alias("w"))
    back = own.select(F.col("h").alias("i"), F.col("t").alias("j"), F.greatest("func", F.lit(least)).alias("w"))
    return forth.unionByName(back).groupBy("i", "j").agg(F.sum("w").alias("w"))


def symmetric_norm(adj: DataFrame, ents: DataFrame | None = None) -> DataFrame:
    """D^-1/2 A^T D^-1/2 of the matrix, with ones added to the diagonal for ents (ent) if given; D are row sums, 1/0 counts as 0."""
    a = adj.select("i", "j", "w")
    if ents is not None:
        a = a.unionByName(ents.select(F.col("ent").alias("i"), F.col("ent").alias("j"), F.lit(1.0).alias("w"))).groupBy("i", "j").agg(F.sum("w").alias("w"))
    d = a.groupBy("i").agg(F.sum("w").alias("d"))
    s = F.when(F.col("d") > 0, F.pow("d", F.lit(-0.5))).otherwise(0.0)
    left, right = d.select("i", s.alias("si")), d.select(F.col("i").alias("j"), s.alias("sj"))
    return a.join(left, "i").join(right, "j", "left").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("w") * F.col("si") * F.coalesce("sj", F.lit(0.0))).alias("w"))


def row_norm(adj: DataFrame) -> DataFrame:
    """Each row divided by its sum."""
    d = adj.groupBy("i").agg(F.sum("w").alias("d"))
    return adj.join(d, "i").select("i", "j", F.when(F.col("d") != 0, F.col("w") / F.col("d")).otherwise(0.0).alias("w"))


def binary(triples: DataFrame, ents: DataFrame) -> DataFrame:
    """The undirected 0/1 matrix with the diagonal of ents."""
    both = triples.select(F.col("h").alias("i"), F.col("t").alias("j")).unionByName(triples.select(F.col("t").alias("i"), F.col("h").alias("j")))
    return both.unionByName(ents.select(F.col("ent").alias("i"), F.col("ent").alias("j"))).distinct().withColumn("w", F.lit(1.0))


def pair_relations(triples: DataFrame) -> DataFrame:
    """(h, t, r, w): each relation of a pair, with 1 over the number of the pair's triples."""
    return triples.select("h", "t", "r", (F.lit(1.0) / F.count("*").over(Window.partitionBy("h", "t"))).alias("w"))


def relation_degrees(triples: DataFrame) -> DataFrame:
    """(ent, r, direction, n): how often a relation leaves ('out') and enters ('in') an entity."""
    out = triples.select(F.col("h").alias("ent"), "r", F.lit("out").alias("direction"))
    return out.unionByName(triples.select(F.col("t").alias("ent"), "r", F.lit("in").alias("direction"))).groupBy("ent", "r", "direction").agg(F.count("*").alias("n"))


def isolated(ents: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities (ent) without a triple."""
    return ents.join(triples.select(F.explode(F.array("h", "t")).alias("ent")).distinct(), "ent", "left_anti")


def top_attributes(attributes: DataFrame, top: int = 2000) -> DataFrame:
    """(ent, attr): incidence of the `top` attributes held most often; ties go to the first in order."""
    most = attributes.groupBy("attr").count().orderBy(F.desc("count"), "attr").limit(top)
    return attributes.join(F.broadcast(most), "attr", "left_semi").select("ent", "attr").distinct()


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("w").alias("v"))
    return a.select("i", F.col("j").alias("k"), "w").join(right, "k").groupBy("i", F.col("l").alias("j")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))


#: Entries of a cell's own rows, and products that a task sums at a time.
CELL, PRODUCTS = 500_000, 1_000_000


def _summed(batches: Iterator[pa.RecordBatch], products: int) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, w) of the product from a partition's cells in order: of each cell the named rows of the right matrix (stage 0: a, b, name of b, w), held, then
    the left matrix (stage 1: a, name of a, b, w), of which whole rows are taken as long as they make so many products."""
    parts, waiting, cell = [], [], None

    def held() -> tuple:
        own = pa.Table.from_batches(parts)
        a, b, w = (own[c].to_numpy() for c in ("a", "b", "w"))
        _, first, column = np.unique(b, return_index=True, return_inverse=True)
        return a, column, w, own["name"].combine_chunks().take(pa.array(first))

    def product(rows: pa.Table, right: tuple) -> Iterator[pa.RecordBatch]:
        ra, column, rw, names = right
        a, b, w = (rows[c].to_numpy() for c in ("a", "b", "w"))
        low, high = np.searchsorted(ra, b), np.searchsorted(ra, b, side="right")
        n = high - low
        ends = np.cumsum(n)
        starts = np.flatnonzero(np.diff(a, prepend=a[0] - 1))  # of the rows
        before = np.concatenate([[0], ends])
        at = 0
        while at < len(starts):
            # as many whole rows as make so many products, one at least
            to = max(at + 1, int(np.searchsorted(before[np.append(starts[1:], len(a))], before[starts[at]] + products, side="right")))
            lo, hi = starts[at], starts[to] if to < len(starts) else len(a)
            size = n[lo:hi]
            place = np.repeat(low[lo:hi] - (before[lo:hi] - before[lo]), size) + np.arange(size.sum())
            row = np.repeat(np.cumsum(np.isin(np.arange(lo, hi), starts)) - 1, size)
            key = row * len(names) + column[place]
            order = np.argsort(key, kind="stable")
            key, value = key[order], (np.repeat(w[lo:hi], size) * rw[place])[order]
            if len(key):
                each = np.flatnonzero(np.diff(key, prepend=-1))
                met = key[each]
                own = rows["name"].combine_chunks().take(pa.array(starts[at:to]))
                yield pa.RecordBatch.from_arrays([own.take(pa.array(met // len(names))), names.take(pa.array(met % len(names))), pa.array(np.add.reduceat(value, each))], names=["i", "j", "w"])
            at = to

    def ready(last: bool) -> Iterator[pa.RecordBatch]:
        """The rows that wait, but for the last one if more of it may come."""
        nonlocal waiting
        rows = pa.Table.from_batches(waiting)
        a = rows["a"].to_numpy()
        whole = len(a) if last else int(np.searchsorted(a, a[-1]))
        if whole:
            yield from product(rows.slice(0, whole), right)
            waiting = rows.slice(whole).to_batches()

    right = None
    for b in batches:
        mark = b["cell"].to_numpy() * 2 + b["stage"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1), len(mark)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if mark[lo] // 2 != cell:
                if waiting:
                    yield from ready(True)
                cell, parts, waiting, right = mark[lo] // 2, [], [], None
            if mark[lo] % 2 == 0:
                parts.append(b.slice(lo, hi - lo))
            elif parts:
                right = right or held()
                waiting.append(b.slice(lo, hi - lo))
        if waiting and sum(x.num_rows for x in waiting) >= CELL // 10:
            yield from ready(False)
    if waiting:
        yield from ready(True)


def recurrence(scaled: DataFrame, last: DataFrame, before: DataFrame) -> DataFrame:
    """2 * scaled * last - before, of matrices whose names are all among those of scaled.

    A hub's neighbours make products with the square of their number, so products aren't shuffled: the rows of scaled are dealt into cells, a cell is
    sent each row of last that it names once, and sums its own rows one after the other. `before` takes part as rows that only its own row names."""
    scratch = Scratch()
    ids = scratch.cut(dense_ids(scaled.select("i").unionByName(scaled.select(F.col("j").alias("i"))).distinct(), ["i"], "n", scratch.cut))
    of = lambda c: ids.select(F.col("i").alias(c), F.col("n").alias(f"{c}_n"))
    numbered = lambda m: scratch.cut(m.select("i", "j", "w").join(of("i"), "i").join(of("j"), "j"))
    s, b = numbered(scaled), numbered(before)
    t = s if last is scaled else numbered(last)
    cells = max(s.sparkSession.sparkContext.defaultParallelism, s.count() // CELL)
    cell = F.pmod(F.xxhash64("i_n"), F.lit(cells)).alias("cell")
    own = -1 - F.col("i_n")
    asks = s.select(cell, F.col("i_n").alias("a"), F.col("i").alias("name"), F.col("j_n").alias("b"), (F.col("w") * 2).alias("w")).unionByName(b.select(cell, F.col("i_n").alias("a"), F.col("i").alias("name"), own.alias("b"), F.lit(-1.0).alias("w")).distinct())
    rows = t.select(F.col("i_n").alias("a"), F.col("j").alias("name"), F.col("j_n").alias("b"), "w").unionByName(b.select(own.alias("a"), F.col("j").alias("name"), F.col("j_n").alias("b"), "w"))
    sent = rows.join(asks.select("cell", F.col("b").alias("a")).distinct(), "a").select("cell", "a", "name", "b", "w")
    both = sent.withColumn("stage", F.lit(0)).unionByName(asks.withColumn("stage", F.lit(1)))
    dealt = cut(both)
    scratch.drop()
    products = PRODUCTS
    return dealt.repartition(cells, "cell").sortWithinPartitions("cell", "stage", "a", "b").mapInArrow(lambda batches: _summed(batches, products), f"i {scaled.schema['i'].dataType.simpleString()}, j {scaled.schema['j'].dataType.simpleString()}, w double")


def combine(*terms: tuple[float, DataFrame]) -> DataFrame:
    """The sum of matrices, each times a factor."""
    out = None
    for factor, m in terms:
        m = m.select("i", "j", (F.col("w") * factor).alias("w"))
        out = m if out is None else out.unionByName(m)
    return out.groupBy("i", "j").agg(F.sum("w").alias("w"))


def largest_eigenvalue(a: DataFrame, rounds: int = 200, tolerance: float = 1e-8) -> float:
    """The eigenvalue of greatest magnitude of a matrix (i, j, w), symmetric or not; 0 for an empty one, its magnitude if it isn't real.
    ValueError if it isn't found in so many rounds.

    Arnoldi's recurrence over dense numbers of the nodes: a round writes one table, each node's elements of the vectors
    so far and of the last one's product, and sums its inner products with them; only these sums are on the driver. It ends when
    the residual, which the last component of their matrix's eigenvector gives, is within the tolerance."""
    start = a.select("i").unionByName(a.select(F.col("j").alias("i"))).distinct()
    scratch = Scratch()
    ids = scratch.cut(dense_ids(start, ["i"], "n", scratch.cut))
    of = lambda c: ids.select(F.col("i").alias(c), F.col("n").alias(f"{c}_n"))
    a = scratch.cut(a.join(of("i"), "i").join(of("j"), "j").select(F.col("i_n").alias("i"), F.col("j_n").alias("j"), "w"))
    drawn = ids.select(F.col("n").alias("i"), (F.pmod(F.xxhash64("i"), F.lit(2**31)) / F.lit(2.0**31) + 0.5).alias("v"))
    n = drawn.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
    if not n:
        scratch.drop()
        return 0.0
    step, stored = drawn.select("i", F.array(F.col("v") / n).alias("q")), None
    inner = lambda t, k: np.array(t.agg(*[F.sum(F.col("q")[c] * F.col("u")) for c in range(k)], F.sum(F.col("u") * F.col("u"))).first())
    h = np.zeros((rounds + 1, rounds))
    for k in range(1, rounds + 1):
        product = a.join(step.select(F.col("i").alias("j"), F.element_at("q", -1).alias("v")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("v")).alias("u"))
        both = scratch.cut(step.join(product, "i", "left").select("i", "q", F.coalesce("u", F.lit(0.0)).alias("u")))
        if stored is not None:
            scratch.drop(stored)
        stored = rest = both
        for _ in range(2):  # what rounding leaves of the earlier vectors is taken off once more
            *found, _square = inner(rest, k)
            h[:k, k - 1] += found
            rest = rest.select("i", "q", (F.col("u") - sum(F.col("q")[c] * F.lit(float(x)) for c, x in enumerate(found))).alias("u"))
        left = float(np.sqrt(rest.agg(F.sum(F.col("u") * F.col("u"))).first()[0]))
        values, vectors = np.linalg.eig(h[:k, :k])
        top = int(np.argmax(np.abs(values)))
        if left * abs(vectors[-1, top]) <= tolerance * max(1.0, abs(values[top])):
            scratch.drop()
            value = complex(values[top])
            return value.real if abs(value.imag) <= tolerance * abs(value) else abs(value)
        h[k, k - 1] = left
        step = rest.select("i", F.concat("q", F.array(F.col("u") / left)).alias("q"))
    scratch.drop()
    raise ValueError(f"no eigenvalue within {tolerance} after {rounds} rounds")


def alternates(a: DataFrame, rounds: int = 30) -> bool | None:
    """Whether some component of a matrix (i, j, w) without negative elements has two sides, every element leading from one to the other, and
    no row without a sum. None if that isn't known after so many rounds, about twice the longest distance being needed.

    Each node has the least number that reaches it by walks of even length, and of odd length; they stay apart where there are two sides."""
    scratch = Scratch()
    pairs = a.where("w > 0").select("i", "j")
    nodes = a.select("i").unionByName(a.select(F.col("j").alias("i"))).distinct()
    ids = scratch.cut(dense_ids(nodes.join(pairs.select("i", F.lit(True).alias("led")).distinct(), "i", "left"), ["i"], "n", scratch.cut))
    of = lambda c: ids.select(F.col("i").alias(c), F.col("n").alias(f"{c}_n"))
    once = pairs.join(of("i"), "i").join(of("j"), "j").select(F.least("i_n", "j_n").alias("x"), F.greatest("i_n", "j_n").alias("y")).distinct()
    both = once.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
    dead = ids.where("led IS NULL").select(F.col("n").alias("x"), F.col("n").alias("y"))
    edges = scratch.cut(both.unionByName(dead))  # a row without a sum counts as a loop, which has no two sides
    state = scratch.cut(ids.select(F.col("n").alias("x"), F.col("n").alias("even"), F.lit(None).cast("long").alias("odd"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        # only what has moved is sent
        sent = edges.join(state.where("moved").select("x", F.col("even").alias("o"), F.col("odd").alias("e")), "x").groupBy(F.col("y").alias("x")).agg(F.min("e").alias("e"), F.min("o").alias("o"))
        even, odd = F.least("even", "e"), F.least("odd", "o")
        new = scratch.cut(state.join(sent, "x", "left").select("x", even.alias("even"), odd.alias("odd"), (~even.eqNullSafe(F.col("even")) | ~odd.eqNullSafe(F.col("odd"))).alias("moved")))
        scratch.drop(state)
        state = new
        moved, apart = state.agg(F.coalesce(F.max("moved"), F.lit(False)), F.coalesce(F.max(~F.col("even").eqNullSafe(F.col("odd"))), F.lit(False))).first()
        if not (moved and apart):  # numbers that have met stay together
            scratch.drop()
            return apart
    scratch.drop()
    return None


def chebyshev(adj: DataFrame, ents: DataFrame, order: int) -> list[DataFrame]:
    """T_0 to T_order of the scaled Laplacian 2 (I - A_norm) / lambda_max - I."""
    eye = ents.select(F.col("ent").alias("i"), F.col("ent").alias("j"), F.lit(1.0).alias("w"))
    laplacian = cut(combine((1.0, eye), (-1.0, symmetric_norm(adj))))
    # A_norm is similar to a matrix whose rows sum to 1, so lambda_max is at most 2, which a component of two sides has.
    # A_norm need not be symmetric.
    largest = 2.0 if alternates(adj) else largest_eigenvalue(laplacian)
    scaled = cut(combine((2.0 / largest, laplacian), (-1.0, eye)))
    out = [eye, scaled]
    for _ in range(2, order + 1):
        out.append(recurrence(scaled, out[-1], out[-2]))
    return out[: order + 1]
