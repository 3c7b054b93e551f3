"""Evidence passing and the benefit of context entities.

The benefit of a candidate is how much less evidence unmatched entities get without it. All candidates
are taken at once: for each, only the entities whose evidence changes have a row, so a layer is one
join with the edges and one sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import cut
from tessera.functions.vectors import squash
from tessera.operators.graph import both_ways, ordered_ends

EPS = 1e-8


def evidence_edges(triples: DataFrame, ents: DataFrame) -> DataFrame:
    """(src, dst, mult): both directions of every triple and a loop for every entity (ent), with multiplicities."""
    once = triples.select(*ordered_ends(), F.when(F.col("h").eqNullSafe(F.col("t")), 2.0).otherwise(1.0).alias("n"))
    counted = once.unionByName(ents.select(F.col("ent").alias("a"), F.col("ent").alias("b"), F.lit(1.0).alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("mult"))  # one row an edge is shuffled
    return counted.select(both_ways("src", "dst"), "mult").select("e.*", "mult")


def propagate(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(ent, x): sums over incoming edges of x (ent, x); absent entities count 0."""
    return edges.join(x, edges.src == x.ent).groupBy(F.col("dst").alias("ent")).agg(F.sum(F.col("mult") * F.col("x")).alias("x"))


def _states(x: DataFrame, edges: DataFrame, layers: int) -> list[DataFrame]:
    out = [cut(x)]
    for _ in range(layers):
        out.append(cut(propagate(out[-1], edges)))
    return out


def _moved(delta: DataFrame | None, own: DataFrame, candidates: DataFrame) -> DataFrame:
    """delta (c, v, d) with row (c, c) replaced by the candidate's own value."""
    at = candidates.join(own, candidates.c == own.ent).select("c", F.col("c").alias("v"), F.col("x").alias("d"))
    return at if delta is None else delta.where("c <> v").select("c", "v", "d").unionByName(at)


def _deltas(start: DataFrame | None, states: list[DataFrame], edges: DataFrame, candidates: DataFrame) -> DataFrame:
    delta = _moved(start, states[0], candidates)
    for own in states[1:]:
        delta = delta.join(edges, delta.v == edges.src).groupBy("c", F.col("dst").alias("v")).agg(F.sum(F.col("mult") * F.col("d")).alias("d"))
        delta = cut(_moved(delta, own, candidates))
    return delta


def counts(anchors: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """(ent, x): evidence paths of `layers` edges from anchors (ent)."""
    x = anchors.select("ent").distinct().withColumn("x", F.lit(1.0))
    for _ in range(layers):
        x = propagate(x, edges)
    return x


def weights(n: DataFrame, gamma: float) -> DataFrame:
    """(ent, x): squashed share of the evidence itself, which is near 1 wherever there is some."""
    return n.select("ent", squash(F.col("x") / (F.col("x") + EPS), gamma).alias("x"))


def base(anchors: DataFrame, unmatched: DataFrame, edges: DataFrame, layers: int, gamma: float) -> DataFrame:
    """(part_id, base): expected matches among the part's unmatched entities (part_id, ent)."""
    n2 = weights(counts(anchors, edges, layers), gamma)
    for _ in range(layers):
        n2 = propagate(n2, edges)
    p = weights(n2, gamma)
    return unmatched.join(p, "ent", "left").groupBy("part_id").agg(F.sum(F.coalesce("x", F.lit(0.0))).alias("base"))


def benefits(anchors: DataFrame, unmatched: DataFrame, candidates: DataFrame, edges: DataFrame, layers: int = 1, gamma: float = 2.0) -> DataFrame:
    """(ent, part_id, benefit) of every candidate (ent) for every part it matters to; unmatched is (part_id, ent).

    Candidates without a row have benefit 0. Rows grow with the candidates' neighbourhoods of 2 * layers
    edges: around hubs use few layers or subgraphs.
    """
    edges = cut(edges)
    c = cut(candidates.select(F.col("ent").alias("c")).distinct())
    one = _states(anchors.select("ent").distinct().withColumn("x", F.lit(1.0)), edges, layers)
    n1 = one[-1]
    d = _deltas(None, one, edges, c)
    change = squash(F.col("x") / (F.col("x") + EPS), gamma) - squash((F.col("x") - F.col("d")) / (F.col("x") + EPS), gamma)
    d = d.join(n1, d.v == n1.ent).select("c", "v", change.alias("d")).where("d <> 0")
    two = _states(weights(n1, gamma), edges, layers)
    d = _deltas(d, two[:-1], edges, c)
    # The last layer goes to unmatched entities only, whose evidence and parts come along with its edges: its sums needn't be stored or joined again.
    goal = cut(unmatched.select("part_id", F.col("ent").alias("dst")).distinct().join(two[-1].withColumnRenamed("ent", "dst"), "dst").select("part_id", "dst", "x"))
    last = edges.join(goal, "dst").select("part_id", "src", "dst", "mult", "x")
    reached = d.join(last, d.v == last.src).where("c <> dst").groupBy("c", "dst", "part_id").agg(F.sum(F.col("mult") * F.col("d")).alias("d"), F.max("x").alias("x"))
    own = c.join(goal, c.c == goal.dst).select("c", "dst", "part_id", F.col("x").alias("d"), "x")
    return reached.unionByName(own).select("c", "part_id", change.alias("d")).where("d <> 0").groupBy(F.col("c").alias("ent"), "part_id").agg(F.sum("d").alias("benefit"))
