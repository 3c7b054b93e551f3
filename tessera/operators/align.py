"""Counterpart discovery, contexts, subtasks and seed exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tables import Scratch, cut, ranks_within
from tessera.functions.vectors import squash
from tessera.operators import evidence
from tessera.operators.graph import anchor_hop, hop_levels, induced_by_part, undirected


def distance_weights(levels: DataFrame) -> DataFrame:
    """(part_id, ent, weight): the part's greatest hop less the entity's."""
    most = levels.groupBy("part_id").agg(F.max("hop").alias("most"))
    return levels.join(F.broadcast(most), "part_id").select("part_id", "ent", (F.col("most") - F.col("hop")).alias("weight"))


def top_per_part(scored: DataFrame, score: str, size: DataFrame | int) -> DataFrame:
    """The best rows of each part by score, ties (at 9 decimals) to the lower entity. size: a number, or (part_id, size), which may
    be nearly the part's rows: these are then ranked in range partitions, not a part in a task. (part_id, ent) is distinct."""
    order = [F.desc(F.round(score, 9)), F.col("ent")]
    if isinstance(size, int):
        rank = F.row_number().over(Window.partitionBy("part_id").orderBy(*order))
        return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= size)
    ranked = ranks_within(scored, ["part_id"], order, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.select(*scored.columns, "rank").join(size, "part_id").where(F.col("rank") <= F.greatest("size", F.lit(0))).drop("size")


def counterparts(edges: DataFrame, part_anchors: DataFrame, size: int, layers: int, features: DataFrame | None = None, alpha: float = 0.9, beta: float = 1.0) -> DataFrame:
    """(part_id, ent, weight, rank): the second graph's likely region of each part, by closeness to its
    anchors (part_id, ent) and, where there are features (part_id, ent, sim scaled to 0..1), by (sim - alpha) * beta."""
    w = distance_weights(hop_levels(edges, part_anchors, 2 * layers)).withColumn("weight", F.col("weight").cast("double"))
    if features is not None:
        add = (F.col("sim") - alpha) * beta
        w = w.join(features, ["part_id", "ent"], "left").select("part_id", "ent", (F.col("weight") + F.coalesce(add, F.lit(0.0))).alias("weight"))
    return top_per_part(w, "weight", size)


def restricted_region(triples: DataFrame, members: DataFrame, anchors_: DataFrame) -> DataFrame:
    """(part_id, ent): the part's entities and the anchors (ent) next to them: the graph in which a client looks for context."""
    near = anchor_hop(undirected(triples), members, anchors_, 1)
    return members.select("part_id", "ent").unionByName(near).distinct()


def first_context(benefit: DataFrame, unmatched: DataFrame, size: int) -> DataFrame:
    """(part_id, ent, benefit, rank): each part's most useful context entities: as many as the size less its
    unmatched entities; unmatched ones aren't candidates. benefit is (part_id, ent, benefit)."""
    left = unmatched.groupBy("part_id").agg((F.lit(size) - F.countDistinct("ent")).alias("size"))
    return top_per_part(benefit.join(unmatched.select("part_id", "ent"), ["part_id", "ent"], "left_anti"), "benefit", left)


def second_context(candidates: DataFrame, part_anchors: DataFrame, size: int) -> DataFrame:
    """(part_id, ent, role): all anchors of the part, then its candidates (part_id, ent, rank) that aren't, in order, up to the size."""
    own = part_anchors.select("part_id", "ent").distinct()
    room = own.groupBy("part_id").agg(F.count("*").alias("_n"))
    rest = candidates.join(own, ["part_id", "ent"], "left_anti")
    at = F.row_number().over(Window.partitionBy("part_id").orderBy("rank"))
    kept = rest.withColumn("_at", at).join(room, "part_id", "left").where(F.col("_at") <= F.greatest(F.lit(size) - F.coalesce("_n", F.lit(0)), F.lit(0)))
    return own.withColumn("role", F.lit("anchor")).unionByName(kept.select("part_id", "ent", F.lit("candidate").alias("role")))


def connectors(triples: DataFrame, unmatched: DataFrame, part_anchors: DataFrame, size: int, layers: int = 1, gamma: float = 2.0) -> DataFrame:
    """(part_id, ent, benefit, rank): the second graph's entities next to a part's anchors that bring its unmatched ones
    (part_id, ent) the most evidence, at most `size` for each part. Each part looks only at the graph between these three."""
    if layers == 1:
        return top_per_part(_one_layer(triples, unmatched, part_anchors, gamma), "benefit", size)
    near = hop_levels(undirected(triples), part_anchors, 1).select("part_id", "ent")
    fixed = unmatched.select("part_id", "ent").unionByName(part_anchors.select("part_id", "ent")).distinct()
    region = fixed.unionByName(near).distinct()
    candidates = near.join(fixed, ["part_id", "ent"], "left_anti").distinct()
    node = lambda c: F.struct("part_id", F.col(c).alias("ent"))
    keyed = lambda t: t.select("part_id", node("ent").alias("ent"))
    inside = induced_by_part(triples, region).select(node("h").alias("h"), "r", node("t").alias("t"))
    edges = evidence.evidence_edges(inside, keyed(region).select("ent"))
    found = evidence.benefits(keyed(part_anchors).select("ent"), keyed(unmatched), keyed(candidates).select("ent"), edges, layers, gamma)
    scored = candidates.join(found.select("part_id", F.col("ent.ent").alias("ent"), "benefit"), ["part_id", "ent"], "left")
    return top_per_part(scored.withColumn("benefit", F.coalesce("benefit", F.lit(0.0))), "benefit", size)


def _one_layer(triples: DataFrame, unmatched: DataFrame, part_anchors: DataFrame, gamma: float) -> DataFrame:
    """(part_id, ent, benefit) of connectors() with one layer, for which triples are shuffled once by each end.

    All that has evidence after a layer is an anchor or next to one, so it is in the part's graph. A candidate isn't an anchor, so without it
    only its own evidence is lost: an unmatched neighbour gets less by the candidate's share."""
    scratch = Scratch()
    mine, open_ = (t.select("part_id", "ent").where("ent IS NOT NULL").distinct() for t in (part_anchors, unmatched))
    of = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("part_id")))
    every = mine.withColumn("role", F.lit(0)).unionByName(open_.withColumn("role", F.lit(1)))
    roles = scratch.cut(every.groupBy("ent").agg(of(0).alias("anchor"), of(1).alias("goal")))
    at = lambda end: roles.select(F.col("ent").alias(end), F.struct("anchor", "goal").alias(f"{end}_"))
    known = triples.select("h", "t").join(at("h"), "h", "left").join(at("t"), "t", "left")
    marked = scratch.cut(known.where("h_ IS NOT NULL OR t_ IS NOT NULL"))
    ways = [(a, b, f"{a}_") for a, b in (("h", "t"), ("t", "h"))]
    # Evidence of anchors and of what is next to them; a loop for each anchor, and for each unmatched entity below.
    first = mine.select("part_id", F.col("ent").alias("v"))
    for a, b, own in ways:
        first = first.unionByName(marked.select(F.explode(f"{own}.anchor").alias("part_id"), F.col(b).alias("v")))
    x = F.count("*").cast("double")
    first = scratch.cut(first.groupBy("part_id", "v").agg(x.alias("x")).select("part_id", "v", squash(F.col("x") / (F.col("x") + evidence.EPS), gamma).alias("d")))
    to = open_.select("part_id", F.col("ent").alias("v"), F.col("ent").alias("u"))
    for a, b, own in ways:
        to = to.unionByName(marked.select(F.explode(f"{own}.goal").alias("part_id"), F.col(b).alias("v"), F.col(a).alias("u")))
    # Rows of an unmatched entity lie together, so neither its neighbours nor its whole evidence are shuffled again.
    each = to.join(first, ["part_id", "v"]).repartition("part_id", "u").groupBy("part_id", "u", "v").agg((F.count("*") * F.max("d")).alias("d"))
    each = each.withColumn("x", F.sum("d").over(Window.partitionBy("part_id", "u"))).where("u <> v")
    less = squash(F.col("x") / (F.col("x") + evidence.EPS), gamma) - squash((F.col("x") - F.col("d")) / (F.col("x") + evidence.EPS), gamma)
    found = each.groupBy("part_id", F.col("v").alias("ent")).agg(F.sum(less).alias("benefit"))
    fixed = mine.unionByName(open_)
    candidates = first.select("part_id", F.col("v").alias("ent")).join(fixed, ["part_id", "ent"], "left_anti")
    out = cut(candidates.join(found, ["part_id", "ent"], "left").select("part_id", "ent", F.coalesce("benefit", F.lit(0.0)).alias("benefit")))
    scratch.drop()
    return out


def subtasks(triples1: DataFrame, triples2: DataFrame, members1: DataFrame, context1: DataFrame, members2: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Tables of all subtasks, keyed by part_id: triples of both sides and pairs (e1, e2, split). Training
    pairs may start at members or context, test pairs at members only; both must end in the part."""
    all1 = members1.unionByName(context1).select("part_id", "ent").distinct()
    heads = lambda m: m.select("part_id", F.col("ent").alias("e1")).distinct()
    tails = members2.select("part_id", F.col("ent").alias("e2")).distinct()
    train = pairs.where("split = 'train'").join(heads(all1), "e1")
    test = pairs.where("split = 'test'").join(heads(members1), "e1")
    return {"triples1": induced_by_part(triples1, all1), "triples2": induced_by_part(triples2, members2), "pairs": train.unionByName(test).join(tails, ["part_id", "e2"], "left_semi").select("part_id", "e1", "e2", "split")}


def collected_seeds(seeds: DataFrame) -> DataFrame:
    """(e1, e2): all parts' seeds, once each."""
    return seeds.select("e1", "e2").distinct()


def merged_seeds(old: DataFrame, new: DataFrame, policy: str = "first_wins") -> DataFrame:
    """old and new seeds (part_id, e1, e2). first_wins: a new seed counts only if its part has none for e1; accumulate: all count."""
    fresh = new.join(old.select("part_id", "e1").distinct(), ["part_id", "e1"], "left_anti") if policy == "first_wins" else new
    return old.select("part_id", "e1", "e2").unionByName(fresh.select("part_id", "e1", "e2")).distinct()
