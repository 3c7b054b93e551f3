"""Subgraphs and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import cut, ranks_within

#: Values of a segment of a long list.
SEGMENT = 10_000


def ordered_ends() -> list:
    """Columns a and b of triples: the ends in their order, a null first."""
    forth = F.coalesce(F.col("h") <= F.col("t"), F.col("h").isNull())
    return [F.when(forth, F.col("h")).otherwise(F.col("t")).alias("a"), F.when(forth, F.col("t")).otherwise(F.col("h")).alias("b")]


def both_ways(one: str, two: str):
    """Column e with a row for each direction of an edge (a, b): structs (one, two); a loop has one."""
    forth, back = F.struct(F.col("a").alias(one), F.col("b").alias(two)), F.struct(F.col("b").alias(one), F.col("a").alias(two))
    return F.explode(F.when(F.col("a").eqNullSafe(F.col("b")), F.array(forth)).otherwise(F.array(forth, back))).alias("e")


def undirected(triples: DataFrame) -> DataFrame:
    """Distinct edges (a, b) in both directions, without relations."""
    once = triples.select(*ordered_ends()).distinct()  # one row an edge is shuffled
    return once.select(both_ways("a", "b")).select("e.*")


def induced(triples: DataFrame, ents: DataFrame) -> DataFrame:
    """Triples with both ends among ents (ent).

    The entities of a partition are held as a hash table (one row an entity, so no hub makes it larger), and the triples,
    of which there are many more, aren't sorted."""
    among = lambda end: ents.select(F.col("ent").alias(end)).hint("shuffle_hash")
    return triples.join(among("h"), "h", "left_semi").join(among("t"), "t", "left_semi").select("h", "r", "t")


def induced_by_part(triples: DataFrame, members: DataFrame) -> DataFrame:
    """For all parts at once: the part's triples with both ends among its members (part_id, ent)."""
    m = members.distinct()
    return triples.join(m.select("part_id", F.col("ent").alias("h")), "h").join(m.select("part_id", F.col("ent").alias("t")), ["part_id", "t"], "left_semi").select("part_id", "h", "r", "t")


def _with_end(pairs: DataFrame, ents: DataFrame, end: str) -> DataFrame:
    parts = [c for c in ents.columns if c == "part_id"]
    return pairs.join(ents.select(*parts, F.col("ent").alias(end)).distinct(), end, "inner" if parts else "left_semi")


def pairs_with_head(pairs: DataFrame, ents: DataFrame) -> DataFrame:
    """Pairs whose e1 is among ents (ent); with parts (part_id, ent), the pairs of each part. Repeated pairs stay."""
    return _with_end(pairs, ents, "e1")


def pairs_with_tail(pairs: DataFrame, ents: DataFrame) -> DataFrame:
    """Pairs whose e2 is among ents (ent); with parts (part_id, ent), the pairs of each part. Repeated pairs stay."""
    return _with_end(pairs, ents, "e2")


def anchors(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(part_id, ent): the second graph's ends of pairs whose e1 is a member of the part."""
    return pairs.join(members.select("part_id", F.col("ent").alias("e1")), "e1").select("part_id", F.col("e2").alias("ent")).distinct()


def hop_levels(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(part_id, ent, hop) of all entities 1 to `hops` edges from the part's seeds (part_id, ent), seeds left out.

    All parts advance together; lineage is cut at each hop and an empty frontier ends it.
    """
    edges = cut(edges)
    frontier = cut(seeds.select("part_id", "ent").distinct())
    seen, out = frontier, None
    for hop in range(1, hops + 1):
        step = frontier.join(edges, frontier.ent == edges.a).select("part_id", F.col("b").alias("ent")).distinct().join(seen, ["part_id", "ent"], "left_anti")
        frontier = cut(step.select("part_id", "ent"))
        level = frontier.withColumn("hop", F.lit(hop).cast("long"))
        out = level if out is None else out.unionByName(level)
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return out


def anchor_hop(edges: DataFrame, part: DataFrame, anchors_: DataFrame, hops: int) -> DataFrame:
    """Anchors met within `hops` edges of the part's entities (part_id, ent), the part's own left out. On
    the last hop, if it isn't the first, both ends of the edges from the frontier to an anchor are kept."""
    edges, keep = cut(edges), anchors_.select("ent").distinct()
    frontier = part.select("part_id", "ent").distinct()
    seen, out = frontier, None
    for hop in range(1, hops + 1):
        edge = frontier.join(edges, frontier.ent == edges.a).select("part_id", F.col("a"), F.col("b").alias("ent")).join(seen, ["part_id", "ent"], "left_anti")
        if hop == hops and hop > 1:
            hit = edge.join(keep, "ent", "left_semi")
            found = hit.select("part_id", F.explode(F.array("a", "ent")).alias("ent")).distinct()
        else:
            found = edge.select("part_id", "ent").distinct().join(keep, "ent", "left_semi").select("part_id", "ent")
        out = found if out is None else out.unionByName(found)
        if hop < hops:
            frontier = cut(edge.select("part_id", "ent").distinct())
            seen = seen.unionByName(frontier)
    return out.distinct()


def linking_entities(edges: DataFrame, anchors_: DataFrame, unmatched: DataFrame, hops: int) -> DataFrame:
    """(ent, step): entities inside shortest paths of 2 to `hops` edges from an anchor to an unmatched entity, with the least length of such a path."""
    seen = cut(anchors_.select("ent").distinct())
    targets, steps, at, out = unmatched.select("ent").distinct(), [], seen, None
    for step in range(1, hops + 1):
        # Edges (a, b) from the last level to entities that no shorter path reaches.
        edge = cut(at.join(edges, at.ent == edges.a).select("a", F.col("b").alias("ent")).join(seen, "ent", "left_anti").select("a", F.col("ent").alias("b")).distinct())
        steps.append(edge)
        at = cut(edge.select(F.col("b").alias("ent")).distinct())
        seen = seen.unionByName(at)
        # From the targets of this level back to the first one: no path is written out.
        back = at.join(targets, "ent", "left_semi")
        for earlier in reversed(steps[1:]):
            back = earlier.join(back.select(F.col("ent").alias("b")), "b", "left_semi").select(F.col("a").alias("ent")).distinct()
            found = back.withColumn("step", F.lit(step).cast("long"))
            out = found if out is None else out.unionByName(found)
        if at.isEmpty():
            break
    if out is None:
        return seen.where("false").select("ent", F.lit(0).cast("long").alias("step"))
    return out.groupBy("ent").agg(F.min("step").alias("step"))


def segments(rows: DataFrame, key: list[str], value: str, name: str, longest: int = SEGMENT) -> DataFrame:
    """(key..., segment, name): the distinct values of each key in their order, in arrays of at most `longest`, numbered from 0.

    However many values a key has, no row or task holds more than one segment of them."""
    ranked = ranks_within(rows.select(*key, value).distinct(), key, [value], "_at")
    own = ranked.withColumn("segment", F.floor(F.col("_at") / longest).cast("long"))
    return own.groupBy(*key, "segment").agg(F.sort_array(F.collect_list(value)).alias(name))


def of_segments(lists: DataFrame, name: str, value: str) -> DataFrame:
    """The rows that segments() were made of: each value beside its key."""
    return lists.withColumn(value, F.explode(name)).drop("segment", name)


def adjacency_segments(triples: DataFrame, ents: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """(ent, segment, neighbours): the neighbours of every entity in segments; an isolated one has one, which is empty."""
    near = segments(undirected(triples), ["a"], "b", "neighbours", longest).withColumnRenamed("a", "ent")
    none = F.array().cast(near.schema["neighbours"].dataType)
    return ents.select("ent").distinct().join(near, "ent", "left").select("ent", F.coalesce("segment", F.lit(0)).alias("segment"), F.coalesce("neighbours", none).alias("neighbours"))


def head_tail_segments(triples: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """(r, side, segment, ents): the heads and the tails of each relation in segments."""
    ends = F.explode(F.array(F.struct(F.lit("head").alias("side"), F.col("h").alias("ent")), F.struct(F.lit("tail").alias("side"), F.col("t").alias("ent"))))
    return segments(triples.select("r", ends.alias("e")).select("r", "e.*"), ["r", "side"], "ent", "ents", longest)
