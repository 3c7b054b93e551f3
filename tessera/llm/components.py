"""Connected components by alternating large-star and small-star steps on DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut

#: Up to so many ids are broadcast as a filter (16 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def filtered(docs: DataFrame, ids: DataFrame, how: str, count: int) -> DataFrame:
    """docs semi- or anti-joined with the distinct doc_ids of ids, of which there are `count`."""
    ids = ids.select("doc_id")
    return docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", how)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every end of links (u, v): the smallest id that is reachable.

    Each round joins links with the smallest neighbour of their ends, so no round gathers a
    component in one task; rounds grow with the logarithm of a component's diameter. Self-links
    are ignored, repeated links count once, and no links give no rows.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = cut(small)
        drop_cut(edges)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    tops = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id"))
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(tops).distinct()
