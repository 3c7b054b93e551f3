"""Rank metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = (1, 5, 10, 50)
SUMS = (1, 5, 10, 15, 20)


def rank_metrics(ranks: DataFrame, by: list[str] | None = None, top: tuple = TOP, percent: bool = False) -> DataFrame:
    """n, mr, mrr and recall_k of ranks (rank); a NULL rank is a miss. percent: times 100, at two decimals."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    aggregates = [F.count("*").alias("n"), F.avg("rank").alias("mr"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")]
    aggregates += [(F.round(100 * hit(k), 2) if percent else hit(k)).alias(f"recall_{k}") for k in top]
    return ranks.groupBy(*(by or [])).agg(*aggregates)


def fused_ranks(one: DataFrame, two: DataFrame) -> DataFrame:
    """(e1, e2, rank) with the greater of two ranks for the same pairs (e1, e2, rank)."""
    return one.join(two.withColumnRenamed("rank", "_r"), ["e1", "e2"]).select("e1", "e2", F.greatest("rank", "_r").alias("rank"))


def reranked(scored: DataFrame) -> DataFrame:
    """(e1, e2, rank): candidates (e1, e2, rank) numbered anew by rank, then id."""
    return scored.select("e1", "e2", F.row_number().over(Window.partitionBy("e1").orderBy("rank", "e2")).cast("long").alias("rank"))


def fused_reranked(forth: DataFrame, other: DataFrame) -> DataFrame:
    """(e1, e2, rank): rows (e1, e2, rank) of candidates, numbered anew by the greater of this rank and another's for the same pair."""
    return reranked(fused_ranks(forth, other))


def coverage(test: DataFrame, present: DataFrame) -> DataFrame:
    """(part_id, test_n, kept_n, recall): how many of a part's test pairs (part_id, e1, e2) have their e2 in the part (part_id, ent)."""
    kept = test.join(present.select("part_id", F.col("ent").alias("e2")).distinct().withColumn("_in", F.lit(1)), ["part_id", "e2"], "left")
    n, k = F.count("*"), F.count("_in")
    return kept.groupBy("part_id").agg(n.alias("test_n"), k.alias("kept_n"), (k / F.nullif(n, F.lit(0))).alias("recall"))


def effectiveness(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row: coverage (weighted recall) and each metric times recall, weighted by test_n over parts (test_n, recall, names...)."""
    w = F.sum("test_n")
    return metrics.agg((F.sum(F.col("test_n") * F.col("recall")) / w).alias("recall"), *((F.sum(F.col("test_n") * F.col(m) * F.col("recall")) / w).alias(m) for m in names))


def running_time(log: DataFrame, counted: list[str], client: str) -> DataFrame:
    """(iteration, server_time, client_time, total) of log rows (iteration, machine, process, value): summed server processes, and the slowest client, as clients run side by side."""
    own = log.where(F.col("process").isin(counted)).groupBy("iteration").agg(F.sum("value").alias("server_time"))
    slow = log.where(F.col("process") == client).groupBy("iteration", "machine").agg(F.sum("value").alias("v")).groupBy("iteration").agg(F.max("v").alias("client_time"))
    none = F.lit(0.0)
    return own.join(slow, "iteration", "full").select("iteration", F.coalesce("server_time", none).alias("server_time"), F.coalesce("client_time", none).alias("client_time"), (F.coalesce("server_time", none) + F.coalesce("client_time", none)).alias("total"))


def peak_memory(log: DataFrame) -> DataFrame:
    """(peak): over machines, the greatest mean of 'after' less mean of 'before' of log rows (machine, phase, value); 0 without rows."""
    mean = lambda p: F.avg(F.when(F.col("phase") == p, F.col("value")))
    own = log.groupBy("machine").agg((mean("after") - mean("before")).alias("d"))
    return own.agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("peak"))


def similarity_sums(pairs: DataFrame, by: str = "e2") -> DataFrame:
    """(ent, score1, score5, ... score20): sums of the best 1 to 20 similarities of each entity, from pairs (rank, sim)."""
    return pairs.groupBy(F.col(by).alias("ent")).agg(*(F.sum(F.when(F.col("rank") <= k, F.col("sim"))).alias(f"score{k}") for k in SUMS))


def latest(features: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The value of the highest `order` for each key."""
    return features.groupBy(*key).agg(F.max_by(value, order).alias(value))


def min_max(features: DataFrame, by: list[str], value: str) -> DataFrame:
    """value scaled to 0..1 within each group; a constant group becomes 0."""
    group = F.struct(*[F.col(c) for c in by])  # null groups are equal as structs
    bounds = features.groupBy(group.alias("_group")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return features.withColumn("_group", group).join(bounds, "_group").withColumn(value, scaled).select(*features.columns)
