"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than ROWS, or than a KEYS-th of all rows, is hot: there are at most KEYS hot keys.
ROWS, KEYS = 1000, 100_000


def _least(total: int | None) -> int:
    return max(ROWS, (total or 0) // KEYS)


def by_unique(rows: DataFrame, unique: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """rows joined with the keys (a column or several) of `unique`, whose column n says how many of rows a key has at most.

    unique has one row for each key and is stored. Its hot keys, at most KEYS of them, are broadcast, so
    their rows stay where they are; all other keys have few rows and are shuffled."""
    least = _least(unique.agg(F.sum(n)).first()[0])
    hot = F.broadcast(unique.where(F.col(n) > least).drop(n))
    few = unique.where(F.col(n) <= least).drop(n)
    names = [*rows.columns, *(c for c in few.columns if c not in ([key] if isinstance(key, str) else key))]
    cold = rows.join(hot.select(key), key, "left_anti").join(few, key).select(names)
    return rows.join(hot, key).select(names).unionByName(cold)


def salted(rows: DataFrame, unique: DataFrame, key: str, by: str) -> DataFrame:
    """rows, a stored table, joined with unique on key; the rows of a hot key are dealt by the column `by` over as many tasks as they need, each with its own copy of the key's row."""
    least = _least(rows.count())
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_salts")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))).drop("_salts")
    right = unique.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
