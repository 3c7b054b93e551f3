"""Two overlapping graphs from the test tables: orders, customers, nations and regions; and lineitems, parts, suppliers, nations and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triples(df: DataFrame, h, r, t) -> DataFrame:
    return df.select(h.alias("h"), r.alias("r"), t.alias("t"))


def kg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples (h, r, t) of orders, customers, nations and regions."""
    parts = [
        _triples(_table(spark, sf_dir, "orders"), _name("order", "o_orderkey"), _name("placed_by", "o_orderpriority"), _name("customer", "o_custkey")),
        _triples(_table(spark, sf_dir, "customer"), _name("customer", "c_custkey"), F.lit("in_nation"), _name("nation", "c_nationkey")),
        _triples(_table(spark, sf_dir, "nation"), _name("nation", "n_nationkey"), F.lit("in_region"), _name("region", "n_regionkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def kg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples (h, r, t) of orders, parts, suppliers, nations and regions."""
    items = _table(spark, sf_dir, "lineitem")
    parts = [
        _triples(items, _name("order", "l_orderkey"), _name("has_part", "l_returnflag"), _name("part", "l_partkey")),
        _triples(items, _name("order", "l_orderkey"), _name("supplied_by", "l_linestatus"), _name("supplier", "l_suppkey")),
        _triples(_table(spark, sf_dir, "supplier"), _name("supplier", "s_suppkey"), F.lit("in_nation"), _name("nation", "s_nationkey")),
        _triples(_table(spark, sf_dir, "nation"), _name("nation", "n_nationkey"), F.lit("in_region"), _name("region", "n_regionkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def shared(one: DataFrame, two: DataFrame) -> DataFrame:
    """(uri): entities of both graphs, which are each other's counterparts."""
    ends = [g.select(F.col(c).alias("uri"), F.lit(k).alias("side")) for k, g in ((1, one), (2, two)) for c in ("h", "t")]
    return reduce(DataFrame.unionByName, ends).groupBy("uri").agg(F.bit_or("side").alias("side")).where("side = 3 AND uri IS NOT NULL").select("uri")


# The same graphs in SQL, for oracles.
KG1_SQL = """SELECT 'order:'||o_orderkey h, 'placed_by:'||o_orderpriority r, 'customer:'||o_custkey t FROM orders
UNION ALL SELECT 'customer:'||c_custkey, 'in_nation', 'nation:'||c_nationkey FROM customer
UNION ALL SELECT 'nation:'||n_nationkey, 'in_region', 'region:'||n_regionkey FROM nation"""
KG2_SQL = """SELECT 'order:'||l_orderkey h, 'has_part:'||l_returnflag r, 'part:'||l_partkey t FROM lineitem
UNION ALL SELECT 'order:'||l_orderkey, 'supplied_by:'||l_linestatus, 'supplier:'||l_suppkey FROM lineitem
UNION ALL SELECT 'supplier:'||s_suppkey, 'in_nation', 'nation:'||s_nationkey FROM supplier
UNION ALL SELECT 'nation:'||n_nationkey, 'in_region', 'region:'||n_regionkey FROM nation"""
