"""Dense ids, hash order and cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, one of our own if all runs on this machine (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: The innermost scope of owned() that notes what cut() writes.
_SCOPE: ContextVar[set | None] = ContextVar("tessera_scope", default=None)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; none is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose stored tables are deleted at its end, however it ends. It gives a function that keeps a table of cut() for the scope around it."""
    outer, own = _SCOPE.get(), set()
    token = _SCOPE.set(own)

    def keep(df: DataFrame) -> DataFrame:
        own.discard(df._stored)
        if outer is not None:
            outer.add(df._stored)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in own:
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that plans of iterations don't grow. A table that is stored already is given back as it is."""
    if getattr(df, "_stored", None):
        return df
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if (scope := _SCOPE.get()) is not None:
        scope.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def dense_ids(df: DataFrame, by: list[str], name: str, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df with 0-based dense ids in the order of `by`, which must be distinct. store: what writes the table that is read for it.

    Rows are sorted in range partitions; each gets its place in its partition plus the rows of the
    partitions before. No task holds all rows, unlike with a window over the whole table.
    """
    placed = store(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mono", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mono", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mono", "_part", "_before")


def ranks_within(df: DataFrame, within: list[str], by: list[str], name: str) -> DataFrame:
    """df with 0-based ranks in the order of `by` inside each group of `within`; both together must be distinct.

    Rows are sorted in range partitions by group and order. A row's rank is its place after the group's
    first row in its partition, and the group's rows in partitions before: a group of any size is spread
    over as many partitions as it fills, and none has a task of its own.
    """
    group = F.struct(*[F.col(c) for c in within])  # null groups are equal as structs
    keys = [F.col(c) for c in within] + [c if not isinstance(c, str) else F.col(c) for c in by]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mono", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_mono", 33), "_group": group})
    runs = placed.groupBy("_part", "_group").agg(F.min("_mono").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_n")  # a group has a row for each partition
    return placed.join(runs.withColumn("_before", earlier), ["_part", "_group"]).withColumn(name, F.col("_before") + F.col("_mono") - F.col("_first")).drop("_mono", "_part", "_group", "_first", "_before", "_n")


def hash_order(key) -> list:
    """Sort columns of a reproducible random order: the md5 of the key, then the key."""
    return [F.md5(F.col(key).cast("string")), F.col(key)]


class Scratch:
    """Stored tables that are deleted once nothing reads them any more."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """cut(), noted for deletion, of a table of its own."""
        out = cut(df.select("*"))
        self.tables[out._stored] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        for path in [t._stored for t in tables] or list(self.tables):
            delete(self.tables.pop(path).sparkSession, path)
