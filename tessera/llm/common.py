"""Helpers shared by the corpus operators: table access, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tables import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark then deletes the files of an execution's shuffles at its end, instead of when their plan is collected as garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Nothing reads the shuffles of what is written here once it is stored, so they go."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends, lost executors cost nothing. rows: of a file at most, if not 0."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.option("maxRecordsPerFile", rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """cut() with the rows of a key in one bucket: joined with rows that are partitioned alike, the table isn't shuffled."""
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with _freed(spark):
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._shared_path, out._named = path, name
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() or bucketed() wrote, once nothing reads it any more."""
    path = df._shared_path
    spark = df.sparkSession
    if name := getattr(df, "_named", None):
        spark.sql(f"DROP TABLE {name}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of cut() that are deleted together, but for those that a lazy result still reads."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, rows: int = 0) -> DataFrame:
        """cut(), noted for deletion."""
        self.tables.append(cut(df, rows))
        return self.tables[-1]

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """bucketed(), noted for deletion."""
        self.tables.append(bucketed(df, key, buckets))
        return self.tables[-1]

    def drop(self, *, keep: tuple[DataFrame, ...] = ()) -> None:
        """Delete the tables noted so far; those in keep stay."""
        for t in self.tables:
            if not any(t is k for k in keep):
                drop_cut(t)
        self.tables = list(keep)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; with no input rows fn isn't called."""
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of Python or numpy columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`: bounds what the worker holds of decoded text."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def remainder(mod: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo mod: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
