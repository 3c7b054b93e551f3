"""Tab-separated dataset formats, JSON documents and logs.

Files have no header; columns go by position and a line of the wrong arity fails the read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import encode

PAIR, TRIPLE, ENTITY, RELATION = "e1 long, e2 long", "h long, r long, t long", "ent_id long, uri string", "rel_id long, uri string"
URI_TRIPLE, URI_PAIR = "h string, r string, t string", "uri1 string, uri2 string"
# File names of each raw format: both graphs' triples, entity links, relation links, name-based links.
EVENT = "ts double, machine string, msg_type string, process string, iteration int, value double"
FILES = {
    "openea": (("rel_triples_1", "rel_triples_2"), "ent_links", None, None),
    "dwy": (("triples_1", "triples_2"), "ent_links", None, None),
    "2m": (("rel_triples_1", "rel_triples_2"), "ent_links", None, None),
    "dbp15k": (("s_triples", "t_triples"), "ent_ILLs", "rel_ILLs", "name_pseudo_mappings.txt"),
}


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file; an empty file has none."""
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").option("quote", "").option("escape", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Rows as text, each with a line end."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Graph:
    """A graph's dictionaries (ent_id, uri), (rel_id, uri) and triples (h, r, t)."""

    entities: DataFrame
    relations: DataFrame
    triples: DataFrame


@dataclass(frozen=True)
class Dataset:
    """Two graphs and their alignment (e1, e2, split); split is 'all' where there is none."""

    one: Graph
    two: Graph
    alignment: DataFrame
    relation_alignment: DataFrame | None = None
    names: DataFrame | None = None


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_graph(spark: SparkSession, folder: str, kg: str) -> Graph:
    """A graph in the uniform format."""
    return Graph(*(read_tsv(spark, f"{folder}/{kg}_{name}.txt", s) for name, s in (("entity_id2uri", ENTITY), ("relation_id2uri", RELATION), ("triple_rel", TRIPLE))))


def read_uniform(spark: SparkSession, folder: str, kgs: tuple[str, str]) -> Dataset:
    """A dataset in the uniform format, with its splits if it has them."""
    found = [(k, f"{folder}/{k}_alignment.txt") for k in ("train", "test") if _there(spark, f"{folder}/{k}_alignment.txt")] or [("all", f"{folder}/alignment_of_entity.txt")]
    pairs = reduce(DataFrame.unionByName, (read_tsv(spark, p, PAIR).withColumn("split", F.lit(k)) for k, p in found))
    return Dataset(read_graph(spark, folder, kgs[0]), read_graph(spark, folder, kgs[1]), pairs)


def write_uniform(data: Dataset, folder: str, kgs: tuple[str, str]) -> None:
    """All files of the uniform format; each graph's dictionaries hold its own entries."""
    for kg, g in zip(kgs, (data.one, data.two)):
        write_tsv(g.entities.select("ent_id", "uri"), f"{folder}/{kg}_entity_id2uri.txt")
        write_tsv(g.relations.select("rel_id", "uri"), f"{folder}/{kg}_relation_id2uri.txt")
        write_tsv(g.triples.select("h", "r", "t"), f"{folder}/{kg}_triple_rel.txt")
    write_tsv(data.alignment.select("e1", "e2"), f"{folder}/alignment_of_entity.txt")
    for part in ("train", "test"):
        rows = data.alignment.where(F.col("split") == part).select("e1", "e2")
        if not rows.isEmpty():
            write_tsv(rows, f"{folder}/{part}_alignment.txt")
    if data.relation_alignment is not None:
        write_tsv(data.relation_alignment.select("r1", "r2"), f"{folder}/alignment_of_relation.txt")
    if data.names is not None:
        write_tsv(data.names.select("e1", "e2"), f"{folder}/name_pseudo_mappings.txt")


def encoded(one: DataFrame, two: DataFrame, links: DataFrame, links_are_entities: bool = False) -> Dataset:
    """A dataset from uri triples and links (uri1, uri2). links_are_entities: link ends without a triple are entities too."""
    graphs = []
    for triples, end in ((one, "uri1"), (two, "uri2")):
        ents = encode.dictionary(encode.entities(triples, *([links.select(end)] if links_are_entities else [])))
        rels = encode.dictionary(encode.relations(triples), "rel_id")
        graphs.append(Graph(ents, rels, encode.encode(triples, ents, rels)))
    return Dataset(*graphs, encode.encode_pairs(links, graphs[0].entities, graphs[1].entities).withColumn("split", F.lit("all")))


def read_raw(spark: SparkSession, folder: str, kind: str) -> Dataset:
    """A dataset in one of the raw uri formats."""
    (a, b), links, rel_links, names = FILES[kind]
    data = encoded(read_tsv(spark, f"{folder}/{a}", URI_TRIPLE), read_tsv(spark, f"{folder}/{b}", URI_TRIPLE), read_tsv(spark, f"{folder}/{links}", URI_PAIR), kind == "2m")
    more = {}
    if rel_links and _there(spark, f"{folder}/{rel_links}"):
        one, two = (g.relations.select(F.col("rel_id").alias("ent_id"), "uri") for g in (data.one, data.two))
        more["relation_alignment"] = encode.encode_pairs(read_tsv(spark, f"{folder}/{rel_links}", URI_PAIR), one, two).toDF("r1", "r2")
    if names and _there(spark, f"{folder}/{names}"):
        more["names"] = encode.encode_pairs(read_tsv(spark, f"{folder}/{names}", URI_PAIR), data.one.entities, data.two.entities)
    return Dataset(data.one, data.two, data.alignment, **more)


def read_unified(spark: SparkSession, folder: str) -> Dataset:
    """A dataset in the unified-id format: each graph's ids become dense in the order of its file, relations in numeric order."""
    graphs = []
    for k in (1, 2):
        lines = read_tsv(spark, f"{folder}/ent_ids_{k}", "old long, uri string").withColumn("_at", F.monotonically_increasing_id())
        from tessera.functions.tables import dense_ids

        ents = dense_ids(lines, ["_at"], "ent_id").drop("_at")
        raw = read_tsv(spark, f"{folder}/triples_{k}", TRIPLE)
        rels = dense_ids(raw.select("r").distinct(), ["r"], "rel_id")
        ids = ents.select(F.col("old").cast("string").alias("uri"), "ent_id")
        names = rels.select(F.col("r").cast("string").alias("uri"), "rel_id")
        triples = encode.encode(raw.select(*(F.col(c).cast("string").alias(c) for c in "hrt")), ids, names)
        graphs.append((Graph(ents.select("ent_id", "uri"), names.select("rel_id", "uri"), triples), ids))
    splits = [(s, f"{folder}/ref_ent_ids{x}") for s, x in (("train", "_train"), ("test", "_test")) if _there(spark, f"{folder}/ref_ent_ids{x}")] or [("all", f"{folder}/ref_ent_ids")]
    pairs = []
    for s, path in splits:
        links = read_tsv(spark, path, PAIR).select(F.col("e1").cast("string").alias("uri1"), F.col("e2").cast("string").alias("uri2"))
        pairs.append(encode.encode_pairs(links, graphs[0][1], graphs[1][1]).withColumn("split", F.lit(s)))
    return Dataset(graphs[0][0], graphs[1][0], reduce(DataFrame.unionByName, pairs))


def read_any(spark: SparkSession, folder: str, kind: str | None = None) -> Dataset:
    """The format is told by the files that are there, or named: '2m' has the files of 'openea', but its link ends are entities even without a triple."""
    if kind is not None:
        return read_raw(spark, folder, kind)
    if _there(spark, f"{folder}/ent_ids_1"):
        return read_unified(spark, folder)
    for kind in ("openea", "dwy", "dbp15k"):
        if _there(spark, f"{folder}/{FILES[kind][0][0]}"):
            return read_raw(spark, folder, kind)
    raise FileNotFoundError(f"no known dataset in {folder}")


def write_openea(data: Dataset, folder: str) -> None:
    """The dataset with uris for ids, with empty attribute files; links also by split where there is one."""
    for k, g in ((1, data.one), (2, data.two)):
        write_tsv(encode.decode(g.triples, g.entities, g.relations), f"{folder}/rel_triples_{k}")
        write_tsv(g.triples.limit(0), f"{folder}/attr_triples_{k}")
    one, two = (g.entities.select(F.col("ent_id").alias(e), F.col("uri").alias(u)) for g, e, u in ((data.one, "e1", "u1"), (data.two, "e2", "u2")))
    links = data.alignment.join(one, "e1").join(two, "e2").select("u1", "u2", "split")
    write_tsv(links.select("u1", "u2"), f"{folder}/ent_links")
    for s in ("train", "test"):
        rows = links.where(F.col("split") == s).select("u1", "u2")
        if not rows.isEmpty():
            write_tsv(rows, f"{folder}/{s}_links")


def write_unified(data: Dataset, folder: str) -> None:
    """Both graphs in one id space: ent_ids, triples and reference pairs; the second's ids follow the first's."""
    n, m = data.one.entities.count(), data.one.relations.count()
    both = encode.unify(data.one.triples, data.two.triples, n, m)
    for k, g, shift in ((1, data.one, 0), (2, data.two, n)):
        write_tsv(g.entities.select((F.col("ent_id") + shift).alias("id"), "uri"), f"{folder}/ent_ids_{k}")
        write_tsv(both.where(F.col("kg") == k).select("h", "r", "t"), f"{folder}/triples_{k}")
    pairs = data.alignment.select("e1", (F.col("e2") + n).alias("e2"), "split")
    write_tsv(pairs.select("e1", "e2"), f"{folder}/ref_ent_ids")
    for s in ("train", "test"):
        rows = pairs.where(F.col("split") == s).select("e1", "e2")
        if not rows.isEmpty():
            write_tsv(rows, f"{folder}/ref_ent_ids_{s}")


def write_partition(data: Dataset, folder: str) -> None:
    """The links of a dataset by split, for tools that read uris: train_links, test_links, an empty valid_links, and test pairs of
    ids by whether the second graph has their end (test_alignment_valid.txt, test_alignment_invalid.txt)."""
    one, two = (g.entities.select(F.col("ent_id").alias(e), F.col("uri").alias(u)) for g, e, u in ((data.one, "e1", "u1"), (data.two, "e2", "u2")))
    links = data.alignment.join(one, "e1", "left").join(two, "e2", "left")
    for s in ("train", "test"):
        write_tsv(links.where((F.col("split") == s) & F.col("u2").isNotNull()).select("u1", "u2"), f"{folder}/{s}_links")
    write_tsv(links.limit(0).select("u1", "u2"), f"{folder}/valid_links")
    tests = links.where("split = 'test'")
    for name, there in (("valid", F.col("u2").isNotNull()), ("invalid", F.col("u2").isNull())):
        write_tsv(tests.where(there).select("e1", "e2"), f"{folder}/test_alignment_{name}.txt")


@dataclass(frozen=True)
class Joint:
    """Two graphs as one: entities (ent), relations (r), triples (h, r, t), and pairs (e1, e2, split)."""

    entities: DataFrame
    relations: DataFrame
    triples: DataFrame
    pairs: DataFrame


def read_longs(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(c0, c1, ...): the first n tab-separated numbers of each line."""
    p = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(*(p[i].cast("long").alias(f"c{i}") for i in range(n)))


def read_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, ent_id) of files of ids and uris; a uri that occurs again has the greatest of its ids."""
    lines = reduce(DataFrame.unionByName, (read_tsv(spark, p, ENTITY) for p in paths))
    return lines.groupBy("uri").agg(F.max("ent_id").alias("ent_id"))


def read_joint(spark: SparkSession, folder: str, reserve: bool = True, listed: bool = True, train: str | float = "ref_ent_ids_train") -> Joint:
    """Both graphs of a unified-id dataset as one.

    reserve: relations move up by one and relation 0 stands for a node's loop. listed: entities are those of the id files, else
    those of triples. train: the file of training pairs (with ref_ent_ids_test beside it), or the share of ref_ent_ids that trains,
    in the order of the md5 of the pair.
    """
    triples = reduce(DataFrame.unionByName, (read_tsv(spark, f"{folder}/triples_{k}", TRIPLE) for k in (1, 2)))
    if reserve:
        triples = triples.withColumn("r", F.col("r") + 1)
    rels = triples.select("r").distinct()
    if reserve:
        rels = rels.unionByName(spark.range(1).select(F.col("id").alias("r")))
    if listed:
        ents = reduce(DataFrame.unionByName, (read_longs(spark, f"{folder}/ent_ids_{k}", 1).toDF("ent") for k in (1, 2))).distinct()
    else:
        ents = triples.select(F.explode(F.array("h", "t")).alias("ent")).distinct()
    if isinstance(train, str):
        pairs = read_tsv(spark, f"{folder}/{train}", PAIR).withColumn("split", F.lit("train")).unionByName(read_tsv(spark, f"{folder}/ref_ent_ids_test", PAIR).withColumn("split", F.lit("test")))
    else:
        from tessera.functions.tables import dense_ids

        links = read_tsv(spark, f"{folder}/ref_ent_ids", PAIR).distinct()
        cut_at = int(train * links.count())
        placed = dense_ids(links.withColumn("_h", F.md5(F.concat_ws("#", "e1", "e2"))), ["_h", "e1", "e2"], "_at")
        pairs = placed.select("e1", "e2", F.when(F.col("_at") < cut_at, "train").otherwise("test").alias("split"))
    return Joint(ents, rels, triples, pairs)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(side, id, vec): embeddings of both sides, or any state of a model as rows of arrays; they replace what was there."""
    vectors.select("side", "id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(side, id, vec) of write_vectors()."""
    return spark.read.schema("side int, id long, vec array<float>").parquet(path)


def read_predictions(spark: SparkSession, path: str, kind: str = "pred_alignment_csls") -> DataFrame:
    """(part, e1, e2) of all parts' files pred_alignment.json under path, each one object whose lists hold pairs."""
    rows = spark.read.schema(f"{kind} array<array<bigint>>").option("multiLine", True).json(f"{path}/partition_*/pred_alignment.json")
    part = F.regexp_extract(F.input_file_name(), "partition_([0-9]+)/", 1).cast("long")
    return rows.select(part.alias("part"), F.explode(kind).alias("p")).select("part", F.col("p")[0].alias("e1"), F.col("p")[1].alias("e2"))


def write_documents(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one a line."""
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a schema."""
    return spark.read.schema(schema).json(path)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(ent, attr) of lines that hold an entity and any number of attributes."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return parts.select(F.element_at("p", 1).alias("ent"), F.explode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("attr"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of log_events() files."""
    return spark.read.schema(EVENT).json(path)


def log_events(spark: SparkSession, path: str, events: list[dict]) -> None:
    """Append a run's events (machine, process, iteration, msg_type, value) to a JSON-lines log."""
    rows = [(time.time(), e.get("machine"), e.get("msg_type"), e.get("process"), e.get("iteration"), float(e.get("value", 0))) for e in events]
    spark.createDataFrame(rows, EVENT).write.mode("append").json(path)
