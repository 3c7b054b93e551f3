"""Dictionary encoding, id spaces and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tables import dense_ids, ranks_within


def entities(triples: DataFrame, *links: DataFrame) -> DataFrame:
    """Distinct entities (uri) of the triples' ends, and of one-column tables of link ends. Heads and tails are read by themselves, which takes less than an array for each triple."""
    out = triples.select(F.col("h").alias("uri")).unionByName(triples.select(F.col("t").alias("uri")))
    for link in links:
        out = out.unionByName(link.toDF("uri"))
    return out.distinct()


def relations(triples: DataFrame) -> DataFrame:
    """Distinct relations (uri)."""
    return triples.select(F.col("r").alias("uri")).distinct()


def dictionary(values: DataFrame, name: str = "ent_id") -> DataFrame:
    """uri with dense 0-based ids in code-point order."""
    return dense_ids(values, ["uri"], name).select(name, "uri")


def encode(triples: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Triples of uris as triples of ids."""
    h = ents.select(F.col("uri").alias("h"), F.col("ent_id").alias("hi"))
    t = ents.select(F.col("uri").alias("t"), F.col("ent_id").alias("ti"))
    r = rels.select(F.col("uri").alias("r"), F.col("rel_id").alias("ri"))
    return triples.join(h, "h").join(t, "t").join(r, "r").select(F.col("hi").alias("h"), F.col("ri").alias("r"), F.col("ti").alias("t"))


def decode(triples: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Triples of ids as triples of uris."""
    h = ents.select(F.col("ent_id").alias("h"), F.col("uri").alias("hu"))
    t = ents.select(F.col("ent_id").alias("t"), F.col("uri").alias("tu"))
    r = rels.select(F.col("rel_id").alias("r"), F.col("uri").alias("ru"))
    return triples.join(h, "h").join(t, "t").join(r, "r").select(F.col("hu").alias("h"), F.col("ru").alias("r"), F.col("tu").alias("t"))


def encode_pairs(pairs: DataFrame, ents1: DataFrame, ents2: DataFrame) -> DataFrame:
    """Pairs of uris (uri1, uri2) as pairs of ids (e1, e2)."""
    one = ents1.select(F.col("uri").alias("uri1"), F.col("ent_id").alias("e1"))
    two = ents2.select(F.col("uri").alias("uri2"), F.col("ent_id").alias("e2"))
    return pairs.join(one, "uri1").join(two, "uri2").select("e1", "e2")


def unify(triples1: DataFrame, triples2: DataFrame, n_ents1: int, n_rels1: int) -> DataFrame:
    """Both graphs in one id space: the second's entities and relations follow the first's."""
    shift = lambda c, n: (F.col(c) + n).alias(c)
    return triples1.select(F.lit(1).alias("kg"), "h", "r", "t").unionByName(triples2.select(F.lit(2).alias("kg"), shift("h", n_ents1), shift("r", n_rels1), shift("t", n_ents1)))


def split(pairs: DataFrame, key: str, percent: float, names: DataFrame | None = None) -> DataFrame:
    """pairs with split 'train' for the first int(n * percent) in hash order of key, else 'test'; name-based pairs are added to train."""
    n = pairs.count()
    keyed = pairs.withColumn("_key", F.md5(F.col(key).cast("string")))
    out = dense_ids(keyed, ["_key", key], "_at").withColumn("split", F.when(F.col("_at") < int(n * percent), "train").otherwise("test")).drop("_at", "_key")
    return out if names is None else out.unionByName(names.withColumn("split", F.lit("train")))


def local_reindex(members: DataFrame) -> DataFrame:
    """members (part_id, ent) with 0-based ids inside each part, in order of ent."""
    return ranks_within(members.distinct(), ["part_id"], ["ent"], "local_id")


def local_triples(triples: DataFrame, local: DataFrame) -> DataFrame:
    """Triples inside each part, in the part's own ids."""
    h = local.select("part_id", F.col("ent").alias("h"), F.col("local_id").alias("lh"))
    t = local.select("part_id", F.col("ent").alias("t"), F.col("local_id").alias("lt"))
    return triples.join(h, "h").join(t, ["part_id", "t"]).select("part_id", F.col("lh").alias("h"), "r", F.col("lt").alias("t"))


def validity(test: DataFrame, present: DataFrame) -> DataFrame:
    """test pairs (part_id, e1, e2) with valid: whether e2 is among the part's entities present (part_id, ent)."""
    marks = present.select("part_id", F.col("ent").alias("e2"), F.lit(True).alias("_in")).distinct()
    return test.join(marks, ["part_id", "e2"], "left").withColumn("valid", F.col("_in").isNotNull()).select(*test.columns, "valid")


def subtask_size(size: float | int, n1: int, n2: int, parts: int, ctx_g1: float) -> tuple[int, int, int]:
    """(entities of a subtask, of them for the first graph, for the second). A float is relative to the mean, an int absolute."""
    total = int(size * (n1 + n2) / parts) if isinstance(size, float) else int(size)
    first = int(total * ctx_g1)
    return total, first, total - first
