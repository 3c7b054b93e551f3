"""Near-duplicates by b-bit MinHash.

Each document's set of word shingles has 128 minima. Bands of four minima give candidate buckets;
the low four bits of each minimum, packed into eight longs, give an estimate of the similarity from
bit counts, corrected for chance agreement of the low bits. Pairs that the estimate leaves are
confirmed on the full sets. Documents with the same set are one candidate. In a bucket each member is
first paired with the smallest one; after components are formed, only buckets that still hold several
components are paired again, across components, so copies are never expanded into all pairs and no
link between components is lost.

Defined cases: null or empty texts and texts without words have no shingles, link with nothing and
stay. Fewer words than the shingle length are one shingle. Null doc_ids link with nothing and stay.
Repeated rows of an id share their result. Ties are settled by the smallest doc_id. An empty table
gives an empty result. Extra columns are ignored by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batch, cut, map_batches, small_batches, table
from tessera.llm.components import components, filtered
from tessera.llm.skew import by_unique, salted

WORDS, PERCENT = 5, 75
HASHES, ROWS, BITS = 128, 4, 4
#: Pairs with a lower estimate aren't confirmed; at a true similarity of 0.75 that is over five standard deviations away.
LEAST_ESTIMATE = 0.55
#: Buckets of more members than LARGE are compared in cells of CELL members by CELL.
LARGE, CELL = 64, 256
_MIX = np.random.default_rng(11).integers(0, 2**63, (2, HASHES), np.uint64)
_A, _B = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1]
_P = np.random.default_rng(12).integers(0, 2**63, (HASHES // ROWS, ROWS + 1), np.uint64) | np.uint64(1)
_LONGS = HASHES * BITS // 64


def shingles(raw: bytes | None, width: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= width:
        return np.array([digest(text)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([digest(text[s:e]) for s, e in zip(starts, ends[width - 1 :])], np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """128 minima of a set of hashes."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(low, (found[i : i + 2048, None] * _A + _B).min(0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One bucket key for each band of minima."""
    h = (low.reshape(-1, ROWS) * _P[:, :ROWS]).sum(1, dtype=np.uint64) + _P[:, ROWS]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, in eight longs."""
    bits = (low >> np.uint64(24)) & np.uint64(2**BITS - 1)
    per = 64 // BITS
    return np.bitwise_or.reduce(bits.reshape(_LONGS, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """The similarity of two packed signatures, from their bit counts; a and b: prefixes of their columns."""
    different = None
    for i in range(_LONGS):
        d = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        different = F.bit_count(d) if different is None else different + F.bit_count(d)
    by_chance = 1 / 2**BITS
    return ((HASHES - different) / HASHES - by_chance) / (1 - by_chance)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (of the whole set), s0 to s7 (packed low bits), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), *((f"s{i}", pa.int64()) for i in range(_LONGS)), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            lows = [minima(x) for x in sets]
            sigs = np.array([packed(x) for x in lows], np.int64).reshape(-1, _LONGS)
            keys = pa.ListArray.from_arrays(np.arange(len(lows) + 1, dtype=np.int32) * (HASHES // ROWS), np.concatenate([bands(x) for x in lows] or [np.empty(0, np.int64)]))
            yield batch(schema, [b.column(0), [len(x) for x in sets], [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], *sigs.T, keys])

    fields = ", ".join(f"s{i} long" for i in range(_LONGS))
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, n_shingles long, set_id binary, {fields}, bands array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            sets = [shingles(t).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield batch(schema, [b.column(0), pa.ListArray.from_arrays(ends, np.concatenate(sets) if sets else np.empty(0, np.int64))])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, found array<bigint>").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v), a stored table, whose full sets have 100 * intersection >= 75 * union."""
    ids = scratch.cut(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    sets = _sets(filtered(docs.select("doc_id", "text"), ids, "left_semi", ids.count()))
    both = salted(pairs, sets.select(F.col("doc_id").alias("u"), F.col("found").alias("a")), "u", "v").join(sets.select(F.col("doc_id").alias("v"), F.col("found").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= PERCENT * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket's members, of different components, whose estimate allows a link."""
    one, two = (rows.select("bucket", F.col("doc_id").alias(i), F.col("c").alias(f"c{i}"), *(F.col(f"s{k}").alias(f"{p}{k}") for k in range(_LONGS))) for i, p in (("u", "a"), ("v", "b")))
    return one.join(two, "bucket").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & (estimate("a", "b") >= LEAST_ESTIMATE)).select("u", "v")


def _linked_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of cell (bucket, i, j) and side: links of side 0 to side 1 across components, by exact overlaps from an index of a cell's sets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    cell, left, right = None, [], []

    def links() -> list:
        out = []
        if left and right:
            size = np.array([len(x[2]) for x in right])
            flat, owner = np.concatenate([x[2] for x in right]), np.repeat(np.arange(len(right)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, c = np.array([x[0] for x in right]), np.array([x[1] for x in right])
            for doc, own, found in left:
                lo, hi = np.searchsorted(flat, found), np.searchsorted(flat, found, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(right))
                ok = ((100 + PERCENT) * shared >= PERCENT * (len(found) + size)) & (c != own)
                out += [(min(doc, v), max(doc, v)) for v in ids[ok].tolist()]
        return out

    for b in small_batches(batches, 256):
        for bucket, i, j, side, doc, c, found in zip(*(b.column(k).to_pylist() for k in range(6)), (np.array(x.as_py(), np.int64) for x in b.column(6))):
            if cell != (bucket, i, j):
                if out := links():
                    yield batch(schema, list(zip(*set(out))))
                cell, left, right = (bucket, i, j), [], []
            (right if side else left).append((doc, c, found))
    if out := links():
        yield batch(schema, list(zip(*set(out))))


def _large(rows: DataFrame) -> DataFrame:
    """(bucket, n, main, ni, nj) of each bucket with more than LARGE members: its largest component, and cells along the members outside it and along all."""
    most = rows.groupBy("bucket", "c").count().groupBy("bucket").agg(F.max(F.struct("count", (-F.col("c")).alias("m"))).alias("top"), F.sum("count").alias("n")).where(F.col("n") > LARGE)
    return most.select("bucket", "n", (-F.col("top.m")).alias("main"), F.ceil((F.col("n") - F.col("top.count")) / CELL).cast("int").alias("ni"), F.ceil(F.col("n") / CELL).cast("int").alias("nj"))


def _across_large(rows: DataFrame, large: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between different components within large buckets.

    Members outside a bucket's largest component are compared with all of its members, in cells of
    CELL * CELL members at most, so a bucket of any size is spread over tasks and only true links leave them."""
    rows = by_unique(rows.select("bucket", "doc_id", "c"), large, "bucket")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("c <> main").select("bucket", "doc_id", "c", F.lit(0).alias("side"), own("ni").alias("i"), every("nj").alias("j"))
    right = rows.select("bucket", "doc_id", "c", F.lit(1).alias("side"), own("nj").alias("j"), every("ni").alias("i"))
    placed = scratch.cut(left.unionByName(right))
    ids = scratch.cut(placed.select("doc_id").distinct())
    sets = _sets(filtered(docs.select("doc_id", "text"), ids, "left_semi", ids.count()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = placed.join(sets, "doc_id").select("bucket", "i", "j", "side", "doc_id", "c", "found")
    return map_batches(cells.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side"), _linked_in_cells, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs. Two stored tables that the result reads stay in scratch, for the caller to drop."""
    scratch = scratch or Scratch()
    every = scratch.cut(signatures(docs))
    plain = "n_shingles > 0 AND doc_id IS NOT NULL"
    some = every.where(plain)
    alike = scratch.cut(some.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    sigs = [f"s{i}" for i in range(_LONGS)]
    reps = some.join(alike.select("set_id", F.col("first_id").alias("doc_id")), ["set_id", "doc_id"], "left_semi")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    smallest = buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "low", "n")
    members = scratch.cut(by_unique(buckets, scratch.cut(smallest), "bucket"))

    def side(name: str, of: str) -> DataFrame:
        return every.select(F.col("doc_id").alias(of), *(F.col(s).alias(f"{name}{i}") for i, s in enumerate(sigs))).dropDuplicates([of])

    pairs = scratch.cut(members.where("doc_id <> low").select(F.col("low").alias("u"), F.col("doc_id").alias("v")).distinct())
    pairs = salted(pairs, side("a", "u"), "u", "v").join(side("b", "v"), "v").where(estimate("a", "b") >= LEAST_ESTIMATE).select("u", "v")
    links = scratch.cut(confirmed(scratch.cut(pairs), docs, scratch))
    of = scratch.cut(components(links))

    # Each bucket's smallest member has met all of its others.
    known = scratch.cut(members.where("doc_id <> low").join(of, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component_id", "doc_id").alias("c")))
    mixed = scratch.cut(known.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 < c1").select("bucket", "n"))
    known = by_unique(known, mixed, "bucket").join(every.select("doc_id", *sigs).dropDuplicates(["doc_id"]), "doc_id")
    known = scratch.cut(known.select("bucket", "doc_id", "c", *sigs))
    large = scratch.cut(_large(known))
    small = known.join(mixed.where(F.col("n") <= LARGE).select("bucket"), "bucket", "left_semi")
    more = scratch.cut(_across(small).distinct())
    new = scratch.cut(confirmed(more, docs, scratch).unionByName(_across_large(known, large, docs, scratch)))
    if not new.isEmpty():
        of = scratch.cut(components(links.unionByName(new)))
    # A set's component; all rows of a set share it, so its copies meet only where few have it.
    component = scratch.cut(alike.join(of.withColumnRenamed("doc_id", "first_id"), "first_id", "left").select("set_id", "n", F.coalesce("component_id", "first_id").alias("component_id")))
    out = by_unique(some.select("doc_id", "n_shingles", "set_id"), component, "set_id").drop("set_id")
    alone = every.where(f"NOT ({plain})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    scratch.drop(keep=(every, component))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; of repeated rows of an id one stays."""
    scratch = Scratch()
    gone = cut(near_duplicates(docs, scratch).where("NOT kept").select("doc_id").distinct())
    scratch.drop()
    stay = filtered(docs, gone, "left_anti", gone.count()).select(docs.columns)
    again = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = again.count()
    if not n:
        return stay
    once = filtered(stay, again, "left_semi", n).select(docs.columns).dropDuplicates(["doc_id"])
    return filtered(stay, again, "left_anti", n).select(docs.columns).unionByName(once)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
