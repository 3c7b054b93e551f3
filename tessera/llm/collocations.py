"""Phrases of two to four words by hierarchical pair naming.

A phrase of k words is the pair of the two phrases of k - 1 words that it starts and ends with. Each
level brings the occurrences of adjacent pairs of frequent ids together over all documents, names the
frequent pairs, and hands the names back to the chunks, where they replace the pairs. The two ids of a pair are pointers to its
parents: along them go the counts of all first and last parts, which the cuts need, and the counts of
longer phrases that contain a phrase.

The text lies in chunks of a bounded number of words, as places in the chunk's own list of different
words or pairs; a chunk sends each entry of its list once, so a word of every document has no more rows
than there are chunks. Pairs are dealt into shards and sent packed, as columns of a chunk and shard, which
take about a third of rows' bytes; all rows of a pair meet in its shard. Nothing else is gathered anywhere but a chunk's names.

Defined cases: a null text is empty, a null language is `und`; null ids and repeated rows each are a
document; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_batches, small_batches, table

#: Words of a chunk, from which it is closed at a document's or long text's end.
CHUNK = 1_000_000
#: Bits of a chunk's number within its partition, and of a place within its chunk.
CHUNK_BITS, PLACE_BITS = 12, 31
#: A-Z in lower case, separators of pieces as 0xFF, which no UTF-8 text has, tabs as blanks.
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_VOCABULARY = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length in few bytes: bytes of one significance lie together, so those that hardly differ cost next to nothing."""
    return pa.compress(b"".join([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, types: str) -> list[np.ndarray]:
    """The n rows of _packed() as columns of these types."""
    widths = [np.dtype(t).itemsize for t in types]
    raw, at, out = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd"), np.uint8), 0, []
    for t, width in zip(types, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


class _Chunk:
    """Documents as places in one list of words for each language; 0 ends a piece."""

    def __init__(self):
        self.known: dict[str, defaultdict] = {}
        self.parts: list[tuple[str, np.ndarray]] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if lang not in self.known:
            self.known[lang] = defaultdict(count().__next__, {b"\xff": 0})
            next(self.known[lang].default_factory.__self__)
        at = np.fromiter(map(self.known[lang].__getitem__, words), np.int32, len(words))
        self.parts.append((lang, at))
        self.size += len(words)

    def row(self) -> tuple[list[dict], int, bytes]:
        """The words with their counts, the number of places, and these, packed: -1 ends a piece."""
        first, bases, found = 0, {}, []
        for lang, known in self.known.items():
            bases[lang] = first
            own = np.bincount(np.concatenate([a for n, a in self.parts if n == lang]), minlength=len(known))[1:]
            found.append({"lang": lang, "first": first, "words": [w.decode() for w in list(known)[1:]], "counts": own})
            first += len(known) - 1
        places = [np.where(a > 0, a - 1 + bases[n], -1).astype("<i4") for n, a in self.parts]
        return found, self.size, _packed(np.concatenate(places))


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, vocabulary, n, places): all texts, cut into pieces and words, and the n places in packed form. A piece is never divided."""
    schema = pa.schema([("chunk", pa.int64()), ("vocabulary", _VOCABULARY), ("n", pa.int64()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << CHUNK_BITS, _Chunk()

        def close() -> pa.RecordBatch:
            nonlocal at, held
            columns = [at, *held.row()]
            out = pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, schema.types)], schema=schema)
            at, held = at + 1, _Chunk()
            if at >> CHUNK_BITS != TaskContext.get().partitionId():
                raise ValueError("a partition has too many chunks: read the documents in smaller ones")
            return out

        for rows in small_batches(batches, 256):
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist()):
                marked, start = (text or b"").translate(_TABLE), 0
                while start < len(marked):
                    end = marked.find(b"\xff", start + 8 * size)  # long texts are taken in parts that end with a piece
                    end = len(marked) if end < 0 else end + 1
                    held.add(lang, (marked[start:end] + b"\xff").replace(b"\xff", b" \xff ").split())
                    start = end
                    if held.size >= size:
                        yield close()
        if held.size:
            yield close()

    return map_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), run, "chunk long, vocabulary array<struct<lang:string,first:int,words:array<string>,counts:array<bigint>>>, n long, places binary")


def _words(texts: DataFrame) -> DataFrame:
    """(chunk, place, lang, word, times) of all chunks."""
    own = texts.select("chunk", F.explode("vocabulary").alias("v")).select("chunk", "v.lang", "v.first", "v.words", "v.counts")
    each = own.select("chunk", "lang", "first", "counts", F.posexplode("words").alias("at", "word"))
    return each.select("chunk", (F.col("first") + F.col("at")).alias("place"), "lang", "word", F.get("counts", F.col("at")).alias("times"))


def _frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """(chunk, place, id) of rows whose key occurs `least` times or more in all; the row that gives the key its id has the key and its count f as well.

    The rows of a key meet once: their first place is its name, so nothing need be sent back to be joined."""
    whole = Window.partitionBy(*key)
    placed = rows.select((F.shiftleft("chunk", PLACE_BITS) + F.col("place")).alias("at"), *key, "times")  # all that is shuffled
    found = placed.withColumns({"f": F.sum("times").over(whole), "id": F.min("at").over(whole)}).where(F.col("f") >= least)
    chunk, place = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return found.select(chunk.alias("chunk"), place.alias("place"), "id", *(F.when(F.col("at") == F.col("id"), F.col(c)).alias(c) for c in ("f", *key)))


#: Columns of packed pairs (left, right, place, times) and of packed names (place, id).
_PAIR, _NAME = "qqii", "iq"


def _shards(left: np.ndarray, right: np.ndarray, shards: int) -> np.ndarray:
    """The shard in which all rows of a pair meet."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(shards)).astype(np.int32)


def replaced(texts: DataFrame, named: DataFrame, shards: int) -> DataFrame:
    """(chunk, n, places, pairs): names in place of what they name, and the different adjacent pairs of names, packed for each shard.

    named (chunk, named): of the places of each chunk that have a name, with it, as structs (place, id) or packed ones (n, packed)."""
    part = pa.list_(pa.struct([("shard", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())]))
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("pairs", part)])

    def given(named: pa.StructArray) -> list[np.ndarray]:
        if named.type.field(0).name == "place":
            return [named.field(0).to_numpy(), named.field(1).to_numpy()]
        parts = [_unpacked(data, n, _NAME) for n, data in zip(named.field(0).to_pylist(), named.field(1).to_pylist())]
        return [np.concatenate(c) for c in zip(*parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (places,) = _unpacked(b.column(2)[k].as_buffer(), b.column(1)[k].as_py(), "i")
                at, ids = given(b.column(3)[k].values)
                size = int(max(places.max(initial=-1), at.max(initial=-1))) + 2
                known = np.full(size, -1, np.int64)  # the last is where -1 points
                known[at] = ids
                use = known[places] >= 0
                both = use[:-1] & use[1:]
                keys = places[:-1][both].astype(np.int64) * size + places[1:][both]
                pairs, own, times = np.unique(keys, return_inverse=True, return_counts=True)
                new = np.full(len(places), -1, "<i4")
                new[:-1][both] = own
                left, right = known[pairs // size], known[pairs % size]
                shard = _shards(left, right, shards)
                order = np.argsort(shard, kind="stable").astype(np.int32)
                sent = []
                for to in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                    sent.append({"shard": int(shard[to[0]]), "n": len(to), "packed": _packed(left[to], right[to], to, times[to].astype(np.int32))})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([_packed(new)], pa.binary()), pa.array([sent], part)], schema=schema)

    return map_batches(texts.select("chunk", "n", "places").join(named, "chunk"), run, "chunk long, n long, places binary, pairs array<struct<shard:int,n:int,packed:binary>>")


def _frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """Of the pairs of all chunks that occur `least` times or more in all: rows (id, left, right, f), one for each, and rows (chunk, n, packed) with their places in a chunk and ids.

    The rows of a pair meet once, as those of a word do in _frequent(); a shard is a bounded part of all pairs."""
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("packed", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        chunks, sizes = rows["chunk"].to_numpy(), rows["n"].to_numpy()
        parts = [_unpacked(data, n, _PAIR) for n, data in zip(sizes.tolist(), rows["packed"].to_pylist())]
        left, right, place, times = (np.concatenate(c) for c in zip(*parts))
        at = (np.repeat(chunks, sizes) << PLACE_BITS) + place
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        f, ids = np.add.reduceat(times[order].astype(np.int64), starts), np.minimum.reduceat(at[order], starts)
        often = f >= least
        names = np.empty(len(order), np.int64)
        names[order] = np.repeat(np.where(often, ids, -1), np.diff(starts, append=len(order)))
        out, end = [], 0
        for chunk, n in zip(chunks.tolist(), sizes.tolist()):
            own = slice(end, end + n)
            use = names[own] >= 0
            end += n
            if k := int(use.sum()):
                out.append({"chunk": chunk, "n": k, "packed": _packed(place[own][use], names[own][use])})
        found = pa.table([pa.nulls(int(often.sum()), t) for t in schema.types[:3]] + [pa.array(c) for c in (ids[often], left[starts][often], right[starts][often], f[often])], schema=schema)
        return pa.concat_tables([pa.Table.from_pylist(out, schema=schema), found])

    sent = texts.select("chunk", F.explode("pairs").alias("p")).select("chunk", "p.shard", "p.n", "p.packed")
    return sent.groupBy("shard").applyInArrow(run, "chunk long, n int, packed binary, id long, left long, right long, f long")


def _named(found: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """(chunk, named): the places of each chunk that have a name, with it, partitioned as the texts' buckets are."""
    return found.select("chunk", *columns).repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias("named"))


def _extended(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Names of pairs with phrase, last word, and the counts of all first (heads) and last parts (tails), by length, from both parents."""
    left = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.concat("heads", F.array("f")).alias("heads"))
    right = parents.select(F.col("id").alias("right"), F.col("last"), F.concat("tails", F.array("f")).alias("tails"))
    return pairs.join(left, "left").join(right, "right").select("id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f", "heads", "tails", "left", "right")


def _cut(words: int) -> Column:
    """The cut with the lowest score: score, words before it, l, r. Decimals keep the products exact."""

    def scored(k: int) -> Column:
        l, r = f"heads[{k - 1}]", f"tails[{words - k - 1}]"
        score = F.expr(f"CAST(f AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV (CAST({l} AS DECIMAL(20,0)) + {r})")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(l).alias("l"), F.expr(r).alias("r"))

    return F.array_min(F.array(*[scored(k) for k in range(1, words)]))


def phrases(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words that occur `least` times or more.

    A phrase goes if a longer one that contains it has `percent` of its count or more. Only the longer by
    one word need be asked: between a phrase and a still longer one lies one of these, as frequent at least."""
    scratch = Scratch()
    buckets = 2 * (docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 2  # two for each partition of the documents
    texts = scratch.bucketed(chunks(docs, chunk), "chunk", buckets)
    own = texts.select(F.explode("vocabulary").alias("v")).select("v.lang", F.aggregate("v.counts", F.lit(0).cast("long"), lambda n, x: n + x).alias("n"))
    total = scratch.cut(own.groupBy("lang").agg(F.sum("n").alias("n")))
    names = scratch.cut(_frequent(_words(texts), ["lang", "word"], least))
    first = names.where("f IS NOT NULL")
    none = F.array().cast("array<long>")
    named = _named(names, ["place", "id"], buckets)
    levels = [scratch.cut(first.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails")))]
    for _ in range(2, longest + 1):
        texts = scratch.bucketed(replaced(texts, named, buckets), "chunk", buckets)
        scratch.drop(keep=(total, texts, *levels))
        names = scratch.cut(_frequent_pairs(texts, least))
        named = _named(names.where("chunk IS NOT NULL"), ["n", "packed"], buckets)
        levels.append(scratch.cut(_extended(names.where("id IS NOT NULL"), levels[-1])))
    scratch.drop(keep=(total, *levels))
    found = []
    for words, own in zip(range(2, longest + 1), levels[1:]):
        if words < longest:
            longer = levels[words]
            held = longer.select(F.col("left").alias("id"), F.col("f").alias("held")).unionByName(longer.select(F.col("right").alias("id"), F.col("f").alias("held"))).groupBy("id").agg(F.max("held").alias("held"))
            wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
            own = own.join(held, "id", "left").where(F.col("held").isNull() | (wide("held", 100) < wide("f", percent)))
        found.append(own.withColumn("cut", _cut(words)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language of the documents."""
    return phrases(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
tokens AS (SELECT lang, id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
runs AS (
    SELECT lang, x AS w1, lead(x, 1) OVER o AS w2, lead(x, 2) OVER o AS w3, lead(x, 3) OVER o AS w4 FROM tokens WINDOW o AS (PARTITION BY id ORDER BY i)
), grams AS (
    SELECT lang, 1 AS k, w1 AS g FROM runs
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
), f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, g, f, string_split(g, ' ') AS ws FROM f WHERE f >= 30 AND k > 1),
cuts AS (
    SELECT c.lang, c.g, c.k, c.f, j.j, array_to_string(c.ws[1 : j.j], ' ') AS head, array_to_string(c.ws[j.j + 1 : c.k], ' ') AS tail
    FROM often c JOIN (SELECT unnest([1, 2, 3]) AS j) j ON j.j < c.k
), scored AS (
    SELECT c.lang, c.g, c.j, c.f AS a, x.f AS l, y.f AS r, (c.f::HUGEINT * 2000000 // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.head JOIN f y ON y.lang = c.lang AND y.g = c.tail
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM scored),
starts AS (SELECT c.lang, c.f, c.ws, s.s, unnest(range(1, c.k - s.s + 2)) AS i FROM often c JOIN (SELECT unnest([2, 3]) AS s) s ON s.s < c.k),
held AS (SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS g, max(f) AS held FROM starts GROUP BY ALL),
kept AS (
    SELECT b.lang, b.g AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.g = b.g
    WHERE b.o = 1 AND (h.held IS NULL OR 100 * h.held::HUGEINT < 80 * b.a::HUGEINT)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
