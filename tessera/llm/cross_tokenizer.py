"""Alignment of two tokenizers over the bytes of a text.

Both tokenizers cut the same bytes. Where a token of each ends at the same byte, the text is cut into
groups; within a group every token of one is linked with every token of the other. Python only
tokenises: it hands on the ids and the byte offsets of the tokens' ends. Groups and links are built from
these arrays by Spark's higher-order functions: array_intersect of the end arrays gives the cuts,
transform and filter the groups, aggregate their counts.

No token goes beyond a word, so each different word is tokenised and aligned once: the COMMON words met
most often once for all, and broadcast; every other one once for its chunk. Documents lie in chunks of a
bounded number of characters, as places in the list of common words and the chunk's own after it. Which words
are common has no effect on results. A text with white space or characters for which this may not hold is
an entry of its own, whole.

How often ids are linked is counted over all documents: a document sends each of its id pairs once, and
pairs of many words are broadcast (`skew.by_unique`) instead of meeting in one task.

Defined cases: a null or empty text, and one that a tokenizer doesn't give back byte by byte, has no
tokens: zeros and an empty digest. Null ids and repeated rows each are a document. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batch, map_batches, small_batches, table
from tessera.llm.skew import by_unique

#: Characters of a chunk, and words that are encoded together.
CHUNK, SLICE = 1_000_000, 2000
#: Words that are aligned once for all chunks, and different words that a task counts at a time to find them.
COMMON, COUNTED = 200_000, 200_000
#: Tokens of a side up to which an entry's groups are found by comparing each end with each cut.
SHORT = 24
#: Chunks of a stored file: a reader holds a file's chunks at once.
HELD = 4
#: Texts with other white space than single blanks and line ends, or with characters that normalise, are encoded whole.
_OTHER = re.compile("[^\n -~¡-§©-®°±¶·¿-ıŁ-ňŊ-žƀ-ɏ]")


def _odd(text: str) -> bool:
    return "  " in text or text[0] == " " or text.endswith((" ", " \n")) or _OTHER.search(text) is not None


def _raw_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in prints else next(rest)): b for b in range(256)}


class ByteLevel:
    """A `tokenizers` file of a byte-level vocabulary; it encodes a blank and the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        raw = _raw_bytes()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = bytes(raw[c] for c in entry) if all(c in raw for c in entry) else entry.encode()
        said = json.loads(self.tokenizer.to_str())
        step = said.get("pre_tokenizer") or {}
        self.by_words = not said.get("normalizer") and step.get("type") == "ByteLevel" and step.get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """A `sentencepiece` model; it adds the blank itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [re.fullmatch("<0x([0-9A-Fa-f]{2})>", e) if self.model.is_byte(i) else None for i, e in enumerate(entries)]
        self.pieces = [bytes([int(m[1], 16)]) if m else e.replace("▁", " ").encode() for e, m in zip(entries, byte)]
        self.by_words = not any("▁" in e.lstrip("▁") for e in entries)  # no piece goes beyond a word

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Tokens:
    """The tokens of entries, each a blank and a word or a text."""

    def __init__(self, coder):
        self.coder = coder
        self.lengths = np.array([len(p) for p in coder.pieces], np.int32)

    def _exact(self, text: str) -> np.ndarray | None:
        """The ids, if they are the bytes of a blank and the text."""
        ids = self.coder.encode([text])[0]
        return np.array(ids, np.int32) if b"".join([self.coder.pieces[i] for i in ids]) == b" " + text.encode() else None

    def of(self, words: list[str], whole: list[str]) -> list[np.ndarray | None]:
        """The ids of runs of words and then of each whole text; None for a text that isn't given back byte by byte."""
        runs = [" ".join(words[k : k + SLICE]) for k in range(0, len(words), SLICE)]
        return [self._exact(t) for t in runs + whole]


@lru_cache(maxsize=4)
def _loaded(first: str, second: str) -> tuple[Tokens, Tokens]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(ByteLevel(first)), Tokens(Pieces(second))


def _nested(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """values as a list of so many each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _aligned_by(words: list[str], whole: list[str], a: Tokens, b: Tokens) -> tuple[list[pa.ListArray], list[np.ndarray], np.ndarray]:
    """For words and then whole texts: lists of ids of a, their ends, ids of b and their ends; the sizes of a's and b's lists;
    and which whole texts are given back byte by byte. The others have no tokens."""
    left, right = a.of(words, whole), b.of(words, whole)
    runs = -(-len(words) // SLICE)
    if any(x is None or y is None for x, y in zip(left[:runs], right[:runs])):
        raise ValueError("plain words aren't given back byte by byte")
    exact = np.array([x is not None and y is not None for x, y in zip(left[runs:], right[runs:])], bool)
    none = np.zeros(0, np.int32)
    entry_bytes = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))
    entry_bytes = np.concatenate([entry_bytes, [len(t.encode()) + 1 if k else 0 for t, k in zip(whole, exact)]]).astype(np.int64)
    entry_ends = np.cumsum(entry_bytes)
    lists, sizes = [], []
    for side, found in ((a, left), (b, right)):
        ids = np.concatenate([none, *found[:runs], *(x if k else none for x, k in zip(found[runs:], exact))])
        ends = np.cumsum(side.lengths[ids], dtype=np.int64)
        n = np.diff(np.searchsorted(ends, entry_ends, side="right"), prepend=0)
        lists += [_nested(ids, n), _nested(ends - np.repeat(entry_ends - entry_bytes, n), n)]
        sizes.append(n)
    return lists, sizes, exact


class _Chunk:
    """Documents as places: of common words, then of the chunk's other words, then of its whole texts."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self.words: defaultdict = defaultdict(count(len(common)).__next__)
        self.whole: defaultdict = defaultdict(count().__next__)
        self.docs: list[tuple[int | None, np.ndarray, bool]] = []
        self.size = 0

    def add(self, doc: int | None, text: str, by_words: bool) -> None:
        split = by_words and text != "" and not _odd(text)
        entries = (text.split(" ") if split else [text]) if text else []
        if split:
            places = np.fromiter(map(self.common.get, entries, repeat(-1)), np.int32, len(entries))
            for k in np.flatnonzero(places < 0):
                places[k] = self.words[entries[k]]
        else:
            places = np.fromiter(map(self.whole.__getitem__, entries), np.int32, len(entries))
        self.docs.append((doc, places, split))
        self.size += len(text) + 1

    def columns(self, a: Tokens, b: Tokens, sizes: list[np.ndarray]) -> list:
        """Tokens of the chunk's own entries, and the documents by places. sizes: of the common words, as in tokens()."""
        lists, own, exact = _aligned_by(list(self.words), list(self.whole), a, b)
        n_a, n_b = (np.concatenate([c, o]) for c, o in zip(sizes, own))
        n = len(self.common)
        first, docs = n + len(self.words), []
        for doc, places, split in self.docs:
            if not split:
                places = (places[exact[places]] + first).astype(np.int32)
            common, rest = places[places < n], places[places >= n] - n
            sums = [int(of[at].sum()) for of, at in ((n_a, places), (n_b, places), (sizes[2], common), (sizes[3], common))]
            docs.append(dict(zip(_DOC, (doc, *sums, places, common, rest))))
        return [*lists, docs]


_LISTS = pa.list_(pa.list_(pa.int32()))
_DOC = {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "entries": "array<int>", "common": "array<int>", "rest": "array<int>"}
_DOCS = pa.list_(pa.struct([(c, pa.int64() if t == "bigint" else pa.list_(pa.int32())) for c, t in _DOC.items()]))
_SIDES = ("a_ids", "a_ends", "b_ids", "b_ends")
_MADE = ", ".join(f"{c} array<array<int>>" for c in _SIDES)


def frequent(docs: DataFrame, first: str, second: str, most: int = COMMON) -> list[str]:
    """About the `most` words met most often, of those that occur twice among the words that a task counts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(first, second)
        schema, seen = pa.schema([("word", pa.string()), ("n", pa.int64())]), Counter()

        def told() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if n > 1]
            return batch(schema, [[w for w, _ in kept], [n for _, n in kept]])

        for rows in small_batches(batches, 64):
            for text in rows.column(0).to_pylist():
                if text and a.coder.by_words and b.coder.by_words and not _odd(text):
                    seen.update(text.split(" "))
            if len(seen) > COUNTED:
                yield told()
                seen = Counter()
        yield told()

    counted = map_batches(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def word_tokens(spark: SparkSession, words: list[str], first: str, second: str) -> DataFrame:
    """at, a_ids, a_ends, b_ids, b_ends: for slices of words the lists of tokens() of each word."""
    schema = pa.schema([("at", pa.int64()), *((c, _LISTS) for c in _SIDES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(first, second)
        for rows in batches:
            for at, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                lists, _, _ = _aligned_by(own, [], a, b)
                yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], schema=schema)

    slices = spark.createDataFrame([(k, words[k : k + SLICE]) for k in range(0, len(words), SLICE)], "at long, words array<string>")
    return map_batches(slices.repartition(max(1, min(spark.sparkContext.defaultParallelism, len(words) // SLICE))), run, f"at long, {_MADE}")


def tokens(docs: DataFrame, first: str, second: str, chunk: int = CHUNK, common: tuple[str, ...] = (), sizes: list[np.ndarray] | None = None) -> DataFrame:
    """chunk, a_ids, a_ends, b_ids, b_ends, docs: for each chunk the lists of its own entries' tokens, each entry with a blank before it, and of the
    byte offsets of their ends in the entry; and the documents (doc_id, n_a, n_b, n_groups, n_links, entries, common, rest), where entries are places
    from 0 in the common words and the chunk's own entries after them, common and rest those of either kind, from 0, and n_groups and n_links
    sums over the common ones. sizes: the common words' numbers of tokens of each side, groups and links.

    first: a byte-level file for `tokenizers`, second: a model for `sentencepiece`, both at the same path on every executor."""
    schema = pa.schema([("chunk", pa.int64()), *((c, _LISTS) for c in _SIDES), ("docs", _DOCS)])
    sizes = sizes or [np.zeros(0, np.int64)] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(first, second)
        known = {w: k for k, w in enumerate(common)}
        by_words, at, held = a.coder.by_words and b.coder.by_words, TaskContext.get().partitionId() << 32, _Chunk(known)

        def close() -> pa.RecordBatch:
            nonlocal at, held
            *lists, docs = held.columns(a, b, sizes)
            arrays = [pa.array([at]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), pa.array([docs], _DOCS)]
            at, held = at + 1, _Chunk(known)
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for rows in small_batches(batches, 256):
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                held.add(doc, text or "", by_words)
                if held.size >= chunk:
                    yield close()
        if held.docs:
            yield close()

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"chunk long, {_MADE}, docs array<struct<{','.join(f'{c}:{t}' for c, t in _DOC.items())}>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _lasts(ends: Column, cuts: Column) -> Column:
    """The place in ends of each cut, all of which are among them. Odd numbers mark cuts among the even ends, in order, so the k-th mark has its token and k others before it."""
    marked = F.sort_array(F.concat(F.transform(ends, lambda e: e * 2), F.transform(cuts, lambda e: e * 2 + 1)))
    marks = F.filter(F.transform(marked, lambda x, k: F.when(x.bitwiseAND(F.lit(1)) == 1, k)), lambda k: k.isNotNull())
    return F.transform(marks, lambda k, before: k - before - 1)


def _segments(values: Column, lasts: Column) -> Column:
    """values cut after the places in lasts. Most segments are single values, which need no slice."""

    def one(v: Column, at: Column, before: Column) -> Column:
        return F.when(at - before == 1, F.array(F.get(v, at))).otherwise(F.slice(v, before + 2, at - before))

    return _let(values, lambda v: _let(F.concat(F.array(F.lit(-1)), lasts), lambda before: F.transform(lasts, lambda at, k: one(v, at, F.get(before, k)))))


def _compared(ids: Column, ends: Column, cuts: Column) -> Column:
    """ids cut into groups at the place of each cut among the ends. No token is empty, so an end has one place."""
    at = lambda k: F.array_position(ends, F.get(cuts, k)).cast("int")

    def one(cut: Column, k: Column) -> Column:
        before = F.when(k == 0, 0).otherwise(at(k - 1))
        return F.slice(ids, before + 1, at(k) - before)

    return F.when(F.size(cuts) == 1, F.array(ids)).otherwise(F.transform(cuts, one))


def _marked(ids: Column, ends: Column, cuts: Column) -> Column:
    """The same, in a time that grows little faster than their number."""
    return _let(_lasts(ends, cuts), lambda lasts: _segments(ids, lasts))


def _cut(ids: Column, ends: Column, cuts: Column) -> Column:
    return F.when(F.size(ids) <= SHORT, _compared(ids, ends, cuts)).otherwise(_marked(ids, ends, cuts))


def groups(found: DataFrame) -> DataFrame:
    """`cuts`, `a` and `b` beside columns a_ids, a_ends, b_ids, b_ends of arrays: the common ends, and the ids of each group, one array for each side."""
    cut = found.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    return cut.withColumns({s: _cut(F.col(f"{s}_ids"), F.col(f"{s}_ends"), F.col("cuts")) for s in "ab"})


def _written(ids: Column) -> Column:
    return F.when(F.size(ids) == 1, ids[0].cast("string")).otherwise(F.array_join(ids.cast("array<string>"), ","))


def _linked(own: Column, other: Column) -> Column:
    pair = lambda x, y: F.shiftleft(x.cast("long"), 32) + y
    every = F.flatten(F.transform(own, lambda x: F.transform(other, lambda y: pair(x, y))))
    return F.when((F.size(own) == 1) & (F.size(other) == 1), F.array(pair(own[0], other[0]))).otherwise(every)


def entries() -> Column:
    """From the lists a_ids, a_ends, b_ids, b_ends: for each entry its groups as written text (`written`), their number (`n_groups`), its links (`links`)
    as (A id << 32) + B id, and the numbers of its tokens (`n_a`, `n_b`)."""
    told = lambda own, other: F.concat(_written(own), F.lit("|"), _written(other))

    def of(a_ids: Column, i: Column) -> Column:
        a_ends, b_ids, b_ends = (F.get(c, i) for c in _SIDES[1:])

        def cut_at(cuts: Column) -> Column:
            return F.struct(_cut(a_ids, a_ends, cuts).alias("a"), _cut(b_ids, b_ends, cuts).alias("b"))

        def entry(g: Column) -> Column:
            links = F.flatten(F.zip_with(g["a"], g["b"], _linked))
            return F.struct(F.array_join(F.zip_with(g["a"], g["b"], told), ";").alias("written"), F.size(g["a"]).alias("n_groups"), links.alias("links"), F.size(a_ids).alias("n_a"), F.size(b_ids).alias("n_b"))

        return _let(_let(F.array_intersect(a_ends, b_ends), cut_at), entry)

    return F.transform("a_ids", of)


def _sum(places: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(places, F.lit(0).cast("long"), lambda n, k: n + value(k))


def held(found: DataFrame) -> DataFrame:
    """pair, held: how many documents hold each linked pair. found: docs, own (the links of the chunk's entries) and shared (those of the common words)."""
    of = lambda places, links: F.flatten(F.transform(F.array_distinct(places), lambda k: F.get(links, k)))
    own = F.transform("docs", lambda d: F.array_distinct(F.concat(of(d["common"], F.col("shared")), of(d["rest"], F.col("own")))))
    return found.select(F.explode(F.flatten(own)).alias("pair")).groupBy("pair").agg(F.count("*").alias("held"))


def digest(docs: DataFrame, first: str, second: str, chunk: int = CHUNK, common: int = COMMON) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, scratch = docs.sparkSession, Scratch()
    words = frequent(docs, first, second, common)
    n = len(words)
    # One row, bounded by COMMON: the entries of the common words in their order.
    slices = scratch.cut(word_tokens(spark, words, first, second).select("at", entries().alias("e")))
    every = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "e"))), lambda s: s["e"]))
    shared = scratch.cut(slices.agg(every.alias("e")).select("e.written", "e.n_groups", "e.links", "e.n_a", "e.n_b"))
    sizes = [np.array(c or [], np.int64) for c in shared.select("n_a", "n_b", "n_groups", F.transform("links", F.size)).first()]

    def told(d: Column, own: dict[str, Column]) -> Column:
        written = F.transform(d["entries"], lambda k: F.when(k < n, F.get("written", k)).otherwise(F.get(own["written"], k - n)))
        sha = F.when(d["n_a"] > 0, F.sha2(F.array_join(written, ";"), 256)).otherwise("")
        sums = [(d[c] + _sum(d["rest"], lambda k: F.get(own[c], k))).alias(c) for c in ("n_groups", "n_links")]  # noqa: B023
        return F.struct(*(d[c].alias(c) for c in ("doc_id", "n_a", "n_b")), *sums, sha.alias("groups_sha256"), d["common"].alias("common"), d["rest"].alias("rest"))

    aligned = tokens(docs, first, second, chunk, tuple(words), sizes).select("chunk", "docs", entries().alias("own")).crossJoin(F.broadcast(shared.select("written")))
    own = F.struct(F.col("own.written").alias("written"), F.col("own.n_groups").alias("n_groups"), F.transform("own.links", F.size).alias("n_links"))
    found = scratch.cut(aligned.select("chunk", _let(own, lambda o: F.transform("docs", lambda d: told(d, o))).alias("docs"), F.col("own.links").alias("own")), HELD)
    links = shared.select(F.col("links").alias("shared"))
    linked = found.select("chunk", F.posexplode("own").alias("entry", "pairs")).select("chunk", "entry", F.explode("pairs").alias("pair"))
    rows = linked.groupBy("pair").agg(F.count("*").alias("rows"))
    known = scratch.cut(held(found.crossJoin(F.broadcast(links))).join(rows, "pair", "left").fillna(0, ["rows"]).withColumn("a_id", F.shiftright("pair", 32)))
    most = known.groupBy("a_id").agg(F.max("held").alias("most"))
    known = scratch.cut(known.join(most, "a_id").select("pair", "held", "rows", (F.col("held") == F.col("most")).cast("long").alias("best")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("best", "held")]

    def counted(each: DataFrame, best: str, held_: str, *by: str) -> DataFrame:
        """Arrays of both sums in the order of entries."""
        of = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("entry", "best", "held"))).alias("of"))
        return of.select(*by, F.col("of.best").alias(best), F.col("of.held").alias(held_))

    rest = counted(by_unique(linked, known.where("rows > 0"), "pair", "rows").groupBy("chunk", "entry").agg(*sums), "best", "held", "chunk")
    pairs = links.select(F.posexplode("shared").alias("entry", "pairs")).select("entry", F.explode_outer("pairs").alias("pair"))
    often = scratch.cut(counted(pairs.join(known, "pair", "left").groupBy("entry").agg(*sums), "often_best", "often_held"))
    # Sums over common words come first, so that only places of the others are shuffled.
    kept = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "rest")
    slim = F.transform("docs", lambda d: F.struct(*(d[c].alias(c) for c in kept), *(_sum(d["common"], lambda k: F.get(f"often_{c}", k)).alias(c) for c in ("best", "held"))))  # noqa: B023

    def result(d: Column) -> Column:
        n_best, count_sum = (d[c] + _sum(d["rest"], lambda k: F.get(c, k)) for c in ("best", "held"))  # noqa: B023
        return F.struct(*(d[c].alias(c) for c in kept[:5]), n_best.alias("n_best"), count_sum.alias("count_sum"), d["groups_sha256"].alias("groups_sha256"))

    met = found.crossJoin(F.broadcast(often)).select("chunk", slim.alias("docs")).join(rest, "chunk", "left")
    whole = scratch.cut(met.select(F.explode(F.transform("docs", result)).alias("d")).select("d.*"))
    scratch.drop(keep=(whole,))
    return whole


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of a byte-level and a piece vocabulary over all documents."""
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
