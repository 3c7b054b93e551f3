"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of token positions, some of them ignored, give hashes of test items; a training text's
hashes are joined with them against a broadcast index. Around each hit the item is laid over the text
on the hit's diagonal, and its best-scoring stretch, in which substituted tokens are tolerated, counts
the tokens of the item that the text holds. A text leaks an item when these tokens, over all stretches,
are at least `least` of them and at least `share` of the item, or at least `many`.

Items shorter than the longest mask are one stretch, and have masks of their own, of fewer positions: whatever tokens of
such an item are substituted within these limits, one of the masks still hits. Items that are shorter
than every mask are found by the hash of the whole item.

The items are taken in blocks of bounded text, so the index that each task holds is bounded too,
whatever the benchmark's size. A hash that many items share is looked up in bounded portions.

Defined cases: null or empty texts and items leak nothing. Repeated items count once; repeated rows of
documents repeat. Null ids are kept. Empty tables give an empty result. Extra columns are ignored by
`leaks` and kept by `decontaminate`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, map_batches, small_batches, table

#: Masks: 1 selects a token, 0 ignores it.
MASKS = ("1110100111", "11010110011", "110011101001", "1111011")
_SPAN = max(map(len, MASKS))
#: Masks of items shorter than that: of 9 to 11 tokens, all but 8 may be substituted.
SHORT_MASKS = ("10111", "11001001", "1110001")
_TOKEN = re.compile(r"\w+")
#: Characters of the items of one index, and hits that are expanded at once.
BLOCK_CHARS, HITS = 16_000_000, 1_000_000


@dataclass(frozen=True)
class Limits:
    """How many tokens of an item make a leak."""

    least: int = 8
    share: float = 0.5
    many: int = 20
    mismatch: float = 1.5


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of word characters."""
    return _TOKEN.findall((text or "").lower())


def _weights(mask: str) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == 49)
    rng = np.random.default_rng(len(mask) * 1000 + int(mask, 2) % 997)
    return at, rng.integers(1, 2**63, len(at), np.uint64) | np.uint64(1)


def _hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which all selected ids are known, and their hashes."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, by = _weights(mask)
    known = ids != 0
    ok = known[at[0] : at[0] + n].copy()
    for k in at[1:]:
        ok &= known[k : k + n]
    where = np.flatnonzero(ok)
    h = np.zeros(len(where), np.uint64)
    for k, w in zip(at, by):
        h += ids[where + k].astype(np.uint64) * w
        h ^= h >> np.uint64(29)
    return where, h


def _masks(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    if n >= _SPAN:
        return MASKS
    return tuple(m for m in SHORT_MASKS if len(m) <= n) or ("1" * n,) * (n > 0)


@dataclass
class Index:
    """Hashes of a block of items."""

    items: list
    vocabulary: dict = field(default_factory=dict)
    texts: list = field(default_factory=list)
    seeds: dict = field(default_factory=dict)

    def build(self) -> Index:
        """Number the tokens, 1 and up, and sort the hashes of each mask."""
        of = defaultdict(list)
        for i, (_, text) in enumerate(self.items):
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.int64)
            self.texts.append(ids)
            for mask in _masks(len(ids)):
                where, h = _hashes(ids, mask)
                of[mask].append((h, np.full(len(h), i), where))
        for mask, parts in of.items():
            h, item, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.seeds[mask] = h[order], item[order], pos[order]
        return self

    def found(self, texts: list[str | None], limits: Limits) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, matched tokens, first token, end token) of each leak, by text and item."""
        get = self.vocabulary.get
        each = [np.fromiter((get(t, 0) for t in tokens(x)), np.int64) for x in texts]
        gap = np.zeros(_SPAN, np.int64)
        starts, at = [], 0
        for x in each:
            starts.append(at)
            at += len(x) + _SPAN
        ids = np.concatenate([y for x in each for y in (x, gap)] or [gap])
        starts = np.array(starts, np.int64)
        near = defaultdict(set)
        for mask, (seeds, item, pos) in self.seeds.items():
            where, h = _hashes(ids, mask)
            low = np.searchsorted(seeds, h)
            hit = np.flatnonzero((low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == h))
            where, low = where[hit], low[hit]
            many = np.searchsorted(seeds, h[hit], "right") - low
            ends = np.cumsum(many)
            for x in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                # The x-th hit and those after it: which place of the texts, and which entry of the index.
                nth = np.arange(x, min(x + HITS, int(ends[-1])))
                at = np.searchsorted(ends, nth, "right")
                entry = low[at] + nth - (ends[at] - many[at])
                place, of = where[at], item[entry]
                found = np.unique(np.stack([np.searchsorted(starts, place, "right") - 1, of, place - pos[entry]], 1), axis=0)
                for k, i, start in found.tolist():
                    near[k, i].add(start)
        for (k, i), diagonals in sorted(near.items()):
            b, held, first, last = self.texts[i], np.zeros(len(self.texts[i]), bool), None, 0
            lo, hi = int(starts[k]), int(starts[k]) + len(each[k])
            for d in sorted(diagonals):
                s, e = max(lo, d), min(hi, d + len(b))
                same = ids[s:e] == b[s - d : e - d]
                x, y = _stretch(same, limits.mismatch) if len(b) >= _SPAN else (0, len(same))
                held[s - d + x : s - d + y] |= same[x:y]
                first, last = s + x - lo if first is None else min(first, s + x - lo), max(last, s + y - lo)
            n = int(held.sum())
            if n >= min(limits.many, max(min(limits.least, len(b)), limits.share * len(b))):
                yield k, i, n, first, last


def _stretch(same: np.ndarray, mismatch: float) -> tuple[int, int]:
    """The stretch with the greatest sum of 1 for a match and -mismatch for none; of several the first."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -mismatch))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of all items, of BLOCK_CHARS characters or so each."""
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield spark.sparkContext.broadcast(Index(sorted((tuple(r) for r in rows.collect()), key=str)).build())


def leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, n_matched, item_tokens, first_token, end_token."""
    fields = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_matched", pa.int64()), ("item_tokens", pa.int64()), ("first_token", pa.int64()), ("end_token", pa.int64())]
    schema, ddl = pa.schema(fields), ", ".join(f"{k} long" for k, _ in fields)
    benchmark = benchmark.select(F.col("item_id").cast("long"), "text")

    def over(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in small_batches(batches, 256):
                ids = b.column(0).to_pylist()
                rows = [(ids[k], own.items[i][0], n, len(own.texts[i]), x, y) for k, i, n, x, y in own.found(b.column(1).to_pylist(), limits)]
                yield batch(schema, list(zip(*rows)) if rows else [[]] * len(fields))

        return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, ddl)

    out = docs.sparkSession.createDataFrame([], ddl)
    for index in _blocks(docs, benchmark):
        out = out.unionByName(over(index))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs without those that leak an item; each block of items is one filter, without a join."""
    at = docs.columns.index("text")

    def without(df: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, 256):
                stay = np.ones(b.num_rows, bool)
                stay[[x[0] for x in index.value.found(b.column(at).to_pylist(), limits)]] = False
                yield b.filter(pa.array(stay))

        return df.mapInArrow(run, df.schema)

    for index in _blocks(docs, benchmark):
        docs = without(docs, index)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items in documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
