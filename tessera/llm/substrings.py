"""Removal of repeated substrings by suffix sorting.

Every byte that is covered by a `WINDOW`-byte string which also starts earlier (in a document with a
smaller id, or earlier in the same one) is removed. A window's least hash of 24-byte grams is the same
wherever the window occurs, so runs of windows with the same least hash are dealt by it: equal windows
meet in one task. Only runs whose hash occurs again go on, and of runs that are identical as a whole
the first stands for all. The suffixes of what remains are ordered shard by shard by external induced
sorting, which also gives the prefixes that neighbours have in common: where one is a whole window,
both are equal, and all but the first in the corpus are marked. A hash with very many different runs is dealt anew by the
bytes beside its gram, so that no task gets them all; where these are the same too, by whole windows, of
which again the first stands for all.

Defined cases: null texts count as empty. Null ids have no order: nothing is removed from them and
nothing because of them. Repeated rows of an id and text are one document, with a row each; rows of one id
with different texts are taken together: what one of them repeats of the others, or of itself, counts once. Texts under
the window keep all. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, cut, map_batches, small_batches, table
from tessera.llm.components import filtered
from tessera.llm.induced import ARRAYS, QUEUED, suffix_order
from tessera.llm.skew import by_unique

WINDOW, GRAM = 100, 24
#: Runs of a least hash with more different surroundings than this are too many for one task.
HOT = 4096


@dataclass(frozen=True)
class Memory:
    """Bytes of text that are sorted together (a longer group of runs is sorted alone), and bytes of a sort's queues and arrays in memory; the rest of these is on the task's disk."""

    shard: int = 4 << 20
    queued: int = QUEUED
    arrays: int = ARRAYS


_RNG = np.random.default_rng(17)
_LETTER = _RNG.integers(0, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 2**63, 6, np.uint64) | np.uint64(1)
_THREE = np.uint64(int(_STEP[3]) * int(_STEP[4]) % 2**64)
_BASE = int(_STEP[5])
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled, power = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(power)
        filled += more
        power = power * power % 2**64
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each byte on."""
    h = _LETTER[0][raw]
    for k, width in enumerate((1, 2, 4)):
        h = h[:-width] * _STEP[k] + h[width:]
    h = h[:-16] * _THREE + h[8:-8] * _STEP[4] + h[16:]  # three times 8 bytes
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def runs(text: bytes) -> tuple[np.ndarray, ...] | None:
    """Least hash, hash of all its bytes, first window, number of windows, and whether equal windows may lie within, of each run."""
    n = len(text) - WINDOW + 1
    if n <= 0:
        return None
    raw = np.frombuffer(text, np.uint8)
    h = grams(raw)
    several, low, width = WINDOW - GRAM + 1, h, 1
    while 2 * width <= several:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[several - width : several - width + n])
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    last = np.append(first[1:], n) - 1
    again = h[:n] == low  # the least gram leads its window; within a run it then occurs again
    again[last] = False
    within = np.add.reduceat(again, first) > 0
    power = _powers(_BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[1][raw] * power, out=total[1:])
    whole = (total[last + WINDOW] - total[first]) * _powers(_INVERSE, len(raw))[first]
    return low[first].view(np.int64), whole.view(np.int64), first, last - first + 1, within


_RUN = pa.schema([("m", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("within", pa.bool_())])


def _dealt(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            parts = [(doc, *found) for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) if t and (found := runs(t))]
            if parts:
                ids = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
                m, whole, first, n, within = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
                yield batch(_RUN, [m, whole, ids, first, n, within])

    return map_batches(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), run, "m long, whole long, doc_id long, first long, n long, within boolean")


_OUT = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("sort", pa.bool_())])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs in the order of m, whole, doc_id, first: the runs that repeat a whole earlier one (sort
    false), and the first ones of each kind where a hash has several kinds or a run repeats itself (sort true).

    A batch starts with the two rows that the last one held back: the first of the current kind and, if that is still undecided, itself."""
    held = None  # the first row of the current kind, and whether the kind before it has the same m
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], 1)
        lead = held is not None
        if lead:
            rows = np.concatenate([held[0][None], rows])
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        at = np.flatnonzero(new)
        of = rows[at][np.cumsum(new) - 1]
        later = (rows[:, 2] != of[:, 2]) | (rows[:, 3] != of[:, 3])
        kinds = rows[at]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = kinds[1:, 0] == kinds[:-1, 0]
        if lead:
            same[0] = held[1]
        several = same[:-1] | same[1:] | (kinds[:, 5] > 0)
        sure = kinds[:-1][several[:-1]]
        gone = rows[later]
        out = np.concatenate([gone, sure])
        yield batch(_OUT, [out[:, 2], out[:, 3], out[:, 4], out[:, 0], np.arange(len(out)) >= len(gone)])
        held = kinds[-1], bool(same[len(at) - 1])
    if held is not None and (held[1] or held[0][5]):
        out = held[0][None]
        yield batch(_OUT, [out[:, 2], out[:, 3], out[:, 4], out[:, 0], np.ones(1, bool)])


def marked(segments: list[tuple[int, int, int, bytes]], memory: Memory = Memory()) -> list[tuple[int, int, int]]:
    """(doc_id, first, n) of the windows of segments (doc_id, first window, windows, bytes) that occur earlier in one of them."""
    order = sorted(set(segments))
    size = np.array([len(s[3]) for s in order], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.ones(int(start[-1]) + 1, np.int16)  # 1 parts the segments, 0 ends the text
    text[-1] = 0
    valid = np.zeros(len(text), bool)
    for (_, _, n, raw), at in zip(order, start.tolist()):
        text[at : at + len(raw)] = np.frombuffer(raw, np.uint8).astype(np.int16) + 2
        valid[at : at + n] = True
    suffixes, common = suffix_order(text, WINDOW, memory.queued, memory.arrays)
    begin = np.array([s[1] for s in order], np.int64)
    doc = np.unique(np.array([s[0] for s in order], np.int64), return_inverse=True)[1]
    wide = int((begin + size).max()) + 1

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In order, the windows' suffixes, their places in the corpus (documents in order of id, then starts), and the numbers of their groups: a group shares a whole window."""
        n = 0
        for s in range(0, len(suffixes), BLOCK):
            at, of = suffixes[s : s + BLOCK], n + np.cumsum(common[s : s + BLOCK] < WINDOW)
            n = int(of[-1])
            keep = valid[at]
            at, of = at[keep], of[keep]
            segment = np.searchsorted(start, at, "right") - 1
            yield at, doc[segment] * wide + begin[segment] + at - start[segment], of

    least = np.full(int((common < WINDOW).sum()) + 1, np.iinfo(np.int64).max)
    for _, place, of in blocks():
        np.minimum.at(least, of, place)
    flag = np.zeros(len(text) + 1, bool)
    for at, place, of in blocks():
        flag[at[place > least[of]]] = True
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if flag[0]:
        edge = np.concatenate([[0], edge])
    out = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        k = int(np.searchsorted(start, s, "right")) - 1
        out.append((order[k][0], order[k][1] + s - int(start[k]), e - s))
    return out


#: Suffixes that are looked at together.
BLOCK = 1 << 20
_MARK = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])


#: A window holds so many bytes beside its least gram on one side at least.
SIDE = (WINDOW - GRAM) // 2


def trimmed(segments: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """Segments (m, doc_id, first, n, bytes) of whole groups, without m, cut down to what can have an equal window.

    Equal windows have the least gram at the same place, so they agree in the SIDE bytes before it or in
    those after it. Windows of a segment that shares neither with another of its group go; groups in
    which a segment has its gram twice stay as they are."""
    if not segments:
        return []
    m = np.array([s[0] for s in segments], np.int64)
    size = np.array([len(s[4]) for s in segments], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    raw = np.frombuffer(b"".join(s[4] for s in segments), np.uint8)
    h = grams(raw).view(np.int64)
    of = np.repeat(np.arange(len(segments)), size)[: len(h)]
    hit = np.flatnonzero((h == m[of]) & (np.arange(len(h)) + GRAM <= (start + size)[of]))
    times = np.bincount(of[hit], minlength=len(segments))
    at = np.zeros(len(segments), np.int64)
    at[of[hit][::-1]] = hit[::-1] - start[of[hit][::-1]]
    whole = np.isin(m, m[times != 1])
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[1][raw] * _powers(_BASE, len(raw)), out=total[1:])
    back = _powers(_INVERSE, len(raw))

    def shared(begin: np.ndarray, fits: np.ndarray) -> np.ndarray:
        b = np.where(fits, start + begin, 0)
        key = ((total[np.minimum(b + SIDE, len(raw))] - total[b]) * back[np.minimum(b, len(raw) - 1)]) ^ (m.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, same, n = np.unique(key[fits], return_inverse=True, return_counts=True)
        out = np.zeros(len(segments), bool)
        out[fits] = n[same] > 1
        return out

    left = shared(at - SIDE, at >= SIDE) | whole
    right = shared(at + GRAM, at + GRAM + SIDE <= size) | whole
    out = []
    for (_, doc, first, n, text), p, lo, hi in zip(segments, at.tolist(), left.tolist(), right.tolist()):
        if lo and hi:
            out.append((doc, first, n, text))
        elif lo and p >= SIDE:
            n = min(n, p - SIDE + 1)
            out.append((doc, first, n, text[: n + WINDOW - 1]))
        elif hi and (skip := max(0, p - SIDE + 1)) < n:
            out.append((doc, first + skip, n - skip, text[skip:]))
    return out


def _sorted_shards(memory: Memory) -> Callable:
    """marked() over segments in the order of m; groups of m stay whole, small ones are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def found() -> pa.RecordBatch:
            kept_ = trimmed(held)
            return batch(_MARK, list(zip(*(marked(kept_, memory) if kept_ else []))) or [[], [], []])

        for b in small_batches(batches, 4096):
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                if size > memory.shard and row[0] != last:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield found()

    return run


_SEGMENT = pa.schema([("m", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("raw", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 256):
        out = []
        for doc, text, want in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            out += [(w["m"], doc, w["first"], w["n"], text[w["first"] : w["first"] + w["n"] + WINDOW - 1]) for w in want if w["first"] + w["n"] + WINDOW - 1 <= len(text)]
        yield batch(_SEGMENT, list(zip(*out)) or [[]] * 5)


def resided(m: int, first: int, raw: bytes, n: int) -> list[tuple[int, int, int, bytes]]:
    """(key, first, n, bytes) of the n windows of a run of least hash m: windows in a row whose key is the same. The key
    is of the SIDE bytes before the window's first least gram if it holds them, and of those after the gram if not: equal windows have equal keys."""
    x = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(grams(x).view(np.int64) == m)
    w = np.arange(n)
    p = at[np.searchsorted(at, w)]
    left = p - w >= SIDE
    begin = np.where(left, p - SIDE, p + GRAM)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_LETTER[1][x] * _powers(_BASE, len(x)), out=total[1:])
    key = (total[begin + SIDE] - total[begin]) * _powers(_INVERSE, len(x))[begin] + left.astype(np.uint64)
    key = (key ^ (np.uint64(m & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
    edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]]).tolist()
    return [(int(key[s]), first + s, e - s, raw[s : e + WINDOW - 1]) for s, e in zip(edge[:-1], edge[1:])]


def _by_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 1024):
        out = [(key, doc, f, k, x) for m, doc, first, n, raw in zip(*(b.column(c).to_pylist() for c in range(5))) for key, f, k, x in resided(m, first, raw, n)]
        yield batch(_SEGMENT, list(zip(*out)) or [[]] * 5)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("window", pa.binary()), ("doc_id", pa.int64()), ("first", pa.int64())])
    for b in small_batches(batches, 1024):
        out = [(xxhash.xxh3_128_digest(raw[k : k + WINDOW]), doc, first + k) for doc, first, n, raw in zip(*(b.column(c).to_pylist() for c in range(1, 5))) for k in range(n)]
        yield batch(schema, list(zip(*out)) or [[]] * 3)


def _by_window(segments: DataFrame) -> DataFrame:
    """marked() for groups of any size whose windows share their least gram and the bytes beside it: of equal windows the first stands for all; its place is a partial minimum."""
    windows = map_batches(segments, _windows, "window binary, doc_id long, first long")
    least = cut(windows.groupBy("window").agg(F.min(F.struct("doc_id", "first")).alias("least"), F.count("*").alias("n")).where("n > 1"))
    return by_unique(windows, least, "window").where(F.struct("doc_id", "first") > F.col("least")).select("doc_id", "first", F.lit(1).cast("long").alias("n"))


def _hot(keys: DataFrame) -> DataFrame:
    """The values of m that more than HOT rows have."""
    return cut(keys.groupBy("m").count().where(F.col("count") > HOT).select("m"))


def repeats(docs: DataFrame, memory: Memory = Memory()) -> DataFrame:
    """(doc_id, first, n): each n windows from first on also occur earlier."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(docs).repartition(parts, "m").sortWithinPartitions("m", "whole", "doc_id", "first")
    found = cut(map_batches(dealt, _resolved, "doc_id long, first long, n long, m long, sort boolean"))
    want = cut(found.where("sort").groupBy("doc_id").agg(F.collect_set(F.struct("m", "first", "n")).alias("want")))
    texts = filtered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), want, "left_semi", want.count()).join(want, "doc_id").select("doc_id", "text", "want")
    segments = map_batches(texts, _segments, "m long, doc_id long, first long, n long, raw binary")
    marks = found.where("NOT sort").select("doc_id", "first", "n")
    hot = _hot(found.where("sort"))
    if not hot.isEmpty():
        segments = cut(segments)
        sides = cut(map_batches(segments.join(hot, "m", "left_semi").select(segments.columns), _by_sides, "m long, doc_id long, first long, n long, raw binary"))
        segments, again = segments.join(hot, "m", "left_anti").select(segments.columns), _hot(sides)
        marks = marks.unionByName(_by_window(sides.join(again, "m", "left_semi").select(sides.columns)))
        segments = segments.unionByName(sides.join(again, "m", "left_anti").select(sides.columns))
    shards = segments.repartition(parts, "m").sortWithinPartitions("m", "doc_id", "first")
    return marks.unionByName(map_batches(shards, _sorted_shards(memory), "doc_id long, first long, n long"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def kept(text: bytes, found: list) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the digest of the bytes that remain."""
    spans: list[list[int]] = []
    for x in sorted((w["first"], w["first"] + w["n"] + WINDOW - 1) for w in found):
        if spans and x[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], x[1])
        else:
            spans.append(list(x))
    rest, at = hashlib.sha256(), 0
    for s, e in spans:
        rest.update(text[at:s])
        at = e
    rest.update(text[at:])
    return len(text), sum(e - s for s, e in spans), len(spans), rest.hexdigest()


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 256):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        found = b.column(2).to_pylist() if b.num_columns > 2 else [[]] * len(texts)
        yield batch(_KEPT, [b.column(0), *zip(*(kept(t or b"", f or []) for t, f in zip(texts, found)))])


def remove_repeats(docs: DataFrame, memory: Memory = Memory()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    spans = cut(repeats(docs, memory).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("found")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = spans.count()
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    clean = map_batches(filtered(own, spans, "left_anti", n).select("doc_id", "text"), _finished, ddl)
    hit = filtered(own, spans, "left_semi", n).join(spans, "doc_id").select("doc_id", "text", "found")
    return clean.unionByName(map_batches(hit, _finished, ddl))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without repeated strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
