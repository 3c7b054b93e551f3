"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. It is cut into full windows, which need no partner, and a
rest, itself cut at `piece` tokens. The rests of `chunk` documents are partitioned over the least
number of windows that could hold them: partial partitions with the largest imbalances are merged
again and again, the fullest window of one with the emptiest of the other, until one near-equal
partition is left. While its fullest window exceeds the capacity, the number of windows rises.

Chunks are the documents that a task reads, in order, so nothing is shuffled, memory is bounded, and a
task that is run again packs alike. Sequence ids hold the partition and a counter.

Defined cases: null or empty texts are the end id alone. Null ids, repeated rows and extra columns
don't matter: each row is packed. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, map_batches, small_batches, table

CAPACITY, PIECE, CHUNK = 2048, 512, 2048
END = (1).to_bytes(4, "little")
#: Words and parts of words whose ids a worker remembers.
MEMORY = 250_000


def difference(sizes: list[int], windows: int) -> tuple[list[int], np.ndarray]:
    """Karmarkar-Karp, balanced: the window of each size, and the windows' sums, largest first.

    It starts from partial partitions that hold one size for each window, in order of size, instead
    of single sizes: as many merges as sizes for a window, not as sizes. Ties: earlier sizes first."""
    order = np.argsort(-np.array(sizes, np.int64), kind="stable")
    heap = []
    for k in range(0, len(sizes), windows):
        own = order[k : k + windows]
        sums = np.zeros(windows, np.int64)
        sums[: len(own)] = np.array(sizes, np.int64)[own]
        heap.append((-int(sums[0] - sums[-1]), len(heap), sums, own, np.arange(len(own))))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, own_a, at_a = heapq.heappop(heap)
        _, _, b, own_b, at_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        moved = np.empty(windows, np.int64)
        moved[order] = np.arange(windows)
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), made, sums, np.concatenate([own_a, own_b]), moved[np.concatenate([at_a, windows - 1 - at_b])]))
        made += 1
    _, _, sums, own, at = heap[0]
    out = np.empty(len(sizes), np.int64)
    out[own] = at
    return out.tolist(), sums


def partition(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size, near-equal and within capacity; no size may exceed it."""
    if not sizes:
        return []
    windows = -(-sum(sizes) // capacity)
    while True:
        out, sums = difference(sizes, windows)
        if sums[0] <= capacity:
            return out
        windows += 1


# What a tokenizer's file must say for its words to be encoded one by one: lower case, white space dropped, letters, digits and marks apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_words(described: dict) -> bool:
    """Whether a tokenizer, as its file describes it, gives the same ids for a text and for its words one by one."""
    added = all(t["content"].startswith("<|") for t in described.get("added_tokens") or [])
    return added and described.get("normalizer") == _NORMALIZER and described.get("pre_tokenizer") == _PRE_TOKENIZER


class Ids:
    """Token ids of texts, as little-endian bytes. Where the tokenizer's file says that white space and marks
    split words, texts of the plain characters below are encoded by words, which are remembered; other
    texts, and all texts of other tokenizers, go to the tokenizer whole."""

    # Printable ASCII, usual white space and precomposed Latin letters, but for the dotted capital I, whose lower case is two characters.
    _odd = re.compile("[^\t\n\r -~À-ÖØ-öø-įı-ɏ]|<\\|")
    _parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    # Byte-level vocabularies write bytes that don't print as the characters from 256 on, in order.
    _byte = dict(zip([*range(33), *range(127, 161), 173], range(256, 324)))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.by_words = splits_words(json.loads(self.tokenizer.to_str()))
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, part: str) -> bytes:
        """The ids of a lower-cased word or mark: the tokenizer's merges alone, on the characters that stand for its bytes."""
        tokens = self.merges(part if part.isascii() else part.encode().decode("latin-1").translate(self._byte))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without the end id."""
        if not self.by_words:
            return self._encoded(texts)
        split: list[list[str] | None] = [None if self._odd.search(t) else t.lower().split() for t in texts]
        unknown = {w for words in split if words for w in words}.difference(self.words)
        cut = {w: self._parts.findall(w) for w in unknown}
        new = {p: self._merged(p) for p in {p for found in cut.values() for p in found}.difference(self.parts)}
        know = self.parts
        for w, found in cut.items():
            cut[w] = b"".join([know[p] if p in know else new[p] for p in found])
        out = []
        get, fresh = self.words.get, cut.__getitem__
        for t, words in zip(texts, split):
            out.append(self._encoded([t])[0] if words is None else b"".join([get(w) or fresh(w) for w in words]))
        if len(self.words) < MEMORY:
            self.words.update(cut)
        if len(know) < MEMORY:
            know.update(new)
        return out


_LOADED: dict[str, Ids] = {}


def _loaded(path: str) -> Ids:
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = Ids(path)
    return _LOADED[path]


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def packed(chunk: list[tuple[int | None, bytes]], first: int, capacity: int = CAPACITY, piece: int = PIECE) -> tuple[list[tuple], int]:
    """The pieces of a chunk's documents (id, bytes of their ids), and the next free sequence id."""
    out, rests = [], []
    for doc, ids in chunk:
        n = len(ids) // 4
        full = n - n % capacity
        for s in range(0, full, capacity):
            out.append((doc, s, capacity, zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n, first, 0))
            first += 1
        for s in range(full, n, piece):
            e = min(n, s + piece)
            rests.append((doc, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n))
    used: dict[int, int] = {}
    for r, w in zip(rests, partition([r[2] for r in rests], capacity)):
        at = used.get(w, 0)
        out.append((*r, first + w, at))
        used[w] = at + r[2]
    return out, first + (max(used) + 1 if used else 0)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """A row per piece of every document. tokenizer: the path of a tokenizers file on every executor."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    schema = pa.schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, free = _loaded(tokenizer), [], TaskContext.get().partitionId() << 33

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return batch(schema, list(zip(*found)))

        for b in small_batches(batches, 256):
            for doc, found in zip(b.column(0).to_pylist(), ids.of([t or "" for t in b.column(1).to_pylist()])):
                held.append((doc, found + END))
                if len(held) == chunk:
                    found, free = packed(held, free, capacity, piece)
                    held = []
                    yield rows(found)
        if held:
            found, free = packed(held, free, capacity, piece)
            yield rows(found)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, ", ".join(f"{k} long" for k, _ in FIELDS))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"))
