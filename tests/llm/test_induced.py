"""Orders and common prefixes against sorting, within small memory; whole texts through the operator with arrays and queues on disk."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import induced, substrings
from test_brute import removed


def draw(rng, letters):
    if rng.random() < 0.5:
        return np.concatenate([np.full(rng.integers(1, 30), rng.integers(1, 1 + letters)) for _ in range(rng.integers(1, 8))])
    return rng.integers(1, 2 + letters, int(rng.integers(1, 80)))


@pytest.mark.parametrize("memory, arrays", [(0, 0), (256, 400), (1 << 20, 1 << 20)])
@pytest.mark.parametrize("alphabet", [4, 4096])
@pytest.mark.parametrize("depth", [3, 8, 1000])
def test_suffix_order(memory, arrays, alphabet, depth):
    for seed in range(60):
        rng = np.random.default_rng(seed)
        t = np.append(draw(rng, 1 + seed % 4), 0).astype(np.int16)
        order, common = induced.suffix_order(t, depth, memory, arrays, alphabet)
        assert sorted(order.tolist()) == list(range(len(t)))
        keys = [tuple(t[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys) and common[0] == 0
        for a, b, n in zip(keys, keys[1:], common[1:]):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == same


def test_queues_spill_and_keep_order():
    q = induced.Queues(2, 40)
    for k in range(5):
        q.put(1, (np.arange(k, k + 3), np.arange(3, dtype=np.int32), np.full(3, k, np.int32)))
    assert q.file is not None
    assert q.take(1, last=True)[0].tolist() == [4, 5, 6] and [q.take(1)[0][0] for _ in range(4)] == [0, 1, 2, 3]


def test_long_runs_are_linear():
    start = time.time()
    order, common = induced.suffix_order(np.append(np.full(3_000_000, 7, np.int16), 0), 100)
    assert order[0] == 3_000_000 and (common[101:] == 100).all() and time.time() - start < 20


@pytest.mark.parametrize("hot", [3, 4096])
def test_whole_operator_in_small_memory(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    memory = substrings.Memory(shard=1_000_000, queued=2000, arrays=2000)
    rng = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, rng.integers(97, 103, n)))
    passage, line = word(300), "-" * 130
    rows = [(k, word(150) + passage[k % 7 : 200 + k] + word(40) + line[: 90 + k] + word(30) + passage) for k in range(40)]
    rows += [(100, "x" * 5000), (101, "x" * 300 + "y"), (102, "ab" * 900), (103, "c" + "ab" * 300), (104, passage + line * 3 + passage)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), memory).collect()}
    assert got == removed(rows)


def test_one_character(spark):
    start = time.time()
    rows = [(1, "z" * 1_000_000), (2, "z" * 500), (3, "q" + "z" * 99)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (999_999, 1), 2: (500, 1), 3: (0, 0)} and time.time() - start < 90


def test_a_shard_without_equal_windows():
    """Two segments agree in the gram and the bytes after it, in no whole window: the shard has no marks, which is a batch of no rows."""
    middle = bytes(range(60, 60 + substrings.GRAM + substrings.SIDE))
    raws = [bytes([side]) * 38 + middle + bytes([side]) * 5 for side in (1, 2)]
    m = int(substrings.grams(np.frombuffer(middle, np.uint8)).view(np.int64)[0])
    rows = [(m, doc, 0, len(raw) - substrings.WINDOW + 1, raw) for doc, raw in enumerate(raws)]
    assert substrings.trimmed(rows)
    found = list(substrings._sorted_shards(substrings.Memory())(iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), substrings._SEGMENT.types)], schema=substrings._SEGMENT)])))
    assert sum(b.num_rows for b in found) == 0
