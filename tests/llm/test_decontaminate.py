"""Leaks against a plain search over all positions, substitutions, short items and shared passages."""

from itertools import combinations

import numpy as np
import pytest

from tessera.llm import decontaminate
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"
LIMITS = decontaminate.Limits()


def plain_stretch(same):
    """First and end place of the stretch of greatest sum; of several the first to end, and of those the first to start."""
    best, out = 0.0, (0, 0)
    for s in range(len(same)):
        total = 0.0
        for e in range(s, len(same)):
            total += 1.0 if same[e] else -LIMITS.mismatch
            if total > best + 1e-9 or (abs(total - best) < 1e-9 and total > 0 and e + 1 < out[1]):
                best, out = total, (s, e + 1)
    return out


def plain_leaks(texts, items):
    """(doc, item, matched tokens) by trying every mask at every place of item and text."""
    out = set()
    tokens = {k: decontaminate.tokens(t) for k, t in texts.items()}
    for i, item in items.items():
        b = decontaminate.tokens(item)
        masks = decontaminate.MASKS if len(b) >= 12 else [m for m in decontaminate.SHORT_MASKS if len(m) <= len(b)] or ["1" * len(b)]
        if not b:
            continue
        seeds = {}
        for m in masks:
            for p in range(len(b) - len(m) + 1):
                seeds.setdefault((m, tuple(b[p + j] for j in range(len(m)) if m[j] == "1")), []).append(p)
        for k, a in tokens.items():
            diagonals = {q - p for m in masks for q in range(len(a) - len(m) + 1) for p in seeds.get((m, tuple(a[q + j] for j in range(len(m)) if m[j] == "1")), ())}
            held = set()
            for d in diagonals:
                lo = max(0, d)
                same = [a[q] == b[q - d] for q in range(lo, min(len(a), d + len(b)))]
                s, e = plain_stretch(same) if len(b) >= 12 else (0, len(same))
                held |= {lo - d + x for x in range(s, e) if same[x]}
            if len(held) >= min(LIMITS.many, max(min(LIMITS.least, len(b)), LIMITS.share * len(b))):
                out.add((k, i, len(held)))
    return out


def test_leaks_equal_a_plain_search(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.op1_decontamination(spark, SF).collect()}
    assert got and got == plain_leaks(texts, items)


@pytest.mark.parametrize("n", [8, 9, 10, 11])
def test_short_items_tolerate_substitutions(n):
    words = [f"w{k}" for k in range(n)]
    index = decontaminate.Index([(0, " ".join(words))]).build()
    for gone in combinations(range(n), n - 8):
        text = " ".join(f"z{k}" if k in gone else w for k, w in enumerate(words))
        assert [x[1] for x in index.found([f"a b c {text} d e f"], LIMITS)] == [0]


@pytest.mark.parametrize("share, least", [(0.1, 0.99), (0.2, 0.85)])
def test_recall_under_substitutions(share, least):
    rng = np.random.default_rng(7)
    items = [(k, " ".join(f"t{x}" for x in rng.integers(0, 3000, rng.integers(9, 60)))) for k in range(200)]
    index = decontaminate.Index(items).build()
    texts = []
    for _, t in items:
        w = [f"s{rng.integers(9)}" if rng.random() < share else x for x in t.split()]
        texts.append(" ".join([*(f"t{x}" for x in rng.integers(0, 3000, 100)), *w]))
    found = {(a, b) for a, b, *_ in index.found(texts, LIMITS)}
    kept = [sum(x == y for x, y in zip(t.split(), text.split()[100:])) for (_, t), text in zip(items, texts)]
    due = {(k, k) for k, (_, t) in enumerate(items) if kept[k] >= max(8, 0.5 * len(t.split()))}
    assert len(found & due) >= least * len(due) and not {x for x in found if x[0] != x[1]}


def test_passages_that_items_share(monkeypatch, spark):
    monkeypatch.setattr(decontaminate, "HITS", 100)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4000)
    ask = "which of the following statements about the text above is most likely to be true"
    items = {k: f"{ask} " + " ".join(f"i{k}x{j}" for j in range(30)) for k in range(150)}
    texts = {0: f"{ask} " * 20, 1: items[7], 2: f"{ask} nothing else", 3: None, 4: items[149] + " " + items[3]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decontaminate.leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 7), (4, 149), (4, 3)}
