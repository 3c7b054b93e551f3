"""Scores of class-based bigrams against a plain version, from the classes that were found."""

import math
import zlib
from collections import Counter

import pytest

from tessera.llm import brown
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_scores(texts, learn, of):
    """log10 probability of each text; of: word to class, other words and those that occur once are in the class `rest`, the end in `end`."""
    split = {k: [*brown.words(t.encode()), None] for k, t in texts.items()}
    n = Counter(w for k in learn for w in split[k])
    name = lambda w: "end" if w is None else of.get(w, "rest")
    classes = sorted({*of.values(), "rest", "end"}, key=str)
    pairs = Counter()
    for k in learn:
        path = ["end", *map(name, split[k])]
        pairs.update(zip(path, path[1:]))
    total = sum(pairs.values())
    row, col = Counter(), Counter()
    for (a, b), m in pairs.items():
        row[a] += m
        col[b] += m
    share = {b: (col[b] + 0.1) / (total + 0.1 * len(classes)) for b in classes}
    loose = sum(n[w] + 1 for w in n if name(w) == "rest") + 1

    def emission(w):
        if w is None:
            return 0.0
        if name(w) == "rest":
            return math.log10((n[w] + 1) / loose)
        return math.log10(n[w] / col[of[w]])

    def score(words):
        path = ["end", *map(name, words)]
        return sum(math.log10((pairs[a, b] + 2 * share[b]) / (row[a] + 2)) for a, b in zip(path, path[1:])) + sum(map(emission, words))

    return {k: score(words) for k, words in split.items()}


@pytest.mark.parametrize("listed", [100, 200_000])
def test_scores(spark, listed):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    learn = [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    training = docs.where(brown.remainder(7) != 2)
    model, far = brown.learned(training, brown.counted(training).cache(), listed)
    rest = int(model.of[-2])
    of = {w: int(model.of[i]) for w, i in model.words.index.items() if model.of[i] != rest} | {bytes(r.word): r["class"] for r in far.collect() if r["class"] != rest}
    want = plain_scores(texts, learn, of)
    for r in brown.scores(docs, training, listed).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9)


def test_frequent_words(spark):
    rows = [(f"w{k}".encode(), 1 + 10**6 // (k + 1)) for k in range(3000)] + [(b"once", 1)]
    df = spark.createDataFrame(rows, "word binary, n long")
    for listed in (0, 10, 500, 5000):
        got = brown.frequent(df, listed)
        want = sorted(((w, n) for w, n in rows if n > 1), key=lambda r: (-r[1], r[0]))
        assert got == want[: len(got)] and len(got) <= listed and len(got) >= 0.8 * min(listed, 3000)
