"""Phrases against a plain version and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations
from tessera.llm.common import table

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = Counter()
    for p, a in candidates.items():
        words = p[1:]
        for s in range(2, len(words)):
            for i in range(len(words) - s + 1):
                q = (p[0], *words[i : i + s])
                held[q] = max(held[q], a)
    found = {}
    for p, a in candidates.items():
        if 100 * held[p] >= 80 * a:
            continue
        lang, words = p[0], p[1:]
        score, _, l, r = min((2000000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k, f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, own in found.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


ODD = [
    (None, "New York, new york; NEW YORK! new york\tnew york" * 3),
    (None, None),
    ("en", ""),
    ("en", " \t .,;:!?\n\x0b\x0c\r "),
    ("en", "a b c d e\na b c d e\na b c d f? a b c x a b"),
    ("en", "a b c d e\na b c d e\na b c d f? a b c x a b"),
    ("de", "ÄÖ äö ÄÖ äö ÄÖ äö nbsp word nbsp word İI ii"),
    ("xx", "same " * 500),
]


@pytest.mark.parametrize("size", [5, 100_000])
def test_phrases_against_plain(spark, size):
    """However texts are cut into chunks."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 60").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(None, lang, t) for lang, t in ODD], "doc_id long, lang string, text string")
    every = docs.unionByName(odd)
    want = plain([(r.lang, r.text) for r in every.collect()], 3, 70)
    if size == 5:
        every = odd
        want = plain(ODD, 3, 70)
    clash = every.withColumns({c: F.lit("x") for c in ("chunk", "places", "left", "right", "times", "n", "rank", "phrase", "f")})
    assert got(collocations.phrases(clash, least=3, top=70, chunk=size)) == want
    assert want


def test_pairs_are_sent_packed(spark):
    """A pair of a chunk takes a few bytes on its way to its shard, all its rows meet there, and both ways give back what was packed."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 4000) % 500) for _ in range(12)]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    cut = collocations.chunks(docs, 8000)
    words = collocations._frequent(collocations._words(cut), ["lang", "word"], 3)
    made = collocations.replaced(cut, collocations._named(words, ["place", "id"], 4), 4).selectExpr("chunk", "inline(pairs)").collect()
    meets = defaultdict(set)
    for r in made:
        for left, right in zip(*collocations._unpacked(r.packed, r.n, collocations._PAIR)[:2]):
            meets[left, right].add(r.shard)
    assert {len(s) for s in meets.values()} == {1} and {r.shard for r in made} == {0, 1, 2, 3}
    assert sum(len(r.packed) for r in made) < 10 * sum(r.n for r in made)
    columns = [rng.integers(0, 2**60, 1000), np.arange(1000, dtype=np.int32)]
    assert all((a == b).all() for a, b in zip(columns, collocations._unpacked(collocations._packed(*columns), 1000, "qi")))


def test_no_rows(spark):
    assert got(collocations.phrases(spark.createDataFrame([], "doc_id long, lang string, text string"))) == []


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(collocations.ORACLE_SQL)
    assert [d[0] for d in cur.description] == COLUMNS
    want = sorted(cur.fetchall())
    assert got(collocations.op12_collocations(spark, "/root/testdata/sf0.001")) == want
    assert len(want) >= 50


def test_exact_beyond_64_bits(spark):
    n = 2**61
    own = spark.createDataFrame([(1, "en", "x y", "y", n + 5, [2 * n + 1], [2 * n + 3], 0, 0)], "id long, lang string, phrase string, last string, f long, heads array<long>, tails array<long>, left long, right long")
    (row,) = own.select(collocations._cut(2).alias("c")).collect()
    assert row.c.score == 2000000 * (n + 5) // (4 * n + 4)
