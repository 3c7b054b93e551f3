"""Distances and verdicts of the quality rules against a plain version, and languages without fixed word lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_class(c):
    if c in " \t\n\r\x0b\x0c":
        return 3
    if c in ".,;:'\"?!()-":
        return 4
    if ord(c) > 127:
        return 7
    if c.isalpha():
        return int(c.isupper())
    if c.isdigit():
        return 2
    return 6 if ord(c) < 32 or ord(c) == 127 else 5


def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    d = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        d += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(d / 2, 0))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain(rows, least=20):
    """doc_id to (character distance, word distance) of (doc_id, text, lang)."""
    from test_brute import rules

    langs = sorted(k for k, n in Counter(x for _, _, x in rows).items() if n >= least and k)
    words = sorted({w for k in langs for w in quality_rules.COMMON_WORDS[k]})
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for d, t, _ in rows}

    def of(d, t):
        c, w = Counter(map(plain_class, t)), Counter(tokens[d])
        listed = [w[x] for x in words]
        return [c[k] for k in range(8)], listed, len(tokens[d])

    sums = {k: ([0] * 8, [0] * len(words), 0) for k in langs}
    for d, t, lang in rows:
        if lang in sums and not rules(t)[5]:
            c, w, n = of(d, t)
            if 100 * sum(w) < 4 * n:
                continue
            a, b, m = sums[lang]
            sums[lang] = [x + y for x, y in zip(a, c)], [x + y for x, y in zip(b, w)], m + n
    refs = {k: (c, [*w, n - sum(w)]) for k, (c, w, n) in sums.items()}
    out = {}
    for d, t, lang in rows:
        c, w, n = of(d, t)
        if lang not in refs:
            out[d] = (None, None)
            continue
        share = {k: sum(w[words.index(x)] for x in quality_rules.COMMON_WORDS[k]) + 1e-9 for k in refs}
        mixed = [[sum(share[k] / sum(share.values()) * refs[k][i][j] / sum(refs[k][i]) for k in refs) for j in range(len(refs[lang][i]))] for i in (0, 1)]
        both = [[*w, n - sum(w)]]
        out[d] = (
            min(plain_distance(c, r[0]) for r in (mixed, refs[lang])) if sum(c) >= 300 else None,
            min(plain_distance(both[0], r[1]) for r in (mixed, refs[lang])) if n >= 80 else None,
        )
    return out


def test_distances(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    want = plain(rows)
    got = quality_rules.assess(docs).collect()
    for r in got:
        for a, b in zip((r.char_distance, r.word_distance), want[r.doc_id]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))
    # The verdict follows from the distances: every limit is the general one or what the language's documents of a length give.
    limits = quality_rules.Limits()
    groups = {}
    lang = {d: x for d, _, x in rows}
    words = {w for k in quality_rules.COMMON_WORDS.values() for w in k}
    teaches = {d: 25 * sum(w in words for w in lower(t).split()) >= len(t.split()) for d, t, _ in rows}
    for r in got:
        groups.setdefault((lang[r.doc_id], int(r.n_words).bit_length()), []).append(r)
    for rs in groups.values():
        most = []
        for name in ("char_distance", "word_distance"):
            v = sorted(r[name] for r in rs if r[name] is not None and teaches[r.doc_id])
            low, mid = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.5)) if v and sum(teaches[r.doc_id] for r in rs) >= 20 else (0, 0)
            most.append(mid + 5 * (mid - low))
        for r in rs:
            far = r.char_distance is not None and r.char_distance > max(most[0], limits.char_distance)
            far = far or (r.word_distance is not None and r.word_distance > max(most[1], limits.word_distance + limits.word_slack / r.n_words**0.5))
            assert r.kept == (not r.base_failed and not far)


FOREIGN = {
    "ru": ("абвгдежзиклмнопрстуфхцчшщыьэюя", "и в не на я быть он с что а по это она этот к но они мы весь который"),
    "ja": ("日本語漢字文書東京都大阪府山川田中", "の に は を た が で て と し れ さ"),
    "pl": ("ąćęłńóśźżabcdefghijklmnoprstuwyz", "i w nie na z się to do jest o jak za od po co"),
}


@pytest.mark.parametrize("many", [3, 60])
def test_no_language_is_lost(spark, many):
    rng = random.Random(many)

    def text(lang):
        letters, common = FOREIGN[lang]
        return " ".join(rng.choice(common.split()) if rng.random() < 0.3 else "".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(200))

    rows = [(10**6 * i + k, text(lang), lang, "s", 1000) for i, lang in enumerate(FOREIGN, 1) for k in range(many)]
    junk = [(10**7, "@@ ## 12 -- ** %% == ++ 99 ;; " * 60, "ru", "s", 1000), (10**7 + 1, " ".join(f"BUY{k}!! NOW{k}%%" for k in range(150)), "ru", "s", 1000)]
    docs = table(spark, SF, "documents")
    both = docs.unionByName(spark.createDataFrame(rows + junk, docs.schema))
    kept = {r.doc_id for r in quality_rules.keep(both).select("doc_id").collect()}
    assert {r[0] for r in rows} <= kept
    if many > 20:
        assert not {r[0] for r in junk} & kept
    before = {r.doc_id for r in quality_rules.keep(docs).select("doc_id").collect()}
    assert before == kept - {r[0] for r in rows + junk}


def test_texts_without_a_reference(spark):
    words = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(k, words, None if k % 2 else "xx") for k in range(10)], "doc_id long, text string, lang string")
    assert all(r.kept and r.char_distance is None for r in quality_rules.assess(df).collect())
    one = quality_rules.assess(df, refs=quality_rules.References({}, {}, {}, {})).collect()
    assert np.all([r.kept for r in one])


@pytest.mark.parametrize("clean,junk", [(60, 100), (100, 60), (20, 400)])
def test_junk_in_the_majority(spark, clean, junk):
    """Clean documents stay and junk goes, whichever are more."""
    rng = random.Random(5)
    nouns = "maison jardin ville route arbre fleur table livre homme femme enfant eau pain soleil mer".split()
    common = quality_rules.COMMON_WORDS["fr"]
    good = [(k, " ".join(rng.choice(common if rng.random() < 0.45 else nouns) for _ in range(200))) for k in range(clean)]
    bad = [(1000 + k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789#$%&@!{}[]") for _ in range(rng.randrange(3, 9))) for _ in range(200))) for k in range(junk)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string").withColumn("lang", F.lit("fr"))
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    assert sum(k < 1000 for k in kept) >= 0.92 * clean and sum(k >= 1000 for k in kept) <= 0.05 * junk
