"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import cross_tokenizer
from tessera.llm.common import table

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    None,
    "",
    " ",
    "  two  blanks ",
    " leading",
    "trailing ",
    "a\nb\n\nc \n d\t e\r\n",
    "\n",
    "x\n\n",
    "▁ literal mark",
    "ﬁ ligature and ① and ½ and é",
    "naïve café über straße ñandú",
    "日本語 テキスト 😀 emoji 👩‍👩‍👧",
    "<|endoftext|> and <s> and </s> and <unk> and <0x0A>",
    "it's they've 12345 1,234.56 --- ==== don't",
    "\x00\x01\x7f control",
    " nbsp line　wide",
    "same same same same",
    "same same same same",
    "word " * 3000 + "end",
    "x" * 5000,
]


def plain(rows):
    """doc -> digest, from (id, text) rows."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    raw = {}
    n = 256
    for k in range(256):
        if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174:
            raw[chr(k)] = k
        else:
            raw[chr(n)] = k
            n += 1

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, held = [], Counter()
    for i, text in rows:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        ta = [bytes(raw[c] for c in a.id_to_token(x)) for x in ia]
        tb = [b_bytes(x) for x in ib]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            out.append((i, 0, 0, [], ""))
            continue
        found, ka, kb, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
        while ka < len(ta) or kb < len(tb):
            if ea <= eb:
                ga.append(ia[ka])
                ea += len(ta[ka])
                ka += 1
            else:
                gb.append(ib[kb])
                eb += len(tb[kb])
                kb += 1
            if ea == eb and ga and gb:
                found.append((ga, gb))
                ga, gb = [], []
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        held.update({(x, y) for xs, ys in found for x in xs for y in ys})
        out.append((i, len(ia), len(ib), found, hashlib.sha256(said.encode()).hexdigest()))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    result = []
    for i, na, nb, found, sha in out:
        each = [(x, y) for xs, ys in found for x in xs for y in ys]
        result.append((i, na, nb, len(found), len(each), sum(held[p] == most[p[0]] for p in each), sum(held[p] for p in each), sha))
    return result


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_digest_against_plain(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.unionByName(odd)
    want = plain([(r.doc_id, r.text) for r in every.collect()])
    got = rows_of(cross_tokenizer.digest(every.withColumns({c: F.lit("x") for c in ("row", "pair", "a", "b", "held", "rows", "n", "chunk", "docs")}), A, B, 60_000))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 150


def test_hot_pairs(spark, monkeypatch):
    """The same rows whether pairs are broadcast or shuffled."""
    from tessera.llm import skew

    docs = spark.createDataFrame([(k, f"the same words of all and {k}") for k in range(40)] + [(None, "the same words"), (3, "the same words")], "doc_id long, text string")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    for rows in (5, 10_000):
        monkeypatch.setattr(skew, "ROWS", rows)
        assert rows_of(cross_tokenizer.digest(docs, A, B)) == sorted(want, key=str)


def test_common_words_are_aligned_once(spark):
    """Chunks hold only words that aren't common, and the result doesn't depend on which words are."""
    import numpy as np

    docs = spark.createDataFrame([(k, f"some words are in every document, others like n{k * 7919} aren't") for k in range(40)], "doc_id long, text string").coalesce(1)
    words = cross_tokenizer.frequent(docs, A, B)
    assert sorted(words) == sorted("some words are in every document, others like aren't".split())
    found = cross_tokenizer.tokens(docs, A, B, 200, tuple(words), [np.ones(len(words), np.int64)] * 4)
    assert found.count() >= 10 and found.agg(F.sum(F.size("a_ids"))).first()[0] == 40
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    for most in (0, 3, 100):
        assert rows_of(cross_tokenizer.digest(docs, A, B, 200, most)) == want


def test_groups_cut_at_common_ends(spark):
    found = spark.createDataFrame([([1, 2, 3], [2, 3, 7], [4, 5, 6, 7], [1, 3, 5, 7]), ([], [], [], []), ([9], [4], [8], [4])], "a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>")
    got = [(r.a, r.b) for r in cross_tokenizer.groups(found).select("a", "b").collect()]
    assert got == [([[1, 2], [3]], [[4, 5], [6, 7]]), ([], []), ([[9]], [[8]])]


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(1, None)] * n, "doc_id long, text string")
    assert rows_of(cross_tokenizer.digest(docs, A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")] * n
