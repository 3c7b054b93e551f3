"""Further personal data: recall on planted secrets, held-out accuracy of the candidates' models, and plans over redacted texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def merged(spans):
    out = []
    for start, end, kind in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, kind])
    return out


def cut(text, spans):
    at, out = 0, ""
    for start, end, kind in merged(spans):
        out += text[at:start] + f"<{kind}>"
        at = end
    return out + text[at:]


def test_planted_secrets_and_clean_texts(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {d: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)] for d, t in texts.items()}
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    hits = [any(s.start <= a and b <= s.end for s in found[d].secret) for d, spans in planted.items() for a, b in spans]
    assert len(hits) > 5 and sum(hits) >= 0.9 * len(hits)
    clean = [d for d, t in texts.items() if not planted[d] and not any(found[d][k.name] for k in pii.BASE)]
    assert sum(bool(found[d][k.name]) for d in clean for k in pii.MORE) <= 0.003 * len(clean)
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for d, t in texts.items():
        assert redacted[d] == cut(t, [(s.start, s.end, k.name.upper()) for k in pii.KINDS for s in found[d][k.name]])


def test_held_out_sentences(spark):
    rows = pii.examples(600, seed=99)
    df = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    covered = lambda i, start, end: any(s.start < end and start < s.end for k in pii.KINDS for s in found[i][k.name])
    right = [covered(i, s, e) for i, (kind, s, e, _) in enumerate(rows) if kind]
    wrong = [covered(i, s, e) for i, (kind, s, e, _) in enumerate(rows) if not kind]
    assert sum(right) >= 0.9 * len(right) and sum(wrong) <= 0.1 * len(wrong)


OVERLAPS = ["write to a@b.cc 10.0.0.1 +49 10.0.0.1 555 1234", "x " * 3000 + "a@b.cc, 10.1.2.3 😀" * 700, "é😀 a@b.cc", "4111 1111 1111 1111", "", "plain words only", "a@b.cc" + " y" * 5000]


def test_redact_cuts_once(spark):
    df = spark.createDataFrame([*enumerate(OVERLAPS), (99, None)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = {r.doc_id: r for r in pii.find(df).collect()}
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    for i, t in enumerate(OVERLAPS):
        assert got[i].text == cut(t, [(s.start, s.end, k.name.upper()) for k in pii.KINDS for s in found[i][k.name]]) and got[i].n_chars == len(got[i].text)
    assert got[99].text is None and got[99].n_chars is None


@pytest.mark.parametrize("read", [lambda r: r.where(F.col("text").contains("<SECRET>")), lambda r: r.groupBy("lang").agg(F.sum("n_chars")), lambda r: r.alias("a").join(r.select("doc_id", F.col("text").alias("other")), "doc_id").where("text <> other")])
def test_redacted_texts_plan_quickly(spark, read):
    red = pii.redact(table(spark, "/root/testdata/sf0.001", "documents"))
    start = time.time()
    read(red)._jdf.queryExecution().executedPlan()
    assert time.time() - start < 15
    read(red).collect()
