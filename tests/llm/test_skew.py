"""Hot keys: groups of exact and near copies and empty texts that hold most rows give the same result as without them."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import minhash, skew
from test_brute import linked


def test_copies_and_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 10)
    monkeypatch.setattr(minhash, "LARGE", 20)
    monkeypatch.setattr(minhash, "CELL", 16)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(60)]
    rows = {k: "the same text in every one of these many rows here" for k in range(100)}
    rows |= {100 + k: "" for k in range(60)}
    for k in range(80):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            w[at] = f"x{rng.integers(500)}"
        rows[200 + k] = " ".join(w)
    rows |= {300 + k: " ".join(f"y{k}a{j}" for j in range(30)) for k in range(20)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == linked(rows)
    want = {k for k, c in linked(rows).items() if k == c}
    assert {r.doc_id for r in minhash.deduplicate(df).collect()} == want


def test_joins(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 5)
    rows = spark.range(200).select(F.when(F.col("id") < 120, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    unique = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).where("k <> 3")
    want = sorted(map(tuple, rows.join(unique.drop("n"), "k").select("k", "v", "m").collect()))
    assert sorted(map(tuple, skew.by_unique(rows, unique, "k").collect())) == want
    assert sorted(map(tuple, skew.salted(rows, unique.drop("n"), "k", "v").select("k", "v", "m").collect())) == want
