"""Quality classifier by positive-unlabelled learning.

A small network over format and wording features is fitted to trusted positives and unlabelled web
text by minimising the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives)). The class prior is estimated from the scores of a first classifier of
positives against unlabelled rows, as the least ratio of their shares in any upper score range. A held
back part of the labelled sample calibrates scores to probabilities.

The samples are bounded by parameters (`positives`, `unlabelled`, `calibration` rows, chosen by the
hash of their id); every document is scored.

Defined cases: null and empty texts have the features of an empty text and are scored as such. Null
ids are kept and never learned from; repeated rows repeat. Without any positive row all scores are
0.5. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import platt
from tessera.llm.common import batch, map_batches, remainder, small_batches, table

_BYTES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "comma": b",",
    "stop": b".",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#*$%&<>@~^_=+/\\{}[]",
    "quote": b"\"'()-:;`",
}
#: Least steps of a training, however small its sample.
STEPS = 600
_GROUP = np.full(256, len(_BYTES), np.uint8)
for _k, _v in enumerate(_BYTES.values()):
    _GROUP[np.frombuffer(_v, np.uint8)] = _k
_GROUP[128:192] = len(_BYTES) + 1
FEATURES = len(_BYTES) + 13  # the groups, other bytes, and twelve of words


def features(raw: bytes) -> list[float]:
    """Shares of character groups, and of words that repeat, shout, carry marks, or are short."""
    words = raw.split()
    n = len(words)
    groups = np.bincount(_GROUP[np.frombuffer(raw, np.uint8)], minlength=len(_BYTES) + 2)[: len(_BYTES) + 1]
    shares = (groups / max(1, groups.sum())).tolist()
    if not n:
        return shares + [0.0] * (FEATURES - len(shares))
    seen = Counter(words)
    pairs = list(zip(words, words[1:], words[2:]))
    again = 1 - len(set(pairs)) / len(pairs) if pairs else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(1 for a, b in zip(words, words[1:]) if a == b) / n
    upper = sum(map(bytes.isupper, words)) / n
    return shares + [
        np.log1p(n) / 10,
        1.0 if n < 10 else 0.0,
        len(seen) / n,
        max(seen.values()) / n,
        again,
        same,
        1 - len(set(lines)) / max(1, len(lines)),
        upper,
        sum(len(w) < 3 for w in words) / n,
        len(raw) / n / 20,
        sum(v for w, v in seen.items() if not w.isalpha() and w.isascii()) / n,
        np.log1p(n / max(1, len(lines))) / 10,
    ]


@dataclass
class Network:
    """One hidden layer with tanh units over standardised features, then a calibrated logistic score."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds before calibration."""
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def train(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 60, least: int = STEPS, hidden: int = 24, rate: float = 0.01, decay: float = 3e-3, seed: int = 1) -> Network:
    """Fit to positives p and unlabelled u. prior None: plain positives against unlabelled."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([p, u])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 0.3, (every.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    parts = max(1, len(u) // 256)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for _ in range(max(epochs, -(-least // parts))):
        for a, b in zip(np.array_split(rng.permutation(len(p)), parts), np.array_split(rng.permutation(len(u)), parts)):
            if not len(a) or not len(b):
                continue
            x = np.concatenate([p[a], u[b]])
            h = np.tanh(x @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3][0]
            zp, zu = z[: len(a)], z[len(a) :]
            # The loss of calling z positive is soft(-z), of calling it negative soft(z).
            if prior is None:
                g = np.concatenate([(sig(zp) - 1) / len(a), sig(zu) / len(b)])
            elif soft(zu).mean() - prior * soft(zp).mean() < 0:  # the negative risk is below zero: step back from it
                g = np.concatenate([prior * sig(zp) / len(a), -sig(zu) / len(b)])
            else:
                g = np.concatenate([prior * ((sig(zp) - 1) - sig(zp)) / len(a), sig(zu) / len(b)])
            back = np.outer(g, weights[2]) * (1 - h**2)
            grads = [x.T @ back + decay * weights[0], back.sum(0), h.T @ g + decay * weights[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                weights[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return net


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among u: a classifier of half of the rows scores the other half, and the
    least ratio, over upper score ranges, of the share of u to that of p bounds the prior from above."""
    net = train(p[::2], u[::2], None, epochs=15, least=0)
    sp, su = np.sort(net.margin(p[1::2])), np.sort(net.margin(u[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    at = sp[np.unique(np.linspace(0, len(sp) - 1, 200).astype(int))]
    qp, qu = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    ok = qp > 0.1
    best = np.argmin((qu[ok] + slack) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.05, 0.95))


def _sampled(df: DataFrame, n: int) -> DataFrame:
    """About n rows at most, by the hash of doc_id; all rows if there are no more."""
    count = df.count()
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 24)) < int(min(1.0, n / max(1, count)) * (1 << 24)))


def _table(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield batch(schema, [b.column(0), [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 6000, calibration: int = 3000) -> Network | None:
    """The model from docs and labels (doc_id, quality), both of the rows to learn from only."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)))
    trusted = _sampled(marked.where("part > 0 AND quality = 1"), positives)
    checks = _sampled(marked.where("part = 0"), calibration)
    chosen = trusted.unionByName(checks).select("doc_id", F.col("quality").cast("int").alias("quality"), (F.col("part") == 0).alias("check"))
    web = _sampled(docs.where("doc_id IS NOT NULL").select("doc_id"), unlabelled).select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(False).alias("check"))
    want = chosen.unionByName(web)  # bounded by the three parameters
    ids = want.select("doc_id").distinct()
    rows = {r.doc_id: r.x for r in _table(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")).collect()}
    got = sorted((r for r in want.collect() if r.doc_id in rows), key=lambda r: (r.doc_id, r.quality is None))
    x = lambda keep: np.array([rows[r.doc_id] for r in got if keep(r)]).reshape(-1, FEATURES)
    p, u = x(lambda r: r.quality == 1 and not r.check), x(lambda r: r.quality is None)
    if not len(p) or not len(u):
        return None
    net = train(p, u, estimated_prior(p, u))
    c, y = x(lambda r: r.check), np.array([r.quality for r in got if r.check])
    if 0 < y.sum() < len(y):
        net.slope, net.offset = platt(net.margin(c), y.astype(float))
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in small_batches(batches):
            x = np.array([features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield batch(schema, [b.column(0), model.score(x) if model and len(x) else np.full(len(x), 0.5)])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; the fold 2 of 4 is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs.where(remainder(4) != 2), labels.where(remainder(4) != 2)))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
