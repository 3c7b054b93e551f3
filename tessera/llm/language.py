"""Language identification: averaged hashed subword embeddings with a linear softmax.

Byte bigrams and trigrams of the text, with ASCII letters lower-cased and other ASCII characters
read as a space, are hashed to rows of an embedding table; the mean of the rows goes through a linear
softmax. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows, `per_language` of each at most; part of the sample calibrates a temperature and the score under
which a prediction is marked as rejected.

Defined cases: null texts and texts without a letter give `und` with score 0, as does a model without
any labelled row. Ties go to the language first in order. Rows are predicted one by one, so repeated
rows repeat; null ids are kept and never learned from. Empty tables give an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, map_batches, remainder, small_batches, table

BUCKET_BITS, WIDTH = 13, 16
BUCKETS = 1 << BUCKET_BITS
BROADCAST_LANGUAGES = 10_000
# Every letter matches, and so do some number forms.
_MAYBE = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; digits of any script and number forms aren't."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _MAYBE.finditer(text))


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's bigrams and trigrams."""
    a = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    two = a[:-1] * np.uint32(256) + a[1:]
    three = two[:-1] * np.uint32(256) + a[2:] + np.uint32(1 << 24)
    mix, shift = np.uint32(2654435761), np.uint32(32 - BUCKET_BITS)
    return np.bincount((two * mix) >> shift, minlength=BUCKETS) + np.bincount((three * mix) >> shift, minlength=BUCKETS)


@dataclass(frozen=True)
class Model:
    """Weights of each bucket and language (embeddings times softmax), biases, temperature, least accepted score."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, True
        x = counts(text)
        z = (x @ self.weights / x.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        score = float(p[k] / p.sum())
        return self.languages[k], score, score < self.least


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 20.0, seed: int = 3) -> Model:
    """Train on (language, buckets, counts) rows; every fifth row calibrates instead."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    u, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    of = {k: i for i, k in enumerate(languages)}
    data = [(of[k], i, c / c.sum()) for k, i, c in rows]
    train, held = [d for n, d in enumerate(data) if n % 5], [d for n, d in enumerate(data) if n % 5 == 0]
    train = train or data
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for n in rng.permutation(len(train)):
            y, i, w = train[n]
            mean = w @ e[i]
            z = mean @ u + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - step / steps)
            back = u @ p
            u -= lr * 0.02 * np.outer(mean, p)
            bias -= lr * 0.001 * p
            e[i] -= lr * w[:, None] * back
            step += 1
    z = np.array([w @ e[i] @ u + bias for _, i, w in held])
    y = np.array([d[0] for d in held])

    def loss(t: float) -> float:
        q = z / t - (z / t).max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

    temperature = min((0.05 * 1.2**k for k in range(32)), key=loss)
    q = np.exp((z - z.max(1, keepdims=True)) / temperature)
    q /= q.sum(1, keepdims=True)
    right = q.argmax(1) == y
    least = float(np.quantile(q.max(1)[right], 0.005)) if right.any() else 0.0
    return Model(languages, (e @ u).astype(np.float32), bias.astype(np.float32), temperature, least)


def sample(docs: DataFrame, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Bucket counts of at most about per_language labelled rows of each language, by the hash of their id."""
    docs = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    size = docs.groupBy("lang").count()
    size = size.where(f"count > {per_language}")
    # A row per language: broadcast while they are few, so that texts aren't shuffled by language.
    rows = docs.join(F.broadcast(size) if size.count() <= BROADCAST_LANGUAGES else size, "lang", "left")
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.coalesce(F.lit(per_language << 20) / F.col("count"), F.lit(1 << 20)))
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            found = [counts(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            yield batch(schema, [b.column(0), b.column(1), [i.astype(np.uint16).tobytes() for i in at], [c[i].astype(np.float32).tobytes() for c, i in zip(found, at)]])

    got = map_batches(rows.select("lang", F.col("doc_id").cast("long"), "text"), run, "lang string, doc_id long, buckets binary, counts binary").collect()
    return [(r.lang, np.frombuffer(r.buckets, np.uint16), np.frombuffer(r.counts, np.float32)) for r in sorted(got, key=lambda r: (r.doc_id, r.lang, r.buckets))]


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = 600) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs, learned from labelled (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(labelled, per_language)))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield batch(schema, [b.column(0), *zip(*map(model.value.predict, b.column(1).to_pylist()))])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the fold 1 of 3 is held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(remainder(3) != 1))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
