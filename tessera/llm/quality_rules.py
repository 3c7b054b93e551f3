"""Quality rules by distribution divergence.

A document's character-class histogram and its common-word histogram are compared with the
references of its language by Jensen-Shannon distance (square root of the base-2 divergence,
0 to 1). Every language of the table with `least_docs` documents or more has references, measured over
all of its documents that pass the base rules, in one pass of partial sums; its common words are the
fixed lists below or, for other languages, its most frequent words. A document is also compared with
the mixture of references that its common words suggest, since texts can be in several languages. The
least distance counts. How far documents of a language and length lie from their reference is measured in a
second pass: a limit is never less than that pass's median and `spreads` times the distance from the
lower quartile to it. Short texts vary too much to judge: each histogram has a minimum length under
which it isn't compared.

Defined cases: null text counts as empty, and an empty text fails the base rule of 10 words. A document
whose language is null or has no reference isn't compared: the base rules alone decide. Ties
and repeated rows are judged row by row. Null doc_id and lang are kept as they are. An empty table
gives an empty result. Extra columns are ignored by `assess` and kept by `keep`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, map_batches, small_batches, table

# Frequent function words of the languages that have references.
COMMON_WORDS = {
    "en": "the of and to in that is was for it with as be on by he at from his this are or an not have had which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya".split(),
}
#: Character classes of bytes: lower, upper, digit, white space, sentence marks, other marks, controls, lead bytes of non-ASCII characters; continuation bytes don't count.
CLASSES = 8
_CLASS = np.full(256, 8, np.uint8)
_CLASS[np.arange(0, 32)] = 6
_CLASS[np.arange(33, 127)] = 5
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = 3
_CLASS[np.frombuffer(b".,;:'\"?!()-", np.uint8)] = 4
_CLASS[127] = 6
_CLASS[192:256] = 7
_SYMBOLS = b"#*$%&|<>"
#: Listed words of a language; others have the words that make up at least this share of it.
LISTED, SHARE = 30, 0.002
#: A document of a language with a fixed list teaches its reference and limits only if this share of its words is on some list:
#: junk has no such words, so it can't become the reference even where it is the majority.
TAUGHT = 0.04
#: A task hands on its counts at so many words.
FLUSH = 250_000


@dataclass(frozen=True)
class Limits:
    """Greatest distances that a kept document may have where its language doesn't allow more, and the lengths from which they hold."""

    char_distance: float = 0.32
    word_distance: float = 0.175
    word_slack: float = 1.45  # over the square root of the words: what chance adds in short texts
    spreads: float = 5.0  # of the lower quartile from the median, over the median
    min_chars: int = 300
    min_words: int = 80
    least_docs: int = 20


@dataclass
class References:
    """Common words of all languages by number, and by language: their numbers, the histograms, and by length (powers of two) the limits."""

    index: dict[bytes, int]
    place: dict[str, np.ndarray]
    of: dict[str, tuple[np.ndarray, np.ndarray]]
    limits: dict[tuple[str, int], tuple[float, float]]


def base(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    joined = b"".join(words)
    word_chars = len(joined) - len(joined.translate(None, bytes(set(range(256)) - set(range(128, 192)))))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    repeated = 0
    if len(words) > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) < len(grams):
            seen = Counter(grams)
            end = 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + 5 - max(i, end)
                    end = i + 5
    return word_chars, symbols, len(lines) - len(set(lines)), repeated


def histograms(raw: bytes, index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the character classes and of all common words."""
    chars = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    return chars, np.bincount([index[w] for w in raw.lower().split() if w in index], minlength=len(index))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(min(max(d / 2, 0.0), 1.0)))


def _with_rest(listed: np.ndarray, total: int) -> np.ndarray:
    return np.append(listed, max(0, total - int(listed.sum()))).astype(float)


def _compared(raw: bytes, n: int, lang: str | None, refs: References, limits: Limits) -> tuple[float | None, float | None]:
    """Distances of the characters and of the common words of a text of n words from the nearer of its language's
    references and their mixture by the languages' common words in the text; None where they aren't compared."""
    if lang not in refs.of or (len(raw) < limits.min_chars and n < limits.min_words):
        return None, None
    chars, listed = histograms(raw, refs.index)
    shares = {k: float(listed[at].sum()) + 1e-9 for k, at in refs.place.items()}
    total = sum(shares.values())
    among = [refs.of[lang], tuple(sum(shares[k] / total * (r[i] / max(r[i].sum(), 1)) for k, r in refs.of.items()) for i in (0, 1))]
    words = _with_rest(listed, n)
    char_d = min(distance(chars, r[0]) for r in among) if int(chars.sum()) >= limits.min_chars else None
    return char_d, min(distance(words, r[1]) for r in among) if n >= limits.min_words else None


def _frequent(docs: DataFrame, langs: list[str]) -> dict[str, list[bytes]]:
    """The most frequent words of each of these languages."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in small_batches(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found.update((lang, w) for w in (text or b"").lower().split())
            if len(found) > FLUSH:
                yield batch(schema, [[k[0] for k in found], [k[1] for k in found], list(found.values())])
                found.clear()
        yield batch(schema, [[k[0] for k in found], [k[1] for k in found], list(found.values())])

    parts = map_batches(docs.where(F.col("lang").isin(langs)).select("lang", "text"), counts, "lang string, word binary, n long")
    words = parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = parts.groupBy("lang").agg(F.sum("n").alias("total"))
    out: dict[str, list[bytes]] = {k: [] for k in langs}
    # A language has at most 1 / SHARE such words.
    for r in sorted(words.join(F.broadcast(total), "lang").where(F.col("n") >= SHARE * F.col("total")).collect(), key=lambda r: (-r.n, bytes(r.word))):
        out[r.lang].append(bytes(r.word))
    return {k: v[:LISTED] for k, v in out.items()}


def references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """References of each language with enough documents, and the limits that its documents' distances give; the results have a few rows for each language."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    langs = sorted(r.lang for r in docs.where("lang IS NOT NULL").groupBy("lang").count().where(F.col("count") >= limits.least_docs).collect())
    own = {k: [w.encode() for w in COMMON_WORDS[k]] for k in langs if k in COMMON_WORDS}
    if others := [k for k in langs if k not in own]:
        own |= _frequent(docs, others)
    index = {w: i for i, w in enumerate(sorted({w for words in own.values() for w in words}))}
    refs = References(index, {k: np.array([index[w] for w in own[k]], np.int64) for k in langs}, {}, {})
    schema = pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))])
    among = docs.where(F.col("lang").isin(langs))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in small_batches(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if not _failed(len(words), base(text or b"", words)[3]):
                    chars, listed = histograms(text, index)
                    if not _teaches(lang, int(listed.sum()), len(words)):
                        continue
                    row = np.concatenate([chars, listed, [len(words)]])
                    total[lang] = total[lang] + row if lang in total else row
        yield batch(schema, [list(total), [v.tolist() for v in total.values()]])

    got: dict[str, np.ndarray] = {}
    for r in map_batches(among, sums, "lang string, counts array<bigint>").select("lang", F.posexplode("counts")).groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect():
        got.setdefault(r.lang, np.zeros(CLASSES + len(index) + 1))[r.pos] = r.n
    refs.of = {k: (v[:CLASSES], _with_rest(v[CLASSES:-1], int(v[-1]))) for k, v in sorted(got.items())}
    refs.place = {k: refs.place[k] for k in refs.of}
    refs.limits = _allowed(among, refs, limits)
    return refs


def _size(n: int) -> int:
    return n.bit_length()


def _allowed(docs: DataFrame, refs: References, limits: Limits) -> dict[tuple[str, int], tuple[float, float]]:
    """By language and length, how far its documents may lie from it."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("c", pa.float64()), ("w", pa.float64())])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").lower().split()
                if _teaches(lang, sum(w in refs.index for w in words), len(words)):
                    rows.append((lang, _size(len(words)), *_compared(text or b"", len(words), lang, refs, limits)))
            if rows:
                yield batch(schema, list(zip(*rows)))

    of = map_batches(docs, distances, "lang string, size long, c double, w double").groupBy("lang", "size")
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5)), 1000).alias(c)
    far = lambda q: q[1] + limits.spreads * (q[1] - q[0]) if q else 0.0
    return {(r.lang, r["size"]): (far(r.c), far(r.w)) for r in of.agg(F.count("*").alias("n"), quartiles("c"), quartiles("w")).where(F.col("n") >= limits.least_docs).collect()}


def _teaches(lang: str | None, listed: int, n_words: int) -> bool:
    return lang not in COMMON_WORDS or listed >= TAUGHT * n_words


def _failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def judge(raw: bytes, lang: str | None, refs: References, limits: Limits) -> tuple:
    """The row of a text: counts, base verdict, verdict, distances (null where not compared)."""
    words = raw.split()
    word_chars, symbols, dup, repeated = base(raw, words)
    failed = _failed(len(words), repeated)
    char_d, word_d = _compared(raw, len(words), lang, refs, limits)
    char_most, word_most = refs.limits.get((lang, _size(len(words))), (0.0, 0.0))
    far = char_d is not None and char_d > max(char_most, limits.char_distance)
    far = far or (word_d is not None and word_d > max(word_most, limits.word_distance + limits.word_slack / len(words) ** 0.5))
    return len(words), word_chars, symbols, dup, repeated, failed, not failed and not far, char_d, word_d


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def assess(docs: DataFrame, limits: Limits = Limits(), refs: References | None = None) -> DataFrame:
    """doc_id and the row of judge() for each document. refs: other references than those of docs."""
    refs = references(docs, limits) if refs is None else refs
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    schema = pa.schema([("doc_id", pa.int64()), *((f.split()[0], t) for f, t in zip(FIELDS.split(", "), types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = [judge(t or b"", lang, refs, limits) for t, lang in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())]
            yield batch(schema, [b.column(0), *zip(*rows)])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")), run, f"doc_id long, {FIELDS}")


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns; judged in the pass that carries them, without a join."""
    refs = references(docs, limits)
    at, of = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            langs = b.column(of).cast(pa.string()).to_pylist()
            yield b.filter(pa.array([judge(t or b"", lang, refs, limits)[6] for t, lang in zip(b.column(at).cast(pa.binary()).to_pylist(), langs)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return assess(table(spark, sf_dir, "documents"))
