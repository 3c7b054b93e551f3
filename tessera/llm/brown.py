"""Language-model scores by Brown class-based bigrams.

Word counts are taken over all training texts: tasks count, one aggregation adds up. The most frequent
words, up to `listed`, are broadcast with their counts and classes; all other words stay in tables that
are joined with the texts' remaining words, so every count is used whatever the vocabulary's size.

Every word that occurs twice or more is in a class found by exchange. Clustering begins on the driver with
the most frequent words, `MOVED` or more: each goes to the class that raises the class bigrams' mutual
information most, until none moves. Then, in `ROUNDS` rounds, tasks count each listed word's neighbours by
class, and all listed words go at once to the class that is best against the classes' totals of that round.
Words that aren't listed follow in the same way, once, from shuffled counts. The number of classes grows as
the cube root of the number of words (`class_count`), and the words of the first step with it. Words that
occur once share one class: they stand for what is unseen. The end of a text is its own. A text's score is
the sum of the smoothed logarithms of class transitions and of word emissions.

Defined cases: null texts count as empty, which is the end token alone. Null ids are kept and not
learned from. Repeated rows count and are scored each. Ties between words go to the first in order,
ties between classes to the lowest. Without training texts both scores are 0. Empty tables give an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, cut, drop_cut, map_batches, remainder, small_batches, table

LISTED, MOVED, CLASSES, ROUNDS = 200_000, 512, 48, 2
#: A task hands on its counts at so many words, and its neighbours at so many pairs.
FLUSH, PAIRS = 250_000, 4_000_000
#: So many training tokens have a block of listed words; so many cells are scored at once.
BLOCK, CELLS = 4_000_000, 16_384


def class_count(clustered: int) -> int:
    """The number of classes for so many words."""
    return max(CLASSES, round(clustered ** (1 / 3)))


def words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or b"").lower().split()


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of docs, without the end token."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in small_batches(batches, 256):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                found.update(words(t))
            if len(found) > FLUSH:
                yield batch(schema, [list(found), list(found.values())])
                found = Counter()
        yield batch(schema, [list(found), list(found.values())])

    return map_batches(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The listed words in order of count, their counts and symbols. Symbols: moved words first, then the rest, the end."""

    index: dict[bytes, int]
    n: np.ndarray
    symbol: np.ndarray
    moved: int

    @property
    def symbols(self) -> int:
        return self.moved + 2


def vocabulary(rows: list[tuple[bytes, int]], moved: int = MOVED) -> Vocabulary:
    """From (word, n) in order. One more entry stands for all words not listed, another for the end."""
    n = np.array([r[1] for r in rows], np.int64)
    m = min(moved, len(rows))
    symbol = np.minimum(np.arange(len(rows) + 2), m)
    symbol[-1] = m + 1
    return Vocabulary({w: i for i, (w, _) in enumerate(rows)}, n, symbol, m)


def _places(v: Vocabulary, found: list[bytes]) -> np.ndarray:
    """Entries of the words and of the end."""
    rest = len(v.n)
    out = np.fromiter(map(v.index.get, found, [rest] * len(found)), np.int64, len(found))
    return np.append(out, rest + 1)


def _lists(lengths: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def coded(docs: DataFrame, shared) -> DataFrame:
    """(row, ids, others) of each text: its words' entries, and its words that aren't listed, both in order."""
    schema = pa.schema([("row", pa.int64()), ("ids", pa.list_(pa.int32())), ("others", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rest, row = shared.value.index, len(shared.value.n), TaskContext.get().partitionId() << 33
        for b in small_batches(batches, 256):
            found = [words(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = list(chain.from_iterable(found))
            ids = np.fromiter(map(index.get, flat, repeat(rest)), np.int32, len(flat))
            loose = np.flatnonzero(ids == rest)
            many = np.bincount(np.repeat(np.arange(len(found)), lengths)[loose], minlength=len(found))
            yield batch(schema, [np.arange(row, row + len(found)), _lists(lengths, pa.array(ids)), _lists(many, pa.array([flat[k] for k in loose], pa.binary()))])
            row += len(found)

    return map_batches(docs.select("text"), run, "row long, ids array<int>, others array<binary>")


def _path(ids: pa.ListArray, end: int) -> np.ndarray:
    """The entries of a column of texts, each with the end after it, and one end before all."""
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.insert(np.insert(flat, np.cumsum(lengths), end), 0, end)


def transitions(texts: DataFrame, shared, c: int, loose: bool = True) -> np.ndarray:
    """Counts of pairs of classes over texts (ids), where shared has the entries' classes, of c; without loose, none of words that aren't listed."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(c * c, np.int64)
        for b in small_batches(batches, 1024):
            at = _path(b.column(0), len(of) - 1)
            cell = of[at[:-1]] * c + of[at[1:]]
            if not loose:
                cell = cell[(at[:-1] != len(of) - 2) & (at[1:] != len(of) - 2)]
            total += np.bincount(cell, minlength=c * c)
        cells = np.flatnonzero(total)
        yield batch(schema, [cells, total[cells]])

    return _matrix(map_batches(texts.select("ids"), run, "cell long, n long"), c)


def _matrix(cells: DataFrame, c: int) -> np.ndarray:
    """The sums of (cell, n) as a matrix."""
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(c * c, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(c, c)


def bigrams(docs: DataFrame, shared) -> np.ndarray:
    """Counts of pairs of symbols over all texts, as they are or coded; a text begins after an end."""
    texts = docs if "ids" in docs.columns else coded(docs, shared)
    return transitions(texts, docs.sparkSession.sparkContext.broadcast(shared.value.symbol), shared.value.symbols)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, moved: int, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """The class of each symbol. The first `moved` symbols are exchanged among `classes` classes; each other symbol is a class."""
    b = pairs.astype(float)
    s = len(b)
    k = min(classes, moved)
    of = np.concatenate([np.arange(moved) % max(k, 1), k + np.arange(s - moved)]).astype(np.int64)
    c = k + s - moved
    one = np.zeros((s, c))
    one[np.arange(s), of] = 1
    out, into = b @ one, b.T @ one  # counts of a symbol before, and after, each class
    m = one.T @ out
    for _ in range(rounds):
        changes = 0
        for w in range(moved):
            a, r, q, own = of[w], out[w].copy(), into[w].copy(), b[w, w]
            r[a] -= own
            q[a] -= own
            m[a] -= r
            m[:, a] -= q
            m[a, a] -= own
            fm = _f(m)
            rows, cols = (_f(m + r) - fm)[:k], (_f(m + q[:, None]) - fm)[:, :k]
            d = np.arange(k)
            gain = rows.sum(1) - rows[d, d] + cols.sum(0) - cols[d, d] + _f(m[d, d] + r[d] + q[d] + own) - fm[d, d]
            left, right = m.sum(1)[:k], m.sum(0)[:k]
            gain -= _f(left + r.sum() + own) - _f(left) + _f(right + q.sum() + own) - _f(right)
            to = int(gain.argmax())
            if gain[to] <= gain[a] + 1e-9:
                to = int(a)
            m[to] += r
            m[:, to] += q
            m[to, to] += own
            if to != a:
                changes += 1
                of[w] = to
                out[:, a] -= b[:, w]
                out[:, to] += b[:, w]
                into[:, a] -= b[w]
                into[:, to] += b[w]
        if not changes:
            break
    return of


class Totals:
    """Class bigrams as best() reads them; the first k of the c classes take words."""

    def __init__(self, m: np.ndarray, k: int):
        self.c, self.k = len(m), k
        self.near = np.concatenate([m[:, :k], m[:k].T]).astype(float)  # a class before, then a class after, by the word's class
        self.f = _f(self.near)
        self.left, self.right = m.sum(1)[:k].astype(float), m.sum(0)[:k].astype(float)

    def best(self, key: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The best class of each word against these totals, given the counts n of ascending cells word * 2c + (class before, or c + class after).
        of: the words' classes in the totals, from which their own counts are taken out; k and above take part in no comparison."""
        word, cell = key // (2 * self.c), key % (2 * self.c)
        n = n.astype(float)
        starts = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(key))
        size = np.add.reduceat(np.where(cell < self.c, n, 0), starts[:-1]) if len(key) else np.zeros(0)
        out, i = np.zeros(len(size), np.int64), 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + CELLS, "right")) - 1)
            at = slice(starts[i], starts[j])
            x, own = self.near[cell[at]], np.repeat(of[i:j], np.diff(starts[i : j + 1]))
            gain = _f(x + n[at, None]) - self.f[cell[at]]
            inside = np.flatnonzero(own < self.k)
            a = own[inside]
            gain[inside, a] = self.f[cell[at][inside], a] - _f(np.maximum(x[inside, a] - n[at][inside], 0))
            gain = np.add.reduceat(gain, starts[i:j] - starts[i])
            inside = np.flatnonzero(of[i:j] < self.k)
            a, s = of[i:j][inside], size[i:j]
            for side in (self.left, self.right):
                less = _f(side + s[:, None]) - _f(side)
                less[inside, a] = _f(side[a]) - _f(np.maximum(side[a] - s[inside], 0))
                gain -= less
            out[i:j] = gain.argmax(1)
            i = j
        return out


def moved(texts: DataFrame, of: np.ndarray, m: np.ndarray, tokens: int) -> np.ndarray:
    """The entries' classes after all listed words went at once to the best class against the class bigrams m."""
    k, c, blocks = len(m) - 2, len(m), max(16, tokens // BLOCK)
    shared = texts.sparkSession.sparkContext.broadcast((of, Totals(m, k)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        rest, schema = len(of) - 2, pa.schema([("block", pa.int32()), ("cells", pa.binary())])
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(kept), return_counts=True)
            edges = np.searchsorted(key, np.arange(blocks + 1) * (rest // blocks + 1) * 2 * c)
            parts = [(k, np.concatenate([np.diff(key[i:j], prepend=0), n[i:j]])) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
            return batch(schema, [[k for k, _ in parts], [p.astype(np.int64).tobytes() for _, p in parts]])

        for b in small_batches(batches, 1024):
            at = _path(b.column(0), rest + 1)
            # Words by number in their block: frequent ones are dealt over all blocks.
            place = (at % blocks) * (rest // blocks + 1) + at // blocks
            for w, x, side in ((slice(1, None), slice(None, -1), 0), (slice(None, -1), slice(1, None), c)):
                use = at[w] < rest
                kept.append((place[w] * (2 * c) + side + of[at[x]])[use])
                size += len(kept[-1])
            if size > PAIRS:
                yield flush()
                kept, size = [], 0
        if size:
            yield flush()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, totals = shared.value
        rest, schema = len(of) - 2, pa.schema([("entry", pa.int64()), ("class", pa.int64())])
        for b in small_batches(batches, 1):
            found = [np.frombuffer(x, np.int64).reshape(2, -1) for x in b.column(0)[0].as_py()]
            key, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x[1] for x in found]))
            place = np.unique(key // (2 * c))
            entry = place % (rest // blocks + 1) * blocks + place // (rest // blocks + 1)
            yield batch(schema, [entry, totals.best(key, n, of[entry])])

    cells = map_batches(texts.select("ids"), count, "block int, cells binary").groupBy("block").agg(F.collect_list("cells").alias("cells"))
    got = map_batches(cells.select("cells"), assign, "entry long, class long").toArrow()
    out = of.copy()
    out[got.column("entry").to_numpy()] = got.column("class").to_numpy()
    return out


def loose(texts: DataFrame, shared) -> DataFrame:
    """(row, pos, word, l, r) of each word that isn't listed: the classes before and after it, or -1 for another such word."""
    schema = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("word", pa.binary()), ("l", pa.int32()), ("r", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.copy()
        of[-2] = -1
        for b in small_batches(batches, 1024):
            at = _path(b.column(1), len(of) - 1)
            found = np.flatnonzero(at == len(of) - 2)
            many = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            yield batch(schema, [np.repeat(b.column(0).to_numpy(), many), found.astype(np.int32), b.column(2).flatten(), of[at[found - 1]].astype(np.int32), of[at[found + 1]].astype(np.int32)])

    return map_batches(texts.select("row", "ids", "others"), run, "row long, pos int, word binary, l int, r int")


def placed(found: DataFrame, m: np.ndarray) -> DataFrame:
    """(word, n, class) of the words of loose(): the best class against the class bigrams m; words that occur once stay in the rest."""
    k, c = len(m) - 2, len(m)
    shared, schema = found.sparkSession.sparkContext.broadcast(Totals(m, k)), pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            of = np.full(len(n), k, np.int32)
            several = np.repeat(n > 1, n) & (k > 0)
            word = np.repeat(np.arange(len(n)), n)[several]
            l, r = (np.where(x < 0, k, x)[several] for x in (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3)))
            key, many = np.unique(np.concatenate([word * (2 * c) + l, word * (2 * c) + c + r]), return_counts=True)
            at = np.unique(word)
            of[at] = shared.value.best(key, many, np.full(len(at), k))
            yield batch(schema, [b.column(0), n, of])

    by_word = found.groupBy("word").agg(F.count("*").alias("n"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
    return map_batches(by_word, run, "word binary, n long, class int")


def edges(found: DataFrame, far: DataFrame, rest: int, fn, schema: str) -> DataFrame:
    """fn(row, from, to, row of tokens, n, class) over the words of loose() with n and classes of far: pairs of classes in which one of them is, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, items = b.column(1).value_lengths().to_numpy(zero_copy_only=False), b.column(1).flatten()
            pos, l, r, n, of = (items.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            row = np.repeat(np.arange(len(at)), at)
            order = np.lexsort((pos, row))
            row, l, r, n, of = (x[order] for x in (row, l, r, n, of))
            out = r >= 0
            yield fn(b.column(0), np.concatenate([row, row[out]]), np.concatenate([np.where(l < 0, np.roll(of, 1), l), of[out]]).astype(np.int64), np.concatenate([of, r[out]]).astype(np.int64), row, n, of)

    seen = found.join(far, "word", "left").select("row", F.struct("pos", "l", "r", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(rest)).alias("class")).alias("item"))
    return map_batches(seen.groupBy("row").agg(F.collect_list("item").alias("items")), run, schema)


@dataclass
class Model:
    """Entry to class, log10 of emissions by entry and of transitions by class, log10(c + 1) by entry, log10 of the classes' sizes, sums."""

    words: Vocabulary
    of: np.ndarray
    emit: np.ndarray
    step: np.ndarray
    base: np.ndarray
    size: np.ndarray
    tokens: int
    distinct: int

    def known(self, found: list[bytes]) -> tuple[float, float, int, np.ndarray, np.ndarray, np.ndarray]:
        """Base score and score without what the words that aren't listed add, the number of listed tokens and the end;
        and of the others, as loose() has them, places and classes before and after."""
        at = np.append(len(self.words.n) + 1, _places(self.words, found))
        path, other = self.of[at], at == len(self.words.n)
        step = self.step[path[:-1], path[1:]][~(other[:-1] | other[1:])]
        score = self.emit[at[1:]][~other[1:]].sum() + step.sum()
        path = np.where(other, -1, path)
        k = np.flatnonzero(other)
        return float(self.base[at[1:]].sum() - len(found) * self.unit - self.unit), float(score), len(found) + 1 - len(k) if self.tokens else 0, k, path[k - 1], path[k + 1]

    @property
    def unit(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))


def model(v: Vocabulary, pairs: np.ndarray, tokens: int, distinct: int, ends: int, of: np.ndarray | None = None, far: int = 0) -> Model:
    """The smoothed model: transitions shrink towards the classes' own shares. pairs are of symbols, which are exchanged;
    with the entries' classes in `of`, they are of classes, and `far` words that aren't listed are in classes too."""
    m = pairs
    if of is None:
        of_symbol = exchange(pairs, v.moved)
        of, c = of_symbol[v.symbol], int(of_symbol.max()) + 1
        m = np.zeros((c, c))
        np.add.at(m, (of_symbol[:, None].repeat(len(pairs), 1), of_symbol[None, :].repeat(len(pairs), 0)), pairs)
    c, rest = len(m), of[-2]
    share = (m.sum(0) + 0.1) / (m.sum() + 0.1 * c)
    step = np.log10((m + 2.0 * share) / (m.sum(1, keepdims=True) + 2.0))
    single = of[: len(v.n)] == rest
    size = np.maximum(m.sum(0), 1).astype(float)
    size[rest] = m[:, rest].sum() + distinct - (ends > 0) - int((~single).sum()) - far + 1
    size = np.log10(size)
    emit = np.concatenate([np.log10(np.maximum(v.n, 1) + single) - size[of[: len(v.n)]], [-size[rest], 0.0]])
    base = np.concatenate([np.log10(v.n + 1.0), [0.0, np.log10(ends + 1.0)]])
    if not tokens:
        emit, step = np.zeros_like(emit), np.zeros_like(step)
    return Model(v, of, emit, step, base, size, tokens, distinct)


def information(m: np.ndarray) -> float:
    """Mutual information of class bigrams, times their number, up to a constant."""
    return float(_f(m.astype(float)).sum() - _f(m.sum(0).astype(float)).sum() - _f(m.sum(1).astype(float)).sum())


def frequent(table_of: DataFrame, listed: int) -> list[tuple[bytes, int]]:
    """(word, n) of the most frequent words, at most `listed` of them and none that occurs once, in order of count, then word.

    A histogram of counts, to three digits, gives the least count; no task sorts or gathers more words than are listed."""
    zeros = F.pow(F.lit(10), F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))).cast("long")
    least, held = None, 0
    for r in sorted(table_of.where("n > 1").groupBy((F.expr("n") - F.col("n") % zeros).alias("from")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["from"]):
        held += r["words"]
        if held > listed:
            break
        least = r["from"]
    else:
        least = 2
    if least is None:
        return []
    top = table_of.where(F.col("n") >= least).toArrow()
    return sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist()), key=lambda r: (-r[1], r[0]))


def learned(training: DataFrame, table_of: DataFrame, listed: int = LISTED) -> tuple[Model, DataFrame]:
    """The model of all training texts, and (word, n, class) of the words that it doesn't list."""
    sc = training.sparkSession.sparkContext
    total, distinct, several = table_of.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") > 1)).first()
    ends = training.count()
    tokens, distinct = int(total or 0) + ends, distinct + (ends > 0)
    classes = class_count(several)
    v = vocabulary(frequent(table_of, listed), max(MOVED, 4 * classes))
    shared = sc.broadcast(v)
    texts = cut(coded(training, shared))
    pairs = bigrams(texts, shared)
    of = exchange(pairs, v.moved, classes)[v.symbol]
    c, best = int(of[-1]) + 1, None
    for left in range(ROUNDS, -1, -1):
        m = transitions(texts, sc.broadcast(of), c)
        if best is None or left == ROUNDS - 1 or information(m) > best[0]:  # whatever it brings, every word has a class
            best = information(m), of, m
        if left and c > 2:
            of = moved(texts, of, m, tokens)
    _, of, m = best
    shared_of = sc.broadcast(of)
    far = cut(placed(loose(texts, shared_of), m))

    def cells(_, row, start, to, *rest) -> pa.RecordBatch:
        cell, n = np.unique(start * c + to, return_counts=True)
        return batch(pa.schema([("cell", pa.int64()), ("n", pa.int64())]), [cell, n])

    m = transitions(texts, shared_of, c, False) + _matrix(edges(loose(texts, shared_of), far, c - 2, cells, "cell long, n long"), c)
    drop_cut(texts)
    return model(v, m, tokens, distinct, ends, of, far.where(F.col("class") < c - 2).count()), far


def scores(docs: DataFrame, training: DataFrame, listed: int = LISTED) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of docs."""
    table_of = cut(counted(training))
    found_model, far = learned(training, table_of, listed)
    tokens, rest = found_model.tokens, int(found_model.of[-2])
    fitted = docs.sparkSession.sparkContext.broadcast(found_model)
    drop_cut(table_of)
    ints = pa.list_(pa.int32())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("word", pa.list_(pa.binary())), ("pos", ints), ("l", ints), ("r", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = fitted.value, TaskContext.get().partitionId() << 33
        for b in small_batches(batches, 256):
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = words(t)
                base, own, known, k, l, r = m.known(found)
                out.append((row, doc, len(found) + 1, known, base, own, [found[i - 1] for i in k], k, l, r))
                row += 1
            yield batch(schema, list(zip(*out)))

    def summed(rows, row, start, to, token, n, of) -> pa.RecordBatch:
        m, many = fitted.value, len(rows)
        emit = np.log10(np.where((of == rest) | (n == 0), n + 1, n)) - m.size[of]
        add = np.bincount(row, m.step[start, to], many) + np.bincount(token, emit, many)
        return batch(pa.schema([("row", pa.int64()), ("more", pa.int64()), ("known_base", pa.float64()), ("add", pa.float64())]), [rows, np.bincount(token, n > 0, many).astype(np.int64), np.bincount(token, np.log10(n + 1), many), add])

    parts = cut(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "row long, doc_id long, n_tokens long, known long, base double, own double, word array<binary>, pos array<int>, l array<int>, r array<int>"))
    others = parts.select("row", F.inline(F.arrays_zip("word", "pos", "l", "r")))
    sums = edges(others, far, rest, summed, "row long, more long, known_base double, add double")
    zero = lambda name: F.coalesce(name, F.lit(0))
    out = parts.drop("word", "pos", "l", "r").join(sums, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("known_base")).alias("base_score"), ((F.col("own") + zero("add")) if tokens else F.lit(0.0)).alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document; the fold 2 of 7 is held out."""
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, docs.where(remainder(7) != 2))
    return found.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
