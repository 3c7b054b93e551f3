"""Toxicity by a weighted grammar of clauses.

Five transducers each read one symbol for each word and write one: reported speech and negation mark what
stands in their scope, threats need an announcement before the deed, targets mark what is said to or of
someone, and insults weigh what is left. `compose` joins them into one machine, which reads a clause and
gives the best path's weight. Words become symbols by small lists of the languages here, and by a list of
insults that is learned from labelled documents: words with far more different surroundings in toxic
documents than in others. Surroundings count once, so copies of a document don't make its words insults.

A document's features are the weights of its matched clauses: their sum, the largest, their number and
the sum for each word; a logistic model, fitted to labelled documents that the list wasn't learned from,
makes them a probability. Clauses without an insult or deed match nothing, and alike words weigh less
when negated or reported.

The sample is bounded by `sample` documents of each label, chosen by the hash of their id; every document
is scored over its whole text.

Defined cases: null and empty texts have no clause and score as any text without a match. Null ids are
kept and never learned from; repeated rows repeat. Without labelled rows of both kinds the shipped lists
alone decide. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batch, map_batches, remainder, small_batches, table

#: Symbols. The upper row comes from words, the lower row from transducers.
OTHER, COMMA, INSULT, DEED, ANNOUNCE, TARGET, NEGATION, REPORT, QUOTE = range(9)
NEGATED, REPORTED, THREAT, DIRECTED, HARD = range(9, 14)
SYMBOLS = 14

_WORDS = {
    INSULT: "idiot idiots moron morons scum loser losers imbecile imbeciles dumbass bastard bastards pathetic disgusting worthless stupid vermin subhuman trash "
    "idioten abschaum versager dreckskerl schwachkopf dummkopf widerlich wertlos idiote crétin ordure minable pourriture abruti "
    "idiota imbécil escoria basura asqueroso inútil estúpido patético",
    DEED: "kill hurt murder stab shoot beat destroy burn töten umbringen verletzen erschießen schlagen tuer frapper détruire brûler poignarder matar golpear destruir quemar apuñalar",
    ANNOUNCE: "will gonna going shall must should i'll we'll werde werden wirst soll muss vais allons va devrais doit voy vamos debe debería",
    TARGET: "you your you're yourself they them these those he she him her people du dich dir euch ihr sie ihnen tu toi vous ils elles eux tú usted ustedes ellos ellas vosotros",
    NEGATION: "not no never isn't aren't don't won't wasn't nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says called wrote claimed quoted according reported sagte sagt nannte schrieb behauptete laut disait écrivit appelé selon dijo dice llamó escribió según",
}
#: Learned words weigh up to so much, listed ones so much.
MOST, LISTED = 4.0, 1.0
#: A learned word's least number of surroundings, log odds, and log odds in standard errors.
LEAST, ODDS, ERRORS = 3, 1.5, 2.5
#: Parts of the sample: a document's features for the logistic model come from a list learned without its part.
PARTS = 3
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;:,\n\"“”„«»]")
_MARKS = {q: (QUOTE, 1.0) for q in '"“”„«»'} | {",": (COMMA, 1.0)}


@dataclass(frozen=True)
class Transducer:
    """Letter to letter: arcs[state][symbol] is a list of (symbol written, weight, next state). State 0 starts; a clause must end in one of `final`."""

    arcs: tuple
    final: frozenset

    def best(self, symbols: list[int], scale: list[float]) -> float:
        """The largest weight of a path that reads the symbols; the arc at the k-th weighs scale[k] times its weight."""
        reached = {0: 0.0}
        for s, by in zip(symbols, scale):
            new: dict[int, float] = {}
            for state, so_far in reached.items():
                for _, weight, to in self.arcs[state][s]:
                    total = so_far + by * weight
                    if total > new.get(to, -np.inf):
                        new[to] = total
            reached = new
        return max((w for q, w in reached.items() if q in self.final), default=0.0)


def machine(states: int, rules: dict[tuple[int, int], list[tuple[int, float, int]]], open_states: tuple[int, ...] = ()) -> Transducer:
    """From arcs by (state, symbol); other symbols pass unchanged and keep the state. No clause may end in open states."""
    arcs = tuple(tuple(tuple(rules.get((q, s), [(s, 0.0, q)])) for s in range(SYMBOLS)) for q in range(states))
    return Transducer(arcs, frozenset(range(states)).difference(open_states))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that passes what `first` writes to `second`; weights add. Only pairs of states that can be reached remain."""
    places, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    for p, q in queue:
        row = []
        for s in range(SYMBOLS):
            found = []
            for middle, w, p2 in first.arcs[p][s]:
                for out, v, q2 in second.arcs[q][middle]:
                    if (p2, q2) not in places:
                        places[p2, q2] = len(places)
                        queue.append((p2, q2))
                    found.append((out, w + v, places[p2, q2]))
            row.append(tuple(found))
        arcs.append(tuple(row))
    return Transducer(tuple(arcs), frozenset(k for (p, q), k in places.items() if p in first.final and q in second.final))


def reported() -> Transducer:
    """After a verb of reporting, and between quotes, insults and deeds are another's words."""
    arcs = {(q, REPORT): [(OTHER, 0.0, 1)] for q in range(2)} | {(0, QUOTE): [(OTHER, 0.0, 2)], (1, QUOTE): [(OTHER, 0.0, 2)], (2, QUOTE): [(OTHER, 0.0, 0)]}
    arcs |= {(q, s): [(REPORTED, 0.0, q)] for q in (1, 2) for s in (INSULT, DEED)}
    return machine(3, arcs)


def negation(reach: int = 2) -> Transducer:
    """Insults and deeds up to `reach` words after a negation are denied."""
    arcs: dict = {(q, NEGATION): [(OTHER, 0.0, reach + 1)] for q in range(reach + 2)}
    for q in range(1, reach + 2):
        arcs |= {(q, s): [(s, 0.0, q - 1)] for s in range(SYMBOLS) if s != NEGATION}
        arcs |= {(q, s): [(NEGATED, 0.0, q - 1)] for s in (INSULT, DEED)} | {(q, COMMA): [(OTHER, 0.0, 0)]}
    return machine(reach + 2, arcs)


def threat() -> Transducer:
    """A deed is a threat after an announcement in its clause; alone it is nothing."""
    arcs = {(0, ANNOUNCE): [(OTHER, 0.0, 1)], (1, ANNOUNCE): [(OTHER, 0.0, 1)], (0, DEED): [(OTHER, 0.0, 0)], (1, DEED): [(THREAT, 0.0, 1)]}
    return machine(2, arcs)


def target() -> Transducer:
    """After a target, insults and threats are directed. Before one, a path may guess that they are, and must then meet a target."""
    arcs: dict = {(q, TARGET): [(OTHER, 0.0, 1)] for q in range(3)}
    for s, hit in ((INSULT, DIRECTED), (THREAT, HARD)):
        arcs |= {(0, s): [(s, 0.0, 0), (hit, 0.0, 2)], (1, s): [(hit, 0.0, 1)], (2, s): [(hit, 0.0, 2)]}
    return machine(3, arcs, (2,))


def insult() -> Transducer:
    """Weights of what is left."""
    weights = {INSULT: 1.0, DIRECTED: 1.5, THREAT: 1.0, HARD: 2.0, NEGATED: 0.4, REPORTED: 0.4}
    return machine(1, {(0, s): [(OTHER, w, 0)] for s, w in weights.items()})


def grammar() -> Transducer:
    """All five, composed."""
    out = reported()
    for then in (negation(), threat(), target(), insult()):
        out = compose(out, then)
    return out


FEATURES = 4


@dataclass
class Model:
    """The learned insults with their weights, and the logistic model over the features of clauses."""

    insults: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([2.0, 1.0, 0.5, 5.0]))
    offset: float = -3.5

    def __post_init__(self):
        self.grammar = grammar()
        self.symbols = {w: (s, LISTED) for s, words in _WORDS.items() for w in words.split()}
        self.symbols |= {w: (INSULT, x) for w, x in self.insults.items()}

    def __getstate__(self):
        return self.insults, self.weights, self.offset

    def __setstate__(self, state):
        self.insults, self.weights, self.offset = state
        self.__post_init__()

    def clauses(self, text: str) -> tuple[list[float], int]:
        """The weights of the clauses that match, and the number of words."""
        found = _TOKEN.findall(text.lower())
        known = self.symbols
        hits = [k for k, t in enumerate(found) if t in known and known[t][0] in (INSULT, DEED)]
        words, out, done = len(found), [], -1
        for k in hits:
            if k <= done:
                continue
            start = k
            while start and found[start - 1] not in ".!?;:\n":
                start -= 1
            end = k
            while end < words and found[end] not in ".!?;:\n":
                end += 1
            done = end
            read = [known.get(t) or _MARKS.get(t, (OTHER, 1.0)) for t in found[start:end]]
            weight = self.grammar.best([s for s, _ in read], [w for _, w in read])
            if weight > 0:
                out.append(weight)
        return out, words

    def features(self, text: str) -> list[float]:
        """Of the matched clauses: log of the sum, the largest, log of the number, and the root of the sum for each word."""
        own, words = self.clauses(text)
        total = sum(own)
        return [np.log1p(total), min(max(own, default=0.0), 8.0) / 4, np.log1p(len(own)), np.sqrt(total / max(20, words))]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset by Newton steps; label 0 weighs four times as much as label 1 in all, since clean documents should stay. A feature whose weight would be negative is left out, so no further clause lowers a score."""
    each = np.where(y == 1, 0.2 / max(1, y.sum()), 0.8 / max(1, (1 - y).sum())) * min(len(y), 2000)
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (each * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    if (w[:-1] < 0).any():
        use, out = w[:-1] >= 0, np.zeros(x.shape[1])
        out[use], offset = logistic(x[:, use], y, penalty, steps)
        return out, offset
    return w[:-1], float(w[-1])


def _surroundings(docs: DataFrame) -> DataFrame:
    """(word, near, part, toxic): each word of docs (text, part, toxic) and the hash of its neighbours."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("part", pa.int32()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in small_batches(batches, 128):
            seen = set()
            for text, part, toxic in zip(*(b.column(k).to_pylist() for k in range(3))):
                w = ["", *(t for t in _TOKEN.findall((text or "").lower()) if t[0].isalpha()), ""]
                seen.update((x, f"{p} {n}", part, toxic) for p, x, n in zip(w, w[1:], w[2:]))
            if seen:
                words, near, part, toxic = zip(*seen)
                yield batch(schema, [list(words), [xxh3_64_intdigest(n) - 2**63 for n in near], list(part), list(toxic)])

    return map_batches(docs.select("text", F.col("part").cast("int"), "toxic"), run, "word string, near long, part int, toxic int")


def learned(docs: DataFrame, words: int = 5000) -> list[dict[str, float]]:
    """Insults with their weights, the `words` surest at most, from docs (text, part, toxic): from all of them, then without each of the PARTS parts.

    A word's weight is its log odds less their standard error, so rare words weigh little."""
    scratch = Scratch()
    near = _surroundings(docs).groupBy("word", "near").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"), F.min("part").alias("part"))
    both = scratch.cut(near.groupBy("word", "part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    out = []
    for without in range(-1, PARTS):
        own = both.where(F.col("part") != without)
        bad, good = (x or 0 for x in own.agg(F.sum("bad"), F.sum("good")).first())
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        sums = own.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumns({"odds": odds, "spread": spread})
        sure = sums.where((F.col("bad") >= LEAST) & (F.col("odds") >= ODDS) & (F.col("odds") >= ERRORS * F.col("spread")))
        out.append({r.word: min(MOST, r.odds - r.spread) / 2 for r in sure.orderBy((F.col("odds") / F.col("spread")).desc(), "word").limit(words).collect()})
    scratch.drop()
    return out


def _sampled(marked: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of each label at most, by the hash of doc_id."""
    n = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = lambda k: int(min(1.0, sample / max(1, n.get(k, 0))) * (1 << 24))
    return marked.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 24)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))


def _featured(docs: DataFrame, models: list[Model]) -> DataFrame:
    """toxic and x, the features by the model of its part, of docs (text, part, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in small_batches(batches):
            yield batch(schema, [b.column(2), [own[k].features(t or "") for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]])

    return map_batches(docs.select("text", F.col("part").cast("int"), "toxic"), run, "toxic int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    """The model from docs and labels (doc_id, toxic), both of the rows to learn from only. The sample is read whole for the insults, and by parts for the logistic model."""
    scratch = Scratch()
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = _sampled(marked, sample)  # bounded, so it is broadcast
    rows = scratch.cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS))))
    first, *others = learned(rows)
    model, found = Model(first), _featured(rows, [Model(x) for x in others]).collect()
    scratch.drop()
    y = np.array([r.toxic for r in found], float)
    if 0 < y.sum() < len(y):
        model.weights, model.offset = logistic(np.array([r.x for r in found]), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in small_batches(batches):
            yield batch(schema, [b.column(0), own.score(np.array([own.features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, FEATURES))])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; the fold 0 of 5 is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs.where(remainder(5) != 0), labels.where(remainder(5) != 0)))
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
