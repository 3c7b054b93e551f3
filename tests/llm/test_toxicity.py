"""The clause grammar on sentences and against a search of all paths; accuracy on held-out rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import table

MODEL = toxicity.Model()


def weight(text):
    return sum(MODEL.clauses(text)[0])


def test_clauses():
    assert weight("the weather is fine today") == 0
    assert weight("a stupid plan") == 1.0
    assert weight("you are an idiot") == 1.5
    assert weight("idiot, that is what you are") == 1.5  # the target comes later
    assert weight("that is not stupid") == pytest.approx(0.4)
    assert weight("he is not here, stupid") == 1.5  # a comma ends what is denied
    assert weight('she said he is an "idiot"') == pytest.approx(0.4)
    assert weight("we will kill them") == 2.0 and weight("we will kill time") == 1.0
    assert weight("the frost can kill plants") == 0  # a deed alone is no threat
    assert weight("you are scum. the end") == 1.5 and weight("you. scum here") == 1.0
    assert weight("du bist ein idiot") == 1.5 and weight("vous êtes pathetic") == 1.5
    assert weight("") == 0 and weight("!?") == 0


def test_composition_is_the_cascade():
    """The composed machine gives what running the five one after the other over all paths gives."""
    steps = [toxicity.reported(), toxicity.negation(), toxicity.threat(), toxicity.target(), toxicity.insult()]

    def outputs(t, symbols):
        paths = [(0, (), 0.0)]
        for s in symbols:
            paths = [(to, (*out, o), w + v) for q, out, w in paths for o, v, to in t.arcs[q][s]]
        return [(out, w) for q, out, w in paths if q in t.final]

    rng, whole = random.Random(3), toxicity.grammar()
    for _ in range(300):
        symbols = [rng.randrange(9) for _ in range(rng.randrange(1, 8))]
        found = [(tuple(symbols), 0.0)]
        for t in steps:
            found = [(o, w + v) for own, w in found for o, v in outputs(t, own)]
        assert whole.best(symbols, [1.0] * len(symbols)) == pytest.approx(max(w for _, w in found))


def test_copies_dont_teach(spark):
    """A word of one toxic text isn't an insult however often the text is copied; one with many surroundings is."""
    rng = random.Random(1)
    plain = [f"w{rng.randrange(300)}".replace("0", "o") for _ in range(4000)]
    words = ["".join(chr(97 + int(c)) for c in w[1:].replace("o", "0")) for w in plain]
    rows = [(" ".join(words[k * 20 : k * 20 + 20]), 0) for k in range(150)]
    bad = [(" ".join([*words[k * 20 : k * 20 + 10], "grumblefutz", *words[k * 20 + 10 : k * 20 + 20]]), 1) for k in range(150, 190)]
    copied = [("only once copied peculiar " + " ".join(words[:5]), 1)] * 500
    found, *others = toxicity.learned(spark.createDataFrame(rows + bad + copied, "text string, toxic int").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3))))
    assert len(others) == toxicity.PARTS and all("grumblefutz" in x for x in others)
    assert "grumblefutz" in found and "peculiar" not in found and "copied" not in found


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op13_toxicity(spark, sf).collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").where("toxic IS NOT NULL").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    held = [(got[k].predicted, y) for k, y in marks.items() if k in got and got[k].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.85 and sum(p for p, y in held if not y) <= 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_scores_against_plain(spark):
    """Each row's score is the model's of its whole text; awkward rows have defined scores."""
    texts = [None, "", " ", "you idiot", "x " * 5000 + "you idiot", "you idiot"]
    docs = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = [r.score for r in toxicity.score(docs.coalesce(1), MODEL).collect()]
    assert got == [float(MODEL.score(toxicity.np.array([MODEL.features(t or "")]))[0]) for t in texts]
    assert got[0] == got[1] == got[2] < 0.5 < got[3] == got[5] > got[4]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 0), (1, 0), (None, 1), (9, None)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "a fine day"), (None, None), (1, "you idiot")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 4
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert list(itertools.islice(model.insults, 1)) == []
