"""Every operator and stage on awkward tables: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

import pytest

from tessera.llm import brown, decontaminate, html_text, language, minhash, packing, pii, pu_quality, quality_rules, substrings

LONG = " ".join(f"word{k % 977} the of and" for k in range(60_000))
ROWS = [
    (1, None, "en", "s", 0),
    (2, "", None, None, None),
    (3, " \n\t ", "en", "s", 4),
    (4, "the quick brown fox jumps over the lazy dog and runs into the dark woods again", "en", "s", 10),
    (4, "the quick brown fox jumps over the lazy dog and runs into the dark woods again", "en", "s", 10),
    (5, "the quick brown fox jumps over the lazy dog and runs into the dark woods again", "de", "s", 10),
    (None, "der schnelle braune Fuchs springt über den faulen Hund und läuft davon", "de", None, 10),
    (7, LONG, "en", "t", len(LONG)),
    (8, "?!", "xx", "t", 2),
    (9, "one two", "fr", "t", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    extra = ["kept", "score", "found", "m", "m_email", "bucket", "count", "row", "_text", "component_id", "first_id", "held", "u"]
    return df.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (None, "alpha beta")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (9, 1, 0), (7, 0, None), (8, None, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "brown": lambda d, i, k: brown.scores(d, d),
    "language": lambda d, i, k: language.identify(d, d),
    "minhash": lambda d, i, k: minhash.near_duplicates(d),
    "packing": lambda d, i, k: packing.pack(d),
    "pii": lambda d, i, k: pii.find(d),
    "pu_quality": lambda d, i, k: pu_quality.score(d, pu_quality.fit(d, k)),
    "quality_rules": lambda d, i, k: quality_rules.assess(d),
    "substrings": lambda d, i, k: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, items, labels, name):
    rows = OPERATORS[name](frame(spark), items, labels).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    if name == "packing":
        assert set(ids) == {(r[0] is None, r[0] or 0) for r in ROWS}
    else:
        assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, items, labels, name):
    assert OPERATORS[name](frame(spark, []), items, labels).count() == 0


def test_leaks(spark, items):
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark), items).collect()}
    assert got == {(4, 1), (5, 1)}
    assert decontaminate.leaks(frame(spark, []), items).count() == 0
    assert decontaminate.leaks(frame(spark), items.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 100_000), (3, "u", "<article><p>Hi"), (None, "u", "<article>x</article>")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 499_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


STAGES = {
    "quality": lambda d, i: quality_rules.keep(d),
    "dedup": lambda d, i: minhash.deduplicate(d),
    "decontaminate": lambda d, i: decontaminate.decontaminate(d, i),
    "redact": lambda d, i: pii.redact(d),
}
LEFT = {"quality": [(4, 3), (7, 1)], "dedup": None, "decontaminate": None, "redact": None}


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, items, name):
    docs = frame(spark)
    out = STAGES[name](docs, items)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    every = sorted((r[0] is None, r[0] or 0) for r in ROWS)
    if name == "redact":
        assert ids == every
    elif name == "dedup":
        assert ids == sorted({x for x in every if x != (False, 5)})
    elif name == "decontaminate":
        assert ids == [x for x in every if x not in ((False, 4), (False, 5))]
    else:
        assert (False, 4) in ids and (False, 2) not in ids
    assert STAGES[name](frame(spark, []), items).count() == 0
