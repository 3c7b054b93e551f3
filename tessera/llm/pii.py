"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base kinds (email, ip, card, phone) are patterns with checks and are always selected. For further
kinds (phones in national form, numbers of persons and accounts, IPv6, secrets, names, addresses),
high-recall generators propose spans, which may overlap; a boosted-tree model of format and
context features scores each of them, as CASE expressions over an array of features; thresholds
calibrated on sentences that the trees haven't seen select. A span that overlaps a base span is
already covered and isn't added.

A text is cut at the matches of a pattern: extract gives the matches, split the gaps, and running
sums of their lengths the positions, in code points.

Defined cases: null text counts as empty: no spans, and the digest of the empty string; redact leaves
it null. Null ids are kept. Rows are judged one by one, so repeated rows repeat. Patterns are possessive
or bounded, and anchored at run starts, so long runs of one character class stay linear. An empty table
gives an empty result. Extra columns are ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import Booster, platt, threshold
from tessera.llm.common import table

_LOCAL = "[A-Za-z0-9._%+-]"
#: Matches whose lengths are summed together; code points of a piece of text.
BLOCK, CHUNK = 256, 1024


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _matches(x: str, pattern: str) -> str:
    return f"rlike({x}, {_text(pattern)})"


def _groups(x: str, pattern: str) -> str:
    return f"size(regexp_extract_all({x}, {_text(pattern)}, 0))"


def _distinct(x: str) -> str:
    return f"size(array_distinct(regexp_extract_all({x}, '.', 0)))"


_BARE = "trim(LEADING '0' FROM p)"
_IP = f"forall(split(x, '[.]'), p -> length({_BARE}) < 3 OR (length({_BARE}) = 3 AND {_BARE} <= '255'))"
_AT = "cast(substr(d, length(d) - i + 1, 1) AS int)"
_LUHN = f"aggregate(sequence(1, length(d)), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN {_AT} WHEN {_AT} > 4 THEN {_AT} * 2 - 9 ELSE {_AT} * 2 END) % 10 = 0"
# An array of one element stands for a variable.
_CARD = f"get(transform(array({_digits('x')}), d -> CASE WHEN length(d) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END), 0)"
_AS_DIGIT = "ascii(substr(s, i, 1))"
_IBAN = f"get(transform(array(concat(substr(replace(x, ' ', ''), 5), substr(replace(x, ' ', ''), 1, 4))), s -> aggregate(sequence(1, length(s)), 0, (t, i) -> CASE WHEN {_AS_DIGIT} >= 65 THEN (t * 100 + {_AS_DIGIT} - 55) % 97 ELSE (t * 10 + {_AS_DIGIT} - 48) % 97 END) = 1), 0)"


@dataclass(frozen=True)
class Kind:
    """A pattern, a text that every match contains, and the check of a match x, in SQL."""

    name: str
    pattern: str
    needs: str
    ok: str


BASE = [
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _IP),
    # Runs of under 13 digits fail the check whatever they are, so they aren't matched.
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", "", _CARD),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", f"length({_digits('x')}) BETWEEN 9 AND 15"),
]


_WORD = r"[\p{L}'’-]"
# Generators of the further kinds: they propose whatever may be one, and their checks are features, not conditions.
MORE = [
    Kind("local_phone", r"(?<![0-9A-Za-z+.,/:_-])(?:\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}+|0[1-9][0-9]{7,11}|[2-9][0-9]{8,9})(?![0-9A-Za-z])", "", f"length({_digits('x')}) BETWEEN 8 AND 13 AND NOT {_matches('x', '^[0-9]{1,4}([./-])[0-9]{1,2}' + chr(92) + '1[0-9]{1,4}$')}"),
    Kind("ssn", r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])", "", f"NOT {_matches('x', '^(000|666|9)|^...[- ]00|0000$')}"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", _IBAN),
    Kind("ipv6", r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{0,4}+(?![A-Za-z0-9:])", ":", f"(length(regexp_replace(x, '[^:]', '')) = 7 OR {_groups('x', '::')} = 1) AND length(x) > 3"),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+", "", f"{_distinct('x')} >= 10 AND {_matches('x', '[A-Za-z]')} AND NOT {_matches('x', '^[/-]|[a-z]{9}')}"),
    Kind("name", r"(?<![\p{L}0-9'’-])\p{Lu}\p{Ll}{1,15}+(?: \p{Lu}\.)?(?: \p{Lu}\p{Ll}{1,15}+){1,2}+(?![\p{L}0-9])", " ", "size(array_distinct(split(x, ' '))) = size(split(x, ' '))"),
    Kind(
        "address",
        rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}}[a-z]?,? (?:\p{{Lu}}{_WORD}{{1,20}} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Way|Court|Ct|Square)(?!\p{{L}})"
        rf"|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin|allée|impasse) (?:d[eu]s? |de la |de l['’]|d['’])?{_WORD}{{2,20}}(?: \p{{Lu}}{_WORD}{{1,20}}){{0,2}}"
        rf"|\p{{Lu}}{_WORD}{{1,20}}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?(?!\p{{L}})"
        rf"|(?:Calle|Avenida|Plaza|Paseo|Avda\.) (?:(?:de|del|la|los|las) ){{0,2}}\p{{Lu}}{_WORD}{{1,20}}(?: \p{{Lu}}{_WORD}{{1,20}}){{0,2}},? [0-9]{{1,4}}(?![0-9]))",
        " ",
        _matches("x", "[0-9]"),
    ),
]
# Words before a candidate that speak for its kind, and those that speak against any.
CUES = {
    "local_phone": "phone|telefon|téléphone|teléfono|tel|call|mobile|móvil|handy|cell|fax|dial|reach|appel|llám|nummer|numéro|número",
    "ssn": "ssn|social|security|tax|insurance",
    "iban": "iban|account|bank|konto|cuenta|compte|transfer",
    "ipv6": "ip|host|addr|ping|server|route|dns",
    "secret": "token|secret|key|passw|pwd|api|auth|bearer|credential|schlüssel|clé|clave|login",
    "name": "name|mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|mme|señora?|sincerely|regards|dear|signed|contact|patient|customer|grüße|cordialement|atentamente|nom|nombre|llamo|appelle|heiße",
    "address": "address|live|lives|ship|deliver|adresse|wohn|habite|dirección|vive|visit|office|home",
}
AGAINST = "order|invoice|isbn|issn|version|part|serial|ref|item|lot|time|date|mac|sku|page|score|commit|hash|checksum|sha|md5|digest|etag|image|file|path|url|build|ratio|table|figure|chapter"
LETTER = r"\p{L}"
HEX = "^[0-9a-f]+$|^[0-9A-F]+$"


def pieces(text: Column, kind: Kind) -> tuple[Column, Column]:
    """Matches of the kind's pattern, and what a split at them leaves; no matches, no gaps."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(text.contains(kind.needs), found).otherwise(none) if kind.needs else found, F.split(text, kind.pattern, -1)


def _described(kind: Kind) -> Column:
    """Format and context of each candidate of a kind, as arrays of doubles, from columns m_ and g_."""
    before, after = f"right(get(g_{kind.name}, i), 40)", f"left(get(g_{kind.name}, i + 1), 8)"
    low, cues = f"lower({before})", CUES[kind.name]
    values = [
        f"length({_digits('x')})",
        f"length(regexp_replace(x, {_text('[' + LETTER + '0-9]')}, ''))",
        "length(x)",
        _matches(before, "[A-Za-z0-9_/#=.@-]$"),
        _matches(after, "^([A-Za-z0-9_/=@-]|[.][A-Za-z0-9])"),
        _matches(low, cues),
        _matches(low, f"(?:^|[^{LETTER}])(?:{cues})[^\n]{{0,14}}$"),
        _matches(low, AGAINST),
        _matches(before, "[=:]\\s*[\"'`]?$"),
        f"({kind.ok})",
        _distinct("x"),
        _groups("x", "[0-9]+"),
        _groups("x", "[A-Z]"),
        _matches("x", HEX),
        f"CASE WHEN {_matches('x', '^[(]?0')} THEN 0 WHEN {_matches('x', '^[(]?1')} THEN 1 ELSE 2 END",
        _matches(low, "(^|[.!?]\\s*|\n)$"),
    ]
    return F.expr(f"transform(m_{kind.name}, (x, i) -> array({', '.join(f'coalesce(cast({v} AS double), 0D)' for v in values)}))")


# The labelled table: sentences around a value of a kind, and around look-alikes of none.
SENTENCES = {
    "local_phone": ["You can reach me at {} after six.", "Tel. {}", "please call {} now", "Rufen Sie mich unter {} an.", "Telefon: {} (Büro)", "mon numéro est le {} merci", "Appelez le {} pour en savoir plus", "llámame al {} mañana", "Fax {}", "{} is my cell", "text me: {}", "the front desk, {}, is open", "my phone is {} today", "she wrote down {} for him", "Mobil {} oder per Post"],
    "ssn": ["SSN: {}", "her social security number is {} I think", "the taxpayer ({}) has filed", "number {} on the insurance card", "employee {} born 1970", "her ssn is {} ok", "ID {} was verified", "applicant's number was {}."],
    "iban": ["IBAN {}", "please transfer to {} by Friday", "Konto: {}", "mi cuenta es {}", "iban {} x", "virement sur le compte {}", "payee {} thanks", "send it to {} today"],
    "ipv6": ["host {} is up", "ping {}", "logged in from {} at noon", "the client {} was blocked", "address {} on eth0", "route via {} dev", "server at {} replied", "seen from {} twice"],
    "secret": ['token = "{}"', "api_key: {}", "password={}", "export SECRET_KEY='{}'", "Authorization: Bearer {}", "my key is {} keep it safe", "auth {} expires", "client_secret = {}", "use {} to log in", "clé d'accès {}", "AWS_ACCESS {} there", 'the token = "{}" was', "pwd: {}"],
    "name": ["My name is {} and I live here.", "Dear {}, thanks", "Sincerely, {}", "contact {} for details", "Mr. {} said so", "Frau {} war da", "signed by {}", "je m'appelle {}.", "me llamo {} y vivo", "patient: {}", "Dr. {} will see you", "Mit freundlichen Grüßen {}", "the customer, {}, called"],
    "address": ["I live at {} now", "ship to {} please", "our office: {}", "wohnhaft in der {} in Bonn", "j'habite {} à Lyon", "vive en {} desde", "send it to {}.", "deliver: {}", "{} is her home", "they met near {} at six"],
    "": ["order {} was shipped", "invoice {} is due", "see page {} of it", "version {} is out", "ISBN {}", "the score was {} then", "born on {} or so", "commit {} fixed it", "checksum {} matches", "at {} the train left", "values {} were measured", "part {} is missing", "src=/img/{}.png", "sha256 {}", "see table {}", "see {} there", "mac {} seen", "{} of them are done", "build {} passed", "ref {} in the file"],
}
# Names and words that the table's values are made of.
GIVEN, FAMILY = "Anna John Maria Peter Lucie Jean Carlos Elena Hans Karin Ruth Omar Li Priya".split(), "Smith Müller Garcia Dubois Rossi Novak Schmidt Lopez Martin Chen Brown Weber Moreau Ruiz".split()
PLACES, CAPITALS = "Oak Main Mozart Goethe Victor Park Lake Hill Church Linden Sol Mayor Rivoli Station".split(), "United States|New York|Monday Morning|The End|World War|In Addition|High Court|Red Cross|Data Science|Last Year|Prime Minister|South Africa|Apache License|Public License|Creative Commons".split("|")


def _value(kind: str, rng: np.random.Generator) -> str:
    """A value of the kind, or a look-alike of none."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    text = lambda k, of: "".join(pick(of) for _ in range(k))
    some = str(rng.integers(2, 10))
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == "local_phone":
        return pick([f"({some}{num(2)}) {num(3)}-{num(4)}", f"{some}{num(2)}-{num(3)}-{num(4)}", f"{some}{num(2)}.{num(3)}.{num(4)}", f"0{some}{num(1)} {num(7)}", f"0{some} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{some}{num(2)}/{num(6)}", f"6{num(2)} {num(3)} {num(3)}", f"0{some}{num(8)}", f"0{some}{num(1)}-{num(4)}-{num(3)}", f"{some}{num(2)} {num(3)} {num(4)}"])
    if kind == "ssn":
        return f"{rng.integers(1, 600):03d}{pick('- ')}{rng.integers(1, 99):02d}-{rng.integers(1, 9999):04d}"
    if kind == "iban":
        country, body = pick(["DE", "FR", "ES", "GB", "NL"]), num(18)
        s = f"{country}{98 - int(body + ''.join(str(ord(c) - 55) for c in country) + '00') % 97:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    if kind == "ipv6":
        parts = [f"{v:x}" for v in rng.integers(1, 65536, 8)]
        at, gone = rng.integers(1, 6), rng.integers(2, 5)
        return pick([":".join(parts), ":".join(parts[:at]) + "::" + ":".join(parts[at + gone :]), f"{pick(['fe80', '2001:db8', 'fd00'])}::{parts[0]}"])
    if kind == "secret":
        mixed = letters + letters.upper() + "0123456789"
        return pick([text(40, "0123456789abcdef"), text(32, "0123456789abcdef"), f"AKIA{text(16, letters.upper() + '0123456789')}", f"ghp_{text(36, mixed)}", f"sk-{text(32, mixed)}", text(24, mixed) + "7q", text(43, mixed + "+/") + "=", text(64, "0123456789abcdef")])
    if kind == "name":
        return pick([f"{pick(GIVEN)} {pick(FAMILY)}", f"{pick(GIVEN)} {pick('ABCDE')}. {pick(FAMILY)}", f"{pick(GIVEN)} {pick(GIVEN)} {pick(FAMILY)}"])
    if kind == "address":
        n = rng.integers(1, 900)
        return pick([f"{n} {pick(PLACES)} {pick(['Street', 'Ave', 'Road', 'Lane'])}", f"{n}, rue {pick(['de la ', 'du ', ''])}{pick(PLACES)}", f"{pick(PLACES)}{pick(['straße', 'weg', 'platz'])} {n}", f"Calle {pick(PLACES)}, {n}", f"{n} {pick(PLACES)} {pick(PLACES)} Boulevard"])
    return pick([
        f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(7)}", f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2030)}", f"{num(2)} {num(2)} {num(2)}", f"{num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(2)}:{num(2)}:{num(2)}",
        ":".join(text(2, "0123456789abcdef") for _ in range(6)), text(40, "0123456789abcdef"), text(32, "0123456789abcdef"), f"{text(6, letters)}_{text(9, letters)}_{num(4)}", f"{text(9, letters)}/{text(8, letters)}-{num(3)}", "abcabcabc123123123", f"{pick(['XX', 'AB', 'QR'])}{num(20)}", pick(CAPITALS), pick(CAPITALS), f"{num(2)} {pick(PLACES)} {pick(['Trees', 'Apples', 'Times'])}", f"{num(4)}-{num(4)}", "a::b", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", " ".join([pick(PLACES)] * 3), " ".join([pick(PLACES)] * 3),
    ])


def examples(n: int = 2400, seed: int = 5) -> list[tuple[str, int, int, str]]:
    """The labelled table: n rows (kind, start, end, text), a third of them of no kind. The label says what the sentence is about; no feature is consulted."""
    rng = np.random.default_rng(seed)
    kinds = [k for k in SENTENCES if k]
    out = []
    for i in range(n):
        kind = "" if i % 3 == 0 else kinds[i % len(kinds)]
        value, sentence = _value(kind, rng), SENTENCES[kind][rng.integers(len(SENTENCES[kind]))]
        lead = ["", "It was late. ", "Sie kam an. ", "ok; "][rng.integers(4)]
        start = len(lead) + sentence.index("{}")
        out.append((kind, start, start + len(value), lead + sentence.replace("{}", value)))
    return out


@dataclass(frozen=True)
class Scorer:
    """A kind's trees, their calibration and the probability from which a span is selected."""

    trees: Booster
    slope: float
    offset: float
    least: float

    def selects(self, features: str) -> Column:
        """For each array of features in a column, whether its calibrated probability reaches the threshold."""
        return F.expr(f"transform({features}, f -> 1 / (1 + exp(-(({self.trees.sql('f')}) * {self.slope!r}D + {self.offset!r}D))) >= {self.least!r}D)")


_TRAINED: dict[tuple, dict[str, Scorer]] = {}


def train(spark: SparkSession, precision: float = 0.97) -> dict[str, Scorer]:
    """One model per further kind, from the labelled table: half of the sentences fit the trees, half calibrate.

    A candidate is right if the sentence is about its kind and it covers most of the value. The table is
    a constant of this module, so a process fits once."""
    if (precision,) in _TRAINED:
        return _TRAINED[precision,]
    table_of = "\u0002".join("\u0001".join(map(str, (i, *r))) for i, r in enumerate(examples()))
    part = F.split(F.col("row"), "\u0001")
    rows = spark.range(1).select(F.explode(F.split(F.lit(table_of), "\u0002")).alias("row")).select(part[0].cast("int").alias("at"), part[1].alias("kind_of"), part[2].cast("int").alias("start_of"), part[3].cast("int").alias("end_of"), part[4].alias("text"))
    rows = _with_pieces(rows, MORE, "text").withColumns({f"f_{k.name}": _whole(_described(k)) for k in MORE})
    got = sorted(_positions(rows, {k.name: None for k in MORE}).collect(), key=lambda r: r.at)
    out = {}
    for kind in MORE:
        own = [(r, s, f) for r in got for s, f in zip(r[kind.name], r[f"f_{kind.name}"] or [])]
        x = np.array([f for _, _, f in own])
        y = np.array([float(r.kind_of == kind.name and 2 * (min(s.end, r.end_of) - max(s.start, r.start_of)) > r.end_of - r.start_of) for r, s, _ in own])
        fit = np.array([r.at for r, _, _ in own]) // 24 % 2 == 0
        trees = Booster(rounds=12, depth=3).fit(x[fit], y[fit])
        slope, offset = platt(trees.margin(x[~fit]), y[~fit])
        least = threshold(1 / (1 + np.exp(-(trees.margin(x[~fit]) * slope + offset))), y[~fit], precision)
        out[kind.name] = Scorer(trees, float(slope), float(offset), min(max(least, 0.5), 0.9))
    _TRAINED[precision,] = out
    return out


def _whole(column: Column) -> Column:
    """The column, in a form that the optimizer neither copies into filters above nor merges with what reads it."""
    return F.when(F.spark_partition_id() >= 0, column)


def _positions(df: DataFrame, ok: dict[str, str | None]) -> DataFrame:
    """Replace columns m_name and g_name of each kind by name, an array of (start, end) of the matches, or of those whose element of the array column ok[name] is true.

    Running sums are taken over blocks of matches, so a text with very many of them stays cheap."""
    total = lambda a: f"aggregate({a}, 0, (s, v) -> s + v)"
    blocks = lambda k: f"sequence(0, cast(floor((size(m_{k}) - 1) / {BLOCK}) AS int))"
    where = lambda k, value: _whole(F.expr(f"CASE WHEN size(m_{k}) > {BLOCK} THEN {value} END"))
    df = df.withColumns({f"l_{k}": _whole(F.expr(f"transform(m_{k}, (x, i) -> length(x) + length(get(g_{k}, i)))")) for k in ok})
    df = df.withColumns({f"b_{k}": where(k, f"transform({blocks(k)}, b -> {total(f'slice(l_{k}, b * {BLOCK} + 1, {BLOCK})')})") for k in ok})
    df = df.withColumns({f"p_{k}": where(k, f"transform({blocks(k)}, b -> {total(f'slice(b_{k}, 1, b)')})") for k in ok})

    def spans(k: str) -> Column:
        start = f"coalesce(get(p_{k}, i div {BLOCK}), 0) + {total(f'slice(l_{k}, cast(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK})')} + length(get(g_{k}, i))"
        out = f"transform(transform(m_{k}, (x, i) -> struct({start} AS start, length(x) AS n)), s -> struct(s.start AS start, s.start + s.n AS end))"
        if ok[k] is not None:
            out = f"filter({out}, (s, i) -> get({ok[k]}, i))"
        return F.expr(f"CASE WHEN size(m_{k}) > 0 THEN {out} ELSE cast(array() AS array<struct<start:int,end:int>>) END")

    return df.withColumns({k: _whole(spans(k)) for k in ok}).drop(*(f"{c}_{k}" for k in ok for c in "mglbp"))


def _with_pieces(df: DataFrame, kinds: list[Kind], text: str) -> DataFrame:
    both = {k.name: pieces(F.col(text), k) for k in kinds}
    df = df.withColumns({f"m_{k}": _whole(found) for k, (found, _) in both.items()})
    return df.withColumns({f"g_{k}": _whole(F.when(F.size(f"m_{k}") > 0, gaps)) for k, (_, gaps) in both.items()})


KINDS = [*BASE, *MORE]


def _spans(df: DataFrame, text: str) -> DataFrame:
    """df with a column of spans for each kind. Spans of the further kinds that overlap a base one are left out: they are covered."""
    scorers = train(df.sparkSession)
    df = _with_pieces(df, KINDS, text).withColumns({f"f_{k.name}": _whole(_described(k)) for k in MORE})
    ok = {k.name: F.expr(f"transform(m_{k.name}, x -> {k.ok})") for k in BASE} | {k.name: scorers[k.name].selects(f"f_{k.name}") for k in MORE}
    df = df.withColumns({f"ok_{k}": _whole(v) for k, v in ok.items()}).drop(*(f"f_{k.name}" for k in MORE))
    df = _positions(df, {k: f"ok_{k}" for k in ok}).drop(*(f"ok_{k}" for k in ok))
    df = df.withColumn("_taken", _whole(F.concat(*(F.col(k.name) for k in BASE))))
    clear = lambda s: ~F.exists("_taken", lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    return df.withColumns({k.name: F.filter(k.name, clear) for k in MORE}).drop("_taken")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of spans (start, end), in code points."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return _spans(df, "_text").select("doc_id", *(_whole(F.col(k.name)).alias(k.name) for k in KINDS))


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """The code points from a to b of a text in chunks of CHUNK."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    first = F.substr(F.get(chunks, i), a % CHUNK + 1)
    within = F.substr(F.get(chunks, i), a % CHUNK + 1, b - a)
    across = F.concat(first, F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.left(F.get(chunks, j), b - j * CHUNK))
    return F.when(b <= a, "").when(i == j, within).otherwise(across)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each selected span replaced by the name of its kind in angle brackets; spans that overlap are replaced together, by the first one's name. n_chars follows."""
    df = _spans(docs.select(F.struct(*docs.columns).alias("_rest"), F.coalesce("text", F.lit("")).alias("_text")), "_text")
    one = lambda k: F.transform(k.name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k.name.upper()).alias("kind")))
    df = df.select("_rest", "_text", _whole(F.array_sort(F.concat(*(one(k) for k in KINDS)))).alias("_all"))
    some = F.size("_all") > 0
    # The greatest end before a span, from maxima over blocks: where it is over the start, the span goes with those before it.
    df = df.select("_rest", "_text", "_all", _whole(F.transform("_all", lambda s: s["end"])).alias("_ends"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / BLOCK).cast("int"))
    df = df.withColumn("_block", _whole(F.when(some, F.transform(blocks, lambda b: F.array_max(F.slice("_ends", b * BLOCK + 1, BLOCK))))))
    df = df.withColumn("_before", _whole(F.when(some, F.transform(blocks, lambda b: F.array_max(F.slice("_block", 1, b))))))

    def before(i: Column) -> Column:
        return F.greatest(F.get("_before", F.floor(i / BLOCK).cast("int")), F.array_max(F.slice("_ends", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))

    groups = F.transform("_all", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("before")))
    df = df.select("_rest", "_text", _whole(F.filter(groups, lambda s: s["before"].isNull() | (s["before"] <= s["start"]))).alias("_groups"), F.array_max("_ends").alias("_last"), _whole(F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))).alias("_chunks"))
    # A group ends at the greatest end before the next one.
    after = lambda i: F.get("_groups", i + 1)
    chunks = F.col("_chunks")
    parts = F.transform("_groups", lambda s, i: F.concat(F.lit("<"), s["kind"], F.lit(">"), _cut(chunks, F.coalesce(after(i)["before"], "_last"), F.coalesce(after(i)["start"], F.length("_text")))))
    text = F.when(F.size("_groups") > 0, F.concat(_cut(chunks, F.lit(0), F.get("_groups", F.lit(0))["start"]), F.array_join(parts, ""))).otherwise(F.col("_rest")["text"])
    df = df.select("_rest", _whole(text).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_text").isNull(), F.col("_rest")["n_chars"]).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return df.select(*(new.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    df = find(table(spark, sf_dir, "documents"))

    def said(kinds: list[Kind]) -> Column:
        one = lambda name: lambda s: F.concat_ws(":", F.lit(name), s["start"], s["end"])
        return F.array_join(F.concat(*(F.transform(k.name, one(k.name)) for k in kinds)), ",")

    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(said(BASE), 256).alias("base_sha256"), said(KINDS).alias("spans"))
