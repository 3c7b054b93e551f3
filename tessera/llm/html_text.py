"""Main text of HTML pages from a flat list of text blocks.

A page is cut at block-level tags into text blocks. Each block has its word count and link density and
those of its neighbours, and four notes of where it lies: how strongly its elements are marked as no
part of an article, inside an article or main element, in a heading, under a heading that announces
reader comments. A decision tree trained on the small labelled table of pages below keeps or drops it.

Defined cases: null or empty pages give an empty text. Unclosed and misnested tags are tolerated: an
end tag closes up to its nearest open element, and one without an open element is ignored. A tag whose
quotes never close ends at the next ">"; without one it is text. Only the elements that HTML calls void
have no content, whatever slash they end with. Time grows with a page's length, however its tags and quotes are broken.
Repeated rows repeat, null ids are kept, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, map_batches, small_batches, table

# Fixed values of HTML: elements without content, with content that isn't markup, inside a line of text, and that are never of the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = set("nav footer aside form menu dialog button select fieldset svg object audio video canvas".split())
# Words of a class, id or role that mark parts outside the article, and words that only may.
_STRONG = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|sidebar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|comments?|replies|respond|disqus|share|social|related|login|signup|search|toolbar|complementary|contentinfo)(?:$|[\s_-])", re.I)
_WEAK = re.compile(r"(?:^|[\s_-])(?:promo(?:tion)?s?|banner|side|widgets?|header|recommended|copyright|legal)(?:$|[\s_-])", re.I)
_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|your|all|leave a|post a|write a|add a)? ?(?:comments?|reply|replies|responses?|reactions?)|kommentare?|commentaires?|comentarios?|discussion|join the (?:discussion|conversation))\b", re.I)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_MARK = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
STRONG, WEAK = 2, 1


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    words: int
    linked: int
    marked: int
    article: bool
    heading: bool
    comments: bool


class Tags:
    """Where tags end: at the first ">" that isn't quoted. Each quote is followed once, so all tags of a page take linear time."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.known: dict[int, int] = {}

    def end(self, at: int) -> int:
        """The place of the ">" that ends a tag whose name ends at `at`, or -1."""
        page, passed, i, out = self.page, [], at, -1
        while i <= max(self.last.values()):
            j = _MARK.search(page, i).start()
            if j in self.known:
                out = self.known[j]
                break
            passed.append(j)
            c = page[j]
            if c == ">":
                out = j
                break
            if j >= self.last[c]:  # never closed
                break
            i = page.find(c, j + 1) + 1
        self.known.update(dict.fromkeys(passed, out))
        return out if out >= 0 or at > self.last[">"] else page.find(">", at)


def _mark(name: str, attributes: str) -> int:
    """How strongly an element is marked as no part of an article."""
    if name in ASIDE:
        return STRONG
    out = WEAK if name == "header" else 0
    for k, *v in _ATTRIBUTE.findall(attributes) if attributes else ():
        k, value = k.lower(), "".join(v)
        if k == "hidden" or (k == "aria-hidden" and value == "true") or (k == "style" and re.search(r"display\s*:\s*none", value)):
            return STRONG
        if k in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            if _STRONG.search(value):
                return STRONG
            out = max(out, WEAK * bool(_WEAK.search(value)))
    return out


class _Reader:
    """The state of a pass over a page."""

    def __init__(self):
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.names: Counter = Counter()
        self.marks: Counter = Counter()
        self.head = self.comments = False

    def text(self, chunk: str) -> None:
        if chunk:
            self.parts.append(chunk)
            if self.names["a"]:
                self.linked.append(chunk)

    def close_block(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text and not self.head:
            heading = any(self.names[h] for h in HEADINGS)
            words = len(text.split())
            if heading:
                self.comments = words <= 6 and bool(_COMMENTS.match(text))
            linked = min(words, len(html.unescape(" ".join(self.linked)).split()))
            mark = STRONG if self.marks[STRONG] else WEAK if self.marks[WEAK] else 0
            self.out.append(Block(text, words, linked, mark, bool(self.names["article"] or self.names["main"]), heading, self.comments))
        self.parts, self.linked = [], []

    def push(self, name: str, mark: int) -> None:
        self.open.append((name, mark))
        self.names[name] += 1
        self.marks[mark] += 1

    def close(self, name: str) -> None:
        """Close the nearest open element of that name; inline ones only within their block."""
        if not self.names[name]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                for n, m in self.open[k:]:
                    self.names[n] -= 1
                    self.marks[m] -= 1
                del self.open[k:]
                return
            if name in INLINE and self.open[k][0] not in INLINE:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in VOID:
            return
        if name in ("head", "body"):
            self.head = name == "head"
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.names[name]:
            inner = next((n for n, _ in reversed(self.open) if n not in INLINE), None)
            if inner == name:
                self.close(name)
        self.push(name, _mark(name, attributes))


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    page = page or ""
    state, tags, at, done = _Reader(), Tags(page), 0, 0
    while 0 <= (at := page.find("<", at)) <= tags.last[">"]:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            state.text(page[done:at])
            at = done = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            state.text(page[done:at])
            at = done = len(page) if end < 0 else end + 1
            continue
        name = _NAME.match(page, at + 1)
        end = tags.end(name.end()) if name else -1
        if end < 0:
            at += 1
            continue
        state.text(page[done:at])
        tag, attributes = name[0].lower(), page[name.end() : end]
        at = done = end + 1
        if tag.lstrip("/") not in INLINE:
            state.close_block()
        if tag[0] == "/":
            if tag == "/head":
                state.head = False
            state.close(tag[1:])
        elif tag in RAW:
            end = _END_OF[tag].search(page, at)
            at = done = end.end() if end else len(page)
        else:
            state.start(tag, attributes)
    # What is left has no tag, and a comment or declaration in it has no end.
    left = min((k for k in (page.find("<!", done), page.find("<?", done)) if k >= 0), default=len(page))
    state.text(page[done:left])
    state.close_block()
    return state.out


# The labelled table: blocks of pages in order, each by its number of words. l: all of them in links, p: half, q: a fifth;
# s, w: strongly or weakly marked; a: in an article; h: heading; c: under a heading that announces comments; -: not main text.
LABELLED = """
1l- 1l- 2l- 8s- 9ah 80a 3a 60a 1a 45a 20aq 2a 9as- 7s-
3s- 5ah 14a 45a 120a 30ap 6al 1a 4a 60a 2ahs- 25as- 7s- 60s-
2sl- 40s- 12ah 2a 3a 4a 1a 9a 5al 3al 12s- 4s-
1l- 7aw 8awh 70a 35aw 90a 4aw 50a 15aw 22a 90as- 40s- 70s-
6ahw 3aw 40a 12aw 8a 33as- 80as- 18s- 5ah 9a 3s-
2l- 1l- 1l- 8h 70 60 3 45 80 2 30 4- 2l- 3l- 6-
4- 3l- 3l- 9h 120 15 90 5h 60 11 75 4h- 6l- 7l- 5-
2h 30 3 25 40 1l- 1l- 3-
6h 80 75 3hc- 20c- 3c- 35c- 2c- 60c- 8c- 3l- 4-
9h 50 40 2hc- 12c- 3c- 90c-
2wl- 6w- 1l- 1l- 7wh 90 60 12 40 3wl- 5w-
5w- 2l- 3l- 6h 45 70 30w 60 8w- 2l-
1l- 2l- 5h 22 18 25 3l- 4- 2l-
3l- 2l- 30 2l- 3-
5l- 30p- 4l- 6h 60 30p 70 3l- 25p- 2l-
1l- 3- 2l- 5h 6 7 5 8 6 7 9 2l- 3- 1l-
7h 50 2 40 1 35
3- 2l- 3- 2l- 3- 2l- 4h 55 20 3- 2l- 3- 2l-
2 40 3 50
12
70 60 50 4
2l- 2- 1l- 5- 1l- 80 3 70 5q 66 2- 1l- 3- 1l-
3h- 2l- 3l- 2l- 4h 60 30 3h- 2l- 2l- 2l-
20s- 30s- 10s- 90s- 14 60 25s- 70 6s- 2s-
3h 12 40q 3h 15 60p 2h- 4l- 5l-
2l- 1l- 60
1l- 3l- 25
4l- 1l- 90 3l- 6-
1l- 6h 60 70 9
6h 50 40 14
5h 60 2l- 3l- 13-
7h 45 50 4l- 10-
1l- 6ah 50a 4a 7al 5al 60a 2ah 6al 8s-
2ah 3a 5al 6al 40a 2ap 3al 1l-
"""
_FLAGS = re.compile(r"(\d+)([a-z]*)(-?)")
FEATURES = ["words", "density", "words before", "density before", "words after", "density after", "marked", "article", "heading", "comments"]


def _rows(sizes: list[tuple[int, float]], notes: list[tuple]) -> list[tuple]:
    """The features of the blocks of a page, from their words and link densities and their other notes."""
    padded = [(0, 0.0), *sizes, (0, 0.0)]
    return [(*padded[k], *padded[k - 1], *padded[k + 1], *note) for k, note in enumerate(notes, 1)]


def labelled_rows() -> np.ndarray:
    """The features and labels of the labelled table."""
    out = []
    for page in LABELLED.strip().split("\n"):
        found = [_FLAGS.fullmatch(x).groups() for x in page.split()]
        sizes = [(int(n), 1.0 if "l" in f else 0.5 if "p" in f else 0.2 if "q" in f else 0.0) for n, f, _ in found]
        notes = [(STRONG if "s" in f else WEAK if "w" in f else 0, "a" in f, "h" in f, "c" in f) for _, f, _ in found]
        out += [(*row, drop == "") for row, (_, _, drop) in zip(_rows(sizes, notes), found)]
    return np.array(out, float)


def grow(rows: np.ndarray, depth: int = 10):
    """A decision tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above it). Ties: first feature, least threshold."""
    y = rows[:, -1]
    if depth == 0 or len(set(y)) == 1:
        return bool(y.mean() >= 0.5)
    best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, None, None)
    for f in range(rows.shape[1] - 1):
        v = np.unique(rows[:, f])
        for cut in (v[:-1] + v[1:]) / 2:
            left = y[rows[:, f] <= cut]
            right = y[rows[:, f] > cut]
            impurity = len(left) * left.mean() * (1 - left.mean()) + len(right) * right.mean() * (1 - right.mean())
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best[1] is None:
        return bool(y.mean() >= 0.5)
    below = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[below], depth - 1), grow(rows[~below], depth - 1)


TREE = grow(labelled_rows())


def main_text(page: str | None, tree=TREE) -> str:
    """The kept blocks, joined by a space."""
    found = blocks(page)
    kept = []
    for b, row in zip(found, _rows([(b.words, b.linked / b.words) for b in found], [(b.marked, b.article, b.heading, b.comments) for b in found])):
        node = tree
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield batch(schema, [b.column(0), b.column(1), texts, [len(t) for t in texts]])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
