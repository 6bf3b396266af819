"""Main text of web pages by composite text density.

A page is read into a tree. For every node, C characters and T tags (its own included) lie in it, of
which LC and LT in links; the node's density is

    C / T * log(C / LC * T / LT)  to the base  ln(C / (C - LC) * LC + LCb / Cb * C + e)

where b is the body and a zero divisor counts as 1: characters per tag, lessened by links the more
the richer in links the page is. Four steps find the main text:

1. The heart is the container whose children's densities sum to the most (paragraphs, headings and
   inline elements are no containers; of a tie the first). Its subtree is taken whole.
2. The threshold is the smallest density on the heart's path to the body. A subtree beside that path
   is taken too if its density and the largest sum within it both reach the threshold: an article may
   stand in several boxes. A box that holds nothing but its own words has no sum, so a line of
   advertising isn't taken, however dense; but of what stands in one element with the heart, titles,
   paragraphs and boxes of these only need the density, if they have no link and no hint.
3. Within what is taken, a subtree under the threshold goes if most of its characters are in two or
   more links; so does a form that isn't on the heart's path. Lists of links in an article or main
   element stay.
4. Class, id or role may hint at something beside the text. Characters under a hint weigh ``HINTED``
   of others, down to the next article or main element, and within what is taken a hinted subtree
   under the threshold goes; in an article or main element only if it has links or the hint is of
   advertising or comments. A hint on what holds most of the page and all its articles is no hint. What has most of the page's characters never goes.

Cut from the tree before are only what isn't shown (scripts, styles, comments, hidden elements) and the
elements that stand for menus, headers, footers, sidebars, notices and controls (``nav``, ``footer``,
``button``...; a ``header`` within an article or main element is the article's own).
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_of, walk

_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[a-z]+")
# Elements by kind (HTML, fixed values).
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body html caption tbody tfoot thead tr legend".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_LIST_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_SCOPE = frozenset("html body table td th caption object template button".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
_NO_CONTAINER = _INLINE | _VOID | frozenset("p h1 h2 h3 h4 h5 h6 pre dt summary caption figcaption legend address hgroup".split())
_ARTICLES = frozenset("article main".split())
_HEARTS = _ARTICLES | {"html", "body"}
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
# Elements that are never main text, and words that hint at what stands beside it.
_NEVER = frozenset("head nav aside footer button select option input label dialog menu search template svg canvas object audio video map".split()) | _RAW
_HINTS = frozenset("ad ads advert advertisement alert banner breadcrumb comment comments complementary contentinfo cookie footer menu nav navigation newsletter notice pagination promo related share sidebar social sponsored subscribe widget".split())
# Of these, what stands within an article's text without belonging to it.
_FOREIGN = frozenset("ad ads advert advertisement comment comments cookie newsletter sponsored".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Weight of a character under a hint.
HINTED = 0.02


class Page:
    """The tree, without what is never shown or never main text. Node 0 is the body."""

    def __init__(self, source: str):
        self.tag, self.parent, self.items = ["body"], [-1], []  # items: (node, text), or (node, None) where a block starts or ends
        self.chars, self.hinted = [0], [0]  # hinted: 1 at something beside the text, 2 at what isn't text within it
        self.stack: list[tuple[str, int]] = [("body", 0)]  # open elements and their nodes, -1 in what is cut
        self.open: dict[str, list[int]] = {}  # tag -> places in the stack
        self.blocks, self.cut, self.articles = [0], 0, 0
        self.line = (0, 0)  # node with line breaks, and the last of these: it counts the words that follow
        at = 0
        while True:
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if close:
                self._end(name)
                continue
            self._start(name, rest)
            if name in _RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else len(source)
                self._end(name)

    def _text(self, text: str) -> None:
        if self.stack[-1][0] == "head" and not text.isspace():
            self._pop()
        if self.cut or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        node = self.stack[-1][1]
        self.items.append((node, text))
        self.chars[self.line[1] if node == self.line[0] else node] += len("".join(text.split()))

    def _push(self, name: str, node: int) -> None:
        self.open.setdefault(name, []).append(len(self.stack))
        if name in _BLOCK or name in _SCOPE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, node))
        self.articles += name in _ARTICLES

    def _pop(self) -> None:
        name, node = self.stack.pop()
        self.open[name].pop()
        if self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.articles -= name in _ARTICLES
        if node < 0:
            self.cut -= 1
        elif name in _BLOCK:
            self.items.append((self.stack[-1][1], None))

    def _nearest(self, names) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def _close(self, names, scope) -> None:
        """Closes the nearest open element of these names, unless a later one is of ``scope`` (names, or a place in the stack)."""
        at = self._nearest(names)
        if at > 0 and at > (scope if isinstance(scope, int) else self._nearest(scope)):
            while len(self.stack) > at:
                self._pop()

    def _node(self, name: str, hinted: int = 0) -> int:
        self.tag.append(name)
        self.parent.append(self.stack[-1][1])
        self.chars.append(0)
        self.hinted.append(hinted)
        return len(self.tag) - 1

    def _start(self, name: str, rest: str) -> None:
        if name == "body":
            self._close(("head",), ())
        elif self.stack[-1][0] == "head" and name not in _IN_HEAD:
            self._pop()
        if name in ("html", "body") or (name == "form" and self.open.get("form")):  # forms don't nest
            return
        if name in _ENDS_P:
            self._close(("p",), _SCOPE)
        if name in _ENDS:
            self._close(_ENDS[name], _LIST_SCOPE[name] | _HEARTS)
        top = self.stack[-1][1]
        if name in _VOID:
            if not self.cut:
                self.items.append((top, None) if name == "hr" else (top, " " if name in ("br", "wbr") else ""))
                node = self._node(name)
                if name == "br":
                    self.line = (top, node)
            return
        never, hinted = (False, False) if self.cut else self._judged(name, rest)
        if self.cut or never:
            if not self.cut and name in _BLOCK:
                self.items.append((top, None))
            self.cut += 1
            self._push(name, -1)
            return
        node = self._node(name, hinted)
        self._push(name, node)
        if name in _BLOCK:
            self.items.append((node, None))
        elif name in ("td", "th"):
            self.items.append((node, " "))

    def _end(self, name: str) -> None:
        if name not in ("html", "body"):
            self._close((name,), self.blocks[-1] if name in _INLINE else _SCOPE if name == "p" else ())

    def _judged(self, name: str, rest: str) -> tuple[bool, int]:
        """Whether an element is cut, and how far its names hint that it isn't text (0 to 2)."""
        if name in _NEVER or (name == "header" and not self.articles):
            return True, False
        if not rest or rest.isspace():
            return False, False
        given: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(rest):
            given.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return True, False
        if name in _HEARTS:
            return False, False
        words = _NAME_PARTS.findall(f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower())
        return False, 2 * (not _FOREIGN.isdisjoint(words)) or int(not _HINTS.isdisjoint(words))

    def weighed(self) -> list[float]:
        """Characters of each node alone by their weight; hints of what holds most of the page, and every article of it, are struck out."""
        n = len(self.tag)
        below, articles = list(self.chars), [int(t in _ARTICLES) for t in self.tag]
        for k in range(n - 1, 0, -1):
            below[self.parent[k]] += below[k]
            articles[self.parent[k]] += articles[k]
        weight = [1.0] * n
        for k in range(1, n):
            self.hinted[k] = self.hinted[k] if 2 * below[k] <= below[0] or articles[k] < articles[0] else 0
            weight[k] = 1.0 if self.tag[k] in _ARTICLES else HINTED if self.hinted[k] else weight[self.parent[k]]
        return [c * w for c, w in zip(self.chars, weight, strict=True)]

    def densities(self) -> tuple[list[float], list[float]]:
        """Density of each node and the sum of its children's."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = self.weighed(), [1] * n, [0.0] * n, [0] * n
        for k in range(n - 1, 0, -1):  # children come after their parents
            if self.tag[k] == "a":
                link_chars[k], link_tags[k] = chars[k], tags[k]
            p = self.parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k]
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k]
        self.links = [(lc, c, lt) for lc, c, lt in zip(link_chars, chars, link_tags, strict=True)]
        share = link_chars[0] / (chars[0] or 1)
        density = [0.0] * n
        for k in range(n):
            c, t, lc, lt = chars[k], tags[k], link_chars[k], link_tags[k]
            if c:
                base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
                density[k] = c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1.0)) / math.log(max(base, 1.0) + 1e-9 + (base <= 1))
        sums = [0.0] * n
        for k in range(1, n):
            sums[self.parent[k]] += density[k]
        return density, sums

    def inside(self) -> list[bool]:
        """For each node whether its words are main text."""
        density, sums = self.densities()
        n = len(self.tag)
        heart = max((k for k in range(n) if self.tag[k] not in _NO_CONTAINER), key=lambda k: (sums[k], -k))
        path, at, threshold = set(), heart, density[heart]
        while at >= 0:
            path.add(at)
            threshold = min(threshold, density[at])
            at = self.parent[at]
        largest = list(sums)  # sum within each node's subtree
        for k in range(n - 1, 0, -1):
            largest[self.parent[k]] = max(largest[self.parent[k]], largest[k])
        beside, prose = self.parent[heart], [False] * n
        for k in range(1, n):
            prose[self.parent[k]] = prose[self.parent[k]] or self.tag[k] in _PROSE
        out, within = [False] * n, [False] * n
        out[0] = heart == 0
        for k in range(1, n):
            p, low = self.parent[k], density[k] < threshold
            within[k] = within[p] or self.tag[p] in _ARTICLES
            if k in path:
                out[k] = out[p] or k == heart
                continue
            link_chars, chars, links = self.links[k]
            linked = links > 1 and 2 * link_chars > chars and self.tag[k] not in _INLINE
            # a list of sources or a box with a telling name is the article's own; advertising and comments aren't, nor are boxes of links
            apart = self.hinted[k] and links if within[k] else linked or self.hinted[k]
            if (self.tag[k] == "form" or (low and apart) or (within[k] and self.hinted[k] == 2)) and 2 * chars <= self.links[0][1]:
                out[k] = False
            elif p in path and not out[p]:
                own = p == beside and not links and not self.hinted[k] and (self.tag[k] in _PROSE or prose[k])
                out[k] = not low and threshold > 0 and (own or largest[k] >= threshold)
            else:
                out[k] = out[p]
        return out

    def main_text(self) -> str:
        inside = self.inside()
        blocks, block = [], []
        for node, text in self.items:
            if text is None:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif inside[node]:
                block.append(text)
        blocks.append("".join(block))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_text(source: str | None) -> str:
    """The page's main text, one line per block; empty for null, empty or textless pages."""
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of each page's main text, row for row.

    Null or empty html gives the empty text. Broken markup is read as far as it goes, a page of any
    length as a whole. Nulls in ``keep`` stay; an empty table gives no rows.
    """
    cols = pages.select(F.col(html_col).alias("html"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    schema = T.StructType([*cols.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in texts_of(batch.column(0))]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], schema.names)

    return walk(cols, run, schema, "html").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": query}
SQL: dict[str, str] = {}
