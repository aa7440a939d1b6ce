"""Main text of web pages by tree scoring.

A tolerant reader turns HTML into a tree. Each paragraph earns points for its length and its
commas, discounted by the share of its text inside links, and passes them to its ancestors: all
to the container it stands in, half to the next, less further up. The container of the largest score (again
discounted by link density) is the article, together with siblings that score or read like it;
inside an ``article`` element (else a main part of few links) it is that element. Menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, hidden parts and reader comments are left out by element, role
and class or id words; a form or sidebar around nearly all paragraphs of a page without an article is none. Of
an article's own header the headings and full sentences stay. Words alone leave out nothing that holds the article or most of the page's
paragraph points, and inside an article nothing that reads as prose, unless it also looks like a menu (links),
a form or comments (repeated items).

Results: one row per page. Blocks of the article in page order, character references decoded, white
space inside a block made one space, trimmed, empty blocks dropped, joined by one line feed. A null or
empty page, and one without text, has an empty text. Broken and cut-off markup is read as far
as it goes. Pages of any length and depth are read whole, without recursion. Repeated
rows are read each. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import prepared

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)
      |<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
      |<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)
      |<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.X)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, or no text of the page.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark "
                   "optgroup option q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr".split())
#: Blocks that stand inside a container; they pass their points on to it.
INNER = frozenset("p li ul ol dl dt dd table thead tbody tfoot tr td th blockquote pre h1 h2 h3 h4 h5 h6 figure "
                  "figcaption caption address hr center summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the key closes an open one of these, unless a ``_WALL`` stands between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
_WALL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "tbody": {"table"}}

DROPPED = frozenset("head nav footer aside form fieldset button select dialog menu option".split())
#: Of these, what may stand around a whole page: kept where nearly all paragraphs stand inside and no article does.
WRAPPERS = frozenset("form fieldset aside dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                  "toolbar tablist note".split())
#: Words of a class or id that name what is no article; a word that begins with one counts.
JUNK = ("nav", "menu", "sidebar", "footer", "advert", "sponsor", "promo", "cookie", "consent", "gdpr", "notice",
        "notification", "popup", "modal", "overlay", "newsletter", "subscri", "share", "sharing", "social", "related",
        "recommend", "breadcrumb", "pagination", "pager", "toolbar", "widget", "login", "signup", "search", "masthead",
        "banner", "skip", "hidden", "alert", "toast", "teaser", "outbrain", "taboola", "paywall", "topbar", "tracking")
JUNK_WORDS = frozenset("ad ads adv aside rail dfp promo sr".split())
TALK = ("comment", "disqus", "respond", "reply", "replies", "discussion", "reviews")
#: What is named by nothing else holds readers' comments.
TALK_WORDS = frozenset("comment comments disqus replies".split())
HEAD_WORDS = ("header", "masthead")
GOOD = ("article", "content", "entry", "main", "post", "story", "body", "text")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


_ENDING = ".!?…\"”)"


def _sentence(text: str) -> bool:
    return len(text) >= 60 and text[-1] in _ENDING


@dataclass
class Page:
    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # (block, node, text)


def parse(source: str) -> Page:
    page, stack, block, at, n = Page(), [0], 0, 0, len(source)
    open_: dict[str, int] = {}  # tag -> how many are open
    unclosed: set[str] = set()

    def pop() -> None:
        nonlocal block
        tag = page.tags[stack.pop()]
        open_[tag] -= 1
        if tag not in INLINE:
            block += 1

    while at < n:
        m = _TOKEN.match(source, at)
        if not m:
            break
        at = m.end()
        kind = m.lastgroup
        text = m["text"] or m["cdata"]
        if text:
            page.texts.append((block, stack[-1], text))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            if open_.get(tag):
                while page.tags[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if kind == "attrs2" and not source[at - 1:at] == ">":
            break  # the page ends inside a tag
        if tag not in INLINE and tag not in RAW and open_.get("p"):
            while page.tags[stack[-1]] in INLINE or page.tags[stack[-1]] == "p":
                pop()  # a block ends the paragraph before it
        for other in _ENDS.get(tag, ()):
            if open_.get(other):
                walls = _WALL.get(tag, ())
                depth = len(stack) - 1
                while depth and page.tags[stack[depth]] not in walls and page.tags[stack[depth]] != other:
                    depth -= 1
                if depth and page.tags[stack[depth]] == other:
                    while len(stack) > depth:
                        pop()
        if tag == "br":
            page.texts.append((block, stack[-1], " "))
        if tag not in INLINE and tag not in RAW:
            block += 1
        if tag in VOID:
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if tag in RAW:
            if attrs.rstrip().endswith("/") and tag in ("svg", "iframe", "object"):
                continue
            end = None if tag in unclosed else re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            if end is None:
                unclosed.add(tag)  # nor is there one further on
                if tag in ("script", "style", "textarea", "title"):
                    break
                continue
            close = source.find(">", end.start())
            at = n if close < 0 else close + 1
            continue
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.attrs.append(attrs)
        stack.append(len(page.tags) - 1)
        open_[tag] = open_.get(tag, 0) + 1
    return page


def _named(attrs: str) -> tuple[dict[str, str], list[str]]:
    """Attributes, and the words of class and id."""
    if not attrs.strip():
        return {}, []
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
    words = [w.lower() for k in ("class", "id", "itemprop") for w in _WORDS.findall(found.get(k, ""))]
    return found, words


class _Told:
    """What the subtrees of a page hold, read when first asked for: whether words alone may leave one out."""

    def __init__(self, page: Page, named: list[tuple[dict[str, str], list[str]]], link: list[bool]) -> None:
        self.page, self.named, self.link, self.read = page, named, link, False

    def _read(self) -> None:
        page, named = self.page, self.named
        tags, parents, n = page.tags, page.parents, len(page.tags)
        self.read = True
        out, talk, hard = [False] * n, [0] * n, [False] * n  # ``hard``: out whatever it wraps
        self.whole = [0.0] * n
        self.points, self.size, self.linked, self.prose = [0.0] * n, [0] * n, [0] * n, [0] * n
        self.forms, self.talks, self.articles = [0] * n, [0] * n, []
        for i in range(1, n):
            given, words = named[i]
            says = any(w.startswith(TALK) for w in words)
            hides = tags[i] in DROPPED and tags[i] not in WRAPPERS or "hidden" in given or \
                given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ROLES or \
                "display:none" in given.get("style", "").lower().replace(" ", "")
            hard[i] = hard[parents[i]] or hides
            out[i] = out[parents[i]] or hides or tags[i] in WRAPPERS
            talk[i] = talk[parents[i]] + says
            self.forms[i] += tags[i] == "form"
            self.talks[i] += says or tags[i] == "article"
            if not out[i] and (tags[i] in ("article", "main") or given.get("role") in ("main", "article")):
                self.articles.append(i)
        at, texts = 0, [(b, i, t) for b, i, t in page.texts if not hard[i]]
        while at < len(texts):
            to, whole, inside = at, 0, 0
            while to < len(texts) and texts[to][0] == texts[at][0]:
                to += 1
            text = " ".join("".join(t for _, _, t in texts[at:to]).split())
            for _, i, t in texts[at:to]:
                whole += len(t.strip())
                inside += len(t.strip()) * self.link[i]
            i = texts[at][1]
            at = to
            if not text:
                continue
            if out[i]:
                self.whole[i] += (1 + min(len(text) / 100, 3)) * (1 - inside / max(whole, 1))
                continue
            self.size[i] += whole
            self.linked[i] += inside
            share = inside / max(whole, 1)
            block = i
            while tags[block] in INLINE:
                block = parents[block]
            if tags[block] not in HEADINGS:
                self.points[i] += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - share)
                self.whole[i] += (1 + min(len(text) / 100, 3)) * (1 - share)
                if share < 0.5 and (len(text) >= 60 or len(text) >= 20 and text[-1] in _ENDING):
                    self.prose[i] += len(text)
        for i in range(n - 1, 0, -1):
            for sums in (self.points, self.whole, self.size, self.linked, self.prose, self.forms, self.talks):
                sums[parents[i]] += sums[i]
        # parts named after an article that hold paragraphs: in each subtree, around it, and what the outermost holds
        self.good, self.around, self.outer = [0] * n, [0] * n, [0.0] * n
        for i in range(1, n):
            p = parents[i]
            self.good[i] = int(self.points[i] >= 2 and not out[i] and not talk[i] and tags[i] not in ("html", "body")
                               and any(w.startswith(GOOD) for w in named[i][1]) and not self._junk(i))
            self.around[i] = self.around[p] + self.good[p]
            self.outer[i] = self.outer[p] or self.good[p] * self.points[p]
        for i in range(n - 1, 0, -1):
            self.good[parents[i]] += self.good[i]
        # the article: the largest of those in the fewest parts that are named after talk
        self.article = min(self.articles, key=lambda i: (talk[i], -self.points[i]), default=-1)
        self.above = set()
        i = self.article
        while i > 0:
            self.above.add(i)
            i = parents[i]

    def wraps(self, i: int) -> bool:
        """``i`` stands around the page: no article anywhere, and next to nothing outside it."""
        if self.page.tags[i] not in WRAPPERS:
            return False
        if not self.read:
            self._read()
        return self.article < 0 and self.whole[i] >= 2.5 and self.whole[i] > 0.85 * self.whole[0]

    def _junk(self, i: int) -> bool:
        return any(w in JUNK_WORDS or w.startswith(JUNK) for w in self.named[i][1])

    def _only_talk(self, i: int) -> bool:
        words = self.named[i][1]
        return bool(words) and all(w in TALK_WORDS for w in words)

    def _most(self, i: int) -> bool:
        return self.points[i] > self.points[0] / 2

    def holds_article(self, i: int) -> bool:
        """``i`` is or holds the article, though it is named after talk."""
        if not self.read:
            self._read()
        return i in self.above and not (self._only_talk(i) and not self._most(i))

    def kept(self, i: int, in_article: bool) -> bool:
        """Words speak against ``i``, its content for it."""
        if not self.read:
            self._read()
        given, words = self.named[i]
        if in_article:
            if self._only_talk(i) or any(w in JUNK_WORDS for w in words) or self.forms[i]:
                return False
            own = any(w.startswith(TALK) for w in words) or self.page.tags[i] == "article"
            return self.prose[i] > 0 and self.linked[i] <= self.size[i] / 2 and self.talks[i] - own < 2
        if self.article > 0 or not self._most(i):
            return False
        if not any(w.startswith(TALK) for w in words):
            return True
        # comments may be longer than what they are about, where there is such a thing
        return self.good[0] - self.good[i] <= self.around[i] and self.outer[i] - self.points[i] < 2


def main_text(source: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not source:
        return ""
    page = parse(source)
    tags, parents, n = page.tags, page.parents, len(page.tags)
    named = [_named(a) for a in page.attrs]
    article = [False] * n  # holds an article or the main part
    for i in range(n - 1, 0, -1):
        article[i] |= tags[i] in ("article", "main") or named[i][0].get("role") in ("main", "article")
        article[parents[i]] |= article[i]
    in_article = [False] * n
    link = [False] * n
    for i in range(1, n):
        link[i] = tags[i] == "a" or link[parents[i]]
    told = _Told(page, named, link)
    gone, headings = [False] * n, [False] * n
    for i in range(1, n):
        p = parents[i]
        in_article[i] = in_article[p] or tags[i] in ("article", "main") or named[i][0].get("role") in ("main", "article")
        gone[i], headings[i] = gone[p], headings[p]
        if gone[i]:
            continue
        given, words = named[i]
        talk = any(w.startswith(TALK) for w in words)
        named_head = any(w.startswith(HEAD_WORDS) for w in words) and tags[i] not in HEADINGS
        if tags[i] in DROPPED or "hidden" in given or given.get("aria-hidden", "").lower() == "true" \
                or "display:none" in given.get("style", "").lower().replace(" ", ""):
            gone[i] = not (article[i] and tags[i] not in ("head", "nav", "footer") or told.wraps(i))
        elif tags[i] in ("html", "body", "main") or article[i] and (not talk or told.holds_article(i)):
            pass
        elif tags[i] == "header" or named_head and not told.kept(i, in_article[p]):
            gone[i], headings[i] = not in_article[i], True
        elif given.get("role", "").lower() in ROLES:
            gone[i] = True
        elif (talk or tags[i] not in HEADINGS and any(w in JUNK_WORDS or w.startswith(JUNK) for w in words) and not (
                words[:1] in (["no"], ["has"], ["with"]))) and not told.kept(i, in_article[p]):
            gone[i] = True
        if headings[i] and tags[i] in HEADINGS:
            headings[i] = False  # of an article's own header its headings stay

    # paragraphs
    blocks: list[tuple[list[int], str]] = []
    length, linked, score = [0] * n, [0] * n, [0.0] * n
    at = 0
    texts = [(b, i, t) for b, i, t in page.texts if not gone[i]]
    while at < len(texts):
        to = at
        while to < len(texts) and texts[to][0] == texts[at][0]:
            to += 1
        parts = [(i, html.unescape(t)) for _, i, t in texts[at:to]]
        at = to
        text = " ".join("".join(t for _, t in parts).split())
        if not text:
            continue
        if any(headings[i] for i, _ in parts) and not _sentence(text):
            continue  # of an article's own header: bylines, dates, labels
        inside = 0
        for i, t in parts:
            size = len(t.strip())
            inside += size * link[i]
            length[i] += size
            linked[i] += size * link[i]
        holder = next(i for i, t in parts if t.strip())
        blocks.append(([i for i, t in parts if t.strip()], text))
        while tags[holder] in INLINE:
            holder = parents[holder]
        share = min(inside / len(text), 1)
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - share)
        if tags[holder] in HEADINGS:
            points = 0
        level = 0
        while holder > 0:
            if tags[holder] not in INNER:
                score[holder] += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
                level += 1
            holder = parents[holder]
        if level == 0:
            score[0] += points
    if not blocks:
        return ""
    for i in range(n - 1, 0, -1):
        length[parents[i]] += length[i]
        linked[parents[i]] += linked[i]
    density = [b / a if a else 0.0 for a, b in zip(length, linked)]
    for i in range(1, n):
        if score[i] > 0:
            score[i] = score[i] * (1 - density[i]) + 25 * (
                tags[i] in ("article", "main") or any(w.startswith(GOOD) for w in named[i][1]))
    best = max(range(n), key=lambda i: score[i])
    def around(fits) -> int:
        up = best
        while up > 0 and not fits(up):
            up = parents[up]
        return up

    up = around(lambda i: tags[i] == "article") or around(
        lambda i: in_article[i] and not in_article[parents[i]] and density[i] < 0.3)
    chosen = {up or best}
    if not up and best > 0:  # no article element: siblings that belong to it
        least = 0.2 * score[best]
        for i in range(1, n):
            if parents[i] == parents[best] and i != best and not gone[i]:
                if score[i] >= least or tags[i] in HEADINGS or tags[i] == "p" and density[i] < 0.25:
                    chosen.add(i)
    inside_ = [False] * n
    for i in range(n):
        inside_[i] = i in chosen or i > 0 and inside_[parents[i]]
    items = [int(t in ("li", "dt", "dd")) for t in tags]
    for i in range(n - 1, 0, -1):
        items[parents[i]] += items[i]
    menus = [False] * n  # lists of links inside the article
    for i in range(1, n):
        menus[i] = menus[parents[i]] or tags[i] in ("ul", "ol", "dl") and density[i] > 0.8 \
            and length[i] < 40 * items[i]  # links of a line each are references
    return "\n".join(text for nodes, text in blocks if inside_[nodes[0]] and not menus[nodes[0]])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    prepared(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"),
                                              pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
