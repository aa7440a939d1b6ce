"""A small HTML helper for the structural extraction rules (runs inside tasks).

Builds a light element tree with the rules of the stdlib parser (void elements, implicit
``</p>`` before a block element): plain tags and text are cut by one regular expression, and from the first
markup of another form on the stdlib parser itself reads the page. All selectors of a job are compiled once into one ``Matcher``, which finds
the elements of every selector in a single walk over a page. It reads what rule lists are
written in: comma lists, descendant, ``>``, ``+`` and ``~`` combinators, tag and ``.class`` and ``#id``, the attribute
forms ``[a]`` ``[a=v]`` ``[a*=v]`` ``[a^=v]`` ``[a$=v]`` ``[a~=v]`` ``[a|=v]``, ``:first-child``, ``:last-child``, ``:not(...)``, and
``:has(...)`` on the element that is selected. Anything else raises when it is compiled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr", "image", "use", "path"}
BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
         "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p",
         "pre", "section", "table", "ul"}
SKIP_TEXT = {"script", "style", "template", "noscript"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "source", "order", "start", "end", "steps", "inside", "below",
                 "before", "earlier")

    def __init__(self, tag, attrs, parent, source=None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.source = source  # the tag as it is written: equal tags fit the same conditions
        # set by the walk: elements of the subtree are start <= n < end

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def iter(self):
        """Descendant elements in document order (iterative: deep pages are fine)."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, sep=" "):
        """The texts below, each stripped, without blank ones."""
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                c = c.strip()
                if c:
                    out.append(c)
            elif c.tag not in SKIP_TEXT:
                stack += c.children[::-1]
        return sep.join(out)


#: Elements whose content the stdlib parser reads in a way of its own (which, depends on its version).
_OTHER = sorted({*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext",
                 "script", "style"})
_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTES = (r"""(?:%s+[A-Za-z_:@][\w.:@-]*(?:="[^"]*"|='[^']*'|=[\w.,:;%%#?&/+~@!*()$-]+(?=[ \t\n\r\f>]))?)*%s*"""
               % (_SPACE, _SPACE))
#: Plain tokens, which all versions of the stdlib parser read the same way: text, an end tag, a start tag whose attributes
#: stand apart and are quoted or simple words, a script or style, a comment, a doctype; else the rest of the page.
_PLAIN = re.compile(rf"""([^<]+)|</([A-Za-z][A-Za-z0-9]*)>
    |(<(?!(?i:{"|".join(_OTHER)})[\s/>])[A-Za-z][A-Za-z0-9:-]*{_ATTRIBUTES}/?>)
    |(<(script|style){_ATTRIBUTES}>)([^<]*(?:<(?!/\s*(?i:\5)|!--)[^<]*)*)</(?i:\5)>
    |<!--[^<>-]*-->|<![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^<>\[]*>|(<[\s\S]*)""".replace("\n    ", ""), re.A)
_TAG = re.compile(rf"<([A-Za-z][A-Za-z0-9:-]*)({_ATTRIBUTES})(/?)>", re.A)
_PAIRS = re.compile(r"""([^ \t\n\r\f=]+)(?:="([^"]*)"|='([^']*)'|=([^ \t\n\r\f]+))?""")
#: Tags that a builder remembers, and the longest one.
TAGS, TAG_CHARS = 4096, 200


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root
        self.order = self.root.order = []  # its elements in document order

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def read(self, page: str, tags: dict) -> None:
        """The plain beginning of a page (mostly all of it) by ``_PLAIN``, the rest by the stdlib parser."""
        root, order = self.root, self.order
        for text, end, source, script, name, body, rest in _PLAIN.findall(page):
            if text:
                self.cur.children.append(unescape(text) if "&" in text else text)
            elif source:
                tag, attrs, block, empty = tags.get(source) or self.tag(source, tags)
                if block:
                    self.close_paragraph()
                cur = self.cur
                node = Node(tag, attrs, cur, source)
                cur.children.append(node)
                order.append(node)
                if not empty:
                    self.cur = node
            elif end:
                cur = self.cur
                if cur.tag == end and cur is not root:
                    self.cur = cur.parent
                else:
                    self.handle_endtag(end.lower())
            elif script:
                tag, attrs, _, _ = tags.get(script) or self.tag(script, tags)
                self.add(tag, attrs, script, False)
                if body:
                    self.cur.children.append(body)
                self.handle_endtag(tag)
            elif rest:
                self.feed(rest)
        self.close()

    @staticmethod
    def tag(source, tags) -> tuple:
        """(name, attributes, whether it is a block that closes a paragraph, whether nothing stands in it)."""
        m = _TAG.match(source)
        tag = m[1].lower()
        attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in _PAIRS.findall(m[2])}
        known = tag, attrs, tag in BLOCK and not m[3], bool(m[3]) or tag in VOID
        if len(source) <= TAG_CHARS:
            if len(tags) >= TAGS:
                tags.clear()
            tags[source] = known
        return known

    def close_paragraph(self):
        n = self.cur
        while n is not self.root:
            if n.tag == "p":
                self.cur = n.parent
                break
            if n.tag in BLOCK:
                break
            n = n.parent

    def add(self, tag, attrs, source, empty):
        if tag in BLOCK and not empty:
            self.close_paragraph()
        node = Node(tag, attrs, self.cur, source)
        self.cur.children.append(node)
        self.order.append(node)
        if tag not in VOID and not empty:
            self.cur = node

    def handle_starttag(self, tag, attrs):
        self.add(tag, {k: (v or "") for k, v in attrs}, None, False)

    def handle_startendtag(self, tag, attrs):
        self.add(tag, {k: (v or "") for k, v in attrs}, None, True)

    def handle_endtag(self, tag):
        if tag not in VOID:
            n = self.cur
            while n is not None and n.tag != tag:
                n = n.parent
            if n is not None and n is not self.root:
                self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str, tags: dict | None = None) -> Node:
    """The tree of a page. ``tags`` keeps what tags hold from one page to the next."""
    b = _Builder()
    b.read(html or "", {} if tags is None else tags)
    return b.root


def release(root: Node) -> None:
    """Undo a tree that is no longer needed: without the way up it is freed at once, not searched for by the collector."""
    for node in root.order:
        node.parent = None


# ---------------------------------------------------------------- selectors
_TOKEN = re.compile(r"""\s*(?P<comma>,)\s* | \s*(?P<combinator>[>+~])\s* | (?P<descend>\s+)
    | (?P<tag>\*|[A-Za-z][A-Za-z0-9-]*) | \.(?P<class>[\w-]+) | \#(?P<id>[\w-]+)
    | \[\s*(?P<attr>[\w:.-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s"'\]]+))\s*)?\]
    | :(?P<pseudo>[a-z-]+)(?P<open>\()?""", re.X)


@dataclass
class Compound:
    """Conditions on one element. ``has`` holds numbers of selectors of which some element must (not) lie inside."""
    tag: str | None = None
    tests: list = field(default_factory=list)
    needs: set[str] = field(default_factory=set)  # attributes that the tests ask for
    has: list[tuple[int, bool]] = field(default_factory=list)
    combinator: str = ""
    placed: bool = False  # a test asks for the element's place among its siblings

    def holds(self, node: Node, first: bool, last: bool) -> bool:
        for _, t in self.tests:
            if not t(node, first, last):
                return False
        return True


def _attribute(name: str, op: str | None, value: str):
    """(what is asked, the test)"""
    name = name.lower()
    got = lambda n: n.attrs.get(name)
    if op is None:
        test = lambda n, *_: name in n.attrs
    elif op == "=":
        test = lambda n, *_: got(n) == value
    elif not value:
        test = lambda n, *_: False  # an empty part matches nothing
    else:
        test = {"*=": lambda n, first, last: value in n.attrs.get(name, ""),
                "^=": lambda n, *_: (got(n) or "").startswith(value),
                "$=": lambda n, *_: (got(n) or "").endswith(value), "~=": lambda n, *_: value in (got(n) or "").split(),
                "|=": lambda n, *_: got(n) == value or (got(n) or "").startswith(value + "-")}[op]
    return (name, op, value), test


class Matcher:
    """Selectors compiled together. Each selector is a chain of steps; a step's bit is set for an element
    that fits the chain so far, so the bits of ancestors and siblings tell which steps may come next."""

    def __init__(self):
        self.steps: list[Compound] = []
        self.finals: list[tuple[int, list[tuple[int, bool]]]] = []  # (bit, has) of every selector
        self.last_bit: dict[int, int] = {}  # the number of the selector whose last step it is
        self.all_finals = 0
        self.known: dict[str, list[int]] = {}
        self.starts = self.descend = self.child = self.adjacent = self.sibling = 0
        self.by_tag: dict[str, int] = {}
        self.any_tag = 0
        self.by_form: dict[tuple, int] = {}  # steps open to an element of this tag and these attributes
        self.by_source: dict[str, tuple[int, int]] = {}  # what ``_fits`` tells of a tag

    def add(self, text: str) -> list[int]:
        """Numbers of the selectors of a comma list."""
        if text not in self.known:
            chains, end = self._parse(text, 0, False)
            if end != len(text):
                raise ValueError(f"unsupported selector {text!r}")
            self.known[text] = [self._chain(c, text) for c in chains]
        return self.known[text]

    def _chain(self, chain: list[Compound], text: str) -> int:
        for i, compound in enumerate(chain):
            if compound.has and i < len(chain) - 1:
                raise ValueError(f"unsupported selector {text!r}: :has() before the element selected")
            bit = 1 << len(self.steps)
            self.steps.append(compound)
            self.by_form.clear()
            self.by_source.clear()
            if not i:
                self.starts |= bit
            else:
                name = {" ": "descend", ">": "child", "+": "adjacent", "~": "sibling"}[compound.combinator]
                setattr(self, name, getattr(self, name) | bit)
            if compound.tag is None:
                self.any_tag |= bit
            else:
                self.by_tag[compound.tag] = self.by_tag.get(compound.tag, 0) | bit
        self.finals.append((bit, chain[-1].has))
        self.last_bit[bit] = len(self.finals) - 1
        self.all_finals |= bit
        return len(self.finals) - 1

    def _parse(self, text: str, at: int, inner: bool) -> tuple[list[list[Compound]], int]:
        """Chains of a comma list from ``at``, up to the end or (``inner``) a closing bracket."""
        bad = ValueError(f"unsupported selector {text!r}")
        chains: list[list[Compound]] = [[]]
        now, combinator = None, ""
        while at < len(text) and not (inner and text[at] == ")"):
            m = _TOKEN.match(text, at)
            if not m:
                raise bad
            at = m.end()
            if m["comma"] or m["combinator"] or m["descend"]:
                rest = text[at:at + 1]
                if m["descend"] and (now is None or not rest or rest == ")"):
                    continue  # space around a selector
                if now is None:
                    raise bad
                chains[-1].append(now)
                now, combinator = None, m["combinator"] or " "
                if m["comma"]:
                    chains.append([])
                    combinator = ""
                continue
            if now is None:
                now = Compound(combinator=combinator)
            elif m["tag"]:
                raise bad
            if m["tag"]:
                now.tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["class"]:
                now.needs.add("class")
                now.tests.append(_attribute("class", "~=", m["class"]))
            elif m["id"]:
                now.needs.add("id")
                now.tests.append(_attribute("id", "=", m["id"]))
            elif m["attr"]:
                now.needs.add(m["attr"].lower())
                now.tests.append(_attribute(m["attr"], m["op"], next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")))
            else:
                at = self._pseudo(m, text, at, now, bad)
        if now is None:
            raise bad
        chains[-1].append(now)
        return chains, at

    def _pseudo(self, m: re.Match, text: str, at: int, now: Compound, bad: ValueError) -> int:
        name = m["pseudo"]
        if not m["open"]:
            if name not in ("first-child", "last-child"):
                raise bad
            now.placed = True
            now.tests.append((name, (lambda n, first, last: first) if name == "first-child" else (lambda n, first, last: last)))
            return at
        if name not in ("not", "has"):
            raise bad
        chains, at = self._parse(text, at, True)
        if text[at:at + 1] != ")":
            raise bad
        if name == "has":
            if [len(c) for c in chains] != [1]:
                raise bad
            now.has.append((self._chain(chains[0], text), True))
            return at + 1
        for chain in chains:  # not(a, b) is not(a) and not(b)
            if len(chain) > 1:
                raise bad
            inside, = chain
            if inside.has:
                if inside.tag or inside.tests or len(inside.has) > 1:
                    raise bad
                now.has.append((inside.has[0][0], not inside.has[0][1]))
            else:
                now.placed |= inside.placed
                now.tests.append((object(), lambda n, first, last, c=inside: not (
                    (c.tag is None or n.tag == c.tag) and c.holds(n, first, last))))
        return at + 1

    def _open(self, form: tuple) -> tuple[int, int, list]:
        """Of the steps whose tag and attributes ``form`` (a tag and attribute names) has: those that ask for no place among
        siblings, those that do, and what the former ask for, each with the steps that do. Pages have few forms."""
        if form not in self.by_form:
            if len(self.by_form) >= 10_000:
                self.by_form.clear()
            may = self.any_tag | self.by_tag.get(form[0], 0)
            sure, placed, asked = 0, 0, {}
            for i, step in enumerate(self.steps):
                if not may >> i & 1 or not step.needs.issubset(form[1:]):
                    continue
                if step.placed:
                    placed |= 1 << i
                    continue
                sure |= 1 << i
                for key, test in step.tests:
                    asked[key] = test, asked.get(key, (test, 0))[1] | 1 << i
            self.by_form[form] = sure, placed, list(asked.values())
        return self.by_form[form]

    def _fits(self, node: Node) -> tuple[int, int]:
        """Steps that the tag and its attributes meet, and the ones that also ask for its place."""
        sure, placed, asked = self._open((node.tag, *node.attrs))
        for test, steps in asked:
            if sure & steps and not test(node, False, False):
                sure &= ~steps
        known = sure, placed
        if node.source is not None and len(node.source) <= TAG_CHARS:
            if len(self.by_source) >= TAGS:
                self.by_source.clear()
            self.by_source[node.source] = known
        return known

    def walk(self, root: Node) -> "Found":
        """One walk over a page: the elements that each selector matches, in document order."""
        hits: list[list[Node]] = [[] for _ in self.finals]
        last_bit, finals = self.last_bit, self.all_finals
        starts, descend, child = self.starts, self.descend, self.child
        adjacent, sibling, by_source = self.adjacent, self.sibling, self.by_source
        order = root.order
        # of an element: its steps, those of it and its ancestors, the steps that may come below it, those of its last
        # child so far, and of all its children so far (None: there is none)
        root.steps = root.inside = root.end = 0
        root.below, root.before, root.earlier = starts, 0, None
        for count, node in enumerate(order):
            node.start = count
            parent = node.parent
            may, first = parent.below, parent.earlier is None
            if not first:
                may |= ((parent.before << 1) & adjacent) | ((parent.earlier << 1) & sibling)
            sure, placed = by_source.get(node.source) or self._fits(node)
            steps = may & sure
            may &= placed
            if may:
                last = next(c for c in reversed(parent.children) if isinstance(c, Node)) is node
                while may:
                    bit = may & -may
                    may ^= bit
                    if self.steps[bit.bit_length() - 1].holds(node, first, last):
                        steps |= bit
            parent.before, parent.earlier = steps, steps if first else parent.earlier | steps
            inside = parent.inside
            if steps:
                done = steps & finals
                while done:
                    bit = done & -done
                    done ^= bit
                    hits[last_bit[bit]].append(node)
                inside |= steps
            node.steps, node.inside = steps, inside
            node.below = starts | ((inside << 1) & descend) | ((steps << 1) & child) if inside else starts
            node.before, node.earlier, node.end = 0, None, count + 1
        for node in reversed(order):  # every element of a subtree comes after its root
            if node.end > node.parent.end:
                node.parent.end = node.end
        root.start, root.end = -1, len(order)
        found = Found(hits)
        for i, (_, has) in enumerate(self.finals):  # inner selectors stand before the ones they are part of
            if has:
                found.set(i, [n for n in hits[i] if all((found.first([k], n) is not None) == wanted for k, wanted in has)])
        return found


class Found:
    """Elements by selector, of a page or of the part inside an element."""

    def __init__(self, hits: list[list[Node]]):
        self.hits = hits
        self.at = [[n.start for n in h] for h in hits]
        self.merged: dict[tuple, tuple[list[int], list[Node]]] = {}  # places and elements of several selectors together

    def set(self, i: int, nodes: list[Node]) -> None:
        self.hits[i], self.at[i] = nodes, [n.start for n in nodes]
        self.merged.clear()

    def of(self, selectors: list[int]) -> tuple[list[int], list[Node]]:
        """Places and elements that one of the selectors matches, in document order."""
        key = tuple(selectors)
        if key not in self.merged:
            if len(key) == 1:
                self.merged[key] = self.at[key[0]], self.hits[key[0]]
            else:
                nodes = sorted({n.start: n for s in key for n in self.hits[s]}.items())
                self.merged[key] = [at for at, _ in nodes], [n for _, n in nodes]
        return self.merged[key]

    def first(self, selectors: list[int], inside: Node) -> Node | None:
        """The first element in ``inside`` (itself left out) that one of the selectors matches."""
        return first_inside(*self.of(selectors), inside)

    def every(self, selectors: list[int], inside: Node) -> list[Node]:
        """All of them, once each, in document order."""
        out = {}
        for s in selectors:
            for n in self.hits[s][bisect_left(self.at[s], inside.start + 1):bisect_left(self.at[s], inside.end)]:
                out[n.start] = n
        return [out[k] for k in sorted(out)]


def first_inside(at: list[int], nodes: list[Node], inside: Node) -> Node | None:
    i = bisect_left(at, inside.start + 1)
    return nodes[i] if i < len(at) and at[i] < inside.end else None


def has_button(n: Node) -> bool:
    stack = [n]
    while stack:
        for c in stack.pop().children:
            if not isinstance(c, str):
                if c.tag == "button" or c.attrs.get("role") == "button":
                    return True
                stack.append(c)
    return False
