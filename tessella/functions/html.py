"""A small HTML reader in pure Python: tokens, a tree, and simple CSS selectors.

Tokens follow the HTML rules that matter for text: comments, raw text of script and style, character
references, quoted attributes, end of input inside a tag. The tree closes p, li, cells, rows and
options where an opening tag implies it. Formatting elements left open aren't opened again in later
paragraphs.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
#: An opening tag of the key closes an open element among the values, up to the nearest boundary.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "caption"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "a": {"a"},
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "a": {"table", "body"}}
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SKIP = re.compile(r"[\s/]*")
#: All attributes of a tag as most are written, up to its end: names of plain characters, values in double quotes.
_PLAIN = re.compile(r'''((?:\s++[\w:.-]++(?:="[^"]*+")?+)*+)\s*+>''')
_PLAIN_ATTR = re.compile(r'''([\w:.-]+)(?:="([^"]*)")?''')


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    attrs: dict[str, str] = {}
    if m := _PLAIN.match(source, at):
        for name, value in _PLAIN_ATTR.findall(m[1]):
            attrs.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
        return attrs, m.end()
    n = len(source)
    while True:
        at = _SKIP.match(source, at).end()
        if at >= n:
            return attrs, n
        if source[at] == ">":
            return attrs, at + 1
        m = _ATTR.match(source, at)
        if not m:  # a stray "="
            at += 1
            continue
        value = next((g for g in m.groups()[1:] if g is not None), "")
        attrs.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
        at = m.end()


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, None), ("start", name, attributes) and ("end", name, None), in order."""
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if not m:
            break
        if m.start() > at:
            t = source[at : m.start()]
            yield "text", _html.unescape(t) if "&" in t else t, None
        comment, slash, name, _ = m.groups()
        if comment:
            end = source.find("-->", m.end() - 2)
            at = n if end < 0 else end + 3
        elif name:
            name = name.lower()
            if source.startswith(">", m.end()):
                attrs, at = {}, m.end() + 1
            else:
                attrs, at = _attributes(source, m.end())
            if slash:
                yield "end", name, None
                continue
            yield "start", name, attrs
            if name in RAW or name in RCDATA:
                c = _closing(name).search(source, at)
                end = c.start() if c else n
                if end > at:
                    t = source[at:end]
                    yield "text", _html.unescape(t) if name in RCDATA and "&" in t else t, None
                at = end
        else:
            end = source.find(">", m.end())
            at = n if end < 0 else end + 1
    if at < n:
        t = source[at:]
        yield "text", _html.unescape(t) if "&" in t else t, None


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self) -> list[Node]:
        """All elements below, in document order."""
        out, stack = [], [c for c in reversed(self.children) if c.__class__ is not str]
        while stack:
            x = stack.pop()
            out.append(x)
            if x.children:
                stack += [c for c in reversed(x.children) if c.__class__ is not str]
        return out

    def text(self, without: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in without:
                stack.extend(reversed(x.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def copy(self, parent: Node | None = None) -> Node:
        """The element and all below, apart from the original and from what is above it."""
        out = Node(self.tag, dict(self.attrs), parent)
        todo = [(self, out)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                if c.__class__ is not str:
                    twin = Node(c.tag, dict(c.attrs), new)
                    if c.children:
                        todo.append((c, twin))
                    c = twin
                new.children.append(c)
        return out

    def all(self, selector: str) -> list[Node]:
        return _chosen(self.walk(), selector)

    def first(self, selector: str) -> Node | None:
        return _first(self.walk(), selector)


class Document(Node):
    """A tree that doesn't change any more: its elements are listed once, and by name. Copies are plain nodes."""

    __slots__ = ("by_tag", "listed")

    def __init__(self):
        super().__init__("#document")
        self.listed: list[Node] | None = None
        self.by_tag: dict[str, list[Node]] = {}

    def walk(self) -> list[Node]:
        if self.listed is None:
            self.listed = super().walk()
            for x in self.listed:
                self.by_tag.setdefault(x.tag, []).append(x)
        return self.listed

    def _near(self, selector: str) -> list[Node]:
        """Elements among which all matches are, in document order."""
        every, tags = self.walk(), last_tags(selector)
        here = [t for t in tags if t in self.by_tag] if tags is not None else [None, None]
        return every if len(here) > 1 else self.by_tag[here[0]] if here else []

    def all(self, selector: str) -> list[Node]:
        return _chosen(self._near(selector), selector)

    def first(self, selector: str) -> Node | None:
        return _first(self._near(selector), selector)


class Elements(Document):
    """Elements of some names without their tree, for selectors of one part; the order is that of the document."""

    def __init__(self, source: str, names: frozenset[str]):
        super().__init__()
        self.listed = [Node(name, attrs) for kind, name, attrs in tokens(source) if kind == "start" and name in names]
        for x in self.listed:
            self.by_tag.setdefault(x.tag, []).append(x)


def _chosen(nodes: list[Node], selector: str) -> list[Node]:
    match = selector_of(selector)
    return [x for x in nodes if match(x)]


def _first(nodes: list[Node], selector: str) -> Node | None:
    match = selector_of(selector)
    return next((x for x in nodes if match(x)), None)


def parse(source: str) -> Document:
    """The document: html with head and body, whether or not the source has their tags."""
    doc = Document()
    root = Node("html", parent=doc)
    head, body = Node("head", parent=root), Node("body", parent=root)
    doc.children, root.children = [root], [head, body]
    stack, in_body = [root, head], False

    def to_body() -> None:
        nonlocal in_body
        if not in_body:
            in_body = True
            stack[:] = [root, body]

    def close(name: str, stops: set[str] | frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag == name:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    for kind, name, attrs in tokens(source):
        if kind == "text":
            if not in_body and len(stack) == 2:
                if not name.strip():
                    continue
                to_body()
            stack[-1].children.append(name)
        elif kind == "start":
            if name in ("html", "head", "body"):
                where = {"html": root, "head": head, "body": body}[name]
                for k, v in attrs.items():
                    where.attrs.setdefault(k, v)
                if name == "body":
                    to_body()
                continue
            if not in_body and name not in HEAD_ONLY and len(stack) == 2:
                to_body()
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 1, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in ("table", "td", "th", "button", "caption"):
                        break
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if name in CLOSES:
                stops = BOUNDARY.get(name, {"table"})
                for i in range(len(stack) - 1, 1, -1):
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag in CLOSES[name]:
                        del stack[i:]
                        if name in ("a", "li", "dt", "dd"):
                            break
            if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                if stack[-1].tag == "table":
                    stack.append(_add(stack[-1], "tbody", {}))
                stack.append(_add(stack[-1], "tr", {}))
            if name == "tr" and stack[-1].tag == "table":
                stack.append(_add(stack[-1], "tbody", {}))
            node = _add(stack[-1], name, attrs)
            if name not in VOID:
                stack.append(node)
        elif name == "head":
            to_body()
        elif name not in ("html", "body"):
            if name == "p" and not any(x.tag == "p" for x in stack):
                _add(stack[-1], "p", {})
            elif name == "br":
                _add(stack[-1], "br", {})
            elif name in HEADINGS:
                for i in range(len(stack) - 1, 1, -1):
                    if stack[i].tag in HEADINGS:
                        del stack[i:]
                        break
            else:
                close(name, frozenset({"table"}) if name not in ("table", "body") and name in ("p", "li", "a", "b", "i", "em", "strong", "span") else frozenset())
    return doc


def _add(parent: Node, tag: str, attrs: dict[str, str]) -> Node:
    x = Node(tag, attrs, parent)
    parent.children.append(x)
    return x


# Selectors: tag, *, .class, #id, [a], [a=v], [a*=v], [a~=v], [a^=v], [a$=v] with "i", :not(...), descendants, commas.
_PART = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*~^$|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*(i)?\s*)?\]|:not\(([^()]*)\)""")


def _test(op: str, have: str, want: str) -> bool:
    if op == "=":
        return have == want
    if op == "~=":
        return want in have.split()
    return bool(want) and {"*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "|=": have == want or have.startswith(want + "-")}[op]


def _compound(source: str):
    tests, at = [], 0
    while at < len(source):
        m = _PART.match(source, at)
        if not m:
            raise ValueError(f"selector not understood: {source}")
        at = m.end()
        tag, cls, ident, attr, op, v1, v2, v3, fold, no = m.groups()
        if tag:
            if tag != "*":
                tests.append(lambda x, t=tag.lower(): x.tag == t)
        elif cls:
            tests.append(lambda x, c=cls: c in x.attrs.get("class", "").split())
        elif ident:
            tests.append(lambda x, i=ident: x.attrs.get("id") == i)
        elif attr:
            want = next((v for v in (v1, v2, v3) if v is not None), "")
            if op is None:
                tests.append(lambda x, a=attr.lower(): a in x.attrs)
            else:
                tests.append(lambda x, a=attr.lower(), o=op, w=want.lower() if fold else want, f=fold: a in x.attrs and _test(o, x.attrs[a].lower() if f else x.attrs[a], w))
        else:
            inner = selector_of(no)
            tests.append(lambda x, i=inner: not i(x))
    if not tests and source != "*":
        raise ValueError("empty selector")
    if len(tests) == 1:
        return tests[0]
    if len(tests) == 2:
        a, b = tests
        return lambda x: a(x) and b(x)
    return lambda x: all(t(x) for t in tests)


@lru_cache(maxsize=512)
def last_tags(selector: str) -> list[str] | None:
    """Names that elements matched by a selector may have; None for any."""
    tags = selector_of(selector).tags
    return None if None in tags else list(tags)


@lru_cache(maxsize=512)
def selector_of(selector: str):
    """A predicate on nodes; ValueError if the selector isn't understood."""
    chains = []
    for alt in re.split(r",(?![^\[(]*[\])])", selector):
        parts = re.findall(r"""(?:\[[^\]]*\]|:not\([^()]*\)|[^\s\[])+""", alt.strip())
        if not parts or re.sub(r"\s", "", "".join(parts)) != re.sub(r"\s", "", alt):
            raise ValueError(f"selector not understood: {selector}")
        tag = re.match(r"[a-zA-Z][\w-]*", parts[-1])
        chains.append((tag and tag[0].lower(), _compound(parts[-1]), [_compound(p) for p in reversed(parts[:-1])]))
    by_tag: dict = {tag: [c[1:] for c in chains if c[0] in (tag, None)] for tag in {c[0] for c in chains}}
    anywhere = by_tag.get(None, ())

    def match(x: Node) -> bool:
        for last, above in by_tag.get(x.tag, anywhere):
            if last(x):
                k, up = 0, x.parent
                while k < len(above) and up is not None:
                    if above[k](up):
                        k += 1
                    up = up.parent
                if k == len(above):
                    return True
        return False

    match.tags = frozenset(by_tag)
    return match
