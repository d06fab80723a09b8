"""A small HTML tree on the standard library, with the selectors that pages of results need.

Selectors: tag, .class, [attr], [attr*='part'], compounds of these, descendant (space) and child (>).

A page is cut at ``<`` and its tags are looked up by their text, since pages of one kind repeat them; only what is plain
markup is read so. A page with anything else goes through ``html.parser`` as a whole, which gives the same tree.
Elements are numbers in document order: those below an element follow it without a gap, and so do its texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open element of the named kinds, inside the nearest of the limits.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "p": ({"p"}, {"div", "td", "li", "body"})}
_HIDDEN = frozenset(("script", "style"))
#: Elements whose content versions of html.parser do not read as markup.
_RAW = _HIDDEN | frozenset("iframe noembed noframes noscript plaintext textarea title xmp".split())


class _Tag:
    """A start tag: what an element is, apart from its place."""

    __slots__ = ("tag", "attrs", "classes", "keys", "leaf", "bare", "raw", "closes")

    def __init__(self, tag: str, attrs: dict[str, str], bare: bool = False):
        self.tag, self.attrs, self.bare, self.raw = tag, attrs, bare, tag in _RAW
        self.classes = frozenset(attrs.get("class", "").split())
        self.keys = frozenset([tag, *[f".{c}" for c in self.classes], *[f"[{a}" for a in attrs]])
        #: nothing goes into a void element or one that ends itself (bare), which ends no other either
        self.leaf, self.closes = bare or tag in _VOID, None if bare else _CLOSES.get(tag)


class _Tree:
    __slots__ = ("tags", "parents", "ends", "first_text", "last_text", "texts", "owners", "hidden", "keyed", "found", "at")

    def __init__(self):
        self.tags, self.parents, self.ends, self.first_text, self.last_text = [], [], [], [], []
        self.texts, self.owners, self.hidden = [], [], set()
        self.keyed: dict[str, list[int]] = {}
        self.found: dict[str, list[int]] = {}
        self.at = -1  # the page

    def up_to(self, above: int) -> None:
        """Ends the open elements below ``above``."""
        x, end, text = self.at, len(self.tags), len(self.texts)
        while x != above:
            self.ends[x], self.last_text[x] = end, text
            x = self.parents[x]
        self.at = above

    def start(self, tag: _Tag) -> None:
        if tag.closes is not None:
            ends, limits = tag.closes
            x, above = self.at, None
            while x >= 0 and (name := self.tags[x].tag) not in limits:
                if name in ends:
                    above = self.parents[x]
                    if tag.tag != "tr":
                        break
                x = self.parents[x]
            if above is not None:
                self.up_to(above)
        k, text = len(self.tags), len(self.texts)
        self.tags.append(tag)
        self.parents.append(self.at)
        self.ends.append(k + 1)
        self.first_text.append(text)
        self.last_text.append(text)
        if not tag.leaf:
            self.at = k

    def end(self, name: str) -> None:
        x = self.at
        while x >= 0 and self.tags[x].tag != name:
            x = self.parents[x]
        if x >= 0:
            self.up_to(self.parents[x])

    def data(self, text: str) -> None:
        if self.at >= 0 and self.tags[self.at].tag in _HIDDEN:
            self.hidden.add(len(self.texts))
        self.texts.append(text)
        self.owners.append(self.at)

    def done(self) -> _Tree:
        """Ends what is open, and lists elements by tag, class and attribute."""
        self.up_to(-1)
        keyed = self.keyed
        for k, tag in enumerate(self.tags):
            for key in tag.keys:
                if key in keyed:
                    keyed[key].append(k)
                else:
                    keyed[key] = [k]
        return self

    def matching(self, selector: str, root: int) -> list[int]:
        """Elements of the page that the selector means below root, in document order. It is looked for once, if not told by root."""
        chain = _parsed(selector)
        if not chain:
            return []
        keys, parts = tests = chain[-1][1]
        found = min([self.keyed.get(key, []) for key in keys], key=len) if keys else range(len(self.tags))
        if len(keys) != 1 or parts:
            found = [k for k in found if _fits(self.tags[k], tests)]
        above = len(chain) - 1
        if above or chain[0][0] == ">":
            found = [k for k in found if _placed(self, k, chain, above, root)]
        if chain[0][0] != ">":
            self.found[selector] = found
        return found


class Node:
    __slots__ = ("_tree", "_k", "_of")

    def __init__(self, tree: _Tree, k: int):
        self._tree, self._k, self._of = tree, k, tree.tags[k] if k >= 0 else _PAGE

    @property
    def tag(self) -> str:
        return self._of.tag

    @property
    def attrs(self) -> dict[str, str]:
        return self._of.attrs

    @property
    def classes(self) -> frozenset[str]:
        return self._of.classes

    def _span(self) -> tuple[int, int]:
        t, k = self._tree, self._k
        return (t.first_text[k], t.last_text[k]) if k >= 0 else (0, len(t.texts))

    def texts(self) -> list[str]:
        t, (a, b) = self._tree, self._span()
        if t.hidden and self.tag not in _HIDDEN:
            return [t.texts[n] for n in range(a, b) if n not in t.hidden]
        return t.texts[a:b]

    def text(self, sep: str = " ") -> str:
        """All text below, white space normalised; parts of different elements are ``sep`` apart."""
        texts = self.texts()
        if len(texts) == 1:
            return " ".join(texts[0].split())
        return sep.join([x for x in [" ".join(t.split()) for t in texts] if x])

    def own_texts(self) -> list[str]:
        """Normalised texts that are direct children."""
        t, (a, b) = self._tree, self._span()
        return [" ".join(t.texts[n].split()) for n in range(a, b) if t.owners[n] == self._k and t.texts[n].strip()]

    def get(self, name: str, default: str = "") -> str:
        return self._of.attrs.get(name, default)

    def select(self, selector: str) -> list[Node]:
        t, k = self._tree, self._k
        found = t.found.get(selector)
        if found is None:
            found = t.matching(selector, k)
        if k >= 0:
            found = found[bisect_left(found, k + 1) : bisect_left(found, t.ends[k])]
        return [Node(t, x) for x in found]

    def first(self, selector: str) -> Node | None:
        t, k = self._tree, self._k
        found = t.found.get(selector)
        if found is None:
            found = t.matching(selector, k)
        at = bisect_left(found, k + 1)
        return Node(t, found[at]) if at < len(found) and (k < 0 or found[at] < t.ends[k]) else None


_PAGE = _Tag("", {})
_PART = re.compile(r"\.([\w-]+)|\[([\w-]+)(?:\*=['\"]?([^'\"\]]*)['\"]?)?\]|([\w-]+)")


@lru_cache(maxsize=512)
def _parsed(selector: str) -> tuple[tuple[str, tuple], ...]:
    """((combinator before it, (keys, parts of attributes)), ...) from left to right."""
    out, joint = [], " "
    for token in re.findall(r">|[^\s>]+", selector):
        if token == ">":
            joint = ">"
            continue
        found = _PART.findall(token)
        keys = tuple({f".{c}" if c else f"[{a}" if a else tag.lower() for c, a, part, tag in found})
        out.append((joint, (keys, tuple((a, part) for c, a, part, tag in found if a and part))))
        joint = " "
    return tuple(out)


def _fits(tag: _Tag, tests: tuple) -> bool:
    return tag.keys.issuperset(tests[0]) and (not tests[1] or all(part in tag.attrs[a] for a, part in tests[1]))


def _placed(tree: _Tree, k: int, chain: tuple, n: int, root: int) -> bool:
    """Whether what is above k, which fits step n of the chain, fits the steps before."""
    joint = chain[n][0]
    if n == 0:
        return joint == " " or tree.parents[k] == root
    above = k
    while above >= 0:  # ancestors above root count too, as in a style sheet
        above = tree.parents[above]
        if _fits(tree.tags[above] if above >= 0 else _PAGE, chain[n - 1][1]) and _placed(tree, above, chain, n - 1, root):
            return True
        if joint == ">":
            return False
    return False


class _Builder(HTMLParser):
    def __init__(self, tree: _Tree):
        super().__init__(convert_charrefs=True)
        self.tree = tree

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tree.start(_Tag(tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.tree.start(_Tag(tag, {k: v or "" for k, v in attrs}, True))

    def handle_endtag(self, tag: str) -> None:
        self.tree.end(tag)

    def handle_data(self, data: str) -> None:
        self.tree.data(data)


_NAME, _GAP, _BARE = r"[a-zA-Z_][\w.-]*", r"[ \t\n\r\f]+", r"""[^\s"'=<>`/&]+(?=[ \t\n\r\f]|\Z)"""
_PLAIN = re.compile(rf"""([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}{_NAME}(?:="[^"]*"|='[^']*'|={_BARE})?)*)[ \t\n\r\f]*(/?)""", re.ASCII)
_ATTR = re.compile(rf"""{_GAP}({_NAME})(?:="([^"]*)"|='([^']*)'|=({_BARE}))?""", re.ASCII)
_SKIPPED = re.compile(r"!doctype [\w .]*|!--(?:[^-]|-[^-])*--", re.I | re.ASCII)
_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*", re.ASCII)


@lru_cache(maxsize=8192)
def _tag(inside: str) -> _Tag | str | None:
    """What stands between < and > as a start tag, as the name of an end tag, or as "" if it says nothing; None if it is not plain."""
    if inside[:1] == "/":
        got = _END.fullmatch(inside)
        return got[1].lower() if got else None
    if inside[:1] == "!":
        return "" if _SKIPPED.fullmatch(inside) else None
    got = _PLAIN.fullmatch(inside)
    if got is None:
        return None
    if "&" in inside:  # references in attributes have rules of their own
        tree = _built(f"<{inside}>")
        return tree.tags[0] if len(tree.tags) == 1 and not tree.texts else None
    return _Tag(got[1].lower(), {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(got[2])}, got[3] == "/")


def _read(html: str) -> _Tree | None:
    """The tree of a page of plain markup; None for any other."""
    head, *rest = html.split("<")
    tree = _Tree()
    tags, parents, ends, first_text, last_text, texts, owners = tree.tags, tree.parents, tree.ends, tree.first_text, tree.last_text, tree.texts, tree.owners
    if head:
        tree.data(unescape(head))
    rest, at = iter(rest), -1
    for piece in rest:
        inside, closed, text = piece.partition(">")
        tag = _tag(inside) if closed else None
        if tag is None:
            return None
        if tag.__class__ is not str:
            if tag.closes is not None:
                tree.at = at
                tree.start(tag)
                at = tree.at
            else:
                # as start does
                k, n = len(tags), len(texts)
                tags.append(tag)
                parents.append(at)
                ends.append(k + 1)
                first_text.append(n)
                last_text.append(n)
                if not tag.leaf:
                    at = k
            if tag.raw:
                if tag.bare:
                    return None
                end = f"/{tag.tag}>"
                for piece in rest:
                    if piece.startswith(end):
                        break
                    # in scripts and styles all is text up to the end tag, of which others have forms
                    if tag.tag not in _HIDDEN or piece[:1] == "/" and piece[1:].lstrip()[: len(tag.tag)].lower() == tag.tag:
                        return None
                    text += "<" + piece
                else:
                    return None
                tree.at = at
                if text:
                    tree.data(text if tag.tag in _HIDDEN else unescape(text))
                tree.end(tag.tag)
                at, text = tree.at, piece[len(end) :]
        elif at >= 0 and tags[at].tag == tag:
            ends[at], last_text[at], at = len(tags), len(texts), parents[at]
        elif tag:
            tree.at = at
            tree.end(tag)
            at = tree.at
        if text:
            texts.append(unescape(text) if "&" in text else text)
            owners.append(at)
    tree.at = at
    return tree.done()


def _built(html: str) -> _Tree:
    """The tree of any page."""
    tree = _Tree()
    builder = _Builder(tree)
    builder.feed(html)
    builder.close()
    return tree.done()


def parse(html: str | None) -> Node:
    return Node(_read(html or "") or _built(html or ""), -1)
