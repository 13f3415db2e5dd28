"""HTML to blocks of text, with what the tree around each says about it."""

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|$)|<(/?)([a-zA-Z][^\s/>]*)[^>]*>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
WORDS = re.compile(r"[a-z]+")

# Elements as HTML names them.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title".split())
# Left out where they end; without an end tag, only the tag is.
CLOSED = frozenset("noscript template iframe svg math object select canvas video audio button".split())
SKIPPED = frozenset("noscript template iframe".split())
FOREIGN = frozenset("svg math".split())
SILENT = frozenset("svg button annotation".split())  # no text, and no border of a block
EMBEDDED = frozenset("object select option canvas video audio head".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
# What cannot stand in these and closes one left open.
NARROW = frozenset("svg math button option select".split())
BREAKS = frozenset(
    "article main section body p h1 h2 h3 h4 h5 h6 ul ol table header nav footer aside pre blockquote".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img "
    "svg math button".split()
)
# What closes an open element of the same kind that was left open.
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
SAME |= {"option": "option", "button": "button"}
SCOPE = frozenset("ul ol dl table tbody thead section article main aside nav div body".split())

CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_ROLES = frozenset("main article".split())
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
# Words of class and id attributes.
CONTENT_WORDS = frozenset("article content entry post story main".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended comment comments disqus respond reply replies "
    "pagination pager toolbar copyright".split()
)


COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
# Elements whose nearest open one is remembered, as a later element may close it.
REMEMBERED = frozenset("p li dt dd tr td th option button".split())


@dataclass(frozen=True, slots=True)
class Tree:
    """What the elements around a text say of it, each from 0 to 1.

    Names of class and id count by the share of their words that are in a list: ``notice-of-meeting``
    says less than ``cookie-notice``.
    """

    content_tag: float = 0.0
    content_word: float = 0.0
    other_tag: float = 0.0
    other_word: float = 0.0
    comment: float = 0.0
    hidden: float = 0.0
    form: float = 0.0


@dataclass(slots=True)
class Block:
    text: str
    element: int  # the number of the element that holds it
    container: int  # the number of the one around that
    apart: int  # steps in the tree from the block before
    tag: str
    tree: Tree
    linked: int  # code points within links


@dataclass(slots=True)
class _Element:
    tag: str
    number: int
    tree: Tree
    holder: "_Element | None"  # the nearest element that is not inline, itself included
    around: int  # the number of the holder's own holder
    height: int
    near: dict[str, int]  # where in the stack the nearest of ``REMEMBERED`` stand


@dataclass(slots=True)
class _Reader:
    stack: list = field(default_factory=list)
    out: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)  # open elements by tag
    special: list = field(default_factory=list)  # where heads, narrow and foreign ones stand
    linked: int = 0
    links: int = 0
    silent: int = 0
    foreign: int = 0
    made: int = 0
    headed: bool = False
    low: int = 0  # the least height of the stack since the last block began
    before: int = 0  # the height at which that began
    block: tuple = (0, 0, 0, "", Tree())

    def context(self) -> tuple:
        """Element, container, distance, tag and tree of text that begins here."""
        top = self.stack[-1] if self.stack else None
        height = top.holder.height if top and top.holder else 0
        shared = min(self.low, height, self.before)
        apart = (height - shared) + (self.before - shared)
        self.low, self.before = height, height
        if not (top and top.holder):
            return 0, 0, apart, "", top.tree if top else Tree()
        return top.holder.number, top.around, apart, top.holder.tag, top.tree

    def add(self, raw: str) -> None:
        if not raw or self.silent:
            return
        if not self.parts:
            if raw.isspace():
                return
            if self.stack and self.stack[-1].tag == "head":
                self.pop(len(self.stack) - 1)
            self.block = self.context()
        self.parts.append(raw)
        if self.links:
            self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.out.append(Block(text, *self.block, self.linked))
            self.parts, self.linked = [], 0

    def pop(self, k: int) -> None:
        for e in self.stack[k:]:
            self.opened[e.tag] -= 1
            self.links -= e.tag == "a"
            self.silent -= e.tag in SILENT
            self.foreign -= e.tag in FOREIGN
        del self.stack[k:]
        while self.special and self.special[-1] >= k:
            self.special.pop()
        self.low = min(self.low, self.stack[-1].height if self.stack else 0)

    def leave(self, tag: str) -> None:
        """Close what was left open and cannot hold the element that begins."""
        if tag not in BREAKS and (tag in IN_HEAD or not self.opened["head"]):
            return
        for k in self.special:
            at = self.stack[k].tag
            if at == "foreignobject":
                break
            if at == "head" or tag in BREAKS:
                return self.pop(k)

    def open(self, tag: str, attributes: str) -> None:
        self.leave(tag)
        if self.foreign or tag in FOREIGN:
            if attributes.endswith("/"):
                return
        elif tag not in INLINE or tag == "button":
            if tag != "button":
                self.flush()
            near = self.stack[-1].near if self.stack else {}
            last = max((near.get(t, -1) for t in ("p", *SAME.get(tag, "").split())), default=-1)
            if last >= 0:
                self.pop(last)
        if tag == "br":
            self.add("\n")
        if tag in VOID or tag == "head" and self.headed:
            return
        self.push(tag, attributes)

    def push(self, tag: str, attributes: str) -> None:
        self.made += 1
        self.opened[tag] += 1
        self.links += tag == "a"
        self.silent += tag in SILENT
        self.foreign += tag in FOREIGN
        self.headed |= tag == "head"
        if tag in NARROW or tag in ("head", "foreignobject"):
            self.special.append(len(self.stack))
        top = self.stack[-1] if self.stack else None
        near = {} if tag in SCOPE or not top else top.near
        if tag in REMEMBERED:
            near = near | {tag: len(self.stack)}
        tree = told(tag, attributes, top.tree if top else Tree())
        holder, around, height = (top.holder, top.around, top.height) if top else (None, 0, 0)
        one = _Element(tag, self.made, tree, holder, around, height, near)
        if tag not in INLINE:
            one.around = holder.number if holder else 0
            one.holder, one.height = one, height + 1
        self.stack.append(one)

    def close(self, tag: str) -> None:
        if tag not in INLINE and not (self.foreign and tag not in BREAKS):
            self.flush()
        if self.opened[tag]:
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.pop(k)


def _share(names: list[str], listed: frozenset[str]) -> float:
    """The largest share of one name's words that are listed."""
    split = [WORDS.findall(name) for name in names]
    return max((sum(w in listed for w in ws) / len(ws) for ws in split if ws), default=0.0)


def told(tag: str, attributes: str, around: Tree) -> Tree:
    """What is said of text within an element, given what was said around it."""
    if tag in ("html", "body"):
        return around
    names: list[str] = []
    role, hidden = "", False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            hidden |= bool(bare) or name == "aria-hidden" and value == "true"
            hidden |= name == "style" and "display:none" in value.replace(" ", "")
            if name == "role":
                role = value
            if name in ("class", "id"):
                names += value.split()
    content = tag in CONTENT_TAGS or role in CONTENT_ROLES
    other = tag in OTHER_TAGS or tag in EMBEDDED or role in OTHER_ROLES
    if not (names or content or other or hidden):
        return around
    comment = max(around.comment, _share(names, COMMENT_WORDS))
    content_word = max(around.content_word, _share(names, CONTENT_WORDS))
    other_word, other_tag, form = around.other_word, around.other_tag, around.form
    if content and not comment:
        # A name around an article says little, and some pages put all they have into a form.
        other_word, form = 0.0, 0.0
    other_word = max(other_word, _share(names, OTHER_WORDS))
    if tag == "form" or role == "form":
        form = 1.0
    elif other and not (tag == "header" and around.content_tag):  # an article's own heading
        other_tag = 1.0
    content_tag = max(around.content_tag, float(content and not comment))
    return Tree(
        content_tag, content_word, other_tag, other_word, comment, max(around.hidden, hidden), form
    )


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order: text between elements that are not inline."""
    reader, at, n = _Reader(), 0, len(page)
    ends: dict[str, tuple[int, int]] = {}  # the next end tag of a kind, as last looked for

    def end_of(tag: str) -> int:
        """Where the next end tag of a kind ends; -1 without one."""
        if tag not in ends or ends[tag][0] < at and ends[tag][1] >= 0:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            ends[tag] = (end.start(), end.end()) if end else (0, -1)
        return ends[tag][1]

    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            reader.add(page[at:])
            break
        reader.add(page[at : found.start()])
        at = found.end()
        slash, tag = (found[1], found[2]) if found[2] else (found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            reader.close(tag)
        elif tag in RAW:
            reader.flush() if tag not in INLINE and not reader.foreign else None
            at = end_of(tag) if end_of(tag) >= 0 else n
        elif tag in CLOSED and end_of(tag) < 0 and not (tag in FOREIGN and (found[3] or "").endswith("/")):
            reader.leave(tag)
        elif tag in SKIPPED:
            reader.flush()
            at = end_of(tag)
        else:
            reader.open(tag, found[3] or "")
    reader.flush()
    return reader.out
