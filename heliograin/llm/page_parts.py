"""Pages as trees of blocks, and union-free expressions over them.

A node of an expression is ``[sym, optional, repeated, children]``. ``sym`` names a block
element with the telling tokens of its class, id and role; a text run is a leaf named ``#`` whose
children are its facts: the digest that all occurrences share (None if they differ),
occurrences, characters, and characters inside links. ``(`` names a group of
several nodes that repeats, ``*`` a place of any blocks.

What a name says is read from whole tokens, cut at hyphens, underscores and
capitals: ``post-comments`` names comments; ``has-sidebar``, ``tag-share`` and
``category-social`` say something about a block, not what it is.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

# Element names and the words of class, id and role that tell what a block is for.
RAW = {"script", "style", "template", "iframe", "textarea"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul "
    "audio canvas noscript select svg video".split()
)
VOID = {"hr"}
DROPPED_ELEMENTS = {"aside", "audio", "button", "canvas", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "noscript", "select", "svg", "title", "video"}
DROPPED_WORDS = set(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup promo promotion related reply replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Of an article element, only these say that it isn't one.
DROPPED_ARTICLES = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "replies", "reply", "sponsored", "teaser"}
#: Inline elements with one of these as a whole token are left out of their paragraph.
DROPPED_INLINE = {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "promo", "promotion", "share", "sharing", "social", "sponsor", "sponsored"}
#: Words beside those of DROPPED_WORDS in the name of a block inside an article that don't make it a part of the text.
NEUTRAL_WORDS = set(
    "after area articles bar before block bottom bottombar box btn button buttons card cards center column container content end entry feed form frame "
    "group head header holder icons inline inner item items label large layout left links list main media message module more news "
    "outer page panel post posts region right row section shell site slot small stories story strip thread title top unit user view well wrap wrapper zone".split()
)
MAIN_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}
#: First parts, or any parts, of tokens that describe a block rather than name it.
ABOUT_FIRST = {"cat", "category", "format", "is", "postname", "status", "tag", "tagged", "taxonomy", "template", "term", "theme", "type"}
ABOUT_ANY = {"has", "no", "not", "show", "with", "without"}
EMPTY = {"area", "base", "br", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

#: Blocks nested deeper than this are one text and a place of any blocks to the wrapper; pages are read at any depth.
DEEPEST = 100
#: Children of a wrapper's node that are told apart; the lightest beyond them become places of any blocks, which each page's own blocks say how to read.
MOST_CHILDREN = 40

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
_NAMING = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An open element of these names ends where another of the second names begins beside it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "thead": {"tbody"}, "tbody": {"tbody", "tfoot"}}
_HEADINGS = {"h1", "h2", "h3"}


_KNOWN: dict = {}


def _known(what, *key):
    """``what`` of ``key``, remembered; a plain dictionary, as functions go to the workers by value."""
    at = (what.__name__, *key)
    if at not in _KNOWN:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        _KNOWN[at] = what(*key)
    return _KNOWN[at]


def parts_of(token: str) -> tuple[str, ...]:
    """The words of a token, in lower case; none of one that only describes its block."""
    words = tuple(w.lower() for w in _PART.findall(token))
    if len(words) > 1 and (words[0] in ABOUT_FIRST or not ABOUT_ANY.isdisjoint(words)):
        return ()
    return words


def _name_of(element: str, attributes: str) -> str:
    """The symbol of an element: its name and its tokens, without those that hold digits or only describe it."""
    tokens = {t for m in _NAMING.findall(attributes) for t in "".join(m).split()} if attributes else ()
    kept = sorted(t for t in tokens if len(t) <= 40 and not any(c.isdigit() for c in t) and parts_of(t))
    return " ".join((element, *kept)) if kept else element


def name_of(element: str, attributes: str) -> str:
    return _known(_name_of, element, attributes)


def parse(page: str):
    """The tree of a page: (sym, children) with leaves ("#", text, link characters)."""
    root = ("", [])
    stack, run, link, linked, at, n = [root], [], 0, 0, 0, len(page)
    is_open: Counter = Counter()
    muted, depth = "", 0  # an inline element that is left out, and how many of its name are open in it

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not muted:
            piece = html.unescape(piece)
            run.append(piece)
            if link:
                linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if run:
            whole = " ".join("".join(run).split())
            if whole:
                stack[-1][1].append(("#", whole, linked))
            run.clear()
        linked = 0

    def shut() -> str:
        element = stack.pop()[0].split(" ", 1)[0]
        is_open[element] -= 1
        return element

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        element = m[2] or m[5]
        if element is None:
            continue
        element, closing, attributes = element.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if element in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{element}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if element not in BLOCKS:
            if muted:
                if element == muted:
                    depth += -1 if closing else 1
                    muted = muted if depth else ""
            elif not closing and element not in EMPTY and attributes and not attributes.endswith("/") and not DROPPED_INLINE.isdisjoint(name_of(element, attributes).lower().split(" ")[1:]):
                muted, depth = element, 1
            if element == "a":
                link = 0 if closing else 1
            elif element == "br":
                run.append(" ")
            continue
        muted = ""
        flush()
        if closing:
            while is_open[element]:
                last = shut()
                if last == element:
                    break
            continue
        while len(stack) > 1 and ((last := stack[-1][0].split(" ", 1)[0]) == "p" or element in _ENDS.get(last, ())):
            shut()
        node = (name_of(element, attributes), [])
        stack[-1][1].append(node)
        if element not in VOID and not attributes.endswith("/"):
            stack.append(node)
            is_open[element] += 1
    flush()
    return root


def _dropped(sym: str) -> bool:
    """Whether a block's name says that it isn't part of an article."""
    element, *tokens = sym.split(" ")
    if element in ("html", "body", "main"):
        return False
    words = {w for t in tokens for w in parts_of(t)}
    if element == "article":
        return not DROPPED_ARTICLES.isdisjoint(words)
    return element in DROPPED_ELEMENTS or not DROPPED_WORDS.isdisjoint(words)


def _heads(sym: str) -> bool:
    """Whether a block is a header: of an article it keeps the headings only."""
    element, *tokens = sym.split(" ")
    return element == "header" or element in ("div", "section") and any(parts_of(t)[-1:] == ("header",) for t in tokens)


def _main(sym: str) -> bool:
    element, *tokens = sym.split(" ")
    return element == "main" or any(not MAIN_WORDS.isdisjoint(parts_of(t)) for t in tokens)


def _dropped_inside(sym: str) -> bool:
    """Whether a block inside an article isn't part of it: of its name's tokens one says nothing else than that."""
    element, *tokens = sym.split(" ")
    if element in DROPPED_ELEMENTS or element == "article":
        return _dropped(sym)
    return any(words and not words.isdisjoint(DROPPED_WORDS) and words <= DROPPED_WORDS | NEUTRAL_WORDS for words in map(set, map(parts_of, tokens)))


def dropped_inside(sym: str) -> bool:
    return _known(_dropped_inside, sym)


def dropped(sym: str) -> bool:
    return _known(_dropped, sym)


def heads(sym: str) -> bool:
    return _known(_heads, sym)


def main(sym: str) -> bool:
    return _known(_main, sym)


def _leaf(text: str, linked: int) -> list:
    return ["#", False, False, [zlib.crc32(text.encode("utf-8", "replace")), 1, len(text), linked]]


def expression(node, depth: int = 0) -> list:
    """A page's node as an expression, with adjacent repeats folded; what lies below ``DEEPEST`` as one text."""
    if node[0] == "#":
        return _leaf(node[1], node[2])
    if depth < DEEPEST:
        return [node[0], False, False, bounded(fold([expression(x, depth + 1) for x in node[1]]))]
    found, linked, open_ = [], 0, [node]
    while open_:
        x = open_.pop()
        if x[0] == "#":
            found.append(x[1])
            linked += x[2]
        else:
            open_.extend(reversed(x[1]))
    return [node[0], False, False, [*([_leaf(" ".join(found), linked)] if found else []), ["*", True, True, []]]]


def characters(node: list) -> int:
    return node[3][2] if node[0] == "#" else sum(map(characters, node[3]))


def bounded(items: list) -> list:
    """At most MOST_CHILDREN children: the lightest in text become places of any blocks."""
    if len(items) <= MOST_CHILDREN:
        return items
    weights = [characters(x) if x[0] != "*" else -1 for x in items]
    # a place of any blocks may stand between two kept children
    kept = set(sorted(range(len(items)), key=lambda k: -weights[k])[: MOST_CHILDREN // 2])
    out: list = []
    for k, x in enumerate(items):
        if k in kept:
            out.append(x)
        elif not out or out[-1][0] != "*":
            out.append(["*", True, True, []])
    return out


def fold(items: list) -> list:
    """Runs of one symbol become a repeated node, repeated sequences of up to four a repeated group."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            out[-1] = merged(out[-1], x)
            out[-1][2] = True
        else:
            out.append(x)
    for period in (2, 3, 4):
        made, i = [], 0
        while i < len(out):
            first = [x[0] for x in out[i : i + period]]
            both, k = None, i + period
            while len(first) == period and [x[0] for x in out[k : k + period]] == first:
                both = [merged(a, b) for a, b in zip(both or out[i : i + period], out[k : k + period])]
                k += period
            if both:
                made.append(["(" + "|".join(first), False, True, both])
                i = k
            else:
                made.append(out[i])
                i += 1
        out = made
    return out


def merged(a: list, b: list) -> list:
    """The expression of two nodes of one symbol."""
    if a[0] == "#":
        x, y = a[3], b[3]
        return ["#", a[1] or b[1], a[2] or b[2], [x[0] if x[0] == y[0] else None, x[1] + y[1], x[2] + y[2], x[3] + y[3]]]
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def aligned(a: list, b: list) -> list:
    """Two sequences of one wrapper: what both have in one order is merged, mismatches become optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merged(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2], b[j][3]])
            j += 1
    return bounded(fold(out) if any(x[0] == y[0] for x, y in zip(out, out[1:])) else out)


class Weights:
    """Characters outside links under each node of a wrapper, of slots only where pages differ at all.

    ``all`` counts whatever names say, ``kept`` leaves out dropped blocks but the spared ones.
    """

    def __init__(self, wrapper: list, pages: int):
        self.shared = pages > 1
        self.all, self.kept, self.spared = {}, {}, set()
        if self._of(wrapper, self.all, False) < 0.1 * characters(wrapper):  # pages that are copies of each other
            self.shared = False
            self._of(wrapper, self.all, False)
        self.total = self._of(wrapper, self.kept, True)
        self._overrule(wrapper)

    def _of(self, node: list, at: dict, names: bool) -> float:
        if node[0] == "#":
            fact = node[3]
            total = 0 if self.shared and fact[0] is not None and fact[1] > 1 else fact[2] - fact[3]
        else:
            gone = node[0].split(" ")[0] in DROPPED_ELEMENTS or names and dropped(node[0]) and node[0] not in self.spared
            inner = [self._of(x, at, names) for x in node[3]]
            total = 0 if gone else sum(inner)
        at[id(node)] = total
        return total

    def _overrule(self, wrapper: list) -> None:
        """Names are wrong where leaving out what they name leaves hardly any text: the heaviest named blocks are spared."""
        while self.total < 0.2 * self.all[id(wrapper)]:
            node, named = wrapper, None
            while node[3] and node[0] != "#":
                heavy = max(node[3], key=lambda x: self.all[id(x)], default=None)
                if heavy is None or heavy[0] == "#":
                    break
                node = heavy
                if dropped(node[0]) and node[0] not in self.spared:
                    named = node[0]
                    break
            if named is None:
                return
            self.spared.add(named)
            self.total = self._of(wrapper, self.kept, True)


def regions(wrapper: list, pages: int) -> list:
    """What a wrapper tells about reading its pages: [ways, spared]. Ways lead to the article: ``[sym, is main, children]``.

    A place of any blocks is a way ``["*", False, kind]``: below it a page's own blocks of that kind (article, main) are the article's.
    ``spared`` lists names of blocks that are kept although they look like something else.
    """
    w = Weights(wrapper, pages)
    weight, total = w.kept, w.total

    def out(sym: str) -> bool:
        return dropped(sym) and sym not in w.spared

    def named(node, test) -> bool:
        if node[0] in ("#", "*") or out(node[0]):
            return False
        return test(node) or any(named(x, test) for x in node[3])

    def held(node, test) -> float:
        """The weight under the outermost nodes that pass."""
        if node[0] in ("#", "*") or out(node[0]):
            return 0
        return weight[id(node)] if test(node) else sum(held(x, test) for x in node[3])

    def starred(node) -> bool:
        """Whether a place of any blocks lies below."""
        return node[0] == "*" or node[0] != "#" and not out(node[0]) and any(map(starred, node[3]))

    def cut(node, test, kind: str) -> list:
        if node[0] == "*":
            return ["*", False, kind]
        is_main = node[0][:1] != "(" and test(node)
        return [node[0], is_main, [] if is_main else [cut(x, test, kind) for x in node[3] if named(x, test) or kind and starred(x)]]

    def heaviest() -> int:
        node = wrapper
        while True:
            inner = [x for x in node[3] if x[0] not in ("#", "*") and x[0].split(" ")[0] not in ("p", "li", "td", "dd") and weight[id(x)] >= 0.6 * max(total, 1)]
            if not inner:
                return id(node)
            node = inner[0]

    is_article = lambda x: x[0].split(" ")[0] == "article"
    is_main = lambda x: main(x[0]) and weight[id(x)] >= 0.5 * total
    for test, least, kind in ((is_article, 0.3, "article"), (is_main, 0.5, "main")):
        if named(wrapper, test) and held(wrapper, test) >= least * total:
            return [cut(wrapper, test, kind), sorted(w.spared)]
    one = heaviest()
    return [cut(wrapper, lambda x: id(x) == one, ""), sorted(w.spared)]


def _of_kind(sym: str, kind: str) -> bool:
    return sym.split(" ")[0] == "article" if kind == "article" else main(sym)


def _flat(items: list) -> list:
    """Groups opened, so that a page's own sequence can be followed."""
    return [y for x in items for y in (_flat(x[2]) if x[0][:1] == "(" else [x])]


def texts(root, region: list) -> list[str]:
    """Text runs of a page's tree that its wrapper's regions hold, in order."""
    ways, spared = region[0], set(region[1])
    # (node, its ways or None inside the article, whether headings only)
    found, open_ = [], [(root, None if ways[1] else ways, False)]
    while open_:
        node, way, headings = open_.pop()
        if node[0] == "#":
            found.append(node[1])
            continue
        star = way if way and way[0] == "*" else None
        inner, at, after = _flat(way[2]) if way and not star else [], 0, []
        star = star or next((x for x in inner if x[0] == "*"), None)
        for x in node[1]:
            sym = x[0]
            if sym == "#":
                if way is None and not headings:
                    after.append((x, None, False))
                continue
            if (dropped_inside if way is None else dropped)(sym) and sym not in spared:
                continue
            if way is None:
                after.append((x, None, (headings or heads(sym)) and sym.split(" ")[0] not in _HEADINGS))
                continue
            hit = next((k for k in [*range(at, len(inner)), *range(at)] if inner[k][0] == sym), None)
            if hit is not None:
                at = hit
                after.append((x, None if inner[hit][1] else inner[hit], False))
            elif star is not None:
                after.append((x, None if _of_kind(sym, star[2]) else star, False))
        open_.extend(reversed(after))
    return found
