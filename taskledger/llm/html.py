"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a stream of elements (with words of class and id) and text slots. Elements and groups of them
that follow each other again fold into a repeated group. Streams of a host are aligned one after
the other: what both have stays, what only one has becomes optional, and what is repeated in one
is repeated. Slots carry what their texts were on all pages of the host: on how many pages they stood, their
characters, those in links, and whether they were the same on every page.

A page is then read by fitting it to its host's wrapper. Slots whose text never changes, or is links,
are furniture. Of the rest, the article is in the element that holds most of the text that such
slots hold over the host's pages. Names of classes only weigh in: they make an element less
likely to be that one, and inside of it they tell what is set aside, if it is short.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_salted

#: Fixed values of HTML: elements without content, with text that is never shown, and that begin or end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noframes select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that another start tag of the same group ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements out of which another start tag ends nothing.
_SCOPES = frozenset("table ul ol dl article main".split())
#: Elements that are said to hold the article, that can hold one, and that hold none of it wherever they stand.
MAIN = frozenset(("article", "main"))
HOLDERS = MAIN | frozenset("html body div section center table tbody tr td details figure blockquote form".split())
ASIDE = frozenset("nav footer aside form menu dialog head".split())
#: Words of class, id and role that say that an element isn't the article. Inside of the article the first are heeded unless nearly all of its text is there, those of menus where links or what never changes bear them out, the weak ones where the part is small.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising advertorial adsense sponsor sponsored cookie cookies consent gdpr paywall newsletter subscribe subscription signup sidebar aside footer comment comments disqus respond replies complementary contentinfo".split()
)
MENU_MARKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager".split())
WEAK_MARKS = frozenset("banner promo promotion notice notices alert popup modal overlay widget share sharing social related recommended toolbar search".split())
OUTER_MARKS = frozenset("header masthead top topbar head logo branding".split())
#: Containers without a class of their own: two of them are alike if they hold the same kinds of elements.
PLAIN = frozenset(("div", "section", "td", "center", "blockquote"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")

_MASK = (1 << 62) - 1
SLOT = "#"
#: Elements within each other that a stream tells apart; of what is deeper as many again that names or kinds tell of, such as menus and footers. The rest of what is deeper belongs to the slots of these.
DEEPEST, TELLING = 64, 16
#: Cells of a table by which two sequences are aligned exactly; longer ones are cut at what both have once, and else in halves.
CELLS = 250_000
#: Places before, of the same key, at which an item may end a group that comes again.
RECENT = 16
#: Streams that are aligned in one group, about, in each round.
FAN = 64
#: Up to so many characters all wrappers are broadcast; beyond, pages are joined to them by host.
BROADCAST_CHARS = 16_000_000
#: Pages on which a slot must stand with the same text to count as furniture, the share of links that makes it a menu, and of all text that makes it too much for furniture.
SAME_ON, LINKS, MOST = 3, 0.5, 0.5
#: Share of the text that an element holds to be gone into, what names and elements weigh, and the share from which a weak name inside of the article isn't heeded.
HELD, MARKED, SAID, LARGE = 0.6, 0.1, 10.0, 0.25
#: Share of the article's text from which no name sets an element in it aside.
NEARLY_ALL = 0.75


@lru_cache(65_536)
def _tag(tag: str) -> tuple[str, str, str]:
    """(kind, name, signature) of a tag: the signature is the name with the words of class, id and role."""
    named = _NAME.match(tag)
    if not named:
        return "none", "", ""
    name = named[1].lower()
    if tag[1] == "/":
        return "close", name, f"/{name}"
    if name in RAW:
        return "none" if tag.endswith("/>") else "raw", name, ""
    marks = sorted({w for m in _MARK.finditer(tag) for w in _SPLIT.split(next((g for g in m.groups()[1:] if g is not None), "").lower()) if w})
    return "void" if name in VOID else "open", name, ".".join([name, *marks])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, signature), and (text, SLOT, the text). Raw elements and comments are left out whole."""
    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", SLOT, page[at:]
            return
        if found.start() > at:
            yield "text", SLOT, page[at : found.start()]
        at = found.end()
        kind, name, sig = _tag(found[0])
        if kind == "raw":
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif kind != "none":
            yield kind, name, sig


def _telling(name: str, sig: str) -> bool:
    return name in ASIDE or name in MAIN or bool(_marks(sig) & (MARKS | MENU_MARKS | WEAK_MARKS))


def walk(page: str) -> Iterator[tuple[str, str, tuple[str, ...], bool, bool]]:
    """(name, signature, path of open blocks, whether the path ends with this element, whether in a link) of each tag, and the same of (SLOT, text). Elements end where HTML ends them.

    The path has the outermost DEEPEST blocks, and TELLING of those within them that names or kinds tell of.
    """
    open_: list[tuple[str, tuple[str, ...], bool]] = []  # names, paths, whether in a link
    count: dict[str, int] = {}
    blocks = 0  # open elements that are blocks

    def last(name: str) -> int:
        return next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name)

    def cut(at: int) -> None:
        nonlocal blocks
        for name, *_ in open_[at:]:
            count[name] -= 1
            blocks -= name in BLOCK
        del open_[at:]

    for kind, name, sig in tokens(page):
        told = False
        if kind == "open":
            for other in (*(("p",) if name in BLOCK else ()), *CLOSES.get(name, ())):
                if count.get(other):
                    at = last(other)
                    if not any(x in _SCOPES for x, *_ in open_[at + 1 :]):
                        cut(at)
            path, link = open_[-1][1:] if open_ else ((), False)
            told = name in BLOCK and len(path) < DEEPEST + TELLING and (blocks < DEEPEST or _telling(name, sig))
            open_.append((name, (*path, sig) if told else path, link or name == "a"))
            count[name] = count.get(name, 0) + 1
            blocks += name in BLOCK
        elif kind == "close" and count.get(name):
            at = last(name)
            if name in BLOCK or not any(x in BLOCK for x, *_ in open_[at + 1 :]):
                cut(at)
        path, link = open_[-1][1:] if open_ else ((), False)
        yield name, sig, path, told, link


# --- streams and wrappers: sequences of slots [SLOT, ...], elements ["e", signature, sequence], and groups ["+", sequence] or ["?", sequence]
# A page's slot is [SLOT, characters, those in links, hash of the text, numbers of its pieces of text],
# a wrapper's [SLOT, pages, characters, those in links, hash or null if the text isn't always the same].

Join = Callable[[list, list], list]


def _in_page(a: list, b: list) -> list:
    return [SLOT, a[1] + b[1], a[2] + b[2], (a[3] + b[3]) & _MASK, a[4] + b[4]]


def _over_pages(a: list, b: list) -> list:
    return [SLOT, a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] if a[4] == b[4] else None]


def _opened(item: list) -> tuple[bool, bool, list]:
    """(repeated, optional, sequence) of a group, or of one item."""
    repeated = optional = False
    while item[0] in "+?":
        repeated, optional = repeated or item[0] == "+", optional or item[0] == "?"
        if len(item[1]) > 1:
            return repeated, optional, item[1]
        item = item[1][0]
    return repeated, optional, [item]


def _sign(item: list) -> str:
    """The signature of an element, or of what a group begins with."""
    while item[0] in "+?":
        item = item[1][0]
    return SLOT if item[0] == SLOT else item[1]


def _key(item: list) -> str:
    """What items that are put on each other share: the signature, and for plain containers the kinds of elements in them."""
    while item[0] in "+?":
        item = item[1][0]
    if item[0] == SLOT:
        return SLOT
    return f"{item[1]} {' '.join(sorted(set(map(_sign, item[2]))))}" if item[1] in PLAIN else item[1]


def _alike(a: list, b: list, ka: str, kb: str) -> int:
    """How well two items go with each other: 2, 1 for plain containers that share a kind of element, or 0."""
    if ka == kb:
        return 2
    if _sign(a) != _sign(b):
        return 0
    return int(bool(set(ka.split()[1:]) & set(kb.split()[1:])))


Pairs = list[tuple[list | None, list | None]]


def pairs(a: list, b: list) -> Pairs:
    """Items of both sequences in order, those that go with each other together: the heaviest alignment. Long sequences are cut up before, so that time grows with their length."""
    return _pairs(a, b, list(map(_key, a)), list(map(_key, b)))


def _pairs(a: list, b: list, ka: list[str], kb: list[str]) -> Pairs:
    low, least = 0, min(len(a), len(b))
    while low < least and ka[low] == kb[low]:
        low += 1
    high = 0
    while high < least - low and ka[-1 - high] == kb[-1 - high]:
        high += 1
    out: Pairs = list(zip(a[:low], b[:low]))
    ends = list(zip(a[len(a) - high :], b[len(b) - high :]))
    a, ka, b, kb = a[low : len(a) - high], ka[low : len(a) - high], b[low : len(b) - high], kb[low : len(b) - high]
    if not a or not b:
        return out + [(x, None) for x in a] + [(None, y) for y in b] + ends
    if len(a) * len(b) <= CELLS:
        return out + _heaviest(a, b, ka, kb) + ends
    at = (0, 0)
    for i, j in [*_anchors(ka, kb), (len(a), len(b))]:
        if (i - at[0]) * (j - at[1]) > CELLS and (i, j) == (len(a), len(b)) and at == (0, 0):  # nothing to cut at
            middle = len(a) // 2, len(b) // 2
            out += _pairs(a[: middle[0]], b[: middle[1]], ka[: middle[0]], kb[: middle[1]])
            at = middle
        out += _pairs(a[at[0] : i], b[at[1] : j], ka[at[0] : i], kb[at[1] : j])
        at = i, j
    return out + ends


def _anchors(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Places of runs of four keys that both sequences have once, in an order that is the same in both."""
    places: list[dict[tuple, int]] = []
    for keys in (ka, kb):
        found: dict[tuple, int] = {}
        for i, run in enumerate(zip(keys, keys[1:], keys[2:], keys[3:])):
            found[run] = -1 if run in found else i
        places.append(found)
    both = [(i, j) for run, i in places[0].items() if i > 0 and (j := places[1].get(run, -1)) > 0]
    tails: list[int] = []  # the longest rising sequence of places in the second, by its least ends
    chain: list[tuple[int, int, int]] = []
    held: list[int] = []
    for i, j in both:
        at = bisect_left(tails, j)
        chain.append((i, j, held[at - 1] if at else -1))
        if at == len(tails):
            tails.append(j)
            held.append(len(chain) - 1)
        else:
            tails[at], held[at] = j, len(chain) - 1
    out, at = [], held[-1] if held else -1
    while at >= 0:
        i, j, at = chain[at]
        out.append((i, j))
    return out[::-1]


def _heaviest(a: list, b: list, ka: list[str], kb: list[str]) -> Pairs:
    n, m, out = len(a), len(b), []
    like = [[_alike(a[i], b[j], ka[i], kb[j]) for j in range(m)] for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + like[i][j] if like[i][j] else 0)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def align(a: list, b: list, join: Join) -> list:
    """The sequence that both fit: what goes with each other is joined, the rest optional."""
    if len(a) == len(b) == 1 and a[0][0] == b[0][0] == SLOT:
        return [join(a[0], b[0])]
    return [_both(x, y, join) if x and y else lone if (lone := x or y)[0] == "?" else ["?", [lone]] for x, y in pairs(a, b)]


def _both(a: list, b: list, join: Join) -> list:
    (ra, oa, in_a), (rb, ob, in_b) = _opened(a), _opened(b)
    if len(in_a) == len(in_b) == 1 and in_a[0][0] == in_b[0][0]:
        x, y = in_a[0], in_b[0]
        body = [join(x, y) if x[0] == SLOT else ["e", x[1], align(x[2], y[2], join)]]
    else:
        body = align(in_a, in_b, join)
    repeated, optional = ra or rb, oa or ob
    body = [["+", body]] if repeated else body
    return ["?", body] if optional or len(body) > 1 else body[0]


class _Folded:
    """A sequence to which items are put one by one, and in which what repeats at once is folded: equal keys, and groups of any size whose last item is one of the RECENT ones of its key.

    Sums of the keys' numbers tell in one step whether two runs are equal.
    """

    def __init__(self, join: Join) -> None:
        self.items: list = []
        self.join = join
        self.keys: list[str] = []
        self.sums = [0]
        self.powers = [1]
        self.places: dict[str, list[int]] = {}
        self.groups: dict[int, list[str]] = {}  # keys of what groups of several hold, by their place

    def put(self, item: list) -> None:
        key = _key(item)
        if self.items and key == self.keys[-1] != SLOT and len(_opened(self.items[-1])[2]) == len(_opened(item)[2]) == 1:
            one = _both(self.items[-1], item, self.join)
            self.drop(1)
            item = one if one[0] == "+" else ["+", [one]]
        self.push(item)
        while self.again():
            pass

    def push(self, item: list) -> None:
        key = _key(item)
        self.places.setdefault(key, []).append(len(self.items))
        self.items.append(item)
        self.keys.append(key)
        self.sums.append((self.sums[-1] * _BASE + xxhash.xxh3_64_intdigest(key)) % _PRIME)
        if len(self.powers) < len(self.sums):
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def drop(self, n: int) -> list:
        gone = self.items[len(self.items) - n :]
        for key in reversed(self.keys[len(self.keys) - n :]):
            self.places[key].pop()
        for at in range(len(self.items) - n, len(self.items)):
            self.groups.pop(at, None)
        del self.items[len(self.items) - n :], self.keys[len(self.keys) - n :], self.sums[len(self.sums) - n :]
        return gone

    def run(self, low: int, high: int) -> int:
        return (self.sums[high] - self.sums[low] * self.powers[high - low]) % _PRIME

    def again(self) -> bool:
        """Folds what the last item ends, if it ends anything: one more turn of the group before, or a group that comes for the second time."""
        n = len(self.items)
        if self.groups:
            at = next(reversed(self.groups))
            keys = self.groups[at]
            if n - 1 - at == len(keys) and self.keys[at + 1 :] == keys:
                more = self.drop(len(keys))
                group = self.items[at]
                self.items[at] = ["+", [_both(x, y, self.join) for x, y in zip(group[1], more)]]
                return True
        for before in reversed(self.places[self.keys[-1]][-1 - RECENT : -1]):
            size = n - 1 - before
            if size > 1 and n >= 2 * size and self.run(n - size, n) == self.run(n - 2 * size, n - size):
                keys, second = self.keys[n - size :], self.drop(size)
                first = self.drop(size)
                self.push(["+", [_both(x, y, self.join) for x, y in zip(first, second)]])
                self.groups[len(self.items) - 1] = keys
                return True
        return False


_BASE, _PRIME = 0x9E3779B97F4A7C15 % ((1 << 61) - 1), (1 << 61) - 1


def fold(items: list, join: Join) -> list:
    """The sequence with what repeats at once folded, in time that grows with its length."""
    out = _Folded(join)
    for item in items:
        out.put(item)
    return out.items


def parse(page: str) -> tuple[list, list[tuple[str, int | None]]]:
    """(stream, pieces): the folded elements of blocks and slots, and the page's texts with their number, block ends as (line break, None).

    White space alone is of no slot; inline tags aren't told apart, but for links.
    """
    root: list = []
    open_: list[tuple[tuple[str, ...], list]] = [((), root)]  # paths of blocks, and what stands in them
    pieces: list[tuple[str, int | None]] = []
    fresh = True  # whether a block has begun or ended since the last text

    def close() -> None:
        _, inside = open_.pop()
        inside[:] = fold(inside, _in_page)

    for name, sig, at, opens, in_link in walk(page):
        if name in VOID or name != SLOT and name not in BLOCK:
            if name in VOID:
                pieces.append(("\n" if name in BLOCK else " ", None))
                fresh = fresh or name in BLOCK
            continue
        parent = at[:-1] if opens else at
        while len(open_[-1][0]) > len(parent) or open_[-1][0] != parent[: len(open_[-1][0])]:
            close()
        if name != SLOT:
            pieces.append(("\n", None))
            fresh = True
            if opens:
                inside: list = []
                open_[-1][1].append(["e", sig, inside])
                open_.append((at, inside))
            continue
        text = references.unescape(sig)
        bare = text.strip()
        pieces.append((text, len(pieces) if bare else None))
        if bare:
            slot = [SLOT, len(bare), len(bare) * in_link, xxhash.xxh3_64_intdigest(bare.encode()) & _MASK, [len(pieces) - 1]]
            items = open_[-1][1]
            if not fresh and items and items[-1][0] == SLOT:
                items[-1] = _in_page(items[-1], slot)
            else:
                items.append(slot)
            fresh = False
    while len(open_) > 1:
        close()
    return fold(root, _in_page), pieces


def wrapper_of(stream: list) -> list:
    """A page's stream as a wrapper of this page alone."""
    return [[SLOT, 1, *x[1:4]] if x[0] == SLOT else [x[0], *x[1:-1], wrapper_of(x[-1])] for x in stream]


def flat(wrapper: list) -> tuple[str, list[list]]:
    """(shape, slots): the wrapper without what its slots carry, as JSON, and that, in order."""
    slots: list[list] = []

    def shape(items: list) -> list:
        out = []
        for x in items:
            if x[0] == SLOT:
                slots.append(x[1:])
                out.append(SLOT)
            else:
                out.append([x[0], *x[1:-1], shape(x[-1])])
        return out

    return json.dumps(shape(wrapper), ensure_ascii=False, separators=(",", ":")), slots


def built(shape: str, slots: list[list]) -> list:
    """The wrapper of flat()."""
    left = iter(slots)

    def build(items: list) -> list:
        return [[SLOT, *next(left)] if x == SLOT else [x[0], *x[1:-1], build(x[-1])] for x in items]

    return build(json.loads(shape))


def _merged(found: dict[str, list[list]], shape: str, slots: list[list]) -> None:
    """found with one more wrapper; equal shapes are one."""
    old = found.get(shape)
    found[shape] = [_over_pages([SLOT, *a], [SLOT, *b])[1:] for a, b in zip(old, slots)] if old else slots


def judged(wrapper: list) -> list:
    """The wrapper with [SLOT, whether it never changes, whether it is links, characters a page outside of links] for each slot.

    Furniture is text that stands on SAME_ON pages or more and is the same on all, and outside of the article text of
    links alone; but nothing that is most of the host's text.
    """
    every: list[list] = []

    def go(items: list) -> list:
        out = []
        for x in items:
            if x[0] == SLOT:
                every.append(x)
                out.append([SLOT, x])
            else:
                out.append([x[0], *x[1:-1], go(x[-1])])
        return out

    tree = go(wrapper)
    total = sum(x[2] for x in every)

    def settle(items: list) -> None:
        for x in items:
            if x[0] == SLOT:
                _, pages, chars, links, text = x[1]
                same = pages >= SAME_ON and text is not None
                x[1:] = [same and chars < MOST * total, links > LINKS * chars and chars < MOST * total, (chars - links) / pages]
            else:
                settle(x[-1])

    settle(tree)
    return tree


def _name(sig: str) -> str:
    return sig.split(".")[0]


def _marks(sig: str) -> set[str]:
    return set(sig.split(".")[1:])


class _Reader:
    """Fits one page's stream to a judged wrapper and chooses its slots."""

    def __init__(self, stream: list, wrapper: list) -> None:
        self.known: dict[int, list] = {}  # by a slot's first piece
        self.fit(stream, wrapper)
        self.kept: set[int] = set()
        self.masses: dict[tuple[int, bool], float] = {}
        self.inside = True  # of an element that isn't the whole page
        self.choose(["e", "", stream])

    def fit(self, items: list, wrapper: list) -> None:
        for x, y in pairs(items, wrapper):
            if not x or not y:
                continue
            (_, _, a), (_, _, b) = _opened(x), _opened(y)
            if len(a) == len(b) == 1 and a[0][0] == b[0][0]:
                if a[0][0] == SLOT:
                    self.known[a[0][4][0]] = b[0]
                else:
                    self.fit(a[0][2], b[0][2])
            else:
                self.fit(a, b)

    def mass(self, item: list, heed: bool = True) -> float:
        """Text that a host's pages have, on average, where this item has slots; furniture has none. heed: whether names and elements weigh in."""
        if (found := self.masses.get((id(item), heed))) is None:
            found = self.masses[id(item), heed] = self._mass(item, heed)
        return found

    def slot(self, item: list) -> tuple[bool, bool, float]:
        """What the host knows of a slot: whether it never changes, whether it is links, characters."""
        known = self.known.get(item[4][0])
        return tuple(known[1:]) if known else (False, item[2] > LINKS * item[1], item[1] - item[2])

    def _mass(self, item: list, heed: bool) -> float:
        if item[0] == SLOT:
            same, links, chars = self.slot(item)
            return 0.0 if same or links and item[4][0] in self.known else max(chars, 0.5)
        if item[0] in "+?":
            return sum(self.mass(x, heed) for x in item[1])
        name, marks = _name(item[1]), _marks(item[1])
        if name in ASIDE:
            return 0.0
        inner = sum(self.mass(x, heed) for x in item[2])
        if heed and name not in ("html", "body"):
            inner *= (SAID if name in MAIN else 1.0) * (MARKED if name == "header" or marks & (MARKS | MENU_MARKS | WEAK_MARKS | OUTER_MARKS) else 1.0)
        return inner

    def choose(self, root: list) -> None:
        """From the root into the element that holds most, as long as there is one; a first heading on the way is kept."""
        holder, total = root, self.mass(root)
        while total:
            inner = [x for item in holder[2] for x in _opened(item)[2] if x[0] == "e" and _name(x[1]) in HOLDERS]
            most = max(inner, key=self.mass, default=None)
            if most is None or self.mass(most) < HELD * total:
                break
            for x in holder[2][: next(i for i, item in enumerate(holder[2]) if any(x is most for x in _opened(item)[2]))]:
                if x[0] == "e" and _name(x[1]) == "h1" and not _marks(x[1]) & MARKS and self.mass(x):
                    self.keep(x, set(), 0.0)
            holder, total = most, self.mass(most)
        self.inside = _name(holder[1]) not in ("", "html", "body")
        total = sum(self.mass(item, heed=False) for item in holder[2])
        for item in holder[2]:
            self.keep(item, set() if self.inside else OUTER_MARKS, total)

    def shares(self, item: list) -> tuple[float, float]:
        """(characters, those in links or that never change) of an item."""
        if item[0] == SLOT:
            same, links, _ = self.slot(item)
            return item[1], item[1] if same or links else item[2]
        parts = [self.shares(x) for x in item[-1]]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    def aside(self, sig: str, item: list, outer: set[str], total: float) -> bool:
        """Whether an element that holds no more than its part of the article's text (total) is set aside."""
        name, marks, mass = _name(sig), _marks(sig), self.mass(item, heed=False)
        if name in ASIDE or outer and (name == "header" or marks & MENU_MARKS):
            return True
        if marks & MENU_MARKS:
            chars, linked = self.shares(item)
            if linked > LINKS * chars:
                return True
        return bool(marks & MARKS and mass < NEARLY_ALL * total or marks & (WEAK_MARKS | outer) and mass < LARGE * total)

    def keep(self, item: list, outer: set[str], total: float) -> None:
        if item[0] == SLOT:
            same, links, _ = self.slot(item)
            if not same and (self.inside or not links or item[4][0] not in self.known):
                self.kept.update(item[4])
        elif item[0] in "+?":
            for x in item[1]:
                self.keep(x, outer, total)
        elif not self.aside(item[1], item, outer, total):
            for x in item[2]:
                self.keep(x, outer, total)


def article(page: str, wrapper: list) -> str:
    """The page's article by a judged wrapper: blocks in order, joined by line breaks."""
    stream, pieces = parse(page)
    kept = _Reader(stream, wrapper).kept
    blocks = "".join(text if text == "\n" and number is None else " ".join(text.split("\n")) if number is None or number in kept else "" for text, number in pieces)
    return "\n".join(block for line in blocks.split("\n") if (block := " ".join(line.split())))


@lru_cache(4096)
def _known(shape: str, slots: str) -> list:
    return judged(built(shape, json.loads(slots)))


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host): the host of the URL without port, in lower case; none is empty. A null html is empty."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, shape, slots): a wrapper, as JSON, for each host of all its pages.

    Pages of equal shape meet before the shuffle. The shapes of a host are aligned in groups of
    about FAN, and what comes of these again, until one is left: no host is one task's, however many shapes it has.
    """
    schema = "host string, shape string, slots string"

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, dict[str, list]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                _merged(found.setdefault(host, {}), *flat(wrapper_of(parse(page.as_py())[0])))
            rows = [(host, shape, json.dumps(slots)) for host, shapes in found.items() for shape, slots in shapes.items()]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["host", "shape", "slots"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list[list]] = {}
        for shape, slots in zip(rows["shape"], rows["slots"]):
            _merged(found, shape, json.loads(slots))
        first, *others = sorted(found, key=lambda x: (len(x), x))
        wrapper = built(first, found[first])
        for shape in others:
            wrapper = align(wrapper, built(shape, found[shape]), _over_pages)
        shape, slots = flat(wrapper)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [shape], "slots": [json.dumps(slots)]})

    found = cut_lineage(pages.select("host", "html").mapInArrow(streams, schema))
    while (most := found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        part = F.pmod(F.xxhash64("shape"), F.lit(-(-most // FAN)))
        found = cut_lineage(found.groupBy("host", part.alias("part")).applyInPandas(merge, schema))
    return found


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; a null or empty html, or one without an article, has an empty text. Other columns are ignored."""
    rows = with_host(pages)
    wrappers = infer_wrappers(rows)
    size = wrappers.agg(F.sum(F.length("shape") + F.length("slots") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        both = rows.join(F.broadcast(wrappers), "host")
    else:
        both = join_salted(rows, wrappers, ["host"], rows.groupBy("host").agg(F.count("*").alias("n")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(p.as_py(), _known(a.as_py(), b.as_py())) for p, a, b in zip(*batch.columns[2:])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "shape", "slots").mapInArrow(read, "page_id long, url string, text string, n_chars long")
