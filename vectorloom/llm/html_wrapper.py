"""HTML extraction by union-free regular-expression inference.

The pages of a host are aligned one after another. A wrapper is a tree of items: an element that is there once, is optional or repeats, a group of
elements that repeats, or a text slot. Where an aligned page differs, the wrapper is generalised: elements on one side only become
optional, runs of equal elements become a repeated group, differing strings become a variable slot while equal ones stay part of
the template. The wrapper then tells the main region of a host's pages, and every page is matched against it.

Tasks infer a wrapper per host from their own pages, and these are merged, so a host of any number of pages costs each task a few trees.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import words
from vectorloom.operators.sizing import checkpointed

#: Wrappers of all hosts together up to this size travel with the tasks; beyond, they are joined by host.
SHIPPED_BYTES = 8 << 20
#: Hosts whose wrappers a task holds before it reports them, and partial wrappers of a host merged in one place.
HELD_HOSTS, SALTS = 2000, 64
#: A string that is the same on so many different pages, and on all that have its slot, belongs to the template.
TEMPLATE_PAGES = 3
#: Share of link text from which an element outside an article is a menu, and of all text that makes an element the main region.
MENU_SHARE, MAIN_SHARE = 0.6, 0.7
#: Longest group of elements that is looked for as a repetition.
PERIOD = 3

#: Signatures of elements of one name, and children, that an item of a wrapper keeps apart.
VARIETY, MOST_KIDS = 64, 2000

# fixed values: elements by their part in a page
_RAW = "script|style|noscript|template|iframe|textarea"  # dropped with all up to the end tag, or else to the end of the page
_DROPPED = set("object svg math canvas audio video select button".split())  # dropped with what they hold if there is an end tag
_SELF_CLOSED = set("svg math".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var".split()
)
#: Elements that hold a page or its main text: a class or id such as ``has-sidebar`` tells of their parts, not of them.
_WHOLE = set("html body main article".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_VOID_INLINE = set("img wbr source track param area".split())
_BAD_TAGS = set("head nav footer aside form dialog menu fieldset".split())
_BAD_ROLES = set("navigation banner contentinfo search complementary dialog alert alertdialog form menu menubar toolbar".split())
_BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended comment comments disqus reply replies respond toolbar copyright "
    "pagination pager skip".split()
)
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<[!?][^>]*+>|"
    rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES}|[^>]*+)>",
    re.S | re.I,
)
#: One attribute after the other: its whole name, and its value in quotes (which may lack the last one) or without.
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def deep(function):
    """Recursion on the heap: the function yields the recursive calls it makes (of its ``.step``) and is sent their results."""

    @functools.wraps(function)
    def call(*args, **options):
        waiting, result = [function(*args, **options)], None
        while waiting:
            try:
                inner = waiting[-1].send(result)
            except StopIteration as done:
                waiting.pop()
                result = done.value
            else:
                waiting.append(inner)
                result = None
        return result

    call.step = function
    return call


class Element:
    """An element of a page: its name with class and id, its children (elements and strings), and the length of its own link text."""

    __slots__ = ("name", "sig", "kids", "links")

    def __init__(self, name: str, sig: str):
        self.name, self.sig, self.kids, self.links = name, sig, [], 0


def signature(name: str, attributes: str) -> str:
    """Name with marks: ``!`` for boilerplate by name, class, id or role; ``*`` for a main region; then class and id without digits."""
    bad, main, told = name in _BAD_TAGS, name in ("article", "main"), []
    if attributes and not attributes.isspace():
        whole, named, met = name in _WHOLE, False, set()
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in met:  # of an attribute that is given again the first counts
                continue
            met.add(key)
            if key == "hidden":
                bad = True
            elif key == "role":
                bad |= value.lower() in _BAD_ROLES
                main |= value.lower() in ("main", "article")
                whole |= value.lower() == "main"
            elif key == "itemprop":
                main |= value == "articleBody"
                whole |= value == "articleBody"
            elif key in ("class", "id"):
                named |= any(p.lower() in _BAD_WORDS for p in _PART.findall(value))
                told.append(" ".join(sorted(re.sub(r"\d+", "", value).split())[:3]))
        bad |= named and not whole
    return name + ("!" if bad else "*" if main else "") + "".join("." + t for t in told)


def _dropped(token: re.Match) -> str | None:
    """The name in the tag of an element that is dropped."""
    name = token[3]
    if name is None or name.lower() not in _DROPPED or token[4] and not (token[4][0] == "/" or token[4][0].isspace()):
        return None
    return name.lower()


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """Start and end of every dropped element that has an end tag; an end tag closes the last element of its name that is open."""
    ends, begun = {}, {}
    for token in tokens:
        name = _dropped(token)
        if name is None:
            continue
        if not token[2]:
            if name not in _SELF_CLOSED or not token[4].endswith("/"):
                begun.setdefault(name, []).append(token.start())
        elif begun.get(name):
            ends[begun[name].pop()] = token.end()
    return ends


def parse(page: str) -> Element:
    """A page as a tree of its block elements; inline elements without boilerplate marks dissolve into the text around them."""
    root = Element("", "")
    stack, at, in_link = [root], 0, 0
    opened: Counter[str] = Counter()  # names on the stack: what isn't there needn't be looked for

    def push(element: Element) -> None:
        stack[-1].kids.append(element)
        stack.append(element)
        opened[element.name] += 1

    def close(depth: int) -> None:
        opened.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    tokens = list(_TOKEN.finditer(page))
    ends = _ends(tokens)
    for token in tokens:
        start = token.start()
        if start < at:  # inside a dropped element
            continue
        if start > at:
            text = page[at:start]
            stack[-1].kids.append(text)
            if in_link:
                stack[-1].links += len(text)
        at = token.end()
        name = token[3]
        if name is None:
            continue
        if _dropped(token):
            at = ends.get(start, at)
            continue
        name = name.lower()
        if token[2]:
            if name == "a":
                in_link = 0
            if not opened[name]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    close(depth)
                    break
                if name in _INLINE and stack[depth].name not in _INLINE:
                    break
            continue
        if name in _VOID:
            if name not in _VOID_INLINE:
                if name == "br":
                    stack[-1].kids.append("\n")
                elif name == "hr":
                    stack[-1].kids.append(Element("hr", "hr"))
            continue
        attributes = token[4]
        if name in _INLINE:
            if name == "a":
                in_link = 1
            sig = signature(name, attributes) if attributes else name
            if "!" in sig and not attributes.rstrip().endswith("/"):
                push(Element(name, sig))
            continue
        # elements whose end tag is left out
        closable = any(opened[other] for other in ("p", *_CLOSED_BY.get(name, ())))
        for depth in range(len(stack) - 1, 0, -1) if closable else ():
            other = stack[depth].name
            if other == "p" or other in _CLOSED_BY.get(name, ()):
                close(depth)
                if other == "p" and name not in _CLOSED_BY:
                    break
            elif other in _SCOPES.get(name, ()) or (name not in _CLOSED_BY and other not in _INLINE):
                break
        push(Element(name, signature(name, attributes)))
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


# A wrapper item is a list: signature, repeats, pages, characters, link characters, fixed string (its digest and the smallest TEMPLATE_PAGES digests of
# pages that hold it, or None), children. The signature of a text slot is "#", that of a group "()".
_SIG, _MANY, _PAGES, _CHARS, _LINKS, _FIXED, _KIDS = range(7)


def page_digest(element: Element) -> int:
    """Digest of a page's strings outside boilerplate: copies of a page share it, also those that differ in adverts or scripts only."""
    digest = hashlib.blake2b(digest_size=6)
    waiting = [iter(element.kids)]
    while waiting:
        kid = next(waiting[-1], None)
        if kid is None:
            waiting.pop()
        elif isinstance(kid, str):
            digest.update(" ".join(kid.split()).encode("utf-8", "surrogatepass"))
        elif "!" not in kid.sig:
            digest.update(b"\0")
            waiting.append(iter(kid.kids))
    return int.from_bytes(digest.digest())


@deep
def page_wrapper(element: Element, page: int | None = None) -> list:
    """The wrapper of one page, whose digest is ``page``."""
    page = page_digest(element) if page is None else page
    kids, text = [], []
    for kid in element.kids:
        if isinstance(kid, str):
            text.append(kid)
            continue
        if text:
            _slot(kids, text, page)
            text = []
        kids.append((yield page_wrapper.step(kid, page)))
    if text:
        _slot(kids, text, page)
    return [element.sig, 0, 1, 0, element.links, None, kids if len(kids) < 2 else (yield fold.step(kids))]


def _slot(kids: list, text: list[str], page: int) -> None:
    said = " ".join("".join(text).split())
    if said:
        kids.append(["#", 0, 1, len(said), 0, [zlib.crc32(said.encode("utf-8", "surrogatepass")), page], []])


def _template(item: list) -> bool:
    """Whether an item is a slot with the same string on enough different pages."""
    return item[_SIG] == "#" and item[_FIXED] is not None and len(item[_FIXED]) > TEMPLATE_PAGES


def _same(a: list, b: list) -> bool:
    return a[_SIG] == b[_SIG] and (a[_SIG] != "()" or [k[_SIG] for k in a[_KIDS]] == [k[_SIG] for k in b[_KIDS]])


@deep
def fold(items: list) -> list:
    """Equal neighbours become one repeated item, equal neighbouring groups one repeated group."""
    out: list = []
    for item in items:
        if out and item[_SIG] != "#" and _same(out[-1], item):
            out[-1] = yield merge.step(out[-1], item, True)
        else:
            out.append(item)
    for period in range(2, PERIOD + 1):
        at = 0
        while at + 2 * period <= len(out):
            unit, following = out[at : at + period], out[at + period : at + 2 * period]
            if all(_same(a, b) for a, b in zip(unit, following)):
                merged = []
                for a, b in zip(unit, following):
                    merged.append((yield merge.step(a, b, True)))
                    merged[-1][_MANY] = 0
                pages = max(k[_PAGES] for k in merged)
                group = ["()", 1, pages, 0, 0, None, merged]
                out[at : at + 2 * period] = [group]
                # further units of the same shape
                while [k[_SIG] for k in out[at + 1 : at + 1 + period]] == [k[_SIG] for k in group[_KIDS]]:
                    kids = []
                    for a, b in zip(group[_KIDS], out[at + 1 : at + 1 + period]):
                        kids.append((yield merge.step(a, b, True)))
                    group[_KIDS] = kids
                    del out[at + 1 : at + 1 + period]
            at += 1
    return out


@deep
def merge(a: list, b: list, repeat: bool = False) -> list:
    """One item for two that are aligned, of different pages or, with ``repeat``, of one."""
    kids = (yield align.step(a[_KIDS], b[_KIDS], repeat)) if a[_KIDS] and b[_KIDS] else a[_KIDS] or b[_KIDS]
    return _merged(a, b, repeat, kids)


def _merged(a: list, b: list, repeat: bool, kids: list) -> list:
    """:func:`merge` without the children."""
    pages = max(a[_PAGES], b[_PAGES]) if repeat else a[_PAGES] + b[_PAGES]
    fixed = a[_FIXED]
    if fixed != b[_FIXED]:
        fixed = [fixed[0], *sorted({*fixed[1:], *b[_FIXED][1:]})[:TEMPLATE_PAGES]] if fixed and b[_FIXED] and fixed[0] == b[_FIXED][0] else None
    return [a[_SIG], 1 if repeat else a[_MANY] | b[_MANY], pages, a[_CHARS] + b[_CHARS], a[_LINKS] + b[_LINKS], fixed, kids]


def _key(item: list):
    """What aligned items have in common."""
    return item[_SIG] if item[_SIG] != "()" else tuple(k[_SIG] for k in item[_KIDS])


def common_places(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Ascending pairs of places with equal values: the common ends, and between them a longest ascending choice of equal occurrences.

    The k-th occurrence of a value on one side can only meet the k-th one on the other, so time and space stay near the length of
    the sides, however irregular they are.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    met: dict = {}
    pairs = []
    for i in range(head, len(a) - tail):
        k = met[a[i]] = met.get(a[i], -1) + 1
        if k < len(places.get(a[i], ())):
            pairs.append((i, places[a[i]][k]))
    ends: list[int] = []  # place in b of the last pair of the best ascending run of each length
    last, before = [], []
    for n, (_, j) in enumerate(pairs):
        size = bisect_left(ends, j)
        if size == len(ends):
            ends.append(j)
            last.append(n)
        else:
            ends[size], last[size] = j, n
        before.append(last[size - 1] if size else -1)
    middle = []
    n = last[-1] if last else -1
    while n >= 0:
        middle.append(pairs[n])
        n = before[n]
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


@deep
def align(a: list, b: list, repeat: bool = False) -> list:
    """Children of two aligned items: a common subsequence is merged, the rest stays and is thereby optional.

    Aligned children of two repetitions occur as often per repetition as before.
    """
    keys_a, keys_b = [_key(x) for x in a], [_key(y) for y in b]
    pairs = list(zip(range(len(a)), range(len(a)))) if keys_a == keys_b else common_places(keys_a, keys_b)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += a[i:x]
        out += b[j:y]
        if x < len(a) and y < len(b):
            kids, others = a[x][_KIDS], b[y][_KIDS]
            one = _merged(a[x], b[y], repeat, (yield align.step(kids, others, repeat)) if kids and others else kids or others)
            if repeat:
                one[_MANY] = a[x][_MANY] | b[y][_MANY]
            out.append(one)
        i, j = x + 1, y + 1
    if len(pairs) == len(a) == len(b):
        return out
    return (yield compact.step((yield fold.step(out))))


def general(sig: str) -> str:
    """A signature without class and id."""
    return sig.split(".", 1)[0]


@deep
def compact(items: list) -> list:
    """Keep an item's children few, however irregular the pages are.

    Elements of one name that have more than VARIETY signatures (generated class names) lose their class and id. Beyond MOST_KIDS children
    the order is given up: equal ones become a single item that may be met again anywhere.
    """
    if len(items) <= VARIETY:
        return items
    kinds: dict[str, set[str]] = {}
    for item in items:
        kinds.setdefault(general(item[_SIG]), set()).add(item[_SIG])
    many = {name for name, sigs in kinds.items() if len(sigs) > VARIETY}
    if many:
        items = [[general(item[_SIG]), *item[1:]] if general(item[_SIG]) in many else item for item in items]
        items = yield fold.step(items)
    if len(items) <= MOST_KIDS:
        return items
    bag: dict = {}
    for item in items:
        key = _key(item)
        bag[key] = (yield merge.step(bag[key], item, True)) if key in bag else item
    return list(bag.values())


def packed(item: list) -> str:
    """A wrapper as text: its items in document order, each with the number of its children."""
    flat, waiting = [], [item]
    while waiting:
        one = waiting.pop()
        flat.append([*one[:_KIDS], len(one[_KIDS])])
        waiting += reversed(one[_KIDS])
    return json.dumps(flat)


def unpacked(text: str) -> list:
    """Undo :func:`packed`."""
    root: list = []
    open_items: list[list] = []  # (children so far, how many there are)
    for *values, n_kids in json.loads(text):
        item = [*values, []]
        if open_items:
            kids, n = open_items[-1]
            kids.append(item)
        else:
            root = item
        open_items.append([item[_KIDS], n_kids])
        while open_items and len(open_items[-1][0]) == open_items[-1][1]:
            open_items.pop()
    return root


def _in_order(item: list) -> list[list]:
    """All items below and with ``item``, parents first."""
    found = [item]
    for one in found:
        found += one[_KIDS]
    return found


class Wrapper:
    """A host's wrapper with the parts its items play."""

    def __init__(self, root: list):
        self.root = root
        self.total: dict[int, tuple[int, int, int]] = {}
        self.places: dict[int, tuple[dict[str, list[int]], set[int]]] = {}
        self._weigh(root)
        self.articles = self._articles(root)
        self.region = self._region(root)

    def _weigh(self, root: list) -> None:
        """Characters without template strings, link characters, and all characters below an item, without boilerplate."""
        for item in reversed(_in_order(root)):
            if "!" in item[_SIG]:
                chars, links, all_chars = 0, 0, 0
            else:
                chars, links, all_chars = (0 if _template(item) else item[_CHARS]), item[_LINKS], item[_CHARS]
                for kid in item[_KIDS]:
                    c, n, every = self.total[id(kid)]
                    chars, links, all_chars = chars + c, links + n, all_chars + every
            self.total[id(item)] = (chars, links, all_chars)

    def _articles(self, root: list) -> set[int]:
        """Items marked as articles; an outer one, like ``main``, gives way to those inside it that hold most of its text."""
        found: dict[int, list[int]] = {}
        for item in reversed(_in_order(root)):
            inner = [] if "!" in item[_SIG] else [one for kid in item[_KIDS] for one in found.pop(id(kid), ())]
            if "*" in item[_SIG] and "!" not in item[_SIG]:
                held = sum(self.total[one][0] for one in inner)
                inner = inner if inner and held * 2 >= self.total[id(item)][0] else [id(item)]
            if inner:
                found[id(item)] = inner
        return set(found.get(id(root), ()))

    def _outside(self, root: list) -> dict[int, int]:
        """Changing characters below each item that stand in no article."""
        found: dict[int, int] = {}
        for item in reversed(_in_order(root)):
            free = id(item) not in self.articles and "!" not in item[_SIG]
            found[id(item)] = self.total[id(item)][0] - sum(self.total[id(k)][0] - found[id(k)] for k in item[_KIDS]) if free else 0
        return found

    def _region(self, item: list) -> set[int]:
        """For pages without article, the item below which most of the changing text outside articles stands."""
        outside = self._outside(item)
        while True:
            chars = outside[id(item)]
            down = [k for k in item[_KIDS] if k[_SIG] not in ("#", "()") and outside[id(k)] > MAIN_SHARE * chars and not self.menu(k)]
            if not down or not chars or down[0][_MANY]:
                return {id(item)}
            item = down[0]

    def menu(self, item: list, template: bool = False) -> bool:
        chars, links, all_chars = self.total[id(item)]
        return item[_SIG] != "#" and links > MENU_SHARE * max(all_chars if template else chars, 1)

    def extract(self, page: Element) -> list[str]:
        """Blocks of a page's main text; template strings only if there is nothing else."""
        blocks: list[str] = []
        if self.articles:
            self._walk(page, self.root, False, self.articles, False, False, blocks)
        for template in (False, True):
            for region in (self.region, {id(self.root)}):
                if not blocks:
                    self._walk(page, self.root, id(self.root) in region, region, True, template, blocks)
        return blocks

    @deep
    def _walk(self, element: Element, item: list, inside: bool, region: set[int], strict: bool, template: bool, blocks: list[str]):
        """Match children with items in order; ``strict`` also leaves out menus and, without ``template``, template strings."""
        at, text = 0, []

        def flush() -> None:
            said = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if said and inside:
                if strict and not template:
                    digest = zlib.crc32(" ".join(said.split()).encode("utf-8", "surrogatepass"))
                    if digest in self._lookup(item)[1]:
                        return
                blocks.append(said)

        for kid in element.kids:
            if isinstance(kid, str):
                text.append(kid)
                continue
            if "!" in kid.sig:
                if kid.name not in _INLINE:
                    flush()
                continue
            flush()
            if kid.name == "header" and not inside:
                continue
            match, at = self._match(item, at, kid.sig)
            if match is None:
                match = ["", 0, 0, 0, 0, None, []]
            elif strict and self.menu(match, template):
                continue
            yield self._walk.step(self, kid, match, inside or id(match) in region, region, strict, template, blocks)
        flush()

    def _lookup(self, item: list) -> tuple[dict[str, list[int]], set[int]]:
        """The places of a signature among an item's children, in groups too, and the digests of its template strings."""
        if not item[_KIDS]:
            return _NOTHING
        if id(item) not in self.places:
            places: dict[str, list[int]] = {}
            for place, kid in enumerate(item[_KIDS]):
                for sig in {k[_SIG] for k in kid[_KIDS]} if kid[_SIG] == "()" else (kid[_SIG],):
                    places.setdefault(sig, []).append(place)
            self.places[id(item)] = places, {k[_FIXED][0] for k in item[_KIDS] if _template(k)}
        return self.places[id(item)]

    def _match(self, item: list, at: int, sig: str) -> tuple[list | None, int]:
        """The next child for a signature, from ``at`` on, else from the start; a repeated item or group may be met again."""
        known = self._lookup(item)[0]
        if sig not in known:
            sig = general(sig)
        places = known.get(sig)
        if not places:
            return None, at
        place = places[bisect_left(places, at) % len(places)]
        found = item[_KIDS][place]
        if found[_SIG] == sig:
            return found, place if found[_MANY] else place + 1
        return next(k for k in found[_KIDS] if k[_SIG] == sig), place


_NOTHING: tuple[dict[str, list[int]], set[int]] = {}, set()


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to partial wrappers (host, wrapper), one per host and task, or more if there are many hosts."""
    held: dict[str, list] = {}

    def report() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([packed(w) for w in held.values()], pa.string())], names=["host", "wrapper"]
        )
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            one = page_wrapper(parse(page.as_py() or ""))
            held[host] = merge(held[host], one) if host in held else one
            if len(held) > HELD_HOSTS:
                yield report()
    if held:
        yield report()


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers sorted by host, merged one by one."""
    host, whole = None, None
    for batch in batches:
        hosts, wrappers = [], []
        for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper")):
            one = unpacked(text.as_py())
            if whole is not None and name == host:
                whole = merge(whole, one)
            else:
                if whole is not None:
                    hosts.append(host)
                    wrappers.append(packed(whole))
                host, whole = name, one
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(wrappers, pa.string())], names=["host", "wrapper"])
    if whole is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([packed(whole)], pa.string())], names=["host", "wrapper"])


def host_of(url: Column) -> Column:
    """The host in a URL, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, wrapper)``: a wrapper, as JSON, for each host of ``pages``.

    Partial wrappers of a host are merged in two steps, the first salted, so no task meets more than a share of them at a time.
    """
    kind = "host string, wrapper string"
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    partial = rows.mapInArrow(_infer, kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    order = ["host", "wrapper"]
    salted = partial.repartition("host", "salt").select(*order).sortWithinPartitions(*order).mapInArrow(_merge_sorted, kind)
    return salted.repartition("host").sortWithinPartitions(*order).mapInArrow(_merge_sorted, kind)


def _extract(shipped: dict[str, str] | None):
    """Texts of pages, whose wrappers are at hand, or come before the pages of their host in the rows (html null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper] = {}
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            given = None if shipped is not None else batch.column("wrapper")
            column, bounds = batch.column("html"), words.text_buffer(batch.column("html"))[1]
            for a, b in words.chunks(bounds, 1 << 23):
                texts, pages = [], []
                for n in range(a, b):
                    host = hosts[n]
                    if given is not None and given[n].is_valid:
                        ready = {host: Wrapper(unpacked(given[n].as_py()))}  # one host's wrapper at a time
                        continue
                    if host not in ready:
                        if len(ready) > HELD_HOSTS:
                            ready.clear()
                        ready[host] = Wrapper(unpacked(shipped[host]))
                    texts.append("\n\n".join(ready[host].extract(parse(column[n].as_py() or ""))))
                    pages.append(n)
                part = batch.take(pa.array(pages, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shipped_bytes: int = SHIPPED_BYTES
) -> DataFrame:
    """One row per page: ``(page_id, url, text, n_chars)``.

    The text is that of the page's articles (elements so named or marked; else the region below which most of its host's changing text
    stands), without menus, headers, footers, sidebars, notices, adverts, forms, comments and the like. Character references are decoded,
    white space within a block is one space, blocks are joined by an empty line. A null page is empty, and a page without URL belongs to the
    nameless host. Repeated rows are pages each. Only the three named columns are read.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")
    )
    wrappers = checkpointed(infer_wrappers(pages, url_col, html_col))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0)).alias("bytes")).head().bytes
    if size <= shipped_bytes:
        met, shipped = rows, {r.host: r.wrapper for r in wrappers.collect()}
    else:
        # pages of a host are dealt over SALTS tasks; each gets the wrapper once, before its pages
        dealt = rows.withColumns({"salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)), "wrapper": F.lit(None).cast("string"), "page": F.lit(1)})
        copies = wrappers.withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))), "page": F.lit(0)})
        both = dealt.unionByName(copies, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")
        met, shipped = both.drop("salt", "page"), None
    out = met.mapInArrow(_extract(shipped), "page_id bigint, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
