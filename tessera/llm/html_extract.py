"""Main-text extraction from HTML by inferred wrappers.

All pages of a host are read as streams of tags and texts. Repeated neighbours are folded into repeated groups, pages
of one structure become one stream whose differing texts are slots, and those streams are aligned, in the order of
hashes of their structures: what differs in texts becomes a text slot, what only one side has becomes an optional
group. The result is a union-free regular expression, the host's wrapper, whatever the order or partitions of the pages. Its repeated groups of
containers with several slots each, behind the first block of text, are threads of reader comments, and the container
with most of its slots is the content where a page marks none itself.

What is fixed is then counted over all pages of the host, by combined aggregates: containers whose text is the same
wherever they stand, and containers that are mostly links everywhere. Each page is matched with its host's wrapper:
its article (or main element, or the wrapper's content, or else the container with most of its text) without threads,
without what the wrapper has as fixed, text compared, and without elements that are no part of an article by their
name, role, or a whole class name of PARTS.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable
from hashlib import blake2b
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: parts that the structures of a host are dealt to; each is aligned by itself, then the parts, so large hosts are spread
PARTS_OF_HOST = 64
#: nodes of different structures that a task holds before it hands them on
HELD_NODES = 100_000
#: different pages that must agree before a text inside an article counts as fixed
AGREE = 3
#: hosts whose wrappers are broadcast; above, pages and wrappers are joined on host and salt
BROADCAST_HOSTS = 5000
SALTS = 16

# fixed values: element names of HTML, roles of ARIA, and whole class or id names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
NEVER = frozenset("nav header footer aside form head title button dialog menu".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul option".split()
)
CONTAINER = frozenset("article main section div nav header footer aside form ul ol table dl td body head dialog menu figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PARTS = frozenset("ad ads advert advertisement banner breadcrumbs comment comments cookie discussion newsletter notice promo replies responses share sidebar sponsored widget".split())

#: hashes of texts one after the other: a prime below 2^61 and a number below it
PRIME, STEP = (1 << 61) - 1, 0x1A2B3C4D5E6F708
_TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*)")
#: white space and slashes, then a name and a value in quotes or without; a quote that never ends takes all that is left
_ATTRIBUTE = re.compile(
    r"[\t\n\f\r /]*(?:([^\t\n\f\r />][^\t\n\f\r />=]*)"
    r"(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\t\n\f\r >]*)))?)?"
)
_ENDS = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in RAW}


def tokens(page: str):
    """("text", text), ("open", name, names) and ("close", name, "") by the rules of HTML; names: class, id and role.

    References are decoded in each text by itself. Comments, declarations and the content of RAW elements are left
    out, and so is a tag that the page ends in.
    """
    at, begin, size = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        tag = _TAG.match(page, at)
        if not tag and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1  # a "<" of the text
            continue
        if at > begin:
            yield "text", html.unescape(page[begin:at]), ""
        if not tag:
            if page.startswith("<!--", at):
                end = 4 if page.startswith(">", at + 4) else page.find("-->", at + 2)
                end = at + 5 if end == 4 else end + 3 if end >= 0 else size
            else:
                end = page.find(">", at) + 1 or size
            at = begin = end
            continue
        at, names = tag.end(), []
        while at < size and page[at] != ">":
            found = _ATTRIBUTE.match(page, at)
            at = found.end()
            if found.group(1) and found.group(1).lower() in ("class", "id", "role"):
                names.append(found.group(2) or found.group(3) or found.group(4) or "")
        if at >= size:
            return
        at = begin = at + 1
        name = tag.group(2).lower()
        if tag.group(1):
            yield "close", name, ""
            continue
        yield "open", name, " ".join(" ".join(names).lower().split())
        if name in RAW and not (name in ("svg", "math") and page[at - 2] == "/"):
            end = _ENDS[name].search(page, at)
            at = page.find(">", end.end()) + 1 or size if end else size
            begin = at
            yield "close", name, ""
    if begin < size:
        yield "text", html.unescape(page[begin:]), ""


def is_part(name: str, names: str) -> bool:
    """Whether an element by its name, role or a whole class or id is never in an article."""
    return name in NEVER or any(w in PARTS or w in ROLES for w in names.split())


def key_of(parent: int, label: str) -> int:
    """Number of a container, from that of the one around it and its own name and classes."""
    return int.from_bytes(blake2b(f"{parent} {label}".encode(), digest_size=8).digest(), "big", signed=True)


def text_key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """Containers of a page, and pieces of text in order, each with the innermost container and whether in a link."""

    def __init__(self, page: str):
        self.kind, self.names, self.parent, self.key = ["#root"], [""], [-1], [0]
        self.never, self.within = [False], [False]  # within: inside an article
        self.pieces: list[tuple[int, str, bool]] = []  # container, text (" " at a block's edge), in a link
        stack, link = [0], 0
        opened: dict[str, int] = {}  # elements of the stack by name
        for what, name, names in tokens(page):
            if what == "text":
                self.pieces.append((stack[-1], name, link > 0))
                continue
            if name in BLOCK:
                self.pieces.append((stack[-1], " ", False))
            if name == "a":
                link = max(0, link + (1 if what == "open" else -1))
            if what == "open":
                if name in BLOCK and self.kind[stack[-1]] == "p":
                    stack.pop()  # a block ends an open paragraph
                    opened["p"] -= 1
                # inside a part, elements of its own name are followed, so that their ends don't end it
                if name in VOID or not (name in CONTAINER or is_part(name, names) or name == self.kind[stack[-1]]):
                    continue
                self.kind.append(name)
                self.names.append(names)
                self.parent.append(stack[-1])
                self.key.append(key_of(self.key[stack[-1]], f"{name} {names}"))
                self.within.append(self.within[stack[-1]] or self.kind[stack[-1]] == "article")
                self.never.append(self.never[stack[-1]] or self._out(name, names, stack))
                stack.append(len(self.kind) - 1)
                opened[name] = opened.get(name, 0) + 1
            elif opened.get(name):
                for i in range(len(stack) - 1, 0, -1):
                    if self.kind[stack[i]] == name:
                        for gone in stack[i:]:
                            opened[self.kind[gone]] -= 1
                        del stack[i:]
                        break
                    if self.kind[stack[i]] in ("article", "main", "body") and name not in ("body", "html"):
                        break  # a stray closing tag doesn't close the article

    def _out(self, name: str, names: str, stack: list[int]) -> bool:
        if name == "header" and (self.within[stack[-1]] or self.kind[stack[-1]] == "article") and not is_part("div", names):
            return False  # the heading of an article is part of it
        return name not in ("article", "main", "body") and is_part(name, names)

    def text(self, fixed: dict[int, int] = {}, drop: frozenset[int] = frozenset(), content: frozenset[int] = frozenset()) -> str:  # noqa: B006
        """Main text. fixed: text by key of containers that go where they have it; drop: keys of those that always go;
        content: keys of the wrapper's content."""
        n = len(self.kind)
        out = [self.never[i] or (i > 0 and self.key[i] in drop) for i in range(n)]
        if any(k in fixed for k in self.key):
            gone = {key for key, text, *_ in self.parts() if fixed.get(key) == text}
            for i in range(1, n):
                out[i] = out[i] or self.key[i] in gone
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]]
        root = self._main(out, content)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in root or (i > 0 and inside[self.parent[i]])
        return " ".join("".join([t for c, t, _ in self.pieces if inside[c] and not out[c]]).split())

    def parts(self) -> list[tuple[int, int, int, int, bool]]:
        """(key, hash of the text, characters, those in links, inside an article) of the containers that have text, those
        of one key together.

        A container's pieces follow on each other, so its hash and its numbers are differences of sums over all pieces:
        the steps grow with pieces and containers, however deep these are nested.
        """
        n = len(self.kind)
        first, last = [-1] * n, [0] * n
        sums, powers, chars, links = [0], [1], [0], [0]
        for c, t, link in self.pieces:
            if t.strip():
                t, at = " ".join(t.split()), len(chars) - 1
                first[c] = at if first[c] < 0 else first[c]
                last[c] = at + 1
                sums.append((sums[-1] * STEP + text_key(t)) % PRIME)
                powers.append(powers[-1] * STEP % PRIME)
                chars.append(chars[-1] + len(t))
                links.append(links[-1] + (len(t) if link else 0))
        for i in range(n - 1, 0, -1):
            if first[i] >= 0:
                up = self.parent[i]
                first[up] = first[i] if first[up] < 0 else min(first[up], first[i])
                last[up] = max(last[up], last[i])
        found: dict[int, list] = {}
        for i in range(1, n):
            if first[i] >= 0 and self.kind[i] not in ("article", "main", "body", "head"):
                a, b = first[i], last[i]
                x = found.setdefault(self.key[i], [0, 0, 0, self.within[i]])
                own = (sums[b] - sums[a] * powers[b - a]) % PRIME
                x[:3] = (x[0] * powers[b - a] + own) % PRIME, x[1] + chars[b] - chars[a], x[2] + links[b] - links[a]
        return [(key, *x) for key, x in found.items()]

    def _main(self, out: list[bool], content: frozenset[int]) -> set[int]:
        """Outermost articles that are not out; else the first main element; else the wrapper's content; else the
        container with most text."""
        found = [i for i, k in enumerate(self.kind) if k == "article" and not out[i]]
        if found:
            inside = self._inside(set(found))
            return {i for i in found if not inside[i]}
        found = [i for i, k in enumerate(self.kind) if k == "main" and not out[i]]
        if found:
            return {found[0]}
        found = [i for i in range(1, len(self.key)) if self.key[i] in content and not out[i]]
        if found:
            return set(found)
        size = [0.0] * len(self.kind)
        for c, t, link in self.pieces:
            if not out[c]:
                size[c] += -len(t) / 2 if link else len(t.strip())
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += max(0.0, size[i])
        at, children = 0, [[] for _ in self.kind]
        for i in range(1, len(self.parent)):
            children[self.parent[i]].append(i)
        while True:  # down to the container that has nearly all of its parent's text
            below = [i for i in children[at] if size[i] >= 0.8 * size[at] > 0]
            if not below:
                return {at}
            at = max(below, key=lambda i: size[i])

    def _inside(self, nodes: set[int]) -> list[bool]:
        """Whether a container is inside one of some others."""
        inside = [False] * len(self.kind)
        for i in range(1, len(self.kind)):
            inside[i] = inside[self.parent[i]] or self.parent[i] in nodes
        return inside


# wrappers -------------------------------------------------------------------------------------------------------------
# nodes: ("tag", token, place), ("text", hash of the text or None for a slot), ("opt", nodes), ("rep", nodes); a place is
# what a text behind the tag stands in: (element, key of the container, whether in a part)


def stream(page: str) -> list[tuple]:
    """Nodes of a page: tags, and texts that are not only white space."""
    out, stack, count = [], [("#root", 0, False)], {}
    for what, name, names in tokens(page):
        if what == "text":
            if text := " ".join(name.split()):
                out.append(("text", text_key(text)))
            continue
        if what == "close":
            if count.get(name):
                while (last := stack.pop()[0].split()[0]) != name:
                    count[last] -= 1
                count[name] -= 1
        elif name not in VOID:
            label, (_, key, part) = f"{name} {names}".strip(), stack[-1]
            inner = name in CONTAINER or is_part(name, names)
            stack.append((label, key_of(key, f"{name} {names}") if inner else key, part or is_part(name, names)))
            count[name] = count.get(name, 0) + 1
        out.append(("tag", f"{what} {name} {names}".strip(), stack[-1]))
    return fold(out)


def _key(node: tuple):
    if node[0] == "tag":
        return node
    return ("text",) if node[0] == "text" else (node[0], tuple(map(_key, node[1])))


def fold(nodes: list[tuple], short: int = 12) -> list[tuple]:
    """Units of tags and texts that follow themselves become a repeated group, shorter units first, whatever their length.

    Units of up to `short` nodes are looked for at every place, longer ones where a node comes again.
    """
    numbers: dict = {}
    keys = [numbers.setdefault(_key(x), len(numbers)) for x in nodes]
    while True:
        before = len(nodes)
        nodes, keys = _fold_long(*_fold_short(nodes, keys, numbers, short), numbers, short)
        if len(nodes) == before:
            return nodes


def _unit(nodes: list[tuple], keys: list[int], numbers: dict, at: int, size: int, n: int) -> tuple[tuple, int]:
    """One group for the n units of `size` nodes from a place on, and its number."""
    unit = nodes[at : at + size]
    for k in range(1, n):
        unit = [_meet(a, b) for a, b in zip(unit, nodes[at + k * size : at + (k + 1) * size])]
    if size == 1 and unit[0][0] == "rep":
        return unit[0], keys[at]
    return ("rep", unit), numbers.setdefault(("rep", tuple(keys[at : at + size])), len(numbers))


def _fold_short(nodes: list[tuple], keys: list[int], numbers: dict, longest: int) -> tuple[list[tuple], list[int]]:
    for size in range(1, longest + 1):
        out, named, i, done = [], [], 0, 0
        last = len(nodes) - size
        while i < last:
            if keys[i] != keys[i + size] or nodes[i][0] == "text" or keys[i : i + size] != keys[i + size : i + 2 * size]:
                i += 1
                continue
            n = 2
            while keys[i : i + size] == keys[i + n * size : i + (n + 1) * size]:
                n += 1
            unit, number = _unit(nodes, keys, numbers, i, size, n)
            out += [*nodes[done:i], unit]
            named += [*keys[done:i], number]
            i = done = i + n * size
        if done:
            nodes, keys = out + nodes[done:], named + keys[done:]
    return nodes, keys


def _fold_long(nodes: list[tuple], keys: list[int], numbers: dict, short: int) -> tuple[list[tuple], list[int]]:
    """Folds the units of the smallest length above `short` that follow themselves.

    Some node of such a unit comes again at just that distance, so only distances from a node to its next equal one are
    tried, and each stretch that is equal at a distance is walked once. A unit begins with an opening tag if it can.
    """
    seen: dict[int, int] = {}
    ways: dict[int, list[int]] = {}
    for i in range(len(keys) - 1, -1, -1):
        if (far := seen.get(keys[i], i) - i) > short:
            ways.setdefault(far, []).append(i)
        seen[keys[i]] = i
    for size in sorted(ways):
        out, named, done, walked = [], [], 0, 0
        for i in reversed(ways[size]):
            if i < walked:
                continue
            low = i
            while low > walked and keys[low - 1] == keys[low - 1 + size]:
                low -= 1
            walked = i
            while walked + size < len(keys) and keys[walked] == keys[walked + size]:
                walked += 1
            starts = range(max(low, done), walked - size + 1)
            at = next((k for k in starts if nodes[k][0] == "tag" and nodes[k][1].startswith("open")), next((k for k in starts if nodes[k][0] != "text"), None))
            if at is not None:
                n = 1 + (walked - at) // size
                unit, number = _unit(nodes, keys, numbers, at, size, n)
                out += [*nodes[done:at], unit]
                named += [*keys[done:at], number]
                done = at + n * size
        if done:
            return out + nodes[done:], named + keys[done:]
    return nodes, keys


def _meet(a: tuple, b: tuple) -> tuple:
    """One node for two with equal keys: texts that differ become a slot."""
    if a[0] == "tag":
        return a
    if a[0] == "text":
        return a if a[1] == b[1] else ("text", None)
    return a[0], [_meet(x, y) for x, y in zip(a[1], b[1])]


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j), rising, with a[i] == b[j]: the longest run of keys that are in each but once, and between them
    each next key that the other side still has. Takes n log n steps."""
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    times: dict = {}
    for x in a:
        times[x] = times.get(x, 0) + 1
    once = [(i, places[x][0]) for i, x in enumerate(a) if times[x] == 1 and len(places.get(x, ())) == 1]
    tops, ends, before = [], [], [-1] * len(once)
    for n, (_, j) in enumerate(once):  # longest rising run of j
        at = bisect_left(tops, j)
        before[n] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [j], [n]
    anchors, n = [], ends[-1] if ends else -1
    while n >= 0:
        anchors.append(once[n])
        n = before[n]
    out, i, j = [], 0, 0
    for stop_i, stop_j in [*reversed(anchors), (len(a), len(b))]:
        while i < stop_i:
            found = places.get(a[i], ())
            at = bisect_left(found, j)
            if at < len(found) and found[at] < stop_j:
                out.append((i, found[at]))
                j = found[at] + 1
            i += 1
        if stop_i < len(a):
            out.append((stop_i, stop_j))
        i, j = stop_i + 1, stop_j + 1
    return out


def _place(node: tuple, before: tuple | None) -> tuple | None:
    """What a text behind a node stands in."""
    if node[0] == "tag":
        return node[2]
    for x in reversed(node[1] if node[0] != "text" else ()):
        if x[0] != "text":
            return _place(x, before)
    return before


def _names(nodes: list[tuple]) -> list[tuple]:
    """Keys of nodes by which they are aligned, those of texts with what they stand in."""
    out, place = [], None
    for x in nodes:
        out.append(("text", place) if x[0] == "text" else _key(x))
        place = _place(x, place)
    return out


def align(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The wrapper generalised to a page or to another wrapper: mismatches become slots, repeated or optional groups."""
    bare, other = ([x[1][0] if x[0] == "opt" else x for x in side] for side in (wrapper, page))
    keys, others = _names(bare), _names(other)
    out, i, j = [], 0, 0
    for k, m in [*matches(keys, others), (len(wrapper), len(page))]:
        for side, names in ((wrapper[i:k], keys[i:k]), (page[j:m], others[j:m])):
            unit = [_key(y) for y in out[-1][1]] if out and out[-1][0] == "rep" else None
            out += [x if x[0] == "opt" else ("opt", [x]) for x, name in zip(side, names) if unit != [name]]
        if k < len(wrapper):
            met = _meet(bare[k], other[m])
            out.append(("opt", [met]) if "opt" in (wrapper[k][0], page[m][0]) else met)
        i, j = k + 1, m + 1
    return out


def structure(nodes: list[tuple]) -> bytes:
    """Hash of a stream without its texts."""
    return blake2b(repr([_key(x) for x in nodes]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def meet(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """One stream for two of one structure; in whatever order some are taken, the result is the same."""
    return [_meet(x, y) for x, y in zip(a, b)]


def part_of(key: bytes) -> int:
    """Part of its host that a structure is in; rises with the structure."""
    return key[0] * PARTS_OF_HOST // 256


def align_all(wrappers: Iterable[list[tuple]]) -> list[tuple]:
    """Wrapper of some in turn. Those made of about as many are aligned with each other, so what all of them have is read
    again but as often as the logarithm of their number."""
    made: list[tuple[int, list[tuple]]] = []
    for wrapper in wrappers:
        n = 1
        while made and made[-1][0] <= n:
            m, before = made.pop()
            n, wrapper = n + m, align(before, wrapper)
        made.append((n, wrapper))
    wrapper = made.pop()[1] if made else []
    while made:
        wrapper = align(made.pop()[1], wrapper)
    return wrapper


def infer(pages: Iterable[str]) -> list[tuple]:
    """Wrapper of all pages of a host, in any order."""
    found: dict[bytes, list[tuple]] = {}
    for page in pages:
        nodes = stream(page)
        key = structure(nodes)
        found[key] = meet(found[key], nodes) if key in found else nodes
    parts: dict[int, list] = {}
    for key in sorted(found):
        parts.setdefault(part_of(key), []).append(found[key])
    return align_all(align_all(p) for p in parts.values())


def groups(wrapper: list[tuple]) -> tuple[list[int], list[int]]:
    """(threads, content): keys of the containers of a wrapper that repeat as reader comments do, and of its content.

    A thread is a repeated container, behind the first block with a text slot, whose unit has a text slot under an
    element with a class of its own (or time, cite) and another one under a block. The content is the container that
    most slots of blocks stand in directly, threads left out; a slot of a repeated group counts twice.
    """
    threads: set[int] = set()
    slots: list[tuple[int, int]] = []  # container and times of each slot of a block
    state = {"place": ("#root", 0, False), "text": False}

    def slot(unit):
        element, key, out = state["place"]
        if out:
            return
        block = element.split()[0] in BLOCK
        state["text"] = state["text"] or block
        if unit is not None:
            unit.add((" " in element or element in ("time", "cite"), block))
        if block:
            slots.append((key, 1 if unit is None else 2))

    def walk(nodes, unit):
        for x in nodes:
            if x[0] == "text":
                if x[1] is None:
                    slot(unit)
            elif x[0] == "tag":
                state["place"] = x[2]
            elif x[0] == "opt":
                walk(x[1], unit)
            else:
                first = x[1][0][1].split() if x[1][0][0] == "tag" else ["", ""]
                behind, own, before = state["text"], set(), len(slots)
                walk(x[1], own)
                if unit is not None:
                    unit |= own
                told = any(named for named, _ in own) and any(block and not named for named, block in own) and len(own) > 1
                if behind and told and first[0] == "open" and first[1] in CONTAINER and first[2:]:
                    threads.add(x[1][0][2][1])
                    del slots[before:]

    walk(wrapper, None)
    sizes: dict[int, int] = {}
    for key, n in slots:
        sizes[key] = sizes.get(key, 0) + n
    best = max(sizes.items(), key=lambda x: (x[1], x[0]), default=None)
    return sorted(threads), [best[0]] if best and best[0] else []


# Spark ----------------------------------------------------------------------------------------------------------------


def _streams(batches):
    """(host, part, structure, nodes, low, high): streams of pages, those of one structure met; the least and the largest
    hash of their pages."""
    found: dict[tuple[str, bytes], list] = {}
    held = 0
    for batch in batches:
        for host, h, page in zip(batch.column("host").to_pylist(), batch.column("h").to_pylist(), batch.column("html")):
            nodes = stream(page.as_py() or "")
            key = host, structure(nodes)
            if key in found:
                before, low, high = found[key]
                found[key] = [meet(before, nodes), min(low, h), max(high, h)]
                continue
            found[key] = [nodes, h, h]
            held += 1 + len(nodes)
            if held > HELD_NODES:
                yield from _rows((host, part_of(k), k, *x) for (host, k), x in found.items())
                found, held = {}, 0
    yield from _rows((host, part_of(k), k, *x) for (host, k), x in found.items())


_STREAMS = "host string, part int, structure binary, nodes binary, low long, high long"
_TYPES = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())


def _rows(rows, size: int = 64):
    """Batches of rows(host, part, structure, nodes, low, high)."""
    rows = [(*x[:3], pickle.dumps(x[3]), *x[4:]) for x in rows]
    for at in range(0, len(rows), size):
        columns = zip(*rows[at : at + size])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], [x.split()[0] for x in _STREAMS.split(", ")])


def _sorted_rows(batches):
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("host", "part", "structure", "nodes", "low", "high"))):
            host, part, key, nodes, low, high = (x.as_py() for x in row)
            yield host, part, key, pickle.loads(nodes), low, high


def _part_wrappers(batches):
    """Wrapper of each part of a host, from streams in the order of their structures; equal structures are met."""
    for (host, part), rows in groupby(_sorted_rows(batches), key=lambda x: x[:2]):
        seen: list[int] = []  # the least and the largest hash so far

        def streams(rows=rows, seen=seen):
            for _, same in groupby(rows, key=lambda x: x[2]):
                nodes = None
                for *_, more, low, high in same:
                    nodes = meet(nodes, more) if nodes is not None else more
                    seen[:] = min([low, *seen]), max([high, *seen])
                yield nodes

        wrapper = align_all(streams())
        yield from _rows([(host, part, b"", wrapper, *seen)])


def _host_groups(batches):
    """(host, threads, content) of each host, from the wrappers of its parts in their order."""
    for host, rows in groupby(_sorted_rows(batches), key=lambda x: x[0]):
        rows = list(rows)
        threads, content = groups(align_all(x[3] for x in rows))
        one_page = min(x[4] for x in rows) == max(x[5] for x in rows)
        learnt = [pa.array([threads], pa.list_(pa.int64())), pa.array([[] if one_page else content], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), *learnt], ["host", "threads", "content"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, threads, content): groups of each host's wrapper, inferred from all its pages; content from two pages on."""
    streams = pages.select("host", F.xxhash64("page_id", "url", "html").alias("h"), "html").mapInArrow(_streams, _STREAMS)
    parts = streams.repartition("host", "part").sortWithinPartitions("host", "part", "structure").mapInArrow(_part_wrappers, _STREAMS)
    parts = parts.repartition("host").sortWithinPartitions("host", "part")
    return parts.mapInArrow(_host_groups, "host string, threads array<long>, content array<long>")


def count_parts(pages: DataFrame) -> DataFrame:
    """(host, fixed, links) over all pages: containers with the same text on all pages that have them, and of links.

    Pages with equal texts count once, so copies of a page make nothing fixed. A container outside articles is fixed
    with two pages, one inside with AGREE (told by a bit each of 64, so by that many at least).
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for host, page in zip(batch.column("host")[at : at + 256].to_pylist(), batch.column("html")[at : at + 256]):
                    page = Page(page.as_py() or "")
                    bit = text_key(page.text()) & 63
                    bit = (1 << bit) - (1 << 64 if bit == 63 else 0)
                    rows += [(host, key, text, 2 * links > chars, within, bit) for key, text, chars, links, within in page.parts()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()))],
                    ["host", "key", "text", "links", "within", "bit"],
                )

    parts = pages.select("host", "html").mapInArrow(run, "host string, key long, text long, links boolean, within boolean, bit long")
    parts = parts.groupBy("host", "key").agg(
        F.min("text").alias("text"), (F.min("text") == F.max("text")).alias("same"), F.min("links").alias("links"),
        F.max("within").alias("within"), F.bit_count(F.bit_or("bit")).alias("pages"),
    )
    parts = parts.withColumn("fixed", F.col("same") & (F.col("pages") >= F.when(F.col("within"), AGREE).otherwise(2)))
    parts = parts.withColumn("links", F.col("links") & ~F.col("within")).filter("fixed OR links")
    one = lambda flag, value: F.collect_list(F.when(F.col(flag), value))
    return parts.groupBy("host").agg(one("fixed", F.struct("key", "text")).alias("fixed"), one("links", F.col("key")).alias("links"))


def extract_pages(spark: SparkSession, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    A null html counts as empty and gives an empty text. Pages without host, or with a null url, share one wrapper.
    Long pages are read whole, in time that grows with their length times its logarithm. Repeated rows give repeated
    results and count once for what is fixed; of two containers with as many slots the larger key is the content; an
    empty table gives no rows; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = infer_wrappers(pages).join(count_parts(pages), "host", "left")
    wrappers = scratch.save(wrappers, "wrappers")
    learnt = ["threads", "content", "fixed", "links"]
    if wrappers.count() <= BROADCAST_HOSTS:
        joined = pages.join(F.broadcast(wrappers), "host")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("salt", salt).join(wrappers.select("host", *learnt, salts), ["host", "salt"])

    def run(batches):
        for batch in batches:
            texts, known = [], {}
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"))):
                if host not in known:
                    threads, content, fixed, links = (batch.column(c)[i].as_py() or [] for c in learnt)
                    known[host] = {x["key"]: x["text"] for x in fixed}, frozenset([*threads, *links]), frozenset(content)
                texts.append(Page(page.as_py() or "").text(*known[host]))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", *learnt).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spark, table(spark, sf_dir, "pages"), Scratch(spark, "html"))
