"""Main text of pages by union-free wrapper inference.

1. A page is read into a token stream: block tags with their classes (inline tags and markup that shows nothing are
   left out, missing end tags are supplied) and text. What text a host's pages share is settled first: a text at the
   same element on 3 pages at least and on more than half of the host's pages is a literal of the template, any other
   text a slot. Pages with equal main text count as one, so copies make no template.
2. A host's distinct streams are aligned one after the other into its wrapper, level by level. Where all pages agree
   in number, neighbours keep their places and their slots stay apart, a literal paragraph apart from data. A
   mismatch is resolved: neighbours that differ in number become one repeated group; what only some pages have becomes
   optional, and if it also stands elsewhere in that level, all between becomes a repeated group. So a
   level is at most as long as its shortest page and its distinct elements are, however many pages there are.
   Streams are merged in bounded batches, batch results again, until each host has one wrapper.
3. On the wrapper each slot is told template or data: literals and repeated slots of link text (menus) are template, and
   so is what names itself menu, header, footer, sidebar, notice, advert, form or comment, weak names only where the
   wrapper has data outside of them.
4. The host's pages are parsed by the wrapper, and the words of their data slots are summed for each of its elements. The main
   region is the article or main element that holds data; where none is named so, it is found from the sums: from
   the top down, the one element, neither repeated nor a mere paragraph, that holds more than half of what its parent holds.
5. A page is parsed by the wrapper once more. Its text is what stands in the main region, without slots of link text that are
   template and without what names itself boilerplate; passages and headings that pages share stay. Where the region
   is the whole page, or the page lacks it, all template slots go, if the page has data slots too.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
Null or empty html, and html without text, give the empty text; a null url has the empty host. Broken tags end
at the next one; elements nested deeper than DEPTH are read as part of the one there; pages of any length are read
whole, repeated pages each, extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow, prepare
from .url_filter import split_url

#: Elements by how they stand in a page.
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp object canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements, and words in classes and ids, that name boilerplate, and those that do so less surely.
_BOILER = frozenset("head nav footer button select menu dialog".split())
_WEAK_BOILER = frozenset("header aside form fieldset label".split())
_HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer sidebar comment comments reply replies disqus cookie cookies consent notice notices alert popup modal newsletter subscribe subscription".split())
_WEAK_HINTS = frozenset("promo promotion side header masthead overlay share sharing social related recommended widget login signup search pagination pager toolbar skip gdpr".split())
#: What names an article or main element as none.
_NO_ARTICLE = frozenset("comment comments reply replies disqus ad ads adv advert adverts advertisement sponsored".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset(["ul", "ol", "dl", "table", "select"])
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*'|[\"'])*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
#: Streams that one task aligns at a time, and the deepest level that is aligned.
_BATCH, DEPTH = 64, 100
#: Entries above which a level of one page is taken as a list: its repeated elements are one group from the start.
_LIST = 256
#: Bytes of a table with a row for each host that may be broadcast; a larger one is joined, hot hosts dealt out.
BROADCAST_BYTES = 16 << 20
#: Rows of one host above which they are dealt to several tasks, and how many such hosts there are at most.
HOT_ROWS, HOT_HOSTS = 10_000, 20_000


class Block:
    """A text between tags; link: all of it is link text."""

    __slots__ = ("text", "link")

    def __init__(self, text: str, link: bool):
        self.text, self.link = text, link


#: Elements (label, content) and texts in order. A label is a mark (blank, ~ weakly or ! surely boilerplate), the region
#: (0 none, 1 main, 2 article), the element's name and its classes without digits.
Tree = list["tuple[str, Tree] | Block"]


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if _TELLING.search(text):
        for m in _ATTRIBUTE.finditer(text):
            found.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return found


def _label(name: str, attributes: str) -> str:
    found = _attributes(attributes) if attributes else {}
    role, region = found.get("role", "").lower(), {"article": 2, "main": 1}.get(name, 0)
    names = set(re.split(r"[^a-zA-Z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower())) if found else ()
    region = region or int(role == "main")
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        mark = "!"
    elif region:
        mark = "!" if not _NO_ARTICLE.isdisjoint(names) else " "
    elif name in ("html", "body"):
        mark = " "
    else:
        mark = "!" if name in _BOILER or role in _ROLES or not _HINTS.isdisjoint(names) else "~" if name in _WEAK_BOILER or not _WEAK_HINTS.isdisjoint(names) else " "
    return f"{mark}{region}{name}" + "".join(f".{c}" for c in sorted(re.sub(r"\d+", "0", found.get("class", "").lower()).split()))


def _end_of(page: str, name: str, at: int) -> int:
    """Where the element that opened before ``at`` ends: its end tag, elements of the same name inside skipped."""
    open_ = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.IGNORECASE).finditer(page, at):
        open_ += -1 if m[1] else 1
        if not open_:
            return m.start()
    return len(page)


#: Elements that say nothing of their content, and those that are lists or running text.
_BARE, _RUNNING = frozenset(["div", "section"]), frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def _shaped(tree: Tree) -> Tree:
    """Elements without a telling name or class are told apart by what is in them: running text, lists, text alone."""
    out: Tree = []
    for x in tree:
        if not isinstance(x, Block):
            label, inner = x[0], _shaped(x[1])
            if label[:2] == " 0" and label[2:] in _BARE:
                names = {re.split(r"[.{]", y[0][2:])[0] for y in inner if not isinstance(y, Block)}
                label += "{text" if not names else "{running" if names & _RUNNING else "{list" if names <= _LISTS else "{parts"
            x = (label, inner)
        out.append(x)
    return out


def read(page: str) -> Tree:
    """A page as a tree of block elements and texts."""
    return _shaped(_read(page))


def _read(page: str) -> Tree:
    root: Tree = []
    stack: list[tuple[str, Tree]] = []
    here = root
    parts: list[str] = []
    linked = plain = False
    in_link = 0

    def flush() -> None:
        nonlocal linked, plain
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                here.append(Block(text, linked and not plain))
        linked = plain = False

    def add(text: str) -> None:
        nonlocal linked, plain
        text = html.unescape(text)
        parts.append(text)
        if in_link:
            linked = True
        elif not plain and not text.isspace():
            plain = True

    def close(upto: int) -> None:
        nonlocal here
        del stack[upto:]
        here = stack[-1][1] if stack else root

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, start)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        at = m.end()
        ending, name, attributes = m[1] == "/", m[2].lower(), m[3]
        if name in _INLINE:
            if name == "a":
                in_link = int(not ending)
            if not ending and attributes and stack and _TELLING.search(attributes) and _label(name, attributes)[0] == "!":
                at = _end_of(page, name, at)  # an inline element that names itself boilerplate: skip what it holds
            continue
        if name in _RAW:
            if not ending and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = n if end is None else max(page.find(">", end.start()) + 1, end.end())
            continue
        flush()
        if name in _VOID:
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in _SELF_CLOSING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SELF_CLOSING[name]:
                    close(k)
                    break
                if stack[k][0] in _LISTS:
                    break
        if attributes.rstrip().endswith("/"):
            continue
        if len(stack) < DEPTH:
            content: Tree = []
            here.append((_label(name, attributes), content))
            here = content
        stack.append((name, here))
    flush()
    return root


def _hash(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


# ---------------------------------------------------------------- streams

#: A level of a wrapper: entries (quantity, nodes), a node being (key, level). Quantity 1: neighbours of one key, each in
#: its place; ?: the same, on some pages only; +: a group that repeats, one node for each key. Keys: an element's
#: label, ``#`` for a text, ``@`` for link text, ``=`` and a hash for a literal, which also goes to the key of an element
#: that holds nothing else.
Level = list


def tokens(tree: Tree, parent: str = "") -> Iterator[str]:
    """A page's stream without its texts: ``<label``, ``>``, and for a text ``#`` or ``@`` and its hash at this element."""
    for node in tree:
        if isinstance(node, Block):
            yield ("@" if node.link else "#") + _hash(f"{parent}\0{node.text}")
        else:
            yield "<" + node[0]
            yield from tokens(node[1], node[0])
            yield ">"


def _runs(nodes: list) -> Level:
    """Neighbours of one key as one entry."""
    out: Level = []
    for node in nodes:
        if out and out[-1][1][0][0] == node[0]:
            out[-1][1].append(node)
        else:
            out.append(["1", [node]])
    return out


def _page_level(nodes: list) -> Level:
    runs = _runs(nodes)
    return _regroup(runs, True) if len(runs) > _LIST else runs


def _node(label: str, content: list) -> list:
    literal = content[0][0] if len(content) == 1 and content[0][0][0] == "=" else ""
    return [label + literal, _page_level(content)]


def level_of(stream: list[str], literals: frozenset[str]) -> Level:
    """The level of a page's stream; texts in literals stay as they are, the others become slots."""
    stack: list[tuple[str, list]] = [("", [])]
    for t in stream:
        if t[0] == "<":
            stack.append((t[1:], []))
        elif t[0] == ">":
            label, content = stack.pop()
            stack[-1][1].append(_node(label, content))
        else:
            stack[-1][1].append(["=" + t[1:] if t[1:] in literals else t[0], []])
    return _page_level(stack[0][1])


# ---------------------------------------------------------------- alignment


def _keys(entry: list) -> set[str]:
    return {entry[1][0][0]} if entry[0] != "+" else {k for k, _ in entry[1]}


def match(a: Level, b: Level) -> list[tuple[int, int]]:
    """The best alignment of two levels: pairs of entries that share a key, in order; a group may meet several."""
    ka, kb = [_keys(e) for e in a], [_keys(e) for e in b]
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head][0] != "+" and b[head][0] != "+" and ka[head] == kb[head] and len(a[head][1]) == len(b[head][1]):
        head += 1
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, head - 1, -1):
        row, below = best[i], best[i + 1]
        many = a[i][0] == "+"
        for j in range(m - 1, head - 1, -1):
            score = max(below[j], row[j + 1])
            if not ka[i].isdisjoint(kb[j]):
                gain = 3 if many or b[j][0] == "+" or len(a[i][1]) == len(b[j][1]) else 2
                score = max(score, gain + max(below[j + 1], row[j + 1] if many else 0, below[j] if b[j][0] == "+" else 0))
            row[j] = score
    pairs = [(k, k) for k in range(head)]
    i = j = head
    while i < n and j < m:
        if not ka[i].isdisjoint(kb[j]):
            many = a[i][0] == "+"
            gain = 3 if many or b[j][0] == "+" or len(a[i][1]) == len(b[j][1]) else 2
            rest = best[i][j] - gain
            if rest == best[i + 1][j + 1]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
                continue
            if many and rest == best[i][j + 1]:
                pairs.append((i, j))
                j += 1
                continue
            if b[j][0] == "+" and rest == best[i + 1][j]:
                pairs.append((i, j))
                i += 1
                continue
        if best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _group(*entries: list) -> list:
    """One repeated group of all nodes, those of one key aligned into one."""
    nodes: dict[str, Level] = {}
    for _, part in entries:
        for key, level in part:
            nodes[key] = align(nodes[key], level) if key in nodes else level
    return ["+", [[k, v] for k, v in nodes.items()]]


def _joined(x: list, y: list) -> list:
    if "+" not in (x[0], y[0]) and len(x[1]) == len(y[1]):
        return ["?" if "?" in (x[0], y[0]) else "1", [[k, align(p, q)] for (k, p), (_, q) in zip(x[1], y[1], strict=True)]]
    return _group(x, y)


def _regroup(level: Level, all_: bool = False) -> Level:
    """Repeated groups for optional entries (all_: any entries) whose key stands elsewhere in the level too, with what is
    between; neighbours of a group that it holds join it."""
    while True:
        at: dict[str, list[int]] = {}
        for i, e in enumerate(level):
            for k in _keys(e):
                at.setdefault(k, []).append(i)
        spans = []
        for places in at.values():
            for i, j in zip(places, places[1:], strict=False):
                x, y = level[i][0], level[j][0]
                if all_ or "?" in (x, y) or (x == y == "+") or (j == i + 1 and "+" in (x, y)):
                    spans.append((i, j))
        if not spans:
            return level
        spans.sort()
        out, done = [], 0
        while spans:
            low, high = spans.pop(0)
            while spans and spans[0][0] <= high:
                high = max(high, spans.pop(0)[1])
            out += [*level[done:low], _group(*level[low : high + 1])]
            done = high + 1
        level = out + level[done:]


def align(a: Level, b: Level) -> Level:
    """The wrapper of both levels."""
    if a == b:
        return a
    out: Level = []
    i = j = at = 0
    last = (-1, -1)
    for x, y in match(a, b):
        for e in (*a[i:x], *b[j:y]):  # on one side only
            out.append(["?", e[1]] if e[0] == "1" else e)
        if x == last[0] or y == last[1]:  # a group goes on; what stood between is in it
            out[at:] = [_group(*out[at:], b[y] if x == last[0] else a[x])]
        else:
            at = len(out)
            out.append(_joined(a[x], b[y]))
        i, j, last = x + 1, y + 1, (x, y)
    for e in (*a[i:], *b[j:]):
        out.append(["?", e[1]] if e[0] == "1" else e)
    return _regroup(out)


def pattern(level: Level) -> str:
    """A wrapper as a union-free regular expression, for reading."""
    out = []
    for quantity, nodes in level:
        for part in [nodes] if quantity == "+" else [[n] for n in nodes]:
            inner = " ".join(k[0] if k[0] in "#@=" else f"<{k[2:].split('=')[0]}>{pattern(v)}</>" for k, v in part)
            out.append(inner if quantity == "1" else f"({inner}){quantity}")
    return " ".join(out)


# ---------------------------------------------------------------- extraction


class Wrapper:
    """A host's wrapper, ready to parse pages."""

    def __init__(self, level: Level, literals: frozenset[str], region: str = ""):
        self.level, self.literals = level, literals
        #: the path of the main region ("" the whole page), or what ``region_of`` calls a named one
        self.region = region
        #: weak names count only where there is data outside of what they name
        self.weak = self._data(level)
        self._seen: dict[tuple, list] = {}

    def _data(self, level: Level) -> bool:
        return any(k == "#" or (k[0] == " " and self._data(v)) for _, nodes in level for k, v in nodes)

    def places(self, level: Level, runs: Level) -> list:
        """For each node of a page's level the wrapper's node, whether it repeats, and its step in a path of the wrapper."""
        key = (id(level), tuple((e[0], e[1][0][0], len(e[1])) for e in runs))
        if key not in self._seen:
            if len(self._seen) >= 2048:
                self._seen.clear()
            met: dict[int, list[int]] = {}
            for i, j in match(level, runs):
                met.setdefault(j, []).append(i)
            out = []
            for j, (_, nodes) in enumerate(runs):
                for p, (k, _) in enumerate(nodes):
                    found = None
                    for i in met.get(j) or [i for i, e in enumerate(level) if k in _keys(e)]:
                        quantity, own = level[i]
                        at = 0 if quantity == "+" else min(p, len(own) - 1)
                        node = dict(own).get(k) if quantity == "+" else own[at][1]
                        if node is not None:
                            found = (node, quantity == "+" or len(own) > 1, f"{i}.{at}{'+' if quantity == '+' else ''}{k}".replace("/", ""))
                            break
                    out.append(found or ([], False, f"?{k}".replace("/", "")))
            self._seen[key] = out
        return self._seen[key]

    def slots(self, tree: Tree, met: dict[str, int] | None = None) -> Iterator[tuple[Block, str, int, str]]:
        """Of each text of a page: the path of its element, its named region, and what of the template it is (blank: it is data; =:
        literal, @: link text, !: named boilerplate). met counts the page's elements by their paths."""

        def content(nodes: Tree, label: str) -> list:
            out = []
            for x in nodes:
                if isinstance(x, Block):
                    h = _hash(f"{label}\0{x.text}")
                    out.append(["=" + h if h in self.literals else "@" if x.link else "#", x])
                else:
                    inner = content(x[1], x[0])
                    out.append([x[0] + (inner[0][0] if len(inner) == 1 and inner[0][0][0] == "=" else ""), inner])
            return out

        def walk(nodes: list, level: Level, path: str, region: int, mark: str, repeated: bool) -> Iterator[tuple[Block, str, int, str]]:
            for (key, x), (inner, again, step) in zip(nodes, self.places(level, _runs(nodes)), strict=True):
                if isinstance(x, Block):
                    named = mark == "!" or (mark == "~" and self.weak)
                    yield x, path, region, "!" if named else "@" if x.link and (key[0] == "=" or repeated or again) else "=" if key[0] == "=" else " "
                else:
                    if met is not None:
                        met[f"{path}/{step}"] = met.get(f"{path}/{step}", 0) + 1
                    yield from walk(x, inner, f"{path}/{step}", max(region, int(key[1])), max(mark, key[0], key=" ~!".index), repeated or again)

        yield from walk(content(tree, ""), self.level, "", 0, " ", False)

    def volumes(self, tree: Tree) -> dict[tuple[str, int], tuple[int, int]]:
        """Words of a page's data slots by element, with its named region, and how many such elements the page has; an element
        counts what is anywhere in it."""
        out: dict[tuple[str, int], int] = {}
        met: dict[str, int] = {}
        for block, path, region, template in self.slots(tree, met):
            if template == " ":
                words, steps = len(block.text.split()), path.split("/")
                for n in range(1, len(steps) + 1):
                    key = ("/".join(steps[:n]), region if n == len(steps) else 0)
                    out[key] = out.get(key, 0) + words
        return {key: (words, met.get(key[0], 1)) for key, words in out.items()}


def region_of(volumes: list[tuple[str, int, int, int]]) -> str:
    """The main region of a host from (path, named region, words, most on a page) of its elements: "2" or "1" for the articles or main
    elements, else the path of an element, "" for the whole page."""
    named = max((region for _, region, words, _ in volumes if words), default=0)
    if named:
        return str(named)
    total: dict[str, int] = {}
    once: dict[str, bool] = {}
    for path, _, words, most in volumes:
        total[path], once[path] = total.get(path, 0) + words, once.get(path, True) and most == 1
    inside: dict[str, list[str]] = {}
    for path in total:
        if path:
            inside.setdefault(path.rsplit("/", 1)[0], []).append(path)
    here = ""
    while True:
        # an element that holds elements, one on each page
        top = max((p for p in inside.get(here, []) if p in inside and once[p]), key=lambda p: (total[p], p), default=None)
        if top is None or 2 * total[top] <= total.get(here, 0):
            return "" if here.endswith((" 0html", " 0body")) else here
        here = top


def _blocks(tree: Tree) -> Iterator[Block]:
    for x in tree:
        if isinstance(x, Block):
            yield x
        else:
            yield from _blocks(x[1])


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """Main text of a page of the wrapper's host; without a wrapper nothing is known to be template, and all text stays."""
    if not page:
        return ""
    tree = read(page)
    if wrapper is None:
        return " ".join(b.text for b in _blocks(tree))
    slots = list(wrapper.slots(tree))
    named = wrapper.region.isdigit()
    around = wrapper.region and [s for s in slots if s[3] in " =" and (s[2] == int(wrapper.region) if named else f"{s[1]}/".startswith(f"{wrapper.region}/"))]
    if around:
        return " ".join(s[0].text for s in around)
    # no region of its own on this page: its data; a page that is template all over stays as it is, but for named boilerplate
    kept = [s for s in slots if s[3] == " "] or [s for s in slots if s[3] != "!"]
    return " ".join(s[0].text for s in kept)


# ---------------------------------------------------------------- jobs


def with_host(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """rows, each with its host's row of table (one a host). A small table is broadcast, after a sum of its bytes; for
    a larger one rows of hot hosts are dealt out by their key, the host's row copied to each part."""
    sized = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if f.dataType.typeName() == "array" else F.col(c)), F.lit(0)) for c, f in ((f.name, f) for f in table.schema) if f.dataType.typeName() in ("array", "string")]
    size = table.agg(F.sum(sum(sized, F.lit(64)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "host", "left")
    counts = rows.groupBy("host").count()
    limit = max(HOT_ROWS, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_HOSTS)
    fans = cut(counts.where(F.col("count") > limit).select("host", F.ceil(F.col("count") / limit).cast("int").alias("host_fan")))  # HOT_HOSTS rows at most
    part = F.pmod(F.xxhash64(*key), F.coalesce("host_fan", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(fans), "host", "left").withColumn("host_part", part).drop("host_fan")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("host_fan", F.lit(1)) - 1))
    table = table.join(F.broadcast(fans), "host", "left").withColumn("host_part", parts).drop("host_fan")
    return rows.join(table, ["host", "host_part"], "left").drop("host_part")


def skeletons(pages: DataFrame) -> DataFrame:
    """Of each page with text (host, html): host, its stream without texts, the hashes of its texts, and ``same``, equal for
    pages whose main text is."""

    def main(tree: Tree, region: int, out: dict[int, list[str]]) -> None:
        for x in tree:
            if isinstance(x, Block):
                out.setdefault(region, []).append(x.text)
            elif x[0][0] == " ":
                main(x[1], max(region, int(x[0][1])), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, streams, hashes, same = [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = read(page) if page else []
                stream = list(tokens(tree))
                found = sorted({int(t[1:], 16) - (1 << 63) for t in stream if t[0] in "#@"})
                if not found:
                    continue
                regions: dict[int, list[str]] = {}
                main(tree, 0, regions)
                hosts.append(host)
                streams.append("\n".join(stream))
                hashes.append(found)
                same.append(int(_hash(" ".join(regions[max(regions)]) if regions else streams[-1]), 16) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(streams, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(same, pa.int64())], ["host", "stream", "hashes", "same"])

    return pages.mapInArrow(run, "host string, stream string, hashes array<long>, same long")


def literals(streams: DataFrame) -> DataFrame:
    """host, literals: the texts that stand on 3 pages at least and on more than half of the host's pages of different main
    text. A host has at most twice as many as its pages have texts on average."""
    once = streams.groupBy("host", "same").agg(F.min("hashes").alias("hashes"))
    once = cut(once)
    pages = once.groupBy("host").agg(F.count("*").alias("pages"))
    shared = once.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where("n >= 3")
    return cut(shared.join(pages, "host").where("2 * n > pages").groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("literals")))


def _literals(column: list[int] | None) -> frozenset[str]:
    return frozenset(f"{x + (1 << 63):016x}" for x in column or ())


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper, literals: one wrapper for each host with text. pages: host, html."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {(host, json.dumps(level_of(stream.split("\n"), _literals(known)), separators=(",", ":"))) for host, stream, known in zip(*[batch.column(c).to_pylist() for c in ("host", "stream", "literals")], strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in (0, 1)], ["host", "wrapper"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for text in sorted(group["wrapper"]):
            wrapper = json.loads(text) if wrapper is None else align(wrapper, json.loads(text))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(wrapper, separators=(",", ":"))]})

    streams = cut(skeletons(pages))
    known = literals(streams)
    kinds = "host string, wrapper string"
    wrappers = cut(with_host(streams.select("host", "stream"), known, ["stream"]).mapInArrow(levels, kinds).distinct())
    while True:
        fan = wrappers.groupBy("host").agg(F.ceil(F.count("*") / _BATCH).alias("fan"), F.count("*").alias("streams"))
        most = fan.agg(F.max("streams")).first()[0] or 0
        if most <= 1:
            return wrappers.join(known, "host", "left")
        dealt = with_host(wrappers, cut(fan), ["wrapper"])
        done, todo = dealt.where("streams = 1").select("host", "wrapper"), dealt.where("streams > 1").withColumn("deal", F.pmod(F.xxhash64("wrapper"), "fan"))
        wrappers = cut(done.unionByName(todo.groupBy("host", "deal").applyInPandas(merge, kinds)))


def _wrapper(held: dict[str, Wrapper], batch: pa.RecordBatch, i: int) -> Wrapper | None:
    """The wrapper of a row's host, kept for the next rows."""
    host = batch.column("host")[i].as_py()
    if host not in held and batch.column("wrapper")[i].is_valid:
        if len(held) >= 512:
            held.clear()
        region = batch.column("region")[i].as_py() if "region" in batch.schema.names else ""
        held[host] = Wrapper(json.loads(batch.column("wrapper")[i].as_py()), _literals(batch.column("literals")[i].as_py()), region or "")
    return held.get(host)


def regions(joined: DataFrame) -> DataFrame:
    """host, region. joined: host, html, wrapper, literals. Sums are made in each batch, then by element, so a host brings as
    many rows together as its wrapper has elements."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            total: dict[tuple[str, str, int], tuple[int, int]] = {}
            for i, (page, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                wrapper = _wrapper(held, batch, i) if page else None
                for (path, region), (words, most) in wrapper.volumes(read(page)).items() if wrapper else ():
                    before = total.get((host, path, region), (0, 0))
                    total[host, path, region] = (before[0] + words, max(before[1], most))
            columns = [[k[j] for k in total] for j in range(3)] + [[v[j] for v in total.values()] for j in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["host", "path", "named", "words", "most"])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(group["path"], group["named"].tolist(), group["words"].tolist(), group["most"].tolist(), strict=True))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "region": [region_of(rows)]})

    sums = joined.mapInArrow(weigh, "host string, path string, named int, words long, most int").groupBy("host", "path", "named").agg(F.sum("words").alias("words"), F.max("most").alias("most"))
    return sums.groupBy("host").applyInPandas(choose, "host string, region string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    prepare(pages.sparkSession)
    host, _ = split_url(F.col("url"))
    rows = narrow(pages, "page_id", "url", "html").withColumn("host", host)
    wrappers = cut(infer(rows.select("host", "html")))
    found = cut(regions(with_host(rows, wrappers, ["page_id", "url"]).select("host", "html", "wrapper", "literals")))
    wrappers = cut(wrappers.join(found, "host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            texts = [extract(page, _wrapper(held, batch, i) if page else None) for i, page in enumerate(batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = with_host(rows, wrappers, ["page_id", "url"]).select("page_id", "url", "host", "html", "wrapper", "literals", "region")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
