"""Main text of web pages through wrappers inferred for each host.

A page becomes a tree of block elements with the text directly in them. Pages of one host are aligned one after another
into a wrapper, a union-free regular expression over the tree: children that stand next to each other with one label,
or sequences of labels that recur at once, fold into a repeated group; children that one side lacks become optional;
texts that differ become text slots, and texts that all pages agree on stay constants. Partial wrappers are aligned in
the same way, so each task aligns its own pages and partial wrappers meet in two steps; the work on a large host is
spread. The wrapper then decides, for each of its groups:

- Constants of ``AGREE`` or more different pages are the host's own, no article text.
- Groups whose text is links for the most part, around a repeated group, are menus, unless their links differ from page to
  page and paragraphs of the article stand before and behind them.
- The article is where text slots outside of these hold most characters: down from the root to where that text splits
  up. An ``article`` or ``main`` element wins unless several times its text stands elsewhere.
- Names (class, id, role) settle what this leaves open: a group in the article named as an advert, comment, notice and
  the like goes, unless its slots hold so much of the host's article text that it must be part of it.

Only what an element is by HTML itself (scripts, styles, ``nav``, ``aside``, ``footer``, page ``header``, hidden ones)
goes without asking the wrapper. A form goes unless it holds a quarter of the host's article text or more, as where a whole
page stands in one. On a host of one page the wrapper is that page.

All steps take time in proportion to a page's size: trees are walked without recursion, alignment looks ``BAND``
siblings ahead, a wrapper node keeps ``MAX_KIDS`` groups and a stored wrapper ``MAX_NODES``, those with the least text
becoming part of the text slot of the group that they are in.

Defined cases: null or empty html, or a page with no text in its article, gives an empty text; a null or odd url is
a host of its own, ''; repeated rows each get a row and copies of a page speak once; unclosed elements end with their
parent; a tag that never ends is text; very long and very deep pages are read whole; other columns are not looked at;
an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import cut, map_rows

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?", re.I)
_HIDDEN = re.compile(r"display\s*+:\s*+none")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDS = frozenset("html body div section article main form table tbody tr td center ul ol dl".split())
#: Elements that are no article text by what they are.
_OUT = frozenset("head nav footer aside button select menu dialog object canvas".split()) | _RAW
#: Names that settle open cases, firmly and less so, and words that say nothing beside them.
_FIRM = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus newsletter popup promo promotion replies sidebar sponsor sponsored".split())
_SOFT = frozenset("banner breadcrumb breadcrumbs complementary contentinfo copyright footer form header login masthead modal nav navbar navigation notice notices related search share sharing signup social subscribe toolbar widget".split())
_NEUTRAL = frozenset("area bar block body box button buttons container content group item items js layer global inner left link links list main outer panel right row section site slot text top unit wrap wrapper".split())
#: Share of the host's article text from which on a group of such a name is part of the article.
SHARES = (0.0, 0.25, 0.5)
#: What an open element ends when it starts.
_ENDS = {"p": _BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
AGREE, BAND, MAX_KIDS, MAX_NODES, PERIOD = 3, 32, 64, 4000, 6
SALTS = (1024, 32)
#: Hosts' places are sent to all tasks up to this many, else joined.
MAX_SENT = 50_000


class Block:
    """A block element: ``items`` are its texts and blocks in order; ``linked`` counts characters inside links."""

    __slots__ = ("items", "label", "linked", "named", "tag")

    def __init__(self, tag: str, label: str, named: int):
        self.tag, self.label, self.named, self.items, self.linked = tag, label, named, [], 0

    def text(self) -> str:
        return _plain("".join(x for x in self.items if isinstance(x, str)))


def _named(value: str) -> int:
    """0, or how firmly a class, id or role says that the element is no article text."""
    words = [x.lower() for x in _NAME.findall(value)]
    said = [2 if w in _FIRM else 1 if w in _SOFT else 0 for w in words]
    return max(said, default=0) if all(s or w in _NEUTRAL or w.isdigit() for s, w in zip(said, words, strict=True)) else 0


def _attributes(tag: str, attrs: str) -> tuple[str, int, bool]:
    """Label, name and whether the element is hidden."""
    label, named, hidden = tag, 0, False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            named = max([named, *map(_named, value.split())])
            if name == "class":
                label = ".".join([tag, *sorted(_DIGITS.sub("0", x) for x in value.split())])
        elif name == "hidden" or _HIDDEN.search(value):
            hidden = True
    return label, 0 if tag in ("html", "body", "article", "main") else max(named, tag == "form"), hidden


def parse(page: str) -> Block:
    root = Block("#root", "#root", 0)
    # open elements: tag, the block that text goes to, whether nothing in it is wanted, whether in a link
    stack: list[tuple[str, Block, bool, bool]] = [("#root", root, False, False)]
    open_, blocks = Counter(), [0]
    quotes, at, size = True, 0, len(page)

    def pop() -> None:
        open_[stack.pop()[0]] -= 1
        while blocks[-1] >= len(stack):
            blocks.pop()

    def text(part: str) -> None:
        _, block, out, link = stack[-1]
        if not out:
            block.items.append(part)
            if link:
                block.linked += len(part)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        if lt > at:
            text(page[at:lt])
        at = lt
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            text(page[lt + 9 : size if end < 0 else end])
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            end = page.find(">", lt) if page[lt + 1 : lt + 2] in ("!", "?") else -2
            if end == -1:
                break
            if end == -2:
                text("<")
            at = lt + 1 if end == -2 else end + 1
            continue
        end = (_REST.match(page, m.end()) if quotes else None) or None
        if end is None:
            quotes = False  # some quote never ends: from here on a tag ends at its first ">"
            stop = page.find(">", m.end())
            if stop < 0:
                break
            at = stop + 1
        else:
            at = end.end()
        tag, attrs = m[1].lower(), page[m.end() : at - 1]
        if page[lt + 1] == "/":
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        while len(stack) > 1 and tag in _ENDS.get(stack[-1][0], ()):
            pop()
        if tag in _BLOCK and tag not in ("html", "body"):  # an unclosed inline element ends with the paragraph that a block ends
            k = blocks[-1]
            if k and tag in _ENDS.get(stack[k][0], ()):
                while len(stack) > k:
                    pop()
        _, above, out, link = stack[-1]
        label, named, hidden = _attributes(tag, attrs) if attrs else (tag, int(tag == "form"), False)
        if not out:
            out = tag in _OUT or hidden or (tag == "header" and above.tag not in ("article", "main", "section")) or (tag not in _BLOCK and named == 2)
        block = above
        if tag == "br":
            text(" ")
        elif tag in _BLOCK and not out:
            block = Block(tag, label, named)
            above.items.append(block)
        if tag in _RAW and not attrs.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
        elif tag not in _VOID and not attrs.endswith("/"):
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append((tag, block, out, link or tag == "a"))
            open_[tag] += 1
    if at < size:
        text(page[at:])
    return root


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split()) if text else ""


class Group:
    """A group of a wrapper: an element with its quantifiers, what is known of the text in it, and its groups.

    ``text`` is None where no page has any, a number for a constant, -1 for a slot. ``seen`` has a bit for each page's
    longest text, so that copies of a page count once.
    """

    __slots__ = ("chars", "kids", "label", "linked", "named", "pages", "quant", "seen", "text")

    def __init__(self, label: str, quant: str, named: int, pages: int, chars: int, linked: int, text: int | None, seen: int):
        self.label, self.quant, self.named, self.pages, self.chars, self.linked, self.text, self.seen, self.kids = label, quant, named, pages, chars, linked, text, seen, []

    def row(self) -> list:
        return [self.label, self.quant, self.named, self.pages, self.chars, self.linked, self.text, self.seen]

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]


def _marked(quant: str, mark: str) -> str:
    return quant if mark in quant else quant + mark


def merge(a: Group, b: Group, within: bool = False) -> Group:
    """``a`` becomes the wrapper of what both stand for (of one page if ``within``); labels are equal."""
    due = deque([(a, b)])  # in order of depth, so that a group is complete before others are put into it
    while due:
        a_, b_ = due.popleft()
        for mark in b_.quant:
            a_.quant = _marked(a_.quant, mark)
        a_.named, a_.pages = max(a_.named, b_.named), max(a_.pages, b_.pages) if within else a_.pages + b_.pages
        a_.chars, a_.linked, a_.seen = a_.chars + b_.chars, a_.linked + b_.linked, a_.seen | b_.seen
        if a_.text is None or b_.text is None:
            a_.text = b_.text if a_.text is None else a_.text
        elif a_.text != b_.text:
            a_.text = -1
        if a_.kids or b_.kids:
            align(a_, b_.kids, due)
    return a


def align(a: Group, kids: list[Group], due: deque) -> None:
    """Puts ``kids`` into the groups of ``a``, equal labels in order; what one side lacks becomes optional."""
    x, y, i, j, out = a.kids, kids, 0, 0, []

    def put(g: Group, optional: bool) -> None:
        if optional:
            g.quant = _marked(g.quant, "?")
        if out and out[-1].label == g.label:
            out[-1].quant = _marked(out[-1].quant, "+")
            due.append((out[-1], g))
        else:
            out.append(g)

    while i < len(x) and j < len(y):
        if x[i].label == y[j].label:
            due.append((x[i], y[j]))
            put(x[i], False)
            i, j = i + 1, j + 1
            continue
        near: dict[str, int] = {}
        for k in range(j, min(j + BAND, len(y))):
            near.setdefault(y[k].label, k - j)
        _, di, dj = min(((di + near[x[i + di].label], di, near[x[i + di].label]) for di in range(min(BAND, len(x) - i)) if x[i + di].label in near), default=(0, 1, 1))
        for g in x[i : i + di]:
            put(g, True)
        for g in y[j : j + dj]:
            put(g, True)
        i, j = i + di, j + dj
    for g in (*x[i:], *y[j:]):
        put(g, True)
    a.kids = out
    if len(out) > MAX_KIDS:
        _to_slot(a)


def _under(g: Group) -> Iterator[Group]:
    todo = [g]
    while todo:
        x = todo.pop()
        yield x
        todo += reversed(x.kids)


def _to_slot(a: Group) -> None:
    """Of too many groups those of the fewest pages and characters become part of the text slot of ``a``."""
    order = sorted(range(len(a.kids)), key=lambda k: (-a.kids[k].pages, -a.kids[k].chars, k))
    for k in order[MAX_KIDS // 2 :]:
        for g in _under(a.kids[k]):
            a.chars, a.linked, a.text = a.chars + g.chars, a.linked + g.linked, -1
    a.kids = [a.kids[k] for k in sorted(order[: MAX_KIDS // 2])]


def fold(g: Group) -> None:
    """Sequences of 1 to ``PERIOD`` labels that recur at once become repeated groups."""
    for p in range(1, PERIOD + 1):
        kids = g.kids
        if len(kids) < 2 * p:
            return
        out: list[Group] = []
        for k in kids:
            out.append(k)
            if len(out) >= 2 * p and all(out[-q].label == out[-q - p].label for q in range(1, p + 1)):
                for old, new in zip(out[-2 * p : -p], out[-p:], strict=True):
                    merge(old, new, True)
                    old.quant = _marked(old.quant, "+")
                del out[-p:]
        g.kids = out
    if len(g.kids) > MAX_KIDS:
        _to_slot(g)


def wrap(root: Block) -> Group:
    """The wrapper of one page."""
    top = Group("#root", "", 0, 1, 0, 0, None, 0)
    todo, order, longest = [(root, top)], [], ""
    while todo:
        block, g = todo.pop()
        text = block.text()
        if len(text) > len(longest):
            longest = text
        g.chars, g.linked, g.named, g.text = len(text), min(block.linked, len(text)), block.named, zlib.crc32(text.encode()) if text else None
        for x in block.items:
            if not isinstance(x, str):
                k = Group(x.label, "", 0, 1, 0, 0, None, 0)
                g.kids.append(k)
                todo.append((x, k))
        order.append(g)
    bit = 1 << zlib.crc32(longest.encode()) % 62
    for g in order:
        g.seen = bit
    for g in reversed(order):
        fold(g)
    return top


def _lightest_to_slots(g: Group) -> None:
    """Leaves ``MAX_NODES`` groups: those with the most text that is not links in and under them, then the most links. The
    others become part of the text slot of the group that they were in."""
    order = list(_under(g))
    if len(order) <= MAX_NODES:
        return
    number = {id(x): i for i, x in enumerate(order)}
    weight, above = [1] * len(order), [0] * len(order)
    for i in range(len(order) - 1, -1, -1):  # a group outweighs each that is in it
        weight[i] += 16 * max(0, order[i].chars - order[i].linked) + order[i].linked
        for k in order[i].kids:
            weight[i] += weight[number[id(k)]]
            above[number[id(k)]] = i
    stays = set(sorted(range(len(order)), key=lambda i: (-weight[i], i))[:MAX_NODES])
    into = list(range(len(order)))
    for i, x in enumerate(order):
        if i not in stays:
            into[i] = into[above[i]]
            own = order[into[i]]
            own.chars, own.linked, own.text = own.chars + x.chars, own.linked + x.linked, -1
    for i in stays:
        order[i].kids = [k for k in order[i].kids if number[id(k)] in stays]


def dumped(g: Group) -> str:
    _lightest_to_slots(g)
    rows, todo = [], [(0, g)]
    while todo:
        depth, x = todo.pop()
        rows.append([depth, *x.row()])
        todo += [(depth + 1, k) for k in reversed(x.kids)]
    return json.dumps(rows, ensure_ascii=False)


def loaded(text: str) -> Group:
    path: list[Group] = []
    for depth, *row in json.loads(text):
        g = Group(*row)
        del path[depth:]
        if path:
            path[-1].kids.append(g)
        path.append(g)
    return path[0]


def _step(at: int, label: str) -> int:
    return zlib.crc32(label.encode(), at)


def _constant(at: int, text: int) -> int:
    return at << 31 | text >> 1


#: path to the article; constants (place and text), menus and named groups that stay (places), all as hashes
Place = tuple[list[str], list[int], list[int], list[int]]


def place(w: Group) -> Place:
    """Where a host keeps its article, and what in there is not or yet part of it."""
    order = list(_under(w))
    at, above, number = {id(w): 0}, {}, {id(g): i for i, g in enumerate(order)}
    constants, menus = [], []
    chars, linked, mass, own = ([0] * len(order) for _ in range(4))
    for g in order:
        for k in g.kids:
            at[id(k)], above[id(k)] = _step(at[id(g)], k.label), g
    for i in range(len(order) - 1, -1, -1):
        g = order[i]
        fixed = g.text is not None and g.text >= 0 and "+" not in g.quant and g.seen.bit_count() >= AGREE
        if fixed:
            constants.append(_constant(at[id(g)], g.text))
        inner = [number[id(k)] for k in g.kids]
        chars[i], linked[i] = g.chars + sum(chars[k] for k in inner), g.linked + sum(linked[k] for k in inner)
        own[i] = 0 if fixed else max(0, g.chars - g.linked)
        mass[i] = own[i] + sum(mass[k] for k in inner)
        if g.tag in _HOLDS and linked[i] >= 0.7 * max(1, chars[i]) and any("+" in k.quant for k in g.kids):
            menus.append(g)
            mass[i] = 0
    of = lambda g: mass[number[id(g)]]
    # names are asked only where there is as much or more text besides
    said = lambda g: of(g) if not g.named or of(g) >= 0.5 * max(1, of(w)) else 0
    marked = [g for g in order if g.tag in ("article", "main")]
    top = w
    best = max(marked, key=lambda g: (of(g) > 0, g.tag == "article", of(g)), default=None)
    if best is not None and 4 * of(best) + 500 * best.pages >= of(w) - of(best):
        top = best
    else:
        while top.kids:
            k = max(top.kids, key=said)
            rest = [x for x in top.kids if x is not k and said(x)]
            if k.tag not in _HOLDS or "+" in k.quant or said(k) < 0.7 * max(1, said(k) + sum(map(said, rest))) or any(g.tag == "h1" for x in rest for g in _under(x)):
                break
            top = k
    path: list[str] = []
    g = top
    while id(g) in above:
        path.append(g.label)
        g = above[id(g)]
    stay = [at[id(g)] for g in _under(top) if g.named and of(g) >= SHARES[g.named] * max(1, of(top))]
    # links that differ from page to page, with article text before and behind them, are a list in the article
    inside, first, lists = list(_under(top)), number[id(top)], set()
    texts = [first + k for k, g in enumerate(inside) if own[first + k] and "p" in (g.tag, *(x.tag for x in g.kids))]
    for g in menus:
        i = number[id(g)]
        size = sum(1 for _ in _under(g)) if first < i < first + len(inside) else 0
        if size and texts and texts[0] < i and texts[-1] >= i + size and not g.named and all(x.text is None or x.text < 0 or x.seen.bit_count() < AGREE for x in _under(g)):
            lists.add(id(g))
    return path[::-1], sorted(set(constants)), sorted({at[id(g)] for g in menus if id(g) not in lists}), sorted(set(stay))


def article(page: str | Block, found: Place) -> str:
    path, constants, menus, stay = found[0], set(found[1]), set(found[2]), set(found[3])
    places = {c >> 31 for c in constants}
    root = parse(page) if isinstance(page, str) else page
    tops = [(root, 0)]
    for label in path:
        tops = [(k, _step(at, label)) for x, at in tops for k in x.items if isinstance(k, Block) and k.label == label] or tops
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := _plain("".join(run)):
            blocks.append(text)
        run.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
                continue
            if isinstance(x, str):
                run.append(x)
                continue
            block, at = x
            if x is not top and (at in menus or block.named and at not in stay):
                end()
                continue
            own = not (at in places and (t := block.text()) and _constant(at, zlib.crc32(t.encode())) in constants)
            end()
            todo.append(None)
            todo += [(k, _step(at, k.label)) if isinstance(k, Block) else k for k in reversed(block.items) if own or isinstance(k, Block)]
    return "\n".join(blocks)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _folded(df: DataFrame, *by: str) -> DataFrame:
    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for x in sorted(pdf["wrapper"]):
            whole = loaded(x) if whole is None else merge(whole, loaded(x))
        return pdf.iloc[:1].assign(wrapper=dumped(whole))

    return df.groupBy(*by).applyInPandas(folded, df.schema)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, from all pages."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Group] = {}

        def out() -> pa.RecordBatch:
            texts = [dumped(w) for w in found.values()]
            salts = [zlib.crc32(t.encode()) % SALTS[0] for t in texts]
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(salts, pa.int32()), pa.array(texts, pa.string())], ["host", "salt", "wrapper"])
            found.clear()
            return batch

        for batch in it:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = wrap(parse(page.as_py() or ""))
                found[host] = merge(found[host], w) if host in found else w
                if len(found) >= 2000:  # memory stays bounded; what is left is aligned later
                    yield out()
        if found:
            yield out()

    parts = pages.select(host_of().alias("host"), "html").mapInArrow(partial, "host string, salt int, wrapper string")
    # in rounds, so that no task meets more than a share of a host's partial wrappers
    for salts in SALTS:
        parts = _folded(parts.withColumn("salt", F.col("salt") % salts), "host", "salt")
    return _folded(parts.drop("salt"), "host")


def extract(pages: DataFrame, infer: bool = True) -> DataFrame:
    """page_id, url, text and n_chars for each row; without ``infer`` each page is a host of its own."""
    own = pages.select(F.col("page_id").cast("long"), "url", "html", host_of().alias("host"))
    kind = "host string, path array<string>, constants array<long>, menus array<long>, stay array<long>"
    if infer:
        places = cut(map_rows(wrappers(pages), kind, lambda cols: ((h, *place(loaded(w))) for h, w in zip(*cols, strict=True))))
        known = F.broadcast(places) if places.count() <= MAX_SENT else places
        own = own.join(known, "host", "left")
    else:
        own = own.withColumns({c: F.lit(None) for c in ("path", "constants", "menus", "stay")})

    def rows(cols: list[list]) -> Iterator[tuple]:
        for page_id, url, page, *found in zip(*cols, strict=True):
            root = parse(page or "")
            text = article(root, tuple(found) if found[0] is not None else place(wrap(root)))
            yield page_id, url, text, len(text)

    return map_rows(own.select("page_id", "url", "html", "path", "constants", "menus", "stay"), "page_id long, url string, text string, n_chars long", rows)
