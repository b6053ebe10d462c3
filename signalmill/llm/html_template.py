"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its elements, each known by a hash of its path of tags and classes, and its texts with the path they stand in.
Over all pages of a host each token has an occurrence vector: how often it stands in each page. Tokens that share the vector, and stand in
the same element of another class, form an equivalence class; so classes nest. A token that does not always stand after the
same element of its class is out of order and leaves it. What is left is the host's template, a tree of elements with fixed texts; what it
leaves open are slots. Extracted are the main slots: those in the lowest container that holds all open text, without fixed texts and without
slots that are menus, by their share of links over all pages of the host.

Lists of tags, roles and class words (nav, footer, ad, comments) speak against a slot. Where a page has an article beside it (see Page.judge), the
slot is shut however long it is; else it is open where it holds most of the page's text or, by the template, over half of the host's. Links count as
open text in headings only; a page that has open text elsewhere takes its own lowest common container.

Vectors are never gathered: each task adds up its pages, and a vector is known by the exclusive or of hashes of (page, count), with the
count of pages and of occurrences. Only frequent tokens of a host come together, at most as many as 1 / share pages hold. Host tables are
broadcast up to ``broadcast_tokens`` tokens in all; beyond, pages and hosts are joined by shuffle, where adaptive execution splits the pages of a
host that holds many.

Cases: null or empty pages have an empty text; hosts of few pages have no template, so each of their pages is its own (its main
container is found by the same rule); a page without the host's main container likewise; null URLs share one host;
repeated rows count as often as they occur; pages of any length and depth are read whole, in linear time; tags that are broken off are left
out, elements that are not closed end with the page; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import checkpointed
from .url_model import host_of

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body center div form html main section table tbody td tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("br body html head title option".split())
ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NEVER = frozenset("head script style noscript iframe svg canvas template object button select textarea input title".split())
LISTED = frozenset("nav aside footer form menu dialog".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
READERS = frozenset("comment comments disqus replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

# A tag as the standard reads it: a quote that is never closed takes the rest of the page
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?>(?:[\s/]+|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)?|=[^\s/>=]*)*))(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>][^\s>]*))?)?", re.S)
_SPLIT = re.compile(r"[^a-z]+")
# what a container has beside its text: has-sidebar, page-with-header
_BESIDE = re.compile(r"(?<![a-z])(?:has|with|no|without|hide)[-_]+[a-z]+")
_LISTS = frozenset(("ul", "ol", "dl", "blockquote"))
#: Marks of tokens.
TEXT, HOLDS, NAMED = 1, 2, 4


@dataclass(frozen=True)
class TemplateOptions:
    """least_pages: pages that a host's template is deduced from at least. share: of the host's pages that a token of it needs.
    fixed_share: of pages that a text of the template stands in. link_share: of its text that makes a slot a menu. broadcast_tokens: of all hosts
    together that are broadcast."""

    least_pages: int = 5
    share: float = 0.5
    fixed_share: float = 0.95
    short_text: int = 60
    link_share: float = 0.8
    broadcast_tokens: int = 1_000_000


def _digest(*parts: bytes) -> int:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


_PATHS: dict[tuple[int, str], int] = {}


def path_key(parent: int, name: str) -> int:
    """An element's token: a hash of its parent's and its own tag and classes. The root's is 0."""
    key = _PATHS.get((parent, name))
    if key is None:
        if len(_PATHS) > 500_000:
            _PATHS.clear()
        key = _PATHS[parent, name] = _digest(parent.to_bytes(8, "little", signed=True), name.encode("utf-8", "replace"))
    return key


def text_key(parent: int, text: str) -> int:
    """A text's token: a hash of where it stands and its words."""
    return _digest(b"t", parent.to_bytes(8, "little", signed=True), " ".join(text.split()).encode("utf-8", "replace"))


class Page:
    """The elements of a page, each after its parent, and its texts in order. Time and memory grow with the page's length alone, however deep it nests.

    ``parent``, ``key``, ``tag`` and ``named`` of elements (0: the root): named is the share of the page's text that an element must exceed to be
    open, 1 if it never is, 0 if none is asked. ``texts``: (element, text, block, whether in a link that is no heading)."""

    MOST = 0.9
    LEAST = 80  # characters without names that count as an article where there is no element of that kind

    def __init__(self, source: str):
        self.parent, self.key, self.tag, self.named = [0], [0], [""], [0.0]
        self.texts: list[tuple[int, str, int, bool]] = []
        self.sequence: list[int] = []  # elements as they open, texts as -1 - their place
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, in a link
        where: dict[str, list[int]] = {}  # depths in the stack, by tag
        holders, barriers, headings = [0], [0], 0

        def shut(depth: int) -> None:
            nonlocal headings
            while len(stack) > depth:
                tag = stack.pop()[0]
                where[tag].pop()
                headings -= tag in HEADING
                if holders[-1] == len(stack):
                    holders.pop()
                if barriers[-1] == len(stack):
                    barriers.pop()

        def shut_open(tags: tuple[str, ...]) -> None:
            depth = max((where[t][-1] for t in tags if where.get(t)), default=0)
            if depth and depth >= barriers[-1]:
                shut(depth)

        at, block = 0, 0
        while at < len(source):
            m = _TAG.search(source, at)
            # a lone < is text
            end = m.start() if m else len(source)
            if end > at:
                self.sequence.append(-1 - len(self.texts))
                self.texts.append((stack[-1][1], source[at:end], block, stack[-1][2]))
            if not m:
                break
            at = m.end()
            if m[2] is None or not m[4]:
                continue
            tag = m[2].lower()
            if m[1]:
                depth = where[tag][-1] if where.get(tag) else 0
                if depth and not (tag not in BLOCK and holders[-1] > depth):
                    shut(depth)
                block += tag in BLOCK
                continue
            if tag in CLOSES_P:
                shut_open(("p",))
            if tag in ITSELF:
                shut_open(ITSELF[tag])
            block += tag in BLOCK
            _, above, link = stack[-1]
            inside = bool(where.get("article") or where.get("main"))
            name, named = self._named(tag, m[3], inside)
            self.sequence.append(len(self.key))
            self.parent.append(above)
            self.key.append(path_key(self.key[above], name))
            self.tag.append(tag)
            self.named.append(named)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif tag not in VOID and not m[3].endswith("/"):
                headings += tag in HEADING
                where.setdefault(tag, []).append(len(stack))
                if tag in CONTAINER:
                    holders.append(len(stack))
                if tag in CONTAINER or tag in _LISTS:
                    barriers.append(len(stack))
                stack.append((tag, len(self.key) - 1, (link or tag == "a") and not headings))

        self.shut = [False] * len(self.key)
        self.judge()

    def judge(self) -> None:
        """Finds the page's article and shuts named elements beside it.

        An article is text out of links, headings and named elements: in an article or main element any, elsewhere ``LEAST`` characters of it. Elements
        around it that only hint at something else (a form, class words in part) count as unnamed. Beside it, what a tag, a role or a whole word names is
        shut; what hints only where it is out of the article's element, or that has ``LEAST`` characters without it. ``has_article`` tells whether there is one."""
        n = len(self.key)
        owner, heading, strong = [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            owner[i] = i if self.tag[i] in ("article", "main") else 0 if self.named[i] else owner[up]
            heading[i] = heading[up] or self.tag[i] in HEADING
            strong[i] = strong[up] or self.named[i] >= self.MOST
        sizes = self.sizes()
        said = [(e, size) for (e, _, _, link), size in zip(self.texts, sizes, strict=True) if size and not link and not heading[e]]
        articles = {owner[e] for e, _ in said if owner[e] and not strong[owner[e]]}
        seen = {0}
        for at in articles:
            while at not in seen:
                seen.add(at)
                self.named[at] = 0.0
                at = self.parent[at]
        inside, beneath = [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or i in articles
            beneath[i] = beneath[self.parent[i]] or self.named[i] > 0
        free = sum(size for e, size in said if not beneath[e])
        within = sum(size for e, size in said if not beneath[e] and inside[e])
        self.has_article = within > 0 or free >= self.LEAST
        for i in range(1, n):
            if self.named[i] >= self.MOST:
                self.shut[i] = self.has_article
            elif self.named[i]:
                self.shut[i] = within >= self.LEAST or (within > 0 and not inside[i])

    @staticmethod
    def _named(tag: str, attributes: str, inside: bool) -> tuple[str, float]:
        """The element's name in paths, and its share (see Page)."""
        share, kind, seen = 0.0, "", set()
        if tag in NEVER:
            share = 1.0
        elif tag in LISTED or (tag == "header" and not inside):
            share = 0.5 if tag == "form" else Page.MOST
        for m in _ATTRIBUTE.finditer(attributes):
            what = m[1].lower()
            if what not in ("class", "id", "role", "hidden") or what in seen:
                continue
            seen.add(what)
            value = (m[2] or m[3] or m[4] or "").lower()
            if what == "hidden":
                share = 1.0
            elif what == "role":
                share = max(share, Page.MOST) if value.strip() in ROLES else share
            elif tag not in ("html", "body", "article", "main") and not BOILERPLATE.isdisjoint(_SPLIT.split(_BESIDE.sub(" ", value))):
                whole = not BOILERPLATE.isdisjoint(value.split()) or not READERS.isdisjoint(_SPLIT.split(_BESIDE.sub(" ", value)))
                share = max(share, Page.MOST if whole else 0.5)
            if what == "class":
                kind = "." + ".".join(sorted(value.split()))
        return tag + kind, share

    def opened(self, slots: dict[int, bool] | None = None) -> list[bool]:
        """For each element whether texts in it are open. Named elements beside an article are shut; then the host's decisions on slots count; else a named
        element is open if it holds its share of the page's text out of links."""
        held, never = self.summed([0 if link else n for (_, _, _, link), n in zip(self.texts, self.sizes(), strict=True)])
        slots, out = slots or {}, [True] * len(self.key)
        for i in range(1, len(self.key)):
            said = slots.get(self.key[i])
            mine = not never[i] and not self.shut[i] and (held[i] > self.named[i] * held[0] if said is None and self.named[i] else said is not False)
            out[i] = out[self.parent[i]] and mine
        return out

    def sizes(self) -> list[int]:
        """The characters of each text, without spaces."""
        return [0 if text.isspace() else len(text) - text.count(" ") for _, text, _, _ in self.texts]

    def summed(self, sizes: list[int]) -> tuple[list[int], list[bool]]:
        """The sum of the texts' sizes in each element with all in it, but for what is never open; and which elements are in such."""
        never = [share == 1 for share in self.named]
        for i in range(1, len(never)):
            never[i] = never[i] or never[self.parent[i]]
        held = [0] * len(self.key)
        for (e, *_), n in zip(self.texts, sizes, strict=True):
            if not never[e]:
                held[e] += n
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        return held, never


def page_tokens(page: Page) -> dict[int, list[int]]:
    """For each token of the page: how often it stands there, its open text, its text out of links and in links, for the root whether the page has an
    article, its parent's token, its marks."""
    sizes, opened = page.sizes(), page.opened()
    out_of_links = [0 if t[3] else n for t, n in zip(page.texts, sizes, strict=True)]
    plain, _ = page.summed(out_of_links)
    every, _ = page.summed(sizes)
    open_, _ = page.summed([n if opened[t[0]] else 0 for t, n in zip(page.texts, out_of_links, strict=True)])
    found: dict[int, list[int]] = {}
    for i, key in enumerate(page.key):
        marks = (HOLDS if page.tag[i] in CONTAINER else 0) | (NAMED if page.named[i] else 0)
        one = found.setdefault(key, [0, 0, 0, 0, 0, page.key[page.parent[i]], marks])
        for k, x in enumerate((1, open_[i], plain[i], every[i] - plain[i], int(i == 0 and page.has_article))):
            one[k] += x
    for (e, text, _, link), n in zip(page.texts, sizes, strict=True):
        if n:
            one = found.setdefault(text_key(page.key[e], text), [0, 0, 0, 0, 0, page.key[e], TEXT])
            for k, x in enumerate((1, n if opened[e] and not link else 0, 0 if link else n, n if link else 0)):
                one[k] += x
    return found


def predecessors(page: Page, classes: dict[int, int]) -> Iterator[tuple[int, int]]:
    """For each token of a class, as it stands in the page, the element of its class before it."""
    before: dict[int, int] = {}
    for i in page.sequence:
        key = page.key[i] if i >= 0 else text_key(page.key[page.texts[-1 - i][0]], page.texts[-1 - i][1])
        c = classes.get(key)
        if c is not None:
            if c in before:
                yield key, before[c]
            if i >= 0:
                before[c] = key


# ---- one host


@dataclass
class Token:
    token: int
    vector: tuple
    pages: int
    open: int
    plain: int
    linked: int
    articles: int
    parent: int
    marks: int


def equivalence_classes(tokens: list[Token]) -> dict[int, int]:
    """(token, class) of the tokens in valid classes. Tokens with one occurrence vector form a class as far as they stand in the same element of
    another class, so that classes nest; a class of a single token is none."""
    by = {t.token: t for t in tokens}
    outer: dict[int, int] = {}

    def outside(t: Token) -> int:
        """The nearest element around a token that is of another vector."""
        path = []
        while t.token not in outer:
            path.append(t)
            above = by.get(t.parent)
            if above is None or t.token == 0:
                outer[t.token] = 0
                break
            if above.vector != t.vector:
                outer[t.token] = above.token
                break
            t = above
        for x in path:
            outer[x.token] = outer[t.token]
        return outer[path[0].token if path else t.token]

    groups: dict[tuple, list[int]] = {}
    for t in tokens:
        groups.setdefault((t.vector, outside(t)), []).append(t.token)
    return {t: min(g) for g in groups.values() if len(g) > 1 for t in g}


@dataclass
class Slots:
    """What a host's template says: the container of the main slots, the texts it fixes, and whether slots are open that names or links speak against."""

    main: int | None
    fixed: frozenset[int]
    said: dict[int, bool]


def slots_of(tokens: list[Token], classes: dict[int, int], pages: int, options: TemplateOptions) -> Slots:
    """The slots of a host's template, which is the tree of the elements in its classes.

    - A text of a class that nearly all pages hold is fixed; long ones only where fixed texts are no more than half of the open text, so that
      copies of one page are no template.
    - A slot whose text is links is a menu. In a host of articles a named slot is open where the pages themselves open most of its text; in
      other hosts where it holds over half of the host's text.
    - The main slots' container is the lowest element that holds all open text that is left.
    """
    by = {t.token: t for t in tokens}
    articles = 0 in by and 2 * by[0].articles > pages
    fixed = [t for t in tokens if t.marks & TEXT and t.token in classes and t.pages >= options.fixed_share * pages]
    whole = by[0].open if 0 in by else 0
    if 2 * sum(t.open for t in fixed) > whole:
        fixed = [t for t in fixed if t.plain + t.linked <= options.short_text * t.pages]
    taken: dict[int, int] = {}

    def take(t: Token, n: int) -> None:
        """Open text that is no slot's, from a token up to the root."""
        at = t.parent
        while n:
            taken[at] = taken.get(at, 0) + n
            if at == 0 or at not in by:
                break
            at = by[at].parent

    for t in fixed:
        take(t, t.open)
    said: dict[int, bool] = {}
    for t in sorted((t for t in tokens if not t.marks & TEXT and t.token in classes and t.token), key=lambda t: -t.plain - t.linked):
        menu = not t.marks & NAMED and t.linked >= options.link_share * (t.linked + t.plain) > 0
        if menu and t.plain <= 0.1 * max(1, by[0].plain if 0 in by else 0):
            said[t.token] = False
            take(t, t.open - taken.get(t.token, 0))
        elif t.marks & NAMED:
            said[t.token] = 2 * t.open > t.plain if articles else 2 * t.plain > (by[0].plain if 0 in by else 0)
    left = {t.token: t.open - taken.get(t.token, 0) for t in tokens if not t.marks & TEXT}
    depth: dict[int, int] = {0: 0}

    def deep(t: int) -> int:
        path = []
        while t not in depth:
            path.append(t)
            t = by[t].parent if t in by else 0
        for x in reversed(path):
            depth[x] = depth[by[x].parent if x in by else 0] + 1
        return depth[path[0]] if path else depth[t]

    rest = left.get(0, 0)
    mains = [t for t, n in left.items() if t and n == rest and by[t].marks & HOLDS] if rest > 0 else []
    return Slots(max(mains, key=lambda t: (deep(t), t), default=None), frozenset(t.token for t in fixed), said)


def extract(page: Page, slots: Slots | None = None) -> str:
    """The text of the page's main slots."""
    slots = slots or Slots(None, frozenset(), {})
    opened = page.opened(slots.said)
    good = [opened[e] and not (slots.fixed and text_key(page.key[e], text) in slots.fixed) for e, text, _, _ in page.texts]
    counts = [n if g and not t[3] else 0 for n, g, t in zip(page.sizes(), good, page.texts, strict=True)]
    held, _ = page.summed(counts)
    # the main container, unless the page has none or has open text elsewhere
    mains = [i for i, k in enumerate(page.key) if k == slots.main] if slots.main is not None else []
    if not mains or sum(held[i] for i in mains) < held[0]:
        mains = [max((i for i, n in enumerate(held) if n == held[0] and (i == 0 or page.tag[i] in CONTAINER)), default=0)] if held[0] else [0]
    inside = [False] * len(page.key)
    for i in mains:
        inside[i] = True
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parent[i]]
    blocks: list[list] = []
    for (e, text, block, _), g in zip(page.texts, good, strict=True):
        if g and inside[e]:
            if not blocks or blocks[-1][0] != block:
                blocks.append([block, []])
            blocks[-1][1].append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in blocks)
    return "\n".join(x for x in lines if x)


# ---- on Spark

_SEEN = "host string, token long, vector long, pages long, total long, open long, plain long, linked long, articles long, parent long, marks int"


def occurrences(pages: DataFrame) -> DataFrame:
    """Rows (host, id, html) to one row for each host and token: a hash of its occurrence vector, pages, occurrences and texts, added up over all pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for host, key, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes: dict[int, int] = {}
                for token, (n, *sums, parent, marks) in page_tokens(Page(source or "")).items():
                    if n not in hashes:
                        hashes[n] = _digest(f"{key}\0{n}".encode("utf-8", "replace"))
                    one = held.setdefault((host, token), [0, 0, 0, 0, 0, 0, 0, parent, marks])
                    one[0] ^= hashes[n]
                    for k, x in enumerate((1, n, *sums), 1):
                        one[k] += x
                    one[8] |= marks
                if len(held) > 200_000:
                    yield _table(held)
                    held = {}
        yield _table(held)

    rows = pages.mapInArrow(count, _SEEN)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "open", "plain", "linked", "articles")]
    return rows.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), *sums, F.min("parent").alias("parent"), F.bit_or("marks").alias("marks"))


def _table(held: dict[tuple, list]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in _SEEN.split(", ")), strict=True)
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _tokens(table: pa.Table) -> list[Token]:
    columns = [table[c].to_pylist() for c in ("token", "vector", "pages", "total", "open", "plain", "linked", "articles", "parent", "marks")]
    return [Token(t, (v, p, n), p, o, a, b, c, up, m) for t, v, p, n, o, a, b, c, up, m in zip(*columns, strict=True)]


def templates(pages: DataFrame, options: TemplateOptions) -> DataFrame:
    """The tokens of each host that enough of its pages hold, with their class and ``host_pages``. They are at most what 1 / share pages hold."""
    found = checkpointed(occurrences(pages))
    roots = found.filter("token = 0").select("host", F.col("pages").alias("host_pages")).filter(F.col("host_pages") >= options.least_pages)
    frequent = found.filter(F.col("pages") >= options.share * options.least_pages).join(roots, "host").filter(F.col("pages") >= options.share * F.col("host_pages"))

    def classed(table: pa.Table) -> pa.Table:
        classes = equivalence_classes(_tokens(table))
        return table.append_column("class", pa.array([classes.get(t) for t in table["token"].to_pylist()], pa.int64()))

    schema = T.StructType([*frequent.schema.fields, T.StructField("class", T.LongType())])
    return frequent.groupBy("host").applyInArrow(classed, schema)


def _beside(rows: DataFrame, hosts: DataFrame, options: TemplateOptions) -> DataFrame:
    """Rows with the one row of their host; hosts are broadcast where their lists of tokens are short in all."""
    lists = [F.coalesce(F.size(f.name), F.lit(0)) for f in hosts.schema.fields if isinstance(f.dataType, T.ArrayType)]
    tokens = hosts.agg(F.sum(sum(lists, F.lit(1)))).first()[0] or 0
    return rows.join(F.broadcast(hosts) if tokens <= options.broadcast_tokens else hosts, "host", "left")


def misplaced(rows: DataFrame, template: DataFrame, options: TemplateOptions) -> DataFrame:
    """(host, token) of tokens that do not always stand after the same element of their class: those are out of order, and no part of it."""
    known = template.filter("class IS NOT NULL").groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes"))
    joined = _beside(rows.select("host", "html"), checkpointed(known), options).filter("tokens IS NOT NULL").select("host", "html", "tokens", "classes")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for host, source, tokens, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for token, before in predecessors(Page(source or ""), dict(zip(tokens, classes, strict=True))):
                    one = held.setdefault((host, token), [before, before])
                    one[0], one[1] = min(one[0], before), max(one[1], before)
        rows = [(*k, *v) for k, v in held.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "low", "high"])

    spans = joined.mapInArrow(follow, "host string, token long, low long, high long")
    return spans.groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("host", "token")


def host_slots(template: DataFrame, wrong: DataFrame, options: TemplateOptions) -> DataFrame:
    """(host, main, fixed, said, open): the slots of each host, by its tokens that stand in order."""
    rows = template.join(wrong.withColumn("wrong", F.lit(True)), ["host", "token"], "left")

    def slots(table: pa.Table) -> pa.Table:
        wrong = table["wrong"].to_pylist()
        classes = {t: c for t, c, w in zip(table["token"].to_pylist(), table["class"].to_pylist(), wrong, strict=True) if c is not None and not w}
        # a class of which one token is left is none
        left = Counter(classes.values())
        classes = {t: c for t, c in classes.items() if left[c] > 1}
        s = slots_of(_tokens(table), classes, table["host_pages"][0].as_py(), options)
        lists = pa.list_(pa.int64())
        columns = [table["host"][:1], pa.array([s.main], pa.int64()), pa.array([sorted(s.fixed)], lists), pa.array([sorted(t for t, x in s.said.items() if not x)], lists), pa.array([sorted(t for t, x in s.said.items() if x)], lists)]
        return pa.table(columns, names=["host", "main", "fixed", "closed", "opened"])

    return rows.groupBy("host").applyInArrow(slots, "host string, main long, fixed array<long>, closed array<long>, opened array<long>")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", options: TemplateOptions | None = None) -> DataFrame:
    """One row for each page: its id, url, main text and the text's length."""
    options = options or TemplateOptions()
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url").cast("string")), F.lit("")))
    template = checkpointed(templates(rows.select("host", "id", "html"), options))
    slots = checkpointed(host_slots(template, misplaced(rows, template, options), options))
    joined = _beside(rows, slots, options).select("id", "url", "html", "main", "fixed", "closed", "opened")
    schema = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), T.StructField("url", rows.schema["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, main, fixed, closed, opened in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                said = {**dict.fromkeys(closed or (), False), **dict.fromkeys(opened or (), True)}
                texts.append(extract(Page(source or ""), Slots(main, frozenset(fixed or ()), said)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return joined.mapInArrow(read, schema)
