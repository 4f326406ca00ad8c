"""Main text of web pages: page structure, then long token runs that a host's suffix array shows on many of its pages.

A page is read as blocks of text, each inside a stack of open elements. Elements that are never article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments: by tag, role, or a whole class or id)
are dropped with all they hold. A class or id counts if all words between its hyphens are NAMES or, beside one, PARTS. What
a form or a class or id would drop is not dropped where it holds an article or main: this is the article if the page has no
other and it is at least as long as the rest. Inside an article no class or id drops headings and paragraphs, and only
those of reader comments drop sections. If the page marks its article (article or main), the blocks in it are the text.

Then, for every page, marked or not: the token streams of a host's pages stand one after another, with an end for each
block and one of its own for each page; their suffixes are put in order by doubling prefixes, up to DEPTH tokens, and
neighbours' common prefixes follow from the ranks. Suffixes that share RUN tokens or more are intervals of this order;
the distinct pages in an interval, copies of a whole page being one, tell how often the run recurs. Where no article is
marked, a block at least half covered by runs of at least PAGES pages goes, and so does a block shorter than a run that
stands whole on so many pages and on SHARE of the host's; unique runs stay. Articles of a host may well share passages, so
a block in a marked article goes only if runs on at least PAGES pages and on MOST of the host's cover all of it, on a
host of at least ENOUGH pages.

Hosts of more than LOT tokens are dealt over lots by row, so a host with a third of all pages is many tasks; each lot
orders its own suffixes. What goes does not depend on lots: each page is judged by the pages of all lots its runs are on.
If some page of such a host marks no article, where three pages of all lots matter, each lot says on how many pages its
runs are, and the sums over all lots come back to it. Else only runs on MOST of the host's pages matter, and there are few:
each lot says which runs are on more than one in SOME of its pages, and on how many. What a lot does not say is on no more
there, so the sums bound from both sides on how many pages of the host a run is; where that leaves it open whether those are
enough, every lot counts the run. A run on MOST of all pages is on as many of some lot's, so none is missed.

Defined cases: null html is empty and gives empty text; a null or unparsable url is a host of its own kind; repeated
rows and ids are pages of their own; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, tidied, tidy

RUN = 8
PAGES = 3
SHARE = 0.3
MOST = 0.5
SOME = 3
ENOUGH = 8
DEPTH = 32
LOT = 400_000

#: A comment, a declaration, or a tag: its attributes are read as names with values, so quotes inside an unquoted value say nothing.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?>\s++|/|=?[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))?|=)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "label", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status", "note"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "banner", "notice", "notices",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "sidebar", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "comment", "comments", "commentlist", "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "skip", "masthead",
}
HEADERS = {"header", "topbar"}
#: Words that say of a part of a page only where or how it is.
PARTS = {"site", "page", "main", "primary", "secondary", "global", "top", "bottom", "left", "right", "box", "bar", "block", "container", "wrapper", "inner", "list", "item", "items", "link", "links", "button", "buttons", "icon", "icons", "area", "slot", "unit", "section", "form", "posts", "articles", "stories", "media", "google", "content"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
TITLES = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
NESTED = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "html", "main", "menu", "nav", "ol", "section", "select", "table", "ul", "button", "label", "audio", "video"}
BLOCKS = NESTED | {"p", "li", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "summary", "legend", "option", "optgroup", "hgroup", "search"}
TRACKED = NESTED | {"p", "li", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "th", "tr", "caption", "figcaption", "summary", "span", "a", "small", "b", "i", "em", "strong"}
#: What a start tag closes when it is still open, up to the nearest nesting element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: AWAY: dropped with all it holds; NAMED: dropped but for an article or main in it, whose state is HELD.
PLAIN, INSIDE, AWAY, NAMED, HELD = 0, 1, 2, 3, 4


def _named(token: str, names: set[str]) -> bool:
    """Whether a whole class or id is made of such names, and words that say where or how."""
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    return any(w in names for w in words) and all(w in names or w in PARTS for w in words)


def _drops(tag: str, attributes: str, inside: bool) -> int:
    """AWAY or NAMED if an element and all that it holds is no article text, else PLAIN."""
    if tag in DROPPED and tag != "form" or (tag == "header" and not inside):
        return AWAY
    found = NAMED if tag == "form" else PLAIN
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return found
    names = NAMES if inside else NAMES | HEADERS
    if inside and tag in TITLES or tag in ("html", "body", *ARTICLE):
        names = set()
    elif inside and tag == "section":
        names = COMMENTS
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name in ("class", "id"):
            if any(_named(token, names) for token in value.split()):
                found = NAMED
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return AWAY
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return AWAY
    return found


def blocks(page: str) -> list[tuple[int, str]]:
    """(state, text) of each block of a page that is not dropped, in page order; state: INSIDE a marked article or PLAIN."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    state, at = PLAIN, 0

    def end() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((state, line))

    n = len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            if state not in (AWAY, NAMED):
                text.append(page[at:])
            break
        if state not in (AWAY, NAMED) and found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if state not in (AWAY, NAMED) and found[0].startswith("<![CDATA["):
                text.append(found[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag in BLOCKS:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    end() if stack[k][1] != state else None
                    state = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in NESTED and tag not in NESTED:
                    break
            continue
        if tag in RAW:
            if not found[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and state not in (AWAY, NAMED):
                text.append(" ")
            continue
        if tag in BLOCKS:
            end()
            # an open paragraph ends where a block begins; so does an item where the next one begins
            over = CLOSES.get(tag, set()) | {"p"}
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in NESTED:
                if stack[k][0] in over:
                    state = stack[k][1]
                    del stack[k:]
                k = min(k, len(stack)) - 1
        if tag in TRACKED and tag not in VOID:
            stack.append((tag, state))
            if state != AWAY:
                inside = state in (INSIDE, HELD)
                new = _drops(tag, found[3], inside)
                if new == NAMED:
                    new = AWAY if inside else NAMED
                elif new == PLAIN:
                    new = state if tag not in ARTICLE else HELD if state in (NAMED, HELD) else INSIDE
                if new != state:
                    end()
                    state = new
    end()
    if any(s == HELD for s, _ in out):
        size = lambda kind: sum(len(t) for s, t in out if s == kind)
        if size(INSIDE):
            return [(s, t) for s, t in out if s != HELD]
        own = INSIDE if size(HELD) >= size(PLAIN) else PLAIN
        return [(own if s == HELD else s, t) for s, t in out]
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PAGE = "row long, page_id long, url string, host string, content long, tokens long, marked boolean, blob binary"


@tidied
def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (row, page_id, url, html) with their blocks, packed; content: a hash of them."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            hosts, contents, tokens, marks, blobs = [], [], [], [], []
            for url, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found = blocks(page or "")
                marked = any(s == INSIDE for s, _ in found)
                text = "\n".join(t for s, t in found if s == INSIDE or not marked).encode("utf-8", "replace")
                hosts.append(host_of(url))
                contents.append(xxhash.xxh64_intdigest(text, int(marked)) - (1 << 63))
                tokens.append(text.count(b" ") + text.count(b"\n") + 2)
                marks.append(marked)
                blobs.append(press(text))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip((hosts, contents, tokens, marks, blobs), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *made], names=[c.split()[0] for c in _PAGE.split(", ")])


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the starts of all suffixes in the order of their first tokens, at least depth of them, and how many each shares with the one before.

    Prefixes double in each round, so that ranks for 1, 2, 4, ... tokens are known; common prefixes are put together from
    the ranks of the longest down. tokens: numbers; what the last tokens lack sorts first.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < depth and ranks[-1].max() + 1 < n:
        then = np.zeros(n, dtype=np.int64)
        then[:-width] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + then, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = same.astype(np.int64) << level
        common[1:] += step
        a, b = a + step, b + step
    return order, common


class Stream:
    """The token streams of different pages, one after another; a page is a list of blocks."""

    def __init__(self, pages: list[list[str]]) -> None:
        self.lines = [line for lines in pages for line in lines]
        each = [line.split(" ") for line in self.lines]
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1
        get = number.__getitem__
        block = len(each)
        self.sizes = np.fromiter(map(len, each), dtype=np.int64, count=block)
        self.owner = np.repeat(np.arange(len(pages)), [len(lines) for lines in pages]) if pages else np.empty(0, np.int64)
        # a block takes its words and an end; a page its blocks and an end of its own, so no run goes on beyond it
        ends = np.cumsum(self.sizes + 1) + self.owner if block else np.empty(0, np.int64)
        page_ends = np.cumsum(np.bincount(self.owner, weights=self.sizes + 1, minlength=len(pages)).astype(np.int64) + 1) if pages else np.empty(0, np.int64)
        n = int(page_ends[-1]) if len(page_ends) else 0
        self.tokens, self.block_of = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        inside[page_ends - 1] = False
        self.tokens[inside] = np.fromiter((get(w) for words in each for w in words), dtype=np.int64, count=int(self.sizes.sum()))
        self.block_of[inside] = np.repeat(np.arange(block), self.sizes)
        self.tokens[page_ends - 1] = -1 - np.arange(len(pages))
        self.page_of = np.repeat(np.arange(len(pages)), np.diff(np.append(0, page_ends)))
        self.blocks, self.words = block, list(number)

    def classes(self, run: int) -> np.ndarray:
        """For each start, the number of its interval of suffixes that share a run."""
        order, common = suffix_array(self.tokens, max(run, DEPTH))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(common < run)
        return out

    def run_hashes(self, run: int) -> np.ndarray:
        """A hash of the run at each start that has one whole inside its page, for lots to compare; zero elsewhere."""
        own = np.array([xxhash.xxh64_intdigest(w, 3) for w in ["\n", *self.words]], dtype=np.uint64)
        n = max(0, len(self.tokens) - run + 1)
        out = np.zeros(len(self.tokens), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(run):
                h = h * np.uint64(0x9E3779B97F4A7C15) + own[np.maximum(self.tokens[j : j + n], 0)]
                h ^= h >> np.uint64(29)
        whole = self.page_of[:n] == self.page_of[run - 1 :] if n else np.empty(0, bool)
        ends = np.append(0, np.cumsum(self.tokens < 0))
        whole &= ends[run : run + n] == ends[:n]
        out[:n][whole] = h[whole] | np.uint64(1)
        return out

    def line_hashes(self, run: int) -> np.ndarray:
        """A hash of each block that is shorter than a run; zero for others."""
        return np.array([xxhash.xxh64_intdigest(t, 4) & ~1 if n < run else 0 for t, n in zip(self.lines, self.sizes.tolist(), strict=True)], dtype=np.uint64)


def _distinct(keys: np.ndarray, pages: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and on how many of the pages that count each is."""
    values, where = np.unique(keys, return_inverse=True)
    pairs = np.unique(where * len(counts) + pages)
    on, page = pairs // max(1, len(counts)), pairs % max(1, len(counts))
    return values, np.bincount(on, weights=counts[page], minlength=len(values)).astype(np.int64)


def repeated(pages: list[list[str]], marked: np.ndarray, counts: np.ndarray, total: int, run: int, least: int, share: float, told: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[bool]]:
    """Which blocks of each page go. counts: the pages that count (others are copies of pages elsewhere).

    total: how many pages count on the host; told: for a host in several lots, hashes of runs and short blocks, in order,
    with the pages they are on in all lots.
    """
    stream = Stream(pages)
    if not len(stream.tokens):
        return [[False] * len(lines) for lines in pages]
    short = stream.line_hashes(run)
    if told is None:
        keys = stream.classes(run)
        values, times = _distinct(keys, stream.page_of, counts)
        lines, line_times = _distinct(short, stream.owner, counts)
    else:
        keys = stream.run_hashes(run)
        values, times = lines, line_times = told
    look = lambda k, v, t: np.where(v[np.minimum(np.searchsorted(v, k), len(v) - 1)] == k, t[np.minimum(np.searchsorted(v, k), len(v) - 1)], 0) if len(v) else np.zeros(len(k), np.int64)
    seen = look(keys, values, times)
    article = marked[stream.owner]

    def covered(most: float) -> np.ndarray:
        """How many words of each block are in runs on so many pages."""
        starts = np.flatnonzero(seen >= most)
        change = np.zeros(len(seen) + run + 1, dtype=np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + run, -1)
        inside = (np.cumsum(change)[: len(seen)] > 0) & (stream.block_of >= 0)
        return np.bincount(stream.block_of[inside], minlength=stream.blocks)

    gone = ~article & (2 * covered(least) >= stream.sizes)
    gone |= ~article & (short > 0) & (look(short, lines, line_times) >= max(least, share * total))
    if total >= ENOUGH:
        gone |= article & (covered(max(least, MOST * total)) == stream.sizes)
    cuts = np.cumsum([0, *map(len, pages)]).tolist()
    return [gone[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _opened(table: pa.Table) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Different contents of a lot: blocks, whether marked, and for each row its content's number; with the rows."""
    number: dict[int, int] = {}
    which = np.array([number.setdefault(c, len(number)) for c in table.column("content").to_pylist()], dtype=np.int64)
    first = np.unique(which, return_index=True)[1]
    inflate = zstandard.ZstdDecompressor().decompress
    blobs = table.column("blob").take(pa.array(first)).to_pylist()
    texts = [inflate(x).decode() for x in blobs]
    marked = table.column("marked").take(pa.array(first)).to_numpy(zero_copy_only=False) if len(first) else np.empty(0, bool)
    return [t.split("\n") if t else [] for t in texts], marked, which, table.column("row").to_numpy()


def _counting(which: np.ndarray, rows: np.ndarray, leads: np.ndarray, pages: int) -> np.ndarray:
    """Whether each content counts here: the row that stands for it is of this lot."""
    out = np.zeros(pages, dtype=np.int64)
    out[which[np.isin(rows, leads)]] = 1
    return out


@tidy
def _tell(table: pa.Table, side: pa.Table, run: int) -> pa.Table:
    """Runs and short blocks of a lot with the pages they are on; nothing for a host that is one lot or marks all articles."""
    if not len(table) or table.column("lots")[0].as_py() == 1 or not table.column("open")[0].as_py():
        return _TOLD.empty_table()
    pages, _, which, rows = _opened(table)
    stream = Stream(pages)
    counts = _counting(which, rows, side.column("value").to_numpy(), len(pages))
    h = np.concatenate([stream.run_hashes(run), stream.line_hashes(run)])
    owner = np.concatenate([stream.page_of, stream.owner])
    values, times = _distinct(h[h > 0], owner[h > 0], counts)
    host, lot = (table.column(c)[0].as_py() for c in ("host", "lot"))
    return pa.table({"host": pa.array([host] * len(values), pa.string()), "lot": pa.array(np.full(len(values), lot, np.int32)), "value": pa.array(values.view(np.int64)), "n": pa.array(times)})


@tidy
def _common(table: pa.Table, side: pa.Table, run: int) -> pa.Table:
    """Runs on more than one in SOME of a lot's pages with the pages they are on, and the lot's pages; nothing for a host that is one lot, tells all its runs or has too few pages."""
    lots, open_, total = (table.column(c)[0].as_py() if len(table) else 0 for c in ("lots", "open", "contents"))
    if lots <= 1 or open_ or total < ENOUGH:
        return _COMMON.empty_table()
    pages, _, which, rows = _opened(table)
    stream = Stream(pages)
    counts = _counting(which, rows, side.column("value").to_numpy(), len(pages))
    keys = stream.classes(run)
    values, times = _distinct(keys, stream.page_of, counts)
    often = SOME * times > counts.sum()
    starts = np.flatnonzero(often[np.searchsorted(values, keys)]) if often.any() else np.empty(0, np.int64)
    h = stream.run_hashes(run)[starts] if len(starts) else np.empty(0, np.uint64)
    starts, h = starts[h > 0], h[h > 0]
    h, first = np.unique(h, return_index=True)
    n = times[np.searchsorted(values, keys[starts[first]])]
    host = table.column("host")[0].as_py()
    return pa.table({"host": pa.array([host] * len(h), pa.string()), "value": pa.array(h.view(np.int64)), "n": pa.array(n), "pages": pa.array(np.full(len(h), counts.sum(), np.int64))})


@tidy
def _counted(table: pa.Table, side: pa.Table, run: int) -> pa.Table:
    """On how many pages of a lot runs are. side: (kind, value, n): the rows that count (0), what is known already (1), what is to be counted (2)."""
    kind, value, n = (side.column(c).to_numpy() for c in ("kind", "value", "n"))
    values, times = value[kind == 1], n[kind == 1]
    if len(table) and (kind == 2).any():
        pages, _, which, rows = _opened(table)
        stream = Stream(pages)
        h = stream.run_hashes(run)
        asked = np.isin(h, value[kind == 2].view(np.uint64))
        own, on = _distinct(h[asked], stream.page_of[asked], _counting(which, rows, value[kind == 0], len(pages)))
        values, times = np.append(values, own.view(np.int64)), np.append(times, on)
    host = side.column("host")[0].as_py() if len(side) else ""
    return pa.table({"host": pa.array([host] * len(values), pa.string()), "value": pa.array(values), "n": pa.array(times)})


@tidy
def _main_text(table: pa.Table, side: pa.Table, run: int, least: int, share: float) -> pa.Table:
    """The pages of a lot with their texts. side: (kind, value, n): the rows that count (0) and, for a host of several lots, what they told (1)."""
    pages, marked, which, rows = _opened(table)
    kind, value, n = (side.column(c).to_numpy() for c in ("kind", "value", "n"))
    lots, total = (table.column(c)[0].as_py() if len(table) else 0 for c in ("lots", "contents"))
    counts, told = _counting(which, rows, value[kind == 0], len(pages)), None
    if lots > 1:
        h, times = value[kind == 1].view(np.uint64), n[kind == 1]
        order = np.argsort(h)
        told = h[order], times[order]
    if total >= least and (told is None or len(told[0])):
        gone = repeated(pages, marked, counts, total, run, least, share, told)
        pages = [[line for line, g in zip(lines, out, strict=True) if not g] for lines, out in zip(pages, gone, strict=True)]
    texts = pa.array(["\n".join(lines) for lines in pages], pa.string())
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": texts.take(pa.array(which))})


def extracted(pages: DataFrame, run: int = RUN, least: int = PAGES, share: float = SHARE, lot: int = LOT) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = rows.mapInArrow(_parsed, _PAGE)
    # pages are read twice rather than kept; a page goes to its lot packed
    slim = parsed.select("row", "host", "content", "tokens", "marked").groupBy("host", "content")
    leads = settle(slim.agg(F.min("row").alias("value"), F.sum("tokens").alias("tokens"), F.bool_or(~F.col("marked")).alias("open")))
    hosts = settle(leads.groupBy("host").agg(F.ceil(F.sum("tokens") / lot).cast("int").alias("lots"), F.count("*").alias("contents"), F.bool_or("open").alias("open")))
    dealt = lambda df, row: df.join(hosts, "host").withColumn("lot", F.pmod(F.xxhash64(row, F.lit(5)), F.col("lots")).cast("int"))
    tasks = 1 + int((leads.agg(F.sum("tokens")).first()[0] or 0) // lot)
    placed = dealt(parsed, "row").repartition(tasks, "host", "lot").groupBy("host", "lot")
    counting = dealt(leads.drop("open"), "value").select("host", "lot", F.lit(0).alias("kind"), "value", F.lit(0).cast("long").alias("n"))
    met = lambda side, work, columns: placed.cogroup(side.repartition(tasks, "host", "lot").groupBy("host", "lot")).applyInArrow(work, columns)
    side, each = counting, F.sequence(F.lit(0), F.col("lots") - 1)
    if hosts.where("lots > 1 and open").limit(1).count():
        told = met(counting, lambda t, s: _tell(t, s, run), "host string, lot int, value long, n long")
        every = told.withColumn("n", F.sum("n").over(Window.partitionBy("host", "value"))).where(F.col("n") >= least)
        side = side.unionByName(every.select("host", "lot", F.lit(1).alias("kind"), "value", "n"))
    if hosts.where(f"lots > 1 and not open and contents >= {ENOUGH}").limit(1).count():
        said = met(counting, lambda t, s: _common(t, s, run), "host string, value long, n long, pages long")
        summed = said.groupBy("host", "value").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")).join(hosts, "host")
        most = F.greatest(F.lit(least), MOST * F.col("contents"))
        known, may = F.col("n") >= most, SOME * F.col("n") + F.col("contents") - F.col("pages") >= SOME * most
        asked = summed.where(known | may).select("host", F.explode(F.when(known, F.array(F.lit(0))).otherwise(each)).alias("lot"), F.when(known, 1).otherwise(2).alias("kind"), "value", "n")
        sums = met(counting.unionByName(asked), lambda t, s: _counted(t, s, run), "host string, value long, n long").groupBy("host", "value").agg(F.sum("n").alias("n"))
        common = sums.join(hosts, "host").where(F.col("n") >= most)
        side = side.unionByName(common.select("host", F.explode(each).alias("lot"), F.lit(1).alias("kind"), "value", "n"))
    out = met(side, lambda t, s: _main_text(t, s, run, least, share), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


_TOLD = pa.schema([("host", pa.string()), ("lot", pa.int32()), ("value", pa.int64()), ("n", pa.int64())])
_COMMON = pa.schema([("host", pa.string()), ("value", pa.int64()), ("n", pa.int64()), ("pages", pa.int64())])
