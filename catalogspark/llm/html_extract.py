"""Main text of web pages by site style trees.

The DOMs of all pages of a host are merged by style: a style node is a path of tag and class labels. Of each style node
the merged tree knows in how many ways its children are laid out and how often its text repeats; both entropies, and
the share of link text, give its importance. A page's text, weighed by importance, then names the page's main branch,
and branches of low importance are cut from around and within it. What a page says of itself (tags, roles, class words)
is a prior on importance only: the branch that holds most of the important text is kept whatever it is called."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import stored
from .url_filter import url_parts

#: Branches of less importance are cut.
IMPORTANCE = 0.2
#: What is on fewer pages of a host than this share isn't boilerplate of the site. It also bounds the styles kept for a
#: host: 100 times as many as there are on a page.
MIN_SHARE = 0.01
#: Pages without a repeat that are added to each style node, so that few pages tell little: of two pages with one text
#: a third of the importance is left, of five pages a ninth.
DOUBT = 0.5
#: Prior importance of a block whose class or id is made of noise words, and of a form: little, as long as they don't
#: hold most of the page.
PRIOR_WORDS, PRIOR_FORM = 0.02, 0.02
#: The same of noise words within an article: repeats on other pages must agree.
PRIOR_INSIDE = 0.5
#: Prior importance of a block outside articles whose class or id says header, if it holds an h1: repeats decide.
PRIOR_TITLED = 0.5
#: Prior importance of text in an article or main element.
PRIOR_ARTICLE = 10.0
#: Pages of a host that one task takes in the join with the host's styles where that can't be broadcast.
HOST_ROWS = 100_000

_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)?")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BLANKS = re.compile(r"\s+")
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_READ = frozenset("class id role hidden aria-hidden style".split())

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never part of a page's text.
_SILENT = frozenset("script style noscript template iframe svg canvas audio video head title select option textarea noframes noembed annotation annotation-xml".split())
_RAW = frozenset("script style textarea title iframe noscript noframes noembed xmp".split())
_HEAD = frozenset("meta link title base script style noscript template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table thead tbody tr td th b i em strong a span code body html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NOISE_TAGS = frozenset("nav footer aside button menu dialog search".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Words of a class or id that speak against a branch.
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads adv advert advertisement advertising "
    "adverts sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe signup popup "
    "modal overlay share sharing social related recommended discussion pagination pager login search skip".split()
)
#: Words of a class or id of what readers say.
_READER_WORDS = frozenset("comment comments commentlist replies disqus respond".split())
#: Words of a class or id that do so only outside articles.
_TOP_WORDS = frozenset("header masthead banner toolbar topbar".split())
#: A class with one of these words says what a wrapper has, not what it is.
_WRAPPERS = frozenset("with without no not non has is layout page open show hide enabled disabled active".split())

_PLAIN, _TOP, _WORDS, _FORM, _NEVER = range(5)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1 << 16)
def _key(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d/%s" % (parent, label.encode("utf-8", "replace")), digest_size=8).digest(), "big", signed=True)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _label(tag: str, names: str, role: str, hidden: bool) -> tuple[str, bool, int]:
    """(style label, whether it has a class or id, what it says of itself)."""
    tokens = [[w.lower() for w in _WORD_PARTS.findall(token)] for token in names.split()]
    words = sorted({w for token in tokens for w in token})
    kind = _PLAIN
    if hidden or tag in _NOISE_TAGS or role in _NOISE_ROLES:
        kind = _NEVER
    elif tag == "form" or role == "form":
        kind = _FORM
    elif tag not in _INLINE and tag not in ("body", "html", "main", "article"):
        telling = [token for token in tokens if _WRAPPERS.isdisjoint(token)]
        if any(not _READER_WORDS.isdisjoint(token) for token in telling):
            kind = _NEVER
        elif any(not _NOISE_WORDS.isdisjoint(token) for token in telling):
            kind = _WORDS
        elif tag == "header" or any(not _TOP_WORDS.isdisjoint(token) for token in telling):
            kind = _TOP
    return f"{tag}.{'.'.join(words)}", bool(words), kind


_cached_label = lru_cache(maxsize=1 << 14)(_label)


class Page:
    """A forgiving DOM as flat lists, so that neither depth nor length of a page matters.

    Nodes are numbered in page order and node 0 is the document. ``events`` holds a number ``k`` where node ``k`` opens,
    ``~k`` where it closes, and texts between; ``opens[k]`` and ``closes[k]`` are these two places. One pass over the page: elements left
    open end with the element around them; end tags of what isn't open in the same block are skipped."""

    def __init__(self, html: str):
        self.tags, self.keys, self.named, self.kinds, self.parents = ["html"], [_key(0, "html")], [False], [_PLAIN], [-1]
        self.events: list[int | str] = [0]
        self.opens, self.closes = [0], [0]
        self._open, self._count = [0], {}
        self._inline: list[dict[str, int]] = [{}]  # inline elements open in each open block
        self._scopes = [(-1, -1, -1, -1, -1)]  # of each node: the p, li, dt or dd, cell and row that an opening tag would end
        self._has_body = False
        self._read(html)
        while self._open:
            self._pop()

    def _pop(self) -> None:
        k = self._open.pop()
        tag = self.tags[k]
        self.closes[k] = len(self.events)
        self.events.append(~k)
        if k:
            if self._is_block(tag):
                self._inline.pop()
                self._count[tag] -= 1
            else:
                self._inline[-1][tag] -= 1

    @staticmethod
    def _is_block(tag: str) -> bool:
        return tag not in _INLINE

    def _close(self, k: int) -> None:
        while self._open[-1] >= k:
            self._pop()

    def _say(self, text: str) -> None:
        at = self._open[-1]
        if self.tags[at] == "head" and not text.isspace():
            self._close(at)
        if self.tags[self._open[-1]] not in _SILENT:
            self.events.append(text)

    def _start(self, tag: str, names: str, role: str, hidden: bool, empty: bool) -> int:
        if self.tags[self._open[-1]] == "head" and tag not in _HEAD:
            self._close(self._open[-1])
        p, li, dd, cell, row = self._scopes[self._open[-1]]
        ends = -1
        if tag in ("td", "th"):
            ends = cell
        elif tag == "li":
            ends = li
        elif tag in ("dt", "dd"):
            ends = dd
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            ends = row
        if ends < 0 and tag in _BLOCKS:
            ends = p
        if ends >= 0:
            self._close(ends)
        at, k = self._open[-1], len(self.tags)
        label, named, kind = (_cached_label if len(names) < 200 else _label)(tag, names, role, hidden)
        self.tags.append(tag)
        self.keys.append(_key(self.keys[at], label))
        self.named.append(named)
        self.kinds.append(kind)
        self.parents.append(at)
        self.opens.append(len(self.events))
        self.closes.append(0)
        self.events.append(k)
        if empty:
            self.closes[k] = len(self.events)
            self.events.append(~k)
            self._scopes.append(self._scopes[at])
            return k
        self._open.append(k)
        scope = self._scopes[at]
        if self._is_block(tag):
            self._inline.append({})
            self._count[tag] = self._count.get(tag, 0) + 1
            if tag in _BLOCKS or tag in ("td", "th"):
                p, li, dd, cell, row = scope
                if tag == "table":
                    li, dd, cell, row = -1, -1, -1, -1
                scope = (
                    k if tag == "p" else -1,
                    k if tag == "li" else -1 if tag in ("ul", "ol", "menu") else li,
                    k if tag in ("dt", "dd") else -1 if tag == "dl" else dd,
                    k if tag in ("td", "th") else -1 if tag == "tr" else cell,
                    k if tag == "tr" else row,
                )
        else:
            self._inline[-1][tag] = self._inline[-1].get(tag, 0) + 1
        self._scopes.append(scope)
        return k

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if self._inline[-1].get(tag, 0) if not self._is_block(tag) else self._count.get(tag, 0):
            while self.tags[self._open[-1]] != tag:
                self._pop()
            self._pop()

    def _read(self, html: str) -> None:
        pos, size = 0, len(html)
        while pos < size:
            lt = html.find("<", pos)
            if lt < 0:
                self._say(html[pos:])
                return
            if lt > pos:
                self._say(html[pos:lt])
            mark = html[lt + 1 : lt + 2]
            if mark == "!" and html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    pos = html.index(">", lt + 4) + 1
                else:
                    end = html.find("-->", lt + 4)
                    pos = size if end < 0 else end + 3
                continue
            if mark in ("!", "?") and mark or mark == "/" and not _TAG_NAME.match(html, lt + 2):
                end = html.find(">", lt + 1)
                pos = size if end < 0 else end + 1
                continue
            name = _TAG_NAME.match(html, lt + 1 + (mark == "/"))
            if name is None:  # a sign, not a tag
                self._say("&lt;")
                pos = lt + 1
                continue
            tag = name[0].lower()
            if html.startswith(">", name.end()):
                pos, found = name.end() + 1, None
                closed = False
            else:
                pos, found, closed = self._attributes(html, name.end())
                if pos > size:
                    return  # a tag that never ends
            if mark == "/":
                self._end(tag)
            elif tag == "html" or tag == "body" and self._has_body:
                continue
            else:
                self._has_body |= tag == "body"
                names, role, hidden = "", "", False
                if found:
                    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
                    role = found.get("role", "").strip().lower()
                    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
                foreign = closed and (self._count.get("svg", 0) or self._count.get("math", 0))
                raw = tag in _RAW and not foreign
                self._start(tag, names, role, hidden, bool(tag in _VOID or raw or foreign))
                if raw:
                    end = _raw_end(tag).search(html, pos)
                    pos = size if end is None else end.start()

    @staticmethod
    def _attributes(html: str, pos: int) -> tuple[int, dict[str, str], bool]:
        """(place behind the tag, the attributes that are read, whether it ends with a slash); a quote that no other closes
        ends with the tag. Each character is looked at a bounded number of times: only the last quote can lack its other."""
        found: dict[str, str] = {}
        while True:
            m = _ATTRIBUTE.match(html, pos)
            if m[1] is None:
                pos = m.end()
                return pos + 1 if pos < len(html) else len(html) + 1, found, html[pos - 1] == "/"
            name = m[1].lower() if len(m[1]) < 20 else ""
            if name in _READ and name not in found:
                found[name] = m[2] or m[3] or m[4] or ""
            pos = m.end()


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def _decide(page: Page, importance: Mapping[int, float]) -> tuple[bytearray, list[int]]:
    """(which nodes are cut, the nodes whose text is the page's) by the importance of styles and the priors."""
    tags, kinds, parents, n = page.tags, page.kinds, page.parents, len(page.tags)
    inside = bytearray(n)  # in an article or main element
    for k in range(1, n):
        inside[k] = inside[parents[k]] or tags[k] in ("article", "main")
    titled = bytearray(tag == "h1" for tag in tags)  # holds an h1
    for k in range(n - 1, 0, -1):
        titled[parents[k]] |= titled[k]
    own = [1.0] * n
    for k in range(1, n):
        value = importance.get(page.keys[k], 1.0) if tags[k] not in _HEADINGS else 1.0
        kind = kinds[k]
        if kind == _NEVER:
            value = 0.0
        elif kind == _WORDS:
            value *= PRIOR_INSIDE if inside[k] else PRIOR_WORDS
        elif kind == _FORM:
            value *= PRIOR_FORM
        elif kind == _TOP and not inside[k]:
            value *= PRIOR_TITLED if titled[k] and tags[k] != "header" else PRIOR_WORDS
        own[k] = value
    # text weighed by the least importance above it; link text weighs nothing
    weight, link, mass = [1.0] * n, bytearray(n), [0.0] * n
    for k in range(1, n):
        up = parents[k]
        weight[k] = min(weight[up], own[k])
        link[k] = link[up] or tags[k] == "a"
    at = [0]
    for e in page.events[1:]:
        if isinstance(e, str):
            if not link[at[-1]]:
                k = at[-1]
                mass[k] += weight[k] * (PRIOR_ARTICLE if inside[k] else 1.0) * len(e.strip())
        elif e >= 0:
            at.append(e)
        else:
            at.pop()
    for k in range(n - 1, 0, -1):
        mass[parents[k]] += mass[k]
    main = 0  # the deepest node with most of the important text
    for k in range(1, n):
        if 2 * mass[k] > mass[0] > 0:
            main = k
    cut = bytearray(own[k] < IMPORTANCE for k in range(n))
    while main >= 0:  # no branch around it is cut
        cut[main] = 0
        main = parents[main]
    for k in range(1, n):
        cut[k] = cut[k] or cut[parents[k]]
    for name in ("main", "article"):
        outer = [k for k in range(1, n) if tags[k] == name and not cut[k]]
        roots, end = [], -1
        for k in outer:
            if page.closes[k] > end:
                roots.append(k)
                end = page.closes[k]
        if roots and 2 * sum(mass[k] for k in roots) >= mass[0]:
            return cut, [*_headline(page, importance, cut, titled, roots), *roots]
    return cut, [0]


def _headline(page: Page, importance: Mapping[int, float], cut: bytearray, titled: bytearray, roots: list[int]) -> list[int]:
    """What belongs to an article but stands before it, where the article has no h1 of its own: beside the article or
    what is around it, from the branch with an h1 that isn't on other pages too."""
    if any(titled[k] for k in roots):
        return []
    title = next((k for k in range(roots[0] - 1, 0, -1) if page.tags[k] == "h1" and not cut[k] and importance.get(page.keys[k], 1.0) >= IMPORTANCE), 0)
    around, k = set(), roots[0]
    while k >= 0:
        around.add(k)
        k = page.parents[k]
    while title and page.parents[title] not in around:
        title = page.parents[title]
    if not title:
        return []
    level = page.parents[title]
    return [k for k in range(title, roots[0]) if page.parents[k] == level and not cut[k] and k not in around]


def _gather(page: Page, cut: bytearray, root: int) -> list[str]:
    """The blocks of text of a branch."""
    out: list[list[str]] = [[]]
    events, tags = page.events, page.tags
    at, stop = page.opens[root] + 1, page.closes[root]
    while at < stop:
        e = events[at]
        if isinstance(e, str):
            out[-1].append(e)
        else:
            tag = tags[e if e >= 0 else ~e]
            if e >= 0 and (cut[e] or tag in _SILENT):
                at = page.closes[e]
            if tag in _BLOCKS:
                out.append([])
            elif tag in ("br", "td", "th"):
                out[-1].append(" ")
        at += 1
    clean = (_BLANKS.sub(" ", unescape("".join(b))).strip() for b in out if b)
    return [b for b in clean if b]


def main_text(html: str | None, importance: Mapping[int, float] | None = None) -> str:
    """The text of one page, given the importance of its host's style nodes as far as it is under 1."""
    if not html:
        return ""
    page = Page(html)
    cut, roots = _decide(page, importance or {})
    return "\n".join(block for root in roots for block in _gather(page, cut, root))


def _features(html: str) -> list[tuple[int, int, int, int, int]]:
    """(style, layout of the children, text hash, text length, link text length) of each style node of a page with text;
    nodes of one style are taken together. The first row is the whole body."""
    page = Page(html)
    tags, keys, parents, n = page.tags, page.keys, page.parents, len(page.tags)
    silent, link, judged = bytearray(n), bytearray(n), [-1] * n
    for k in range(1, n):
        up = parents[k]
        silent[k] = silent[up] or tags[k] in _SILENT
        link[k] = link[up] or tags[k] == "a"
        judged[k] = k if (tags[k] not in _PROSE or tags[k] == "h1" or page.named[k]) and not silent[k] else -1
    first: dict[int, int] = {}  # style: its number
    number = [first.setdefault(keys[k], len(first)) if judged[k] >= 0 else -1 for k in range(n)]
    layouts: list[list[str]] = [[] for _ in first]
    for k in range(1, n):
        if number[parents[k]] >= 0:
            layouts[number[parents[k]]].append(tags[k])
    # hashes and sizes of nodes are differences of running sums, however deep nodes are nested
    mask, power, inverse = (1 << 64) - 1, 1, 1
    sums, marks = (0, 0, 0), [(0, 0, 0, 1)] * n
    hashes, sizes, links = [0] * len(first), [0] * len(first), [0] * len(first)
    at = [0]
    for e in page.events[1:]:
        if isinstance(e, str):
            text = _BLANKS.sub(" ", e).strip()
            if text and not silent[at[-1]]:
                sums = ((sums[0] + _digest(text) * power) & mask, sums[1] + len(text), sums[2] + len(text) * link[at[-1]])
                power, inverse = power * _BASE & mask, inverse * _BASE_INVERSE & mask
        elif e >= 0:
            at.append(e)
            marks[e] = (*sums, inverse)
        else:
            at.pop()
            s = number[~e]
            if s >= 0:
                h, size, size_links, shift = marks[~e]
                hashes[s] = (hashes[s] * _BASE + (sums[0] - h) * shift) & mask
                sizes[s] += sums[1] - size
                links[s] += sums[2] - size_links
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = [(0, 0, signed(sums[0]), sums[1], sums[2])]
    out += [(key, _digest(",".join(layouts[s])), signed(hashes[s]), sizes[s], links[s]) for key, s in first.items() if sizes[s]]
    return out


_FEATURES = "host string, style long, layout long, content long, size long, links long"


def _all_features(batches):
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                rows += [(host, *f) for f in _features(html)]
        names = [x.strip().split(" ")[0] for x in _FEATURES.split(",")]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(6)], names=names)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, style, pages, host_pages, content, layout, link_share, importance) of the merged tree of each host.

    ``content`` and ``layout`` are entropies in units of log(pages), so that 1 means different on every page; content is
    measured against the same of whole pages, as copies of an article repeat it without being boilerplate. Importance is
    drawn towards 1 by DOUBT pages without a repeat, so that hosts with few pages need no rule of their own."""
    rows = pages.select("host", "html").mapInArrow(_all_features, _FEATURES)
    seen = rows.groupBy("host", "style", "content", "layout").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    seen = stored(seen, "styles")
    by = lambda what: seen.groupBy("host", "style", what).agg(F.sum("n").alias("n")).groupBy("host", "style").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("e")
    ).select("host", "style", "pages", F.when(F.col("pages") > 1, 1 - F.col("e") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(what))
    size = seen.groupBy("host", "style").agg(F.sum("size").alias("size"), F.sum("links").alias("links"))
    nodes = by("content").join(by("layout").drop("pages"), ["host", "style"]).join(size, ["host", "style"])
    whole = nodes.where("style = 0").select("host", F.col("pages").alias("host_pages"), F.col("content").alias("whole"))
    # an entropy of whole pages near 0 says that all pages are copies: then nothing is known to be boilerplate
    relative = F.when(F.col("whole") > 0.05, F.least(F.lit(1.0), F.col("content") / F.col("whole"))).otherwise(1.0)
    share = F.least(F.lit(1.0), F.col("links") / F.greatest("size", F.lit(1)))
    nodes = nodes.where("style <> 0").join(whole, "host").withColumn("content", relative).withColumn("link_share", share)
    seen_much = F.col("pages") - 1
    entropy = (seen_much * (0.8 * F.col("content") + 0.2 * F.least("content", "layout")) + DOUBT) / (seen_much + DOUBT)
    return nodes.withColumn("importance", entropy * (1 - F.col("link_share")))


def _with_styles(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``pages`` with the styles of their host; the planner broadcasts a small ``known``, otherwise hosts with more than
    HOST_ROWS pages are dealt to several tasks."""
    big = stored(known.where(F.col("host_pages") > HOST_ROWS).select("host", F.ceil(F.col("host_pages") / HOST_ROWS).cast("int").alias("parts")), "hosts")
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    # big hosts are few: each has HOST_ROWS pages
    dealt = pages.join(F.broadcast(big), "host", "left").withColumn("part", part.cast("int"))
    copies = known.join(F.broadcast(big), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.join(copies.select("host", "part", "styles"), ["host", "part"], "left")


def extract(pages: DataFrame, cuts: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages(page_id, url, html, ...)``.

    Character references are decoded, white space within a block becomes one blank, blocks are joined by line ends in
    page order. Null or empty html gives an empty text; null urls share the empty host; repeated rows come back as often
    as they came; further columns are ignored; an empty table gives no rows. The page's main branch is the deepest with
    most of its important text; branches around it stay, others of less importance than IMPORTANCE go. Headings, and
    unnamed paragraphs and lists, aren't judged by themselves. Tags that aren't finished are markup; a quote that nothing
    closes ends with its tag. A page without anything important outside menus, footers and the like has an empty text.
    Without ``cuts`` the entropies aren't asked (for comparison)."""
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = url_parts(slim.select(F.struct("page_id", "url", "html").alias("page_id"), "url")).select("page_id.*", "host")
    if cuts:
        low = style_tree(host).where((F.col("pages") >= MIN_SHARE * F.col("host_pages")) & (F.col("importance") < 0.6))
        kept = F.collect_list(F.struct("style", F.col("importance").cast("float").alias("importance")))
        known = stored(low.groupBy("host").agg(F.max("host_pages").alias("host_pages"), kept.alias("styles")), "importance")
        host = _with_styles(host, known)
    else:
        host = host.withColumn("styles", F.expr("cast(null as array<struct<style:long,importance:float>>)"))

    def run(batches):
        for batch in batches:
            texts, known = [], {}
            for host, html, styles in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("styles"), strict=True):
                if host not in known:
                    known = {host: {x["style"]: x["importance"] for x in styles.as_py() or ()}}
                texts.append(main_text(html.as_py(), known[host]))
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kind = dict(pages.dtypes)["page_id"]
    return host.select("page_id", "url", "host", "html", "styles").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
