"""Main text of web pages by consensus of their hosts.

Every page scores its containers by the running text inside of them, however deep. A container is
known by its generalised path, the tags and classes from the body down with numbers taken out,
and every page of a host votes for those that hold its text. Pages are then extracted again by the
winners, each standing for all that is inside of it, so a page whose own text is short or odd still
follows its site's template. Pages also vote on blocks: what stands beside the winner (a heading, a lead, a last part) belongs
to the article too, unless it is marked, mostly links, or said again on other pages of the host.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.session import materialize

# A container wins with the votes of at least this share of its host's pages.
WINNING_SHARE = 0.1
# A container holds a page with at least this share of its running text; main and article are named by the page.
HOLDS, WHOLE_HOLDS = 0.8, 0.51
# A block that different pages of a host have is no page's own, from this share of its pages on.
COMMON_SHARE = 0.01
# The table of winning paths is broadcast up to so many bytes; beyond, pages are shuffled by host.
BROADCAST_BYTES = 8 << 20

_RAW = "script|style|noscript|template|iframe|svg|textarea|title|object|canvas"
_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"


def _token(empty: str) -> re.Pattern[str]:
    """Comments, tags, and raw elements as a whole; those of ``empty`` have no inside if their start tag ends in a slash."""
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?:{empty})\b{_REST}/>|<(?P<raw>{_RAW})\b.*?(?:</(?P=raw)\s*>|\Z)"
        rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>{_REST})>|<[!?/][^>]*>",
        re.I | re.S,
    )


# HTML knows the slash in foreign elements only, XHTML in all.
_HTML, _XHTML = _token("svg"), _token(_RAW)
_IS_XHTML = re.compile(r"\s*(?:<\?xml|<!doctype[^>]*?//dtd xhtml|(?:<!doctype[^>]*>\s*)?<html\b[^>]*1999/xhtml)", re.I | re.S)
_CUT_OFF = re.compile(r"<[a-z/!][^>]*\Z", re.I)  # a tag that the end of the page cuts off
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMBERS = re.compile(r"\d+")
# Elements that are never part of an article.
_ASIDE = frozenset("head nav header footer aside form menu dialog button select option label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that make up a path; all others are text marks inside of them.
_CONTAINERS = frozenset("main article section div table tbody tr td center".split())
_WHOLE = frozenset(("main", "article"))  # text below these counts for them, however deep it is
_BLOCKS = _CONTAINERS | frozenset(
    "html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hr th thead tfoot caption details summary".split()
)
# Class, id or role that marks what stands around an article: one of these words, alone or with a place before it and a shape after it.
_AROUND = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post|entry|article|blog|wp|js)[-_])*"
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|navigation|menus?|menubar|breadcrumbs?"
    r"|header|masthead|footer|foot|side-?bars?|side|aside|widgets?|cookies?|consent|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe"
    r"|signup|login|search|share|sharing|social|related|recommended|recommendations?|comments?|commentlist|replies|reply|respond|disqus|pagination"
    r"|pager|toolbar|complementary|contentinfo)"
    r"(?:[-_](?:area|bar|box|block|list|links?|items?|section|container|wrap|wrapper|inner|outer|panel|form|posts?|articles?|stories|threads?|buttons?"
    r"|icons?|widgets?|top|bottom|left|right|main|primary|secondary|banner|menu|nav|slot|unit|[0-9]+))*"
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())  # say nothing by themselves
# Ids of these are mostly targets of links, those of sections too unless they are one of a few.
_ANCHORS = frozenset("p li dt dd blockquote pre figure figcaption caption summary".split())
_SECTION_IDS = re.compile(r"comments?|respond|disqus|side-?bars?|newsletter|breadcrumbs?|related[-_](?:posts?|articles?|links?|stories)")
_MARK = "!"  # before the part of a container whose names mark it: its blocks count only if its host opens it


def _path_name(tag: str, rest: str) -> tuple[str, bool]:
    """A container's part of the path, and whether its names mark it as standing around the article."""
    names, around = "", False
    for kind, *values in _NAMES.findall(rest):
        tokens, kind = "".join(values).lower().split(), kind.lower()
        if kind != "id" or tag not in _ANCHORS:
            words = _SECTION_IDS if kind == "id" and tag == "section" else _AROUND
            around |= any(words.fullmatch(t) for t in tokens)
        if kind == "class":
            names = "".join(sorted(f".{_NUMBERS.sub('#', c).replace('>', '')}" for c in tokens))
    return tag + names, around and tag not in ("html", "body") and tag not in _HEADINGS


def blocks(html: str | None) -> list[tuple[str, str, int, tuple[int, ...]]]:
    """Blocks of running text in page order: (path of the container, text, characters in links, numbers of the path's elements).

    Character references are decoded, white space is one space. Tags need not be balanced: an end tag closes up to its
    start tag, or nothing. An element that is never part of an article hides all inside of it; a container marked by its names
    stays in the path with ``_MARK``, also below main or article.
    """
    found: list[tuple[str, str, int, tuple[int, ...]]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, part of the path or "", hides, place on the page
    pieces: list[str] = []
    linked = hidden = in_link = at = 0
    html = html or ""
    tokens = _XHTML if _IS_XHTML.match(html) else _HTML

    def close() -> None:
        nonlocal linked
        if pieces and (text := " ".join(unescape("".join(pieces)).split())):
            parts = [(tag, part, place) for tag, part, _, place in stack if part]
            whole = next((i for i, (tag, _, _) in enumerate(parts) if tag in _WHOLE), len(parts) - 1)
            path = [(part, place) for i, (_, part, place) in enumerate(parts) if i <= whole or part[0] == _MARK]
            found.append((">".join(part for part, _ in path), text, linked, tuple(place for _, place in path)))
        pieces.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if not hidden and text:
            pieces.append(text)
            linked += len(text) if in_link else 0

    for token in tokens.finditer(html):
        take(html[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in _BLOCKS or tag in _ASIDE:
            close()
        if tag == "a":
            in_link = not token["end"]
        if token["end"]:
            if any(tag == t for t, *_ in stack):
                while True:
                    name, _, hides, _ = stack.pop()
                    hidden -= hides
                    if name == tag:
                        break
        elif tag not in _VOID and (tag in _BLOCKS or tag in _ASIDE) and not token["rest"].endswith("/"):
            name, around = _path_name(tag, token["rest"])
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                hidden -= stack.pop()[2]
            hides = tag in _ASIDE or (around and tag not in _CONTAINERS)
            hidden += hides
            stack.append((tag, _MARK * around + name if tag in _CONTAINERS else "", hides, at))
    take(_CUT_OFF.sub("", html[at:]))
    close()
    return found


def _score(text: str, linked: int) -> int:
    """Running text: characters outside links, short scraps counting little."""
    return max(0, len(text) - 2 * linked) if len(text) >= 25 else 1


class Tree:
    """The containers of a page: per node its key (a digest of its path), parent, least share to hold the page, and text below it.

    A node of several elements holds no page, as each is a part of what is around them.
    ``opened`` are the marked nodes that hold most of all text, or those among the host's ``winners``; what is inside of other
    marked nodes does not count.
    """

    def __init__(self, found: list[tuple[str, str, int, tuple[int, ...]]], winners: list[bytes] | None = None) -> None:
        self.keys, self.parents, self.least, self.depths = [b""], [-1], [0.0], [0]
        self.children: dict[tuple[int, str], int] = {}
        self.marked: list[int] = []
        self.at: dict[str, int] = {}
        here: dict[int, int] = defaultdict(int)
        self.places = [0]
        self.named = False  # a main or article is outside of marked nodes, so none of these is opened
        self.several: set[int] = set()
        seen: set[tuple[int, ...]] = set()
        for path, text, linked, places in found:
            if places not in seen:
                seen.add(places)
                self.at[path] = self._node(path, places)
            here[self.at[path]] += _score(text, linked)
        whole = self._below(here, frozenset())
        wanted = frozenset(winners) if winners is not None else frozenset() if self.named else None
        opens = lambda n: whole[n] >= HOLDS * whole[0] > 0 if wanted is None else self.keys[n] in wanted
        self.opened = frozenset(n for n in self.marked if opens(n))
        self.shut = frozenset(self.marked) - self.opened
        self.scores = self._below(here, self.shut) if self.shut else whole
        self.any = whole[0] > 0

    def _below(self, here: dict[int, int], shut: frozenset[int]) -> list[int]:
        """Text inside of every node, none for those in ``shut`` and all inside of them."""
        closed = [False] * len(self.keys)
        for n, parent in enumerate(self.parents):  # a parent comes before its children
            closed[n] = n in shut or (n > 0 and closed[parent])
        out = [0 if closed[n] else here.get(n, 0) for n in range(len(self.keys))]
        for n in range(len(self.keys) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out

    def _node(self, path: str, places: tuple[int, ...]) -> int:
        node, plain = 0, True
        for part, place in zip(path.split(">") if path else (), places, strict=True):
            if (child := self.children.get((node, part))) is None:
                child = self.children[node, part] = len(self.keys)
                self.keys.append(xxhash.xxh3_128_digest(self.keys[node] + part.encode()))
                self.parents.append(node)
                self.least.append(WHOLE_HOLDS if re.split(r"\.", part, maxsplit=1)[0] in _WHOLE else HOLDS)
                self.depths.append(self.depths[node] + 1)
                self.places.append(place)
                if part[0] == _MARK:
                    self.marked.append(child)
            elif self.places[child] != place:
                self.several.add(child)
            plain &= part[0] != _MARK
            self.named |= plain and self.least[child] == WHOLE_HOLDS
            node = child
        return node

    def holds(self, n: int) -> bool:
        """Whether the node's subtree holds the page's running text; the body always does."""
        return n == 0 or (n not in self.several and self.scores[n] >= self.least[n] * self.scores[0] > 0)

    def own(self) -> int:
        """The deepest node that holds the page; nodes that do lie on one path."""
        return max((n for n in range(len(self.keys)) if self.holds(n)), key=lambda n: self.depths[n])

    def followed(self, winners: list[bytes]) -> int | None:
        """From the body down to the host's best winners that the page has; None if it has only the body of several."""
        node_of = {k: n for n, k in enumerate(self.keys)}
        at = 0
        for n in (node_of[w] for w in winners if w in node_of):
            if self.inside(n, at):
                at = n
        return at if at or len(winners) == 1 else None

    def inside(self, n: int, top: int) -> bool:
        """Whether a node is in ``top``, with no shut one between."""
        while self.depths[n] > self.depths[top] and n not in self.shut:
            n = self.parents[n]
        return n == top


def _block_digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _beside(tree: Tree, found: list[tuple[str, str, int, tuple[int, ...]]]) -> Iterator[tuple[str, int]]:
    """(path, digest) of blocks that may belong to an article though its container does not hold them: unmarked and not links.

    None on a page that names its article by an element.
    """
    for path, text, linked, _ in found if not tree.named else ():
        if 2 * linked < len(text) and tree.inside(tree.at[path], 0):
            yield path, _block_digest(text)


def extracted(
    found: list[tuple[str, str, int, tuple[int, ...]]],
    winners: list[bytes] | None,
    usual: list[dict] | None = None,
    common: list[int] | None = None,
) -> str:
    """All blocks inside the host's best container that the page has, else inside its own best one, joined by \n.

    With ``usual``, the host's containers and how many pages have them, and ``common``, the digests of its common blocks, also
    blocks beside it that are none of the latter and stand in containers that half as many pages have as have that one.
    """
    tree = Tree(found, winners or None)
    top = tree.followed(winners) if winners else None
    if top is None:
        tree = Tree(found)
        top = tree.own()
    kept = {path for path, n in tree.at.items() if tree.inside(n, top)}
    known, own = set(common or ()), set()
    if usual is not None:
        pages = {u["node"]: u["pages"] for u in usual}
        least = pages.get(tree.keys[top], 1 << 62) / 2
        placed = ((path, d, pages.get(tree.keys[tree.at[path]], 0)) for path, d in _beside(tree, found))
        own = {(path, d) for path, d, n in placed if d not in known and n >= least}
    return "\n".join(text for path, text, *_ in found if path in kept or (own and (path, _block_digest(text)) in own))


def _host():
    """Host of an address in lower case; empty where there is none."""
    return F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def votes(pages: DataFrame) -> DataFrame:
    """(host, node, depth, held, pages, low, high): on how many pages of a host a container is, and on how many it holds the running text.

    Rows of depth -1 are blocks that may stand beside a container, by their digest: ``held`` counts their pages. ``low`` and
    ``high`` are the least and greatest digests of the pages, which tell pages from one page repeated. Summed in each task
    before they are shuffled. Pages without running text do not vote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, bytes, int], list[int]] = defaultdict(lambda: [0, 0, 1 << 63, -(1 << 63)])
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = blocks(html)
                tree = Tree(found)
                if not tree.any:
                    continue
                page = _block_digest("\n".join(text for _, text, *_ in found))
                voted = [(tree.keys[n], tree.depths[n], tree.holds(n) or n in tree.opened) for n in range(len(tree.keys))]
                voted += [(d.to_bytes(8, "big", signed=True), -1, True) for d in {d for _, d in _beside(tree, found)}]
                for node, depth, held in voted:
                    counts = total[host, node, depth]
                    counts[:] = counts[0] + held, counts[1] + 1, min(counts[2], page), max(counts[3], page)
            kinds = (pa.string(), pa.binary(), pa.int64())
            columns = [pa.array([k[i] for k in total], t) for i, t in enumerate(kinds)]
            columns += [pa.array([c[i] for c in total.values()], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "node", "depth", "held", "pages", "low", "high"])

    rows = pages.select(_host().alias("host"), F.col("html").cast("string")).where("host != ''")
    found = rows.mapInArrow(run, "host string, node binary, depth long, held long, pages long, low long, high long")
    counts = [F.sum("held").alias("held"), F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high")]
    return found.groupBy("host", "node", "depth").agg(*counts)


def winning_paths(pages: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """(host, winners, usual, common): the containers that hold the text on at least ``share`` of a host's pages and on most pages that have them.

    The most held come first; of equals the outer one. usual has the containers that at least
    ``share`` of its pages have and how many do, common the digests of blocks that different pages have. Both are null where all pages are one, which cannot tell.
    """
    cast = materialize(votes(pages), "votes")
    total = cast.where("depth = 0").select("host", F.col("pages").alias("total"), (F.col("low") < F.col("high")).alias("differ"))
    best = cast.where("depth >= 0").join(total, "host").where((F.col("held") >= share * F.col("total")) & (2 * F.col("held") > F.col("pages")))
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("held"), "depth", "node")))
    paths = best.groupBy("host").agg(F.transform(ranked, lambda x: x["node"]).alias("winners"))
    often = cast.where("depth >= 0").join(total, "host").where("differ").where(F.col("pages") >= share * F.col("total")).where("low < high")
    usual = often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages"))).alias("usual"))
    several = cast.where("depth = -1 and low < high").join(total, "host").where(F.col("held") >= COMMON_SHARE * F.col("total"))
    digest = F.conv(F.hex("node"), 16, -10).cast("long")
    blocks_of = several.groupBy("host").agg(F.sort_array(F.collect_list(digest)).alias("blocks"))
    common = F.coalesce("blocks", F.array().cast("array<long>")).alias("common")
    return paths.join(usual, "host", "left").join(blocks_of, "host", "left").select("host", "winners", "usual", common)


def extract(pages: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """(page_id, url, text): the main text of each row of pages; empty where there is none.

    A null html is empty. Pages without a host, and pages that have none of their host's paths, use their own best container.
    Blocks beside the container that only this page of its host has are kept in page order, unless the page names its article by an element.
    Repeated rows stay; other columns are ignored. The table of winners is broadcast if its measured size is
    at most ``BROADCAST_BYTES``; else pages are joined to it by host, where the adaptive skew join splits large hosts.
    """
    winners = materialize(winning_paths(pages, share), "winners")
    bytes_of = F.length("host") + 16 * F.size("winners") + 24 * F.coalesce(F.size("usual"), F.lit(0)) + 8 * F.size("common") + 64
    size = winners.agg(F.sum(bytes_of)).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host().alias("host"))
    joined = rows.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)
            texts = pa.array([extracted(blocks(html), *host) for html, *host in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    schema = T.StructType([*rows.select("page_id", "url").schema, T.StructField("text", T.StringType())])
    return joined.select("page_id", "url", "html", "winners", "usual", "common").mapInArrow(run, schema)
