"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with one path (tags and classes from the root) are one style node.
Its importance comes from two entropies over the host's pages, that of its presentations (sequences of child elements)
and that of its contents (the text below): the larger one's perplexity, which is the number of different things the
pages as good as show, by the number of pages. Where all show the same it is near 0, where each shows its own 1. Every
element of every page is held against the tree. What else is known of it only shifts its importance: tags that are
menus, footers and the like push it down all the way, class words as far as they are clear, and a place in an article
lifts it. Branches that end up below the threshold are removed. Of what is left, a marked article is taken when it
holds most of the prose; short articles beside a longer story are teasers.

Pages are parsed once; elements and blocks of text are stored, and all else works on those.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import materialize, ship

#: Comments, declarations and tags; an attribute value may hold ">", and a quote that is never closed is a character.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
OPEN_COMMENT = re.compile("<!--.*()()", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
HIDDEN, NO_DISPLAY = re.compile(r"(?:^|\s)hidden(?:\s|/?$)"), re.compile(r"display\s*:\s*none")
#: Elements whose content is not markup, up to their end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold no text of a page, and those that are no part of an article.
NO_TEXT = {"head", "template", "svg", "math", "object", "canvas", "audio", "video", "applet", "map"}
ASIDE = {"nav", "footer", "aside", "form", "select", "button", "dialog", "menu"}
#: Words of class names, ids and roles that say the same.
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs consent complementary contentinfo "
    "cookie cookies disclaimer footer gdpr login menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Those of reader comments, which count anywhere in a name.
COMMENTS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "respond"}
#: Headers of a page, not of the article, alone or behind such words.
HEADERS, OF_PAGE = {"header", "masthead", "topbar"}, {"site", "page", "top", "global"}
#: What a start tag closes if it is open: items and cells of their own kind, and paragraphs by any block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What is known of an element: the main part, an article, no part of one, a page's header, a clear name, a hint of a name, reader comments, hidden.
MAIN, ARTICLE, TAG, HEADER, CLEAR, HINT, TALK, SHUT = 1, 2, 4, 8, 16, 32, 64, 128
#: Importance where too few pages show a node, what names take from it, and what a place in an article adds, or most of a page's prose.
NEUTRAL, BY_NAME, BY_HINT, IN_ARTICLE, HOLDS = 1.0, 0.75, 0.2, 0.2, 0.35
#: Up to so many style nodes of little importance are sent to every task; beyond, they are joined to the pages.
SENT = 50_000


def said(tokens: list[str]) -> int:
    """What the words of class names, ids and roles say of an element."""
    found = 0
    for token in tokens:
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
        if not words:
            continue
        if not COMMENTS.isdisjoint(words):
            found |= CLEAR | TALK
        elif words[-1] in NAMES:
            found |= CLEAR
        elif words[-1] in HEADERS and OF_PAGE.issuperset(words[:-1]):
            found |= HEADER
        elif not NAMES.isdisjoint(words):
            found |= HINT
    return found


class Page:
    """A parsed page: elements (each after its parent) and segments of text, each with its element and block.

    A block is text without a block element inside; inline elements with names of their own cut it into segments.
    Elements nest as deep as they do; the time is linear in the page.
    """

    def __init__(self, source: str):
        # By element; 0 is the page.
        self.parent, self.node, self.facts = [0], [0], [0]
        self.children: list[list[str]] = [[]]
        self.content = [xxhash.xxh32()]
        # By segment: text, element, block, characters outside of links.
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.block: list[int] = []
        self.prose: list[int] = []
        # What is open: tag and element; where each tag stands, and where the block elements stand.
        self.open: list[tuple[str, int]] = [("", 0)]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = [0]
        self.parts: list[str] = []
        self.linked = self.blocks_ended = 0
        at, last = 0, source.rfind(">")
        while at < len(source):
            # After the last ">" there is no tag, and a comment that opens is never closed.
            found = MARKUP.search(source, at) if at <= last else OPEN_COMMENT.search(source, at)
            if text := source[at : found.start() if found else len(source)]:
                self.parts.append(text)
                if self.where["a"]:
                    self.linked += len(text)
            if not found:
                break
            at = found.end()
            if tag := (found[2] or "").lower():
                if found[1]:
                    self._end(tag)
                elif tag in RAW:  # whatever its attributes: a slash at the end does not close it
                    close = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else len(source)
                else:
                    self._start(tag, found[3])
        self._cut(True)
        while len(self.open) > 1:
            self._pop()

    def _cut(self, block: bool) -> None:
        """End a segment, and the block with it."""
        if self.parts:
            # A reference is decoded before white space is joined, so that a no-break space counts.
            text = html.unescape("".join(self.parts))
            text = f"{' ' if text[:1].isspace() else ''}{' '.join(text.split())}{' ' if text[-1:].isspace() else ''}"
            element = self.open[-1][1]
            self.content[element].update(text)
            self.texts.append(text)
            self.owner.append(element)
            self.block.append(self.blocks_ended)
            self.prose.append(max(0, len(text.strip()) - self.linked))
            self.parts, self.linked = [], 0
        self.blocks_ended += block

    def _pop(self) -> None:
        tag, element = self.open.pop()
        self.where[tag].pop()
        if self.blocks[-1] == len(self.open):
            self.blocks.pop()
        above = self.open[-1][1]
        if element != above:
            self.content[above].update(self.content[element].digest())

    def _start(self, tag: str, raw: str) -> None:
        if tag not in INLINE:
            if tag != "br":
                self._cut(True)
            for place in reversed(self.blocks[1:] if self.where["p"] or tag in CLOSES else ()):
                inner = self.open[place][0]
                if inner in CLOSES.get(tag, ()) or inner == "p" and tag not in VOID:
                    while len(self.open) > place:
                        self._pop()
                elif inner not in ("td", "th"):
                    break
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        attributes, names, facts = {}, [], 0
        if raw:
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw) if m[1]}
            names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split()
            facts = said(names)
            if HIDDEN.search(raw) or attributes.get("aria-hidden") == "true" or NO_DISPLAY.search(attributes.get("style", "")):
                facts |= SHUT
        if tag == "article":
            facts |= ARTICLE
        elif tag == "main" or attributes.get("role") == "main":
            facts |= MAIN
        if tag in ASIDE:
            facts |= TAG
        elif tag == "header":
            facts |= HEADER
        if tag in NO_TEXT:
            facts |= SHUT
        element = above = self.open[-1][1]
        if tag not in INLINE or facts:  # inline elements that say nothing are part of what is around them
            if tag in INLINE:
                self._cut(False)
            element = len(self.node)
            style = f"{tag}.{'.'.join(names)}"
            self.parent.append(above)
            self.node.append(xxhash.xxh64_intdigest(style, seed=self.node[above]))
            self.facts.append(facts)
            self.children[above].append(style)
            self.children.append([])
            self.content.append(xxhash.xxh32())
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.where[tag].append(len(self.open))
        self.open.append((tag, element))
        if raw.endswith("/") and tag not in INLINE | {"p", "div"}:
            self._pop()

    def _end(self, tag: str) -> None:
        inline = tag in INLINE
        if self.where[tag]:
            place = self.where[tag][-1]
            if inline and place < self.blocks[-1]:
                return
            if not inline or self.open[-1][1] != self.open[place - 1][1]:
                self._cut(not inline)
            while len(self.open) > place:
                self._pop()
        elif not inline and tag != "br":
            self._cut(True)

    def style_nodes(self) -> dict[int, tuple[int, int]]:
        """Presentation and content of each style node that may show text: of several elements, summed up."""
        found: dict[int, tuple[int, int]] = {}
        for k in range(1, len(self.node)):
            if not self.facts[k] & SHUT:
                style, content = found.get(self.node[k], (0, 0))
                found[self.node[k]] = (style + xxhash.xxh32_intdigest(" ".join(self.children[k]))) & 0xFFFFFFFF, (content + self.content[k].intdigest()) & 0xFFFFFFFF
        return found


def removed(parent: list[int], node: list[int], facts: list[int], held: list[int], low: dict[int, float], threshold: float) -> tuple[list[bool], list[int]]:
    """Whether each element is removed, and those that the tree alone removes: whose importance in `low` is below the threshold.

    held: prose in each element and below.
    """
    n = len(parent)
    marked = [k & (MAIN | ARTICLE) for k in facts]
    for k in range(n - 1, 0, -1):
        marked[parent[k]] |= marked[k]
    gone, inside, by_tree = [False] * n, [False] * n, []
    for k in range(1, n):
        above, known = parent[k], facts[k]
        inside[k] = inside[above] or bool(known & (MAIN | ARTICLE))
        if gone[above]:
            gone[k] = True
            continue
        importance = low.get(node[k], NEUTRAL)
        score = importance + IN_ARTICLE * (inside[k] and not known & CLEAR)
        # A name says nothing of what holds the article, or most of a page that marks none.
        holds = marked[k] or not marked[0] and 2 * held[k] > held[0] and not known & TALK
        if holds:
            score += HOLDS
        elif known & (CLEAR | HINT):
            score -= BY_NAME if known & CLEAR else BY_HINT
        if known & (SHUT | TAG) or known & HEADER and not inside[above]:
            score -= 2
        gone[k] = score < threshold
        if importance < threshold:
            by_tree.append(k)
    return gone, by_tree


def main_text(parent: list[int], node: list[int], facts: list[int], texts: list[str], owner: list[int], block: list[int], prose: list[int], low: dict[int, float], threshold: float) -> str:
    """The main text of a parsed page: what its tree leaves, in the part that is marked as the main one if that holds most of the prose."""
    n = len(parent)
    held = [0] * n
    for k, size in zip(owner, prose, strict=True):
        held[k] += size
    for k in range(n - 1, 0, -1):
        held[parent[k]] += held[k]
    gone, _ = removed(parent, node, facts, held, low, threshold)
    scope = [not g for g in gone]
    for mark in (MAIN, ARTICLE):
        within = [False] * n
        for k in range(1, n):
            within[k] = scope[k] and (within[parent[k]] or bool(facts[k] & mark))
        if any(within):
            total = sum(size for k, size in zip(owner, prose, strict=True) if scope[k])
            part = sum(size for k, size in zip(owner, prose, strict=True) if within[k])
            if 2 * part >= total:
                scope = within
            elif mark == ARTICLE:  # teasers beside a story
                scope = [a and not b for a, b in zip(scope, within, strict=True)]
    lines: list[list[str]] = []
    last, left_out = -1, False
    for text, element, number in zip(texts, owner, block, strict=True):
        if number != last:
            lines.append([])
            last, left_out = number, False
        if scope[element]:
            lines[-1].append(f" {text}" if left_out else text)
        left_out = not scope[element]
    return "\n".join(line for parts in lines if (line := " ".join("".join(parts).split())))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: A parsed page as a row. own: a hash of its html; nodes, styles, contents: each style node once.
PARSED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("own", pa.int64()), ("nodes", pa.list_(pa.int64())), ("styles", pa.list_(pa.int64())), ("contents", pa.list_(pa.int64())),
    ("parent", pa.list_(pa.int32())), ("node", pa.list_(pa.int32())), ("facts", pa.list_(pa.int16())), ("texts", pa.list_(pa.string())), ("owner", pa.list_(pa.int32())), ("block", pa.list_(pa.int32())), ("prose", pa.list_(pa.int32())),
])
PARSED_SQL = "page_id long, url string, host string, own long, nodes array<long>, styles array<long>, contents array<long>, parent array<int>, node array<int>, facts array<smallint>, texts array<string>, owner array<int>, block array<int>, prose array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """PARSED rows of pages (page_id, url, html); node is an element's place in nodes (0: a node without text; the page itself)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, source in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                text = source.as_py() or ""
                page = Page(text)
                nodes = page.style_nodes()
                place = {node: k for k, node in enumerate(nodes, 1)}
                styles, contents = zip(*nodes.values(), strict=True) if nodes else ((), ())
                rows.append((
                    page_id, url, host_of(url), _signed(xxhash.xxh64_intdigest(text)), [_signed(n) for n in nodes], styles, contents,
                    page.parent, [place.get(n, 0) for n in page.node], page.facts, page.texts, page.owner, page.block, page.prose,
                ))
                if sum(len(r[10]) + len(r[7]) for r in rows) > 100_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, PARSED_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PARSED, strict=True)], schema=PARSED)


def importance(pages: DataFrame, *, least_pages: int) -> DataFrame:
    """(host, node, importance) of style nodes on at least least_pages different pages of their host.

    exp(H) / pages for the larger of the entropies of presentations and of contents: 1 if each page shows its own.
    """
    # Copies of a page say nothing about its site.
    once = pages.select("host", "own", "nodes", "styles", "contents").dropDuplicates(["host", "own"])
    shown = once.select("host", F.explode(F.arrays_zip("nodes", "styles", "contents")).alias("n"))
    shown = shown.select("host", "n.nodes", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("n.styles").alias("what")), F.struct(F.lit(1).alias("of"), F.col("n.contents").alias("what")))).alias("x"))
    counts = shown.groupBy("host", F.col("nodes").alias("node"), "x.of", "x.what").agg(F.count(F.lit(1)).alias("k"))
    sums = counts.groupBy("host", "node", "of").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s")).where(F.col("m") >= least_pages)
    perplexity = F.exp(F.log("m") - F.col("s") / F.col("m"))
    return sums.groupBy("host", "node").agg(F.max(perplexity / F.col("m")).alias("importance"))


def extract(pages: DataFrame, *, least_pages: int = 8, threshold: float = 0.5) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    text: the blocks of the article in page order, one a line, character references decoded, white space within a block
    as one space. Every element is judged by the importance of its style node (NEUTRAL where fewer than least_pages
    different pages of the host show it), shifted by what its tag, its names and a mark of the article say; branches
    below the threshold go.

    A null or empty html gives an empty text; null urls and those without a host form one host. Very long pages and deeply
    nested ones are parsed whole, in a time that grows with their length. Repeated rows are each returned; copies of a
    page count once for the tree. Empty table: empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    stored = materialize(parsed(pages), "parsed")
    # Above this a node is kept as one of which nothing is known: a hint takes BY_HINT at most.
    low = materialize(importance(stored, least_pages=least_pages).where(F.col("importance") < threshold + BY_HINT), "low")
    few = low.limit(SENT + 1).count() <= SENT
    sent: dict[str, dict[int, float]] = {}
    table = stored.drop("own", "styles", "contents")
    if few:
        for r in low.collect():  # at most SENT
            sent.setdefault(r["host"], {})[r["node"]] = r["importance"]
    else:
        # Each page's own style nodes that matter little: at most as many as it has.
        table = table.withColumn("row", F.monotonically_increasing_id())
        own = table.select("row", "host", F.explode("nodes").alias("node")).join(low, ["host", "node"])
        own = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("low"))
        table = table.join(own, "row", "left").drop("row")
    shared = spark.sparkContext.broadcast(sent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for k, host in enumerate(batch.column("host").to_pylist()):
                nodes, node, *rest = (batch.column(c)[k].as_py() for c in ("nodes", "node", "facts", "texts", "owner", "block", "prose"))
                lows = dict(batch.column("low")[k].as_py() or ()) if "low" in batch.schema.names else shared.value.get(host, {})
                by_place = {at: lows[n] for at, n in enumerate(nodes, 1) if n in lows}
                texts.append(main_text(batch.column("parent")[k].as_py(), node, *rest, by_place, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return table.mapInArrow(read, "page_id long, url string, text string, n_chars long")
