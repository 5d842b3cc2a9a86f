"""Main text of web pages, with site templates removed.

1. Every page is parsed once into elements; each element subtree outside the
   page's own main element gets a hash of its tag, class, id and text, its
   children included.
2. Spark counts, by host, on how many different pages a subtree occurs
   (copies of one page count once), and calls it a template from
   ``min_pages`` pages and ``min_share`` of the host's pages, or of the pages
   under one first path segment of it, on, and from ``many_pages`` pages on
   whatever the host's size. Counts are combined before the shuffle, so a host with a third of all pages is no
   load on one task.
3. A second parse deletes template subtrees and elements whose tag, role or
   class names them as menus, headers, footers, sidebars, notices, adverts,
   forms, scripts, styles or reader comments, and joins the text blocks left.

A page's ``article`` or ``main`` element is its main text: where there is
one, all else goes, and what is in it is never taken for a template (an
article copied to many pages stays). Where it holds no text, or where the page
has only ``article`` elements and more text beside them than in them (a teaser
beside the body), the whole body is taken. A class or id never drops a wrapper
of the main element, nor paragraphs, headings, figures and tables in it.
``br`` is white space, not a block.

The template table goes to the tasks by broadcast while its measured number
of rows is at most ``max_broadcast``; beyond that each page gets its own
templates by a join.

Defined results: a null html is an empty page with an empty text; a null url
is a host of its own; repeated or null page_ids keep their own rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textkit import slices
from tidewatch.session import materialize

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
MAIN = frozenset(["article", "main"])
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select textarea dialog "
    "menu audio video title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: words of a class or id that name page furniture, as its first or last word
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription share sharing social comment comments disqus respond replies related recommended recommendations widget "
    "pagination pager login signin signup masthead topbar toolbar skip alert".split()
)
#: first words of a class that tells a state or kind of layout
STATES = frozenset("has no not is with without hide hidden show enable disable".split())
#: elements of a text that no class drops inside the main element
KEPT = frozenset("p figure figcaption h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th dl dt dd".split())
#: words of a whole class that name a page's header
HEADER_WORDS = frozenset(["header", "site-header", "page-header", "banner", "top"])
#: elements whose text is never part of a page's text
_CODE = frozenset("head script style noscript template iframe object svg canvas audio video title".split())
_INLINE_SPACE = frozenset(["br", "td", "th", "option"])
#: a start tag closes open elements of these tags, up to their container
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_WORD = re.compile(r"[^\s_-]+")


class Node:
    __slots__ = ("tag", "parent", "items", "is_main", "in_main", "main", "drop", "named", "holds", "mark", "digest")

    def __init__(self, tag: str, parent: Node | None, mark: str, is_main: bool, in_main: bool, drop: bool, named: int):
        self.tag, self.parent, self.mark, self.drop, self.named = tag, parent, mark, drop, named
        self.is_main, self.in_main = is_main, in_main
        self.main = self.holds = False
        self.items: list = []
        self.digest = 0


@lru_cache(maxsize=50_000)
def _named(names: str) -> int:
    """2: a whole class or id names page furniture; 1: its first or last word; 0: none."""
    found = 0
    for token in names.lower().split():
        words = _WORD.findall(token)
        if token in DROPPED_WORDS:
            return 2
        if words and words[0] not in STATES and (words[0] in DROPPED_WORDS or words[-1] in DROPPED_WORDS):
            found = 1
    return found


def furniture(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
    """Dropped by its tag, role or state, whatever it holds."""
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    for k, v in attrs:
        v = v or ""
        if k == "role" and v.lower() in DROPPED_ROLES:
            return True
        elif k == "hidden" or (k == "aria-hidden" and v == "true"):
            return True
        elif k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True
    return False


def named_furniture(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> int:
    """Named as furniture by class or id (see ``_named``)."""
    found = 0
    for k, v in attrs:
        if k in ("class", "id") and v:
            if tag in MAIN:
                low = v.lower()
                if "comment" in low:  # a reader's comment, or an article open to comments
                    found = max(found, 2 if any(w in ("comment", "comments") for w in low.split()) else 1)
            elif tag not in ("body", "html") and not (in_main and tag in KEPT):
                found = max(found, _named(v))
            if not in_main and any(w in HEADER_WORDS for w in v.lower().split()):
                found = 2
    return found


class TreeBuilder(HTMLParser):
    """Elements and texts of a page, unclosed and wrongly closed tags mended."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", None, "", False, False, False, 0)
        self.at = self.root
        self.has_main = self.has_main_tag = False

    def _close(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:  # a block ends an open paragraph
            n = self.at
            while n.parent is not None and n.tag not in ("div", "li", "td", "article", "section", "body", "blockquote"):
                if n.tag == "p":
                    self.at = n.parent
                    break
                n = n.parent
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        mark, named, up = "", 0, self.at
        drop = up.drop or furniture(tag, attrs, up.in_main)
        is_main = not drop and (tag in MAIN or any(k == "role" and v == "main" for k, v in attrs))
        if attrs:
            mark = " ".join(f"{k}={v}" for k, v in attrs if k in ("class", "id", "role"))
            if not drop:
                named = named_furniture(tag, attrs, up.in_main)
        node = Node(tag, up, mark, is_main, is_main or up.in_main, drop, named)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _settle(page: TreeBuilder) -> None:
    """Decide bottom-up what is dropped by class or id, and what is main.

    Outside the main elements, one that holds a main element is dropped only
    if its whole class names it and the main elements beside the named ones
    have at least as much text (readers' comments, related articles)."""
    order, stack = [], [page.root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.items if isinstance(c, Node)]
    size: dict[Node, int] = {}  # text of the main elements in it
    for n in reversed(order):
        if n.drop:
            continue
        got = 0
        for c in n.items:
            if isinstance(c, str):
                got += len(c.strip()) if n.in_main else 0
            elif not c.drop:
                if not (c.in_main and n.in_main and c.named):
                    got += size[c]
                n.holds |= c.holds or c.is_main
        size[n] = got
    beside = 0
    stack = [page.root]
    while stack:
        n = stack.pop()
        for c in n.items:
            if isinstance(c, Node) and not c.drop and not c.named:
                if c.in_main:
                    beside += size[c]
                else:
                    stack.append(c)
    for n in order:
        up = n.parent
        if up is None:
            continue
        if up.drop:
            n.drop = True
        elif n.named and not n.drop:
            if up.main:
                n.drop = True
            elif n.holds or n.is_main:
                n.drop = n.named == 2 and beside >= size[n] and beside > 0
            else:
                n.drop = True
        if not n.drop:
            n.main = up.main or n.is_main
            if n.is_main and not up.main:
                page.has_main = True
                page.has_main_tag |= n.tag != "article"
    for n in reversed(order):  # of what is left
        n.holds = any(isinstance(c, Node) and (c.main or c.holds) for c in n.items)


def parse(html: str) -> TreeBuilder:
    b = TreeBuilder()
    b.feed(html)
    b.close()
    _settle(b)
    return b


def subtree_hashes(page: TreeBuilder) -> set[int]:
    """Hashes of the block elements' subtrees with text, outside main elements.
    Sets ``digest`` of every element walked."""
    out: set[int] = set()

    def walk(top: Node) -> None:
        # children before parents, without recursion (pages nest deeply)
        order, stack = [], [top]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += [c for c in n.items if isinstance(c, Node) and not c.main and c.tag not in _CODE]
        for n in reversed(order):
            h = hashlib.blake2b(digest_size=8)
            h.update(f"{n.tag}\x00{n.mark}".encode("utf-8", "surrogatepass"))
            some = False
            for c in n.items:
                if isinstance(c, str):
                    t = " ".join(c.split())
                    if t:
                        some = True
                        h.update(b"\x01" + t.encode("utf-8", "surrogatepass"))
                elif c.digest:
                    some = True
                    h.update(b"\x02" + c.digest.to_bytes(8, "little", signed=True))
            n.digest = int.from_bytes(h.digest(), "little", signed=True) if some else 0
            if n.digest and n.tag in BLOCKS and not n.holds:
                out.add(n.digest)

    walk(page.root)
    return out


def page_text(page: TreeBuilder, templates: set[int]) -> str:
    """The blocks left, in page order: of the main elements, or of the whole
    body where they hold no text or are articles with less text than the rest."""
    if not page.has_main:
        return _blocks(page, templates, False)
    text = _blocks(page, templates, True)
    if text and page.has_main_tag:
        return text
    whole = _blocks(page, templates, False)
    return whole if len(whole) > 2 * len(text) else text


def _blocks(page: TreeBuilder, templates: set[int], main_only: bool) -> str:
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)
        parts.clear()

    stack: list = [(page.root, iter(page.root.items))]
    while stack:
        node, items = stack[-1]
        for c in items:
            if isinstance(c, str):
                if node.main or not main_only:
                    parts.append(c)
            elif c.drop or (c.digest in templates and not c.main and not c.holds):
                if c.tag in BLOCKS:
                    flush()
            else:
                if c.tag in BLOCKS:
                    flush()
                elif c.tag in _INLINE_SPACE:
                    parts.append(" ")
                stack.append((c, iter(c.items)))
                break
        else:
            stack.pop()
            if node.tag in BLOCKS:
                flush()
            elif node.tag in _INLINE_SPACE:
                parts.append(" ")
    flush()
    return "\n".join(blocks)


# --- Spark -------------------------------------------------------------------


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def section_of(url: str) -> Column:
    """First segment of the path, of paths that have more than one."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int, min_share: float, many_pages: int) -> DataFrame:
    """(host, hash): subtrees that recur across a host's pages or a section's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html", 64):
                at, hashes = [], []
                for i, html in enumerate(part.column("html").to_pylist()):
                    own = {0} | (subtree_hashes(parse(html)) if html else set())  # 0 counts the page itself
                    hashes += sorted(own)
                    at += [i] * len(own)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(take) for c in ("host", "section", "page")] + [pa.array(hashes, pa.int64())],
                    ["host", "section", "page", "hash"],
                )

    # copies of one page count once: in a section, and in the host
    held = pages.select("host", "section", F.xxhash64("html").alias("page"), "html").mapInArrow(
        work, "host string, section string, page long, hash long"
    )
    held = held.distinct()
    counted = held.groupBy("host", "section", "hash").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.filter((F.col("n") >= min_pages) | (F.col("hash") == 0)).filter("section <> ''")
    whole = held.select("host", "page", "hash").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    whole = whole.filter((F.col("n") >= min_pages) | (F.col("hash") == 0)).withColumn("section", F.lit(None).cast("string"))
    counts = materialize(counted.unionByName(whole), "subtree-counts")
    total = counts.filter("hash = 0").select(F.col("host").alias("_h"), F.col("section").alias("_s"), F.col("n").alias("_pages"))
    common = (F.col("n") >= F.lit(min_share) * F.col("_pages")) | (F.col("n") >= many_pages)
    return (
        counts.filter("hash <> 0")
        .join(total, (F.col("host") == F.col("_h")) & F.col("section").eqNullSafe(F.col("_s")))
        .filter((F.col("n") >= min_pages) & common)
        .select("host", "hash")
        .distinct()
    )


def extract_text(
    pages: DataFrame, min_pages: int = 5, min_share: float = 0.05, max_broadcast: int = 500_000, many_pages: int = 50
) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    own = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    placed = own.withColumn("section", section_of("url"))
    found = materialize(site_templates(placed, min_pages, min_share, many_pages), "site-templates")
    schema = "page_id long, url string, text string, n_chars long"

    def batch(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                part.column("page_id").cast(pa.int64()),
                part.column("url").cast(pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    def text_of(html: str | None, templates: set[int]) -> str:
        if not html:
            return ""
        page = parse(html)
        if templates:
            subtree_hashes(page)
        return page_text(page, templates)

    if found.count() <= max_broadcast:
        by_host: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, "html", 64):
                    hosts = part.column("host").to_pylist()
                    yield batch(
                        part,
                        [
                            text_of(h, shared.value.get(host, set()))
                            for h, host in zip(part.column("html").to_pylist(), hosts, strict=True)
                        ],
                    )

        return own.mapInArrow(work, schema)

    return _joined(own, found, text_of, batch, schema)


def _joined(own: DataFrame, found: DataFrame, text_of, batch, schema: str) -> DataFrame:
    """Each page with the templates it holds, for template tables of any size."""
    keyed = own.withColumn("_key", F.xxhash64("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, html in enumerate(b.column("html").to_pylist()):
                one = subtree_hashes(parse(html)) if html else set()
                out += sorted(one)
                at += [i] * len(one)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("host").take(take), b.column("_key").take(take), pa.array(out, pa.int64())],
                ["host", "_key", "hash"],
            )

    held = keyed.select("host", "_key", "html").mapInArrow(hashes, "host string, _key long, hash long").distinct()
    lists = held.join(found, ["host", "hash"]).groupBy("host", "_key").agg(F.collect_set("hash").alias("_templates"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html", 64):
                lists_ = part.column("_templates").to_pylist()
                yield batch(
                    part,
                    [text_of(h, set(t or ())) for h, t in zip(part.column("html").to_pylist(), lists_, strict=True)],
                )

    return keyed.join(lists, ["host", "_key"], "left").drop("_key", "host").mapInArrow(work, schema)
