"""Main text of web pages, with site templates removed.

A page is read once into blocks, each with its place in the tree of elements. Furniture that names itself
(navigation, headers, footers, asides, notices, adverts, forms, scripts, comments) is left out. What
a site repeats without naming it is found by counting: element subtrees are hashed by their tag, their
text and the shape below them; Spark counts on how many pages of a host each hash occurs; subtrees found
on many pages of their host are deleted. So that copies of an article on one host do not delete each
other, pages that say exactly the same count once, and inside an ``article`` or ``main`` element only
containers (lists, boxes, tables) are counted, never headings and paragraphs.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, per_batch

#: A subtree is a template when it is on at least this many distinct pages of a host, whatever the host's size.
LEAST_PAGES = 8

# Element names of HTML by their role.
SILENT = frozenset("script style noscript template svg math canvas iframe object embed audio video title select textarea button datalist".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
ASIDES = frozenset("comment reply related teaser promo".split())
#: Elements inside an article that may be a site's template; its headings, paragraphs and their like never are.
CONTAINERS = frozenset("div section aside ul ol table details figure".split())
#: Elements that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = BLOCKS - {"br"}
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl body html article section main div td th nav header footer aside form".split())
#: Words of a class, id or role that name furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscri\w*|share|sharing|social|sidebar|breadcrumbs?|nav\w*|menu\w*|"
    r"header|footer|masthead|related|recommend\w*|comments?|replies|respond|disqus|widget|pagination|pager|toolbar|skip|login|signup|complementary|contentinfo|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>?", re.DOTALL)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*["']?true)""", re.IGNORECASE)
_SPACE = re.compile(r"[\s ]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")


@dataclass
class Node:
    """An open element: furniture (1 by its marks, 2 by its kind) or not, inside the article or not, and its place.

    ``around`` is the innermost element, this one included, that may be a template.
    """

    tag: str
    around: int
    dropped: int
    main: bool
    parts: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text, each with the element around it, and for each such element the one around it and its hash (0: no text)."""

    blocks: list[tuple[str, int, bool]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    trees: list[int] = field(default_factory=list)


def _number(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(source: str) -> Page:
    """Blocks and subtrees of a page; open, broken and cut-off markup included.

    The depths of the open elements are kept by tag, so the work is in proportion to the source at any depth.
    """
    page, stack, text = Page(), [Node("", -1, 0, False)], []
    depths: dict[str, list[int]] = {}
    unclosed: set[str] = set()

    def deepest(tags: frozenset[str] | set[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def flush() -> None:
        words = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        top = stack[-1]
        if words and not top.dropped:
            page.blocks.append((words, top.around, top.main))
            top.parts.append(words)

    def close(keep: int) -> None:
        """Close open elements down to a depth; each becomes a part of the one around it."""
        while len(stack) > keep:
            node = stack.pop()
            depths[node.tag].pop()
            if node.parts and not node.dropped:
                if not node.main or node.tag in CONTAINERS:
                    page.trees[node.around] = _number("\x00".join([node.tag, *node.parts]))
                stack[-1].parts.append(f"{node.tag}:{_number(chr(1).join(node.parts))}")

    at, silent, deep = 0, "", 0
    for match in _TOKEN.finditer(source):
        if match.start() < at:
            continue
        if not silent:
            text.append(source[at : match.start()])
        at = match.end()
        tag = _TAG.match(match[0])
        if not tag:
            continue
        name, ends = tag[2].lower(), bool(tag[1])
        if silent:
            if name == silent:
                deep += -1 if ends else (not match[0].endswith("/>"))
                silent = silent if deep > 0 else ""
            continue
        if name in BLOCKS:
            flush()
        if ends:
            if depths.get(name):
                close(depths[name][-1])
            continue
        if name in SILENT:
            stop = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(source, at)
            if not stop:
                unclosed.add(name)
            if name in ("script", "style"):
                at = stop.end() if stop else len(source)
            elif name in ("title", "textarea"):
                at = stop.end() if stop else at
            elif stop and name not in VOID and not match[0].endswith("/>"):
                silent, deep = name, 1
            continue
        if name in ENDS_P:
            open_p = deepest({"p"})
            if open_p > deepest(SCOPES):
                close(open_p)
        if name in SAME_END:
            kin = deepest(SAME_END[name])
            if kin > deepest(SCOPES - SAME_END[name]):
                close(kin)
        if name in VOID or match[0].endswith("/>"):
            continue
        attributes = match[0][tag.end() :]
        marks = " ".join(next(filter(None, m), "") for m in _MARK.findall(attributes)) if "=" in attributes else ""
        up = stack[-1]
        dropped = up.dropped
        if (name in FURNITURE and not (name == "header" and up.main)) or _HIDDEN.search(attributes) or (name == "article" and depths.get("article")):
            dropped = 2
        elif name in MAIN:
            dropped = 2 if dropped == 2 or ASIDES.intersection(marks.lower().split()) else 0
        elif not dropped and name != "body" and marks and NAMES.search(marks) and not (up.main and "header" in marks.lower()):
            dropped = 1
        main, around = up.main or name in MAIN, up.around
        if not dropped and (not main or name in CONTAINERS):
            around = len(page.trees)
            page.parents.append(up.around)
            page.trees.append(0)
        depths.setdefault(name, []).append(len(stack))
        stack.append(Node(name, around, dropped, main))
    if not silent:
        text.append(source[at:])
    flush()
    close(1)
    return page


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def article(page: Page) -> Page:
    """The blocks that can be in a page's text (those of the article alone, if there is one), and the elements around them."""
    blocks = [b for b in page.blocks if b[2]] or page.blocks
    needed: set[int] = set()
    for _, around, _ in blocks:
        while around >= 0 and around not in needed:
            needed.add(around)
            around = page.parents[around]
    place = {old: new for new, old in enumerate(sorted(needed))} | {-1: -1}
    return Page([(words, place[around], main) for words, around, main in blocks], [place[page.parents[i]] for i in sorted(needed)], [page.trees[i] for i in sorted(needed)])


def main_text(page: Page, templates: frozenset[int] | set[int]) -> str:
    """Blocks of the article outside template subtrees, joined by line ends."""
    page, gone = article(page), []
    for up, tree in zip(page.parents, page.trees, strict=True):  # an element comes behind those around it
        gone.append((up >= 0 and gone[up]) or (tree != 0 and tree in templates))
    return "\n".join(words for words, around, _ in page.blocks if around < 0 or not gone[around])


_PARSED = pa.schema(
    [
        ("host", pa.string()), ("page", pa.int64()), ("found", pa.list_(pa.int64())),
        ("words", pa.list_(pa.string())), ("around", pa.list_(pa.int32())), ("parents", pa.list_(pa.int32())), ("trees", pa.list_(pa.int64())),
    ]
)


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
        page, host = parse(source or ""), host_of(url)
        same = _number("\n".join([host, *(words for words, *_ in page.blocks)]))
        own = article(page)
        rows.append((host, same, list(set(page.trees) - {0}), [w for w, *_ in own.blocks], [a for _, a, _ in own.blocks], own.parents, own.trees))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PARSED)]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", *_PARSED.names])


def _texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for words, around, parents, trees, bad in zip(*(batch.column(c).to_pylist() for c in ("words", "around", "parents", "trees", "bad")), strict=True):
        out.append(main_text(Page([(w, a, False) for w, a in zip(words, around, strict=True)], parents, trees), set(bad or ())))
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Each page with its host, a hash of host and words, the hashes of its subtrees, and its article (see ``Page``)."""
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    shape = "host string, page long, found array<long>, words array<string>, around array<int>, parents array<int>, trees array<long>"
    return plain.mapInArrow(per_batch(_parsed), f"page_id {kind}, url string, {shape}")


def template_trees(parsed: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page, bad): of each distinct page, the hashes of those subtrees around its text that are templates of its host.

    A list holds subtrees of one page only. Subtrees meet the templates as rows of (host, hash), of which a
    host may have any number; pages of a host with the same words count once.
    """
    found = parsed.select("host", "page", F.explode("found").alias("tree")).distinct()
    often = found.groupBy("host", "tree").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    around = parsed.select("host", "page", F.explode("trees").alias("tree")).distinct()
    return around.join(often, ["host", "tree"], "left_semi").groupBy("page").agg(F.collect_list("tree").alias("bad"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text; a null or odd url belongs to the host "". Markup that is
    broken or cut off is read as far as it goes, in time in proportion to its length. Repeated rows are
    each extracted; a subtree counts once for all pages of a host with the same words. Of several pages
    with an article, only the articles are returned; nested or repeated articles follow in page order.
    Other columns are not read. An empty table gives no rows. Pages are read once; what is written, met
    with the templates and shuffled are the blocks of their articles, never the markup.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    parsed = scratch.save(parsed_pages(pages))
    # written, so that Spark knows its size: pages are shuffled to meet it only where it is too large to send around
    joined = parsed.join(scratch.save(template_trees(parsed, least_pages)), "page", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    columns = ["page_id", "url", "words", "around", "parents", "trees", "bad"]
    return joined.select(columns).mapInArrow(per_batch(_texts), f"page_id {kind}, url string, text string, n_chars long")
