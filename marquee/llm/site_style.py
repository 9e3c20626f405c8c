"""Main text of web pages by a site style tree.

All pages of a host are merged: elements with the same path of presentation (tag, class,
id and role from the root down) are one node of the host's tree.  For every node Spark
counts on how many pages it occurs, which child sequences (styles) and which text contents it
has there, and on how many pages each.  From these follow, as entropies to the base of the
node's number of pages m:

    style   = - sum of p log_m p over its child sequences
    content = 1 - mean of log_m k over its contents, k being a content's number of pages
    importance = (1 - GAMMA) style + GAMMA content

A text that is the same on every page has importance 0, one that is new on each has 1; a few
pages say little, so ``PRIOR`` pages of importance 1 are added to every node.  A
branch whose nodes with text all lie below ``LEAST`` is removed from every page of the host,
and a page of which nothing would be left keeps what its elements' own names allow.  Numbers in class and
id names, which often count pages, don't tell nodes apart.

Some elements are noise whatever their statistics: a menu's words may differ on every page.
Elements that by tag, role or class name are menus, headers, footers, sidebars, notices,
adverts, forms, comments or the like have importance 0.  A form or a layout class around the ``main`` element, and
a form around an ``article``, are no such branch.  Where a page marks its article
(``article`` or ``main``) and it is no mere teaser beside more text, the text is taken from there.

Counts are summed per batch before they are shuffled, with hashes for paths and contents, so a host with a third
of all pages is no hot spot; pages themselves are never shuffled unless the removed nodes
are too many to be sent along, and then by host with skewed hosts split.

Defined results: a null html counts as empty and gives an empty text; pages without a host (null url) share no tree and
are judged by names alone; broken markup is read leniently; repeated pages are separate rows and
count each; other columns pass through untouched.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marquee.llm.staging import free_name, staged
from marquee.llm.url_filter import host_and_path

GAMMA = 0.9
LEAST = 0.3
#: Pages on which every node counts as important besides those it was seen on.
PRIOR = 2
#: Share of a page's text from which on its marked article is taken alone.
BULK = 0.2
#: Removed nodes (16 bytes each) up to which they are sent to every worker: 16 MB.
BROADCAST_ROWS = 1_000_000

# Elements of the markup language by what they are for.
#: Without an end these swallow the rest of a page; other raw elements without one are skipped alone.
SWALLOWS = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("head nav footer aside form button dialog menu fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
            "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SCOPES = frozenset("article aside body button details div fieldset figure footer form header html main nav section table td th li dd".split())
#: Words in class and id names that mark noise.
NOISE_NAMES = re.compile(
    r"(?:^|(?<!\bhas)(?<!\bno)(?<!\bwith)[-_]|\s)(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promo\w*|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|"
    r"side-?bar|footer|masthead|topbar|site-?header|page-?header|cookies?|consent|gdpr|notices?|notifications?|popups?|modal|overlay|"
    r"subscribe|subscription|newsletter|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommend\w*|"
    r"widgets?|login|signup|search|toolbar|pagination|pager|skip-?link|copyright)(?:$|[-_\s\d])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NUMBER = re.compile(r"\d+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """One open element while a page is read."""

    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag: str, path: int, noise: int, main: bool):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


#: How surely an element is noise: a class name that may be layout, a form, anything else.
NAMED, FORM, SURE = 1, 2, 3


def noise_of(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    """0 for elements that may hold the article."""
    if tag in NOISE_TAGS or tag == "header" and not in_main:
        return FORM if tag in ("form", "fieldset") else SURE
    if not attributes:
        return 0
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if (attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            or HIDDEN.search(attributes.get("style", "")) or tag == "article" and re.search(r"comment|reply", names, re.I)):
        return SURE
    return NAMED if tag not in ("html", "body", "article", "main") and NOISE_NAMES.search(names) else 0


def inherited(noise: int, tag: str) -> int:
    """What an element keeps of its parents' noise."""
    return 0 if tag == "main" and noise < SURE or tag == "article" and noise == FORM else noise


def read_page(page: str) -> tuple[list[tuple[int, str, bool, bool]], list[tuple[int, int]]]:
    """Blocks (path of their element, text, noise by name, inside the article) and closed elements (path, child sequence)."""
    blocks: list[tuple[int, str, bool, bool]] = []
    closed: list[tuple[int, int]] = []
    stack = [Element("", 0, 0, False)]
    held: list[str] = []
    holder = stack[0]

    def flush() -> None:
        nonlocal held
        if held:
            text = SPACE.sub(" ", "".join(held)).strip(" ")
            if text:
                blocks.append((holder.path, text, holder.noise > 0, holder.main))
            held = []

    def pop() -> None:
        top = stack.pop()
        if top.tag not in INLINE:
            flush()
        closed.append((top.path, xxhash.xxh64_intdigest(",".join(top.children))))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            part = m[0]
            if part[0] != "<" or part == "<":
                if not held:
                    holder = next((e for e in reversed(stack) if e.tag not in INLINE), stack[0])
                held.append(html.unescape(part) if "&" in part else part)
            elif part.startswith("<![CDATA["):
                held.append(part[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                while len(stack) > depth:
                    pop()
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stack[-1].children.append(tag)
            if not m[3].endswith("/"):
                at = stop.end() if stop else end if tag in SWALLOWS else at
            continue
        if tag in VOID:
            stack[-1].children.append(tag)
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in CLOSES_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in SIBLINGS:
            same, within = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same.split():
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in within:
                    break
        if tag not in INLINE:
            flush()
        attributes = {}
        if m[3].strip(" /"):
            attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])}
        top = stack[-1]
        name = " ".join([tag, *[f"{k}={NUMBER.sub('0', attributes[k])}" for k in ("class", "id", "role") if k in attributes]])
        top.children.append(name)
        main = top.main or tag in ("article", "main")
        noise = max(inherited(top.noise, tag), noise_of(tag, attributes, main))
        element = Element(tag, xxhash.xxh64_intdigest(name, seed=top.path), noise, main)
        if not (m[3].endswith("/") and tag not in INLINE and tag not in CLOSES_PARAGRAPH):
            stack.append(element)
    while len(stack) > 1:
        pop()
    flush()
    return blocks, closed


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def site_of(host: str | None) -> int:
    """A host's number; 0 for pages without a host."""
    return signed(xxhash.xxh64_intdigest(host, seed=7)) if host else 0


def main_text(page: str | None, removed: frozenset | set) -> str:
    """Text of a page without noise and without the host's unimportant nodes."""
    blocks = [(path, text, main) for path, text, noise, main in read_page(page or "")[0] if not noise]
    important = [b for b in blocks if signed(b[0]) not in removed] if removed else blocks
    important = important or blocks
    marked = [b for b in important if b[2]]
    if sum(len(b[1]) for b in marked) > BULK * sum(len(b[1]) for b in important):
        important = marked
    return " ".join([text for _, text, _ in important])


PAGES, STYLE, CONTENT = 0, 1, 2


def node_counts(pages: DataFrame) -> DataFrame:
    """site, node, kind, value, pages: on how many pages of a site a node occurs, has a style, has a content."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                site = site_of(host)
                if not site or not page:
                    continue
                blocks, closed = read_page(page)
                texts = {path for path, _, noise, _ in blocks if not noise}
                total.update({(site, signed(path), PAGES, 0) for path in texts})
                total.update({(site, signed(path), STYLE, signed(style)) for path, style in closed if path in texts})
                total.update({(site, signed(path), CONTENT, signed(xxhash.xxh64_intdigest(text))) for path, text, noise, _ in blocks if not noise})
                if len(total) > 200_000:
                    yield counted(total)
                    total = Counter()
            yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        columns = list(zip(*[(*k, n) for k, n in total.items()])) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["site", "node", "kind", "value", "pages"])

    found = pages.mapInArrow(count, "site long, node long, kind int, value long, pages long")
    return found.groupBy("site", "node", "kind", "value").agg(F.sum("pages").alias("pages"))


def node_importance(counts: DataFrame) -> DataFrame:
    """site, node, pages, importance of every node with text."""
    def of(kind: int, value) -> F.Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    n, log_n = F.col("pages").cast("double"), F.ln(F.col("pages").cast("double"))
    sums = counts.groupBy("site", "node").agg(
        of(PAGES, F.col("pages")).alias("pages"), of(STYLE, n).alias("styled"), of(STYLE, n * log_n).alias("style_log"),
        of(CONTENT, F.lit(1.0)).alias("contents"), of(CONTENT, log_n).alias("content_log"))
    log_m = F.ln(F.col("pages").cast("double"))
    # entropy of shares n / N is ln N - (sum of n ln n) / N
    style = F.coalesce((F.ln("styled") - F.col("style_log") / F.col("styled")) / log_m, F.lit(0.0))
    content = 1 - F.coalesce(F.col("content_log") / F.col("contents") / log_m, F.lit(0.0))
    seen = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise((1 - GAMMA) * F.least(style, F.lit(1.0)) + GAMMA * content)
    return sums.select("site", "node", "pages", ((F.col("pages") * seen + PRIOR) / (F.col("pages") + PRIOR)).alias("importance"))


def extract(pages: DataFrame, *, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page."""
    host, _ = host_and_path(F.col(url))
    counts = node_counts(pages.select(host.alias("host"), F.col(page).alias("html")))
    removed = staged(node_importance(counts).filter(F.col("importance") < LEAST).select("site", "node"), "unimportant-nodes")
    if removed.count() <= BROADCAST_ROWS:
        by_site: dict[int, set[int]] = {}
        for row in removed.toLocalIterator():
            by_site.setdefault(row["site"], set()).add(row["node"])
        sent = pages.sparkSession.sparkContext.broadcast(by_site)

        @F.pandas_udf("string")
        def text_of(hosts: pd.Series, htmls: pd.Series) -> pd.Series:
            sites = sent.value
            return pd.Series([main_text(p, sites.get(site_of(h), frozenset())) for h, p in zip(hosts, htmls)], dtype=object)

        return pages.withColumn(out, text_of(host, F.col(page)))

    @F.pandas_udf("long")
    def site_number(names: pd.Series) -> pd.Series:
        return names.map(site_of).astype("int64")

    @F.pandas_udf("string")
    def text_without(htmls: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, frozenset() if n is None else set(n)) for p, n in zip(htmls, nodes)], dtype=object)

    site, nodes = free_name(pages, "site"), free_name(pages, "nodes")
    lists = removed.groupBy(F.col("site").alias(site)).agg(F.collect_set("node").alias(nodes))
    joined = pages.withColumn(site, site_number(host)).join(lists, site, "left")
    return joined.withColumn(out, text_without(F.col(page), F.col(nodes))).drop(site, nodes)


def importance_of(pages: int, styles: list[int], contents: list[int]) -> float:
    """The same importance from plain counts, for reading and tests."""
    if pages < 2:
        return 1.0
    total = sum(styles)
    style = -sum(n / total * math.log(n / total) for n in styles) / math.log(pages) if total else 0.0
    content = 1 - sum(math.log(n) for n in contents) / len(contents) / math.log(pages) if contents else 1.0
    return (pages * ((1 - GAMMA) * min(style, 1.0) + GAMMA * content) + PRIOR) / (pages + PRIOR)
