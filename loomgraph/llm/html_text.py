"""HTML extraction: page structure and nearest-URL page differencing.

Every page is cut into text blocks in page order.  Within a host, pages are put
in the order of their URL paths, and each page is paired with its nearer
neighbour: the one whose path shares more leading segments.  The lines (blocks)
of a pair are aligned by a longest common subsequence; lines that both pages
have in the alignment are the site's furniture and are deleted.

Differencing alone cannot give whole articles: furniture that is unlike on each
page is not shared, and what copies of an article share is not furniture.  So
structure decides where a page shows it: blocks in navigation, headers, footers,
asides, forms, scripts, adverts, notices and comments go; the blocks of an
``article`` (else ``main``) element stay; shared lines are deleted from pages
that have no such element.

Pairs come from one sort of all pages by (host, path, id): the order is cut into
ranges, and the first page of each range is passed to the range before it, so a
host with a third of all pages is spread over many tasks and the pairs do not
depend on where the cuts are.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep, table

# Element names of HTML and words of class, id and role attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math textarea title select canvas audio video".split())
_FURNITURE = frozenset("nav header footer aside form button dialog menu head".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"html", "head", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option", "optgroup"}
_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social comment comments commentlist disqus reply replies sidebar navbar nav navigation menu breadcrumb breadcrumbs footer masthead related recommended pagination pager login signup search".split())
_HELPERS = frozenset("area bar block body bottom box button buttons bar container content form global group header holder icon icons inner item items left link links list main media mobile nav panel page post primary right row secondary section side site slot small sticky thread top unit widget wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
#: Pages of a range of the sort by URL; there are at least 64 ranges.
PAGES = 20_000


def _marked(value: str) -> bool:
    """Does a class or id name furniture?  All parts of one of its names do, or only say what kind of box it is.

    So ``share-buttons`` and ``ad_slot_2`` do, ``share-price`` and ``social-science`` do not.
    """
    for one in re.split(r"\s+", value.lower()):
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", one) if p and not p.isdigit()]
        if any(p in _WORDS for p in parts) and all(p in _WORDS or p in _HELPERS for p in parts):
            return True
    return False


def _furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in _FURNITURE and not (inside and name == "header"):
        return True
    if "=" in attributes and name not in ("html", "body", "main"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value = a or b or c
            key = key.lower()
            if (key in ("class", "id") and _marked(value)) or (key == "role" and value.lower() in _ROLES) or (key == "aria-hidden" and value.lower() == "true"):
                return True
    return " hidden" in f"{attributes.lower()} " and bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "=x", attributes.lower())))


def blocks(page: str) -> list[tuple[str, int]]:
    """The page's text blocks in order, each with what holds it: 0 plain, 1 main, 2 article, -1 furniture."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # element, furniture, main/article depth mark
    furniture, held, at = 0, [0], 0
    raw, opened = None, Counter()

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, -1 if furniture else held[-1]))

    def pop() -> None:
        nonlocal furniture
        name, marked, more = stack.pop()
        opened[name] -= 1
        if name in _BLOCK or marked:
            flush()
        furniture -= marked
        if more:
            held.pop()

    for token in _TOKEN.finditer(page):
        if raw is None:
            if token.start() > at:
                parts.append(page[at : token.start()])
        elif not (token[1] and token[1].lower() == raw):
            continue  # inside raw text only its own end counts
        at = token.end()
        if token[1]:
            name = token[1].lower()
            if raw:
                raw = None
                continue
            if name == "br":
                parts.append(" ")
            elif opened[name]:
                while True:
                    last = stack[-1][0]
                    pop()
                    if last == name:
                        break
            elif name in _BLOCK:
                flush()
        elif token[2]:
            name, attributes = token[2].lower(), token[3] or ""
            if name in _RAW:
                if not attributes.endswith("/"):
                    raw = name
                continue
            if name in _VOID:
                if name in ("br", "hr", "img", "wbr"):
                    parts.append("" if name == "wbr" else " ")
                continue
            if name in _BLOCK:
                flush()
                if name in _CLOSES_P:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] in _BLOCK:
                            break
                if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                    same = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}[name]
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in same:
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] in _BLOCK - {"p"}:
                            break
            marked = _furniture(name, attributes, held[-1] > 0)
            if marked:
                flush()
                furniture += 1
            more = 2 if name == "article" else 1 if name == "main" or "itemprop=\"articlebody\"" in attributes.lower() or "role=\"main\"" in attributes.lower() else 0
            if more:
                flush()
                held.append(max(held[-1], more))
            if not attributes.rstrip().endswith("/"):
                stack.append((name, marked, more))
                opened[name] += 1
            else:
                furniture -= marked
                if more:
                    held.pop()
    if raw is None and at < len(page):
        parts.append(page[at:])
    while stack:
        pop()
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes of ``a`` in a longest common subsequence of two line sequences (Hunt and Szymanski)."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(lead, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chain: list[tuple] = []
    for i in range(lead, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect.bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    middle, link = [], chain[-1] if chain else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(lead), *reversed(middle), *range(len(a) - tail, len(a))]


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; a URL that cannot be read is a host of its own."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        return url or "", "/"


def parsed(df: DataFrame, *, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, host, path, sure (structure shows the article), text if sure, else lines; hashes of all open lines."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = blocks(page or "")
                best = max((h for _, h in found), default=0)
                body = [t for t, h in found if h == best] if best > 0 else None
                lines = [t if h >= 0 else None for t, h in found] if best <= 0 else []
                marks = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found]
                rows.append((*address(url), best > 0, "\n".join(body) if body is not None else None, lines, marks))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "url", "host", "path", "sure", "text", "lines", "marks"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, url string, host string, path string, sure boolean, text string, lines array<string>, marks array<long>")


def nearest(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """row, partner of each page (columns row, host, path): its neighbour in path order with the longer common path.

    One of equally near neighbours is the earlier one; a host's only page has a null partner.
    """
    order = ["host", "path", "row"]
    if ranges is None:
        ranges = 64 + pages.count() // PAGES
    cut = keep(pages.select(*order).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "html-order")
    firsts = cut.groupBy("part").agg(F.min(F.struct(*order)).alias("head"), F.max(F.struct(*order)).alias("tail"))
    by = Window.orderBy("part")  # one row a range
    edges = firsts.select("part", F.lag("tail").over(by).alias("ahead"), F.lead("head").over(by).alias("behind"))
    inside = Window.partitionBy("part").orderBy(*order)
    me = F.struct(*order)
    near = cut.select(*order, "part", F.lag(me).over(inside).alias("left"), F.lead(me).over(inside).alias("right")).join(F.broadcast(edges), "part")
    near = near.withColumn("left", F.coalesce("left", "ahead")).withColumn("right", F.coalesce("right", "behind"))

    def closeness(side: str):
        mine, other = F.split("path", "/"), F.split(F.col(f"{side}.path"), "/")
        same = F.transform(F.arrays_zip(mine.alias("a"), other.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
        first = F.array_position(same, False)
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(first > 0, first - 1).otherwise(F.size(same))).otherwise(-1)

    a, b = closeness("left"), closeness("right")
    return near.select("row", F.when((a < 0) & (b < 0), F.lit(None)).when(a >= b, F.col("left.row")).otherwise(F.col("right.row")).alias("partner"))


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Two tables: row, id, url, text, n_chars of each page, and row, n_shared (lines in common with its partner).

    Null and empty pages have an empty text; a null or odd URL is a host of its
    own; pages that repeat are paired with each other like others, and a page
    whose structure shows its article keeps it whole.  Other columns do not
    matter; an empty table gives an empty table.
    """
    pages = keep(parsed(df, id_col=id_col, url_col=url_col, html_col=html_col).withColumn("row", F.monotonically_increasing_id()), "html-pages")
    pairs = nearest(pages)
    marks = pages.select("row", "marks")
    other = marks.select(F.col("row").alias("partner"), F.col("marks").alias("theirs"))
    lined = marks.join(pairs, "row").join(other, "partner", "left").select("row", "marks", F.coalesce("theirs", F.array().cast("array<long>")).alias("theirs"))

    def differ(batches):
        for batch in batches:
            shared = [common_lines(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.list_(pa.int32())), pa.array([len(x) for x in shared], pa.int64())], names=["row", "shared", "n_shared"])

    found = keep(lined.mapInArrow(differ, "row long, shared array<int>, n_shared long"), "html-shared")
    counts = found.select("row", "n_shared")
    sure = pages.where("sure").select("row", "id", "url", "text")
    rest = pages.where("NOT sure").select("row", "id", "url", "lines").join(found.select("row", "shared"), "row")
    left = F.filter("lines", lambda t, i: t.isNotNull() & ~F.array_contains("shared", i.cast("int")))
    rest = rest.select("row", "id", "url", F.array_join(left, "\n").alias("text"))
    # n_shared is one number a page; the texts themselves stay where they are for the sure pages
    return sure.unionByName(rest).select("row", "id", "url", "text", F.length("text").cast("long").alias("n_chars")), counts


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = extract(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", "n_chars")
