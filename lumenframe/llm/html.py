"""Main text of web pages by differencing each with the page of the nearest URL.

Pages of a host are sorted by URL path, and each is paired with that neighbour in
this order whose path shares the longer beginning with its own. Both pages become
lines: one for each block, with the elements it lies in. A longest common
subsequence aligns the lines, and shared lines are deleted: they belong to the
host, not to the page.

Markup decides where it is explicit, since the pair cannot: furniture that changes
from page to page (rotating adverts, menus of links to other pages) is shared with
no neighbour, and articles may be copies of each other. Lines in elements for
menus, headers, footers, sidebars, notices, adverts, forms and comments go. An
article element is the page's main text. All other lines, and all lines of pages
without an article element, stand or fall by the differencing; a class name that
says article only keeps lines of its own which the neighbour repeats.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import host_of, path_of

#: Element names by what they do to text.
SILENT = frozenset("head iframe noscript script style svg template title textarea select option datalist object canvas audio video".split())
FURNITURE = frozenset("nav header footer aside form dialog menu button fieldset".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder munderover q ruby rt rp s samp semantics small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
KEEPS_P = INLINE | SILENT
#: Whole class and id names of furniture, and of articles.
FURNITURE_NAMES = frozenset(
    "ad ads ad-banner ad-container ad-slot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list comments-area commentlist consent cookie cookies cookie-banner cookie-consent cookie-notice disqus footer header hidden legal main-menu main-nav masthead menu modal nav nav-menu navbar navigation newsletter notice notices page-footer page-header pagination popup promo related related-articles related-posts replies respond share share-buttons sharing sidebar site-footer site-header site-nav skip skip-link social social-share sponsor sponsored subscribe subscription toolbar widget widget-area".split()
)
ARTICLE_NAMES = frozenset("article article-body articlebody content entry entry-content main main-content post post-body post-content story".split())
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S | re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]+")


class Place(NamedTuple):
    """What the elements around a line say of it."""

    furniture: bool = False  # by element, role or hidden
    named: bool = False  # by class or id, within the article if there is one
    article: bool = False  # in an article element
    body: bool = False  # in an element that only a class or id calls an article
    around: bool = False  # class or id of an element that holds the article call it furniture


Line = tuple[str, Place]


def _placed(name: str, attributes: str, above: Place) -> Place:
    """The place within an element of this name and attributes."""
    furniture = name in FURNITURE and not (name == "header" and (above.article or above.body))
    article, named, body = name in ARTICLE, False, False
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, names = key.lower(), set(unescape(value.strip("\"'")).lower().split())
            if key == "hidden" or (key == "aria-hidden" and "true" in names):
                furniture = True
            elif key == "role":
                furniture |= bool(names & FURNITURE_ROLES)
                article |= bool(names & {"main", "article"})
            elif name not in ("html", "body"):
                named |= bool(names & FURNITURE_NAMES)
                body |= bool(names & ARTICLE_NAMES)
    if furniture or named:
        return above._replace(furniture=above.furniture or furniture, named=above.named or named)
    if article and not above.article:
        return above._replace(article=True, named=False, around=above.around or above.named)
    return above._replace(body=above.body or body)


def page_lines(html: str) -> list[Line]:
    """The page's blocks in order: white space is one space, character references are decoded."""
    lines: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple[str, Place]] = []
    at = 0

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip(" ")
            buffer.clear()
            if text:
                lines.append((text, stack[-1][1] if stack else Place()))

    def close(k: int) -> None:
        if any(x[0] not in INLINE or x[1].furniture or x[1].named for x in stack[k:]):
            flush()
        del stack[k:]

    while m := _TAG.search(html, at):
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ARTICLE | FURNITURE | {"body", "table", "div", "section"} and name in INLINE | {"p", "li"}:
                    break  # an end without a start here
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in SILENT and not m[3].endswith("/"):
            if name == "head":
                # ends at its end tag, or where the body begins
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(html, at)
            else:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "iframe", "textarea", "noscript", "template", "svg"):
                at = len(html)
            if name not in ("option",):
                buffer.append(" ")
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in EMPTY:
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(name, {"p"}):
                    close(k)
                elif stack[k][0] not in INLINE and stack[k][0] not in ("td", "th"):
                    break
            flush()
        above = stack[-1][1] if stack else Place()
        place = _placed(name, m[3], above)
        if name in INLINE and (place.furniture, place.named) != (above.furniture, above.named):
            flush()
        stack.append((name, place))
    buffer.append(html[at:])
    flush()
    return lines


def shared(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a lie on a longest common subsequence with b."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    mark = [True] * low + [False] * (len(a) - low - high) + [True] * high
    also = set(b[low : len(b) - high])
    left = [k for k in range(low, len(a) - high) if a[k] in also]  # only lines that both have can align
    there = {a[k] for k in left}
    right = [x for x in b[low : len(b) - high] if x in there]
    if not left:
        return mark
    # rows of the table as bit sets (Hyyro): bit j is 0 where the length grows at right[j]
    places: dict[str, int] = {}
    for j, x in enumerate(right):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    rows = [full]
    for k in left:
        v, m = rows[-1], places[a[k]]
        u = v & m
        rows.append(((v + u) | (v - u)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j = len(left), len(right)
    while i and j:
        if a[left[i - 1]] == right[j - 1]:
            mark[left[i - 1]] = True
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return mark


def main_text(lines: list[Line], neighbour: list[Line] | None) -> str:
    """Blocks of the main text, joined by two line ends."""
    held = any(p.article and not (p.furniture or p.named or p.around) for _, p in lines)
    # what a class or id calls furniture is none if it holds the page's only article
    kept = [not (p.furniture or p.named or (p.around and held)) for _, p in lines]
    if any(k and p.article for k, (_, p) in zip(kept, lines, strict=True)):
        return "\n\n".join(text for k, (text, p) in zip(kept, lines, strict=True) if k and p.article)
    common = shared([x[0] for x in lines], [x[0] for x in neighbour]) if neighbour else [False] * len(lines)
    if all(same for k, same in zip(kept, common, strict=True) if k):
        common = [False] * len(lines)  # a copy: the pair differs in nothing, which says nothing about the host
    return "\n\n".join(text for k, same, (text, p) in zip(kept, common, lines, strict=True) if k and (p.body or not same))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (page_id, url, html, host, path, own) -> (page_id, url, text) of own pages. Holds three pages at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(batch.column(c)[k].as_py() for c in range(6))

    def near(a: tuple | None, b: tuple | None) -> int:
        """How much of their paths two pages of one host share; -1 if they are not of one host."""
        if a is None or b is None or a[3] != b[3]:
            return -1
        n = 0
        for x, y in zip(a[4], b[4], strict=False):
            if x != y:
                break
            n += 1
        return n

    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "text"])

    before = now = None
    before_lines: list[Line] | None = None
    now_lines: list[Line] | None = None
    source = rows()
    now = next(source, None)
    now_lines = page_lines(now[2] or "") if now else None
    while now is not None:
        after = next(source, None)
        after_lines = page_lines(after[2] or "") if after else None
        if now[5]:
            left, right = near(before, now), near(now, after)
            pair = before_lines if left > right or (left == right and left >= 0) else after_lines if right >= 0 else None
            text = main_text(now_lines, pair)
            out.append((now[0], now[1], text))
            size += len(text)
        if len(out) >= 1000 or size > 8 << 20:
            yield batch()
            out, size = [], 0
        before, before_lines, now, now_lines = now, now_lines, after, after_lines
    yield batch()


KEY = "struct<host:string,path:string,url:string,page_id:bigint>"
#: URLs that are looked at for each range, on average, to find the ranges' bounds; they are chosen by hash.
SAMPLED = 50


def _constant(value: list, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows (page_id, url, html, host, path) in at most n ranges, one a task, in order, with `own`.

    Each range also holds the pages next to its two ends, if their host is the same;
    there they are not `own`. So a page has the same neighbours however many ranges
    there are. To the driver come about SAMPLED keys and two keys for each range.
    """
    key = F.struct("host", "path", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"))
    rows = rows.withColumn("key", key)
    share = SAMPLED * n / max(rows.count(), 1)
    seen = rows.select("key").where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))).distinct()
    found = sorted(tuple(r["key"]) for r in seen.collect())
    bounds = sorted({found[k * len(found) // n] for k in range(1, n) if found} - set(found[:1]))
    below = F.filter(_constant([dict(zip(("host", "path", "url", "page_id"), b, strict=True)) for b in bounds], f"array<{KEY}>"), lambda b: b <= F.col("key"))
    rows = rows.withColumn("range", F.size(below))
    ends = {r["range"]: r for r in rows.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()}
    held = sorted(ends)
    guests: list[list[dict]] = [[] for _ in range(len(bounds) + 1)]
    for a, b in itertools.pairwise(held):
        if ends[a]["last"]["host"] == ends[b]["first"]["host"]:
            guests[a].append({"key": ends[a]["last"].asDict(), "to": b})
            guests[b].append({"key": ends[b]["first"].asDict(), "to": a})
    here = _constant(guests, f"array<array<struct<key:{KEY},to:int>>>")[F.col("range")]
    visits = F.transform(F.filter(here, lambda g: g["key"] == F.col("key")), lambda g: g["to"])
    rows = rows.withColumn("to", F.explode(F.concat(F.array("range"), visits)))
    rows = rows.withColumn("own", F.col("to") == F.col("range")).repartitionById(len(bounds) + 1, F.col("to"))
    return rows.sortWithinPartitions("key", "html").select("page_id", "url", "html", "host", "path", "own")


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text ('' if none), n_chars.

    A null html is empty; pages with a null URL, or one without a host, are
    neighbours of each other; a page without a neighbour loses only furniture. A
    page that is a copy of its neighbour keeps what both have. A
    page with an article element gives that article; otherwise what is neither
    furniture nor shared. Texts of any length are read whole. An empty table gives
    no rows. Of two equally near neighbours the one before counts, by
    path, then URL, then page_id, then html. Pages are dealt out by ranges of (host,
    path, URL, page_id), so a host of any size is spread over tasks, and neighbours
    are the same for any number of ranges. Repeated rows give repeated rows. Other
    columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(rows, n).mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
