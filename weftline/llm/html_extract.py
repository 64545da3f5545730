"""Main text of web pages: markup zones, and nearest-URL page differencing for what they leave open.

Each page is cut into text lines (blocks) that carry a zone: *chrome* (menus,
page headers, footers, adverts, forms, comments ...), *article*, *main*, or
*open* (none of these). Pages of a host are put in the order of their URL
paths, each is paired with the nearest page of other lines, on the side that
shares more of its path, the open lines of both are aligned by longest common
subsequence, and shared lines go. Copies of a page tell nothing about its
template: they are passed over, and a partner that has nine tenths of a page's
lines counts as one. Lines inside an article are never taken away by
differencing: neighbouring pages may carry copies of one article, and deleting
what they share would delete both.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CHROME, OPEN, MAIN, ARTICLE = range(4)
#: Chrome that may be a wrapper of the page.
_WRAPPED = -1

# Element names by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title head".split())
_CHROME = frozenset("nav header footer aside form dialog menu button fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_IMPLIED = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
#: Words of a class or id that mark an element as no part of the article.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay sidebar menu navbar "
    "nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments reply replies disqus respond newsletter subscribe signup login share sharing social "
    "related recommended widget pagination pager copyright disclaimer".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
#: Elements of running text: one class word among others does not mark them, as in "related-work".
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure ol dl".split())
#: Elements that hold whole pages on some sites; as with classes, an article inside of them is one.
_WRAPPERS = frozenset("form dialog".split())

_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _noise(attrs: str) -> int:
    """Whether a class or id says that an element is no part of the article: 2 by all its words, 1 by some, 0 by none."""
    found = [w.lower() in _NOISE for m in _MARKS.findall(attrs) for w in _WORDS.findall(m)] if attrs else []
    return 0 if not any(found) else 2 if all(found) else 1


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page, in page order; blank blocks are left out.

    What one class word among others ("has-sidebar") or a form takes for chrome
    may be a wrapper of the whole page: ``main`` opens it again, and so does
    ``article`` where the page has had neither before, unless its own class
    is noise. What all words or the element's name say stays closed.
    """
    page = page or ""
    opened = False
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    buf: list[str] = []
    zone = OPEN

    def flush() -> None:
        if buf:
            line = " ".join(html.unescape("".join(buf)).split())
            if line:
                out.append((max(zone, CHROME), line))
            buf.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            buf.append(text)
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, attrs = (m["end"], m["attrs"]) if m["name"] else (m["end2"], m["attrs2"])
        if name in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if zone != (stack[k - 1][1] if k else OPEN):
                        flush()
                    del stack[k:]
                    zone = stack[-1][1] if stack else OPEN
                    break
            continue
        if name in _RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if close:
                at = close.end()
            elif name != "head":  # a raw element that is never closed takes the rest, as in a browser
                at = end
            continue
        if name in _VOID:
            continue
        if name in _IMPLIED:  # a new item or paragraph ends the open one of its kind
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    zone = stack[-1][1] if stack else OPEN
                    break
                if stack[k][0] not in _INLINE and stack[k][0] not in _IMPLIED:
                    break
        inner = zone
        if zone == CHROME:
            pass
        elif zone == _WRAPPED:
            if name == "main" or name == "article" and not opened and not _noise(attrs):
                inner = MAIN if name == "main" else ARTICLE
            elif name in _CHROME - _WRAPPERS:
                inner = CHROME
        elif name == "header":
            inner = zone if zone == ARTICLE else CHROME
        elif name in _CHROME:
            inner = _WRAPPED if zone == OPEN and name in _WRAPPERS else CHROME
        elif name not in ("html", "body", "main") and (noise := _noise(attrs)) and not (noise == 1 and name in _TEXTUAL):
            inner = _WRAPPED if zone == OPEN and noise == 1 else CHROME
        elif name == "article":
            inner = ARTICLE
        elif name == "main":
            inner = max(zone, MAIN)
        opened = opened or inner > OPEN
        if inner != zone and name in _INLINE:
            flush()
        stack.append((name, inner))
        zone = inner
    flush()
    return out


#: Bits of alignment rows that are kept at once; larger alignments are divided.
_ROW_BITS = 500_000_000


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``, in memory of the order of ``b``."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    n = len(b)
    often: dict[int, int] = {}  # masks of at most 64 frequent lines are kept, others are made again
    full = (1 << n) - 1
    v = full
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        mask = often.get(x)
        if mask is None:
            bits = bytearray(n // 8 + 1)
            for j in at:
                bits[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(bits, "little")
            if 64 * len(at) >= n:
                often[x] = mask
        u = v & mask
        v = (v + u | v - u) & full
    ones = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - ones.astype(np.int64))])


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Positions of ``mine`` in one longest common subsequence of the two, by bit-parallel alignment.

    Where the rows of the alignment would take more than ``_ROW_BITS`` bits,
    ``mine`` is halved at the best cut of ``other`` (Hirschberg), common ends
    first, so the length is exact at every size.
    """
    common = set(mine) & set(other)
    a = [i for i, x in enumerate(mine) if x in common]
    b = [x for x in other if x in common]
    n = len(b)
    if not n:
        return []
    if len(a) > 1 and len(a) * n > _ROW_BITS:
        least = min(len(a), n)
        head = next((k for k in range(least) if mine[a[k]] != b[k]), least)
        tail = next((k for k in range(least - head) if mine[a[-1 - k]] != b[-1 - k]), least - head)
        mid = a[head : len(a) - tail]
        x, y = [mine[i] for i in mid], b[head : n - tail]
        if head or tail:
            inner = shared_lines(x, y)
        else:
            h = len(x) // 2
            j = int(np.argmax(_growth(x[:h], y) + _growth(x[h:][::-1], y[::-1])[::-1]))
            inner = shared_lines(x[:h], y[:j]) + [h + i for i in shared_lines(x[h:], y[j:])]
        return a[:head] + [mid[i] for i in inner] + a[len(a) - tail :]
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << n) - 1
    v, rows = full, []
    for i in a:  # a zero bit at j: the subsequence grows by one at column j
        u = v & where[mine[i]]
        v = (v + u | v - u) & full
        rows.append(v)
    out, i, j = [], len(a) - 1, n
    while i >= 0 and j > 0:
        upto = (1 << j) - 1
        here = j - (rows[i] & upto).bit_count()
        above = j - (rows[i - 1] & upto).bit_count() if i else 0
        if here == above:
            i -= 1
        elif here == j - 1 - (rows[i] & upto >> 1).bit_count():
            j -= 1
        else:
            out.append(a[i])
            i, j = i - 1, j - 1
    return out[::-1]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page that may be its text, those of article and main where it has any, else the open ones; ``firm`` are those of an article."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            lines, firm, hashes = [], [], []
            for page in part.column(2).to_pylist():
                found = page_lines(page)
                found = [x for x in found if x[0] >= MAIN] or [x for x in found if x[0] == OPEN]
                lines.append([s for _, s in found])
                firm.append([z == ARTICLE for z, _ in found])
                hashes.append([xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63 for _, s in found])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(firm, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64()))],
                names=["page_id", "url", "lines", "firm", "hashes"],
            )


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, positions of the lines that its neighbour shares and no article holds) of the pages that have such lines."""
    for batch in batches:
        rows, away = [], []
        for row, firm, mine, other in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            gone = shared_lines(mine, other or [])
            if len(gone) * 10 >= len(mine) * 9:  # a copy
                continue
            if gone := [i for i in gone if not firm[i]]:
                rows.append(row)
                away.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(away, pa.list_(pa.int32()))], names=["row", "gone"])


def _nearest(pages: DataFrame) -> DataFrame:
    """Each page's neighbour hashes: of the nearest pages of other lines on both sides in (host, path) order, the one of the same host that shares more of its path.

    The order is cut into ranges, so that a host with a third of all pages is
    many tasks; one first and one last row per range meet in a small window.
    """
    at = cut(pages.repartitionByRange("host", "path", "page_id").withColumn("part", F.spark_partition_id()))
    row = F.struct("host", "path", "hashes")
    w = Window.partitionBy("part").orderBy("host", "path", "page_id")
    own, none = F.xxhash64("hashes"), F.lit(None)
    starts, ends = ~F.lag(own).over(w).eqNullSafe(own), ~F.lead(own).over(w).eqNullSafe(own)
    near = at.select("*", F.when(starts, F.lag(row).over(w)).otherwise(none).alias("before"), F.when(ends, F.lead(row).over(w)).otherwise(none).alias("after"))
    upto, onward = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    near = near.withColumns({"before": F.last("before", ignorenulls=True).over(upto), "after": F.first("after", ignorenulls=True).over(onward)})
    ends = at.groupBy("part").agg(F.min_by(row, F.struct("host", "path", "page_id")).alias("first"), F.max_by(row, F.struct("host", "path", "page_id")).alias("last"))
    along = Window.orderBy("part")  # one row per range
    ends = ends.select("part", F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("first_after"))
    near = near.join(ends, "part").withColumns({"before": F.coalesce("before", "last_before"), "after": F.coalesce("after", "first_after")})

    def common(other):
        """Characters of path shared with a page of the same host; -1 for none."""
        same = F.length(F.regexp_extract(F.concat_ws("\x00", F.col("path"), F.col(f"{other}.path")), "^([^\x00]*)[^\x00]*\x00\\1", 1))
        return F.when(F.col(f"{other}.host").eqNullSafe(F.col("host")), same).otherwise(-1)

    near = near.withColumns({"b": F.coalesce(common("before"), F.lit(-1)), "a": F.coalesce(common("after"), F.lit(-1))})
    return near.withColumn("other", F.when((F.col("b") < 0) & (F.col("a") < 0), None).when(F.col("b") >= F.col("a"), F.col("before.hashes")).otherwise(F.col("after.hashes")))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (blocks joined by one newline; empty if none) and n_chars in code points.

    Every page is paired with the nearest different page by URL and aligned
    with it. Pages with ``article`` or ``main`` give the lines of these, else
    the open lines; those that the other page shares go, but for the lines of an article. Null or empty
    html gives an empty text; a null or odd URL is a host of its own name
    (empty). Repeated pages keep their lines; an empty table gives no rows; no
    other column is looked at. Broken markup is read as a browser would: what a tag leaves
    unclosed ends with its parent. Very long pages are read whole.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = dict(src.dtypes)["page_id"]
    parsed = src.mapInArrow(_parse, f"page_id {kind}, url string, lines array<string>, firm array<boolean>, hashes array<long>")
    parsed = cut(parsed.withColumn("row", F.monotonically_increasing_id()))
    url = F.coalesce(F.col("url"), F.lit(""))
    keyed = parsed.select("row", "page_id", "firm", "hashes", F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"))
    # lines stay where they are: only hashes are paired, and only positions of lines come back
    gone = cut(_nearest(keyed).select("row", "firm", "hashes", "other").mapInArrow(_difference, "row long, gone array<int>"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    rest = parsed.join(gone, "row", "left").select("page_id", "url", F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"))
    return rest.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
