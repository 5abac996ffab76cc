"""Main text of web pages by nearest-URL page differencing.

1. Every page is cut into its shown text lines (blocks), with where each stands: in an article, in the main part or
   elsewhere, and whether markup names its region as no text (menu, footer, advert, comments, ...).
2. Pages are ordered by host and URL path; each is paired with the neighbour of the same host whose path shares the
   longest beginning. The lines of the two are aligned by a longest common subsequence.
3. Shared lines are the site's template and go, with two exceptions: lines of the page's own article stay, as
   neighbours also share real paragraphs (quoted passages), and a neighbour that is a copy decides nothing.
4. Differencing alone can't give right results, as menus, adverts and footers also differ from page to page. So lines in
   regions that markup names go whether they are shared or not. Where an article holds at least as much as
   the rest of what is left it is the text; a mere teaser is not.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, slices, table

# Fixed values of HTML: elements without an end tag, without shown text, that break a line, that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video select datalist button textarea form dialog".split())
CHROME = frozenset("nav footer aside menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold a region and not a piece of text; inside an article only these can be named away.
REGIONS = frozenset("div section ul ol dl table details fieldset".split())
#: Words of class, id or role that name a region which is not the page's text.
NAMED = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent notice notices alert popup modal overlay"
    " nav navigation navbar menu breadcrumb breadcrumbs sidebar aside header masthead footer comment comments disqus reply replies"
    " share sharing social related recommended newsletter subscribe signup login search pagination toolbar widget skip complementary contentinfo".split()
)
#: A line: its text, 2 in an article or 1 in the main part or 0, and 0 or NO_TEXT (its region is none) or ASIDE (a named region of an article).
Line = tuple[str, int, int]
NO_TEXT, ASIDE = 1, 2
#: URLs that the ranges of the order are taken from, at most.
SAMPLE = 20_000


class _Page(HTMLParser):
    """The lines of a page; what is hidden is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = []  # name, kind inside, mark inside, hidden inside
        self.count: dict[str, int] = {}
        self.blocks: list[int] = []  # places of open elements that break a line
        self.kind, self.mark, self.hidden = 0, 0, False
        self.parts: list[str] = []
        self.lines: list[Line] = []

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.kind, self.mark))
            self.parts = []

    def _pop(self, name: str) -> None:
        """Closes the innermost element of this name and all inside it; each element is closed once, so all of it is linear."""
        if not self.count.get(name):
            return
        at = len(self.open) - 1
        while self.open[at][0] != name:
            at -= 1
        if self.blocks and self.blocks[-1] >= at:
            self.end_line()
        for closed, *_ in self.open[at:]:
            self.count[closed] -= 1
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        self.kind, self.mark, self.hidden = self.open[-1][1:] if self.open else (0, 0, False)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            # A new block ends an open paragraph, and a list item or cell one of its kind, unless a region was opened inside it.
            inner = self.open[self.blocks[-1]][0] if self.blocks else ""
            if inner == "p" or (inner == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                self._pop(inner)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        kind = max(self.kind, 2 if tag == "article" else 1 if tag == "main" else 0)
        mark = NO_TEXT if tag in CHROME or (tag == "header" and not self.kind) else self.mark
        if not mark and tag not in ("html", "body", "article", "main") and (kind < 2 or tag in REGIONS):
            words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().replace("_", " ").replace("-", " ").split()
            if not NAMED.isdisjoint(words):
                mark = ASIDE if kind == 2 else NO_TEXT
        self.open.append((tag, kind, mark, self.hidden or tag in HIDDEN))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in BLOCKS:
            self.blocks.append(len(self.open) - 1)
        self.kind, self.mark, self.hidden = self.open[-1][1:]

    def handle_startendtag(self, tag, attrs):
        # A slash at the end means nothing in HTML, but for elements without an end tag.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("p", "br") and not self.count.get(tag):
            self.end_line()
        self._pop(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def lines_of(html: str) -> list[Line]:
    """The shown lines of a page in order; cut-off markup at its end is left out.

    A named region inside an article stays where it holds more than half of what the page's articles hold.
    """
    page = _Page()
    page.feed(html)
    page.close()
    page.end_line()
    inside = sum(len(t) for t, kind, mark in page.lines if kind == 2 and mark != NO_TEXT)
    aside = sum(len(t) for t, _, mark in page.lines if mark == ASIDE)
    keep = 2 * aside > inside
    return [(t, kind, (0 if keep else NO_TEXT) if mark == ASIDE else mark) for t, kind, mark in page.lines]


def _by_matches(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, from all matching pairs.

    A common subsequence is an increasing run of matching positions; going through ``a`` with the matches of
    each line backwards, the longest is found by bisection over the ends of the best runs so far.
    """
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    heads: list[int] = []
    links: list[tuple[int, int]] = []  # position in a, link before
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            links.append((i, heads[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                heads.append(len(links) - 1)
            else:
                ends[k], heads[k] = j, len(links) - 1
    out, at = [], heads[-1] if heads else -1
    while at >= 0:
        i, at = links[at]
        out.append(i)
    return out[::-1]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``, all in the bits of one number."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = full
    for line in a:
        hit = rows & where.get(line, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    bits = np.unpackbits(np.frombuffer(rows.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Lines that repeat often in both would make too many matching pairs; then ``a`` is halved, and ``b`` where the halves share most.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, first, last = todo.pop()
        while low < high and first < last and a[low] == b[first]:
            out.add(low)
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            out.add(high - 1)
            high, last = high - 1, last - 1
        x, y = a[low:high], b[first:last]
        count: dict[str, int] = {}
        for line in y:
            count[line] = count.get(line, 0) + 1
        if high - low < 2 or sum(count.get(line, 0) for line in x) <= 64 * (len(x) + len(y)):
            out.update(low + i for i in _by_matches(x, y))
            continue
        half = len(x) // 2
        both = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(both))
        todo += [(low, low + half, first, first + cut), (low + half, high, first + cut, last)]
    return out


def main_text(page: list[Line], neighbour: list[Line] | None) -> str:
    """The page's own lines: what neither its neighbour shares nor markup names, and of that its article, if that is most of it."""
    shared: set[int] = set()
    if neighbour and neighbour != page:
        shared = common_lines([t for t, *_ in page], [t for t, *_ in neighbour])
    left = [(text, kind) for i, (text, kind, mark) in enumerate(page) if not mark and (kind == 2 or i not in shared)]
    article, rest = (sum(len(t) for t, kind in left if (kind == 2) == inside) for inside in (True, False))
    least = 2 if article and article >= rest else 1 if any(kind == 1 for _, kind in left) else 0
    return "\n".join(text for text, kind in left if kind >= least)


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


SCHEMA = "page_id long, url string, text string, n_chars long"
KEY = ["host", "path", "page_id", "check"]


def _ordered(found: DataFrame) -> DataFrame:
    """The rows with ``range`` (ranges follow one another in the order of KEY, a few for each partition) and ``own``.

    The first and the last row of each range come a second time, not ``own``, in the range beside theirs. The driver sees
    a bounded sample of keys, and the ends of each range.
    """
    spark = found.sparkSession
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = found.select(*KEY)
    sized = found.select(*KEY, F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    sample = bounded_sample(sized, KEY, [*KEY, "size"], SAMPLE).astype(object).where(lambda x: x.notna(), None)
    rows = sorted(((x.host, x.path, x.page_id is not None, x.page_id or 0, x.check), x.size + 1) for x in sample.itertuples(index=False))
    # Ranges of about as many bytes, not as many pages.
    total, ends = sum(size for _, size in rows), list(accumulate(size for _, size in rows))
    splits = sorted({rows[bisect_left(ends, total * k / many)][0] for k in range(1, many)}) if rows else []

    @F.pandas_udf("int")
    def range_of(host: pd.Series, path: pd.Series, page_id: pd.Series, has_id: pd.Series, check: pd.Series) -> pd.Series:
        rows = zip(host, path, has_id.astype(bool), page_id, check, strict=True)
        return pd.Series([bisect_right(splits, row) for row in rows], dtype="int32")

    numbered = range_of("host", "path", F.coalesce("page_id", F.lit(0)), F.col("page_id").isNotNull(), "check")
    ends = keys.withColumn("range", numbered).groupBy("range").agg(F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high"))
    ends = sorted(ends.collect(), key=lambda r: r["range"])
    halo = [(*a["high"], b["range"]) for a, b in zip(ends, ends[1:])] + [(*b["low"], a["range"]) for a, b in zip(ends, ends[1:])]
    beside = spark.createDataFrame(halo, "host string, path string, page_id long, check long, range int")
    # Two rows for each border of ranges.
    matched = [F.col(f"f.{c}").eqNullSafe(F.col(f"h.{c}")) for c in KEY]
    again = found.alias("f").join(F.broadcast(beside.alias("h")), matched).select("f.*", "h.range", F.lit(False).alias("own"))
    return found.select("*", numbered.alias("range"), F.lit(True).alias("own")).unionByName(again)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if none), n_chars.

    Pages are dealt by ranges of host and path, so a hot host is spread; pages at a range's edge also go to the range
    beside it, so the result is the same however many partitions there are. Of two neighbours with equally long
    shared beginnings of the path, the one before decides. Null html is empty; a page with a null or odd url has
    the host it can be given (the empty one at worst) and stays. Repeated rows come back each. Html of any
    length is read whole. An empty table gives no rows. Other columns are not read.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col(id_col).cast("long").alias("page_id"),
        F.xxhash64(url_col, html_col).alias("check"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).alias("html"),
    )

    def run(batches):
        before, now = None, None  # (host, path, range, own, page_id, url, lines)
        done: list[tuple] = []

        def finish(page, behind):
            if page[3]:
                near = [(_prefix(page[1], x[1]), -side, x[6]) for side, x in enumerate((before, behind)) if x and x[0] == page[0] and x[2] == page[2]]
                text = main_text(page[6], max(near, key=lambda x: x[:2])[2] if near else None)
                done.append((page[4], page[5], text, len(text)))

        def batch_of(found):
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])

        for batch in slices(batches, 6):
            for host, path, part, own, page_id, address, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = (host, path, part, own, page_id, address, lines_of(html or ""))
                if now:
                    finish(now, page)
                before, now = now, page
            if done:
                yield batch_of(done)
                done.clear()
        if now:
            finish(now, None)
            if done:
                yield batch_of(done)

    dealt = _ordered(rows).repartitionByRange("range").sortWithinPartitions("range", *KEY)
    return dealt.select("host", "path", "range", "own", "page_id", "url", "html").mapInArrow(run, SCHEMA)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
