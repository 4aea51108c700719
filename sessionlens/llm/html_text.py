"""Main text of web pages: nearest-URL page differencing, and structure.

A page is read into lines, one a block of text, each marked as chrome (inside menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, by element, role or class) or not, and as inside an article or not. Pages are put in order of host and URL path; a page's
near pages are the REACH before and the REACH after it of its host. The lines of a page and of each near page are aligned by longest common
subsequence. A near page that shares more than half of the article (without an article: all lines) is a copy and deletes nothing, and near
pages that are copies of each other count once.

Shared lines go: outside articles those that any near page shares; inside an article, where pages quote the same passages, those
that all near pages share, if these are ALL or more. Of what is left, structure takes menus and adverts that differ from page to page, and on pages
with an article the lines outside it.

The order of pages is cut into chunks of neighbours; pages near a cut are sent to both sides, so a page meets the same near pages however
the work is dealt.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, warc

#: Elements whose content is never text, or is chrome.
SILENT = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "math", "audio", "video"))
CHROME = frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select", "fieldset"))
CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"))
CHROME_NAMES = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "share", "sharing", "social", "related", "pagination", "pager", "toolbar", "widget", "login", "signup", "search")
)
ARTICLE = frozenset(("article", "main"))
BLOCKS = frozenset(
    ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "thead", "tbody", "tr", "td", "th", "caption", "blockquote", "pre", "section", "figure", "figcaption", "dl", "dt", "dd", "hr", "address", "details", "summary", "body", "html", "head", "center")
) | CHROME | ARTICLE
BLOCKS -= {"button", "select"}  # these stand in a line
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
MOST_MATCHES = 1 << 20
REACH, ALL = 3, 4
#: A chunk has LEAST_CHUNK pages, or so many that there are MOST_CHUNKS: the chunks' first keys are looked up by every task.
LEAST_CHUNK, MOST_CHUNKS, GROUP = 512, 1 << 16, 256
#: Parts of class names that don't change what the other parts say.
NEUTRAL = frozenset(("list", "box", "bar", "wrap", "wrapper", "block", "link", "links", "section", "area", "container", "button", "buttons", "item", "items", "inner", "content", "top", "bottom", "left", "right", "main", "site", "page", "global", "post", "posts", "article", "articles", "form", "icons", "panel", "thread", "slot", "unit"))
#: What a page calls its head is chrome, what an article calls its head is text.
HEADS = frozenset(("header", "masthead", "banner"))

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>")
_SILENT_END = re.compile(rf"</({'|'.join(sorted(SILENT))})\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass(frozen=True)
class Line:
    text: str
    chrome: bool
    article: bool


def _says_chrome(name: str, inside: bool) -> bool:
    """Whether a class or id names chrome: one part does, and no other part says something else."""
    parts = [x for x in re.split(r"[_-]+", name) if x and not x.isdigit()]
    named = [x for x in parts if x in CHROME_NAMES and not (inside and x in HEADS)]
    return bool(named) and all(x in CHROME_NAMES or x in NEUTRAL for x in parts)


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in CHROME:
        return not (inside and tag in HEADS)
    if tag in ARTICLE or tag in ("body", "html") or not attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and any(_says_chrome(x, inside) for x in value.split()):
            return True
        if name == "role" and value in CHROME_ROLES or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes.lower()))


def lines(source: str) -> list[Line]:
    """The page's lines in page order. Elements left open end with the page; an article ends chrome left open before it. Chrome that is no block
    leaves the line that it stands in whole; its own text comes before that line."""
    out: list[Line] = []
    parts: list[str] = []
    chrome: list[list] = []  # open chrome elements: tag, depth of the same tag inside
    held: list[str] | None = None  # the line so far, while chrome that stands inside it is open
    article = 0

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Line(text, bool(chrome), article > 0))

    def resume() -> None:
        """Go on with the line that chrome stood in."""
        nonlocal held
        if held is not None:
            parts[:], held = held, None

    at, n = 0, len(source)
    last = source.rfind(">")
    ends: dict[str, list[tuple[int, int]]] = {}  # of silent elements

    def end_of(tag: str, start: int) -> int | None:
        if not ends:
            ends[""] = []
            for m in _SILENT_END.finditer(source, 0, last + 1):
                ends.setdefault(m[1].lower(), []).append(m.span())
        own = ends.get(tag, [])
        k = bisect.bisect_left(own, (start, 0))
        return own[k][1] if k < len(own) else None

    while at < n:
        mark = source.find("<", at)
        if mark < 0 or mark > last:
            parts.append(source[at:])
            break
        parts.append(source[at:mark])
        if source.startswith("<!--", mark):
            stop = source.find("-->", mark + 4)
            at = n if stop < 0 else stop + 3
            continue
        if source.startswith(("<!", "<?"), mark):
            at = source.find(">", mark) + 1
            continue
        found = _TAG.match(source, mark)
        if not found:
            follows = source[mark + 1 : mark + 3]
            if follows[:1].isalpha() or follows[:1] == "/" and follows[1:].isalpha():  # a tag with a quote left open
                at = source.find(">", mark) + 1
            else:
                parts.append("<")
                at = mark + 1
            continue
        tag, attributes, closing = found[1].lower(), found[2], source[mark + 1] == "/"
        at = found.end()
        if tag in SILENT:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = end_of(tag, at)
                at = stop if stop else (n if tag in ("script", "style") else at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            end_line()
        if closing:
            if chrome and chrome[-1][0] == tag:
                if chrome[-1][1]:
                    chrome[-1][1] -= 1
                else:
                    end_line()
                    chrome.pop()
                    if not chrome:
                        resume()
            elif tag in ARTICLE and not chrome:
                article = max(0, article - 1)
        elif tag in ARTICLE and not any(t == "article" for t, _ in chrome):
            chrome.clear()
            resume()
            end_line()
            article += 1
        elif chrome and chrome[-1][0] == tag:
            chrome[-1][1] += 1
        elif tag not in VOID and _is_chrome(tag, attributes, article > 0 and not chrome):
            if chrome or tag in BLOCKS:
                end_line()
            else:
                held, parts = parts, []
            chrome.append([tag, 0])
    end_line()
    chrome.clear()
    resume()
    end_line()
    return out


def _by_pairs(a: list[int], places: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Positions in a and b of a longest common subsequence, from the matching pairs; places: each line's positions in b."""
    ends: list[int] = []  # smallest last position in b of a common subsequence of each length
    nodes: list[tuple[int, int, tuple | None]] = []
    for k, line in enumerate(a):
        for p in reversed(places.get(line, ())):
            size = bisect.bisect_left(ends, p)
            node = (k, p, nodes[size - 1] if size else None)
            if size == len(ends):
                ends.append(p)
                nodes.append(node)
            else:
                ends[size], nodes[size] = p, node
    out = []
    node = nodes[-1] if nodes else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and b[:j], for j from 0 to len(b)."""
    row = np.zeros(len(b) + 1, np.int64)
    for line in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == line)))
    return row


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions in a and b of a longest common subsequence, from the matching pairs; where these are more than MOST_MATCHES, a is halved and b cut where both halves share most (Hirschberg), which takes linear memory."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    keep = [(k, k) for k in range(lo)] + [(len(a) - k, len(b) - k) for k in range(1, hi + 1)]
    numbers: dict[str, int] = {}
    whole_a, whole_b = ([numbers.setdefault(line, len(numbers)) for line in x[lo : len(x) - hi]] for x in (a, b))
    todo = [(lo, lo, whole_a, whole_b)]
    while todo:
        at_a, at_b, a, b = todo.pop()
        places: dict[int, list[int]] = {}
        for k, line in enumerate(b):
            places.setdefault(line, []).append(k)
        if len(a) > 1 and sum(len(places.get(line, ())) for line in a) > MOST_MATCHES:
            half = len(a) // 2
            first, second, other = np.array(a[:half]), np.array(a[half:]), np.array(b)
            cut = int((_lengths(first, other) + _lengths(second[::-1], other[::-1])[::-1]).argmax())
            todo += [(at_a, at_b, a[:half], b[:cut]), (at_a + half, at_b + cut, a[half:], b[cut:])]
        else:
            keep += [(at_a + i, at_b + j) for i, j in _by_pairs(a, places)]
    return keep


@dataclass
class Page:
    """A page, and for each near page the set of its lines and which of this page's lines it shares."""

    own: list[Line]
    near: list[tuple[frozenset[str], set[int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.texts = [line.text for line in self.own]
        self.set = frozenset(self.texts)
        self.body = frozenset(line.text for line in self.own if line.article and not line.chrome)

    def copied(self, other: frozenset[str]) -> bool:
        return 2 * len(self.body & other) > len(self.body) if self.body else self.set <= other


def meet(a: Page, b: Page) -> None:
    """Align two near pages."""
    pairs = aligned(a.texts, b.texts) if not a.set.isdisjoint(b.set) else []
    a.near.append((b.set, {i for i, _ in pairs}))
    b.near.append((a.set, {j for _, j in pairs}))


def verdicts(page: Page) -> list[str]:
    """What becomes of each line: 'shared' (deleted by differencing), 'structure' (deleted by structure) or 'text'."""
    near: list[tuple[frozenset[str], set[int]]] = []
    for lines_there, found in page.near:
        if not page.copied(lines_there) and not any(2 * len(lines_there & x) > len(lines_there) for x, _ in near):
            near.append((lines_there, found))
    any_shares = set().union(*(found for _, found in near))
    all_share = set.intersection(*(found for _, found in near)) if len(near) >= ALL else set()
    out = []
    for k, line in enumerate(page.own):
        inside = line.article and not line.chrome
        if k in (all_share if inside else any_shares):
            out.append("shared")
        else:
            out.append("text" if inside or not (line.chrome or page.body) else "structure")
    return out


def main_text(page: Page) -> str:
    return "\n".join(text for text, verdict in zip(page.texts, verdicts(page), strict=True) if verdict == "text")


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages in order of chunk, host and path, each with its real neighbours; `guest` pages are there for the others' sake and give no row."""
    held: deque[tuple[tuple, tuple, bool, Page]] = deque()  # the last REACH pages of the chunk and host
    of = None

    def done(some: list) -> list[tuple]:
        out = []
        for row, _, guest, page in some:
            if not guest:
                text = main_text(page)
                out.append((*row, text, len(text)))
        return out

    columns = ["page_id", "url", "text", "n_chars"]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "n_chars": "int64"})
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if (row.chunk, row.host) != of:
                out += done(held)
                held.clear()
                of = row.chunk, row.host
            page = Page(lines(row.html))
            for _, _, _, other in held:
                meet(other, page)
            held.append(((row.page_id, row.url), of, row.guest, page))
            if len(held) > REACH:
                out += done([held.popleft()])
        yield frame(out)
    if held:
        yield frame(done(held))


def _chunked(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with chunk and guest, and the number of chunks: every page in its chunk, and pages within REACH of a cut as guests in the chunk beyond it.

    The cuts are set from a sort of the keys alone. At most MOST_CHUNKS keys, and 2 * REACH times as many guests, reach the driver and are broadcast.
    """
    spark = rows.sparkSession
    key = F.struct("host", "path", "number", "tie")
    ordered = rows.select(key.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    ordered = common.written(ordered.withColumn("at", F.monotonically_increasing_id()), "page_order")
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sizes)
    chunk = max(LEAST_CHUNK, -(-total // MOST_CHUNKS))
    begins, begin = [], 0
    for part, n in sizes:
        begins.append((part, begin))
        begin += n
    begins = F.broadcast(spark.createDataFrame(begins, "part bigint, begin bigint"))
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(begins, "part").select("key", (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))
    inside, number = F.col("place") % chunk, F.floor(F.col("place") / chunk)
    cuts = [r[0] for r in placed.where((inside == 0) & (F.col("place") > 0)).select("key").orderBy("key").collect()]
    if not cuts:
        return rows.withColumn("chunk", F.lit(0)).withColumn("guest", F.lit(False)), 1
    guests = placed.where(((inside < REACH) & (number > 0)) | (inside >= chunk - REACH)).select("key", F.when(inside < REACH, number - 1).otherwise(number + 1).cast("int").alias("beyond")).distinct()
    table = spark.createDataFrame([(cuts, cuts[::GROUP])], f"cuts array<{rows.select(key.alias('k')).schema['k'].dataType.simpleString()}>, coarse array<{rows.select(key.alias('k')).schema['k'].dataType.simpleString()}>")
    reached = lambda c: F.size(F.filter(c, lambda x: x <= F.col("key")))
    rows = rows.withColumn("key", key).crossJoin(F.broadcast(table)).withColumn("group", reached(F.col("coarse")))  # one row
    rows = rows.withColumn("chunk", F.when(F.col("group") == 0, 0).otherwise((F.col("group") - 1) * GROUP + reached(F.slice("cuts", F.greatest(F.lit(0), F.col("group") - 1) * GROUP + 1, GROUP)))).drop("cuts", "coarse", "group")
    near_cut = guests.groupBy("key").agg(F.collect_set("beyond").alias("beyond"))  # two at most
    rows = rows.join(F.broadcast(near_cut), "key", "left").drop("key")
    places = F.concat(F.array(F.col("chunk")), F.filter(F.coalesce("beyond", F.array().cast("array<int>")), lambda x: x != F.col("chunk")))
    return rows.withColumn("home", F.col("chunk")).withColumn("chunk", F.explode(places)).withColumn("guest", F.col("chunk") != F.col("home")).drop("home", "beyond"), len(cuts) + 1


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html).

    Null html is empty and has empty text; a null url counts as empty for sorting and stays null, a null page_id sorts first. A repeated row
    gives a row each time. Other columns are ignored.
    """
    key = warc.url_key(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.substring_index(key, ")", 1)).withColumn("path", F.regexp_replace(key, r"^[^)]*\)|\?.*$", ""))
    rows = rows.withColumn("number", F.coalesce("page_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("url"))
    rows, chunks = _chunked(rows)
    rows = rows.withColumn("last", F.xxhash64("html"))
    # more partitions than the session's where eight chunks each need them
    parts = -(-chunks // 8)
    many = parts > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartition(parts, "chunk") if many else rows.repartition("chunk")).sortWithinPartitions("chunk", "host", "path", "number", "tie", "last")
    return rows.select("page_id", "url", "html", "host", "chunk", "guest").mapInPandas(_differ, "page_id long, url string, text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
