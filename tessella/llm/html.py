"""HTML extraction by nearest-URL page differencing.

A page's markup gives text lines (blocks), each known to lie in the main container (article, main) or not; menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by their element, role or class
name. Pages are sorted by host, path and id: the nearest page by path is beside a page in this order, before or after
it. Its lines are aligned with both of these by longest common subsequence. Pages beside it that hold the same article
(`alike`) tell nothing.

A page with a container keeps the container's lines but for labels (lines that end no sentence) that the pages on both
sides have too, as the site puts them on every page; if these are over `SMALL` of the container, the three are versions
of one article and all lines stay. So a sentence that one other page has, an updated or a continued article lose nothing, and what lies
outside the container never comes in. A page without a container loses the lines that both sides have, or the only
side; a single page that has over half of its long lines (`LONG` words) is a version of it, and it keeps all.

Pages are spread by ranges of (host, path, id), so a host with a third of all pages takes as many tasks as it needs.
The first and last pages of a range go to the ranges beside it too, so the ranges don't show in the texts. Defined
results: null and empty html give an empty text and are nobody's neighbour; repeated pages are copies; unclosed
elements end with what surrounds them, or with the page; a null url has an empty host and path; a null or repeated
page_id gets its own row each time; an empty table gives no rows; other columns are not read; a page is read whole,
however long, by one task, which then holds it and its two neighbours.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urls import host_and_path

#: HTML element names by what they mean here.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "ruby", "rt", "rp"}
AWAY = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select"}
MAIN = {"article", "main"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
AWAY_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "sidebar", "sidebars", "comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "share", "sharing", "social", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "toolbar", "pagination", "pager", "widget", "skip"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME = re.compile(r"[a-z]+")
#: Marks of a line: outside the main container, in it, its h1.
OUTSIDE, INSIDE, HEADING = 0, 1, 2
#: Share of a container that may go, and words of a line that is no menu entry.
SMALL, LONG = 0.3, 12
#: What a sentence ends with.
ENDS = set(".!?…:;,。！？»”\"')")
#: Ranges of pages to each shuffle partition, and sampled pages to each range.
RANGES, SAMPLED = 4, 20


def _away(tag: str, attributes: str, inside: bool) -> bool:
    if tag in AWAY and not (tag == "header" and inside):
        return True
    if not attributes.strip():
        return False
    a = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if a.get("role") in AWAY_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if tag in MAIN or tag in ("body", "html"):
        return False
    return any(n in AWAY_NAMES for n in NAME.findall(f"{a.get('class', '')} {a.get('id', '')}"))


def lines(page: str) -> list[tuple[str, int]]:
    """(text, mark) of each block that isn't away."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[list] = []  # element, away, main
    away = main = 0

    def end():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, OUTSIDE if not main else HEADING if any(x[0] == "h1" for x in stack[-3:]) else INSIDE))

    pos = 0
    while True:
        m = TAG.search(page, pos)
        if not away:
            held.append(page[pos : m.start() if m else len(page)])
        if not m:
            break
        pos = m.end()
        close, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if tag in RAW:
            if not close and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = stop.end() if stop else len(page)
            continue
        if tag not in INLINE:
            end()
        if close:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if at >= 0:
                for _, a, b in stack[at:]:
                    away, main = away - a, main - b
                del stack[at:]
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            is_main = tag in MAIN or bool(re.search(r"role\s*=\s*[\"']?main\b|articlebody", attributes, re.I))
            if is_main and not main:  # a form or the like around the whole page doesn't hide it
                if not any(s[0] in ("aside", "nav", "footer") for s in stack):
                    for s in stack:
                        away, s[1] = away - s[1], False
            gone = _away(tag, attributes, main > 0)
            stack.append([tag, gone, is_main])
            away, main = away + gone, main + is_main
    end()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):  # from the last on, so that one line of a is used once
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    out, node = set(), links[-1] if links else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def alike(own: list[tuple[str, int]], other: list[tuple[str, int]]) -> bool:
    """Whether two pages hold one article: equal lines in their containers, an equal h1 in them, or all lines of one."""
    for marks in ((INSIDE, HEADING), (HEADING,)):
        a, b = ([t for t, m in x if m in marks] for x in (own, other))
        if a and a == b:
            return True
    return len(shared([t for t, _ in own], [t for t, _ in other])) == min(len(own), len(other))


def main_text(own: list[tuple[str, int]], *others: list[tuple[str, int]] | None) -> str:
    """The page's main text, from its own lines and those of the pages beside it (None where there is none)."""
    texts = [t for t, _ in own]
    near = [shared(texts, [t for t, _ in x]) for x in others if x and not alike(own, x)]
    everywhere = set.intersection(*near) if len(near) > 1 else set()
    size = lambda places: sum(len(texts[k]) for k in places)
    if inside := [k for k, (_, mark) in enumerate(own) if mark]:
        gone = {k for k in everywhere.intersection(inside) if texts[k][-1] not in ENDS}
        if size(gone) > SMALL * size(inside):
            gone = set()
        return " ".join([texts[k] for k in inside if k not in gone])
    if len(near) == 1:
        long = {k for k, t in enumerate(texts) if t.count(" ") >= LONG - 1}
        everywhere = set() if 2 * len(near[0] & long) > len(long) else near[0]
    return " ".join([t for k, t in enumerate(texts) if k not in everywhere])


def _key(host: str, path: str, page_id: int | None) -> tuple[str, str, int]:
    return host, path, -(1 << 63) if page_id is None else page_id


def ranges(keys: DataFrame, n: int) -> tuple[list, dict, dict]:
    """Bounds of about n ranges of (host, path, page_id); the first pages of ranges, with the range before, and the last
    pages, with the range after. The bounds come from a sample by hash, of n * SAMPLED to about twice as many."""
    one_in = max(1, keys.count() // (n * SAMPLED))
    few = keys.filter(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(one_in)) == 0).distinct().collect()
    step = max(SAMPLED, -(-len(few) // n))
    bounds = sorted(_key(*r) for r in few)[step // 2 :: step]

    def place(it):
        for batch in it:
            found = [_key(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id")), strict=True)]
            at = [bisect_right(bounds, k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array([k[j] for k in found], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=["at", "host", "path", "page_id"])

    key = F.struct("host", "path", "page_id")
    ends = keys.mapInArrow(place, "at int, host string, path string, page_id long").groupBy("at").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    ends.sort(key=lambda r: r["at"])
    before = {tuple(y["lo"]): x["at"] for x, y in zip(ends, ends[1:], strict=False)}
    after = {tuple(x["hi"]): y["at"] for x, y in zip(ends, ends[1:], strict=False)}
    return bounds, before, after


PARSED = "at int, own boolean, page_id long, url string, host string, path string, lines array<string>, marks array<int>"


def extract(pages: DataFrame, n: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, by way of about n ranges of pages."""
    host, path = host_and_path("url")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), "html")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = n or RANGES * parts
    edges = pages.sparkSession.sparkContext.broadcast(ranges(pages.select("host", "path", "page_id"), n))

    def parse(it):
        bounds, before, after = edges.value
        for batch in it:
            found = [lines(h or "") for h in batch.column("html").to_pylist()]
            row, at, own = [], [], []
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id")), strict=True)):
                key = _key(*key)
                home = bisect_right(bounds, key)
                for x in {home, before.get(key, home), after.get(key, home)}:
                    row.append(k)
                    at.append(x)
                    own.append(x == home)
            columns = [batch.column(c) for c in ("page_id", "url", "host", "path")]
            columns += [pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string())), pa.array([[m for _, m in x] for x in found], pa.list_(pa.int32()))]
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own, pa.bool_()), *(c.take(take) for c in columns)], names=["at", "own", "page_id", "url", "host", "path", "lines", "marks"])

    def pair(it):
        def rows():
            for batch in it:
                columns = [batch.column(c).to_pylist() for c in ("at", "host", "own", "page_id", "url", "lines", "marks")]
                for a, h, o, p, u, t, m in zip(*columns, strict=True):
                    yield (a, h), o, p, u, list(zip(t, m, strict=True))

        def flush(done):
            texts = [t for *_, t in done]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        before = page = None
        done = []
        for following in chain(rows(), [None]):
            if page and page[1]:
                done.append((page[2], page[3], main_text(page[4], *(x[4] if x and x[0] == page[0] else None for x in (before, following)))))
            if len(done) >= 1000:
                yield flush(done)
                done = []
            before, page = page, following
        if done:
            yield flush(done)

    near = pages.mapInArrow(parse, PARSED).repartitionById(parts, F.col("at") % parts).sortWithinPartitions("at", "host", "path", "page_id", "url", "lines", "marks")
    return near.mapInArrow(pair, "page_id long, url string, text string, n_chars long")
