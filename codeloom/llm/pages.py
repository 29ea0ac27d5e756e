"""Main text of web pages by page differencing, with markup as a check on it.

A page is cut into blocks of text at its block tags. Blocks inside menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles (by tag, class, id or role)
go. Every page is paired with the page of its host whose URL path is nearest, and their
lines are aligned by longest common subsequence. Shared lines go, as templates repeat.

If the page marks its article (``article`` or ``main``), only lines inside it are text, and
the mark is a check on the alignment, as texts of different pages do share real sentences: a
line goes only if both neighbours share it, and none go if that took over half of the article
(then the pages are copies of each other).

Nearest is the neighbour, in the order of host, path and page id, with the longest common
start of the path. Pages meet their neighbours in ranges of that order, so a host of any size
spreads over many tasks. A first pass over ids and URLs finds the ends of the ranges; the
pages there travel to the range beside theirs as well, so each page sees both neighbours.
Only a page that is alone with its host has no pair and keeps its lines.

Defined cases: a null or empty page has an empty text; text outside all blocks counts as a
block; tags that are never closed end with their parent; null URLs share an empty host;
a page whose neighbours are copies of it, as repeated rows are, keeps its lines; an empty table gives an empty table; only the named
columns are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements without an end tag, whose content is no markup, and that break blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements and names of classes, ids and roles that hold no main text.
DROPPED = frozenset("script style noscript template nav header footer aside form button select textarea iframe svg canvas object menu dialog head title input label fieldset".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner bannerad breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus dropdown footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
MAIN = ("article", "main")


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", *MAIN):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role") and not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(where, text) of the blocks that markup doesn't rule out: where is article, main or body."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool]] = []
    drops = 0
    inside = dict.fromkeys(MAIN, 0)
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(("article" if inside["article"] else "main" if inside["main"] else "body", text))

    raw_until = ""
    for m in _TOKEN.finditer(page):
        token = m.group()
        tag = m.group(2)
        if raw_until:
            if tag and m.group(1) and tag.lower() == raw_until:
                raw_until = ""
            else:
                continue
        if tag is None:
            if token[0] != "<" or token == "<":
                if not drops:
                    held.append(token)
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if m.group(1):
            if any(name == tag for name, _ in stack):
                while True:
                    name, dropped = stack.pop()
                    drops -= dropped
                    if name in inside:
                        inside[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in VOID or m.group(3).endswith("/"):
            continue
        dropped = _dropped(tag, m.group(3))
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            drops -= stack.pop()[1]
        stack.append((tag, dropped))
        drops += dropped
        if tag in inside:
            inside[tag] += 1
        if tag in RAW:
            raw_until = tag
    flush()
    return out


def _skip_raw(page: str) -> str:
    """The page without the contents of scripts and styles, whose quotes and brackets mean nothing."""
    return re.sub(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", " ", re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", page))


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken off; the rest is split in halves (Hirschberg) with bit-parallel row
    lengths, so memory grows with the lines and not with their product.
    """
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, n = work.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append(j)
        if i >= j or k >= n:
            continue
        if j - i == 1:
            if a[i] in b[k:n]:
                out.append(i)
            continue
        half = (i + j) // 2
        fore, back = _lengths(a[i:half], b[k:n]), _lengths(a[half:j][::-1], b[k:n][::-1])
        cut = max(range(n - k + 1), key=lambda x: fore[x] + back[n - k - x])
        work += [(i, half, k, k + cut), (half, j, k + cut, n)]
    return sorted(out)


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` with each start of ``b``."""
    places: dict = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    ones = (1 << len(b)) - 1
    row = ones
    for x in a:
        match = row & places.get(x, 0)
        row = (row + match | row - match) & ones
    out = [0]
    for k in range(len(b)):
        out.append(out[-1] + (not row >> k & 1))
    return out


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def _place(url: str | None) -> tuple[str, str]:
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    return (m.group(1).lower(), m.group(2)) if m else ("", "")


def marked_text(found: list[tuple[str, str]]) -> str | None:
    """Text of a page that marks its article; None for other pages."""
    for name in MAIN:
        if any(where == name for where, _ in found):
            return "\n".join(text for where, text in found if where == name)
    return None if found else ""


_NARROW = "part int, page_id {id}, url string, host string, path string, guest boolean, marked boolean, lines array<long>, blocks array<string>"


def _key(host: str, path: str, page_id: object) -> tuple:
    """Places a page as Spark sorts it: nulls first."""
    return host, path, page_id is not None, page_id


def _ranges(picked: DataFrame, parts: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First keys of the ranges, in order, and the keys of pages that the ranges beside theirs need, with the numbers of these."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_place(u.as_py()) for u in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), b.column(0)], ["host", "path", "page_id"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first, last = first or b.slice(0, 1), b.slice(b.num_rows - 1)
        if first:
            yield from (first, last)

    schema = f"host string, path string, page_id {picked.schema['page_id'].dataType.simpleString()}"
    keys = picked.select("page_id", "url").mapInArrow(places, schema).repartitionByRange(parts, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    found = sorted(_key(*r) for r in keys.mapInArrow(ends, schema).collect())
    firsts, lasts = found[::2], found[1::2]
    guests: dict[tuple, list[int]] = {}
    for k in range(1, len(firsts)):
        if lasts[k - 1][0] == firsts[k][0]:
            guests.setdefault(lasts[k - 1], []).append(k)
            guests.setdefault(firsts[k], []).append(k - 1)
    return firsts, guests


def kept_lines(row: dict, beside: list[dict]) -> list[str]:
    """The lines of a page that stay, given its neighbours of the same host."""
    own = {k for k, t in enumerate(row["blocks"]) if t is not None}
    gone: set[int] = set()
    beside = [x for x in beside if x["lines"] != row["lines"]]
    if beside:
        order = sorted(beside, key=lambda x: -_common_start(x["path"], row["path"]))
        gone = own & set(common_lines(row["lines"], order[0]["lines"]))
    if row["marked"] and gone:
        gone = gone & set(common_lines(row["lines"], order[1]["lines"])) if len(order) > 1 else set()
        if 2 * len(gone) > len(own):
            gone = set()
    return [row["blocks"][k] for k in sorted(own - gone)]


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    picked = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = picked.schema["page_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts, guests = _ranges(picked, parts)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (p, u, h) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                found = blocks(_skip_raw(h or ""))
                inside = next((name for name in MAIN if any(where == name for where, _ in found)), None)
                key = _key(*_place(u), p)
                lines = [_hash(t) for _, t in found]
                rows.append((bisect_right(firsts, key) - 1, i, *key[:2], False, inside is not None, lines, [t if inside in (None, where) else None for where, t in found]))
                rows += [(part, i, *key[:2], True, inside is not None, lines, None) for part in guests.get(key, ())]
            part, at, host, path, guest, marked, lines, texts = zip(*rows, strict=True) if rows else [()] * 8
            places = pa.array(at, pa.int32())
            columns = [pa.array(part, pa.int32()), b.column(0).take(places), b.column(1).take(places), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(guest, pa.bool_()), pa.array(marked, pa.bool_()), pa.array(lines, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "page_id", "url", "host", "path", "guest", "marked", "lines", "blocks"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None

        def judged(after: dict | None) -> list[tuple]:
            if now is None or now["guest"]:
                return []
            beside = [x for x in (before, after) if x is not None and (x["part"], x["host"]) == (now["part"], now["host"])]
            return [(now["page_id"], now["url"], "\n".join(kept_lines(now, beside)))]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, urls, texts = zip(*rows, strict=True) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        for b in batches:
            id_type, out = b.schema.field("page_id").type, []
            for row in b.to_pylist():
                out += judged(row)
                before, now = now, row
            yield batch(out)
        if now is not None:
            yield batch(judged(None))

    ordered = picked.mapInArrow(narrow, _NARROW.format(id=kind)).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "host", "path", "page_id")
    return ordered.mapInArrow(paired, f"page_id {kind}, url string, text string")


def _common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n
