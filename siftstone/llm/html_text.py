"""Main text of web pages by markup and by differencing with the nearest URL.

A page becomes text lines, one for each block. Pages are ordered by host and URL path, each is
paired with the neighbour of its host whose path shares the longest beginning, the two pages' lines
are aligned by longest common subsequence, and shared lines are deleted. Markup settles the lines
that differencing alone gets wrong: lines inside menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and the like go although the neighbour has others; lines inside an
article or main element stay although the neighbour has them too, and then lines outside it go.
`counts` says how many lines differencing found shared and where markup overruled it; the README
gives figures.

Pages are ordered by range over the whole table, so a host with most pages is spread like any
other; only hashes of lines travel to neighbours, not text.

Rows: null html gives empty text; a null or odd URL counts as host '' and path ''. A page without
a neighbour on its host, or whose neighbour has the same lines, loses nothing by differencing; of
two neighbours that are equally near, the one before is taken. Repeated rows are treated alike. Nothing is
capped: texts are whole, however long. An empty table gives an empty result, and extra columns are not
looked at. The result has page_id, url, text and n_chars, and the counts on request.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Fixed: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
DROPPED = frozenset("noscript template object svg math canvas audio video select datalist".split())
CHROME = frozenset("head nav footer aside form button dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Fixed: words in a class or id that name something other than the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead "
    "menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: End tags of raw elements; what stands before them is not markup.
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
SPACE = re.compile(r"\s+")
GONE, OPEN, MAIN = 0, 1, 2


def _names_chrome(name: str, key: str, value: str, in_main: bool) -> bool:
    """Whether a class or id names something other than the article; inside one only as a whole name, as parts of slugs are the article's own words."""
    if not in_main:
        return not CHROME_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value))
    return not (key == "id" and name in TEXT) and not CHROME_WORDS.isdisjoint(value.split())


def _is_chrome(name: str, attributes: str, in_main: bool) -> bool:
    if name in CHROME or name in DROPPED or (name == "header" and not in_main):
        return True
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _names_chrome(name, key, value, in_main):
            return True
        if key == "role" and CHROME_ROLES.intersection(value.split()):
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """(text, GONE, OPEN or MAIN) of each block of a page, in order."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, main
    state = [False, False]
    at = 0
    ends: dict[str, int] = {}

    def flush() -> None:
        line = SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if line:
            out.append((line, GONE if state[0] else MAIN if state[1] else OPEN))

    def settle() -> None:
        state[0], state[1] = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while m := TOKEN.search(page, at):
        name = m[2].lower() if m[2] else None
        text.append(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                if any(x[0] in BLOCK for x in stack[k:]):
                    flush()
                del stack[k:]
                settle()
        elif name in RAW:
            end = RAW_END[name].search(page, at)  # only its end tag ends a raw element
            at = end.end() if end else len(page)
        elif name == "br":
            text.append(" ")
        elif name in DROPPED and (m[3].endswith("/") or ends.setdefault(name, page.lower().rfind(f"</{name}")) < at):
            pass  # one that nothing closes holds nothing
        elif name not in VOID:
            if name in CLOSES_P and any(x[0] == "p" for x in stack):
                k = max(k for k, x in enumerate(stack) if x[0] == "p")
                if not any(x[0] in BLOCK for x in stack[k + 1 :]):
                    del stack[k:]
                    settle()
            chrome = state[0] or _is_chrome(name, m[3], state[1])
            stack.append((name, chrome, state[1] or name in ("article", "main")))
            if chrome and not state[0]:
                flush()
            settle()
    text.append(page[at:])
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Places in `a` of a longest common subsequence with `b`."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            found.add(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            found.add(j - 1)
            j, n = j - 1, n - 1
        if i == j or k == n:
            continue
        where: dict = {}
        for at in range(k, n):
            where.setdefault(b[at], []).append(at)
        if sum(len(where.get(x, ())) for x in a[i:j]) <= 64 * (j - i + n - k):
            found.update(_sparse(a, i, j, where))
        else:  # many repeated lines: halve `a` where the halves' best lengths add up to most
            mid = (i + j) // 2
            ahead, back = _lengths(a[i:mid], b[k:n]), _lengths(a[mid:j][::-1], b[k:n][::-1])[::-1]
            cut = k + int(np.argmax(ahead + back))
            todo += [(i, mid, k, cut), (mid, j, cut, n)]
    return found


def _sparse(a: list, i: int, j: int, where: dict) -> set[int]:
    """Places in a[i:j] of a longest common subsequence, from the places of its lines in the other list."""
    ends: list[int] = []
    links: list[tuple] = []
    for at in range(i, j):
        for k in reversed(where.get(a[at], ())):
            n = bisect_left(ends, k)
            link = (at, links[n - 1] if n else None)
            if n == len(ends):
                ends.append(k)
                links.append(link)
            else:
                ends[n], links[n] = k, link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of `a` and b[:k], for every k; a row of bits for each line of `a`."""
    where: dict = {}
    for k, x in enumerate(b):
        where.setdefault(x, []).append(k)
    masks = {x: sum(1 << k for k in at) for x, at in where.items() if len(at) > 8}
    row = full = (1 << len(b)) - 1
    for x in a:
        mask = masks.get(x) or sum(1 << k for k in where.get(x, ()))
        both = row & mask
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def main_text(found: list[tuple[str, int]], partner: list[int] | None) -> tuple[str, int, int]:
    """(text, lines shared with the partner, lines where markup overrules that)."""
    shared = common_lines([line_hash(x) for x, _ in found], partner) if partner else set()
    in_main = any(kind == MAIN for _, kind in found)
    kept = [kind == MAIN if in_main else kind == OPEN and k not in shared for k, (_, kind) in enumerate(found)]
    overruled = sum(keep == (k in shared) for k, keep in enumerate(kept))
    return "\n\n".join(x for (x, _), keep in zip(found, kept, strict=True) if keep), len(shared), overruled


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@c.tidy
def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[line_hash(x) for x, _ in lines(page.as_py())] for page in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int64()))], ["host", "path", "row", "hashes"])


@c.tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lines(page.as_py()), near.as_py()) for page, near in zip(batch.column(2), batch.column(3), strict=True)]
        found = [(*main_text(x, near), len(x)) for x, near in rows]
        text, shared, overruled, n = zip(*found, strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in (map(len, text), n, shared, overruled))],
            ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_overruled"],
        )


def _place(url: str):
    """Host and path of a URL, without scheme, port, query, fragment, closing slash and extension."""
    address = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    address = F.regexp_replace(address, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(address, "^[^/]*", 0), r":\d*$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(address, "/.*$", 0), "/+$", ""), r"\.[A-Za-z]{1,5}$", "")
    return host, path


def _shared_prefix(a: str, b: str):
    """Characters that two paths begin with alike, 0 if one is null: pieces of halving length are compared, each behind those that were equal."""
    n = F.least(F.length(a), F.length(b))
    halves = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int") + 1, F.lit(0), F.lit(-1))

    def longer(known, p):
        k = F.pow(F.lit(2), p).cast("int")
        return F.when((known + k <= n) & (F.substring(a, known + 1, k) == F.substring(b, known + 1, k)), known + k).otherwise(known)

    return F.when(F.col(a) == F.col(b), F.length(a)).otherwise(F.coalesce(F.aggregate(halves, F.lit(0), longer), F.lit(0)))


def nearest_lines(outline: DataFrame) -> DataFrame:
    """(row, partner): the line hashes of the neighbour on the same host with the nearest path."""
    order = ["host", "path", "row"]
    # a page without lines needs no partner and is none
    parts = c.save(outline.where(F.size("hashes") > 0).dropDuplicates(["row"]).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    item = F.struct(*order, "hashes")
    edges = parts.groupBy("part").agg(F.min(item).alias("first"), F.max(item).alias("last"))
    outer = edges.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"), F.lead("first").over(Window.orderBy("part")).alias("after"))
    inside = Window.partitionBy("part").orderBy(*order)
    near = parts.select("row", "host", "path", "hashes", "part", F.lag(item).over(inside).alias("p"), F.lead(item).over(inside).alias("n")).join(outer, "part")
    near = near.select("row", "host", "path", "hashes", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    usable = {x: (F.col(f"{x}.host") == F.col("host")) & (F.col(f"{x}.hashes") != F.col("hashes")) for x in "pn"}
    near = near.select("*", F.when(usable["p"], F.col("p.path")).alias("pp"), F.when(usable["n"], F.col("n.path")).alias("np"))
    near = near.withColumn("sp", F.coalesce(_shared_prefix("path", "pp"), F.lit(-1))).withColumn("sn", F.coalesce(_shared_prefix("path", "np"), F.lit(-1)))
    partner = F.when(F.col("pp").isNotNull() & (F.col("sp") >= F.col("sn")), F.col("p.hashes")).when(F.col("np").isNotNull(), F.col("n.hashes"))
    return near.select("row", partner.alias("partner")).where("partner is not null").groupBy("row").agg(F.min("partner").alias("partner"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", counts: bool = False) -> DataFrame:
    """page_id, url, text, n_chars of each page; with `counts` also n_lines, n_shared (by its neighbour) and n_overruled (by markup)."""
    host, path = _place("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # a row is known by its content: rows that are alike in all three columns have one result
    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    outline = rows.select(host.alias("host"), path.alias("path"), "row", "html").mapInArrow(_outline, "host string, path string, row long, hashes array<long>")
    near = c.save(nearest_lines(outline))
    found = rows.join(near.hint("merge"), "row", "left").select("page_id", "url", "html", "partner")
    kinds = dict(rows.dtypes)
    out = found.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_lines long, n_shared long, n_overruled long")
    return out if counts else out.select("page_id", "url", "text", "n_chars")
