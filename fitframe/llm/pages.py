"""HTML extraction with nearest-URL page differencing.

A page is read into text lines, one a block element, each of them inside the
article, inside furniture (menus, footers, adverts ...) or in the open.  Its
main lines are those of the article, or the open ones if it has none.  Pages
of a host with the same main lines are copies and count as one.  What is left
is put in order of URL path, and each page is compared with the nearest one
before and after it that is no near copy: lines of the longest common
subsequence are put forward as the site's.  A line put forward is the site's
if at least ``host_share`` of the host's distinct pages hold it as a main line;
it is then deleted from all pages of the host, but for headlines (lines of an
``h1`` or equal to the page's title), which always stay.

A near copy tells nothing about the site, nor does a page without a line of
its own: two pages are taken for near copies if one has no main line beyond
the common ones, or if over half of those it has are reworded in the other.
How many lines they share does not matter.

Only line hashes and small word sketches are sorted and compared; page texts
do not travel.  A host may hold any share of the pages: the order is cut into
chunks of bounded size whose edge pages are given to both sides.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from html import unescape
from itertools import combinations
from urllib.parse import urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relate import broadcast_if_small
from .shared import read, renamed, staged, tasks

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp"
             " small span strike strong sub sup time tt u var wbr br td th input".split())
#: Elements and names of classes, ids and roles that hold no main text.
FURNITURE = set("nav footer aside form button select textarea noscript template iframe svg dialog menu head title"
                " object canvas audio video".split())
NAMES = set("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary"
            " consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal nav"
            " navbar navigation newsletter notice notices notification pagination pager popup promo promoted related"
            " replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar"
            " widget".split())
ARTICLE = {"article", "main"}
HEADLINES = {"h1", "title"}
CHUNK = 256
#: Share of a host's distinct pages from which on a shared line is the site's.
HOST_SHARE = 0.5
#: Pages looked at on each side for one that is no copy, and words kept of a line.
REACH = 4
SKETCH = 6

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^>"'])*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[\s_-]+")


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", *ARTICLE):
        return False
    for m in _NAMED.finditer(attributes):
        parts = _PART.split((m[2] or m[3] or m[4] or "").lower())
        if NAMES.intersection(parts) or "header" in parts and not in_article and not name.startswith("h"):
            return True
    return False


def lines(html: str | None) -> list[tuple[str, int, str]]:
    """The page's text lines in order, each with 2 in an article, 1 in the open, 0 in furniture, and with the
    headline element (``h1`` or ``title``) that holds it, if one does."""
    out: list[tuple[str, int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, with the kind of lines in them
    kind, at, html = 1, 0, html or ""

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                out.append((line, kind, next((s[0] for s in stack if s[0] in HEADLINES), "")))

    def add(a: int, b: int) -> None:
        if a < b:
            part = html[a:b]
            text.append(unescape(part) if "&" in part else part)

    while m := _TAG.search(html, at):
        add(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][1] != kind or any(s[1] != kind for s in stack[i:]):
                        flush()
                    del stack[i:]
                    kind = stack[-1][1] if stack else 1
                    break
            continue
        if name in ("script", "style"):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li") and any(s[0] == name for s in stack):  # an open one ends here, if nothing holds it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
            kind = stack[-1][1] if stack else 1
        new = kind
        if kind and _is_furniture(name, m[3], kind == 2):
            new = 0
        elif kind == 1 and name in ARTICLE:
            new = 2
        if new != kind:
            flush()
        kind = new
        stack.append((name, kind))
    add(at, len(html))
    flush()
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = _rows(a, b)[-1] if a else (1 << len(b)) - 1
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[:len(b)].astype(np.int64))])


def _rows(a: list, b: list) -> list[int]:
    """Bit j of row i is zero if b[j] lengthens the common subsequence of a[:i + 1] with b[:j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    out = []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def common(a: list, b: list, most_bits: int = 1 << 28) -> list[tuple[int, int]]:
    """Places (in a, in b) of one longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    if x and y and len(x) * len(y) > most_bits and len(x) > 1:
        half = len(x) // 2
        split = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        out += [(head + i, head + j) for i, j in common(x[:half], y[:split], most_bits)]
        out += [(head + half + i, head + split + j) for i, j in common(x[half:], y[split:], most_bits)]
    elif x and y:
        rows, i, j, found = _rows(x, y), len(x), len(y), []
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> j - 1 & 1:
                    j -= 1
                    found.append((head + i, head + j))
        out += found[::-1]
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _main(found: list[tuple[str, int, str]]) -> list[int]:
    """The places of the main lines."""
    kept = 2 if any(kind == 2 for _, kind, _ in found) else 1
    return [i for i, (_, kind, _) in enumerate(found) if kind == kept]


def _headlines(found: list[tuple[str, int, str]]) -> list[int]:
    """The numbers of the main lines that are headlines."""
    titles = {t for t, _, name in found if name == "title"}
    return [k for k, i in enumerate(_main(found)) if found[i][2] == "h1" or found[i][0] in titles]


def _sketch(line: bytes) -> bytes:
    """The least hashes of the line's distinct words."""
    least = sorted(set(map(crc32, line.split())))[:SKETCH]
    return struct.pack(f"<{len(least)}I", *least)


def _keys(sketch: bytes) -> list[tuple]:
    """Two lines are rewordings of each other if they have one of these in common: half of the words kept."""
    least = struct.unpack(f"<{len(sketch) // 4}I", sketch)
    return list(combinations(least, max(1, len(least) // 2)))


def _hashed(pages: DataFrame) -> DataFrame:
    """(k1, k2, g1, g2, host, path, lines, main, words, heads): every line's hash, the places and word sketches of
    the main ones, the numbers of the headlines among them, and two hashes of host and main lines, alike for copies."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = lines(html)
                host, path = _place(url)
                texts = [t.encode("utf-8", "replace") for t, *_ in found]
                main = _main(found)
                group = "\n".join([host, *[found[i][0] for i in main]]).encode("utf-8", "replace")
                rows.append((k1, k2, *[xxhash.xxh64_intdigest(group, seed) - (1 << 63) for seed in (0, 1)], host, path,
                             [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], main, [_sketch(texts[i]) for i in main],
                             _headlines(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 10, kinds, strict=True)], names)

    names = ["k1", "k2", "g1", "g2", "host", "path", "lines", "main", "words", "heads"]
    numbers = pa.list_(pa.int64())
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), numbers, numbers, pa.list_(pa.binary()), numbers]
    return pages.select("k1", "k2", "url", "html").mapInArrow(
        run, "k1 long, k2 long, g1 long, g2 long, host string, path string, lines array<long>, main array<long>,"
             " words array<binary>, heads array<long>")


def _compared(a: dict, b: dict) -> tuple[list[int], list[int]] | None:
    """Which main lines of each page, by their number, are common to both; none for near copies."""
    same = common(a["lines"], b["lines"])
    shared, keys, own = [], [], []
    for side, page in enumerate((a, b)):
        both = {v[side] for v in same}
        shared.append([k for k, i in enumerate(page["main"]) if i in both])
        rest = [_keys(page["words"][k]) for k, i in enumerate(page["main"]) if i not in both]
        own.append(rest)
        keys.append({key for line in rest for key in line})
    for side, rest in enumerate(own):
        if 2 * sum(any(key in keys[1 - side] for key in line) for line in rest) > len(rest) or not rest:
            return None
    return shared[0], shared[1]


def _shared_with_nearest(rows: list[dict], i: int, seen: dict, reach: int) -> set[int]:
    """The line hashes that page ``i`` of a chunk shares with the nearest page on either side that is no copy."""
    page = rows[i]
    found: set[int] = set()
    for step in (-1, 1):
        for j in range(i + step, i + step * (reach + 1), step):
            if not 0 <= j < len(rows) or rows[j]["host"] != page["host"]:
                break
            pair = (min(i, j), max(i, j))
            if pair not in seen:
                seen[pair] = _compared(rows[pair[0]], rows[pair[1]])
            if seen[pair]:
                found.update(page["lines"][page["main"][k]] for k in seen[pair][i > j])
                break
    return found


def _site_lines(hashed: DataFrame, chunk: int, host_share: float) -> DataFrame:
    """(host, site): the hashes of a host's lines that its pages in general share.

    An array holds at most ``1 / host_share`` times the main lines of the host's mean page.
    """
    spark = hashed.sparkSession
    order = ["host", "path", "k1", "k2"]
    reach = min(REACH, chunk)
    first = hashed.groupBy("host", "g1", "g2").agg(
        F.min(F.struct("path", "k1", "k2", "lines", "main", "words")).alias("page")).select("host", "g1", "g2", "page.*")
    put = staged(
        first.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("part"),
            (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("at")), "ordered")
    # one row a partition: the number of pages in it
    sizes = sorted((r["part"], r["n"]) for r in put.groupBy("part").agg(F.count("*").alias("n")).collect())
    base, bases = 0, []
    for part, n in sizes:
        bases.append((part, base))
        base += n
    ranked = put.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn(
        "rank", F.col("base") + F.col("at"))
    own = F.floor(F.col("rank") / chunk)
    dealt = ranked.select(
        "host", "lines", "main", "words", "rank", own.alias("own"),
        F.explode(F.array_compact(F.array(
            own, F.when(F.col("rank") % chunk < reach, own - 1), F.when(F.col("rank") % chunk >= chunk - reach, own + 1))))
        .alias("chunk"))

    def solve(table: pa.Table) -> pa.Table:
        rows = table.sort_by("rank").to_pylist()
        seen: dict = {}
        out = [(r["host"], line) for i, r in enumerate(rows) if r["own"] == r["chunk"]
               for line in _shared_with_nearest(rows, i, seen, reach)]
        return pa.table([pa.array(c, t) for c, t in zip(
            list(zip(*out)) or [[]] * 2, [pa.string(), pa.int64()], strict=True)], names=["host", "line"])

    # written first, so that the join below knows its bytes: where they are few the pages' lines are not shuffled
    put_forward = staged(dealt.groupBy("chunk").applyInArrow(solve, "host string, line long").distinct(), "shared")
    held = put.select("host", F.explode(F.array_distinct(F.transform("main", lambda i: F.get("lines", i.cast("int")))))
                      .alias("line"))
    counted = held.join(broadcast_if_small(put_forward, 8 << 20), ["host", "line"], "left_semi").groupBy("host", "line").agg(
        F.count("*").alias("n"))
    pages = put.groupBy("host").agg(F.count("*").alias("pages"))
    return counted.join(pages, "host").where(F.col("n") >= host_share * F.col("pages")).groupBy("host").agg(
        F.collect_list("line").alias("site"))


def main_text(html: str | None, gone: set) -> str:
    """The main lines but those whose number is in ``gone``."""
    found = lines(html)
    return "\n".join(found[i][0] for k, i in enumerate(_main(found)) if k not in gone)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", chunk: int = CHUNK,
            host_share: float = HOST_SHARE) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of the html column.

    The text is the main lines (the article's; where a page has no article
    element, the open ones) but the site's: those that nearest pages share and
    ``host_share`` of the host's distinct pages hold, headlines never.  Null or empty html gives an empty text; a null or broken URL has
    the empty host.  Pages alike in URL and html count once in the order, and
    each gets its row; an empty table gives an empty result; columns that bear
    an added column's name give way.
    """
    carry = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html_col]
    x = renamed(pages, ["own"])
    html, url = F.col(f"`{html_col}`").cast("string"), F.col(f"`{url_col}`").cast("string")
    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias(x["own"]), url.alias("url"),
                         html.alias("html"), F.xxhash64(url, html).alias("k1"), F.xxhash64(F.lit(1), html, url).alias("k2"))
    hashed = staged(_hashed(named).dropDuplicates(["k1", "k2"]), "lines")
    site = staged(_site_lines(hashed, chunk, host_share), "site")
    number = F.sequence(F.lit(0), F.size("main") - 1)
    gone = F.filter(number, lambda k: F.array_contains("site", F.get("lines", F.get("main", k).cast("int")))
                    & ~F.array_contains("heads", k.cast("long")))
    gone = hashed.where(F.size("main") > 0).join(broadcast_if_small(site, 8 << 20), "host").select(
        "k1", "k2", gone.alias("gone")).where(F.size("gone") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, set(g or ())) for h, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                                               strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [x["own"], "text", "n_chars"])

    own = named.schema[x["own"]].dataType.simpleString()
    done = named.join(gone, ["k1", "k2"], "left").select(x["own"], "html", "gone").mapInArrow(
        run, f"`{x['own']}` {own}, text string, n_chars long")
    return done.select(f"{x['own']}.*", "text", "n_chars")


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
