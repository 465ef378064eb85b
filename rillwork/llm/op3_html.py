"""Main text of web pages: markup as a hint and a suffix array of each host.

A page is cut into blocks. Blocks inside an article element are its content, but for parts that are navigation, forms,
notices and the like by their tag, role, class or id; if a page has such an element, its text is these blocks whole, even
where other articles repeat them, and all else is left out. In pages without one, markup only hints: blocks of navigation,
headers, footers, asides, forms and scripts go, and so do blocks that are mostly links. No block goes for its length. If
nothing else is left, blocks that only a class or id puts out are what the page has to say. All other blocks the host's suffix array decides: substrings of MIN_TOKENS tokens or more that distinct pages repeat are
boilerplate, the tokens they cover go, and the unique runs stay.

The streams of a host are the tokens of all blocks outside articles, page by page. A host of any size is split: each task
concatenates the streams of its own pages, up to ARRAY_TOKENS at a time, and builds the suffix array of each host's part by
prefix doubling, with the common prefixes of neighbours (LCP). An interval of the array in which neighbours agree in
MIN_TOKENS tokens or more is a repeated substring; its number of distinct pages, under the hash of its first MIN_TOKENS
tokens, is all that leaves the task, and the parts of a host meet in one aggregation with map-side combine. A longer
substring that pages repeat is covered by such prefixes from its first token to its last, so what they cover are the long
substrings. Pages of a host that are copies as a whole are one page: all but one of them are left out before the arrays are
built, so the counts of the parts add up to the same however the rows are dealt.

Cases: null html is an empty page (text ''). Pages of an unreadable url share the host ''. Text copied in several articles
stays. Unclosed tags end with their parent. Rows with equal ids keep a row each, unless they are equal in id, url and html,
in which case they share a result. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, row_keys

MIN_TOKENS = 8
#: Distinct pages that repeat a substring, at least.
MIN_PAGES = 3
#: And their share of the host's pages, unless they are MANY_PAGES.
MIN_SHARE = 0.01
MANY_PAGES = 20
#: Tokens of a suffix array at most, but for a longer page.
ARRAY_TOKENS = 1 << 19
#: Share of characters in links from which on a block is a menu.
LINKED = 0.8
SALTS = 16

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas select".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A new element of the second kind ends an open one of the first.
ENDS = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: An element that ends with its parent when that closes; others of inline kind aren't tracked unless marked.
DROP_TAGS = frozenset("nav footer aside form head dialog menu button fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown footer form gdpr login masthead menu modal nav navbar navigation navi newsletter notice notices notification notifications overlay pager pagination paywall popup privacy promo promoted promotion related replies reply respond responses rail search share sharing sidebar sidenav signup skip skyscraper social sponsor sponsored subscribe subscription tagcloud teaser toast toolbar topbar tracking widget widgets".split())
HEADERS = frozenset(["header"])
MAIN, OPEN, OUT, ARTICLE, NAMED, AWAY = "main", "open", "out", "article", "named", "away"


def marks(tag: str, attributes: str) -> str:
    """What an element's tag and attributes say of it: OUT, NAMED (out, but only by its class or id), 'header', ARTICLE, MAIN or ''."""
    if tag in DROP_TAGS:
        return OUT
    found = "header" if tag == "header" else "article" if tag == "article" else MAIN if tag == "main" else ""
    if "=" not in attributes and "hidden" not in attributes:
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        if name == "role":
            if value.lower() in DROP_ROLES:
                return OUT
            found = found or {"main": MAIN, "article": "article"}.get(value.lower(), "")
        if name == "itemprop" and value.lower() == "articlebody":
            found = found or "article"
        if name in ("class", "id") and tag not in ("body", "html"):
            parts = {x.lower() for x in NAME_PART.findall(value)}
            if parts & DROP_NAMES:
                found = NAMED
            elif parts & HEADERS:
                found = found or "header"
    return found


class Page:
    """Blocks of a page in order: (kind, text, share of its characters in links). kind: ARTICLE, MAIN, OPEN, OUT or, for
    parts that only their class or id puts out, NAMED in an article and AWAY elsewhere."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, str, float]] = []
        self.pieces: list[str] = []
        self.linked = self.in_link = 0
        self.kind = OPEN
        stack: list[tuple[str, str]] = []
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if (m.start() if m else n) > at:
                self.text(source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    self.in_link = 0
                if tag in BLOCK:
                    self.end_block()
                self.close(stack, tag)
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = source.find(">", close.start()) + 1 or n if close else n
                continue
            if tag == "a":
                self.in_link = 1
            if tag in BLOCK:
                self.end_block()
                while stack and tag in ENDS.get(stack[-1][0], ()):
                    self.kind = stack.pop()[1]
            if tag in VOID:
                continue
            mark = marks(tag, m[3] or "")
            if tag in BLOCK or mark:
                if mark and tag not in BLOCK:
                    self.end_block()
                stack.append((tag, self.kind))
                self.kind = self.inner(mark)
        self.end_block()

    def inner(self, mark: str) -> str:
        """The kind inside an element of this mark."""
        if self.kind in (OUT, NAMED, AWAY) or mark == OUT:
            return OUT if mark == OUT else self.kind
        if mark == NAMED:
            return NAMED if self.kind == ARTICLE else AWAY
        if mark == "header":
            return OUT if self.kind == OPEN else self.kind
        return ARTICLE if mark == ARTICLE else MAIN if mark == MAIN and self.kind == OPEN else self.kind

    def close(self, stack: list[tuple[str, str]], tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                if tag not in BLOCK:
                    self.end_block()
                self.kind = stack[i][1]
                del stack[i:]
                return
            if tag not in BLOCK and stack[i][0] in BLOCK:
                return

    def text(self, piece: str) -> None:
        if "&" in piece:
            piece = entities.unescape(piece)
        self.pieces.append(piece)
        self.linked += self.in_link * len(piece.strip())

    def end_block(self) -> None:
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                text = " ".join(words)
                self.blocks.append((self.kind, text, self.linked / len(text)))
            self.pieces.clear()
        self.linked = 0


def zones(source: str) -> tuple[str | None, list[str], list[str], int]:
    """The text, if an article element settles it; the stream: the blocks outside of articles; of those, the ones that the
    suffix array decides; a hash of the whole page."""
    blocks = Page(source).blocks
    whole = signed(xxhash.xxh3_64_intdigest("\n".join(b[1] for b in blocks).encode("utf-8", "replace")))
    stream = [b[1] for b in blocks if b[0] not in (ARTICLE, NAMED)]
    inside = [b for b in blocks if b[0] in (ARTICLE, NAMED)]
    if inside:
        named = sum(len(b[1]) for b in inside if b[0] == NAMED)
        # A name that would put out most of an article doesn't mean what the list takes it for.
        own = [b[1] for b in inside if b[0] == ARTICLE or 2 * named > sum(len(x[1]) for x in inside)]
        return " ".join(own), stream, [], whole
    kind = MAIN if any(b[0] == MAIN for b in blocks) else OPEN
    out = [b[0] != kind or b[2] >= LINKED for b in blocks]
    left = [b[1] for b, gone in zip(blocks, out) if not gone] or [b[1] for b in blocks if b[0] == AWAY and b[2] < LINKED]
    return None if left else "", stream, left, whole


PARSED = "page_id {id}, url string, k1 long, k2 long, host string, text string, stream array<string>, open array<string>, whole long"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for b in batches:
        rows = [zones(t or "") for t in b.column("html").to_pylist()]
        text, stream, left, whole = zip(*rows) if rows else ((), (), (), ())
        made = (pa.array(text, pa.string()), pa.array(stream, strings), pa.array(left, strings), pa.array(whole, pa.int64()))
        given = ("page_id", "url", "k1", "k2", "host")
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), *made], names=[*given, "text", "stream", "open", "whole"])


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(tokens: list[str]) -> np.ndarray:
    known = {t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t in set(tokens)}
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, depth: int) -> np.ndarray:
    """A hash of each run of depth tokens, of their own hashes."""
    n = len(hashes) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(depth):
        out = out * FACTOR + hashes[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * FACTOR
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def suffix_array(ids: np.ndarray, longest: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of ids, compared in their first longest places, and the common prefix of each suffix with
    the one before it in this order (0 for the first). Prefix doubling; the ranks of all steps then give the prefixes."""
    n = len(ids)
    ranks, have = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while have < longest and len(ranks[-1]) and ranks[-1].max() < n - 1:
        later = np.concatenate((ranks[-1][have:], np.full(min(have, n), -1)))[:n]
        ranks.append(np.unique(ranks[-1] * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64))
        have *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, lcp = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < n) & (y < n)
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        lcp += same * (1 << k)
    return order, np.append(0, lcp)[:n]


def repeats(streams: list[list[str]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the concatenated streams of pages: the hash of each substring of depth tokens, how many pages hold it, and one
    of them. The intervals of the suffix array whose neighbours agree in depth tokens are the substrings' places."""
    texts = [" ".join(blocks).split() for blocks in streams]
    tokens = [t for own in texts for t in own]
    sizes = np.array([len(own) for own in texts], np.int64)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = token_hashes(tokens)
    # Each page ends with a token of its own, so that no common prefix goes beyond a page.
    ends = np.cumsum(sizes)
    ids = np.insert(np.unique(hashes, return_inverse=True)[1].astype(np.int64), ends, len(tokens) + np.arange(len(sizes)))
    page = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(ids))
    left = (ends + np.arange(len(sizes)))[page] - place  # tokens up to the page's end
    order, lcp = suffix_array(ids)
    starts = np.append(True, lcp[1:] < depth)
    interval = np.cumsum(starts) - 1
    whole = left[order] >= depth
    interval, order = interval[whole], order[whole]
    pairs = np.unique(interval * len(sizes) + page[order])
    found, pages = np.unique(pairs // len(sizes), return_counts=True)
    first = order[np.unique(interval, return_index=True)[1]]
    return window_hashes(np.insert(hashes, ends, 0), depth)[first], pages, page[first]


def _host_arrays(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, list[str]]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for host, pages in held.items():
                h, found, page = repeats(list(pages.values()), depth)
                wholes = np.array(list(pages), np.int64)
                # Whether a substring is on pages that differ shows in the least and the greatest of their hashes.
                least, most = (np.where(found > 1, f(wholes), wholes[page]) for f in (np.min, np.max))
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(h), pa.string()), *(pa.array(x, pa.int64()) for x in (h, found, least, most))], names=["host", "h", "n", "least", "most"])
            held.clear()

        for b in batches:
            for host, stream, whole in zip(*(b.column(c).to_pylist() for c in ("host", "stream", "whole"))):
                if stream and whole not in held.setdefault(host, {}):
                    held[host][whole] = stream
                    n += sum(x.count(" ") + 1 for x in stream)
                    if n > ARRAY_TOKENS:
                        yield from flush()
                        n = 0
        yield from flush()

    return run


def _windows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                own = [window_hashes(token_hashes(" ".join(blocks).split()), depth) for blocks in b.column("open").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                places = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0)
                hashes = np.concatenate(own) if own else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("k1", "k2", "host")), pa.array(places, pa.int32()), pa.array(hashes, pa.int64())], names=["k1", "k2", "host", "at", "h"])

    return run


def unique_runs(blocks: list[str], places: list[int], depth: int) -> tuple[str, int]:
    """The blocks' text without the tokens that the substrings at places cover, and the number of those."""
    tokens = " ".join(blocks).split()
    gone = {i for p in places for i in range(p, p + depth)}
    return " ".join(t for i, t in enumerate(tokens) if i not in gone), len(gone)


def _unique_runs(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [unique_runs(blocks, places or [], depth) for blocks, places in zip(b.column("open").to_pylist(), b.column("covered").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["page_id", "url", "text", "n_covered"])

    return run


def main_texts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_tokens: int = MIN_TOKENS,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    many_pages: int = MANY_PAGES,
) -> DataFrame:
    """A row for each page: page_id, url, text, n_covered (tokens that the host's suffix array took out; null where an
    article element settles the text). A substring of min_tokens tokens is boilerplate on a host where at least min_pages
    pages hold it, and min_share of the host's pages or many_pages."""
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^\w+://([^/?#:]+)", 1)), F.lit("")).alias("host")
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *row_keys(id_col, url_col, html_col), host, F.col(html_col).cast("string").alias("html"))
    parsed = materialise(given.mapInArrow(_parse, PARSED.format(id=kind)).withColumn("row", F.monotonically_increasing_id()))
    settled = parsed.filter("text is not null").select("page_id", "url", "text", F.lit(None).cast("long").alias("n_covered"))
    left = parsed.filter("text is null").select("page_id", "url", "k1", "k2", "host", "open")
    # Of a host's pages that are copies as a whole one counts; most pages have none, so only those that have are looked up.
    copies = parsed.groupBy("host", "whole").agg(F.count("*").alias("n"), F.min("row").alias("kept")).filter("n > 1").drop("n")
    again = materialise(parsed.select("host", "whole", "row").join(copies, ["host", "whole"]).filter("row <> kept").select("row"))
    distinct = parsed.join(again, "row", "left_anti")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n_host"))
    arrays = distinct.select("host", "stream", "whole").mapInArrow(_host_arrays(min_tokens), "host string, h long, n long, least long, most long")
    runs = arrays.groupBy("host", "h").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    often = runs.filter((F.col("n") >= min_pages) & (F.col("least") < F.col("most"))).join(hosts, "host")
    repeated = materialise(often.filter((F.col("n") >= F.col("n_host") * min_share) | (F.col("n") >= many_pages)).select("host", "h"))
    # A phrase may be on all pages of a hot host: both sides are dealt by a part of the page's key too.
    salted = repeated.select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    windows = left.select("k1", "k2", "host", "open").mapInArrow(_windows(min_tokens), "k1 long, k2 long, host string, at int, h long")
    hits = windows.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])
    covered = hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("covered"))
    decided = left.join(covered, ["k1", "k2"], "left").select("page_id", "url", "open", "covered")
    schema = f"page_id {kind}, url string, text string, n_covered long"
    return settled.unionByName(decided.mapInArrow(_unique_runs(min_tokens), schema))


def op3_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
