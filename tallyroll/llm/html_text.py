"""Main text of web pages, without what the site repeats on its pages.

1. Each page is parsed once.  Text is gathered in blocks; what is never article text (by tag, role,
   class or id) is left out, as on many sites it differs from page to page and no count can find
   it.  If the page has an ``article`` or ``main`` element, only blocks inside count.
2. Every container element is hashed with all its subtree, and with ``every_block`` so are
   paragraphs, headings, list items and quotations outside ``article`` and ``main``: a sentence that
   many articles hold inside their article element is text of theirs, a container there is not.
   The hashes are counted per host in Spark; of pages with equal text one is counted, so that
   copies of a page count as one.
3. A subtree that recurs on at least ``min_pages`` of these and a share of ``min_share`` of the
   host's, or on ``sure_pages`` whatever their share, is site template; the blocks inside it are
   deleted.  What holds a page's whole text is none on that page.

An element is its hash and the range of blocks inside it, so deep nesting costs no more than flat
pages.  The counts are pre-aggregated; which elements of which page go is written, so that Spark
joins it by page without moving texts unless it is large; a host with a third of all pages is no
hot key.

Nulls: null html gives an empty text; a null url, or one without a host, belongs to host ``""``
and has no template.  Broken markup is read as far as it goes; long pages are read whole.
Repeated rows give repeated results; empty tables give empty ones; other columns are not returned.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .urls import host_of

MIN_PAGES = 5
MIN_SHARE = 0.3
#: On so many pages a subtree is template, however many pages the host has.
SURE_PAGES = 50

#: Pages that are parsed at once.
BATCH = 500

#: Never shown as text.
UNSEEN = frozenset("script style noscript template head title form".split())
DROP_TAGS = frozenset(
    "nav footer aside form script style noscript template head title iframe object svg math canvas button select"
    " option textarea menu dialog audio video input".split()
)
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo banner menu nav navbar navigation breadcrumb breadcrumbs"
    " sidebar cookie cookies consent notice notices comment comments disqus reply replies share sharing social related"
    " newsletter subscribe popup modal footer".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li div section article main body html header footer aside nav blockquote pre tr table thead tbody"
    " tfoot ul ol dl dt dd figure figcaption address form fieldset hr details summary caption center".split()
)
CONTAINERS = frozenset("div section ul ol dl table header footer aside nav figure details form span center".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("html body tr thead tbody tfoot caption dt dd figcaption summary".split())
#: A start tag ends an open element of these names, up to the nearest of the second.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _dropped(tag: str, attrs: str) -> bool:
    if tag in DROP_TAGS:
        return True
    if not attrs or attrs.isspace():
        return False
    for name, *values in ATTR.findall(attrs):
        words = re.split(r"[^a-z0-9]+", "".join(values).lower())
        name = name.lower()
        if name == "role" and DROP_ROLES.intersection(words):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and DROP_WORDS.intersection(words):
            return tag != "article" or bool({"comment", "comments", "reply"}.intersection(words))
    return False


class _Open:
    __slots__ = ("tag", "drop", "main", "first", "parts")

    def __init__(self, tag, drop, main, first, label):
        self.tag, self.drop, self.main, self.first, self.parts = tag, drop, main, first, [label]


def parse(page: str, hashed: frozenset[str] = CONTAINERS, lists: bool = True) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The text blocks, and (hash, first block, block after the last) of every element in ``hashed`` that has some but not all of them.

    Without ``lists`` only what is never shown as text is left out.
    """
    stack = [_Open("", False, False, 0, "")]
    open_: Counter[str] = Counter()
    blocks: list[tuple[str, bool]] = []  # text, inside article or main
    ranges: list[tuple[int, int, int]] = []
    text: list[str] = []
    seen_main, at, low = False, 0, None

    def flush():
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                blocks.append((line, stack[-1].main))

    def close(depth):
        while len(stack) > depth:
            node = stack[-1]
            if node.tag in BLOCKS:
                flush()
            stack.pop()
            open_[node.tag] -= 1
            mark = xxhash.xxh64_intdigest("\0".join(node.parts).encode("utf-8", "replace"))
            stack[-1].parts.append(f"{mark:x}")
            if node.tag in hashed and len(blocks) > node.first and not (node.main and node.tag in LEAVES):
                ranges.append((mark - (1 << 63), node.first, len(blocks)))

    def words(piece):
        if piece:
            node = stack[-1]
            node.parts.append(" ".join(piece.split()))
            if not node.drop:
                text.append(piece)

    def nearest(tags, until=frozenset()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                return 0
            if stack[i].tag in tags:
                return i
        return 0

    while True:
        m = TAG.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_[tag] > 0:
                close(nearest((tag,)))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            while open_["p"] > 0:
                close(nearest(("p",)))
        elif tag in ENDS:
            which, until = ENDS[tag]
            if any(open_[x] > 0 for x in which) and (depth := nearest(which, until)):
                close(depth)
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th", "img"):
            words(" ")
        if tag in VOID:
            continue
        top = stack[-1]
        if lists:
            drop = top.drop or _dropped(tag, m[3]) or (tag == "header" and not top.main)
            main = top.main or (not drop and (tag in ("article", "main") or "main" in m[3] and bool(re.search(r"""role\s*=\s*["']?main""", m[3]))))
        else:
            drop, main = top.drop or tag in UNSEEN, False
        seen_main = seen_main or main
        open_[tag] += 1
        stack.append(_Open(tag, drop, main, len(blocks), " ".join(["<" + tag, *(v for a in ATTR.findall(m[3]) for v in a)]) if m[3] else "<" + tag))
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find("</" + tag, at) if len(low) == len(page) else (lambda x: x.start() if x else -1)(re.compile("</" + tag, re.I).search(page, at))
            at = len(page) if end < 0 else end
    flush()
    close(1)
    place = [0]  # of each block, how many before it are kept
    for _, inside in blocks:
        place.append(place[-1] + (inside or not seen_main))
    kept = [line for line, inside in blocks if inside or not seen_main]
    ranges = [(mark, place[a], place[b]) for mark, a, b in ranges]
    return kept, [r for r in ranges if r[1] < r[2] and r[2] - r[1] < len(kept)]


PARSED = "page_id {0}, url string, host string, key long, content long, blocks array<string>, marks array<long>, lo array<int>, hi array<int>"


def extract(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    url: str = "url",
    page: str = "html",
    page_id: str = "page_id",
    every_block: bool = False,
    sure_pages: int = SURE_PAGES,
    lists: bool = True,
) -> DataFrame:
    """page_id, url, host and text of each page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    hashed = CONTAINERS | LEAVES if every_block else CONTAINERS
    digest = lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
    names = ["page_id", "url", "host", "key", "content", "blocks", "marks", "lo", "hi"]

    def read(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                parsed = [parse(x or "", hashed, lists) for x in b.column("html").to_pylist()]
                keys = [digest(repr(k)) for k in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")))]
                part = lambda k, kind, parsed=parsed: pa.array([[r[k] for r in ranges] for _, ranges in parsed], pa.list_(kind))
                columns = [
                    *b.columns[:3],
                    pa.array(keys, pa.int64()),
                    pa.array([digest("\n\n".join(blocks)) for blocks, _ in parsed], pa.int64()),
                    pa.array([blocks for blocks, _ in parsed], pa.list_(pa.string())),
                    part(0, pa.int64()),
                    part(1, pa.int32()),
                    part(2, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    parsed = written(rows.mapInArrow(read, PARSED.format(rows.schema["page_id"].dataType.simpleString())), "html-blocks")
    result = ["page_id", "url", "host", F.array_join("blocks", "\n\n").alias("text")]
    hosted = parsed.where(F.col("host") != "")
    once = hosted.groupBy("host", "content").agg(F.min("marks").alias("marks"))
    pages_of = hosted.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = once.select("host", F.explode(F.array_distinct("marks")).alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    often = F.col("n") >= F.least(min_share * F.col("pages"), F.lit(float(sure_pages)))
    template = written(counts.where(F.col("n") >= min_pages).join(pages_of, "host").where(often).select("host", "mark"), "html-templates")
    asked = hosted.where(F.size("marks") > 0).select("key", "host", F.explode(F.array_distinct("marks")).alias("mark")).distinct()
    hits = written(asked.join(template, ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("hits")), "html-hits")
    gone = F.filter(F.arrays_zip("marks", "lo", "hi"), lambda z: F.array_contains("hits", z["marks"]))
    cut = parsed.join(hits, "key", "left").withColumn("gone", F.when(F.col("hits").isNotNull(), gone))
    left = F.filter("blocks", lambda b, i: ~F.exists("gone", lambda z: (z["lo"] <= i) & (i < z["hi"])))
    return cut.withColumn("blocks", F.when(F.col("hits").isNull(), F.col("blocks")).otherwise(left)).select(*result)
