"""Main text of web pages: structural rules and nearest-URL page differencing.

Each page is cut into blocks (lines of text between block tags).  Blocks in navigation, headers, footers, sidebars, forms,
scripts, styles, notices, adverts and reader comments (by tag, role, class or id) are marked as boilerplate; blocks in an
`article` or `main` element are marked as content.

For the blocks that are neither, pages are compared: pages of a host are ordered by URL path, and each is aligned with the
page before it or, if that one is a copy of it (COPY of its lines are shared), with the page after it.  Lines, as hashes, are
aligned by a longest common subsequence, and shared lines are deleted as template text; a page between two copies loses
none.  What is left of the undecided lines is text where the page has no `article` or `main`, or where it is longer than
what stands in them (a teaser); lines inside `article` or `main` are kept even if shared.

Null or empty html: empty text.  A null URL has no host and no partner.  Rows with one id are told apart by their html.
Very long pages: the alignment takes lines x lines / 64 steps and the square root of that in memory.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textblocks as tb
from lexloom.llm.shared import pick, settle

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW_TEXT = frozenset("script style textarea title template noscript iframe svg math object select".split())
DROPPED = frozenset("nav header footer aside form button menu dialog".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark boilerplate.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|promotion|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|header|masthead|share|sharing|social|related|recommended|comments?|disqus|respond|replies|login|signup|search|toolbar|complementary|contentinfo|alert|skip)(?:$|[\s_-])", re.I)
#: Start tags that end an open element of the kind.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CONTENT, UNDECIDED, BOILERPLATE = 2, 1, 0
#: Share of a page's undecided lines that make another page a copy of it.
COPY = 0.8


def blocks(page: str) -> list[tuple[int, str]]:
    """(CONTENT, UNDECIDED or BOILERPLATE, text) of the blocks of a page in order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with the mark that holds inside
    mark, parts, at = UNDECIDED, [], 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((mark, text))
        parts.clear()

    skip = ""
    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        if not skip:
            parts.append(page[at : token.start()])
        at = token.end()
        closing, name = token.group(1), (token.group(2) or "").lower()
        if not name:
            continue
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if name in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            mark = stack[-1][1] if stack else UNDECIDED
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            stack.pop()
        around = stack[-1][1] if stack else UNDECIDED
        inside = around
        if around != BOILERPLATE:
            found = dict((a.lower(), b or c or d) for a, b, c, d in ATTRIBUTE.findall(token.group(3)))
            said = " ".join(found.get(x, "") for x in ("class", "id", "role"))
            if name in DROPPED and not (name == "header" and around == CONTENT) or (said and name not in ("html", "body") and name not in MAIN and MARKS.search(said)):
                inside = BOILERPLATE
            elif name in MAIN or "main" in said.lower().split():
                inside = CONTENT
        stack.append((name, inside))
        mark = inside
    if not skip:
        parts.append(page[at:])
    flush()
    return out


def _steps(vector: int, masks: dict[int, int], lines: list[int], full: int) -> list[int]:
    """Bit vectors of the alignment after each further line: bit i is 0 where the i-th line of the other page makes the subsequence longer."""
    out = []
    for x in lines:
        hit = vector & masks[x]
        vector = ((vector + hit) | (vector - hit)) & full
        out.append(vector)
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in a of a longest common subsequence with b (bit-parallel; only every so many vectors are held, the others are made again)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    mine = [i for i in range(head, len(a) - tail) if a[i] in both]
    other = [x for x in b[head : len(b) - tail] if x in both]
    masks: dict[int, int] = {}
    for i, at in enumerate(mine):
        masks[a[at]] = masks.get(a[at], 0) | 1 << i
    full, stride = (1 << len(mine)) - 1, int(len(other) ** 0.5) + 1
    starts = [full]
    for lo in range(0, len(other), stride):
        starts.append(_steps(starts[-1], masks, other[lo : lo + stride], full)[-1])
    found, i = [], len(mine)
    for k in range(len(starts) - 2, -1, -1):
        rows = [starts[k], *_steps(starts[k], masks, other[k * stride : (k + 1) * stride], full)]
        j = len(rows) - 1
        while i and j:
            if rows[j] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - 1] >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append(mine[i])
    return [*range(head), *found[::-1], *range(len(a) - tail, len(a))]


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, url, text in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
            found = blocks(text.as_py() or "")
            free = [i for i, (m, _) in enumerate(found) if m == UNDECIDED]
            raw, cut = tb.utf8(pa.array([found[i][1] for i in free], pa.string()))
            rows.append((page, url, [m for m, _ in found], [t for _, t in found], tb.span_hashes(raw, cut[:-1], cut[1:]).view(np.int64)))
            if len(rows) == 256:
                yield _shredded(rows)
                rows = []
        if rows:
            yield _shredded(rows)


def _shredded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "marks", "texts", "lines"])


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range sorted by (host, path, key): each key with the key before it in its host; `head` marks the first row of a range."""
    last = None
    for batch in batches:
        rows = []
        for host, path, key, part in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key", "part")), strict=True):
            same = last is not None and last[0] == host
            rows.append((host, path, key, last[2] if same else None, part, last is None))
            last = (host, path, key)
        if rows:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "path", "key", "before", "part", "head"])


def neighbours(pages: DataFrame) -> DataFrame:
    """key, other, place: the pages before (0) and after (1) each page of its host by URL path.  pages: key, host, path.

    The order is cut into ranges, so a host of any size is spread; the ends of the ranges (two rows each) are then joined.
    """
    placed = settle(pages.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("part", F.spark_partition_id()).mapInArrow(_pair, "host string, path string, key long, before long, part int, head boolean"), "url-order")
    heads = placed.where("head").select("host", "key", "part").collect()  # a row a range
    tails = {r["part"]: r for r in placed.groupBy("part").agg(F.max(F.struct("host", "path", "key")).alias("t")).select("part", "t.host", "t.key").collect()}
    fixed, seen = [], None
    for r in sorted(heads, key=lambda r: r["part"]):
        if seen is not None and seen["host"] == r["host"]:
            fixed.append((r["key"], seen["key"]))
        seen = tails[r["part"]]
    joined = placed.join(F.broadcast(placed.sparkSession.createDataFrame(fixed, "key long, fix long")), "key", "left").select("host", "path", "key", F.coalesce("before", "fix").alias("other"))
    joined = settle(joined, "url-pairs")
    joined = joined.where("other IS NOT NULL")
    return joined.select("key", "other", F.lit(0).alias("place")).unionByName(joined.select(F.col("other").alias("key"), F.col("key").alias("other"), F.lit(1).alias("place")))


def template_lines(mine: list[int], others: list[list[int]]) -> set[int]:
    """Indices of the lines shared with the first other page that is no copy."""
    for theirs in others:
        shared = common_lines(mine, theirs)
        if len(shared) < COPY * len(mine):
            return set(shared)
    return set()


def kept_lines(marks: list[int], texts: list[str], shared: set[int]) -> list[str]:
    """Texts of content and, where they count, of undecided blocks that aren't shared (numbered among the undecided ones)."""
    free = -1
    main, rest, either = [], [], []
    for mark, text in zip(marks, texts, strict=True):
        free += mark == UNDECIDED
        if mark == CONTENT:
            main.append(text)
            either.append(text)
        elif mark == UNDECIDED and free not in shared:
            rest.append(text)
            either.append(text)
    return main if main and sum(map(len, main)) >= sum(map(len, rest)) else either


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for marks, blocks_, mine, others in zip(*(batch.column(c).to_pylist() for c in ("marks", "texts", "lines", "others")), strict=True):
            texts.append("\n".join(kept_lines(marks, blocks_, template_lines(mine, [o["lines"] for o in others or []]))))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    shredded = rows.mapInArrow(_shred, "page_id long, url string, marks array<int>, texts array<string>, lines array<bigint>")
    # pages are told apart by id, URL and lines; equal rows have equal partners
    shredded = shredded.withColumn("key", F.xxhash64("page_id", "url", "texts"))
    keyed = settle(shredded.select("key", "url", "lines"), "page-lines")  # hashes only; the texts are cut again below
    parts = F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]+)([^?#]*)", 1), F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]+)([^?#]*)", 2)
    urls = keyed.where("url IS NOT NULL").select("key", F.lower(parts[0]).alias("host"), parts[1].alias("path")).where("host <> ''").dropDuplicates(["key"])
    pairs = neighbours(urls)
    lines = keyed.where(F.size("lines") > 0).select(F.col("key").alias("other"), F.col("lines").alias("other_lines")).dropDuplicates(["other"])
    partner = pairs.dropDuplicates(["key", "place"]).join(lines, "other").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", F.col("other_lines").alias("lines")))).alias("others"))  # two at most
    out = shredded.join(partner, "key", "left").mapInArrow(_assemble, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
