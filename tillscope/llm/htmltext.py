"""HTML extraction: pages are compared with their nearest URLs, and the lines they share go."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Memo, settled
from .urls import host_of, path_of

# Fixed values of HTML: how its markup is written, and which elements do what.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,65536}\"|'[^']{0,65536}')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav noscript ol optgroup option p plaintext pre script section "
    "select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: A start tag of the first ends an open element of the second kind, if that is the innermost block.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
            "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}}

# What is no main text by its markup: elements, roles, and words of class names and ids.
DROPPED = frozenset(
    "head nav footer aside form script style template noscript iframe object svg canvas audio video "
    "button select datalist dialog menu textarea".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
    "toolbar".split()
)
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe signup login comment comments disqus "
    "share sharing social related recommended promo toolbar pagination pager".split()
)
COMMENT_WORDS = frozenset(("comment", "comments", "reply"))
#: A class that begins so tells what the page has, not what the element is.
TELLING = ("has", "with", "no", "without", "is", "not")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PLAIN, BOILERPLATE, HEADER, ARTICLE, MAIN = range(5)
#: An article or main element inside one of these shows that it wasn't closed or is a frame.
OPENED_BY_ARTICLE = frozenset(("nav", "header", "form"))

#: Pages whose lines agree to this share of their text are copies and don't tell what is template.
COPY = 0.8
#: Lines of two pages are aligned by rows of bits in memory up to so many bits, else half by half.
MOST_BITS = 1 << 28
#: Up to so many bytes of deletions are handed to every executor, else they are joined by a shuffle.
MOST_BROADCAST = 8_000_000


def _kind(tag: str) -> int:
    """What a start tag, given as its name and attributes, opens."""
    name, _, attributes = tag.partition(" ")
    kind = {"article": ARTICLE, "main": MAIN, "header": HEADER}.get(name, PLAIN)
    if name in DROPPED:
        return BOILERPLATE
    if name in ("html", "body") or not attributes:
        return kind
    found = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    if hidden or (role in DROPPED_ROLES and kind != MAIN):
        return BOILERPLATE
    named = set()
    for label in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [w.lower() for w in WORD.findall(label)]
        if parts and parts[0] not in TELLING:
            named.update(parts)
    if kind in (ARTICLE, MAIN):
        return BOILERPLATE if kind == ARTICLE and named & COMMENT_WORDS else kind
    if role == "main":
        return MAIN
    if role == "article" or found.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if named & DROPPED_WORDS:
        return BOILERPLATE
    return HEADER if "header" in named else kind


_KINDS = Memo(_kind, most=50_000, longest=512)
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW_TEXT}


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """(text, wanted, safe) of every block with text, in page order.

    wanted: no boilerplate by its markup, and inside the main element where the page has one, else
    inside its articles where it has some. safe: inside an article. Markup that isn't closed ends
    with the elements around it; the rest of a page cut inside a tag is taken for a tag.
    """
    lines: list[tuple[str, bool, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that can hold blocks, or are boilerplate
    open_names: dict[str, int] = {}
    dropped = articles = mains = 0
    any_article = any_main = False

    def close():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, not dropped, articles, mains))

    def enter(name, kind):
        nonlocal dropped, articles, mains
        stack.append((name, kind))
        open_names[name] = open_names.get(name, 0) + 1
        dropped += kind == BOILERPLATE
        articles += kind == ARTICLE
        mains += kind == MAIN

    def leave():
        nonlocal dropped, articles, mains
        name, kind = stack.pop()
        open_names[name] -= 1
        dropped -= kind == BOILERPLATE
        articles -= kind == ARTICLE
        mains -= kind == MAIN

    at, size = 0, len(html)
    while at < size:
        match = MARKUP.search(html, at)
        if match is None:
            parts.append(html[at:])
            break
        if match.start() > at:
            parts.append(html[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if name is None:
            continue
        name, ending = name.lower(), match[1] or match[4]
        is_block = name in BLOCKS
        if ending:
            if is_block:
                close()
            if open_names.get(name):
                if not is_block and stack[-1][0] != name:
                    continue  # an inline element doesn't end the blocks inside it
                while True:
                    left = stack[-1][0]
                    leave()
                    if left == name:
                        break
            continue
        attributes = match[3] if match[2] else match[6]
        kind = _KINDS[f"{name} {attributes}" if attributes else name]
        if is_block:
            close()
            ends = ENDED_BY.get(name, ())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in ends):
                leave()
        if kind == HEADER:
            kind = PLAIN if articles or mains else BOILERPLATE
        if kind in (ARTICLE, MAIN):
            # Nothing but an open menu, header or form around it: those end here.
            around = [n for n, k in stack if k == BOILERPLATE]
            if around and all(n in OPENED_BY_ARTICLE for n in around):
                while dropped:
                    leave()
            if not dropped:
                any_article |= kind == ARTICLE
                any_main |= kind == MAIN
        if name in RAW_TEXT:
            end = _CLOSERS[name].search(html, at)
            at = end.end() if end else size
        elif name not in VOID and (is_block or kind != PLAIN):
            enter(name, kind)
    close()
    return [
        (text, wanted and bool(mains if any_main else articles or not any_article), bool(articles))
        for text, wanted, articles, mains in lines
    ]


def _bits(a: list[int], b: list[int], rows: list[int] | None = None) -> int:
    """Row by row of the table of longest common subsequences, a bit for each item of b.

    A zero bit says that the subsequence grows by one at that item; all rows go to `rows`.
    """
    places: dict[int, int] = {}
    for j, item in enumerate(b):
        places[item] = places.get(item, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for item in a:
        grown = row & places.get(item, 0)
        row = (row + grown | row - grown) & full
        if rows is not None:
            rows.append(row)
    return row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and every prefix of b."""
    row = np.frombuffer(_bits(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    grows = 1 - np.unpackbits(row, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(grows)])


def aligned(a: list[int], b: list[int], most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """The pairs of places of one longest common subsequence of a and b.

    Equal ends are paired first, and items without an equal one on the other side left out. What
    remains is one row of bits per item of a; beyond `most_bits`, a is halved and b is cut where
    both halves together are longest, so that memory stays bounded for any two pages.
    """
    pairs = []
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        pairs.append((start, start))
        start += 1
    stop_a, stop_b = len(a), len(b)
    while stop_a > start and stop_b > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
        pairs.append((stop_a, stop_b))
    common = set(a[start:stop_a]) & set(b[start:stop_b])
    if common:
        at_a = [i for i in range(start, stop_a) if a[i] in common]
        at_b = [j for j in range(start, stop_b) if b[j] in common]
        left = _aligned([a[i] for i in at_a], [b[j] for j in at_b], most_bits)
        pairs += [(at_a[i], at_b[j]) for i, j in left]
    return sorted(pairs)


def _aligned(a: list[int], b: list[int], most_bits: int) -> list[tuple[int, int]]:
    if len(a) > 1 and len(a) * len(b) > most_bits:
        half = len(a) // 2
        tail = _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(_lengths(a[:half], b) + tail))
        return aligned(a[:half], b[:cut], most_bits) + [
            (half + i, cut + j) for i, j in aligned(a[half:], b[cut:], most_bits)
        ]
    rows: list[int] = []
    _bits(a, b, rows)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            pairs.append((i, j))
    return pairs


class Page:
    """The lines of a page as numbers: digests, code points, and what its markup says of each."""

    def __init__(self, digests: bytes, chars: bytes, flags: bytes):
        self.lines = np.frombuffer(digests, np.uint64).tolist()
        self.chars = np.frombuffer(chars, np.int32)
        flags = np.frombuffer(flags, np.uint8)
        self.wanted = flags & 1 > 0
        self.safe = flags & 2 > 0
        self.size = int(self.chars[self.wanted].sum())


def shared_lines(a: Page, b: Page) -> tuple[list[int], list[int]]:
    """The places on either page of the lines that are template: shared, and not in an article.

    Pages that share COPY of their wanted text are copies and tell nothing.
    """
    pairs = aligned(a.lines, b.lines)
    both = [(i, j) for i, j in pairs if a.wanted[i] and b.wanted[j]]
    if sum(int(a.chars[i]) for i, _ in both) >= COPY * max(a.size, b.size):
        return [], []
    return (
        [i for i, _ in pairs if a.wanted[i] and not a.safe[i]],
        [j for _, j in pairs if b.wanted[j] and not b.safe[j]],
    )


_PAGE = [("digests", pa.binary()), ("chars", pa.binary()), ("flags", pa.binary())]
_FOUND = pa.schema(
    [("side", pa.int32()), ("part", pa.int32()), ("host", pa.string()), ("content", pa.binary()),
     ("places", pa.binary()), *_PAGE]
)
_FOUND_SQL = (
    "side int, part int, host string, content binary, places binary, digests binary, chars binary, "
    "flags binary"
)
DELETED, FIRST, LAST = range(3)


def _numbers(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """HTML to the numbers that `Page` takes."""
    for htmls in texts:
        columns: list[list[bytes]] = [[], [], []]
        for html in htmls.to_pylist():
            lines = lines_of(html)
            digests = [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) for text, _, _ in lines]
            columns[0].append(np.array(digests, np.uint64).tobytes())
            columns[1].append(np.array([len(text) for text, _, _ in lines], np.int32).tobytes())
            columns[2].append(bytes(wanted | safe << 1 for _, wanted, safe in lines))
        arrays = [pa.array(c, pa.binary()) for c in columns]
        yield pa.StructArray.from_arrays(arrays, [name for name, _ in _PAGE])


def _deleted(side_a: tuple, side_b: tuple) -> Iterator[tuple]:
    """Rows of _FOUND for two neighbours, each (host, content, digests, chars, flags)."""
    if side_a[0] and side_a[0] == side_b[0]:
        for side, places in zip((side_a, side_b), shared_lines(Page(*side_a[2:]), Page(*side_b[2:]))):
            if places:
                yield (DELETED, 0, *side[:2], np.array(places, np.int32).tobytes(), None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_FOUND)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each page of a sorted partition with the next one; hands on the two at its ends."""
    before = part = None
    for batch in batches:
        rows: list[tuple] = []
        for part, *page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if before is None:
                rows.append((FIRST, part, *page[:2], None, *page[2:]))
            else:
                rows += _deleted(before, page)
            before = page
        yield _batch(rows)
    if before is not None:
        yield _batch([(LAST, part, *before[:2], None, *before[2:])])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the last page of a partition with the first one of the next."""
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
        yield _batch([found for row in rows for found in _deleted(row[:5], row[5:])])


def template_lines(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, content, places): the lines that pages share with those of the nearest URLs.

    Pages are sorted by host and path, which puts the paths of the longest common beginning side
    by side, and each is compared with the one before and the one after it on its host. Pages of
    one host with the same HTML are compared once, as one page. Only digests of lines move. A host
    may hold any share of the pages: the sort splits it, and where a partition ends its last page
    is compared with the first one of the next. Pages without a host are not compared.
    """
    whole = F.coalesce(F.col(html), F.lit(""))
    numbers = F.arrow_udf(
        _numbers, "digests binary, chars binary, flags binary", F.ArrowUDFType.SCALAR_ITER
    ).asNondeterministic()
    placed = pages.select(
        F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"),
        F.unhex(F.md5(whole)).alias("content"),
        numbers(whole).alias("page"),
    )
    single = placed.groupBy("host", "content").agg(F.min("path").alias("path"), F.first("page").alias("page"))
    order = ("host", "path", "content")
    ordered = single.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id().alias("part")
    page = [F.col(f"page.{name}").alias(name) for name, _ in _PAGE]
    found = settled(ordered.select(part, "host", "content", *page).mapInArrow(_neighbours, _FOUND_SQL))
    # One row per partition that holds pages, numbered without gaps.
    number = F.row_number().over(W.orderBy("part"))
    names = ["host", "content", *[name for name, _ in _PAGE]]
    first = found.where(F.col("side") == FIRST).withColumn("seam", number - 1)
    last = found.where(F.col("side") == LAST).withColumn("seam", number)
    seams = last.select("seam", *[F.col(c).alias(f"a_{c}") for c in names]).join(
        first.select("seam", *[F.col(c).alias(f"b_{c}") for c in names]), "seam"
    )
    at_seams = seams.drop("seam").mapInArrow(_seams, _FOUND_SQL)
    inside = found.where(F.col("side") == DELETED)
    both = inside.unionByName(at_seams).groupBy("host", "content")
    return both.agg(F.collect_list("places").alias("places"))


def _texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for htmls, deletions in batches:
        texts = []
        for html, places in zip(htmls.to_pylist(), deletions.to_pylist(), strict=True):
            gone = {i for part in places or () for i in np.frombuffer(part, np.int32).tolist()}
            lines = enumerate(lines_of(html))
            texts.append(" ".join(text for i, (text, wanted, _) in lines if wanted and i not in gone))
        yield pa.array(texts, pa.string())


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds text and n_chars to every page: its main text, and that text's code points.

    A page is taken apart into lines, one for each block of its markup, with character references
    decoded and white space turned into one space. Lines go that a menu, header, footer, sidebar,
    notice, advert, form or reader comment holds by its markup, that stand outside the main element
    (or the articles, where there is no main element), or that the page shares with one of the
    nearest URLs of its host (see `template_lines`). A shared line inside an article stays: it is a
    passage or a copy, not a template. The other lines are joined by one space.

    Null html counts as empty and gives an empty text. A null url, or one without a host, is not
    compared. Repeated rows and ties get the same text. Input columns called text or n_chars are
    replaced, all others stay; an empty table gives an empty one. Two pages of many thousand equal
    lines are aligned in bounded memory.
    """
    deleted = settled(template_lines(pages, url, html))
    size = F.aggregate("places", F.lit(64).cast("bigint"), lambda n, p: n + F.octet_length(p))
    total = deleted.agg(F.sum(size + F.length("host"))).first()[0] or 0
    if total <= MOST_BROADCAST:
        deleted = F.broadcast(deleted)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html.lower())]
    whole = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"),
        F.col(html).alias("html"),
        F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.unhex(F.md5(whole)).alias("content"),
    )
    texts = F.arrow_udf(_texts, "string", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    joined = keyed.join(deleted, ["host", "content"], "left")
    done = joined.select("row", "html", texts(F.coalesce("html", F.lit("")), "places").alias("text"))
    carried = [
        F.col("html").alias(c) if c.lower() == html.lower() else F.col("row").getField(c).alias(c)
        for c in pages.columns
        if c.lower() not in ("text", "n_chars")
    ]
    return done.select(*carried, "text", F.length("text").cast("bigint").alias("n_chars"))
