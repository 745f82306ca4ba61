"""Main text of web pages.

Method: nearest-URL page differencing. Pages are ordered by URL path (and query) within each
host, and each is paired with the neighbour that has the longest common prefix with it.
The text lines of the two are aligned by a longest common subsequence, and lines that both
share are deleted: what a site repeats from page to page is its frame.

Three rules keep the result right. Lines inside an article or main element are never deleted,
for articles do quote each other. Other lines that markup does not mark as a frame stay
where the neighbour is another version of the same article: it shares more than four
fifths of the text inside the article, if there is one, and of all that is not marked as frame.
And what the neighbour lacks goes only where markup is explicit: menus, footers, adverts,
forms and the like that only this page has. Equal pages of a host count as one page, so a
copy is nobody's neighbour.

Pairs are made of small tables with a 64-bit hash per line. A host with a third of all
pages is spread over a third of the tasks; the pages move once, to meet their partner's
line hashes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from telelake.llm.rows import add_struct, fresh, store, struct_array, texts_of
from telelake.plans.running import with_running

CONTENT, FREE, FRAME = 2, 1, 0

# Elements and names by their role in a page.
RAW_ELEMENTS = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
FRAME_ELEMENTS = frozenset(
    "nav footer aside form button select svg canvas video audio object dialog menu fieldset".split()
)
CONTENT_ELEMENTS = frozenset("article main".split())
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table"
    " tbody tfoot thead title tr ul".split()
)
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
FRAME_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments"
    " commentlist reply replies respond disqus sidebar widget widgets related recommended recommendations share"
    " sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead topbar toolbar"
    " search skip".split()
)
# A wrapper that only tells of such a part is not that part.
WRAPPER_NAMES = frozenset("has with no without content main article body page wrapper container layout post".split())
# Inside an article a name made of words from both lists, one of them a frame word, is a frame.
COMPANION_NAMES = frozenset(
    "area bar bars block blocks box boxes button buttons count form group icon icons inner item items link links list lists"
    " media module panel posts section sections slot title unit units".split()
)
CONTENT_ROLES = frozenset("main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)(?:>|(?=<)|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_HEADING_NEXT = re.compile(r"(?:\s++|<!--.*?-->)*+<h[1-6]\b", re.S | re.I)
# A page is a copy if less than this part of its text is its own (one in COPY_PART).
COPY_PART = 5
# Two pages whose table of bits would be larger are halved first; the alignment is as long.
ALIGN_BITS = 1 << 28

RESULT = StructType(
    [
        StructField("text", StringType(), False),
        StructField("n_chars", LongType(), False),
        StructField("n_shared_lines", LongType(), False),
    ]
)
_LINES = StructType([StructField("hashes", ArrayType(LongType(), False), False)])


def _names_frame(token: str, inside: int) -> bool:
    """Whether a class or id names a frame. Inside an article the whole token has to."""
    parts = {p for p in _NAME_PARTS.split(token) if p}
    if not parts & FRAME_NAMES or parts & WRAPPER_NAMES:
        return False
    return inside != CONTENT or all(p in FRAME_NAMES or p in COMPANION_NAMES or p.isdigit() for p in parts)


def _role(name: str, raw: str, inside: int, headed: bool = False) -> int | None:
    """What an element makes of its text: FRAME, CONTENT or no change.

    Ids of headings and of sections that start with one (``headed``) are made of their words.
    """
    if name in FRAME_ELEMENTS or (name in ("header", "label") and inside != CONTENT):
        return FRAME
    found = CONTENT if name in CONTENT_ELEMENTS else None
    if raw and not raw.isspace() and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), entities.unescape("".join(values)).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return FRAME
            if key == "style" and "display:none" in value.replace(" ", ""):
                return FRAME
            if key == "role":
                if value in FRAME_ROLES:
                    return FRAME
                if value in CONTENT_ROLES:
                    found = CONTENT
            elif key == "itemprop" and value == "articlebody":
                found = CONTENT
            elif key == "class" and name != "main" or key == "id" and name != "main" and name not in HEADINGS and not headed:
                if any(_names_frame(one, inside) for one in value.split()):
                    return FRAME
    return found


def lines_of(page: str) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with its role.

    A block is a line; white space inside it becomes one space. Unclosed elements end
    where their parent ends, a paragraph or list item also where the next block begins.
    """
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    # Open elements that change the role or may hold one that does.
    stack: list[tuple[str, int]] = []
    role = held = FREE

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                lines.append((text, held))
            buffer.clear()

    def say(text: str) -> None:
        nonlocal held
        if text:
            # Inline parts of another role are lines of their own.
            if buffer and role != held:
                flush()
            held = role
            buffer.append(text)

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = max(found.end(), found.start() + 1)
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in RAW_ELEMENTS and not found[1]:
            if name == "title":
                flush()
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in BLOCK_ELEMENTS:
            flush()
            while stack and stack[-1][0] == "p" and name != "p" or (stack and not found[1] and stack[-1][0] == name and name in ("p", "li")):
                stack.pop()
        elif name in ("br", "td", "th"):
            say(" ")
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif name not in VOID_ELEMENTS and not found[3].endswith("/"):
            headed = name == "section" and bool(_HEADING_NEXT.match(page, at))
            made = _role(name, found[3], stack[-1][1] if stack else FREE, headed)
            if made is not None or name in BLOCK_ELEMENTS:
                before = stack[-1][1] if stack else FREE
                # Inside a frame everything is frame.
                stack.append((name, before if made is None or before == FRAME else made))
            elif any(n == name for n, _ in stack[-8:]):
                stack.append((name, stack[-1][1]))
        role = stack[-1][1] if stack else FREE
    flush()
    return lines


def line_hash(line: str) -> int:
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))
    return value - (1 << 64) if value >= 1 << 63 else value


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, in linear memory."""
    in_b, in_a = set(b), set(a)
    left = [i for i, x in enumerate(a) if x in in_b]
    pairs = _halved([a[i] for i in left], [x for x in b if x in in_a])
    return [left[i] for i, _ in pairs]


def _halved(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matches of an alignment; where the table is too large, ``a`` is halved and ``b`` cut where the lengths add up best."""
    if len(a) * len(b) <= ALIGN_BITS or len(a) < 2:
        return _align(a, b)
    half = len(a) // 2
    ahead = _lengths(a[:half], b)
    behind = _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int((ahead + behind).argmax())
    first = _halved(a[:half], b[:cut])
    return first + [(i + half, j + cut) for i, j in _halved(a[half:], b[cut:])]


def _places(b: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    return places


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``."""
    places, full = _places(b), (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    grows = np.unpackbits(bits, bitorder="little")[: len(b)] == 0
    return np.concatenate(([0], np.cumsum(grows)))


def _align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    places = _places(b)
    # Bit j of a row is 0 where the length grows with b[j].
    full = (1 << len(b)) - 1
    rows, row = [], full
    for x in a:
        hit = row & places[x] if x in places else 0
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    pairs, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        before = rows[i - 1] if i else full
        if rows[i] >> j & 1:
            # The length does not grow with b[j].
            j -= 1
        elif before >> j & 1:
            # It does, and only from this row on: a[i] and b[j] match.
            pairs.append((i, j))
            i, j = i - 1, j - 1
        else:
            i -= 1
    return pairs[::-1]


def _mostly(lines: list[tuple[str, int]], shared: list[int], roles: set[int]) -> bool:
    """Whether more than four fifths of the text of some roles is shared, as far as there is any."""
    body = sum(len(t) for t, role in lines if role in roles)
    common = sum(len(lines[i][0]) for i in shared if lines[i][1] in roles)
    return not body or COPY_PART * common > (COPY_PART - 1) * body


def main_text(page: str, partner: list[int] | None) -> tuple[str, int]:
    """Main text of a page, given the line hashes of its partner, and how many lines the differencing deletes."""
    lines = lines_of(page)
    deleted: set[int] = set()
    if partner:
        shared = common_subsequence([line_hash(t) for t, _ in lines], partner)
        version = all(_mostly(lines, shared, roles) for roles in ({CONTENT}, {CONTENT, FREE}))
        deleted = {i for i in shared if lines[i][1] == FRAME or (lines[i][1] == FREE and not version)}
    kept = [t for i, (t, role) in enumerate(lines) if role != FRAME and i not in deleted]
    return "\n".join(kept), len(deleted)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    """Path and query, without fragment and without the endings that name the same page."""
    whole = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)(\?[^#]*)?"
    path, query = F.regexp_extract(url, whole, 1), F.regexp_extract(url, whole, 2)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", ""), r"(?:\.html?|/)+$", "")
    return F.concat(path, F.when(query == "?", "").otherwise(query))


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two paths, in path segments and then characters."""
    first, second = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(first, second, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.array_position(same, False) - 1, F.size(first).cast("long"))


def partners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (host, path, hashes): each path of a host and the lines of its nearest neighbour."""
    source = pages.select(
        F.col(f"`{html}`").alias("html"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path")
    ).where("host <> ''")

    def make():
        def work(column: pa.Array) -> pa.StructArray:
            hashes = [[line_hash(t) for t, _ in lines_of(p)] for p in texts_of(column)]
            return struct_array(_LINES, pa.array(hashes, pa.list_(pa.field("element", pa.int64(), False))))

        return work

    hashed = add_struct(source, "lines", _LINES, ["html"], make).select("host", "path", "lines.hashes")
    # Of the versions of one path the same one is taken each time.
    one = hashed.groupBy("host", "path").agg(F.min("hashes").alias("hashes"))
    one = store(one.withColumn("digest", F.xxhash64("hashes")), "html-lines")
    # Equal pages of a host stand in order once, at the least of their paths.
    paths = one.groupBy("host", "digest").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("equal"))
    # Only paths are put in order; the lines join the chosen neighbour afterwards.
    with_last = with_running(paths, ["host"], [F.asc("path")], before={"last": F.col("path")})
    both = with_running(with_last, ["host"], [F.desc("path")], before={"next": F.col("path")})
    own, last, following = F.col("path"), F.col("last"), F.col("next")
    earlier = following.isNull() | (_common_prefix(own, last) >= _common_prefix(own, following))
    chosen = F.when(last.isNotNull() & earlier, last).otherwise(following).alias("near")
    near = store(both.select("host", "path", "digest", "equal", chosen), "html-near")
    # Copies share the neighbour of the page that stands for them.
    shared = near.where("equal > 1").select("host", "digest", F.col("path").alias("first"), "near")
    copies = one.select("host", "path", "digest").join(shared, ["host", "digest"]).where("path <> first")
    every = near.select("host", "path", "near").unionByName(copies.select("host", "path", "near"))
    lines = one.select("host", F.col("path").alias("near"), "hashes")
    return every.join(lines, ["host", "near"]).select("host", "path", "hashes")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) and ``out``: ``text``, ``n_chars``, ``n_shared_lines``.

    A null or empty page gives an empty text. A page without a URL, or alone on its host,
    has no partner, so only markup decides. Addresses that differ in scheme or fragment are
    one page, of which one version is compared with others. Ties between two neighbours go
    to the earlier path. Repeated rows give equal results and an empty table stays empty.
    """
    kept = [c for c in (pages.columns if columns is None else columns) if c.lower() != out.lower()]
    mark = fresh("html")
    near = partners(pages, url, html).toDF(f"{mark}_host", f"{mark}_path", f"{mark}_hashes")
    keyed = pages.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"`{html}`").alias(f"{mark}_html"),
        url_host(F.col(f"`{url}`")).alias(f"{mark}_host"),
        url_path(F.col(f"`{url}`")).alias(f"{mark}_path"),
    )
    joined = keyed.join(near, [f"{mark}_host", f"{mark}_path"], "left").select(
        *[F.col(f"`{c}`") for c in kept], f"{mark}_html", f"{mark}_hashes"
    )

    def make():
        def work(column: pa.Array, hashes: pa.Array) -> pa.StructArray:
            rows = [main_text(p, h) for p, h in zip(texts_of(column), hashes.to_pylist(), strict=True)]
            return struct_array(RESULT, [t for t, _ in rows], [len(t) for t, _ in rows], [n for _, n in rows])

        return work

    made = add_struct(joined, out, RESULT, [f"{mark}_html", f"{mark}_hashes"], make)
    return made.drop(f"{mark}_html", f"{mark}_hashes")
