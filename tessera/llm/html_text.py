"""Main text of HTML pages: nearest-URL page differencing, checked against the article where a page marks one up.

Each page is read once into lines (blocks of text). A line is chrome (menus, headers, footers, sidebars, notices,
adverts, forms, comments, by element, role or class name), part of an article, or undecided. Pages of one site that
are near each other by URL share their template, so pages are paired with the nearest URL of their host, lines are
aligned by a longest common subsequence, and lines that both pages have are deleted. This is done to all pages. Where
a page marks its article up, the mark is an exact check of the outcome: lines of the article that the neighbour repeats
are restored, since a quotation or licence in an article belongs to its text, and lines left outside of it go.

Neighbours are found by one range partitioning on (host, path): a host with most pages is spread over many tasks,
and each page meets only the lines of the pages before and after it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ENDS_OF_TAG = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
_RAW = frozenset("script style title noscript iframe xmp noframes textarea template svg".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
#: A value without quotes takes a closing slash for its own.
_UNQUOTED_END = re.compile(r"""=\s*[^\s"'>]*/$""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACES = frozenset("br td th wbr img".split())
_CHROME_TAGS = frozenset("nav footer aside form header button select dialog menu label datalist object audio video canvas".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CHROME_NAMES = frozenset(
    "ad ads adv adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets share sharing social related recommended recommendations newsletter subscribe subscription signup login comment comments commentlist discussion disqus feedback reply replies respond responses form search pagination pager skip toolbar".split()
)
_CONTENT_NAMES = frozenset("article post entry content main story title headline body text".split())
_COMMENT_NAMES = frozenset("comment comments commentlist discussion feedback reply replies respond responses disqus ad ads advert advertisement sponsored promo related".split())
#: Whole class names (or ids of containers) that mean chrome inside an article too; parts of names don't count there.
_INNER_NAMES = frozenset(
    "ad ads advert adverts advertisement adsbygoogle ad-container ad-slot ad-wrapper comment comments commentlist comment-list comments-area comments-section comment-section disqus_thread share sharing share-buttons share-links social-share social-sharing social-links sharedaddy related-posts related-articles related-links newsletter newsletter-signup cookie-notice cookie-banner breadcrumb breadcrumbs navbar sidebar pagination skip-link".split()
)
_ID_IS_SLUG = frozenset("h1 h2 h3 h4 h5 h6 p section".split())


def _chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _CHROME_TAGS and not (tag == "header" and in_article):
        return True
    if not attributes.strip(" /") or tag in ("html", "body", "main"):
        return False
    values = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "").lower()):
        return True
    if values.get("role", "").lower() in _CHROME_ROLES:
        return True
    if in_article or tag == "article" or tag not in _BLOCKS:  # an inline element's words are part of its block
        whole = set(values.get("class", "").lower().split())
        return bool((whole if tag in _ID_IS_SLUG else whole | {values.get("id", "").strip().lower()}) & _INNER_NAMES)
    names = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{values.get('class', '')} {values.get('id', '')}").lower()))
    if names & _CONTENT_NAMES:
        return bool(names & _COMMENT_NAMES)
    return bool(names & _CHROME_NAMES)


def _tag_ends(page: str, start: int) -> tuple[list[int], list[int]]:
    """For each quote or > from ``start`` on, where a tag ends whose rest it is the first of (-1: nowhere).

    One walk from the end, for pages in which a tag with an open quote runs on to the end of the page.
    """
    marks = [m.start() for m in _ENDS_OF_TAG.finditer(page, start)]
    ends, following = [-1] * (len(marks) + 1), {'"': len(marks), "'": len(marks)}
    for i in range(len(marks) - 1, -1, -1):
        mark = page[marks[i]]
        if mark == ">":
            ends[i] = marks[i]
        else:
            close = following[mark]
            ends[i] = ends[close + 1] if close < len(marks) else -1
            following[mark] = i
    return marks, ends


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(slash, tag, attributes, place) of each tag and ("", "", text, place) of what lies between; comments are left out.

    The place is where the token ends; a caller may send back a later one to go on from. A tag ends at the first > outside of quotes,
    and where quotes are never closed, at the first > of all. Time is linear in the page.
    """
    at, known = 0, None
    while at < len(page):
        m = _OPEN.search(page, at)
        if m is None or (m[2] is None and m[0] in ("<!", "<?") or m[2]) and (plain_end := page.find(">", m.end())) < 0:
            yield "", "", page[at:], len(page)
            return
        if m.start() > at:
            yield "", "", page[at : m.start()], m.start()
        if m[2] is None:
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0])
            stop = plain_end if mark is None else page.find(mark, m.end())
            at = len(page) if stop < 0 else stop + len(mark or ">")
            if m[0] == "<![CDATA[":
                yield "", "", page[m.end() : len(page) if stop < 0 else stop].replace("&", "&amp;"), at
            continue
        if known is None and (rest := _REST.match(page, m.end())):
            end = rest.end() - 1
        else:
            known = known or _tag_ends(page, m.end())
            end = known[1][bisect_left(known[0], m.end())]
        end = plain_end if end < 0 else end
        at = end + 1
        at = (yield m[1], m[2].lower(), page[m.end() : end], at) or at


def _open_line(open_tags: list[tuple[str, str]], tag: str) -> int | None:
    """The open p (or li) that a new one ends: the innermost, unless another block lies in between."""
    for i in range(len(open_tags) - 1, -1, -1):
        if open_tags[i][0] == tag:
            return i
        if open_tags[i][0] in _BLOCKS:
            return None
    return None


def _self_closed(tag: str, attributes: str) -> bool:
    """Whether an element ends in its own tag. HTML knows none but foreign ones, but pages write others that way too; those
    whose content is no markup never do."""
    return attributes.endswith("/") and (tag not in _RAW or tag == "svg") and not _UNQUOTED_END.search(attributes)


class _Ends:
    """Whether open elements are closed further on in a page, by counts of the tags of their name."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def closes(self, tag: str, at: int, depth: int) -> bool:
        """Whether the ``depth`` innermost open elements of a name all end after ``at``."""
        if tag not in self.known:
            name = re.escape(tag)
            self.known[tag] = [[m.start() for m in re.finditer(f"<{slash}{name}[\\s/>]", self.page, re.I)] for slash in ("/", "")]
        ends, begins = (len(x) - bisect_left(x, at) for x in self.known[tag])
        return ends - begins >= depth


def lines(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks in order, as ``_read`` has them.

    An article in chrome that ends further on, a teaser in a sidebar or a comment, say, is chrome. Only where this leaves a page
    that has articles without any, ends of chrome are not trusted, and an article in chrome is one.
    """
    out = _read(page, True)
    marked = any(k in ("article", "main") for k, _ in out)
    return out if marked or not (_ARTICLE.search(page) or _MAIN.search(page)) else _read(page, False)


def _read(page: str, trusted: bool) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks in order; kind is chrome, article, main or other.

    Character references are decoded, white space becomes one space, blocks without text are left out. A p ends where
    the next block begins and an li where the next li does. Any other element that never ends stops at the next
    article or main, or where an element around it ends; chrome that is ``trusted`` to end goes on over an article. Chrome
    inside a line, an advert or a button, say, is taken out of the line, which goes on after it.
    """
    out: list[tuple[str, str]] = []
    text: list[tuple[str, str]] = []  # pieces of a block and their kinds
    ends = _Ends(page)
    open_tags: list[tuple[str, str]] = []  # containers, and the kind that each puts its text in
    kind = "other"

    def flush() -> None:
        for k in dict.fromkeys(k for k, _ in text):
            block = " ".join("".join(t for of, t in text if of == k).split())
            if block:
                out.append((k, block))
        text.clear()

    found, go_on = tokens(page), None
    while True:
        try:
            slash, tag, rest, at = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if not tag:
            text.append((kind, html.unescape(rest)))
            continue
        if tag in _BLOCKS:
            flush()
        elif tag in _SPACES:
            text.append((kind, " "))
        if slash:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    around = open_tags[-1][1] if open_tags else "other"
                    if around != kind and (kind != "chrome" or tag in _BLOCKS):
                        flush()
                    kind = around
                    break
            continue
        closed = _self_closed(tag, rest)
        if tag in _RAW and not closed:
            stop = _RAW_END[tag].search(page, at)
            go_on = stop.start() if stop else len(page)
            continue
        if tag in _BLOCKS and (ended := _open_line(open_tags, "li" if tag == "li" else "p")) is not None:
            del open_tags[ended:]
            kind = open_tags[-1][1] if open_tags else "other"
        if tag in _VOID or tag in ("p", "b", "i", "a", "li", "em", "strong") and not rest:
            continue
        inside = any(k == "article" for _, k in open_tags)
        within = inside or any(k == "main" for _, k in open_tags)
        if _chrome(tag, rest, within):
            new = "chrome"
        elif tag in ("article", "main") or rest and _MAIN.search(rest):
            if kind == "chrome" and not any(t in ("article", "main") and k != "chrome" for t, k in open_tags):
                first = next(i for i, (_, k) in enumerate(open_tags) if k == "chrome")
                name = open_tags[first][0]
                if not (trusted and ends.closes(name, at, sum(t == name for t, _ in open_tags[first:]))):
                    open_tags.clear()
            new = "chrome" if open_tags and open_tags[-1][1] == "chrome" else "article" if tag == "article" or inside else "main"
        else:
            new = kind
        if new != kind and new != "chrome" and tag not in _BLOCKS:
            flush()
        if not closed:
            open_tags.append((tag, new))
            kind = new
    flush()
    return out


def decided(found: list[tuple[str, str]]) -> str | None:
    """The text of a page that marks its article (else its main part) up; of a page without open lines, the empty text."""
    for wanted in ("article", "main"):
        if any(k == wanted for k, _ in found):
            return "\n".join(t for k, t in found if k == wanted or k == "article")
    return None if any(k == "other" for k, _ in found) else ""


#: Bits of a table of prefixes that an alignment holds at a time; longer ones are halved.
_TABLE_BITS = 1 << 26


def _lengths(left: list[int], right: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of ``left`` and each prefix of ``right``, by bit vectors."""
    where: dict[int, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(right)) - 1
    for x in left:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    zeros = 1 - np.unpackbits(np.frombuffer(v.to_bytes(len(right) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(right)].astype(np.int64)
    return np.concatenate(([0], np.cumsum(zeros)))


def _aligned(left: list[int], right: list[int]) -> list[int]:
    """Places in ``left`` of a longest common subsequence with ``right``; memory is bounded by halving ``left``."""
    if not left or not right:
        return []
    if len(left) > 1 and len(left) * len(right) > _TABLE_BITS:
        half = len(left) // 2
        cut = int(np.argmax(_lengths(left[:half], right) + _lengths(left[half:][::-1], right[::-1])[::-1]))
        return _aligned(left[:half], right[:cut]) + [half + i for i in _aligned(left[half:], right[cut:])]
    where: dict[int, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(right)) - 1
    rows = [full]
    for x in left:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [], len(right) - 1
    for i in range(len(left), 0, -1):
        while j >= 0 and rows[i] >> j & 1:  # no match of the prefix ends in column j
            j -= 1
        if j < 0:
            break
        if rows[i - 1] >> j & 1:
            out.append(i - 1)
            j -= 1
    return out[::-1]


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` lie on a longest common subsequence with ``b``.

    Common ends are matched first; of the middle, only what both have takes part.
    """
    n, m = len(a), len(b)
    shared = np.zeros(n, bool)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        shared[head] = True
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        shared[n - 1 - tail] = True
        tail += 1
    a_mid, b_mid = a[head : n - tail], b[head : m - tail]
    places = head + np.flatnonzero(np.isin(a_mid, b_mid))  # no other element can take part
    shared[places[_aligned(a[places].tolist(), b_mid[np.isin(b_mid, a_mid)].tolist())]] = True
    return shared


def _key(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), f"{parts.path}?{parts.query}" if parts.query else parts.path
    except ValueError:
        return "", url or ""


def _common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _hashes(found: list[tuple[str, str]]) -> bytes:
    return b"".join(xxhash.xxh64_digest(t.encode()) for _, t in found)


def _sorted_out(found: list[tuple[str, str]]) -> list[tuple[str, str, bool]]:
    """(kind, text, wanted) of the lines; wanted are those that the page's marks decide to be its text."""
    for wanted in (("article",), ("main", "article")):
        if any(k == wanted[0] for k, _ in found):
            return [(k, t, k in wanted) for k, t in found]
    return [(k, t, False) for k, t in found]


#: Keys of differing content that a walk remembers.
KEPT = 8
#: Up to so many bytes of ends of parts go by the driver; more stay in tables.
ENDS_BYTES = 32 << 20
_ENDS = pa.schema([("part", pa.int32()), ("i", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("key", pa.binary())])


class _Seen:
    """A key on a walk: its row, the hashes of its lines, and hash and characters of its open lines."""

    def __init__(self, row: dict) -> None:
        hashes, sizes = np.frombuffer(row["hashes"], np.uint64).tolist(), np.frombuffer(row["sizes"], np.int32).tolist()
        self.row, self.lines, self.open, self.size = row, set(hashes), [(h, n) for h, n in zip(hashes, sizes, strict=True) if n], sum(sizes)

    def copies(self, other: _Seen) -> bool:
        """Whether the other has nine tenths of the characters of the open lines: it is a copy then, not a template."""
        if self.row["hashes"] == other.row["hashes"]:
            return True
        return self.size > 0 and 10 * sum(n for h, n in self.open if h in other.lines) >= 9 * self.size


class _Walk:
    """The last keys of a host in order, without copies of each other; of copies the latest stands."""

    def __init__(self, rows: list[dict] | None = None) -> None:
        self.kept = [_Seen(r) for r in rows or []]

    def step(self, row: dict) -> dict | None:
        """The nearest key before this one that is no copy of it; the row is remembered unless it has no lines."""
        if self.kept and self.kept[-1].row["host"] != row["host"]:
            self.kept.clear()
        if not row["hashes"]:
            return None
        new = _Seen(row)
        copies = [new.copies(k) for k in self.kept]
        found = next((k.row for k, same in zip(reversed(self.kept), reversed(copies), strict=True) if not same), None)
        self.kept = [k for k, same in zip(self.kept, copies, strict=True) if not (same and k.copies(new))][1 - KEPT :] + [new]
        return found


def differenced(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text string, marked boolean, lines, shared, open_lines, deleted, restored, outside long), a row for each page.

    Every page goes through pairing, alignment and deletion of all its ``lines``, of which so many are ``shared`` with
    its neighbour. Its open lines are those that aren't chrome; so many of them are ``deleted``. Where a page marks its
    article (else its main part) up, the mark is an exact check of the outcome: its lines that were deleted are
    ``restored``, and lines left ``outside`` of it go. ``text`` is what remains, as of ``extract``.
    """
    chosen = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[page].cast("string").alias("html"))

    def keyed(found: list[tuple[str, str]], url: str | None) -> tuple[bytes, str, str, bytes, bytes]:
        """(key, host, path, line hashes, characters of open lines; 0 for chrome)."""
        host, path = _key(url)
        hashes, sizes = _hashes(found), np.array([0 if k == "chrome" else len(t) for k, t in found], np.int32).tobytes()
        whole = "\0".join((host, path)).encode("utf-8", "surrogatepass")
        return xxhash.xxh128_digest(b"%d:%d:" % (len(whole), len(hashes)) + whole + hashes + sizes), host, path, hashes, sizes

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every page's place and line hashes."""
        for batch in batches:
            rows = [keyed(lines(h.as_py() or ""), u.as_py()) for h, u in zip(batch.column("html"), batch.column("url"), strict=True)]
            kinds = [pa.binary(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "host", "path", "hashes", "sizes"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which lines of a key its nearest neighbour has too."""
        for batch in batches:
            gone = []
            for row in batch.to_pylist():
                mine = np.frombuffer(row["hashes"], np.uint64)
                near = [(np.frombuffer(row[s], np.uint64), row[f"{s}_path"]) for s in ("before", "after") if row[s] is not None]
                other = max(near, key=lambda x: _common_prefix(x[1], row["path"]))[0] if near else mine[:0]
                gone.append(np.packbits(common_lines(mine, other)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.binary())], ["key", "gone"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every page's key and its lines other than chrome."""
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "lines", "at", "wanted", "marked", "n")}
            for h, u in zip(batch.column("html"), batch.column("url"), strict=True):
                found = lines(h.as_py() or "")
                open_lines = [(t, i, w) for i, (k, t, w) in enumerate(_sorted_out(found)) if k != "chrome"]
                out["key"].append(keyed(found, u.as_py())[0])
                for c, values in zip(("lines", "at", "wanted"), zip(*open_lines, strict=True) if open_lines else ([], [], []), strict=True):
                    out[c].append(list(values))
                out["marked"].append(any(k in ("article", "main") for k, _ in found))
                out["n"].append(len(found))
            kinds = [pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["page_id", "url", *out])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("text", "marked", "lines", "shared", "open_lines", "deleted", "restored", "outside")}
            for row in batch.select(["lines", "at", "wanted", "marked", "n", "gone"]).to_pylist():
                shared = np.unpackbits(np.frombuffer(row["gone"], np.uint8)).astype(bool)
                gone = shared[np.array(row["at"], np.int64)]
                wanted = np.array(row["wanted"], bool)
                keep = wanted if row["marked"] else ~gone
                out["text"].append("\n".join(t for t, k in zip(row["lines"], keep, strict=True) if k))
                out["marked"].append(row["marked"])
                out["lines"].append(row["n"])
                out["shared"].append(int(shared[: row["n"]].sum()))
                out["open_lines"].append(len(keep))
                out["deleted"].append(int(gone.sum()))
                out["restored"].append(int((gone & keep).sum()))
                out["outside"].append(int((~gone & ~keep).sum()))
            kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["page_id", "url", *out])

    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A walk over each part of the keys in order, and one backward, meet the nearest keys of other content; what a
    # walk begins with comes from the ends of the parts passed before, KEPT keys for each.
    order = ["host", "path", "hashes", "sizes", "key"]
    keys = chosen.mapInArrow(ring, "key binary, host string, path string, hashes binary, sizes binary").distinct()
    keys = checkpointed(keys.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def walked(table: DataFrame, name: str, down: bool) -> DataFrame:
        """``table``, of the parts of ``keys``, with the neighbour met on one walk.

        Nothing is moved between parts while what they begin with is small; beyond ENDS_BYTES it is carried on in one
        stream of KEPT rows for each part, which holds KEPT of them at a time, and meets its part by a shuffle.
        """
        way = [F.col(c).desc() if down else F.col(c) for c in ("part", *order)]

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The last keys of a part's walk that differ from each other, oldest first."""
            walk, part = _Walk(), None
            for batch in batches:
                for row in batch.to_pylist():
                    part = row["part"]
                    walk.step(row)
            for i, row in enumerate(k.row for k in walk.kept):
                yield pa.RecordBatch.from_pylist([{"part": part, "i": i, **{c: row[c] for c in order}}], schema=_ENDS)

        def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What each part begins with, from the ends of all parts in the order of the walk; of the first part nothing."""
            walk, part = _Walk(), None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["part"] != part:
                        part = row["part"]
                        for i, r in enumerate(k.row for k in walk.kept):
                            yield pa.RecordBatch.from_pylist([{"part": part, "i": i, **{c: r[c] for c in order}}], schema=_ENDS)
                    walk.step(row)

        fields = "part int, i int, host string, path string, hashes binary, sizes binary, key binary"
        found = checkpointed(keys.sortWithinPartitions(*way).mapInArrow(ends, fields))
        total = found.agg(F.sum(sum(F.octet_length(c).cast("long") for c in order))).first()[0] or 0
        begin: dict[int, list[dict]] = {}
        if total <= ENDS_BYTES:
            rows = sorted((r.asDict() for r in found.collect()), key=lambda r: (-r["part"] if down else r["part"], r["i"]))
            for batch in carried(iter([pa.RecordBatch.from_pylist(rows, schema=_ENDS)])):
                for r in batch.to_pylist():
                    begin.setdefault(r["part"], []).append(r)
            here = table.withColumn("lead", F.lit(None).cast("int")).sortWithinPartitions(*way)
        else:
            lead = found.coalesce(1).sortWithinPartitions(way[0], "i").mapInArrow(carried, fields).withColumnRenamed("i", "lead")
            here = table.unionByName(lead, allowMissingColumns=True).repartition(spread, "part").sortWithinPartitions(way[0], F.col("lead").asc_nulls_last(), *way[1:])

        columns = table.columns

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walk, part = _Walk(), None
            for batch in batches:
                out, own = [], []
                for i, row in enumerate(batch.to_pylist()):
                    if row["part"] != part:
                        part = row["part"]
                        walk = _Walk(begin.get(part))
                    if row["lead"] is not None:
                        walk.kept.append(_Seen(row))
                        continue
                    other = walk.step(row)
                    own.append(i)
                    out.append((other["hashes"], other["path"]) if other else (None, None))
                kept = batch.take(pa.array(own, pa.int64())).select(columns)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], [*kept.schema.names, name, f"{name}_path"])

        return here.mapInArrow(meet, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema) + f", {name} binary, {name}_path string")

    sides = walked(walked(keys, "before", False), "after", True)
    gone = sides.mapInArrow(differ, "key binary, gone binary")
    rows = chosen.mapInArrow(dealt, "page_id long, url string, key binary, lines array<string>, at array<int>, wanted array<boolean>, marked boolean, n long").join(gone, "key")
    return rows.mapInArrow(checked, "page_id long, url string, text string, marked boolean, lines long, shared long, open_lines long, deleted long, restored long, outside long")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text string), a row for each page.

    The text is what page differencing leaves, checked against the blocks of the article, else of the main element,
    where the page has one; blocks are joined by a newline. Null and empty pages, and pages of chrome only, give an
    empty text. Null and malformed urls are of one nameless host. A page alone on its host keeps all undecided
    lines. Of equally near neighbours the one before counts. Pages of one host, path and content are one neighbour,
    and a page is not compared with copies: pages that have nine tenths of the characters of its open lines. The next
    nearest page counts instead; where a host has only copies of a page, that page keeps all undecided lines. Pages of any length are read whole. Other columns
    are ignored.
    """
    return differenced(pages, page_id, url, page).select("page_id", "url", "text")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
