"""Packing token sequences by best-fit decreasing, with a segment tree over remaining capacities.

Documents are tokenized where they are read and cut into full windows, which are sequences of their own. What is left
of each document, less than a window, waits in a group of bounded size. A group is packed by best-fit decreasing: the
longest first, each into the open window with the least capacity that still holds it, which a segment tree over
capacities finds in steps of the logarithm of the window. Then the emptiest windows of the group are taken apart, their
pieces cut to fill the gaps of the others exactly, and the one window that stays unfilled is cut at powers of two, at
which no padding is due. So nothing is padded, and nothing is shuffled: a task packs what it reads.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a sequence; remainders packed together; parts of texts and words that a worker keeps the ids
#: of; characters encoded at once.
WINDOW, GROUP, CACHE, AT_ONCE = 1024, 4096, 1 << 20, 1 << 20
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: White space that the vocabulary's own splitting knows, letters of one byte or two, and texts that hold characters on
#: whose kind libraries differ or NUL, which marks a part that doesn't follow a single space.
_SPACE = r"\t\n\v\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(rf" ?[{_LETTERS}]++(?![^\x00-\x40\x5b-\x60\x7b-\x7f])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
_WHOLE = re.compile(r"[\x00\x1c-\x1f\x85\u180e\u200b\ufeff]")
_ODD = re.compile(r"[\x00\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers, those of the file read by ``tokenizers``.

    A byte-level vocabulary splits texts into words with at most one space before them and merges nothing across, so
    texts are cut at single spaces, the parts that were not met before into words, and only words not met before are
    encoded. Both are kept up to CACHE of each. Texts that hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str] | None:
        """Parts that are encoded each by itself; those that begin at a single space are given without it."""
        odd = _ODD.search(text)
        if (odd and _WHOLE.search(text)) or any(s in text for s in self.special):
            return None
        if odd or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return [p[1:] if p[:1] == " " and len(p) > 1 and p[1:].strip() else "\x00" + p for p in _WORD.findall(text)]
        first, *rest = text.split(" ")
        return ["\x00" + first, *rest]

    def known(self, cache: dict[str, bytes], asked: set[str], answer) -> None:
        """Fill ``cache`` with what is asked and not there."""
        new = list(asked.difference(cache))
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list(asked)
        cache.update(zip(new, answer(new), strict=True))

    def of_parts(self, parts: list[str]) -> list[bytes]:
        cut = [_WORD.findall(p[1:] if p[:1] == "\x00" else " " + p) for p in parts]
        self.known(self.words, set().union(*cut), self.packed)
        return [b"".join(map(self.words.__getitem__, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        self.known(self.parts, set().union(*(c for c in split if c)), self.of_parts)
        return [self.packed([t])[0] if c is None else b"".join(map(self.parts.__getitem__, c)) for t, c in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    return Encoder(path)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities 0 to ``most``, a node telling
    whether any window is below it."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        i = capacity + self.leaves
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window of the least capacity of at least ``size`` and that capacity, now no longer open."""
        if size >= len(self.windows):
            return None
        i = size + self.leaves
        while not self.any[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i + (not self.any[2 * i])
        capacity = i - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self.any[i] = False
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = False
        return window, capacity


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each window, by their place in ``sizes``, none of which passes ``window``."""
    tree, bins = OpenWindows(window), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            bins.append([item])
            tree.put(len(bins) - 1, window - sizes[item])
        else:
            bins[found[0]].append(item)
            tree.put(found[0], found[1] - sizes[item])
    return bins


def fill(bins: list[list[int]], sizes: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, begin, end): the emptiest windows are taken apart and cut to fill the others.

    All sequences have ``window`` ids but for the last ones, whose lengths are powers of two.
    """
    held = [[(i, 0, sizes[i]) for i in b] for b in bins]
    size = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(held)), key=lambda b: -size[b])
    at, loose = 0, []
    while at < len(order):
        gap = window - size[order[at]]
        while gap and (loose or at + 1 < len(order)):
            if not loose:
                loose = held[order.pop()]
            item, begin, end = loose.pop()
            cut = min(end, begin + gap)
            held[order[at]].append((item, begin, cut))
            gap -= cut - begin
            if cut < end:
                loose.append((item, cut, end))
        at += 1
    out = [held[b] for b in order]
    if loose:
        out.append(loose)
    last = out.pop() if out else []
    left = sum(e - b for _, b, e in last)
    while left:
        room, now = 1 << (left.bit_length() - 1) if left < window else window, []
        left -= room
        while room:
            item, begin, end = last.pop()
            cut = min(end, begin + room)
            now.append((item, begin, cut))
            room -= cut - begin
            if cut < end:
                last.append((item, cut, end))
        out.append(now)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids.

    Returns (doc_id, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long), a row
    for each piece: its first id's place in the document, how many ids, their CRC-32 as little-endian unsigned 32-bit
    numbers, the ids of the document, and where the piece lies. A document's ids are those that the file ``tokenizer``
    gives its text, without special tokens added, then ``end_id``. Each id lies in one piece; the pieces of a sequence
    follow one another from offset 0. Sequences have ``window`` ids or a power of two, the latter a few for each group
    of ``group`` documents or task. Null and empty texts are ``end_id`` alone; rows that repeat are packed each; other
    columns are ignored; an empty table gives no rows. A worker holds a batch, a group's remainders and a bounded
    cache. Sequences follow the order in which partitions give their rows: write a table that isn't read from files.
    """
    if window < 1 or group < 1:
        raise ValueError("window and group are at least 1")

    def run(batches):
        encode, number, waiting = encoder(tokenizer).encode, 0, []
        base, last = TaskContext.get().partitionId() << 40, array("I", [end_id]).tobytes()

        def encoded(texts):
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < AT_ONCE:
                    size += len(texts[to])
                    to += 1
                yield from encode(texts[at:to])
                at = to

        def rows(found):
            columns = list(zip(*found, strict=True)) if found else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _SCHEMA.split(", ")])

        def flush():
            nonlocal number, waiting
            sizes, found = [len(ids) // 4 for *_, ids in waiting], []
            for pieces in fill(best_fit(sizes, window), sizes, window):
                offset = 0
                for item, begin, end in pieces:
                    d, start, total, ids = waiting[item]
                    found.append((d, start + begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end]), total, base + number, offset))
                    offset += end - begin
                number += 1
            waiting = []
            return rows(found)

        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            full = []
            for d, ids in zip(ids_of, encoded([t or "" for t in texts]), strict=True):
                ids += last
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    full.append((d, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), total, base + number, 0))
                    number += 1
                if whole < total:
                    waiting.append((d, whole, total, ids[4 * whole :]))
                if len(waiting) == group:
                    yield flush()
                if len(full) >= 4096:
                    yield rows(full)
                    full = []
            yield rows(full)
        yield flush()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 1,024 ids of the byte-level vocabulary."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
