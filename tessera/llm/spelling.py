"""Grouping of spelling variants: a positional q-gram inverted index with length, position and count filters.

Words are counted by one aggregation. For the search, two words of one edit share the first or the second half of the
shorter one, since the edit touches one half only; so each word is a member of the groups of its halves, for its own
length and for the length before. A group beyond GROUP words is divided by the halves of what its words don't share,
and so on, until a single code point is left, so that groups are bounded, by the alphabet at the last, whatever the
data, and no pair is lost. In a group, the q-grams of what isn't shared are indexed by position and length. A word
merges the postings that it can meet, those of its own length at its positions and those one longer there or one place
on, by a heap, and keeps the words whose overlap reaches what one edit leaves. The longest lists, which alone can't
reach it, are not merged but looked up. What is left is verified.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed

#: A-Z, a-z and the letters (and two signs) of Latin-1.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Q = 2
#: Words of a group beyond which it is divided.
GROUP = 256


def runs(text: Column) -> Column:
    """Maximal runs of letters with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))


def damaged(doc_id: Column, run: Column, one_in: int = 97) -> Column:
    """``run`` without one code point where ``one_in`` divides the CRC-32 of ``doc_id:run``; a null id counts as ''."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n long) of the words of at least so many code points and occurrences."""
    words = docs.select(docs[doc_id].alias("d"), F.explode(runs(docs[text].cast("string"))).alias("run")).where(F.char_length("run") >= least_length)
    words = words.select(damaged(F.col("d"), F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_within(words: list[str], short: int, lo: int, tail: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of one edit among words of ``short`` or one more code points of which the first ``lo`` and the last
    ``tail`` agree; of words one longer, those with shorter ones only. Each pair once."""
    opened = ["\x00" + w[lo : len(w) - tail] + "\x01" for w in words]
    index: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    for i, x in enumerate(opened):
        for p in range(len(x) - Q + 1):
            index[x[p : p + Q], p, len(words[i])].append(i)
    everyone = {n: [i for i, w in enumerate(words) if len(w) == n] for n in (short, short + 1)}
    pairs = []
    for i in everyone[short]:
        x = opened[i]
        for n in (short, short + 1):
            postings = []
            for p in range(len(x) - Q + 1):
                for at in (p,) if n == short else (p, p + 1):
                    if found := index.get((x[p : p + Q], at, n)):
                        postings.append(found)
            bound = n - lo - tail + Q - 1 - Q  # of the longer one's grams, one edit changes Q at most
            if bound <= 0:
                candidates = everyone[n]
            elif len(postings) < bound:
                continue
            else:
                postings.sort(key=len)
                few, long = postings[: len(postings) - bound + 1], postings[len(postings) - bound + 1 :]
                candidates = []
                for j, same in groupby(heapq.merge(*few) if len(few) > 1 else few[0]):
                    overlap = sum(1 for _ in same)
                    for k, other in enumerate(long):
                        if overlap + len(long) - k < bound:
                            break
                        at = bisect_left(other, j)
                        overlap += at < len(other) and other[at] == j
                    if overlap >= bound:
                        candidates.append(j)
            pairs += [(i, j) for j in candidates if (j > i or n > short) and one_edit(words[i], words[j])]
    return pairs


_KEY = ["short", "lo", "tail", "head", "rest"]


def _members(words: DataFrame, short: Column, lo: Column, tail: Column) -> DataFrame:
    """Memberships in groups: what the first ``lo`` and the last ``tail`` code points are, for words of ``short`` or one more."""
    m = words.withColumns({"short": short, "lo": lo, "tail": tail})
    return m.withColumns({"head": F.substring("word", F.lit(1), F.col("lo")), "rest": F.expr("right(word, tail)")}).select("word", "n", *_KEY)


def _halves(words: DataFrame) -> DataFrame:
    """The memberships that come of dividing what (short, lo, tail) leave open."""
    half = F.floor((F.col("short") - F.col("lo") - F.col("tail")) / 2).cast("int")
    open_ = F.col("short") - F.col("lo") - F.col("tail")
    first = _members(words, F.col("short"), F.col("lo") + half, F.col("tail"))
    return first.unionByName(_members(words, F.col("short"), F.col("lo"), F.col("tail") + open_ - half))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, other, m) for all words (word, n) that are one edit apart, in both directions, each once."""
    length = F.char_length("word")
    both = words.withColumn("short", F.explode(F.array(length, length - 1))).where("short > 0").withColumns({"lo": F.lit(0), "tail": F.lit(0)})
    todo, parts = checkpointed(_halves(both)), []
    while True:
        size = todo.groupBy(*_KEY).agg(F.count("*").alias("size"))
        divided = checkpointed(size.where((F.col("size") > group) & (F.col("short") - F.col("lo") - F.col("tail") > 1)).select(*_KEY))
        if divided.isEmpty():
            parts.append(todo)
            break
        parts.append(todo.join(divided, _KEY, "left_anti"))
        todo = checkpointed(_halves(todo.join(divided, _KEY, "left_semi")))

    def search(batches):
        key, words, count = None, [], []

        def found():
            pairs = near_within(words, *key[:3]) if len(words) > 1 else []
            for i, j in pairs:
                yield words[i], count[i], words[j], count[j]
                yield words[j], count[j], words[i], count[i]

        def rows(of):
            of = list(zip(*of, strict=True)) if of else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(of, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "other", "m"])

        out = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*_KEY, "word", "n"]]
            for *k, w, n in zip(*columns, strict=True):
                if k != key:
                    out += found() if key else []
                    key, words, count = k, [], []
                    if len(out) >= 8192:
                        yield rows(out)
                        out = []
                words.append(w)
                count.append(n)
        yield rows(out + (list(found()) if key else []))

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    dealt = every.repartition(*_KEY).sortWithinPartitions(*_KEY)
    pairs = dealt.mapInArrow(search, "word string, n long, other string, m long")
    return pairs.repartition("word").groupBy("word", "other").agg(F.first("n").alias("n"), F.first("m").alias("m")).select("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) and ``root``, the last word that forms lead to from a word, by pointer jumping."""
    at = checkpointed(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = checkpointed(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return forms.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, factor: int = 2, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, group: int = GROUP) -> DataFrame:
    """The words of a corpus, each with the spelling that it is a variant of.

    Words are the maximal runs of the letters of RUN, A-Z lower-cased, of at least ``least_length`` code points and
    ``least_count`` occurrences, after ``damaged`` took a code point off about one of 97 runs. Returns (word, form,
    root string, n, n_near, form_n long): occurrences; how many words are one edit away; of these that of largest n,
    ties to the smallest in code-point order, if its n is at least ``factor`` (2 or more) times the word's, with its
    n, else null; and the word that forms lead to in the end, or the word itself. Null and empty texts have no words;
    a null id counts as ''; rows that repeat count each; other columns are ignored; an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("factor is at least 2, so that forms can't lead in a circle")
    words = checkpointed(count_words(docs, doc_id, text, least_length, least_count))
    # code-point order is that of UTF-8 bytes, in which Spark compares strings
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form")))
    near = near_pairs(words, group).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.m") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")
    )
    return roots(checkpointed(joined)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All words of all ``documents``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS h FROM r GROUP BY d, run),
b AS (SELECT run, n, list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, crc),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM v)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN del b ON a.word = b.less
  UNION SELECT b.word, a.word, a.n FROM v a JOIN del b ON a.word = b.less),
f AS (
  SELECT word, count(*) AS n_near, max(m) AS m, (array_agg(other ORDER BY m DESC, encode(other)))[1] AS other FROM p GROUP BY word),
x AS (
  SELECT v.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN f USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM x
  UNION ALL SELECT c.word, c.next, x.form FROM chain c JOIN x ON c.next = x.word)
SELECT x.word, x.form, c.root, x.n, x.n_near, x.form_n FROM x JOIN chain c ON x.word = c.word AND c.next IS NULL
"""
