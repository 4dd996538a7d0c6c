"""Near-duplicate documents by b-bit MinHash.

Each text becomes its set of hashed word shingles. Texts of the same set form one class, and only classes go on.
128 minima are taken of each set; three at a time make a band, and classes that share a band are candidates. Of
the minima four low bits are kept, packed 16 to a long, and the share of equal lanes, corrected for chance
collisions, estimates the similarity of a candidate pair by bit counts. Pairs whose estimate is within five
standard deviations of the threshold are confirmed on the full sets.

All pairs of a band would be quadratic for large groups of copies. Only components matter, so all of a band first
follow one leader, and then what is not connected yet follows a leader of the band's main component. Pairs across the
components left are tested one and all: row by row in small bands, in blocks against blocks in large ones. Pairs
within a component are not formed, and no pair across components of a band is left out. Components between these
steps are those that one look at the leaders' leaders finds; the true ones are computed once, of all links.

No band sits in one task: what is joined on bands is joined on bands and SALTS shares of their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import lookup
from tessera.llm.graph import components
from tessera.llm.salted import bit, for_members, salt
from tessera.llm.shared import checkpointed
from tessera.llm.words import U64, mix, shingles, utf8, words

MINIMA, ROWS, BITS = 128, 3, 4
#: Members of a band from which its pairs are tested in blocks rather than joined row by row, and what a block holds
#: at most: members, and bytes of their sets.
BLOCK_FROM, BLOCK, BLOCK_BYTES = 64, 2048, 32 << 20
#: Pairs across components for each member of a band up to which no second leader is followed.
ENUMERATE = 16
#: Chance that a pair right at the threshold shares no band.
MISS = 1e-6
_LANES = 64 // BITS
_MULTIPLY = np.random.default_rng(99).integers(0, 2**63, MINIMA, dtype=np.uint64) * U64(2) + U64(1)
_SLICE = 1 << 20


def bands_for(threshold: float) -> int:
    return max(1, min(MINIMA // ROWS, math.ceil(math.log(MISS) / math.log(1 - min(threshold, 0.999) ** ROWS))))


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(at) - 1:
        last = max(row + 1, int(np.searchsorted(at, at[row] + _SLICE, side="right")) - 1)
        yield row, last
        row = last


def signatures(docs: DataFrame, k: int, n_bands: int) -> DataFrame:
    """(doc_id, r1, r2, n_shingles, f1, f2, sig, bands) of (doc_id, text, r1, r2); f1 and f2 are equal for equal sets only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for lo, hi in _slices(at):
                h, bounds = shingles(words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True), k)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                heads, n = bounds[:-1][full], hi - lo
                minima = np.zeros((MINIMA, n), np.uint32)
                prints = np.zeros((2, n), np.uint64)
                if len(full):
                    for i, m in enumerate(_MULTIPLY):
                        minima[i, full] = np.minimum.reduceat((h * m >> U64(32)).astype(np.uint32), heads)
                    prints[0, full] = np.add.reduceat(mix(h + U64(1)), heads)
                    prints[1, full] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), heads)
                low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, _LANES, n)
                sig = np.bitwise_or.reduce(low << (np.arange(_LANES, dtype=np.uint64) * U64(BITS))[None, :, None], axis=1)
                bands = np.empty((n_bands, n), np.uint64)
                for b in range(n_bands):
                    v = np.full(n, b + 1, np.uint64)
                    for r in range(ROWS):
                        v = mix(v + minima[b * ROWS + r])
                    bands[b] = v
                listed = lambda x: _listed(np.ascontiguousarray(x.T).ravel(), np.arange(0, x.size + 1, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, n) for c in ("doc_id", "r1", "r2")], pa.array(size, pa.int64()), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), listed(sig), listed(bands)],
                    ["doc_id", "r1", "r2", "n_shingles", "f1", "f2", "sig", "bands"],
                )

    return docs.mapInArrow(sign, f"doc_id {kind}, r1 long, r2 long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: equal lanes by bit counts, less what chance makes equal."""
    ones = F.lit(sum(1 << i for i in range(0, 64, BITS)))
    differ = F.lit(0)
    for i in range(MINIMA // _LANES):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    chance = 2.0**-BITS
    return ((MINIMA - differ) / F.lit(float(MINIMA)) - chance) / (1 - chance)


def floor_for(threshold: float) -> float:
    """The estimate below which a pair at the threshold falls with a chance of about one in four million."""
    chance = 2.0**-BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - 5 * math.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)


def _listed(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _longs(rows: pa.Table, name: str) -> np.ndarray:
    """The items of an array column one after another."""
    return np.asarray(rows.column(name).combine_chunks().flatten()).view(np.uint64)


def _dealt(rows: DataFrame, n_bytes: int) -> tuple[DataFrame, int]:
    """Rows with a batch by node, and the number of batches."""
    n = max(1, math.ceil(n_bytes / lookup.BATCH_BYTES))
    return rows.withColumn("batch", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")), n


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, r1, r2, n, sig, bands) of classes that share a band, with those bands only."""
    width = 8 * len(classes.columns) + MINIMA * BITS // 8 + 8 * (MINIMA // ROWS)
    dealt, buckets = _dealt(classes.select("node", "r1", "r2", "n", "sig", "bands"), classes.count() * width)

    def finish(table: pa.Table, again: np.ndarray) -> pa.Table:
        shared = again.reshape(table.num_rows, -1)
        at = np.concatenate(([0], np.cumsum(shared.sum(axis=1))))
        out = table.select(["node", "r1", "r2", "n", "sig"]).append_column("bands", _listed(_longs(table, "bands")[again], at))
        return out.filter(pa.array(shared.any(axis=1)))

    return lookup.occurring_elsewhere(dealt, buckets, lambda t: _longs(t, "bands"), finish, "node long, r1 long, r2 long, n long, sig array<long>, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, n, sig, bands, set) of (node, n, sig, bands, text): the sorted shingles of a text, packed."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for lo, hi in _slices(at):
                h, bounds = shingles(words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True), k)
                blobs = [lookup.pack(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("node", "n", "sig", "bands")], pa.array(blobs, pa.binary())], ["node", "n", "sig", "bands", "set"])

    return docs.mapInArrow(collect, "node long, n long, sig array<long>, bands array<long>, set binary")


def _matchable(sets: DataFrame, n_bytes: int, percent: int) -> DataFrame:
    """(node, n, m, sig, bands, set) of sets that can reach the threshold at all: m of their n shingles occur in another.

    No intersection is larger than the smaller m, so a set with too few such shingles has no partner, and pairs can
    be ruled out by their counts alone. This is what keeps groups of loosely similar texts from meeting pairwise.
    """
    dealt, buckets = _dealt(sets, n_bytes)

    def once(table: pa.Table) -> np.ndarray:
        """The first row of each node; rows that repeat in the input come with the same one."""
        return np.sort(np.unique(table.column("node").to_numpy(), return_index=True)[1])

    def keys_of(table: pa.Table) -> np.ndarray:
        return np.concatenate([lookup.unpack(x) for x in table.column("set").take(pa.array(once(table))).to_pylist()])

    def finish(table: pa.Table, again: np.ndarray) -> pa.Table:
        table = table.take(pa.array(once(table)))
        n = table.column("n").to_numpy()
        m = np.diff(np.concatenate(([0], np.cumsum(again)))[np.concatenate(([0], np.cumsum(n)))])
        out = table.select(["node", "n", "sig", "bands", "set"]).add_column(2, "m", pa.array(m, pa.int64()))
        return out.filter(pa.array(100 * m >= percent * n))

    return lookup.occurring_elsewhere(dealt, buckets, keys_of, finish, "node long, n long, m long, sig array<long>, bands array<long>, set binary")


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether two nodes, by the fields n, m and sig of their structs, may reach the threshold."""
    least = F.least(F.col(f"{a}.m"), F.col(f"{b}.m"))
    counts = 100 * least >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - least)
    return counts & (estimate(F.col(f"{a}.sig"), F.col(f"{b}.sig")) >= floor_for(percent / 100))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, last, right = [], None, None
            for one, two in zip(batch.column("left"), batch.column("right"), strict=True):
                two = two.as_py()
                if two != last:
                    last, right = two, lookup.unpack(two)
                left = lookup.unpack(one.as_py())
                both = _overlap(left, right)
                fine.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def _overlap(left: np.ndarray, right: np.ndarray) -> int:
    small, big = (left, right) if len(left) <= len(right) else (right, left)
    return int(np.count_nonzero(big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small))


def _blocked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across the components of large bands, enough of them to connect what is connected.

    A band's main component and its other members are dealt into blocks by hash, and every two blocks that can hold
    a pair across components meet in one group, bounded in members and in bytes. A group tests pairs from the most
    alike on and skips those that its own links have joined; a pair that shares several bands is tested in the first
    of them only.
    """
    floor, chance = floor_for(percent / 100), 2.0**-BITS
    lanes = U64(sum(1 << i for i in range(0, 64, BITS)))
    is_main = F.col("component") == F.col("main")
    blocks = lambda n, words: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(words * 8 / F.lit(BLOCK_BYTES))).cast("int")
    n0, n1 = blocks(F.col("n_main"), F.col("words_main")), blocks(F.col("all") - F.col("n_main"), F.col("words") - F.col("words_main"))
    block = F.when(is_main, F.pmod(F.xxhash64("node"), n0)).otherwise(n0 + F.pmod(F.xxhash64("node"), n1)).cast("int")
    other = F.when(is_main, F.sequence(n0, n0 + n1 - 1)).otherwise(F.sequence(F.lit(0), n0 + n1 - 1))
    wide = near.select("band", "node", "component", "of.m", block.alias("block"), F.explode(other).alias("with"))
    wide = wide.select("band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "component", "m")
    wide = wide.join(sets.select("node", "n", "sig", "set", "bands"), "node")

    def test(key, rows):
        band, lo, hi = (x.as_py() for x in key)
        sig = _longs(rows, "sig").reshape(-1, MINIMA // _LANES)
        bands_of = [set(x) for x in rows.column("bands").to_pylist()]
        n, m, block = (rows.column(c).to_numpy() for c in ("n", "m", "block"))
        node, blobs = rows.column("node").to_pylist(), rows.column("set").to_pylist()
        group: dict = {}
        comp = np.array([group.setdefault(c, len(group)) for c in rows.column("component").to_pylist()], np.int64)
        p, q = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = []
        for at in range(0, len(p), 128):
            part = p[at : at + 128]
            differ = np.zeros((len(part), len(q)), np.uint8)
            for k in range(sig.shape[1]):
                x = sig[part, k][:, None] ^ sig[q, k][None, :]
                x |= x >> U64(1)
                x |= x >> U64(2)
                differ += np.bitwise_count(x & lanes)
            alike = ((MINIMA - differ.astype(np.float32)) / MINIMA - chance) / (1 - chance)
            least = np.minimum(m[part][:, None], m[q][None, :])
            fine = (alike >= floor - 1e-6) & (comp[part][:, None] != comp[q][None, :]) & (100 * least >= percent * (n[part][:, None] + n[q][None, :] - least))
            if lo == hi:
                fine &= np.arange(at, at + len(part))[:, None] < np.arange(len(q))[None, :]
            i, j = np.nonzero(fine)
            found.append((part[i], q[j], alike[i, j]))
        i, j, alike = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(-alike, kind="stable")
        up, unpacked, links = list(range(len(group))), {}, ([], [])

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        def shingles_of(r: int) -> np.ndarray:
            if r not in unpacked:
                unpacked[r] = lookup.unpack(blobs[r])
            return unpacked[r]

        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = root(comp[a]), root(comp[b])
            if x == y or min(bands_of[a] & bands_of[b]) != band:
                continue
            both = _overlap(shingles_of(a), shingles_of(b))
            if 100 * both >= percent * (int(n[a]) + int(n[b]) - both):
                up[x] = y
                links[0].append(node[a])
                links[1].append(node[b])
        return pa.table([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])

    return wide.groupBy("band", "lo", "hi").applyInArrow(test, "a long, b long")


def _best(pairs: DataFrame, thin: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), the one of each a that may reach the threshold and is most alike by its signature."""
    of = F.struct("n", "m", "sig")
    pairs = pairs.distinct().join(thin.select(F.col("node").alias("a"), of.alias("fa")), "a").join(thin.select(F.col("node").alias("b"), of.alias("fb")), "b")
    alike = F.struct(estimate(F.col("fa.sig"), F.col("fb.sig")).alias("alike"), "b")
    return pairs.where(_possible("fa", "fb", percent)).groupBy("a").agg(F.max(alike).alias("best")).select("a", "best.b")


def _links(sets: DataFrame, percent: int, star_rounds: int) -> DataFrame | None:
    """Links (a, b) between nodes of ``sets`` that connect all nodes connected by pairs at the threshold."""
    thin = checkpointed(sets.select("node", "n", "m", "sig", "bands"))
    member = thin.select("node", F.explode("bands").alias("band"), salt("node"))
    lead = member.groupBy("band", "salt").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    lead = lead.groupBy("band").agg(F.min("low").alias("b"), F.sum("n").alias("n"), F.bit_or(bit("salt")).alias("salts")).where("n > 1").select("band", "b", "salts")
    pairs = member.join(for_members(lead), ["band", "salt"]).where("node <> b").select(F.col("node").alias("a"), "b")
    links = checkpointed(_confirmed(_best(pairs, thin, percent), sets, percent))
    up = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    top = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
    label = up.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    for turn in range(1, star_rounds + 1):
        labelled = checkpointed(thin.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
        member = labelled.select("node", "component", "n", F.explode("bands").alias("band"), salt("node"))
        sizes = member.groupBy("band", "component", "salt").agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.max("node").alias("high"))
        sizes = sizes.groupBy("band", "component").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("high").alias("high"), F.bit_or(bit("salt")).alias("salts"))
        bands = sizes.groupBy("band").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("within"), F.sum("words").alias("words"), F.max(F.struct("n", "component", "high", "words")).alias("main"), F.bit_or("salts").alias("salts"))
        bands = checkpointed(bands.where("all * all > within"))  # bands of one component are done with
        cross, rows = bands.agg(F.sum((F.col("all") - F.col("within") / F.col("all")) / 2), F.sum("all")).first()
        if not cross:
            return links
        last = turn == star_rounds or cross <= ENUMERATE * rows
        near = member.join(for_members(bands), ["band", "salt"])
        if not last:
            pairs = near.where(F.col("component") != F.col("main.component")).select(F.col("node").alias("a"), F.col("main.high").alias("b"))  # not the first leader again
            found = checkpointed(_confirmed(_best(pairs, thin, percent), sets, percent))
            links = checkpointed(links.unionByName(found))
            old = labelled.select("node", "component")
            into = found.join(old.select(F.col("node").alias("a"), F.col("component").alias("component")), "a").join(old.select(F.col("node").alias("b"), F.col("component").alias("into")), "b")
            into = into.groupBy("component").agg(F.min("into").alias("into"))
            label = old.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
            continue
        of = thin.select("node", F.struct("n", "m", "sig").alias("of"))
        near = checkpointed(near.select("band", "node", "component", "all", "words", F.col("main.n").alias("n_main"), F.col("main.component").alias("main"), F.col("main.words").alias("words_main")).join(of, "node"))
        left = near.where(F.col("all") <= BLOCK_FROM).select("band", F.col("node").alias("a"), F.col("of").alias("fa"), "component")
        right = left.select("band", F.col("a").alias("b"), F.col("fa").alias("fb"), F.col("component").alias("other"))
        pairs = left.join(right, "band").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & _possible("fa", "fb", percent)).select("a", "b").distinct()
        found = _confirmed(pairs, sets, percent).unionByName(_blocked(near.where(F.col("all") > BLOCK_FROM), sets, percent))
        return links.unionByName(found)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", star_rounds: int = 2) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns (doc_id, n_shingles long, component_id, kept boolean), a row for each input row. Words are those of
    ``[^\\x20\\x09-\\x0D]+`` with A-Z folded; a text of fewer than k words is one shingle; null and empty texts have
    none and are linked with nothing. ``component_id`` is the smallest doc_id of the component, and the documents
    of that id are kept. Every row is a document by its text: rows that repeat a doc_id with other texts are linked by
    those texts only. Rows without doc_id are linked like others; a component of none but such has a null id, and all
    of it is kept. Other columns are ignored. Pairs at the threshold are missed with a chance of about 1e-6; whatever
    is linked has been confirmed on full sets. ``star_rounds`` bounds the leaders followed before the remaining pairs
    are enumerated; it changes no result.
    """
    t = docs[text].cast("string")
    # r1 and r2 name a row by its content, so that the text of a class can be found again.
    source = docs.select(docs[doc_id].alias("doc_id"), t.alias("text"), F.xxhash64(docs[doc_id], t).alias("r1"), F.xxhash64(t, docs[doc_id], F.lit(1)).alias("r2"))
    signed = checkpointed(signatures(source, k, bands_for(percent / 100)).select("*", salt(F.monotonically_increasing_id())))
    classes = signed.where("n_shingles > 0").groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("r1", "r2")).alias("r"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.bit_or(bit("salt")).alias("salts"))
    classes = checkpointed(classes.select("f1", "f2", "n", "doc_id", "r.r1", "r.r2", "sig", "bands", "salts", F.monotonically_increasing_id().alias("node")))
    shared = checkpointed(_candidates(classes))
    texts = source.groupBy("r1", "r2").agg(F.first("text").alias("text")).join(shared, ["r1", "r2"])  # rows that repeat become one in their task
    sets = checkpointed(_matchable(_sets(texts, k), 8 * (shared.agg(F.sum("n")).first()[0] or 0), percent))
    label = components(_links(sets, percent, max(1, star_rounds)))
    label = label.join(classes.select("node", "doc_id"), "node").select("node", "component", "doc_id", salt("node"))
    least = label.groupBy("component", "salt").agg(F.min("doc_id").alias("low"))
    least = least.groupBy("component").agg(F.min("low").alias("component_id"), F.bit_or(bit("salt")).alias("salts"))
    label = label.join(for_members(least), ["component", "salt"]).select("node", "component_id", F.lit(True).alias("linked"))
    named = classes.select("f1", "f2", "n", "node", "doc_id", "salts").join(label, "node", "left")
    named = named.select("f1", "f2", F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "salts")
    out = signed.where("n_shingles > 0").join(for_members(named), ["f1", "f2", "n_shingles", "salt"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` on four-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
