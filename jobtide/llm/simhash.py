"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints have 64 bits. Two that differ in at most two bits agree on at least two of their four
16-bit bands, so each is put under six keys of two bands. Within a key, bit planes are stored
vertically: one bit of many comparisons stands in one run of words, and distances of all of them are
counted at once by carry-save counters. A block is given up once all its distances exceed the radius.
Keys with many fingerprints are cut into chunks by a hash, and each pair of chunks is a group of its own,
so no task gets an unbounded group. A group gives one link from each member to the smallest member that
it is connected with, never all pairs.

Nulls count as empty texts; texts without words have the fingerprint zero, linked like any other. Equal
fingerprints belong together. Rows without ``doc_id`` have a fingerprint and belong to a component, but
name none. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import free_name, ready, stored

RADIUS = 2
CHUNK = 2048
LANES = 1 << 19
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the hashes of the text's word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    whole, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash_of(whole, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    end = (begin + size)[width - 1 :].tolist()
    count, n = np.zeros(64, np.int64), len(end)
    for at in range(0, n, 1 << 15):
        hashes = np.array([hash_of(whole[a:b], seed) for a, b in zip(begin[at : at + (1 << 15)].tolist(), end[at : at + (1 << 15)], strict=False)], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        for part in range(0, len(bits), 255):
            count += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(count * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tie, fp`` of every row; tie is a hash of the text, fp the fingerprint as a signed 64-bit integer."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "tie", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, "doc_id long, tie long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all values, eight values to a byte."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits, axis=0).T.copy()


def within(differences: Iterator[np.ndarray], n: int, radius: int = RADIUS) -> np.ndarray:
    """Which of n lanes differ in at most radius planes.

    Each lane's count is kept in bit-sliced counters; a lane that has reached radius + 1 stays out.
    """
    limit = radius + 1
    counters: list[np.ndarray] = []
    over = None
    for k, carry in enumerate(differences):
        if over is None:
            counters = [np.zeros_like(carry) for _ in range(limit.bit_length())]
            over = np.zeros_like(carry)
            over[n // 8 :] = np.packbits(np.arange(n // 8 * 8, len(carry) * 8) >= n)
        for j, c in enumerate(counters):
            up = c & carry
            counters[j] = c ^ carry
            carry = up
        reached = np.full_like(over, 255)
        for j, c in enumerate(counters):
            reached &= c if limit >> j & 1 else ~c
        over |= reached
        if k % 4 == 3 and (over == 255).all():
            return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits(~over)[:n])


def matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, one in each, whose values differ in at most RADIUS bits: one query against a block."""
    block, a, b = planes(right), [], []
    for i, value in enumerate(left.tolist()):
        if len(hit := within((~block[p] if value >> (63 - p) & 1 else block[p] for p in range(64)), len(right))):
            a.append(np.full(len(hit), i))
            b.append(hit)
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def lane_matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places at which left and right differ in at most RADIUS bits: each lane is a pair of its own."""
    out = []
    for at in range(0, len(left), LANES):
        block = planes(left[at : at + LANES] ^ right[at : at + LANES])
        out.append(at + within(iter(block), min(LANES, len(left) - at)))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root


def _links(fps: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in groups of fingerprints. Rows stand by group and side; side 0 and 1 are compared with each other, side 2 with itself."""
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edge, len(group)])
    a, b = [], []
    small = np.flatnonzero((size > 1) & (size <= 32))
    for s in np.unique(size[small]).tolist():
        i, j = np.triu_indices(s, 1)
        base = edge[small[size[small] == s]]
        step = max(1, LANES // len(i))
        for at in range(0, len(base), step):
            left, right = (base[at : at + step, None] + i).ravel(), (base[at : at + step, None] + j).ravel()
            hit = lane_matches(fps[left], fps[right])
            a.append(left[hit])
            b.append(right[hit])
    for k in np.flatnonzero(size > 32).tolist():
        lo, hi = edge[k], edge[k] + size[k]
        mid = lo + int((side[lo:hi] == 0).sum())
        i, j = matches(fps[lo:hi], fps[lo:hi]) if mid == lo else matches(fps[lo:mid], fps[mid:hi])
        a.append(lo + i)
        b.append((lo if mid == lo else mid) + j)
    if not a:
        return fps[:0], fps[:0]
    root = roots(len(fps), np.concatenate(a), np.concatenate(b))
    far = np.flatnonzero(root != np.arange(len(fps)))
    return fps[far], fps[root[far]]


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column fp) within the radius of each other."""
    ready(distinct.sparkSession)
    band = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    two = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[F.lit(k << 32) + F.shiftleft(band(i), 16) + band(j) for k, (i, j) in enumerate(two)])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    cut = keyed.join(shared, "key").select("fp", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("own"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sides = other.select(
        "fp", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    dealt = sides.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush(rest: bool) -> Iterator[pa.RecordBatch]:
            """All groups but the last, which may go on in the next batch."""
            nonlocal kept
            rows = pa.Table.from_batches(kept)
            fp, key, x, y, side = (rows.column(c).to_numpy() for c in ("fp", "key", "x", "y", "side"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            end = len(fp) if rest else (int(new[-1]) if len(new) else 0)
            group = np.zeros(len(fp), np.int64)
            group[new] = 1
            a, b = _links(fp[:end], np.cumsum(group)[:end], side[:end])
            kept = rows.slice(end).combine_chunks().to_batches() if end < len(fp) else []
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= 16 * CHUNK:
                yield from flush(False)
        if kept:
            yield from flush(True)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of the links (a, b) is connected with.

    Each round every node hands its larger neighbours, then its smaller ones, to the smallest node around
    (Kiveris et al., Connected Components in MapReduce and Beyond, 2014), until the links stay the same.
    """

    def around(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(least, "a")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.sparkSession, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(now)
    while True:
        large = around(now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(edges.sparkSession, small.select("e.*").where("a <> b").distinct(), "links")
        if (new := state(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = new


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; component_id is the smallest id of its component."""
    spark = docs.sparkSession
    marked = stored(spark, fingerprints(docs), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(first.select("fp")))
    rooted = first.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id and then hash of its text, with all columns.

    Rows without ``doc_id`` come last. Of rows that repeat id and text, one stays: the least by all columns.
    """
    spark = docs.sparkSession
    marked = stored(spark, fingerprints(docs), "fingerprints")
    roots = components(links(marked.select("fp").distinct())).withColumnRenamed("node", "fp")
    rows = marked.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"), "doc_id", "tie").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("e"))
    stays = F.col("doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("tie") == F.col("e.tie"))
    left, right, stay, row = (free_name(docs, c) for c in ("left_key", "right_key", "stay", "row"))
    key = lambda d, t: F.struct(d.isNull().alias("a"), F.coalesce(d, F.lit(0)).alias("b"), t.alias("c"))
    chosen = stored(spark, rows.join(least, "root").select(key(F.col("doc_id"), F.col("tie")).alias(right), "n", stays.alias(stay)), "kept-documents")
    gone, twice = chosen.where(~F.col(stay)).select(right), chosen.where(F.col(stay) & (F.col("n") > 1)).select(right)
    keyed = docs.withColumn(left, key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    if twice.isEmpty():
        return keyed.join(gone, F.col(left) == F.col(right), "left_anti").select(*docs.columns)
    alone = keyed.join(gone.union(twice), F.col(left) == F.col(right), "left_anti").select(*docs.columns)
    again = keyed.join(twice, F.col(left) == F.col(right), "left_semi").groupBy(left).agg(F.min(F.struct(*docs.columns)).alias(row))
    return alone.unionByName(again.select(f"{row}.*"))
