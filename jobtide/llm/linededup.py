"""Near-duplicate lines by a deletion-neighbourhood join over words.

Lines are compared by their words (runs between white space); only lines without any word stay as they are.
Among equal lines the earliest stays, however short. A line also goes if an earlier one differs from it by at
most one word in `NEAR_WORDS` of the longer line, rounded down: words replaced, put in or taken out. So the
similarity, one less edits by words, is 0.8 or more.

Lines that may be within the bound are found by their deletion neighbourhoods, as hashed keys: equal keys are joined, the words
decide, and the earliest stays. A key needs no list of its lines, only the earliest, so a key of very many lines is a
minimum like any other.

- Lines of four to nine words emit themselves and every variant with one word deleted. Two lines a word apart share a key with
  the same place deleted (one word replaced), or with one of them whole (one word more).
- Lines of eight words and more are cut into pieces of some two words, before the words of least hash, so that cuts survive edits
  elsewhere. Every window of three pieces emits its variants with one piece deleted: pairs of neighbours, and pairs
  with one left out. Of these a line keeps the `LEAST` with the least hashes, which lines with many keys in
  common choose alike. Against plain distances that finds all but a few in a thousand of the lines of documents, and
  19 in 20 of lines that were changed at random up to the bound (both in the tests); `exact` finds all of them at some
  three times the cost.

Only keys that two different lines share go on; a bit map of them, sized by their number, spares the others the shuffle, and where
they are too many for one the join alone decides. Only lines of candidate pairs are fetched from the texts for the verification.

The exact way: one edit is found by variants with one word deleted, of lines whose halves some other line shares; more edits
by shared pairs of neighbouring words. An edit touches two pairs at most, so of the M - 1
pairs of the longer line all but twice the bound stand in the other line too. Pairs have one order for all
lines, the rare ones first, and two lines within the bound share one among the first few of each, however
they are ordered: what is left out of a prefix is fewer pairs than must be shared. The counts behind the order come
from a sample, which changes the work but not what is found. Keys travel as bytes, a row for all keys of a part that a
task has met. Lines are compared with the earliest line of each of their keys that may be within the bound by the number of its words
and by its marks, then those still open with every such one; the words decide. Marks are bits, each word turning one over, so an edit turns
two at most, or one if it puts a word in or takes it out. Shared keys are gone through in `PASSES` passes, and tables and shuffle files go as soon as they are read, since the keys
of all lines are larger than the texts as stored.

Order is by doc_id (nulls first), a hash of the text, and the line's number. Rows that repeat both id and
text are one document: what holds for one holds for each. Nulls have no lines and stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide import storage
from jobtide.llm.common import free_name, ready, stored
from jobtide.llm.fuzzyhash import distance

#: Words of a line that is compared at all, and of the longer of two lines that may differ by a word.
MIN_WORDS, NEAR_WORDS = 1, 5
#: Bytes of text that are cut and hashed at once, bits of a map for each key in it, the fewest, and the most bits of a map.
CHUNK_BYTES, KEY_BITS, LEAST_BITS, MAP_BITS = 1 << 20, 16, 3, 1 << 28
#: The longest line that emits its variants with a word deleted and the shortest that is cut into pieces; words of a piece,
#: pieces apart of the two of a key, keys of a line, and lines that are cut at once.
SHORT, LONG, PIECE, APART, LEAST, CUT_LINES = 9, 8, 2, 2, 8, 1 << 16
#: Lines of fewer words are cut before this share of all words.
FEW_WORDS, CUTTING = 20, 0.6
#: Edits up to which two lines are compared along diagonals.
FEW = 8
#: Variants of a batch.
VARIANTS = 200_000
BASE, BYTE_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Buckets in which pairs are counted, parts in which they are summed, in one text of so many, and the most lines whose pairs are sorted at once.
PAIR_BUCKETS, PAIR_PARTS, PAIR_SAMPLE, PAIR_LINES = 1 << 20, 64, 16, 1 << 16
#: The fewest words of a line that may be two edits from another.
PAIR_WORDS = 2 * NEAR_WORDS - 2
#: Bits of a line's marks, lines that are marked at once, keys that are dealt out at once, pairs that are told apart at once, earliest
#: lines of a key that are tried one by one, and passes over the shared keys.
MARK_BITS, MARK_LINES, DEALT, TRIED, ONE_BY_ONE, PASSES = 256, 1 << 13, 1 << 20, 1 << 20, 8, 4
LINE = "doc_id long, tie long, line int, n int, whole long, halves array<long>, marks binary"
#: What is known of a line while its keys are compared: its order number, its words, the marks, and whether it is compared with all lines.
KNOWN = np.dtype([("ord", "<i8"), ("n", "<i4"), ("open", "?"), ("marks", "<u8", MARK_BITS // 64)])


def _powers(n: int, base: int) -> np.ndarray:
    """base to the power 0 to n - 1, modulo 2 to the 64."""
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    x = x + np.asarray(kind).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(33)).view(np.int64)


_BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64), 1).view(np.uint64)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, given where its bytes begin and end: sums of byte values times powers, mixed."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES)))
        # words and what lies between them take turns; sums of the latter are left out
        edges = np.empty(2 * (to - at), np.int64)
        edges[::2], edges[1::2] = start[at:to], end[at:to]
        edges -= start[at]
        size = np.diff(edges)
        place = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
        value = _BYTE[raw[start[at] : end[to - 1]]] * _powers(int(size.max()), BYTE_BASE)[place]
        out[at:to] = _mixed(np.add.reduceat(value, edges[:-1])[::2], size[::2]).view(np.uint64)
        at = to
    return out


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `CHUNK_BYTES`, each with the row it begins at; nulls are empty."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts.cast(pa.binary())):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


class Cut:
    """The words of texts: hashes of runs of them, and the words and lines at which lines and texts begin.

    The hash of a run is the sum of word hashes times powers of an odd base, from running totals.
    """

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        self.words = np.r_[0, np.searchsorted(start, np.flatnonzero(raw == 10)), len(start)]
        self.lines = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
        self.power = _powers(len(start) + 1, BASE)
        self.inverse = _powers(len(start) + 1, pow(BASE, -1, 1 << 64))
        self.hash = _hashes(raw, start, end)
        self.total = np.zeros(len(start) + 1, np.uint64)
        np.cumsum(self.hash * self.power[:-1], out=self.total[1:])

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the words from a up to b, the same wherever they stand."""
        return (self.total[b] - self.total[a]) * self.inverse[a]

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The hash of the words from a up to b without word i."""
        return self.run(a, i) + self.power[i - a] * self.run(i + 1, b)


def lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The lines of at least so many words: where they stand, their hash, the hashes of their halves, and their marks."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(2)):
                cut = Cut(texts)
                line = np.flatnonzero(np.diff(cut.words) >= least)
                row = np.searchsorted(cut.lines, line, side="right") - 1
                a, b = cut.words[line], cut.words[line + 1]
                n = b - a
                # the middle of a line of n words, and where it lies if the other line has a word less
                halves = []
                for m in (n, np.where(n < NEAR_WORDS, n, n - 1)):
                    halves.append(_mixed(cut.run(a, a + m // 2), 2 * (m // 2)))
                    halves.append(_mixed(cut.run(b - (m - m // 2), b), 2 * (m - m // 2) + 1))
                ends = pa.array(np.arange(0, 4 * len(n) + 1, 4, dtype=np.int32))
                take = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array((line - cut.lines[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(_mixed(cut.run(a, b), n)), pa.ListArray.from_arrays(ends, pa.array(np.stack(halves, 1).ravel())),
                        _blobs(_marks(cut, a, n), np.arange(len(n))),
                    ],
                    [c.split()[0] for c in LINE.split(", ")],
                )

    return _keyed(docs).mapInArrow(run, LINE)


def _marks(cut: Cut, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """`MARK_BITS` of each line, each word turning one over: an edit turns two over at most."""
    out = np.empty((len(n), MARK_BITS // 8), np.uint8)
    for at in range(0, len(n), MARK_LINES):
        some = n[at : at + MARK_LINES]
        owner = np.repeat(np.arange(len(some)), some)
        word = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(a[at : at + MARK_LINES], some)
        cell = owner * MARK_BITS + (cut.hash[word] >> np.uint64(20) & np.uint64(MARK_BITS - 1)).astype(np.int64)
        odd = np.bincount(cell, minlength=len(some) * MARK_BITS) & 1
        out[at : at + MARK_LINES] = np.packbits(odd.astype(np.uint8).reshape(-1, MARK_BITS), axis=1)
    return out


def _blobs(rows: np.ndarray, start: np.ndarray) -> pa.Array:
    """The bytes of the rows, as one binary value from each start to the next."""
    rows = np.ascontiguousarray(rows)
    size = rows.nbytes // max(len(rows), 1)
    ends = np.r_[start, len(rows)].astype(np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))


class Bits:
    """A map of two slots for each of some hashes, sized by their number; few other hashes find both of theirs taken."""

    def __init__(self, size: int, held: bytes) -> None:
        self.size, self.held = size, held

    def there(self, hashed: np.ndarray) -> np.ndarray:
        held, mask = np.frombuffer(self.held, np.uint8), self.size - 1
        out = np.ones(len(hashed), bool)
        for slot in (hashed & mask, hashed >> 32 & mask):
            out &= held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
        return out


def _map(slots: DataFrame, count: int) -> Bits | None:
    """The map of the column ``h``, 62 bits of a hash; None where `MAP_BITS` are too few, so that nothing is sent round."""
    if count * LEAST_BITS > MAP_BITS:
        return None
    size = min(max(1 << 15, 1 << (KEY_BITS * count - 1).bit_length() if count else 0), MAP_BITS)
    both = F.array(*[h.bitwiseAND(F.lit(size - 1)) for h in (F.col("h"), F.shiftright("h", 32))])
    slot = slots.select(F.explode(both).alias("s"))
    # slot 0 has a bucket number of its own: numbers count from 1, places from 0 within
    parts = slot.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    whole = bytearray(size // 8 + 4096)
    zero = False
    for b, bits in parts:
        if b == 0:
            zero = True
        else:
            whole[(b - 1) * 4096 : (b - 1) * 4096 + len(bits)] = bits
    # slot s > 0 is bit s - 1 of the buckets
    bits = np.frombuffer(whole, np.uint8)[: max(size // 8, 1)]
    out = bits << np.uint8(1)
    out[1:] |= bits[:-1] >> np.uint8(7)
    out[0] |= zero
    return Bits(size, out.tobytes())


def _document():
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("tie"))


def _documents(keys: DataFrame) -> Bits | None:
    """The map of the documents that stand in keys."""
    per = keys.select(_document().alias("h")).distinct()
    return _map(per, per.count())


def _chosen(docs: DataFrame, bits: Bits | None, inside: bool) -> DataFrame:
    """The rows, with all columns, whose document stands in the map, or does not; without a map all may."""
    if bits is None:
        return docs if inside else docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    slot = free_name(docs, "slot")
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text"))
    cells = docs.withColumn(slot, hashed)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = sent.value.there(batch.column(width).to_numpy())
            yield batch.select(batch.schema.names[:width]).filter(pa.array(there == inside))

    return cells.mapInArrow(run, docs.schema)


def _order():
    return F.struct("doc_id", "tie", "line")


class _Scratch:
    """Tables written below the shared folder by name, added to if there, and deleted as soon as they are of no more use."""

    def __init__(self, spark) -> None:
        self.spark, self.paths = spark, {}

    def kept(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.paths.setdefault(name, storage.scratch(self.spark, name))
        # hashes have no repeats that a dictionary could spare
        with storage.shuffles_dropped(self.spark):
            frame.write.mode("append").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            storage.delete(self.spark, self.paths.pop(name))


def repeated(docs: DataFrame, least: int = NEAR_WORDS) -> DataFrame:
    """``doc_id, tie, line`` of every line that goes, and where the earlier one stands (``first``).

    Lines of fewer than `least` words stay; with `MIN_WORDS` all that have a word are compared.
    """
    spark = docs.sparkSession
    scratch = _Scratch(spark)
    kept = scratch.kept
    found = kept(lines(docs, least), "lines")
    per = found.groupBy("whole", "n").agg(F.min(_order()).alias("first"), F.first("marks").alias("marks"), F.count(F.lit(1)).alias("c"))
    # numbers in the order of lines
    firsts = kept(per.orderBy("first").withColumn("ord", F.monotonically_increasing_id()), "first-lines")
    place = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tie") == F.col("tie")) & (F.col("first.line") == F.col("line"))
    again = firsts.where("c > 1").select("whole", "n", "first")
    exact = kept(found.select("doc_id", "tie", "line", "n", "whole").join(again, ["whole", "n"]).where(~place).select("doc_id", "tie", "line", "first"), "repeated-lines")
    suspects = kept(_distinct_lines(_shared(_halves(found))), "suspect-lines")
    scratch.drop("lines")
    shared = kept(_shared(_keys(docs, _map_of(suspects, "whole"), least)), "shared-keys")

    def compared(again: Bits | None, every: bool, name: str) -> DataFrame:
        # a pass over the keys of some parts at a time, with what is known of their lines
        for k in range(PASSES):
            pairs = kept(_candidates(shared.where(F.col("part") % PASSES == k), firsts, again, every), name)
        return pairs.distinct()

    first_pairs = compared(None, False, "first-pairs")
    near = _verified(docs, firsts, first_pairs, scratch)
    still = kept(first_pairs.select("ord").distinct().join(near, "ord", "left_anti").join(firsts.select("ord", "whole"), "ord"), "open-lines")
    if not still.isEmpty():
        # lines whose earliest candidates were too far meet all others
        others = compared(_map_of(still, "whole"), True, "open-pairs").join(still.select("ord"), "ord", "left_semi").join(first_pairs, ["ord", "near"], "left_anti")
        near = _verified(docs, firsts, others, scratch)
    at = firsts.select("ord", "first")
    ends = near.join(at, "ord").select("first.*", "near").join(at.withColumnsRenamed({"ord": "near"}), "near").select("doc_id", "tie", "line", "first")
    with storage.shuffles_dropped(spark):
        gone = stored(spark, exact.unionByName(ends), "repeated-lines")
    scratch.drop()
    return gone


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, scratch: _Scratch) -> DataFrame:
    """``ord, near``: the lines that are in fact within the bound of another, and the earliest of those, by their words; those of earlier calls too."""
    pairs = scratch.kept(pairs, "line-pairs")
    ends = pairs.select("ord").union(pairs.select("near")).distinct()
    wanted = scratch.kept(firsts.join(ends, "ord").select(F.col("ord").alias("whole"), "first.*"), "wanted-lines")
    texts = scratch.kept(_fetched(docs, wanted), "line-texts")

    @F.pandas_udf("boolean")
    def close(a, b):
        import pandas as pd

        return pd.Series([within_one(x.encode().split(), y.encode().split()) for x, y in zip(a, b, strict=True)], dtype="bool")

    own, other = texts.withColumnsRenamed({"whole": "ord", "words": "own_words"}), texts.withColumnsRenamed({"whole": "near", "words": "other_words"})
    near = pairs.join(own, "ord").join(other, "near").where(close("own_words", "other_words")).groupBy("ord").agg(F.min("near").alias("near"))
    near = scratch.kept(near, "near-lines")
    scratch.drop("line-pairs", "wanted-lines", "line-texts")
    return near


def _pairs(cut: Cut, line: np.ndarray, rare: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of neighbouring words of some of the lines: their lines, the pairs in order within each, and bucket numbers.

    A pair is 6 bits of how often its bucket was counted, then its hash.
    """
    for at in range(0, len(line), PAIR_LINES):
        a = cut.words[line[at : at + PAIR_LINES]]
        n = cut.words[line[at : at + PAIR_LINES] + 1] - a - 1
        owner = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + a[owner]
        pair = _mixed(cut.run(i, i + 2), 2).view(np.uint64)
        bucket = (pair & np.uint64(PAIR_BUCKETS - 1)).astype(np.int64)
        if rare is None:
            yield at + owner, pair, bucket
            continue
        both = np.sort(owner.astype(np.uint64) << np.uint64(48) | rare[bucket].astype(np.uint64) << np.uint64(42) | pair >> np.uint64(22))
        yield at + owner, both & np.uint64((1 << 48) - 1), bucket


def _rare(docs: DataFrame) -> np.ndarray:
    """The logarithm of how often pairs of each bucket were met in a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIR_BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(2)):
                cut = Cut(texts)
                for _, _, bucket in _pairs(cut, np.flatnonzero(np.diff(cut.words) >= PAIR_WORDS), None):
                    total += np.bincount(bucket, minlength=PAIR_BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PAIR_PARTS, dtype=np.int32)), _blobs(total, np.arange(PAIR_PARTS) * (PAIR_BUCKETS // PAIR_PARTS))], ["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(counts.as_buffer(), "<i8")
                totals[part] = totals[part] + counts if part in totals else counts
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), _blobs(np.log2(np.maximum(total, 1)).astype(np.uint8), np.zeros(1, np.int64))], ["part", "logs"])

    counted = _keyed(docs).where(F.pmod("tie", F.lit(PAIR_SAMPLE)) == 0).mapInArrow(run, "part int, counts binary")
    out = np.zeros((PAIR_PARTS, PAIR_BUCKETS // PAIR_PARTS), np.uint8)
    with storage.shuffles_dropped(docs.sparkSession):
        # numbers of one byte, whatever was counted
        for part, logs in counted.repartition("part").mapInArrow(summed, "part int, logs binary").collect():
            out[part] = np.frombuffer(logs, np.uint8)
    return out.ravel()


def _pair_keys(cut: Cut, line: np.ndarray, n: np.ndarray, rare: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each line, of which two lines within the bound share one at least: keys and the lines' places in `line`."""
    # the longest prefix that any other line of n or more words needs: those of n, or of the next bound
    up = -(-n // NEAR_WORDS) * NEAR_WORDS
    reach = 1 + np.maximum(2 * (n // NEAR_WORDS), n - up + 2 * (up // NEAR_WORDS))
    for owner, pair, _ in _pairs(cut, line, rare):
        new = np.r_[True, owner[1:] != owner[:-1]]
        place = np.arange(len(owner)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        fresh = new | np.r_[True, pair[1:] != pair[:-1]]
        # the second of equal pairs is another key
        nth = np.arange(len(owner)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        some = place < reach[owner]
        yield _mixed(pair[some], 3 + nth[some]), owner[some]


def _variant_keys(cut: Cut, a: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each line whole and without each of its words: keys and the lines' places in `a`."""
    # a line too short to differ from one of its length, or a shorter one, has no variants but itself
    cuts = np.where(n < NEAR_WORDS, 0, n)
    ends = np.cumsum(cuts + 1)
    # a long line is more than one part
    for at in range(0, int(ends[-1]) if len(ends) else 0, VARIANTS):
        every = np.arange(at, min(at + VARIANTS, int(ends[-1])))
        owner = np.searchsorted(ends, every, side="right")
        place = every - (ends - cuts - 1)[owner] - 1
        lo, some = a[owner], place >= 0
        hi = lo + n[owner]
        key = cut.run(lo, hi)
        key[some] = cut.without(lo[some], hi[some], (lo + place)[some])
        yield _mixed(key, n[owner] - some), owner


# Keys are many, so rows are not: a row holds all keys of a part, as bytes, that a task has met.


def _part_bits(spark) -> int:
    """Bits of the number of a part: parts are some more than partitions."""
    return min(12, max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _dealt(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part, with the bytes of its entries."""
    turn = np.argsort(part.astype(np.uint16), kind="stable")
    part = part[turn]
    start = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    return pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), *[_blobs(x[turn], start) for x in columns.values()]], ["part", *columns])


def _gathered(batches: Iterator[pa.RecordBatch], *kinds: str | np.dtype) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The parts of a task, one after the other, and their columns whole."""
    held: dict[int, list[list[pa.Buffer]]] = {}
    for batch in batches:
        columns = batch.columns
        for k, part in enumerate(columns[0].to_pylist()):
            held.setdefault(part, []).append([c[k].as_buffer() for c in columns[1:]])
    for part in sorted(held):
        rows = held.pop(part)
        yield part, [np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(kinds)]


def _in_bulk(pieces: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of some pieces in one, as soon as they have so many rows: few rows are not worth dealing out."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _dealt_keys(pieces: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Keys and their lines, dealt out by the first bits of the key."""
    for key, whole in _in_bulk(pieces, DEALT):
        key = key.view(np.uint64)
        yield _dealt(key >> np.uint64(64 - bits), keys=key.astype(np.uint32), wholes=whole)


DEALT_KEYS = "part int, keys binary, wholes binary"


def _keys(docs: DataFrame, suspects: Bits | None, least: int) -> DataFrame:
    """The keys of all lines: prefixes of pairs, and of the suspects, or without a map of all, the variants with a word deleted."""
    spark = docs.sparkSession
    sent, bits = spark.sparkContext.broadcast((_rare(docs), suspects)), _part_bits(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rare, suspects = sent.value
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                cut = Cut(texts)
                line = np.flatnonzero(np.diff(cut.words) >= max(least, NEAR_WORDS - 1))
                a, b = cut.words[line], cut.words[line + 1]
                whole = _mixed(cut.run(a, b), b - a)
                whole, one = np.unique(whole, return_index=True)
                line, a, n = line[one], a[one], (b - a)[one]
                some = np.flatnonzero(n >= PAIR_WORDS)
                for key, owner in _pair_keys(cut, line[some], n[some], rare):
                    yield key, whole[some[owner]]
                some = np.arange(len(n)) if suspects is None else np.flatnonzero(suspects.there(whole >> 2))
                for key, owner in _variant_keys(cut, a[some], n[some]):
                    yield key, whole[some[owner]]

    return docs.select(F.col("text").cast("string")).mapInArrow(lambda batches: _dealt_keys(keys(batches), bits), DEALT_KEYS)


def _halves(found: DataFrame) -> DataFrame:
    """The halves of lines as keys."""
    bits = _part_bits(found.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            half = batch.column(1)
            yield half.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), np.diff(half.offsets.to_numpy()))

    # lines of fewer words than these have none but equal partners
    return found.where(F.col("n") >= NEAR_WORDS - 1).select("whole", "halves").mapInArrow(lambda batches: _dealt_keys(keys(batches), bits), DEALT_KEYS)


def _shared(dealt: DataFrame) -> DataFrame:
    """The entries, in order, of those keys that two different lines hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (key, whole) in _gathered(batches, "<u4", "<i8"):
            both = key.astype(np.uint64) << np.uint64(32) | whole.view(np.uint64) >> np.uint64(32)
            turn = np.argsort(both)
            key, whole = key[turn], whole[turn]
            new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
            key, whole = key[new], whole[new]
            same = key[1:] == key[:-1]
            some = np.r_[False, same] | np.r_[same, False]
            if some.any():
                yield _dealt(np.full(int(some.sum()), part), keys=key[some], wholes=whole[some])

    return dealt.repartition("part").mapInArrow(run, DEALT_KEYS)


def _distinct_lines(shared: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(whole.as_buffer(), "<i8")))], ["whole"])

    return shared.select("wholes").mapInArrow(run, "whole long").distinct()


def _close(n: np.ndarray, marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether lines may be within the bound, by the number of their words and their marks."""
    most, more = np.maximum(n[i], n[j]), np.abs(n[i] - n[j])
    out = more * NEAR_WORDS <= most
    some = np.flatnonzero(out)
    # words that one line has and the other has not, on both sides, are no fewer than the bits that differ; an edit takes one of each side
    turned = np.bitwise_count(marks[i[some]] ^ marks[j[some]]).sum(1, dtype=np.int64)
    out[some] = turned + more[some] <= 2 * (most[some] // NEAR_WORDS)
    return out


def _earlier(key: np.ndarray, known: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each line, with each of its keys, the earliest line that may be within the bound, or every one; by their order numbers."""
    turn = np.lexsort((known["ord"], key))
    key, order = key[turn], known["ord"][turn]
    once = np.r_[True, (key[1:] != key[:-1]) | (order[1:] != order[:-1])]
    key, order, known = key[once], order[once], known[turn[once]]
    n, marks = known["n"].copy(), np.ascontiguousarray(known["marks"])
    new = np.r_[True, key[1:] != key[:-1]]
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    left = np.flatnonzero(known["open"] & ~new)
    done = 0
    # most lines that are close to any are close to one of the first
    while not every and done < ONE_BY_ONE and len(left):
        at = start[left] + done
        close = _close(n, marks, at, left)
        yield order[left[close]], order[at[close]]
        done += 1
        left = left[~close & (start[left] + done < left)]
    many = left - start[left] - done
    ends = np.cumsum(many)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + TRIED)))
        j = np.repeat(left[at:to], many[at:to])
        i = np.arange(len(j)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to]) + start[j] + done
        close = _close(n, marks, i, j)
        i, j = i[close], j[close]
        if not every:
            one = np.r_[True, j[1:] != j[:-1]][: len(j)]
            i, j = i[one], j[one]
        yield order[j], order[i]
        at = to


def _candidates(shared: DataFrame, firsts: DataFrame, again: Bits | None, every: bool) -> DataFrame:
    """``ord, near``: lines that share a key with an earlier one that may be within the bound.

    Of each line and key the earliest of these, or for the lines in the map, without a map for all, every one.
    """
    spark = shared.sparkSession
    sent, bits = spark.sparkContext.broadcast(again), _part_bits(spark)
    shift = np.uint64(64 - bits)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            whole = batch.column(0).to_numpy()
            rows = np.zeros(len(whole), KNOWN)
            rows["ord"], rows["n"] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows["marks"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(len(whole), -1)
            rows["open"] = sent.value is None or sent.value.there(whole >> 2)
            yield whole, rows

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for part, key, whole in zip(*batch.columns, strict=True):
                key, whole = np.frombuffer(key.as_buffer(), "<u4"), np.frombuffer(whole.as_buffer(), "<i8")
                if sent.value is not None:
                    # keys without a line of the map have nothing to tell
                    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
                    some = np.bincount(group, sent.value.there(whole >> 2))[group] > 0
                    key, whole = key[some], whole[some]
                yield whole, np.uint64(part.as_py()) << np.uint64(32) | key.astype(np.uint64)

    def known_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, rows in _in_bulk(known(batches), DEALT // 4):
            yield _dealt(whole.view(np.uint64) >> shift, wholes=whole, known=rows, keys=np.empty(len(whole), "V0"))

    def entries_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, keys in _in_bulk(entries(batches), DEALT // 4):
            yield _dealt(whole.view(np.uint64) >> shift, wholes=whole, known=np.empty(len(whole), "V0"), keys=keys)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for k, part in enumerate(batch.column(0).to_pylist()):
                held.setdefault(part, []).append(tuple(c[k].as_buffer() for c in batch.columns[1:]))
        for part in sorted(held):
            rows = held.pop(part)
            line, of = (np.frombuffer(b"".join(r[0] for r in rows if (r[1].size > 0) == is_known), "<i8") for is_known in (True, False))
            known, key = np.frombuffer(b"".join(r[1] for r in rows), KNOWN), np.frombuffer(b"".join(r[2] for r in rows), "<u8")
            if not len(line):
                continue
            turn = np.argsort(line)
            line, known = line[turn], known[turn]
            for at in range(0, len(key), DEALT // 4):
                some = of[at : at + DEALT // 4]
                place = np.minimum(np.searchsorted(line, some), len(line) - 1)
                # lines of too few words are not among the first
                there = line[place] == some
                mine, place = key[at : at + DEALT // 4][there], place[there]
                if len(mine):
                    yield _dealt(mine >> np.uint64(32), keys=mine.astype(np.uint32), known=known[place])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, known) in _gathered(batches, "<u4", KNOWN):
            found = [np.stack(x, 1) for x in _earlier(key, known, every)]
            if found and len(both := np.unique(np.concatenate(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["ord", "near"])

    dealt = "part int, wholes binary, known binary, keys binary"
    lines_of = firsts.select("whole", "ord", "n", "marks").mapInArrow(known_dealt, dealt).unionByName(shared.select("part", "keys", "wholes").mapInArrow(entries_dealt, dealt))
    return lines_of.repartition("part").mapInArrow(met, "part int, keys binary, known binary").repartition("part").mapInArrow(pairs, "ord long, near long")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edits between the words are within one in `NEAR_WORDS` words of the longer line."""
    bound = max(len(a), len(b)) // NEAR_WORDS
    if a == b:
        return True
    if abs(len(a) - len(b)) > bound or not bound:
        return False
    # what both begin and end with takes no edit, and the rest no more than it has words
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(a), len(b)) <= bound:
        return True
    # a word that the other line does not hold takes an edit of its own
    one, other = set(a), set(b)
    if len(one - other) > bound or len(other - one) > bound:
        return False
    # how far each diagonal gets with a number of edits (Ukkonen, Algorithms for Approximate String Matching, 1985)
    goal, far = len(b) - len(a), {}
    for edits in range(bound + 1):
        if edits > FEW:
            # diagonals pay while there are few of them
            return distance(a, b) <= bound
        now = {}
        for d in range(-edits, edits + 1):
            x = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1) if edits else 0
            x = min(x, len(a), len(b) - d)
            if x < 0 or x + d < 0:
                continue
            while x < len(a) and x + d < len(b) and a[x] == b[x + d]:
                x += 1
            now[d] = x
        if now.get(goal, -1) >= len(a):
            return True
        far = now
    return False


# --- deletion neighbourhoods alone --------------------------------------------------------------

KEYED = "doc_id long, tie long, line int, n int, whole long, keys array<long>"
#: Of a key the lowest bit says that it is one of a whole line and its variants, the next that the line stands there whole.
_WHOLE, _SELF = 1, 2
_PLAIN = np.uint64(_MASK ^ 3)


def _short_keys(cut: Cut, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of some short lines and their keys: the line whole, and without each of its words."""
    if not len(line):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    a, b = cut.words[line], cut.words[line + 1]
    n = b - a
    whole = _mixed(cut.run(a, b), n).view(np.uint64) & _PLAIN | np.uint64(_WHOLE | _SELF)
    # lines of fewer than five words are variants of longer ones only
    cuts = np.where(n < NEAR_WORDS, 0, n)
    owner = np.repeat(np.arange(len(n)), cuts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    left = _mixed(cut.without(a[owner], b[owner], a[owner] + place), n[owner] - 1).view(np.uint64)
    by_place = _mixed(left, place + 5).view(np.uint64) & _PLAIN
    return np.concatenate([np.arange(len(n)), owner, owner]), np.concatenate([whole, left & _PLAIN | np.uint64(_WHOLE), by_place])


def _first_of(owner: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its owner; owners stand together."""
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.arange(len(owner)) - np.repeat(new, np.diff(np.r_[new, len(owner)]))


def _long_keys(cut: Cut, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of some long lines and the least keys of their windows of pieces."""
    if not len(line):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    a, b = cut.words[line], cut.words[line + 1]
    n = b - a
    owner = np.repeat(np.arange(len(n)), n)
    place = _first_of(owner)
    hashed = cut.hash[a[owner] + place] >> np.uint64(20)
    hashed[place == 0] = np.uint64((1 << 44) - 1)
    turn = np.argsort(owner.astype(np.uint64) << np.uint64(44) | hashed, kind="stable")
    # how many words of least hash begin a piece: in lines of few words all below a bound, so that an edit moves no other cut
    below = np.bincount(owner[hashed < np.uint64(CUTTING * (1 << 44))], minlength=len(n))
    cuts = np.where(n < FEW_WORDS, np.maximum(below, 2), np.maximum(n // PIECE, 3) - 1)
    first = place == 0
    first[turn[place < cuts[owner]]] = True
    start = np.flatnonzero(first)
    whose, at = owner[start], a[owner[start]] + place[start]
    end = np.r_[at[1:], 0]
    last = np.r_[whose[1:] != whose[:-1], True]
    end[last] = b[whose[last]]
    piece = _mixed(cut.run(at, end), end - at).view(np.uint64)
    # a line's number and 48 bits of a key in one, so that one sort of numbers brings the least of each line in front
    both = []
    for apart in range(1, APART + 1):
        same = np.flatnonzero(whose[apart:] == whose[:-apart])
        key = _mixed(piece[same] * np.uint64(BASE) + piece[same + apart], 3).view(np.uint64) >> np.uint64(16)
        both.append(whose[same].astype(np.uint64) << np.uint64(48) | key)
    both = np.sort(np.concatenate(both))
    both = both[np.r_[True, both[1:] != both[:-1]]]
    owners = (both >> np.uint64(48)).astype(np.int64)
    least = _first_of(owners) < LEAST
    return owners[least], _mixed(both[least] & np.uint64((1 << 48) - 1), 4).view(np.uint64) & _PLAIN


def keyed_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The lines of at least so many words: where they stand, their hash, and the keys of their deletion neighbourhoods."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(2)):
                cut = Cut(texts)
                every = np.flatnonzero(np.diff(cut.words) >= max(least, 1))
                for at in range(0, len(every), CUT_LINES):
                    line = every[at : at + CUT_LINES]
                    row = np.searchsorted(cut.lines, line, side="right") - 1
                    a, b = cut.words[line], cut.words[line + 1]
                    n = b - a
                    short, long = np.flatnonzero((n >= NEAR_WORDS - 1) & (n <= SHORT)), np.flatnonzero(n >= LONG)
                    (o1, k1), (o2, k2) = _short_keys(cut, line[short]), _long_keys(cut, line[long])
                    owner, key = np.r_[short[o1], long[o2]], np.r_[k1, k2]
                    turn = np.argsort(owner, kind="stable")
                    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(line)))].astype(np.int32)
                    take = pa.array(first + row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take), batch.column(1).take(take), pa.array((line - cut.lines[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                            pa.array(_mixed(cut.run(a, b), n)), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[turn].view(np.int64))),
                        ],
                        [c.split()[0] for c in KEYED.split(", ")],
                    )

    return _keyed(docs).mapInArrow(run, KEYED)


def _joined(key):
    """The key under which a line meets others, whether it stands there whole or as a variant."""
    return key.bitwiseAND(F.lit(~_SELF))


def _holding(found: DataFrame, bits: Bits | None, hashes: str, *columns: str) -> DataFrame:
    """A row ``h`` and the columns for each hash of a line, one or a list of them, whose slot stands in the map; without a map for each."""
    if bits is None:
        listed = dict(found.dtypes)[hashes].startswith("array")
        return found.select(F.explode(hashes).alias("h") if listed else F.col(hashes).alias("h"), *columns)
    sent = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0)
            owner = np.arange(len(h))
            if pa.types.is_list(h.type):
                owner, h = np.repeat(owner, np.diff(h.offsets.to_numpy())), h.flatten()
            h = h.to_numpy()
            hit = sent.value.there(h >> 2)
            take = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(h[hit]), *[batch.column(k + 1).take(take) for k in range(len(columns))]], ["h", *columns])

    kinds = ", ".join(f"{c} {t}" for c, t in found.select(*columns).dtypes)
    return found.select(hashes, *columns).mapInArrow(run, f"h long, {kinds}")


def _map_of(frame: DataFrame, column: str) -> Bits | None:
    return _map(frame.select(F.shiftright(column, 2).alias("h")), frame.count())


def _slots(line: np.ndarray, document: np.ndarray) -> np.ndarray:
    return _mixed(document.view(np.uint64), line + 11)


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``whole, words`` of the wanted lines, given where they stand."""
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column(1).to_numpy(), batch.column(0).to_numpy()))], ["h"])

    lines_map = _map(wanted.select(_document().alias("d"), F.col("line").cast("long")).mapInArrow(hashed, "h long"), wanted.count())
    sent = spark.sparkContext.broadcast(lines_map)
    documents = spark.sparkContext.broadcast(_documents(wanted))
    texts = _keyed(docs).select("doc_id", "tie", _document().alias("d"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document = batch.column(2).to_numpy()
            if documents.value is not None:
                some = documents.value.there(document)
                batch, document = batch.filter(pa.array(some)), document[some]
            cut = [(t or b"").split(b"\n") for t in batch.column(3).cast(pa.binary()).to_pylist()]
            size = np.array([len(c) for c in cut], np.int64)
            row = np.repeat(np.arange(len(cut)), size)
            line = _first_of(row)
            if sent.value is not None:
                some = sent.value.there(_slots(line, document[row]))
                row, line = row[some], line[some]
            text = pa.array([cut[r][i] for r, i in zip(row.tolist(), line.tolist(), strict=True)], pa.binary()).cast(pa.string())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line.astype(np.int32)), text], ["doc_id", "tie", "line", "words"])

    got = texts.mapInArrow(run, "doc_id long, tie long, line int, words string").alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.tie") == F.col("w.tie")) & (F.col("t.line") == F.col("w.line"))
    # rows that repeat id and text bring a line again
    return got.join(wanted.alias("w"), same).select("w.whole", "t.words").dropDuplicates(["whole"])


def neighbours(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id, tie, line`` of the lines that go: those equal to an earlier one, and those found within the bound of one.

    Rows that repeat both id and text give their lines as often as they stand.
    """
    spark, paths = docs.sparkSession, []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        paths.append(storage.scratch(spark, name))
        # hashes have no repeats that a dictionary could spare
        writer = frame.write.option("compression", "zstd").option("parquet.enable.dictionary#keys.list.element", "false").option("parquet.enable.dictionary#whole", "false")
        writer.parquet(paths[-1])
        return spark.read.schema(frame.schema).parquet(paths[-1])

    found = kept(keyed_lines(docs, least), "lines")
    per_key = found.select("whole", F.explode("keys").alias("key")).groupBy(_joined(F.col("key")).alias("key")).agg(F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    shared = kept(per_key.where("lo < hi").select(F.col("key").alias("joined")), "shared-keys")
    # the different lines that hold a shared key, with the place of the first of equal ones
    holding = _holding(found, _map_of(shared, "joined"), "keys", "whole", "n", "doc_id", "tie", "line").withColumn("joined", _joined(F.col("h")))
    # a key of very many lines is split by the join, and its lines are dealt out again to be grouped
    lines_of = holding.join(shared, "joined", "left_semi").groupBy(F.col("h").alias("key"), "whole", "n").agg(F.min(_order()).alias("first"))
    held = kept(lines_of.withColumn("joined", _joined(F.col("key"))), "line-keys")
    here = F.struct("first", "whole", "n")
    whole_line, variant = F.col("key").bitwiseAND(F.lit(_SELF)) != 0, F.col("key").bitwiseAND(F.lit(_WHOLE | _SELF)) == _WHOLE
    earliest = held.groupBy("joined").agg(F.min(F.when(whole_line, here)).alias("self"), F.min(F.when(~whole_line, here)).alias("other"))
    # a variant meets the line that is whole under its key, that line its first variant, and all others the first
    meets = held.join(earliest, "joined").withColumn("e", F.when(variant, F.col("self")).otherwise(F.col("other")))
    fits = (F.col("e.first") < F.col("first")) & (F.abs(F.col("n") - F.col("e.n")) * NEAR_WORDS <= F.greatest("n", "e.n"))
    pairs = kept(meets.where(fits).select("whole", "first", F.col("e.whole").alias("near"), F.col("e.first").alias("near_first")).distinct(), "line-pairs")
    wanted = pairs.select("whole", "first.*").union(pairs.select("near", "near_first.*")).distinct()
    texts = kept(_fetched(docs, kept(wanted, "wanted-lines")), "line-texts")

    @F.pandas_udf("boolean")
    def close(a, b):
        import pandas as pd

        def any_close(words, many):
            own = words.encode().split()
            return any(within_one(own, x.encode().split()) for x in many)

        return pd.Series([any_close(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")

    others = pairs.join(texts.select(F.col("whole").alias("near"), F.col("words").alias("other")), "near")
    # a line has no more candidates than keys; the earliest comes first, and the first that is close decides
    listed = others.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("near_first", "other"))).alias("others")).join(texts, "whole")
    near = kept(listed.where(close("words", F.transform("others", lambda o: o["other"]))).select("whole", F.lit(True).alias("goes")), "near-lines")
    repeats = kept(found.groupBy("whole").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("whole", "first"), "repeats")
    going = kept(repeats.join(near, "whole", "full"), "going-lines")
    place = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tie") == F.col("tie")) & (F.col("first.line") == F.col("line"))
    marked = _holding(found, _map_of(going, "whole"), "whole", "doc_id", "tie", "line").withColumnRenamed("h", "whole").join(going, "whole")
    gone = stored(spark, marked.where(F.coalesce("goes", ~place)).select("doc_id", "tie", "line"), "dropped-lines")
    for path in paths:
        storage.delete(spark, path)
    return gone


def deduplicate(docs: DataFrame, report: bool = False, least: int = NEAR_WORDS, exact: bool = True) -> DataFrame:
    """All rows and columns, with texts without the lines that go; `least` as in `repeated`.

    Without exact, by deletion neighbourhoods alone. With report, only ``doc_id, n_lines, n_dropped, text``.
    """
    spark = ready(docs.sparkSession)
    gone = stored(spark, repeated(docs, least).select("doc_id", "tie", "line").distinct(), "dropped-lines") if exact else neighbours(docs, least)
    bits = _documents(gone)
    per = gone.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("gone"))
    text = next(c for c in docs.columns if c.lower() == "text")
    tie, left, right, drop = (free_name(docs, c) for c in ("tie", "left_id", "right_id", "gone"))
    per = per.select(F.col("doc_id").alias(right), F.col("tie").alias(tie + "_r"), F.col("gone").alias(drop))
    hit = _chosen(docs, bits, True).withColumn(left, F.col("doc_id").cast("long")).withColumn(tie, F.xxhash64(text))
    joined = hit.join(per, F.col(left).eqNullSafe(F.col(right)) & (F.col(tie) == F.col(tie + "_r")), "left")
    cut = F.split(text, "\n")
    kept = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    whole = _chosen(docs, bits, False)
    if report:
        n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_lines")
        head = F.col("doc_id").cast("long").alias("doc_id")
        changed = joined.select(head, n_lines, F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept).alias("text"))
        return changed.unionByName(whole.select(head, n_lines, F.lit(0).cast("long").alias("n_dropped"), F.col(text).alias("text")))
    changed = joined.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
    return changed.unionByName(whole)
