"""Context-triggered piecewise hashing: fingerprints of texts that stay comparable after edits.

A rolling hash of the last `WINDOW` bytes ends a chunk wherever its lowest s bits are zero, so the ends depend on
nearby bytes only and a change moves no end further on. The scale s of a text is the least that gives at most `MOST`
chunks; the ends of a scale are ends of the smaller ones too. Each chunk is hashed to a letter of `LETTERS`
values, two digits to base 64. A fingerprint is ``s:letters:letters:letters``, the letters at scale s, s + 1 and
s + 2, so two fingerprints are comparable when their scales are at most two apart (chunk sizes within a factor of four).

The likeness of two fingerprints is one less the edit distance of their letters at the smallest scale that both have,
by the number of letters of the longer; 0 when they have no scale in common, 1 when they are equal. Chunks are
hashed whole, and no part of a text is left out: a text of any length has one fingerprint.

Nulls are empty texts; the fingerprint of an empty text is ``0:::``. Texts are compared as UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import free_name, ready, stored

#: Bytes that decide whether a chunk ends, the most chunks at the first scale, the scales, and the values of a letter.
WINDOW, MOST, SCALES, LETTERS = 7, 64, 3, 1 << 12
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR = 0x9E3779B97F4A7C15
#: Rows of an output batch.
ROWS = 500
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(32)


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))
_ONE = np.uint64(1)
_NAMES = [a + b for a in _DIGITS for b in _DIGITS]


def _rolling(raw: bytes) -> np.ndarray:
    """A hash of the `WINDOW` bytes up to each byte."""
    value = _BYTE[np.frombuffer(raw, np.uint8)]
    total = value.copy()
    for k in range(1, min(WINDOW, len(raw))):
        total[k:] += value[:-k] * np.uint64(pow(_FACTOR, k, 1 << 64))
    return _mixed(total)


def fingerprint(raw: bytes) -> str:
    if not raw:
        return "0" + ":" * SCALES
    rolling, n = _rolling(raw), len(raw)
    reach = np.zeros(n + 1, np.uint64)
    np.cumsum(rolling, out=reach[1:])
    # the ends of chunks and what is left of their hashes, whose lowest bit decides the next scale
    end, rest, scale, parts = np.arange(1, n + 1), rolling, 0, []
    while True:
        closed = len(end) > 0 and end[-1] == n
        if parts or len(end) + (not closed) <= MOST:
            edges = np.zeros(len(end) + 2 - closed, np.int64)
            edges[1 : len(end) + 1], edges[-1] = end, n
            letter = _mixed(np.diff(reach[edges])) >> np.uint64(64 - LETTERS.bit_length() + 1)
            parts.append("".join([_NAMES[x] for x in letter.tolist()]))
            if len(parts) == SCALES:
                return ":".join([str(scale + 1 - SCALES), *parts])
        finer = np.flatnonzero(rest & _ONE == 0)
        end, rest, scale = end[finer], rest[finer] >> _ONE, scale + 1


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of letters, a column of the table at a time as bits (Myers, 1999)."""
    if not a or not b:
        return max(len(a), len(b))
    if set(a).isdisjoint(b):
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = whole, 0, len(a)
    for x in b:
        match = places.get(x, 0)
        level = match | down
        run = ((match & up) + up ^ up) | match
        more, less = down | ~(run | up) & whole, up & run
        score += bool(more & last) - bool(less & last)
        more = (more << 1 | 1) & whole
        up, down = (less << 1 | ~(level | more)) & whole, more & level
    return score


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (one, *left), (other, *right) = a.split(":"), b.split(":")
    scale = max(int(one), int(other))
    if scale >= min(int(one), int(other)) + SCALES:
        return 0.0
    x, y = left[scale - int(one)], right[scale - int(other)]
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (x, y))
    return 1.0 - distance(x, y) / max(len(x), len(y), 1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns with a column ``fingerprint`` (or that name with underscores, if it is taken)."""
    ready(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: fingerprint((t or "").encode()))

    return docs.withColumn(free_name(docs, "fingerprint"), of(F.col(text).cast("string")))


def alike(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def of(left, right):
        import pandas as pd

        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return of(a, b)


def edited(text: str, following: str) -> str:
    """The text with its second half, rounded down, replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following).encode()
    other = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_mark)


def with_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to both that and the next document.

    The next document is the following one by doc_id, nulls first, then by a hash of the text; the last is
    followed by the first, a single one by itself. Texts go through one shuffle, into ranges; a range knows the
    followers of all its documents but the last one, and these wait, one for each range, for the first text of the next range.
    """
    spark = ready(docs.sparkSession)
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [*kinds, pa.int32(), pa.string(), pa.string()], strict=True)], [*names, "part", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, first, before = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                now = doc_id, text, fingerprint(text.encode())
                if before is not None:
                    rows.append((*_row(*before, *now[1:]), part, None, None))
                first, before = first or now, now
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
        if before is not None:
            rows.append((before[0], None, None, before[2], first[2], None, None, part, first[1], before[1]))
            yield batch_of(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    kept = stored(spark, ordered.mapInArrow(run, ROW + ", part int, first string, last string"), "fingerprints")
    # one row for each range that has documents; only their numbers come to the driver
    edge = kept.where("last IS NOT NULL")
    parts = sorted(r.part for r in edge.select("part").collect())
    links = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = edge.select(F.col("part").alias("next_part"), F.col("first").alias("following"), F.col("edited_fingerprint").alias("next_mark"))
    waiting = edge.select("doc_id", "part", "last", "fingerprint").join(links, "part").join(heads, "next_part").select("doc_id", "last", "fingerprint", "following", "next_mark")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_row(*row), kinds, strict=True)], names)

    return kept.where("last IS NULL").select(*names).unionByName(waiting.mapInArrow(close, ROW))
