"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words in which words q apart are identical, q being its smallest period, that
no neighbouring word extends, and that holds at least `POWER` periods and `SHORT` words.

At each dyadic scale t a position is selected if the least hash of the t-windows that begin in [i, i + t] is
that of the window at i or at i + t (Kempa and Kociumaka, String synchronizing sets, 2019). That depends on
the 2t words from i on alone, so positions a period apart in a run are selected alike. Windows within a run of
period t / 4 at most are left out, or such regions would select everywhere or nowhere. They are known: they
lie in runs that smaller scales have found, and runs of one repeated word are read off directly. Two selected
positions in a row with the same 3t words from there on propose their distance d as a period, for 3t/2 <= d < 3t. Within a
run of such a period every residue's selected position is followed by its next one just one period later: an
earlier position with the same 3t > d words would give the stretch a smaller period. Scales cover all periods
from two on. A proposal is extended word by word in both directions, so hashes choose where to look and
the words decide.

Nulls and texts without words have no runs. A document is one unit of work; nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import ready

#: The fewest words and the fewest periods of a run.
SHORT, POWER = 6, 4
#: Bytes of text that are searched at once.
CHUNK_BYTES = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_NONE = np.uint64(_MASK)
RUN = "array<struct<start:long,length:long,period:long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(32)


def _reach(words: np.ndarray, i: int, d: int, step: int) -> int:
    """The first place from i on, forwards or backwards, at which the word d further differs, or the end of the words."""
    limit, size, at = (len(words) - d if step > 0 else -1), 64, i
    while at != limit:
        to = min(at + size, limit) if step > 0 else max(at - size, limit)
        a, b = (at, to) if step > 0 else (to + 1, at + 1)
        other = np.flatnonzero(words[a:b] != words[a + d : b + d])
        if len(other):
            return a + int(other[0] if step > 0 else other[-1])
        at, size = to, size * 2
    return limit


def _stretches(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """The maximal stretches ``start, end, period`` of at least `POWER` periods around the proposals."""
    out, last, end = [], -1, -1
    for k in np.lexsort((at, period)).tolist():
        i, d = int(at[k]), int(period[k])
        if d == last and i < end - d:
            continue
        start, end, last = _reach(words, i, d, -1) + 1, _reach(words, i, d, 1) + d, d
        if end - start >= POWER * d:
            out.append((start, end, d))
    return out


def _selected(window: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising positions of scale t, given the hashes of the t-windows and which of these are highly periodic."""
    rank = _mixed(window)
    rank[periodic] = _NONE
    least, width = rank, 1
    while width < t:
        # the least of 2 * width windows; at the end of the words there are fewer
        least = np.r_[np.minimum(least[:-width], least[width:]), least[-width:]] if width < len(least) else least
        width *= 2
    n = max(len(window) - 3 * t + 1, 0)
    low = np.minimum(least[:n], rank[t : t + n])
    return np.flatnonzero((low != _NONE) & ((low == rank[:n]) | (low == rank[t : t + n])))


def find(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, end, period`` of the stretches of `POWER` periods or more, in any number of words.

    The words are numbers; each of the documents, of so many words, is closed by a number that occurs once.
    """
    new = np.flatnonzero(np.r_[True, words[1:] != words[:-1], True])
    repeat = np.flatnonzero(np.diff(new) >= POWER)
    found = [(int(new[k]), int(new[k + 1]), 1) for k in repeat]
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    window, place, t = _mixed(words), np.arange(len(words)), 1
    while True:
        # a run of this scale has four times 3t/2 words at least
        long = sizes >= POWER * 3 * t // 2
        here = long[owner]
        if not here.all():
            window, place, owner = window[here], place[here], owner[here]
        if not len(window):
            return found
        small = np.array([(a, b - t + 1) for a, b, q in found if POWER * q <= t <= b - a], np.int64).reshape(-1, 2)
        small = small[long[np.searchsorted(ends, small[:, 0], side="right")]]
        edge = np.zeros(len(window) + 1, np.int64)
        np.add.at(edge, np.searchsorted(place, small[:, 0]), 1)
        np.add.at(edge, np.searchsorted(place, small[:, 1]), -1)
        chosen = _selected(window, t, np.cumsum(edge[:-1]) > 0)
        power = np.uint64(pow(FACTOR, t, 1 << 64))
        context = (window[chosen] * power + window[chosen + t]) * power + window[chosen + 2 * t]
        turn = np.argsort(context, kind="stable")
        apart = chosen[turn[1:]] - chosen[turn[:-1]]
        near = (context[turn[1:]] == context[turn[:-1]]) & (2 * apart >= 3 * t) & (apart < 3 * t)
        if near.any():
            found += _stretches(words, place[chosen[turn[:-1][near]]], apart[near])
        wider = window * power
        wider[:-t] += window[t:]
        window = wider
        t *= 2


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs ``start, length, period`` of each list of words, by start, then period."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(d) for d in documents], np.int64)
    words = np.empty(int(sizes.sum()) + len(documents), np.int64)
    ends = np.cumsum(sizes + 1)
    for k, document in enumerate(documents):
        words[ends[k] - 1 - len(document) : ends[k] - 1] = np.fromiter(map(number.__getitem__, document), np.int64, len(document))
    words[ends - 1] = -1 - np.arange(len(documents))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for a, b, q in find(words, sizes):
        if b - a >= SHORT:
            k = int(np.searchsorted(ends, a, side="right"))
            out[k].append((a - int(ends[k] - 1 - sizes[k]), b - a, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each text by start, then period, and the words that are kept.

    Words are runs of anything but ASCII white space; kept words are joined by one space. Rows with a null text
    have no words; rows that repeat an id, or have none, are texts of their own.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _chunks(texts):
                documents = [t.split() for t in texts[a:b]]
                runs = runs_of(documents)
                kept = [b" ".join(collapsed(d, r)) for d, r in zip(documents, runs, strict=True)]
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(d) for d in documents], pa.int64()), pa.array(rows, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods; of equal ones the first, then that of the smaller period. Null without runs."""

    def before(a: Column, b: Column) -> Column:
        # exponents as products of whole numbers
        more = a["length"] * b["period"] - b["length"] * a["period"]
        order = F.when(more > 0, -1).when(more < 0, 1).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        return order.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)

    return F.get(F.array_sort(runs, before), F.lit(0))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and SHA-256 of all runs and of the kept words."""
    best, listed = strongest(F.col("runs")), F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = find_runs(docs).withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which one document in ten, by the checksum of its id, repeats a part of itself to its end.

    With h the CRC32 of the id, g = h div 10 and n words, the words from a = g mod n on become copies of the first
    1 + (n - a) div (3 + g mod 8) of them. Such a text has single spaces.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    some = F.coalesce((h % 10 == 0) & F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    planted = rows.where(some).withColumns({"w": words, "g": F.floor(h / 10)}).withColumn("n", F.size("w"))
    planted = planted.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p + 1))), 1, n - a)")
    changed = planted.select("doc_id", F.array_join(F.concat(F.expr("slice(w, 1, a)"), again), " ").alias("text"))
    return changed.unionByName(rows.where(~some))
