"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents of one task. Its text is the sequence of their words; a run of words that no
benchmark item holds, and each document's end, is one separator, since no phrase goes across it. The
suffixes are sorted with distinct separators, the last column is kept in a wavelet matrix, and the test
phrases are searched backward by its ranks, all at once. Found rows walk back to the nearest sampled suffix
position; samples stand at every 16th word and behind every separator, so no walk crosses one.

Windows of 13 consecutive words of an item are the phrases; an item of fewer words, but not none, is one
phrase. Spans of found words are merged. Benchmarks are taken in blocks of bounded size, each sent to the
workers whole; further blocks are further passes over the documents, without a shuffle.

Null texts have no words. Rows without ``doc_id`` and repeated rows are judged like others. Items of equal
text count each under its own id; an id that stands on several items counts once. Items without id or
words take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.llm.common import free_name, ready

WINDOW = 13
SAMPLE = 16
#: Symbols of a shard, and bytes of benchmark text of a block.
SHARD = 1 << 20
BLOCK_BYTES = 16 << 20
_WORD = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
#: ASCII capitals to small letters, all that is no part of a word to a blank.
FOLD = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Phrases:
    """The distinct windows of a block of items, as rows of symbols from 1 on, and the items that each stands in."""

    def __init__(self, items: list[tuple], width: int = WINDOW) -> None:
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for name, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in words(text)]
            for at in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(tuple(w[at : at + width]), set()).add(name)
        self.items = [sorted(x) for x in found.values()]
        self.size = np.array([len(x) for x in found], np.int64)
        self.rows = np.zeros((len(found), width), np.int64)
        for k, x in enumerate(found):
            self.rows[k, : len(x)] = x
        self.longest = int(self.size.max()) if found else 0


def suffixes(text: np.ndarray, most: int) -> np.ndarray:
    """The suffix array; symbol 0 is a separator, smaller than words and told apart by its place."""
    n, bits = len(text), max(1, int(most).bit_length())
    first, open_, at = np.zeros(n, np.int64), np.ones(n, bool), 0
    for at in range(62 // bits):
        here = np.zeros(n, np.int64)
        here[: max(0, n - at)] = text[at:]
        first = first << bits | np.where(open_, here, 0)
        open_ &= here > 0
    order = np.argsort(first, kind="stable")
    step, key = at + 1, first[order]
    new = np.r_[True, key[1:] != key[:-1]]
    shut = ~open_[order]  # a separator is among the symbols compared: equal ones stand by place
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new | shut, np.arange(n), 0))
    rank[order] = start
    while True:
        # places whose rank is shared
        alone = np.r_[start[1:] != start[:-1], True] & (start == np.arange(n))
        left = np.flatnonzero(~alone)
        if not len(left):
            return order
        places = order[left]
        behind = rank[np.minimum(places + step, n - 1)]
        turn = np.lexsort((behind, start[left]))
        order[left], group, behind = places[turn], start[left][turn], behind[turn]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        start[left] = np.maximum.accumulate(np.where(fresh, left, 0))
        rank[order[left]] = start[left]
        step *= 2


class Index:
    """FM-index of one shard's symbols, which end with a separator."""

    def __init__(self, text: np.ndarray, most: int) -> None:
        order, n = suffixes(text, most), len(text)
        before = text[order - 1]
        self.begin = np.searchsorted(text[order], np.arange(most + 2))
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(most).bit_length())
        row = before
        for level in range(self.bits - 1, -1, -1):
            bit = row >> level & 1
            zeros = np.r_[0, np.cumsum(1 - bit)].astype(np.int32)
            self.levels.append((zeros, int(zeros[-1])))
            row = np.r_[row[bit == 0], row[bit == 1]]
        self.last = before
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.places = sampled, order[sampled]
        self.sample_of = np.cumsum(sampled) - 1
        self.n = n

    def rank(self, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row in the last column."""
        low = np.zeros_like(to)
        for level, (zeros, count) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> level & 1).astype(bool)
            low, to = (np.where(one, count + x - zeros[x], zeros[x]) for x in (low, to))
        return to - low

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and the first and last row of each."""
        which, size = np.arange(len(phrases.size)), phrases.size
        symbol = phrases.rows[which, size - 1]
        low, high = self.begin[symbol], self.begin[symbol + 1]
        done: list[tuple[np.ndarray, ...]] = []
        for step in range(1, phrases.longest + 1):
            live = low < high
            which, low, high = which[live], low[live], high[live]
            ended = size[which] == step
            done.append((which[ended], low[ended], high[ended]))
            which, low, high = which[~ended], low[~ended], high[~ended]
            symbol = phrases.rows[which, size[which] - 1 - step]
            low, high = (self.begin[symbol] + self.rank(symbol, x) for x in (low, high))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the shard of each row's suffix."""
        place, walked = np.full(len(rows), -1), 0
        left = np.arange(len(rows))
        while len(left):
            at = self.sampled[rows]
            place[left[at]] = self.places[self.sample_of[rows[at]]] + walked
            left, rows = left[~at], rows[~at]
            symbol = self.last[rows]
            rows = self.begin[symbol] + self.rank(symbol, rows)
            walked += 1
        return place


def _occurrences(text: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The place and the phrase of each occurrence in a shard."""
    index = Index(np.append(text, 0), len(phrases.symbol))
    which, low, high = index.search(phrases)
    count = high - low
    rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return index.locate(rows), np.repeat(which, count)


def search(texts: list[str | None], phrases: Phrases, shard: int = SHARD) -> tuple[list[int], list[np.ndarray], list[set]]:
    """For each text its number of words, the merged spans (first word, word behind the last) and the items found.

    Shards overlap by a phrase less one word, so that long documents may go over several.
    """
    cut = [words(t) for t in texts]
    n_words = np.array([len(w) for w in cut], np.int64)
    known = phrases.symbol.get
    symbols = np.array([known(x, 0) for w in cut for x in w], np.int64)
    ends = np.cumsum(n_words)
    text = np.insert(symbols, ends, 0)
    doc = np.repeat(np.arange(len(cut)), n_words + 1)
    begin = (ends - n_words + np.arange(len(cut)))[doc]
    keep = text > 0
    keep[1:] |= text[:-1] > 0
    place = np.flatnonzero(keep)
    text = text[keep]
    found, overlap = [], phrases.longest - 1
    for at in range(0, len(text), max(1, shard - overlap)):
        where, which = _occurrences(text[at : at + shard], phrases)
        found.append((place[at + where], which))
    spans: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(texts)
    items: list[set] = [set() for _ in texts]
    if found:
        at, which = (np.concatenate(x) for x in zip(*found, strict=True))
        turn = np.argsort(at, kind="stable")
        at, which = at[turn], which[turn]
        owner, word = doc[at], at - begin[at]
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=False):
            d = int(owner[lo])
            spans[d] = merged(np.c_[word[lo:hi], word[lo:hi] + phrases.size[which[lo:hi]]])
            items[d] = {i for k in set(which[lo:hi].tolist()) for i in phrases.items[k]}
    return n_words.tolist(), spans, items


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans by first word, those that touch or overlap as one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]
    return np.c_[spans[new, 0], reach[last]]


def _blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items, a block of about `limit` bytes of text at a time."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    for k in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def mark(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of docs with what was found in their text.

    The second value names the new columns: n_words, spans (array of first word and word behind the last),
    items (their ids as strings, ordered).
    """
    spark = ready(docs.sparkSession)
    names = {}
    for c in ("n_words", "spans", "items"):
        names[c] = free_name(docs, c)
    kinds = [T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[c], k) for c, k in zip(names, kinds, strict=True))])
    plain = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
    text_at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))
    width = len(docs.columns)
    out = docs
    for block in _blocks(benchmark, limit):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value)
            for batch in batches:
                texts = batch.column(text_at).cast(pa.string()).to_pylist()
                if len(phrases.size):
                    n_words, spans, items = search(texts, phrases)
                else:
                    n_words, spans, items = [len(words(t)) for t in texts], [np.empty((0, 2), np.int64)] * len(texts), [set() for _ in texts]
                if batch.num_columns > width:  # found in earlier blocks
                    old_spans, old_items = (batch.column(width + k).to_pylist() for k in (1, 2))
                    spans = [merged(np.array([*a, *b.tolist()], np.int64).reshape(-1, 2)) for a, b in zip(old_spans, spans, strict=True)]
                    items = [b.union(a) for a, b in zip(old_items, items, strict=True)]
                new = [pa.array(v, k) for v, k in zip((n_words, [s.tolist() for s in spans], [sorted(i) for i in items]), plain, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], [*batch.schema.names[:width], *names.values()])

        out = out.mapInArrow(run, schema)
    return out, names


def _hit(names: dict[str, str]):
    return F.aggregate(names["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items`` of every row."""
    found, names = mark(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, limit)
    hit = _hit(names)
    return found.select(
        "doc_id", F.col(names["n_words"]).alias("n_words"), hit.alias("n_hit"), F.size(names["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names["items"]), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col(names["n_words"]))).alias("contaminated"),
        F.col(names["spans"]).alias("spans"), F.col(names["items"]).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all columns, that are not contaminated: fewer than one word in twenty is hit, or none."""
    found, names = mark(docs, benchmark)
    hit = _hit(names)
    return found.where((hit == 0) | (20 * hit < F.col(names["n_words"]))).select(*docs.columns)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
