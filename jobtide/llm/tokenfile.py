"""Token ids in files of a byte-aligned variable-length code.

A file set holds the documents in ascending ``doc_id`` order (nulls first), cut into blocks. A block ranks
its ids by frequency (ties to the smaller id) and keeps that ranking, so it can be decoded alone. A rank
takes one to four bytes, as few as hold it; its length less one stands in two bits of a control stream,
four ranks to a control byte, apart from the data bytes. Decoding looks up each control byte in a table
of 256 rows that gives four lengths. Blocks are cells of Parquet files: any store that Spark reaches can
hold them, and Spark's commit leaves whole files only.

Nulls count as empty texts. Rows that repeat a ``doc_id`` stand next to each other, ordered by a hash of
their texts. Each document ends with the id ``end``.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import bpe
from jobtide.llm.common import ready

BLOCK_IDS = 2_000_000
KEPT_PIECES = 500_000
BLOCK = "shard int, block int, before long, doc_ids array<long>, lengths array<long>, ranking binary, control binary, data binary"
#: Row c: the lengths of the four values whose control byte is c.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_libraries: dict[int, "Library"] = {}


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    size = 1 + (values >= 1 << 8).astype(np.int64) + (values >= 1 << 16) + (values >= 1 << 24)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        long = size > k
        data[at[long] + k] = values[long] >> np.uint32(8 * k) & np.uint32(255)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    return (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a pair of streams."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    stream = np.frombuffer(data, np.uint8)
    values = stream[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        values[long] |= stream[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids by falling frequency, and the place of each value in that ranking."""
    if len(ids) and int(ids.max()) > 4 * len(ids) + (1 << 20):
        distinct, where, count = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        # ids of a vocabulary: counting them needs no sort of all
        where, every = ids, np.bincount(ids)
        distinct = np.flatnonzero(every)
        count = every[distinct]
    order = np.lexsort((distinct, -count))
    if where is ids:
        place = np.empty(len(every), np.uint32)
        place[distinct[order]] = np.arange(len(order))
    else:
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
    return distinct[order].astype("<u4"), place[where]


class _Pieces(dict):
    """The ids of pieces of text by the library's model, asked once for each piece."""

    def __init__(self, model) -> None:
        self.tokenize = model.tokenize
        self.letters = str.maketrans(dict(enumerate(bpe.byte_letters())))

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            found = self.tokenize(piece.replace(" ", self.letters[32]))  # all others stand for themselves
        else:
            found = self.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        self[piece] = ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


class Library:
    """The tokenizers library; a worker keeps the ids of pieces.

    Texts with added tokens or characters of uncertain class go through the library as they are. Others are
    split here and each new piece goes to its BPE model in the letters of a byte-level vocabulary, which takes
    less than half the time of an encoding with offsets and masks.
    """

    def __init__(self, raw: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Pieces(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added) or not text.isascii() and bpe.UNCERTAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, bpe.PIECES.findall(text)))


def _library(raw: bytes) -> Library:
    key = zlib.crc32(raw)
    if key not in _libraries:
        _libraries[key] = Library(raw)
    return _libraries[key]


def encode(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """The blocks of a file set over all texts; write them as they are with ``DataFrame.write``."""
    spark = ready(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, shard, block, before = _library(raw.value), TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0

        def cut() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            ranking, ranks = ranked(ids)
            control, data = pack(ranks)
            row = [shard, block, before, names, [len(p) // 4 for p in parts], ranking.tobytes(), control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                parts.append(library.encode(text.as_py() or "") + closing)
                held += len(parts[-1]) // 4
                if held >= BLOCK_IDS:
                    yield cut()
                    block, before = block + 1, before + held
                    names, parts, held = [], [], 0
        if names:
            yield cut()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return ordered.select("doc_id", "text").mapInArrow(run, BLOCK)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    encode(docs, tokenizer, end).write.option("compression", "zstd").parquet(path)


def _with_starts(blocks: DataFrame) -> DataFrame:
    """Each block with the number of ids before it: those of its own shard, which it keeps, and of the shards before.

    Only totals of shards come to the driver, one number for each partition that was written, and go back with the blocks' reader.
    """
    size = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    spark, before, starts = blocks.sparkSession, 0, {}
    for shard, ids in sorted(map(tuple, size.groupBy("shard").agg(F.sum("ids")).collect())):
        starts[shard] = before
        before += ids
    sent = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sent.value[shard] for shard in batch.column(0).to_pylist()]
            start = np.array(own, np.int64) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], [*batch.schema.names, "start"])

    return blocks.mapInArrow(run, f"{BLOCK}, start long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written file set; ids are little-endian unsigned 32-bit integers."""
    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                n = np.array(row["lengths"], np.int64)
                ids = np.frombuffer(row["ranking"], "<u4")[unpack(row["control"], row["data"], int(n.sum()))].astype("<u4").tobytes()
                to = np.cumsum(n)
                cells = [ids[4 * a : 4 * b] for a, b in zip((to - n).tolist(), to.tolist(), strict=True)]
                for a in range(0, len(cells), 500):
                    b = min(a + 500, len(cells))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array((row["start"] + to - n)[a:b]), pa.array(n[a:b]), pa.array(cells[a:b], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    blocks = spark.read.schema(BLOCK).parquet(path)
    return _with_starts(blocks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
