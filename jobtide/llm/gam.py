"""Document quality by a generalised additive model with pairwise interactions.

Every whole text is turned into figures about its characters, words and lines. Each figure is cut into
bins at quantiles. Shallow trees over one figure at a time are boosted in turn, each with a small step, so
that every figure ends up with one lookup table; then the pairs of figures that explain most of what is left
get two-way tables in the same manner. A score adds up the looked-up values of a text's bins.

The model is fitted on at most `rows` labelled documents, those whose hashed ids are smallest; every
document is scored. Null and empty texts have figures like any other text. Without labelled rows of both
kinds the score is the share of label 1, or 0.5. Labels that are null or have no document take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.llm.common import crc_mod, ready

#: Bound of the labelled sample, and the score from which a document is kept.
ROWS, THRESHOLD = 20_000, 0.7
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, STEP, PRIOR = 48, 12, 8, 150, 60, 0.15, 2.0
FIGURES = (
    "chars", "words", "lines", "chars_per_word", "words_per_line", "capitals", "digits", "marks", "blanks", "high_bytes",
    "distinct_words", "repeated_next", "repeated_second", "most_frequent", "marks_at_end", "entropy", "distinct_lines", "longest_word", "stops",
)
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_HIGH = np.arange(256) >= 128
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_MARK = ~(_DIGIT | _BLANK | _HIGH | _LETTER)
_NO_LETTER_END = frozenset(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")


def figures(text: str | None) -> list[float]:
    """What the model knows about a text."""
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    m, lines = max(1, len(words)), raw.split(b"\n")
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    share = count[count > 0] / n
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / m, len(words) / len(lines),
        count[_CAPITAL].sum() / n, count[_DIGIT].sum() / n, count[_MARK].sum() / n, count[_BLANK].sum() / n, count[_HIGH].sum() / n,
        len(tally) / m**0.8, sum(map(bytes.__eq__, words, words[1:])) / m, sum(map(bytes.__eq__, words, words[2:])) / m,
        max(tally.values(), default=0) / m, sum(w[-1] in _NO_LETTER_END for w in words) / m, float(-(share * np.log2(share)).sum()),
        len(set(lines)) / len(lines), np.log1p(max(map(len, tally), default=0)), (count[44] + count[46]) / m,
    ]


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the bins by a tree of two levels over an ordered figure."""

    def cut(lo: int, hi: int) -> int:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return lo
        gain = a**2 / (b + PRIOR) + (a[-1] + g[hi - 1] - a) ** 2 / (b[-1] + h[hi - 1] - b + PRIOR)
        return lo + 1 + int(gain.argmax())

    top = cut(0, len(g))
    edges = sorted({0, cut(0, top), top, cut(top, len(g)), len(g)})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PRIOR)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the cells by a tree that cuts one figure, then the other on each side; and what it gains."""
    best, gain = np.zeros_like(g), -1.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        down_g, down_h = np.cumsum(np.cumsum(a, 0), 1), np.cumsum(np.cumsum(b, 0), 1)
        parts = []
        for sg, sh in ((down_g[:-1], down_h[:-1]), (down_g[-1] - down_g[:-1], down_h[-1] - down_h[:-1])):
            left, right = sg[:, :-1] ** 2 / (sh[:, :-1] + PRIOR), (sg[:, -1:] - sg[:, :-1]) ** 2 / (sh[:, -1:] - sh[:, :-1] + PRIOR)
            parts.append(left + right)
        total = parts[0].max(1) + parts[1].max(1)
        row = int(total.argmax())
        if total[row] > gain:
            gain, out = float(total[row]), np.zeros_like(a)
            for rows, part in ((slice(0, row + 1), parts[0]), (slice(row + 1, None), parts[1])):
                col = int(part[row].argmax()) + 1
                for cols in (slice(0, col), slice(col, None)):
                    out[rows, cols] = a[rows, cols].sum() / (b[rows, cols].sum() + PRIOR)
            best = out.T if turned else out
    return best, gain


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Lookup tables for figures and pairs of figures."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        ones = float(y.sum())
        share = (ones + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        n = x.shape[1]
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], grid)) if len(x) else np.empty(0) for f in range(n)]
        coarse = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        self.pair_edges = [np.unique(np.quantile(x[:, f], coarse)) if len(x) else np.empty(0) for f in range(n)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if 0 < ones < len(y):
            self._fit(x, y.astype(float))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = _sigmoid(score)
                g, h = (np.bincount(bins[f], v, len(table)) for v in (y - p, p * (1 - p)))
                step = STEP * _tree(g, h)
                table += step
                score += step[bins[f]]
        p, ranked = _sigmoid(score), []
        sizes = [len(e) + 1 for e in self.pair_edges]
        cells = lambda i, j, v: np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
        for i in range(len(sizes)):
            for j in range(i):
                if sizes[i] > 1 and sizes[j] > 1:
                    ranked.append((-_grid(cells(i, j, y - p), cells(i, j, p * (1 - p)))[1], i, j))
        self.pairs = [(i, j) for _, i, j in sorted(ranked)[:PAIRS]]
        self.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                p = _sigmoid(score)
                step = STEP * _grid(cells(i, j, y - p), cells(i, j, p * (1 - p)))[0]
                table += step
                score += step[coarse[i], coarse[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
        total = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return _sigmoid(total)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 4) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model of ``labels.quality``, learnt from at most `rows` documents that are not held out.

    The sample, a bounded number of rows of figures, is what comes to the driver.
    """
    ready(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [figures(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

    got = texts.mapInArrow(run, "doc_id long, x array<double>, y int").orderBy("doc_id", "y", "x").limit(rows).collect()
    x = np.array([r.x for r in got]).reshape(-1, len(FIGURES))
    return Model(x, np.array([r.y for r in got], int))


def _scored(docs: DataFrame, model: Model, name: str, columns: list[str], at: int) -> DataFrame:
    sent = ready(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([figures(t) for t in batch.column(at).cast(pa.string()).to_pylist()]).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(x))], [*batch.schema.names, name])

    chosen = docs.select(*columns)
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = _scored(docs, model, "score", ["doc_id", "text"], 1)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all columns, whose score reaches the threshold."""
    from jobtide.llm.common import free_name

    name = free_name(docs, "score")
    at = next(k for k, c in enumerate(docs.columns) if c.lower() == "text")
    return _scored(docs, model, name, docs.columns, at).where(F.col(name) >= threshold).select(*docs.columns)
