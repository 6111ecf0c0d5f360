"""Hard negatives from a multiway hyperplane tree with distance ranges (GNAT; Brin, Near Neighbor Search, 1995).

Components are made integers, floor(scale * x), and a row's score is its integer inner product with the anchor. With M the
largest length of a vector, each row x gets one more coordinate, the root of M^2 - |x|^2, and each anchor
a zero: the distance between them is then the root of |a|^2 + M^2 - 2 score, so a window of scores is an
annulus around the anchor.

A node of the tree has split points, far apart from each other, and gives each of its rows to the nearest one.
For each split point and each subtree it keeps the range of distances between them. A query goes to a subtree only
if its annulus meets, as seen from every split point, the shell that the range describes. Leaves are compared row by
row with integers, so what ranges eliminate saves work and never changes a result; a leaf has at most `LEAF` rows, or only
points too close to be told apart.

The root's split points come from a sample of at most `SAMPLE` rows, those with the smallest hash of vec_id.
Rows are dealt to subtrees of some `SUBTREE` rows by nearest split point; a split point with more rows has several subtrees, by
hash, so copies of one vector do not end up in one task. Subtrees fall into groups; each block of queries goes to each
group once. Queries are a stated set against all rows; only a block and a subtree are in memory at once.

A row whose id or label is null, or whose vector is null or holds null or non-finite components, takes no part; missing
trailing components count as zero. Of rows that share an id the one with the least label, then vector, takes part.
Integers of any size are summed exactly; a score beyond 64 bits is given as the nearest 64-bit number.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import ready, stored

#: Rows of a leaf, split points of a node, of the root, and rows from which the latter are chosen.
LEAF, FAN, ROOT_FAN, SAMPLE = 128, 16, 32, 1024
#: Rows of a subtree and of a block of queries.
SUBTREE, QUERY_ROWS = 4096, 512
#: Queries whose best rows a task holds before it gives them out.
HELD = 1 << 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1
HUGE = float(np.finfo(float).max)
QUERY = "own long, label long, positive long, least long, most long, v array<double>"
FOUND = "own long, positive long, vec_id long, score long"


def vectors(table: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, v being whole numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("x"), fine.alias("fine"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND fine")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
    # floor as a double: components may be beyond 64 bits
    whole = F.transform("row.x", lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * scale).cast("double")).otherwise(F.greatest(F.least(x * scale, F.lit(HUGE)), F.lit(-HUGE))))
    return one.select("vec_id", F.col("row.label").alias("label"), whole.alias("v"))


def matrix(lists: list[list[float]], width: int = 0) -> np.ndarray:
    out = np.zeros((len(lists), max([width, *map(len, lists)])))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d
    if peak < 2.0**53:
        # no partial sum is rounded
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), LOW), HIGH) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def lifted(points: np.ndarray, square: float) -> np.ndarray:
    """The points with the coordinate that makes all equally long."""
    with np.errstate(all="ignore"):
        return np.c_[points, np.sqrt(np.maximum(square - (points * points).sum(1), 0))]


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows; not a number where they are too large to tell."""
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def far_apart(points: np.ndarray, fan: int) -> list[int]:
    """Places of up to so many different points, each the farthest from those before."""
    with np.errstate(all="ignore"):
        chosen, gap = [0], np.square(points - points[0]).sum(1)
        while len(chosen) < fan and np.nanmax(gap, initial=0) > 0:
            chosen.append(int(np.nanargmax(gap)))
            gap = np.minimum(gap, np.square(points - points[chosen[-1]]).sum(1))
    return chosen


class Tree:
    """Nodes over rows in leaf order.

    ``span`` is a node's first row and the one behind its last, ``child`` its first child's number and how many follow, ``split``
    the first of its split points, and ``low``, ``high`` its distances by split point and child, from ``range`` on.
    """

    ARRAYS = ("ids", "labels", "points", "square", "span", "child", "split", "range", "low", "high", "splits")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def grown(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, square: float) -> Tree:
        lift, order = lifted(points, square), np.arange(len(points))
        span, child, split, place, low, high, splits, at = [[0, len(points)]], [], [], [], [], [], [], 0
        while at < len(span):
            a, b = span[at]
            rows = order[a:b]
            chosen = far_apart(lift[rows], FAN) if b - a > LEAF and np.isfinite(square) else [0]
            split.append(len(splits))
            place.append(len(low))
            apart = between(lift[rows], lift[rows[chosen]])
            apart[chosen, range(len(chosen))] = 0
            part = np.nan_to_num(apart).argmin(1)
            size = np.bincount(part, minlength=len(chosen))
            if size.max() == len(rows):
                child.append([0, 0])
            else:
                splits += rows[chosen].tolist()
                child.append([len(span), len(chosen)])
                ends = a + np.cumsum(size)
                span += [[int(e - n), int(e)] for e, n in zip(ends, size, strict=True)]
                for p in range(len(chosen)):
                    inside = [apart[part == c, p] for c in range(len(chosen))]
                    low += [x.min(initial=np.inf) for x in inside]
                    high += [x.max(initial=0) for x in inside]
                order[a:b] = rows[np.argsort(part, kind="stable")]
            at += 1
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        return cls(
            ids=ids[order], labels=labels[order], points=points[order], square=np.float64(square), span=np.array(span), child=np.array(child), split=np.array(split),
            range=np.array(place), low=np.array(low, float), high=np.array(high, float), splits=where[np.array(splits, np.int64)],
        )

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw), allow_pickle=False) as held:
            return cls(**{name: held[name] for name in cls.ARRAYS})


class Queries:
    """A block of queries and the best rows found for each, the highest scores first, ties by the smaller id."""

    def __init__(self, own: np.ndarray, label: np.ndarray, least: np.ndarray, most: np.ndarray, points: np.ndarray, same: bool, k: int) -> None:
        self.own, self.label, self.least, self.most, self.points, self.same, self.k = own, label, least.copy(), most, points, same, k
        self.score, self.id = np.full((len(own), k), LOW, np.int64), np.full((len(own), k), HIGH, np.int64)
        self.found = np.zeros(len(own), np.int64)
        self.length = (points * points).sum(1)

    def radius(self, rows: np.ndarray, score: np.ndarray, square: float) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum(self.length[rows] + square - 2 * score[rows].astype(float), 0))

    def search(self, tree: Tree, reach: np.ndarray) -> None:
        """Compares the queries with the rows of a tree, other than those of subtrees whose shells miss the annulus."""
        square = float(tree.square)
        slack = 1e-6 * (1 + np.sqrt(square + self.length))
        stack = [(0, np.flatnonzero(reach <= self.radius(np.arange(len(self.own)), self.least, square) + slack), None)]
        while stack:
            node, alive, nearest = stack.pop()
            outer = self.radius(alive, self.least, square) + slack[alive]
            if nearest is not None:
                # scores found meanwhile may have made the annulus smaller
                near = ~(nearest > outer)
                alive, outer = alive[near], outer[near]
            first, fan = tree.child[node]
            if not len(alive):
                continue
            if not fan:
                self._compare(alive, tree, *tree.span[node])
                continue
            d = min(self.points.shape[1], tree.points.shape[1])
            splits = tree.splits[tree.split[node] : tree.split[node] + fan]
            with np.errstate(all="ignore"):
                apart = np.sqrt(np.maximum(self.length[alive, None] + square - 2 * (self.points[alive, :d] @ tree.points[splits, :d].T), 0))
            at = tree.range[node]
            low, high = (x[at : at + fan * fan].reshape(fan, fan) for x in (tree.low, tree.high))
            inside = self.radius(alive, self.most, square) - slack[alive]
            # the nearest and farthest that a row of a subtree can be, as seen from all split points
            nearest = np.maximum(apart[:, :, None] - high, low - apart[:, :, None]).max(1)
            farthest = (apart[:, :, None] + high).min(1)
            meets = ~(nearest > outer[:, None]) & ~(farthest < inside[:, None])
            for c in np.argsort(-nearest.mean(0)).tolist():
                rows = np.flatnonzero(meets[:, c])
                if len(rows):
                    stack.append((first + c, alive[rows], nearest[rows, c]))

    def _compare(self, alive: np.ndarray, tree: Tree, a: int, b: int) -> None:
        for at in range(a, b, LEAF):
            to = min(at + LEAF, b)
            score, ids, label = inner(self.points[alive], tree.points[at:to]), tree.ids[at:to], tree.labels[at:to]
            fits = (score >= self.least[alive, None]) & (score <= self.most[alive, None]) & (ids != self.own[alive, None])
            fits &= (label == self.label[alive, None]) == self.same
            some = np.flatnonzero(fits.any(1))
            if not len(some):
                continue
            rows, fits, score = alive[some], fits[some], score[some]
            every = np.concatenate([self.score[rows], np.where(fits, score, LOW)], 1)
            named = np.concatenate([self.id[rows], np.where(fits, ids, HIGH)], 1)
            # numbers that no row has stand for places without one; they come last
            turn = np.lexsort((named, ~every), axis=1)[:, : self.k]
            self.found[rows] = np.minimum(self.found[rows] + fits.sum(1), self.k)
            self.score[rows], self.id[rows] = np.take_along_axis(every, turn, 1), np.take_along_axis(named, turn, 1)
            full = rows[self.found[rows] == self.k]
            self.least[full] = np.maximum(self.least[full], self.score[full, -1])


def _subtrees(rows: DataFrame) -> tuple[DataFrame, int]:
    """Subtrees by number, with the ranges of distances to the root's split points, and how many there are."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, largest = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    if not total:
        return spark.createDataFrame([], "number int, tree binary, low array<double>, high array<double>, root binary"), 0
    sample = matrix([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    lift = lifted(sample, largest)
    root = spark.sparkContext.broadcast((lift[far_apart(lift, ROOT_FAN)] if np.isfinite(largest) else lift[:1], largest))

    def distances(lists: list[list[float]]) -> np.ndarray:
        splits, longest = root.value
        points = matrix(lists, splits.shape[1] - 1)
        wide = np.zeros((len(splits), points.shape[1] + 1))
        wide[:, : splits.shape[1] - 1], wide[:, -1] = splits[:, :-1], splits[:, -1]
        return between(lifted(points, longest), wide)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.nan_to_num(distances(batch.column(2).to_pylist())).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "label", "v", "cell"])

    dealt = stored(spark, rows.mapInArrow(deal, "vec_id long, label long, v array<double>, cell int"), "cells")
    # one number for each split point
    parts, before = {}, 0
    for cell, size in sorted(map(tuple, dealt.groupBy("cell").count().collect())):
        parts[cell] = (before, -(-size // SUBTREE))
        before += parts[cell][1]
    place = spark.createDataFrame([(c, *p) for c, p in parts.items()], "cell int, before int, parts int")
    numbered = dealt.join(F.broadcast(place), "cell").select("vec_id", "label", "v", (F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("number"))

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        lists = group.column("v").to_pylist()
        apart = distances(lists)
        tree = Tree.grown(group.column("vec_id").to_numpy(), group.column("label").to_numpy(), matrix(lists), root.value[1])
        cells = [group.column("number")[0].as_py(), tree.packed(), apart.min(0).tolist(), apart.max(0).tolist()]
        return pa.table([pa.array([x], k) for x, k in zip(cells, (pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["number", "tree", "low", "high"])

    grown = numbered.groupBy("number").applyInArrow(grow, "number int, tree binary, low array<double>, high array<double>")
    return stored(spark, grown, "subtrees").withColumn("root", F.lit(_as_bytes(root.value[0]))), before


def _as_bytes(splits: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, splits)
    return out.getvalue()


def _blocks(queries: DataFrame) -> DataFrame:
    """Blocks of at most `QUERY_ROWS` queries, their vectors as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                points = matrix(part.column(5).to_pylist())
                cells = [number, *[part.column(c).to_numpy().astype("<i8").tobytes() for c in range(5)], points.shape[1], points.tobytes()]
                kinds = [pa.int64(), *[pa.binary()] * 5, pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], ["block", "own", "label", "positive", "least", "most", "dims", "points"])
                number += 1

    return queries.select(*[c.split()[0] for c in QUERY.split(", ")]).mapInArrow(run, "block long, own binary, label binary, positive binary, least binary, most binary, dims int, points binary")


def _best(queries: DataFrame, subtrees: DataFrame, count: int, same: bool, k: int) -> DataFrame:
    """Each query's k best rows, of its label or of all others: `FOUND`."""
    spark = queries.sparkSession
    groups = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = _blocks(queries).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = subtrees.withColumn("g", F.col("number") % groups)
    met = left.join(right, "g").select("block", "own", "label", "positive", "least", "most", "dims", "points", "tree", "low", "high", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Queries, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, positive in held.values():
                row, place = np.nonzero(np.arange(k) < block.found[:, None])
                cells = block.own[row], positive[row], block.id[row, place], block.score[row, place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], [c.split()[0] for c in FOUND.split(", ")])
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                name, own, label, positive, least, most, dims, points, tree, low, high, root = (c[at].as_py() for c in batch.columns)
                if name not in held:
                    if len(held) * QUERY_ROWS >= HELD:
                        yield from out()
                    own, label, positive, least, most = (np.frombuffer(x, "<i8") for x in (own, label, positive, least, most))
                    held[name] = Queries(own, label, least, most, np.frombuffer(points, float).reshape(len(own), dims), same, k), positive
                block, tree, splits = held[name][0], Tree.unpacked(tree), np.load(io.BytesIO(root), allow_pickle=False)
                d = min(block.points.shape[1], splits.shape[1] - 1)
                with np.errstate(all="ignore"):
                    apart = np.sqrt(np.maximum(block.length[:, None] + float(tree.square) - 2 * (block.points[:, :d] @ splits[:, :d].T), 0))
                    near = np.maximum(apart - np.array(high), np.array(low) - apart).max(1)
                block.search(tree, np.nan_to_num(near, nan=-np.inf))
        yield from out()

    found = met.mapInArrow(run, FOUND)
    top = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id", "score"))), 1, k)
    names = ["own", "positive"]
    # a group of subtrees gives at most k rows a query; two steps keep what one group of rows holds small
    first = found.groupBy(*names, F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part")).agg(top.alias("best")).select(*names, F.inline("best"))
    final = first.groupBy(*names).agg(top.alias("best")).select(*names, F.posexplode("best").alias("p", "b"))
    return final.select(*names, (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def mine(table: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    is_anchor tells anchors by vec_id. An anchor's positives are its best other rows of the same label. For each positive the best
    rows of other labels follow whose score is from `low` to `high` hundredths of the positive's.
    """
    spark = ready(table.sparkSession)
    rows = stored(spark, vectors(table, F.col("label") if label is None else label), "vectors")
    subtrees, count = _subtrees(rows)
    anchors = rows.where(is_anchor)
    everything = anchors.select(F.col("vec_id").alias("own"), "label", F.lit(0).cast("long").alias("positive"), F.lit(LOW).alias("least"), F.lit(HIGH).alias("most"), "v")
    best = stored(spark, _best(everything, subtrees, count, True, positives), "positives").select("own", F.col("vec_id").alias("positive"), "score")
    # whole scores from low to high hundredths; decimals, since products may be beyond 64 bits
    part = "{} * CAST(score AS DECIMAL(25, 0)) / 100BD"
    window = best.withColumn("least", F.expr("ceil(" + part.format(low) + ")")).withColumn("most", F.expr("floor(" + part.format(high) + ")"))
    windows = window.where("least <= most").join(anchors.withColumnRenamed("vec_id", "own"), "own")
    queries = windows.select("own", "label", "positive", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "v")
    found = _best(queries, subtrees, count, False, negatives).withColumnsRenamed({"own": "anchor_id", "positive": "positive_id", "vec_id": "negative_id", "score": "negative_score"})
    scores = best.select(F.col("own").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
