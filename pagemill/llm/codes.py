"""Compressing vectors to codes by exact k-means over metric trees.

A vector becomes integers, its parts get a codebook each, and a code names the nearest entry for every part. The
rounds are those of plain k-means with integer means; what they cost is less. Blocks of rows hold one metric tree for every
part, grown by an anchors hierarchy: some sqrt(n) anchors take over each other's points, the nearest ones
starting from the anchor of the largest radius; balls are merged upwards by the smallest radius, and each anchor's points are
divided the same way downwards. A ball caches the sum and the number of its points.

In a round every ball inherits the entries that may be nearest to one of its points from the ball around it, and strikes
those that another one beats for all its points. With one entry left the ball is its own, and its cached sum is
added without a look at its points; only points of leaves with several entries left are compared. Entries are struck
only beyond the error of floating point, and leaves are compared in integers, so the result is that of comparing everything.

Trees are written once and read in every round. A task sends one sum for each entry; the driver holds codebooks alone, whose size is fixed
for a length of vectors. Rows are only ever held a block at a time, so no label or vector can be a hot key.

Rows: null vectors and those with null or not finite components are dropped. Rows of equal ids are ordered by their vector where the first
entries are chosen, null ids come last. Vectors of different lengths are compressed apart, with a codebook for each
length; a length that is no multiple of the parts makes the first parts one longer, and empty parts are nearest to the first
entry. With fewer rows than entries the codebook is that much smaller. Components beyond some 65,536 in size (8 to a part) are
held there, so that all sums of squares fit 64 bits. Empty tables give empty tables; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import Scratch, hot_join

_LEAF = 24  # points that are not divided any more
_BLOCK = 8192  # rows that share trees


def bounds(length: int, parts: int) -> list[int]:
    """Where parts of a vector start, and the end of the last one."""
    return [0, *np.cumsum([length // parts + (i < length % parts) for i in range(parts)]).tolist()]


def whole(values: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """Rows of numbers as integers, rounded down, held where sums of squares would not fit."""
    most = int((2**61 / max(1, -(-values.shape[1] // parts))) ** 0.5 / 2)
    return np.clip(np.floor(values * float(scale)), -most, most).astype(np.int64)


# --- growing trees


def _anchors(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Indexes of the points of at most ``k`` anchors.

    Each new anchor is the point furthest from the anchor with the largest radius. It takes over points that
    are nearer to it; an anchor less than half as far from its furthest point as from the new one loses none.
    """
    dist = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    owner = np.zeros(len(x), np.int64)
    at, radius = [x[0]], [dist.max()]
    while len(at) < k:
        widest = int(np.argmax(radius))
        if radius[widest] == 0:
            break
        mine = np.flatnonzero(owner == widest)
        new = x[mine[np.argmax(dist[mine])]]
        apart = np.sqrt(((np.array(at) - new) ** 2).sum(axis=1))
        near = np.flatnonzero((apart < 2 * np.array(radius))[owner])
        far = np.sqrt(((x[near] - new) ** 2).sum(axis=1))
        won = far < dist[near]
        owner[near[won]], dist[near[won]] = len(at), far[won]
        at.append(new)
        radius.append(0.0)
        for o in np.flatnonzero(apart < 2 * np.array(radius[:-1])).tolist() + [len(at) - 1]:
            own = dist[owner == o]
            radius[o] = float(own.max()) if len(own) else 0.0
    return [g for g in (np.flatnonzero(owner == o) for o in range(len(at))) if len(g)]


def _grow(x: np.ndarray, idx: np.ndarray):
    """A tree of points: an array of indexes, or a pair of trees."""
    if len(idx) <= _LEAF:
        return idx
    groups = _anchors(x[idx], int(len(idx) ** 0.5) + 1)
    if len(groups) == 1:
        return idx  # all points are equal
    balls = [_grow(x, idx[g]) for g in groups]
    centre = np.array([x[idx[g]].mean(axis=0) for g in groups])
    count = np.array([len(g) for g in groups], float)
    radius = np.array([np.sqrt(((x[idx[g]] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centre)])
    # Middle out: the two balls whose common one has the smallest radius become one, until one is left.
    n, live = len(balls), np.ones(len(balls), bool)

    def common(i):
        share = (count / (count + count[i]))[:, None]
        mid = centre * share + centre[i] * (1 - share)
        size = lambda c, r: np.sqrt(((mid - c) ** 2).sum(axis=1)) + r
        out = np.maximum(size(centre, radius), size(centre[i], radius[i]))
        out[~live], out[i] = np.inf, np.inf
        return out

    cost = np.array([common(i) for i in range(n)])
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(cost)), n)
        radius[i] = cost[i, j]
        centre[i] = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
        count[i] += count[j]
        balls[i], balls[j], live[j] = (balls[i], balls[j]), None, False
        cost[j, :], cost[:, j] = np.inf, np.inf
        cost[i, :] = cost[:, i] = common(i)
    return balls[i] if n > 1 else balls[0]


@dataclass
class Tree:
    """Balls over points in the order of the leaves; ball 0 holds all, and a ball comes before those inside it."""

    order: np.ndarray  # row of each point
    points: np.ndarray
    start: np.ndarray  # points of each ball
    end: np.ndarray
    left: np.ndarray  # balls inside, -1 for leaves
    right: np.ndarray
    total: np.ndarray  # cached sum
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def grow(cls, x: np.ndarray) -> Tree:
        nested = _grow(x.astype(float), np.arange(len(x)))
        order, start, end, left, right = [], [], [], [], []
        at, stack = 0, [(nested, -1, None)]
        while stack:  # depth first, so that the points of a ball are neighbours
            tree, above, side = stack.pop()
            if above >= 0:
                side[above] = len(start)
            node = len(start)
            start.append(at)
            end.append(at)
            left.append(-1)
            right.append(-1)
            if isinstance(tree, tuple):
                stack += [(tree[1], node, right), (tree[0], node, left)]
            else:
                order.append(tree)
                at += len(tree)
                end[node] = at
        for node in reversed(range(len(start))):
            if right[node] >= 0:
                end[node] = end[right[node]]
        order = np.concatenate(order)
        points = x[order]
        sums = np.vstack([np.zeros((1, x.shape[1]), np.int64), points.cumsum(axis=0)])
        start, end = np.array(start), np.array(end)
        total = sums[end] - sums[start]
        centre = total / (end - start)[:, None]
        radius = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max(initial=0)) for a, b, c in zip(start, end, centre)])
        return cls(order, points, start, end, np.array(left), np.array(right), total, centre, radius)

    def owned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls with the entry that owns each, and single points with the nearest entry of each."""
        e, k = entries.astype(float), len(entries)
        size = (e * e).sum(axis=1)
        between = np.sqrt(((e[:, None] - e) ** 2).sum(axis=2))
        balls, owners, points, nearest = [], [], [], []
        front, may = np.array([0]), np.ones((1, k), bool)
        while len(front):
            c, r = self.centre[front], self.radius[front]
            gap = size - 2 * (c @ e.T)  # squared distance of the centre, but for what all entries have in common
            best = np.where(may, gap, np.inf).argmin(axis=1)
            row = np.arange(len(front))
            # How much further than the best one an entry is at least, over all points of the ball.
            lead = gap - gap[row, best][:, None] - 2 * r[:, None] * between[best]
            slack = 1e-9 * (size.max() + (c * c).sum(axis=1) + r * r + 1)
            may &= lead <= slack[:, None]
            may[row, best] = True
            alone = may.sum(axis=1) == 1
            balls.append(front[alone])
            owners.append(best[alone])
            leaf = self.left[front] < 0
            for i in np.flatnonzero(leaf & ~alone):
                own = np.flatnonzero(may[i])
                inside = np.arange(self.start[front[i]], self.end[front[i]])
                far = ((self.points[inside][:, None] - entries[own]) ** 2).sum(axis=2)
                points.append(inside)
                nearest.append(own[far.argmin(axis=1)])  # the first of equals
            go = ~alone & ~leaf
            front, may = np.concatenate([self.left[front[go]], self.right[front[go]]]), np.concatenate([may[go], may[go]])
        join = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
        return join(balls), join(owners), join(points), join(nearest)

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum and the number of the points of each entry."""
        balls, owners, points, nearest = self.owned(entries)
        total, count = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        np.add.at(total, owners, self.total[balls])
        np.add.at(count, owners, self.end[balls] - self.start[balls])
        np.add.at(total, nearest, self.points[points])
        np.add.at(count, nearest, 1)
        return total, count

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry and the squared distance of every row."""
        balls, owners, points, nearest = self.owned(entries)
        code = np.zeros(len(self.order), np.int64)
        for a, b, o in zip(self.start[balls], self.end[balls], owners):
            code[a:b] = o
        code[points] = nearest
        error = ((self.points - entries[code]) ** 2).sum(axis=1)
        back = np.argsort(self.order)
        return code[back], error[back]


_FIELDS = list(Tree.__dataclass_fields__)


def _packed(trees: Sequence[Tree]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{f}{i}": getattr(t, f) for i, t in enumerate(trees) for f in _FIELDS})
    return out.getvalue()


def _unpacked(data: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(data), allow_pickle=False) as a:
        return [Tree(**{f: a[f"{f}{i}"] for f in _FIELDS}) for i in range(parts)]


# --- jobs


def _blocks(scale: int, parts: int, rows_type: pa.DataType):
    """Rows (v, r) as blocks of trees with their payload ``r``."""

    def block(length: int, held: list[tuple[np.ndarray, pa.Array]]) -> pa.RecordBatch:
        x = np.concatenate([v for v, _ in held])
        payload = pa.concat_arrays([r for _, r in held])
        cut = bounds(length, parts)
        trees = _packed([Tree.grow(x[:, a:b]) for a, b in zip(cut, cut[1:])])
        rows = pa.ListArray.from_arrays(pa.array([0, len(payload)], pa.int32()), payload, type=pa.list_(rows_type))
        return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([trees], pa.binary()), rows], names=["length", "trees", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting = 0
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                pick = pa.array(np.flatnonzero(lengths == length))
                for at in range(0, len(pick), _BLOCK):
                    own = batch.take(pick[at : at + _BLOCK])
                    values = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), length)
                    held.setdefault(int(length), []).append((whole(values, scale, parts), own.column("r").cast(rows_type)))
                    waiting += len(own)
                    if sum(len(r) for _, r in held[length]) >= _BLOCK:
                        waiting -= sum(len(r) for _, r in held[length])
                        yield block(int(length), held.pop(length))
            if waiting > 4 * _BLOCK:  # many lengths
                for length in list(held):
                    yield block(length, held.pop(length))
                waiting = 0
        for length in list(held):
            yield block(length, held.pop(length))

    return run


Books = dict[int, list[np.ndarray]]


def _sums(books: Books, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for length, data in zip(batch.column("length").to_pylist(), batch.column("trees")):
                for part, (tree, entries) in enumerate(zip(_unpacked(data.as_py(), parts), books[length])):
                    total, count = tree.sums(entries)
                    if (length, part) in held:
                        total, count = total + held[length, part][0], count + held[length, part][1]
                    held[length, part] = total, count
        rows = [(n, p, e, c, t) for (n, p), (total, count) in held.items() for e, (c, t) in enumerate(zip(count.tolist(), total.tolist())) if c]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000]), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                names=["length", "part", "entry", "n", "total"],
            )

    return run


def _assign(books: Books, parts: int, out_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (length, data) in enumerate(zip(batch.column("length").to_pylist(), batch.column("trees"))):
                found = [t.assigned(e) for t, e in zip(_unpacked(data.as_py(), parts), books[length])]
                code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                error = sum(e for _, e in found)
                text = code.tobytes().hex()
                step = 2 * parts
                codes = pa.array([text[j : j + step] for j in range(0, len(text), step)], pa.string())
                rows = batch.column("rows")[i].values.cast(out_type)
                size = pa.array(np.full(len(rows), length, np.int32))
                yield pa.RecordBatch.from_arrays([rows, size, codes, pa.array(error, pa.int64())], names=["r", "length", "code", "error"])

    return run


def compress(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, Books]:
    """Rows (r: struct of key and ``carry``, length, code, error), and the final codebooks of each length, one array a part.

    A code has two hex digits for each part, so ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, hence 1 to 256 entries")
    spark = df.sparkSession
    scratch = Scratch(spark, "codes")
    v = F.col(vector).cast("array<double>")
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = df.select(v.alias("v"), F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("r"))
    rows = rows.filter(f"v IS NOT NULL AND {finite}")

    # Spark cuts to the first rows of each length before its shuffle.
    order = W.partitionBy(F.size("v")).orderBy(F.col("r.key").asc_nulls_last(), "v")
    first = rows.select("v", "r").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= entries)
    books: Books = {}
    for r in sorted(first.select("n", "v").collect(), key=lambda r: r.n):
        values = whole(np.array([r.v], float).reshape(1, -1), scale, parts)
        cut = bounds(len(r.v), parts)
        own = books.setdefault(len(r.v), [np.zeros((0, b - a), np.int64) for a, b in zip(cut, cut[1:])])
        books[len(r.v)] = [np.vstack([e, values[:, a:b]]) for e, a, b in zip(own, cut, cut[1:])]

    kind = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("trees", T.BinaryType()), T.StructField("rows", T.ArrayType(rows.schema["r"].dataType))])
    arrow = _arrow_type(rows)
    trees = scratch.keep(rows.mapInArrow(_blocks(scale, parts, arrow), kind))
    for _ in range(rounds):
        found = trees.select("length", "trees").mapInArrow(_sums(books, parts), "length int, part int, entry int, n long, total array<long>")
        # One row a task and entry; positions are summed apart.
        found = found.select("length", "part", "entry", "n", F.posexplode_outer("total").alias("at", "t"))
        found = found.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        new = {n: [e.copy() for e in own] for n, own in books.items()}
        for r in found.collect():  # a number for each component of the codebooks
            if r.at is not None:
                new[r.length][r.part][r.entry][r.at] = r.t // r.n
        same = all(np.array_equal(a, b) for n in books for a, b in zip(books[n], new[n]))
        books = new
        if same:  # further rounds change nothing
            break
    out = T.StructType([rows.schema["r"], T.StructField("length", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return scratch.keep(trees.mapInArrow(_assign(books, parts, arrow), out)), books


def _arrow_type(rows: DataFrame) -> pa.DataType:
    """The Arrow type that Spark gives the payload."""
    return pa.Table.from_batches(rows.select("r").limit(0).toArrow().to_batches(), schema=rows.select("r").limit(0).toArrow().schema).schema.field("r").type


def books_sha256(books: Sequence[np.ndarray]) -> str:
    """The digest of all components by part, entry and position, decimal, with commas between them."""
    return hashlib.sha256(",".join(str(x) for part in books for x in part.ravel().tolist()).encode()).hexdigest()


def with_books(codes: DataFrame, books: Books, out: str = "codebooks_sha256") -> DataFrame:
    """Adds the digest of the codebooks of the length of each row."""
    digest = F.lit(None).cast("string")
    if books:
        digest = F.create_map(*[F.lit(x) for n, own in books.items() for x in (n, books_sha256(own))])[F.col("length")]
    return codes.withColumn(out, digest)


def label_errors(codes: DataFrame, label: Column, out: str = "label_error") -> DataFrame:
    """Adds the sum of the errors of all rows with the same label, nulls together.

    A label that very many rows have is summed in every task first and its rows are dealt over several tasks.
    """
    name = F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))
    codes = codes.withColumn("__label", name)
    sums = codes.groupBy("__label").agg(F.sum("error").alias(out), F.count("*").alias("__rows"))
    return hot_join(codes, sums, "__label", "__rows").drop("__label", "__rows")
