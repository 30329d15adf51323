"""Vector compression to product codes: every vector is cut into equal parts, and each part becomes the number of its nearest codebook entry.

The nearest entry is found by a vantage-point tree over the entries of a part position, a tree a position. A node holds an entry and splits the others into those within the
median distance of it and those beyond, with the least and the largest distance of either side. By the triangle inequality a side holds nothing nearer than
its least distance less, or the part's own less its largest distance. These bounds are rounded to the safe side, a side is passed over only if its bound lies strictly
above the best distance so far (ties must be seen), and what is visited is compared by whole squared distances. So codes are exact: the least squared
distance, ties to the lower number. All parts of a batch walk the tree together: first down to one leaf each, for a good first distance, then over what their bounds leave.

Codebooks are fitted by whole rounds over all vectors: each task adds up its parts by entry, Spark adds up the tasks' sums, and the driver divides. It holds
entries x dimension numbers (``PARTS`` positions of ``ENTRIES`` entries), whatever the number of vectors, and so do the broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise
from .topk import quantised

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a node that isn't split any more.
LEAF = 6
#: Parts that walk the tree together, which bounds the distance matrices.
STEP = 1 << 15
#: Relative slack of the square roots in bounds.
SLACK = 1e-9
LONG = (1 << 63) - 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows a to one point b or to rows b, whole numbers: in 64 bits where they fit, else in Python's integers."""
    difference = a - b
    return (difference * difference).sum(axis=-1)


def _fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which differences, their squares and sums of these over a row are exact."""
    most = max((max(abs(int(x.min())), abs(int(x.max()))) for x in arrays if x.size), default=0)
    width = max(x.shape[-1] for x in arrays)
    kind = np.int64 if width * (2 * most) ** 2 <= LONG else object
    return [x.astype(kind) for x in arrays]


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Node:
    """A leaf has members only; a node has a vantage entry and (least, largest distance, child) of its sides."""

    members: np.ndarray
    vantage: int = -1
    sides: tuple = ()


class Tree:
    """Vantage-point tree over the entries (rows of whole numbers) of one part position."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf, self.compared = entries, leaf, 0
        self.top = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> Node:
        if len(members) <= self.leaf:
            return Node(members)
        # The entry farthest from the first one lies at the rim, where the distances to the others spread most.
        vantage = members[int(np.argmax(_root(_distances(self.entries[members], self.entries[members[0]]))))]
        rest = members[members != vantage]
        far = _root(_distances(self.entries[rest], self.entries[vantage]))
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        sides = tuple((far[s].min() * (1 - SLACK), far[s].max() * (1 + SLACK), self._node(np.sort(rest[s]))) for s in (order[:half], order[half:]))
        return Node(members, int(vantage), sides)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, squared distance) of each part."""
        best = np.full(len(parts), len(self.entries), dtype=np.int64)
        error = np.zeros(len(parts), dtype=parts.dtype)
        # Reach: nothing beyond it can be as near as the best so far.
        reach = np.full(len(parts), np.inf)

        def meet(rows: np.ndarray, entry: int) -> np.ndarray:
            """Compares rows with an entry; their distances."""
            self.compared += len(rows)
            found = _distances(parts[rows], self.entries[entry])
            better = (best[rows] == len(self.entries)) | (found < error[rows]) | ((found == error[rows]) & (entry < best[rows]))
            won = rows[better.astype(bool)]
            best[won], error[won] = entry, found[better.astype(bool)]
            reach[won] = _root(error[won]) * (1 + SLACK)
            return _root(found)

        def bound(far: np.ndarray, side: tuple) -> np.ndarray:
            return np.maximum(side[0] - far * (1 + SLACK), far * (1 - SLACK) - side[1])

        def descend(node: Node, rows: np.ndarray) -> None:
            if not node.sides:
                for entry in node.members:
                    meet(rows, entry)
            elif len(rows):
                far = meet(rows, node.vantage)
                inner = bound(far, node.sides[0]) <= bound(far, node.sides[1])
                descend(node.sides[0][2], rows[inner])
                descend(node.sides[1][2], rows[~inner])

        def visit(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if not node.sides:
                for entry in node.members:
                    meet(rows, entry)
                return
            far = meet(rows, node.vantage)
            for side in node.sides:
                near = bound(far, side) <= reach[rows]
                visit(side[2], rows[near])

        every = np.arange(len(parts))
        descend(self.top, every)
        visit(self.top, every)
        return best, error


class Codebooks:
    """Entries of every part position: an array parts x entries x width of whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.dimension = entries.shape[0] * entries.shape[2]

    def trees(self) -> list[Tree]:
        return [Tree(e) for e in self.entries]

    def text(self) -> str:
        """All components in order of part, entry and position, decimal, joined by commas."""
        return ",".join(str(int(x)) for x in self.entries.ravel())


def _whole(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dimension)


def assigned(vectors: np.ndarray, books: Codebooks, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: (parts, numbers, squared distances)."""
    width = books.entries.shape[2]
    for p, tree in enumerate(trees):
        mine, tree.entries = _fitting(vectors[:, p * width : (p + 1) * width], tree.entries)
        yield mine, *tree.nearest(mine)


def kept(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """rows with v, the whole components floor(scale * x), in place of the vector; rows whose vector is null or holds null or non-finite components go."""
    sound = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    empty = F.array().cast("array<bigint>")
    return rows.filter(sound).withColumn("v", F.when(F.size(vector) > 0, quantised(F.col(vector), scale)).otherwise(empty)).drop(vector)


def started(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the vectors of the smallest ids (nulls last, then by vector), fewer if there are fewer rows; None for an empty table.

    The first vector sets the dimension. Raises ValueError if it can't be cut into equal parts.
    """
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    if not first:
        return None
    dimension = len(first[0].v)
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components can't be cut into {parts} equal parts")
    chosen = rows.filter(F.size("v") == dimension).select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    whole = np.array([r.v for r in chosen], dtype=object).reshape(len(chosen), parts, dimension // parts)
    return Codebooks(whole.transpose(1, 0, 2))


def refined(spark: SparkSession, rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean; an entry without parts stays."""
    shared = spark.sparkContext.broadcast(books.entries)
    shape = "part int, entry int, position int, total string, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        trees, (parts, entries, width) = own.trees(), own.entries.shape
        total, n = np.zeros((parts, entries, width), dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                vectors = _whole(batch.column(0).slice(a, STEP), own.dimension)
                for p, (mine, code, _) in enumerate(assigned(vectors, own, trees)):
                    order = np.argsort(code, kind="stable")
                    used, begin = np.unique(code[order], return_index=True)
                    # A run of at most STEP whole numbers below 2**63 / STEP adds up in 64 bits.
                    small = mine.size == 0 or max(abs(int(mine.min())), abs(int(mine.max()))) < LONG // STEP
                    total[p, used] += np.add.reduceat(mine[order] if small else mine[order].astype(object), begin, axis=0).astype(object)
                    n[p] += np.bincount(code, minlength=entries)
        p, e, w = (x.ravel() for x in np.indices(total.shape))
        seen = n[p, e] > 0
        sums = pa.array([str(x) for x in total.ravel()[seen]], pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array(x[seen], pa.int32()) for x in (p, e, w)), sums, pa.array(n[p, e][seen], pa.int64())], ["part", "entry", "position", "total", "n"])

    sums = rows.filter(F.size("v") == books.dimension).select("v").mapInArrow(run, shape)
    # Sums of at most 2**63 rows of 64-bit numbers fit 38 digits; at most entries x dimension rows come back.
    whole = sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    entries = books.entries.copy()
    for r in whole:
        entries[r.part, r.entry, r.position] = int(r.total) // r.n
    return Codebooks(entries)


def coded(spark: SparkSession, rows: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """Columns keep of rows(v, ...) with code (two hex digits a part) and error (squared distances summed over the parts, at most the largest long).

    Null code and error where the vector's length is not the codebooks'.
    """
    shared = spark.sparkContext.broadcast(books.entries)
    frame = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.when(F.size("v") == books.dimension, F.col("v")).alias("v"))
    names, at = frame.columns[:-1], len(keep)
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1]) + "code string, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        trees = own.trees()
        hexes = np.array([f"{i:02x}" for i in range(own.entries.shape[1])], dtype="U2")
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                column = part.column(at)
                fits = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                vectors = _whole(column.drop_null(), own.dimension)
                code, error = np.full(part.num_rows, None, dtype=object), np.full(part.num_rows, None, dtype=object)
                if len(fits):
                    found = [(c, e) for _, c, e in assigned(vectors, own, trees)]
                    letters = np.ascontiguousarray(hexes[np.stack([c for c, _ in found], axis=1)])
                    code[fits] = letters.view(f"U{2 * len(found)}").ravel()
                    error[fits] = [min(int(x), LONG) for x in sum(e.astype(object) for _, e in found)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*names, "code", "error"])

    return frame.mapInArrow(run, shape).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "code", "error")


def summed_by(rows: DataFrame, label: str, value: str, name: str, share: int = 1000) -> DataFrame:
    """rows with name, the sum of value over the rows of equal label (nulls are one label; a sum beyond a long is held to it).

    Labels of more than one row in share are at most share many: their sums are broadcast, so no task gathers the rows of a common label; the others meet their sums in a join by label.
    """
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    held = F.when(total > LONG, LONG).when(total < -LONG, -LONG).otherwise(total).cast("long")
    sums = materialise(rows.sparkSession, rows.groupBy(F.col(label).alias("_l")).agg(held.alias(name), F.count("*").alias("_n")))
    bound = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] / share
    common = F.broadcast(sums.filter(F.col("_n") > bound).select("_l", name))
    rare = sums.filter(F.col("_n") <= bound).select("_l", name)
    meets = rows[label].eqNullSafe(F.col("_l"))
    hot = rows.join(common, meets).drop("_l")
    return hot.unionByName(rows.join(common, meets, "left_anti").join(rare, meets).drop("_l"))


def compressed(spark: SparkSession, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, code, error, label_error) of every sound row of vectors, the codebooks).

    Codebooks start from the vectors of the smallest ids and are refined over all rows. Rows whose vector is null or holds null or non-finite components go. Vectors
    of another length than that of the smallest id stay, with null code and error. Null ids and labels stay; repeated rows are coded each; other
    columns are not read. Components beyond a long are held to it. An empty table gives no rows and no codebooks. At most 256 entries, two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    rows = kept(vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("e")), "e")
    books = started(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error")), None
    for _ in range(rounds):
        books = refined(spark, rows, books)
    found = materialise(spark, coded(spark, rows, books, ["vec_id", "label"]))
    return summed_by(found, "label", "error", "label_error").select("vec_id", "code", "error", "label_error"), books
