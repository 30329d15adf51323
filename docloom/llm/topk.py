"""Exact top-k inner products by the three-phase uniform threshold algorithm.

A score is the sum of the partial scores of ``SLICES`` slices of the components; for one query, every slice is a list of partial
scores over the candidates. Candidates are dealt into shards, queries into blocks; a (shard, block) cell is one task's work.

1. Gather: every cell makes its list of the first slice only, takes the head of it, completes the scores of the head, and gives the k best for each query.
   The k-th best over all cells is the query's cutoff: k candidates reach it, so it is safe.
2. Broadcast and collect: the cutoff goes back to every cell. A partial score is at most the product of the slice's two norms, so a candidate whose known
   partial scores and norm products don't add up to the cutoff is out. Slice by slice, from the one with the largest norms on, what is left is
   collected; a query whose cutoff the cell's largest norms can't reach costs no product at all.
3. Resolve: of those collected, the remaining slices are added up exactly, for them alone where few are left. What reaches the cutoff goes on, at most the
   k best of a cell (a cell's others cannot be among the k best of all, so nothing is lost, and very many equal vectors cost no more than others), and is ranked.

So a pair costs one slice in the first phase and at most all of them in the others. Comparisons are inclusive, and ties are broken by id only among
exact scores. Vectors are compared with those of their own length only. Sums are exact: in double precision below 2**53, in 64-bit integers below
2**63, and in Python's integers beyond, which are then held to the range of a long and ranked as such.

Growth: the queries are a stated set against all rows, so the products are queries x candidates; a candidate is copied once for every
BLOCK queries, a query once for every SHARD candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

SLICES = 4
SHARD, BLOCK = 4096, 4096
#: Queries of a block are worked on in parts of so many, which bounds the score matrices.
PART = 256


def quantised(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double; null if the vector is null, empty or has a null or non-finite component."""
    sound = (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(sound, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of one length, as integers."""
    values = table.column("v").combine_chunks().flatten().to_numpy()
    return values.reshape(table.num_rows, -1)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type in which all inner products are exact."""
    largest = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (q, c)]
    most = largest[0] * largest[1] * q.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return q.astype(kind), c.astype(kind)


class Cell:
    """The score lists of some queries over one shard: slices ordered by the candidates' norms, with the norms of both sides."""

    def __init__(self, q: np.ndarray, c: np.ndarray, slices: int):
        edge = np.unique(np.linspace(0, q.shape[1], slices + 1).astype(int))
        cut = sorted((slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)), key=lambda s: -float((c[:, s].astype(np.float64) ** 2).sum()))
        q, c = _exact(q, c)
        self.q, self.c = [q[:, s] for s in cut], [c[:, s] for s in cut]
        norm = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6
        self.nq, self.nc = [norm(m) for m in self.q], [norm(m) for m in self.c]

    def scores(self, rows: np.ndarray, near: np.ndarray, since: int = 0) -> np.ndarray:
        """Exact sums of the slices from since on, of given pairs."""
        return sum(((self.q[s][rows] * self.c[s][near]).sum(axis=1) for s in range(since, len(self.q))), np.zeros(len(rows), dtype=self.q[0].dtype))


def _best(rows: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: by score, then by candidate (in order of ids)."""
    order = np.lexsort((near, ~score, rows))
    own = rows[order]
    start = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1)) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < k]


def _long(score: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score], dtype=np.int64) if score.dtype == object else score.astype(np.int64)


def _gather(cell: Cell, names: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate, score): the k best of the heads of the first list."""
    first = cell.q[0] @ cell.c[0].T
    head = min(2 * k + 2, len(names))
    near = (np.argsort(-first, axis=1)[:, :head] if first.dtype == object else np.argpartition(first, len(names) - head, axis=1)[:, len(names) - head :]).ravel()
    rows = np.repeat(np.arange(len(ids)), head)
    own = names[near] != ids[rows]
    rows, near = rows[own], near[own]
    score = _long(first[rows, near] + cell.scores(rows, near, 1))
    top = _best(rows, near, score, k)
    return rows[top], near[top], score[top]


def _collect(cell: Cell, names: np.ndarray, ids: np.ndarray, cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate, score) of the k best that reach the cutoff (minus infinity: all reach it)."""
    slices = len(cell.q)
    reach = sum((cell.nq[s] * cell.nc[s].max() for s in range(slices)), np.zeros(len(ids)))
    asked = np.flatnonzero(reach >= cutoff)
    none = np.zeros(0, dtype=np.int64)
    if not len(asked):
        return none, none, none
    known, rows, near = None, None, None
    for s in range(slices):
        if rows is None:
            part = cell.q[s][asked] @ cell.c[s].T
            known = part if known is None else known + part
            bound = known.astype(np.float64)
            for later in range(s + 1, slices):
                bound += cell.nq[later][asked][:, None] * cell.nc[later]
            alive = bound >= cutoff[asked][:, None]
            # Few left: the rest of the slices for them alone.
            if s == slices - 1 or alive.mean() < 0.05:
                at, near = np.nonzero(alive)
                rows, known = asked[at], known[at, near]
        else:
            known = known + (cell.q[s][rows] * cell.c[s][near]).sum(axis=1)
            bound = known.astype(np.float64) + sum(cell.nq[later][rows] * cell.nc[later][near] for later in range(s + 1, slices))
            alive = bound >= cutoff[rows]
            rows, near, known = rows[alive], near[alive], known[alive]
    good = (names[near] != ids[rows]) & (known >= cutoff[rows]).astype(bool)
    rows, near, known = rows[good], near[good], _long(known[good])
    top = _best(rows, near, known, k)
    return rows[top], near[top], known[top]


def search(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int, slices: int = SLICES, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best candidates of each row of queries; all, if there are fewer.

    queries(query_id, v) and candidates(vec_id, v) hold arrays of integers; null ids and null or empty vectors take no part, and vectors of different lengths don't
    meet. A candidate whose id is the query's own is left out. Ties go to the smaller vec_id. Repeated candidate ids count as separate candidates with
    equal ids; repeated query rows are queries of their own. Other columns are not read. k < 1 or an empty side gives no rows.
    """
    sound = "v is not null and size(v) > 0"
    asked = materialise(spark, queries.filter(f"query_id is not null and {sound}").select(F.monotonically_increasing_id().alias("q"), F.col("query_id").cast("long").alias("query_id"), "v"))
    offered = candidates.filter(f"vec_id is not null and {sound}").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    shards = max(1, -(-offered.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    number = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("block", number(blocks, "q")).withColumn("shard", every(shards)).withColumn("dim", F.size("v"))
    right = offered.withColumn("shard", number(shards, "vec_id", "v")).withColumn("block", every(blocks)).withColumn("dim", F.size("v"))
    shape, answer = "q bigint, query_id bigint, vec_id bigint, score bigint", pa.schema([(c, pa.int64()) for c in ("q", "query_id", "vec_id", "score")])

    def over(work):
        """Runs work(cell, names, ids, cutoff) on the parts of a cell's queries."""

        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows or k < 1:
                return answer.empty_table()
            c = c.sort_by("vec_id")
            names, vectors, asked_vectors = c.column("vec_id").to_numpy(), _matrix(c), _matrix(q)
            row, ids = q.column("q").to_numpy(), q.column("query_id").to_numpy()
            cut = q.column("cutoff").fill_null(-np.inf).to_numpy() if "cutoff" in q.schema.names else np.full(len(ids), -np.inf)
            out = []
            for a in range(0, len(ids), PART):
                p = slice(a, a + PART)
                at, near, score = work(Cell(asked_vectors[p], vectors, slices), names, ids[p], cut[p])
                out.append(pa.table([row[p][at], ids[p][at], names[near], score], schema=answer))
            return pa.concat_tables(out)

        return run

    cells = ["shard", "block", "dim"]
    meet = lambda q, work: q.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(over(work), shape)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    heads = meet(left, lambda cell, names, ids, cut: _gather(cell, names, ids, k)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    # Fewer than k candidates seen: no cutoff, everything is collected. A cutoff as double lies at most a rounding above the score, which the factor takes back.
    least = F.min("score").cast("double")
    cutoff = materialise(spark, heads.groupBy("q").agg(F.when((F.count("*") >= k) & (F.min("score") > -(2**63)), least - F.abs(least) * F.lit(2.0**-50)).alias("cutoff")))
    found = meet(left.join(cutoff, "q", "left"), lambda cell, names, ids, cut: _collect(cell, names, ids, cut, k))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
