"""Exact cosine top-k over vectors that were clustered once: what a cutoff rules out by angles isn't scored, clusters it rules out aren't read.

A vector at angle t from its centre is at least |p - t| away from a query at angle p from that centre. A block holds vectors of one cluster in a narrow range of
angles, so one number bounds all its scores. A first pass over each query's nearest clusters gives its k-th score, a second one visits what may beat it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import versions
from .vector_search import BLOCK, one_dimension

#: Most clusters, vectors that centres are fitted on (a bounded sample by hash of the id), rounds of the fit, rows of a block.
CLUSTERS, SAMPLE, ROUNDS, ROWS = 256, 16_384, 8, 1024
#: Scores are rounded to 6 places; a bound must fall short by more than that and the error of angles in double precision.
SLACK = 2e-6
#: Cluster of vectors of norm zero, to which angles don't apply: always visited.
ODD = -1


def _units(components: pa.Array, width: int) -> np.ndarray:
    m = components.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten()


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _fitted(units: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centres by spherical k-means from evenly spaced rows; a centre without rows stays."""
    centres = units[np.linspace(0, len(units) - 1, clusters).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-300), centres)
    return centres


@dataclass
class VectorIndex:
    """Vectors of one length in a shared folder: blocks by cluster as Parquet, and a manifest whose last version names the blocks, centres and extents of clusters.

    Everything is written before its version is published (see versions), so a write that dies leaves the index as it was. The manifest's size is clusters x length.
    """

    spark: SparkSession
    folder: str

    def write(self, vectors: DataFrame, clusters: int = CLUSTERS, rows: int = ROWS) -> int:
        """Indexes vectors(vec_id bigint, embedding) in place of what was there; the manifest's version.

        Every row is indexed but those with a null id, a null or empty vector or components that are null or not finite. Raises ValueError for vectors of several lengths.
        Rows are dealt by (cluster, angle, id), so a cluster that holds a third of all rows is many tasks' work.
        """
        kept = vectors.filter("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding")
        kept = kept.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        width = one_dimension(kept).first()
        version = (versions.numbers(self.spark, f"{self.folder}/manifest") or [0])[-1] + 1
        if width.low is None:
            return versions.publish(self.spark, f"{self.folder}/manifest", version, {"blocks": None, "width": 0, "centres": [], "extents": []})
        if not width.agree:
            raise ValueError(f"vectors of {width.low} to {width.high} components")
        width, n = width.low, kept.count()
        sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
        units = _units(_flat(sample.column(0)), width)
        units = units[np.linalg.norm(units, axis=1) > 0.5]
        # Clusters hold a block's rows at least, on average.
        centres = _fitted(units, max(1, min(clusters, n // rows, len(units)))) if len(units) else np.eye(1, width)
        shared = self.spark.sparkContext.broadcast(centres)
        kind = kept.schema["embedding"].dataType.simpleString()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = _units(_flat(batch.column(1)), width)
                angles = _angles(units, shared.value)
                own = np.argmin(angles, axis=1)
                odd = np.linalg.norm(units, axis=1) < 0.5
                angle = np.where(odd, 0.0, angles[np.arange(len(own)), own])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(odd, ODD, own), pa.int32()), pa.array(angle)], ["vec_id", "embedding", "cluster", "angle"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, angle = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                turns = np.flatnonzero(np.diff(cluster)) + 1
                starts = np.concatenate([np.arange(a, b, rows) for a, b in zip([0, *turns], [*turns, len(cluster)], strict=True)])
                ends = np.append(starts[1:], len(cluster))
                cut = pa.array(np.append(starts, len(cluster)), pa.int32())
                wide = pa.array(np.append(starts, len(cluster)) * width, pa.int32())
                lists = [pa.ListArray.from_arrays(cut, batch.column(0)), pa.ListArray.from_arrays(wide, _flat(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([pa.array(cluster[starts]), pa.array(angle[starts]), pa.array(angle[ends - 1]), *lists], ["cluster", "low", "high", "ids", "components"])

        spread = kept.mapInArrow(placed, f"vec_id bigint, embedding {kind}, cluster int, angle double")
        tasks = max(1, -(-n // (16 * rows)))
        ordered = spread.repartitionByRange(tasks, "cluster", "angle", "vec_id").sortWithinPartitions("cluster", "angle", "vec_id")
        blocks = ordered.mapInArrow(packed, f"cluster int, low double, high double, ids array<bigint>, components {kind}")
        name = f"blocks-{uuid.uuid4().hex}"
        blocks.write.partitionBy("cluster").parquet(f"{self.folder}/{name}")
        found = self._blocks(name, kind).groupBy("cluster").agg(F.sum(F.size("ids")).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cluster").collect()
        told = {"blocks": name, "kind": kind, "width": width, "centres": centres.tolist(), "extents": [list(r) for r in found]}
        return versions.publish(self.spark, f"{self.folder}/manifest", version, told)

    def _blocks(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"low double, high double, ids array<bigint>, components {kind}, cluster int").parquet(f"{self.folder}/{name}")

    def topk(self, queries: DataFrame, k: int, tally: Accumulator | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score) as vector_search.cosine_topk gives it for queries(query_id bigint, embedding). tally adds up the pairs scored.

        Queries go in turns of about BLOCK, each a broadcast of BLOCK x length numbers; per turn the driver holds k rows a query. Queries of another length find nothing.
        """
        found = versions.read(self.spark, f"{self.folder}/manifest")
        if found is None:
            raise ValueError("the folder holds no index")
        shape = "query_id bigint, rank int, vec_id bigint, score double"
        asked = queries.filter(f"query_id is not null and size(embedding) = {found[1]['width']}").select("query_id", "embedding")
        n = asked.count() if k > 0 and found[1]["blocks"] else 0
        if n == 0:
            return self.spark.createDataFrame([], shape)
        turns = 1 if n <= BLOCK else -(-2 * n // BLOCK)
        made = [self._turn(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == t), k, found[1], tally) for t in range(turns)]
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _turn(self, queries: DataFrame, k: int, told: dict, tally: Accumulator | None) -> DataFrame:
        table, width = queries.toArrow(), told["width"]
        names = table.column("query_id").to_numpy()
        asked = _units(_flat(table.column("embedding")), width)
        number, counts, low, high = (np.array(x) for x in zip(*told["extents"], strict=True))
        centres = np.array(told["centres"])
        # Angles of queries to the centres of the clusters there are; a row of zeros or of what isn't finite has none.
        sound = np.linalg.norm(asked, axis=1) > 0.5
        away = _angles(asked, centres[np.maximum(number, 0)])
        free = ~sound[:, None] | (number == ODD)[None, :]
        bound = np.where(free, 1.0, np.cos(np.clip(np.maximum(away - high, low - away), 0.0, np.pi)))
        # The nearest clusters that together hold k vectors.
        order = np.argsort(np.where(free, np.inf, away), axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        near = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(near, order, before < k, axis=1)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        shape = "query_id bigint, vec_id bigint, score double"
        cutoff = np.full(len(names), -np.inf)

        def scanned(wanted: np.ndarray, cutoff: np.ndarray) -> DataFrame:
            inside = number[wanted.any(axis=0)]
            shared = self.spark.sparkContext.broadcast((names, asked, away, free, wanted, cutoff, {int(c): i for i, c in enumerate(number)}))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                yield from _scan(batches, shared.value, k, width, tally)

            return self._blocks(told["blocks"], told["kind"]).filter(F.col("cluster").isin([int(c) for c in inside])).mapInArrow(run, shape)

        first = scanned(near, cutoff).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place").toArrow()
        ids, scores = first.column("query_id").to_numpy(), first.column("score").to_numpy()
        for i, name in enumerate(names):
            mine = scores[ids == name]
            if len(mine) >= k:
                cutoff[i] = mine.min()
        rest = ~near & (bound >= cutoff[:, None] - SLACK)
        return self.spark.createDataFrame(first, shape).unionByName(scanned(rest, cutoff))


def _scan(batches: Iterator[pa.RecordBatch], shared: tuple, k: int, width: int, tally: Accumulator | None) -> Iterator[pa.RecordBatch]:
    """Each query's k best rows of a task's blocks; a block is skipped for the queries whose k-th score, from before or found here, it can't reach."""
    names, asked, away, free, wanted, cutoff, place = shared
    score, found = np.full((len(names), k), -np.inf), np.zeros((len(names), k), dtype=np.int64)
    held = np.zeros((len(names), k), dtype=bool)
    for batch in batches:
        for i in range(batch.num_rows):
            low, high, cluster = (batch.column(c)[i].as_py() for c in ("low", "high", "cluster"))
            at = place[cluster]
            apart = np.clip(np.maximum(away[:, at] - high, low - away[:, at]), 0.0, np.pi)
            bound = np.where(free[:, at], 1.0, np.cos(apart))
            some = np.flatnonzero(wanted[:, at] & (bound >= np.maximum(cutoff, score[:, -1]) - SLACK))
            if not len(some):
                continue
            ids = batch.column("ids")[i].values.to_numpy()
            near = np.round(asked[some] @ _units(batch.column("components")[i].values, width).T, 6)
            if tally is not None:
                tally.add(near.size)
            near = np.where(np.isfinite(near), near, -np.inf)
            both = np.concatenate([score[some], near], axis=1)
            owner = np.concatenate([found[some], np.broadcast_to(ids, near.shape)], axis=1)
            there = np.concatenate([held[some], np.isfinite(near)], axis=1)
            top = np.lexsort((owner, -both), axis=1)[:, :k]
            score[some], found[some], held[some] = (np.take_along_axis(x, top, axis=1) for x in (both, owner, there))
    row, column = np.nonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(found[row, column]), pa.array(score[row, column])], ["query_id", "vec_id", "score"])
