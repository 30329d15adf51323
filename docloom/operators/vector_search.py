"""Vector store and exact cosine top-k of a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import point_id
from ..functions.vectors import fault, l2_normalise

#: Queries are sent to executors in blocks of so many, a bounded matrix each.
BLOCK = 4096


def embedded(vectors: DataFrame, dimension: int, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows of vectors(chunk_id, document_id, embedding), normalised, with model columns; rejects with their reason)."""
    marked = vectors.withColumn("reason", fault(F.col("embedding"), dimension))
    sound = marked.filter("reason is null").drop("reason").withColumn("embedding", l2_normalise(F.col("embedding")))
    return sound.withColumn("embedding_model", F.lit(model)).withColumn("embedding_model_version", F.lit(version)).withColumn("embedding_dimension", F.lit(dimension)).withColumn("normalized", F.lit(True)), marked.filter("reason is not null")


def points(rows: DataFrame) -> DataFrame:
    """Rows of the vector store: id by uuid5 of the chunk id."""
    return rows.select(point_id(F.col("chunk_id")).alias("id"), "embedding", "chunk_id", "document_id", "embedding_model", "embedding_model_version", "normalized")


def one_dimension(rows: DataFrame) -> DataFrame:
    """One row (low, high, agree): whether all vectors have the same length."""
    return rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).withColumn("agree", F.col("low") == F.col("high"))


def upsert(store: DataFrame, rows: DataFrame, dimension: int) -> DataFrame:
    """store with the points of all documents in rows, and those of the ids in rows, replaced by those in rows; ids are unique after it if they were in store.

    Raises ValueError if a new vector's length isn't dimension, before anything is joined.
    """
    found = one_dimension(rows).first()
    if found.low is not None and (found.low, found.high) != (dimension, dimension):
        raise ValueError(f"vectors of {found.low} to {found.high} components where {dimension} are declared")
    columns = [c for c in store.columns if c != "id"]
    # One row an id: of several new ones the largest by its other columns.
    new = rows.groupBy("id").agg(F.max(F.struct(*columns)).alias("r")).select("id", "r.*")
    kept = store.join(rows.select("document_id").distinct(), "document_id", "left_anti").join(new.select("id"), "id", "left_anti")
    return kept.select(*store.columns).unionByName(new.select(*store.columns))


def hashed_embedding(docs: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """(key, embedding): a deterministic stand-in for a model. Every word adds +1 or -1 at a hashed place; null for a text without words."""
    words = docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    h = F.xxhash64("w")
    cells = words.groupBy(key, F.pmod(h, F.lit(dimension)).cast("int").alias("at")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    dense = maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))
    return docs.select(key).join(dense, key, "left")


def _by_length(names: pa.ChunkedArray | pa.Array, column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors, by the vectors' length."""
    table = pa.table({"id": names, "v": column}).combine_chunks()
    length = table.column("v").combine_chunks().value_lengths().to_numpy()
    out = {}
    for n in np.unique(length[length > 0]):
        rows = table.filter(pa.array(length == n))
        m = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, n)
        out[int(n)] = rows.column("id").to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return out


def _nearest(queries: dict[int, tuple], vectors: dict[int, tuple], k: int) -> pa.RecordBatch:
    """The k best vectors of each query among these, of its own length; ties to the smaller id."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for n, (names, q) in queries.items():
        if n in vectors and k > 0:
            own, v = vectors[n]
            order = np.argsort(own, kind="stable")
            score = np.round(q @ v[order].T, 6)
            # A stable sort by falling score over rows in order of id breaks ties by id.
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found = np.repeat(names, top.shape[1]), own[order][top].ravel(), np.take_along_axis(score, top, axis=1).ravel()
            parts.append(tuple(x[np.isfinite(found[2])] for x in found))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["query_id", "vec_id", "score"])


def cosine_topk(spark: SparkSession, queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(query_id, embedding) against vectors(vec_id, embedding); score to 6 places, ties to the smaller id.

    Null ids, null and empty vectors and those with components that are null or not finite take no part; vectors of different lengths don't meet. Up to block queries are broadcast: every batch of vectors meets them in one matrix product and passes
    on its own k best a query, so vectors are never shuffled. Beyond, queries and vectors are dealt into cells of block rows, one task each.
    """
    shape = "query_id bigint, vec_id bigint, score double"
    queries = queries.filter("query_id is not null and size(embedding) > 0").select("query_id", "embedding")
    vectors = vectors.filter("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding")
    whole = queries.limit(block + 1).toArrow()
    if whole.num_rows <= block:
        shared = spark.sparkContext.broadcast(_by_length(whole.column("query_id"), whole.column("embedding")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _nearest(shared.value, _by_length(batch.column(0), batch.column(1)), k)

        near = vectors.mapInArrow(run, shape)
    else:
        blocks, shards = (max(1, -(-x.count() // block)) for x in (queries, vectors))
        number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("block", number("query_id", blocks)).withColumn("shard", every(shards))
        right = vectors.withColumn("shard", number("vec_id", shards)).withColumn("block", every(blocks))

        def cell(q: pa.Table, v: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_nearest(_by_length(q.column("query_id"), q.column("embedding")), _by_length(v.column("vec_id"), v.column("embedding")), k)])

        near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, shape)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
