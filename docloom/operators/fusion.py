"""Hydration of hits and reciprocal rank fusion (Cormack, Clarke and Buettcher, 2009)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTANT = 60


def hydrated(hits: DataFrame, chunks: DataFrame, registry: DataFrame, method: str) -> DataFrame:
    """hits(query_id, rank, chunk_id, score) with chunk and registry columns; a hit that misses either is dropped, and ranks keep the gap. position counts what is left."""
    c = chunks.select("chunk_id", "document_id", "heading", "page_start", "page_end", "chunk_text")
    r = registry.select("document_id", "title", "source_url")
    out = hits.join(c, "chunk_id").join(r, "document_id")
    place = Window.partitionBy("query_id").orderBy("retrieval_rank")
    return out.select("query_id", "chunk_id", "document_id", "title", "heading", "source_url", "page_start", "page_end", "chunk_text", F.col("score").alias("retrieval_score"), F.lit(method).alias("retrieval_method"), F.col("rank").alias("retrieval_rank")).withColumn("position", F.row_number().over(place))


def fused(keyword: DataFrame, semantic: DataFrame, k: int, constant: int = CONSTANT) -> DataFrame:
    """The k best of two lists(query_id, chunk_id, position, ...) by the sum of 1 / (constant + position); same columns, fused_score and fused_rank.

    A chunk in both lists keeps the semantic list's columns. Ties go to the keyword list's order, then the semantic list's. k <= 0 gives none.
    """
    columns = [c for c in keyword.columns if c not in ("query_id", "chunk_id")]
    both = keyword.withColumn("_list", F.lit(0)).unionByName(semantic.withColumn("_list", F.lit(1)))
    whole = F.struct("_list", *columns)
    one = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("position"))), 9).alias("fused_score"), F.min(F.struct("_list", "position")).alias("_first"), F.max_by(whole, "_list").alias("_row"))
    best = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "_first._list", "_first.position")
    ranked = one.withColumn("fused_rank", F.row_number().over(best)).filter(F.col("fused_rank") <= k)
    return ranked.select("query_id", "chunk_id", *[f"_row.{c}" for c in columns], "fused_score", "fused_rank")
