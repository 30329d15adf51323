"""Whole flows: ingestion of a corpus to chunks, and batches of questions to fused, cited, prompted answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import page_label, preview, score_label
from ..operators import answers, fusion, keyword, metadata, sections, standardise, vector_search, windows
from ..operators.vector_index import VectorIndex
from ..sources import catalog, tables, versions


def chunks_of(docs: DataFrame, most: int = 448, overlap: int = 64, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """docs(document_id, category, raw_text, page_offsets) through metadata, header, sections and windows to chunks, with docs' columns in keep."""
    enriched = metadata.enrich(docs, "raw_text")
    standard = standardise.standardise(enriched, metadata.header(), text="raw_text")
    body = F.substr("content", F.col("body_start") + 1)
    return windows.chunked(sections.sectioned(standard.withColumn("body", body)), most=most, overlap=overlap, keep=keep)


def ingested(files: DataFrame, catalogue: DataFrame, known: DataFrame, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, statuses) of an ingestion run over files(category, filename, content_hash, raw_text, page_offsets, error).

    Statuses hold one row a file: SKIPPED (completed under the same hash in known), FAILED with its reason (no catalogue row, decoding error, no text,
    first fault of a chunk), or SUCCESS; with document_id, content_hash and chunk_count. A failure stays with its file. Chunks are those of the successes.
    """
    named = catalog.join_files(files, catalogue)
    done = known.filter("processing_status = 'completed'").select("document_id", "content_hash").distinct().withColumn("done", F.lit(True))
    early = F.when(~F.col("matched"), "no catalogue row").when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.trim("raw_text"), F.lit("")) == "", "no text")
    judged = tables.written(named.join(done, ["document_id", "content_hash"], "left").withColumn("reason", early))
    fresh = judged.filter("done is null and reason is null")
    # By id and hash, since files of several categories may stand under one id.
    own = ["document_id", "content_hash"]
    made = tables.written(chunks_of(fresh.select(*own, "category", "raw_text", "page_offsets"), **(limits or {}), keep=["content_hash"]))
    found = made.groupBy(*own).agg(F.count("*").alias("n"), F.min("reason").alias("fault"))
    rows = judged.join(found, own, "left").withColumn("fault", F.coalesce("reason", "fault", F.when(F.col("n").isNull(), "no chunks")))
    skipped = F.coalesce("done", F.lit(False))
    status = F.when(skipped, "SKIPPED").when(F.col("fault").isNull(), "SUCCESS").otherwise("FAILED")
    count = F.when(status == "SUCCESS", F.col("n")).otherwise(F.lit(0)).cast("long")
    statuses = rows.select("category", "filename", "document_id", "content_hash", status.alias("status"), F.when(~skipped, F.col("fault")).alias("reason"), count.alias("chunk_count"))
    return made.join(found.filter("fault is null").select(*own), own, "left_semi").drop("content_hash"), statuses


def stored_index(docs: DataFrame, name: str, fields: list[str], key: str = "chunk_id") -> keyword.Index:
    """The keyword index called name of docs, from its store in the shared folder; written there by the first that asks.

    The store's folder follows from the name, the fields and the names, sizes and times of the files behind docs, so files that change have another store.
    """
    spark = docs.sparkSession
    files = versions.fingerprint(spark, docs.inputFiles())
    folder = f"{tables.shared_folder(spark)}/keyword-{name}-{'-'.join([key, *fields])}-{files[:32]}"
    store = keyword.Store(spark, folder)
    if not versions.numbers(spark, f"{folder}/manifest"):
        try:
            store.write(docs, fields, key, strict=False)
        except versions.Conflict:  # another has written it meanwhile
            pass
    return store.read()


def stored_vectors(vectors: DataFrame, name: str) -> VectorIndex:
    """The clustered index called name of vectors(vec_id, embedding), written by the first that asks; its folder follows from the files behind vectors as in stored_index."""
    spark = vectors.sparkSession
    index = VectorIndex(spark, f"{tables.shared_folder(spark)}/vectors-{name}-{versions.fingerprint(spark, vectors.inputFiles())[:32]}")
    if not versions.numbers(spark, f"{index.folder}/manifest"):
        try:
            index.write(vectors)
        except versions.Conflict:  # another has written it meanwhile
            pass
    return index


def hybrid(spark: SparkSession, queries: DataFrame, query_vectors: DataFrame, found: keyword.Index, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, fused_rank, fused_score) of both legs with the same k, keyword first.

    found: an index with field chunk_text; vectors(vec_id, embedding), vec_id being the chunk's id.
    """
    found = keyword.search(queries, found, k, {"chunk_text": 1.0})
    near = vector_search.cosine_topk(spark, query_vectors, vectors, k)
    lists = [x.select("query_id", F.col(c).alias("chunk_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("position"), F.col("score").alias("retrieval_score"), F.lit(m).alias("retrieval_method")) for x, c, m in ((found, "id", "keyword"), (near, "vec_id", "semantic"))]
    return fusion.fused(*lists, k)


def retrieved(found: DataFrame, near: DataFrame, chunks: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k best chunks of two lists of hits(query_id, rank, chunk_id, score), keyword and semantic: both hydrated from chunks and registry, then fused."""
    return fusion.fused(fusion.hydrated(found, chunks, known, "keyword"), fusion.hydrated(near, chunks, known, "semantic"), k)


def cards(fused: DataFrame) -> DataFrame:
    """What is shown of fused, hydrated chunks: each citation once, with the chunk it is matched to, its labels and a preview."""
    fused = tables.written(fused)
    placed = answers.matched(answers.citations(fused), fused)
    chosen = fused.select("query_id", "chunk_id", "chunk_text", "retrieval_method", "retrieval_score", "fused_score")
    method, own = F.col("retrieval_method"), F.col("retrieval_score")
    return placed.join(chosen, ["query_id", "chunk_id"], "left").select(
        "query_id",
        "card_rank",
        "citation_rank",
        "document_id",
        "chunk_id",
        "chunk_rank",
        "title",
        "heading",
        page_label(F.col("page_start"), F.col("page_end"), card=True).alias("pages"),
        score_label(method, own).alias("score"),
        score_label(F.lit("hybrid"), F.col("fused_score")).alias("fused"),
        preview(F.col("chunk_text")).alias("preview"),
    )


def answer(spark: SparkSession, queries: DataFrame, fused: DataFrame, provider: str = "echo") -> DataFrame:
    """queries(query_id, text) with prompt, answer, tokens and status; fused holds hydrated, fused chunks."""
    return answers.generated(answers.prompts(queries, answers.contexts(fused)), provider)
