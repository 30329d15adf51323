"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, infill, langid, lengths, licenses, neardup, packing, pieces, pii, quality, sql, topk, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii.pseudonymise(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), "corpus-release-1")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(spark, rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), rows, 5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(spark, docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(spark, docs, quality.train(docs, quality.grades(_table(spark, sf_dir, "labels"))))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(spark, _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_classed(spark, _table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("is_first").alias("is_representative"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.answers(lengths.histogram(lengths.encoded_lengths(spark, _table(spark, sf_dir, "documents"))))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(spark, _table(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every sound embedding, with the digest of the codebooks."""
    found, books = codes.compressed(spark, _table(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.sha2(F.lit("" if books is None else books.text()), 256))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document's fill-in-the-middle output and of the text restored from it."""
    found = infill.transformed(_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(infill.restored(F.col("output"), F.col("form")), 256)}
    return found.withColumns(digests).drop("output")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's piece ids, and the digest of their decoded text."""
    found = pieces.encoded(spark, _table(spark, sf_dir, "documents"), pieces.default_vocabulary())
    digests = [F.sha2(pieces.id_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_decontamination, op2_pii_surrogates, op3_exact_topk, op4_language_id, op5_quality_classifier, op6_url_filter, op7_best_fit_packing)
    others = (op8_minhash_neardup, op9_token_counts, op10_license_scan, op11_vector_codes, op12_fill_in_middle, op13_sentencepiece)
    return {f.__name__: f for f in (*first, *others)}


def oracle_sql() -> dict[str, str]:
    found = {"op1_decontamination": sql.OP1, "op3_exact_topk": sql.OP3, "op6_url_filter": sql.op6(), "op10_license_scan": sql.op10()}
    return found | {"op11_vector_codes": sql.op11(), "op12_fill_in_middle": sql.OP12}
