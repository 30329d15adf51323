"""Registered queries on faulty, repeated and failing records: the legal path with its cards, routes, failing calls, resumed runs, checks of stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.spans import find_all
from ..operators import answers, evaluation, standardise, vector_search, windows
from ..sources import registry, tables
from . import flows
from .queries import _COSINE, _KEYWORD, _runs, bm25_topk, knn_topk, query, table

#: Hits of both legs, hydrated (a sixth of the documents has no registry row, several share a title), fused, cited once a page and matched.
_CARDS = f"""WITH k AS ({_KEYWORD}), v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id AS id, score FROM ({_COSINE}) QUALIFY rank <= 5),
 s AS (SELECT doc_id AS id, doc_id % 30 AS document_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS heading, CAST(doc_id % 3 AS INTEGER) AS page_start, CAST(doc_id % 3 + doc_id % 2 AS INTEGER) AS page_end, text AS chunk_text FROM documents),
 r AS (SELECT n_nationkey AS document_id, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey),
 u AS (SELECT *, row_number() OVER (PARTITION BY query_id, l ORDER BY rank) AS position FROM (SELECT query_id, id, rank, score, 0 AS l FROM k UNION ALL SELECT query_id, id, rank, score, 1 AS l FROM v) JOIN s USING (id) JOIN r USING (document_id)),
 f AS (SELECT query_id, id, round(sum(1 / (60 + position)), 9) AS fused_score, min(l * 1000 + position) AS first, max(l) AS l, max_by(score, l) AS score FROM u GROUP BY query_id, id),
 g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, first) AS INTEGER) AS fused_rank FROM f QUALIFY fused_rank <= 10),
 h AS (SELECT g.*, s.* EXCLUDE (id), r.title FROM g JOIN s USING (id) JOIN r USING (document_id)),
 c AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS INTEGER) AS citation_rank FROM (SELECT query_id, document_id, title, heading, page_start, page_end, fused_rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, document_id, page_start, page_end ORDER BY fused_rank) = 1)),
 m AS (SELECT c.query_id, c.citation_rank, c.document_id, c.title, c.heading, c.page_start, c.page_end, h.id, h.fused_rank AS chunk_rank, h.l, h.score, h.fused_score, h.chunk_text FROM c JOIN h ON h.query_id = c.query_id AND h.title = c.title
  QUALIFY row_number() OVER (PARTITION BY c.query_id, c.citation_rank ORDER BY CASE WHEN c.page_start = h.page_start AND h.page_start <> 0 THEN 1 WHEN c.heading = h.heading AND c.heading <> '' THEN 2 ELSE 3 END, h.fused_rank) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank, citation_rank) AS INTEGER) AS card_rank, citation_rank, document_id, id AS chunk_id, chunk_rank, title, heading,
 CASE WHEN page_start = page_end THEN 'Page ' || page_start ELSE 'Pages ' || page_start || '–' || page_end END AS pages, CASE WHEN l = 1 THEN printf('%.1f%%', score * 100) ELSE printf('BM25 %.2f', score) END AS score,
 printf('Hybrid %.4f', fused_score) AS fused, substr(replace(chunk_text, chr(10), ' '), 1, 250) AS preview FROM m"""


@query(_CARDS)
def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legal path from both legs to the cards: repeated pages are cited once, and a citation is matched by page, heading or title alone."""
    n = F.col("doc_id")
    heading = F.when(n % 4 == 0, "").otherwise(F.col("lang")).alias("heading")
    first, last = (n % 3).cast("int").alias("page_start"), (n % 3 + n % 2).cast("int").alias("page_end")
    store = table(spark, sf_dir, "documents").select(n.alias("chunk_id"), (n % 30).alias("document_id"), heading, first, last, F.col("text").alias("chunk_text"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = nations.select(F.col("n_nationkey").cast("long").alias("document_id"), F.col("r_name").alias("title"), F.col("n_name").alias("source_url"))
    found = bm25_topk(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    near = knn_topk(spark, sf_dir).withColumnRenamed("vec_id", "chunk_id")
    return flows.cards(flows.retrieved(found, near, store, known, 10))


def _strict(system: str, prompt: str) -> dict:
    """A stand-in provider that fails, is cut off or is stopped, by the number of a prompt's words."""
    words = prompt.split()
    if len(words) % 5 == 0:
        raise TimeoutError("connection timeout")
    return answers.echo(system, prompt) | {"finish": ["", "length", "content_filter", "recitation", "STOP"][len(words) % 5]}


@query(
    r"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations), d AS (SELECT *, len(w) AS n FROM c)
SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE n % 5 WHEN 1 THEN 'MAX_TOKENS' WHEN 2 THEN 'SAFETY' WHEN 4 THEN 'STOP' ELSE 'OTHER' END AS finish_reason, CASE WHEN n % 5 = 0 THEN 'TimeoutError: connection timeout' END AS error,
 CASE WHEN n % 5 > 0 THEN array_to_string(w[1:20], ' ') END AS answer, CASE WHEN n % 5 > 0 THEN CAST(n + 2 + least(n, 20) AS BIGINT) END AS total_tokens, CASE WHEN n % 5 = 0 THEN 'Service temporarily unavailable.' END AS reason FROM d"""
)
def answer_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn sent to a provider some of whose calls fail; a failing call is a row of its own, with what a user is told."""
    answers.PROVIDERS["strict"] = lambda: _strict
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("Be brief.").alias("system_prompt"), F.col("text").alias("user_prompt"))
    told = F.split_part("error", F.lit(": "), F.lit(1)), F.split_part("error", F.lit(": "), F.lit(2))
    reason = F.when(F.col("error").isNotNull(), text.error_message(*told)["reason"])
    return answers.generated(asked, "strict").select("conv_id", "turn", "status", "finish_reason", "error", "answer", "total_tokens", reason.alias("reason"))


_ROUTE = "CASE WHEN turn % 3 = 0 THEN 'general_chat' ELSE CASE conv_id % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'clarify' WHEN 2 THEN 'legal_rag' ELSE 'general_chat' END END"


@query(
    f"""WITH d AS (SELECT *, {_ROUTE} AS route FROM conversations)
SELECT conv_id, turn, route, CASE WHEN turn % 3 = 0 THEN '1.00' WHEN conv_id % 5 < 2 THEN '0.75' ELSE '0.00' END AS confidence, CASE route WHEN 'reject' THEN '{answers.CANNED["reject"]}' WHEN 'clarify' THEN '{answers.CANNED["clarify"]}' END AS answer,
 CASE WHEN route IN ('reject', 'clarify') THEN 0 END AS total_tokens, CASE route WHEN 'legal_rag' THEN '{answers.LEGAL_SYSTEM}' WHEN 'general_chat' THEN '{answers.CHAT_SYSTEM}' END AS system_prompt,
 CASE turn % 4 WHEN 0 THEN 'Gemini 3.5 Flash' WHEN 1 THEN 'Qwen 3 32B' END AS display_name, turn % 4 < 2 AS known FROM d"""
)
def route_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed phrases, replies of a model in any case or malformed, canned answers, and a chosen model that may be unknown; as the panel shows them."""
    turns = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") % 5
    reply = F.when(n == 0, '{"route": "REJECT", "confidence": 0.75, "reason": "x"}').when(n == 1, '{"route": "clarify", "confidence": 0.75}').when(n == 2, '{"route": "Legal_RAG"}').when(n == 3, '{"route": "other", "confidence": 1}').otherwise("no object")
    said = F.when(F.col("turn") % 3 == 0, F.lit("  Thank   YOU ")).otherwise(F.concat(F.lit("On appeal: "), F.coalesce("text", F.lit(""))))
    chosen = F.when(F.col("turn") % 4 == 0, answers.MODELS[0][0]).when(F.col("turn") % 4 == 1, answers.MODELS[2][0]).otherwise("none")
    asked = turns.select("conv_id", "turn", said.alias("text"), reply.alias("reply"), chosen.alias("model_id"))
    out = answers.with_model(answers.dispatched(answers.routed(asked, "reply")), spark)
    shown = out.withColumn("query_id", F.struct("conv_id", "turn")).withColumn("full", F.col("route")).withColumn("confidence", F.col("full.confidence")).withColumn("route", F.col("full.route"))
    blank = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    panel = answers.panel(shown.select("query_id", "route", "confidence", F.col("model_id").alias("model"), "total_tokens", *blank("double", "latency_ms"), *blank("bigint", "prompt_tokens", "completion_tokens", "n_chunks"), *blank("string", "finish_reason")))
    rest = shown.select("query_id", "answer", "system_prompt", "display_name", "known")
    return panel.join(rest, "query_id").select("query_id.conv_id", "query_id.turn", "route", "confidence", "answer", "total_tokens", "system_prompt", "display_name", "known")


@query("SELECT doc_id AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0 OR quality = 0)")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after two stored runs: the first fails on toxic documents, the second repairs those of low quality and fails on one that had succeeded."""
    folder = f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), "toxic", "quality")
    status = lambda good: F.when(good, "SUCCESS").otherwise("FAILED").alias("status")
    evaluation.store(rows.select("question_id", status(F.col("toxic") == 0)), folder, 1)
    evaluation.store(rows.filter("toxic = 1 or question_id % 7 = 0").select("question_id", status((F.col("toxic") == 1) & (F.col("quality") == 0))), folder, 2)
    golden = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    return evaluation.remaining(golden, evaluation.stored(spark, folder))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean, round(median(value) FILTER (event_type <> 'error'), 6) AS median, round(stddev_samp(value) FILTER (event_type <> 'error'), 6) AS std FROM events")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary document, read back from its JSON."""
    shape = "total long, success long, failed long, statistics map<string, struct<mean: double, minimum: double, maximum: double, median: double, std: double>>"
    told = evaluation.summary(_runs(spark, sf_dir), ["value"]).select(F.from_json("summary", shape).alias("s")).select("s.*", F.element_at("s.statistics", "value").alias("v"))
    return told.select("total", "success", "failed", "v.mean", "v.median", "v.std")


_REFERENCE = "CASE doc_id % 6 WHEN 0 THEN ' n/a ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'none' ELSE text END"


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped, doc_id % 6 < 4 OR coalesce(trim(text), '') = '' AS no_reference, true AS uuid_like, true AS time_like FROM documents")
def answer_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids that are kept from a prompt, references that count as empty, fresh ids and times."""
    rows = table(spark, sf_dir, "documents").withColumn("id", text.new_id()).withColumn("now", text.now_utc())
    shown = F.concat(F.lit("Document ID: "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n  document id:\tX-1\n"))
    like = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    when = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$"
    return rows.select("doc_id", F.sha2(text.strip_ids(shown), 256).alias("stripped"), evaluation.empty_reference(F.expr(_REFERENCE)).alias("no_reference"), F.col("id").rlike(like).alias("uuid_like"), F.col("now").rlike(when).alias("time_like"))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 5 = 0 THEN 'zero_norm' END AS reason,
 CASE WHEN vec_id % 11 <> 0 AND vec_id % 7 <> 0 AND vec_id % 5 <> 0 THEN round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) END AS first_part FROM embeddings"""
)
def embed_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding stage's output: sound vectors normalised, the others with their reason."""
    n = F.col("vec_id")
    raw = F.when(n % 11 == 0, F.lit(None)).when(n % 7 == 0, F.slice("embedding", 1, 63)).when(n % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", n.cast("string").alias("chunk_id"), "label", raw.alias("embedding"))
    sound, rejects = vector_search.embedded(rows, 64, "m", "1")
    told = sound.select("vec_id", F.lit(None).cast("string").alias("reason"), F.round(F.element_at("embedding", 1), 6).alias("first_part"))
    return told.unionByName(rejects.select("vec_id", "reason", F.lit(None).cast("double").alias("first_part")))


@query("SELECT CAST(64 - max(label % 2) AS INTEGER) AS low, CAST(64 - min(label % 2) AS INTEGER) AS high, max(label % 2) = min(label % 2) AS agree FROM embeddings")
def mixed_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every second label are one component short."""
    return vector_search.one_dimension(table(spark, sf_dir, "embeddings").select(F.slice(F.col("embedding"), F.lit(1), 64 - F.col("label") % 2).alias("embedding")))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9][^0-9]') THEN 'gap' WHEN regexp_matches(text, '[0-9]$') THEN 'short cover' END AS fault FROM documents")
def mapping_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of what stands between the digits of a text: digits inside leave a gap, digits at the end a cover that is too short."""
    pieces = find_all(F.col("text"), "([^0-9]+)", whole=True)
    spans = F.transform(pieces, lambda s: F.struct(s["start"].alias("std_start"), s["end"].alias("std_end"), s["start"].alias("src_start"), s["end"].alias("src_end")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), spans.alias("spans"))
    return rows.select("doc_id", standardise.mapping_fault(F.col("spans"), F.col("size")).alias("fault"))


@query(
    """WITH c AS (SELECT l_orderkey AS document_id, l_orderkey || '-' || l_suppkey AS chunk_id, l_partkey AS source_start, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem)
SELECT DISTINCT document_id, 'source start goes back' AS reason FROM c WHERE source_start < before
UNION ALL SELECT DISTINCT document_id, 'chunk id repeats' AS reason FROM (SELECT chunk_id, min(document_id) AS document_id FROM c GROUP BY chunk_id HAVING count(*) > 1)"""
)
def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk check over the lines of orders, read as chunks whose source starts are part numbers."""
    rows = table(spark, sf_dir, "lineitem")
    return windows.faults(rows.select(F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_suppkey").alias("chunk_id"), F.struct("l_linenumber", "l_partkey").alias("ordinal"), F.col("l_partkey").alias("source_start")))


@query(
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'title not stripped text' WHEN doc_id % 7 = 0 THEN 'processing_status unknown' WHEN doc_id % 11 = 0 OR n_chars IS NULL THEN 'chunk_count negative' END AS reason FROM documents"""
)
def registry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry records with a blank in front of a title, an unknown status or a negative count."""
    n = F.col("doc_id")
    fixed = [F.lit("1").alias(c) for c in registry.TEXTS if c not in ("title", "processing_status")]
    title = F.concat(F.when(n % 5 == 0, " ").otherwise(""), F.lit("t"))
    status = F.when(n % 7 == 0, "lost").otherwise("completed")
    count = F.when(n % 11 == 0, -1).otherwise(F.col("n_chars"))
    rows = table(spark, sf_dir, "documents").select("doc_id", *fixed, title.alias("title"), status.alias("processing_status"), count.alias("chunk_count"))
    return rows.select(n.alias("document_id"), registry.reason().alias("reason"))
