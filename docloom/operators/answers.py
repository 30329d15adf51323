"""Routing, citations, prompts, model calls and what is shown of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import GREETINGS, normal_query, page_label, strip_ids, strip_thinking

# Routes, finish reasons and models.
ROUTES = ["legal_rag", "general_chat", "reject", "clarify"]
FINISH = {"stop": "STOP", "length": "MAX_TOKENS", "max_tokens": "MAX_TOKENS", "content_filter": "SAFETY", "safety": "SAFETY"}
MODELS = [("gemini-3.5-flash", "Gemini 3.5 Flash", "gemini"), ("gemini-3.1-flash-lite", "Gemini 3.1 Flash Lite", "gemini"), ("qwen/qwen3-32b", "Qwen 3 32B", "groq"), ("nvidia/llama-3.3-nemotron-super-49b-v1", "Llama 3.3 Nemotron Super 49B", "nvidia")]
IMPLEMENTED = ["gemini", "groq"]
CANNED = {"reject": "This assistant answers questions about United States law and taxation only.", "clarify": "The question can be read in several ways. Please add context or put it differently."}
EMPTY_CONTEXT = "No passage was found for this question."
INSTRUCTIONS = "Answer from the context alone and name the passages used. Say so if the context does not hold the answer."
LEGAL_SYSTEM = "You answer questions about United States law and taxation from given passages."
CHAT_SYSTEM = "You are a helpful assistant for short everyday conversation."
RULE = "=" * 80


def rule_route(text: Column) -> Column:
    """struct(route, confidence, reason) where a fixed phrase decides, else null."""
    return F.when(normal_query(text).isin(GREETINGS), F.struct(F.lit("general_chat").alias("route"), F.lit(1.0).alias("confidence"), F.lit("fixed phrase").alias("reason")))


def parsed_route(reply: Column) -> Column:
    """Route from a model's JSON reply. The route's case doesn't matter; a missing confidence is 0, a missing reason empty; anything else that isn't an object with a known route is general_chat, 0."""
    j = F.from_json(reply, "route string, confidence double, reason string", {"mode": "PERMISSIVE"})
    route = F.lower(j["route"])
    good = route.isin(ROUTES)
    return F.when(good, F.struct(route.alias("route"), F.coalesce(j["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(j["reason"], F.lit("")).alias("reason"))).otherwise(F.struct(F.lit("general_chat").alias("route"), F.lit(0.0).alias("confidence"), F.lit("malformed reply").alias("reason")))


def routed(queries: DataFrame, reply: str) -> DataFrame:
    """queries with route: the rule's, else the one parsed from the reply column."""
    return queries.withColumn("route", F.coalesce(rule_route(F.col("text")), parsed_route(F.col(reply))))


def dispatched(queries: DataFrame) -> DataFrame:
    """queries(text, route) with answer and token counts where the route has a canned text, and the system text for the others."""
    route = F.col("route.route")
    canned = F.element_at(F.create_map(*[F.lit(v) for pair in CANNED.items() for v in pair]), route)
    return queries.withColumn("answer", canned).withColumn("total_tokens", F.when(canned.isNotNull(), 0)).withColumn("system_prompt", F.when(route == "legal_rag", LEGAL_SYSTEM).when(route == "general_chat", CHAT_SYSTEM))


def citations(chunks: DataFrame) -> DataFrame:
    """The first chunk of each (query_id, document_id, page_start, page_end) in order of fused_rank, with citation_rank."""
    first = Window.partitionBy("query_id", "document_id", "page_start", "page_end").orderBy("fused_rank")
    out = chunks.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return out.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank")).alias("citation_rank"), "document_id", "title", "heading", "source_url", "page_start", "page_end")


def matched(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each citation with its chunk: same title and page, else title and heading, else title; the first in fused order. Sorted place in card_rank, unmatched last."""
    c = chunks.select("query_id", "title", F.col("chunk_id").alias("m_chunk"), F.col("page_start").alias("m_page"), F.col("heading").alias("m_heading"), F.col("fused_rank").alias("m_rank"))
    both = cited.join(c, ["query_id", "title"], "left")
    level = F.when((F.col("page_start") == F.col("m_page")) & (F.col("m_page") != 0), 1).when((F.col("heading") == F.col("m_heading")) & (F.col("heading") != ""), 2).otherwise(3)
    best = both.groupBy(*cited.columns).agg(F.min(F.when(F.col("m_rank").isNotNull(), F.struct(level.alias("level"), "m_rank", "m_chunk"))).alias("m"))
    place = Window.partitionBy("query_id").orderBy(F.coalesce("m.m_rank", F.lit(99999)), "citation_rank")
    return best.select(*cited.columns, F.col("m.m_chunk").alias("chunk_id"), F.col("m.m_rank").alias("chunk_rank"), F.row_number().over(place).alias("card_rank"))


def evidence() -> Column:
    """One passage for the prompt; the number is the leg's rank, so fused lists may repeat a number."""
    return F.concat(F.lit("[Evidence "), F.col("retrieval_rank").cast("string"), F.lit("]\nTitle: "), F.col("title"), F.lit("\nPages: "), page_label(F.col("page_start"), F.col("page_end")), F.lit("\nSource: "), F.col("source_url"), F.lit("\n\n"), strip_ids(F.col("chunk_text")))


def contexts(chunks: DataFrame) -> DataFrame:
    """(query_id, context): passages in fused order, a rule between them. k passages a query at most, so no group grows with the corpus."""
    parts = chunks.select("query_id", F.struct("fused_rank", evidence().alias("body")).alias("p")).groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("query_id", F.array_join(F.col("p.body"), f"\n\n{RULE}\n\n").alias("context"))


def prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """queries(query_id, text) with system_prompt and user_prompt; a query without passages gets the fixed sentence."""
    out = queries.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(EMPTY_CONTEXT)))
    return out.withColumn("system_prompt", F.lit(LEGAL_SYSTEM)).withColumn("user_prompt", F.concat(F.lit("Question:\n"), F.col("text"), F.lit("\n\nContext:\n"), F.col("context"), F.lit(f"\n\n{INSTRUCTIONS}")))


def echo(system: str, prompt: str) -> dict:
    """A deterministic stand-in for a model, for tests: the first 20 words of the prompt."""
    words = prompt.split()
    return {"text": " ".join(words[:20]), "prompt_tokens": len(words) + len(system.split()), "completion_tokens": min(20, len(words)), "finish": "stop"}


PROVIDERS: dict[str, Callable[[], Callable[[str, str], dict]]] = {"echo": lambda: echo}


def generated(prompts: DataFrame, provider: str = "echo", model: str = "echo") -> DataFrame:
    """prompts(query_id, system_prompt, user_prompt) with text, tokens, latency, finish_reason, status and error; a failing call gives a FAILED row.

    Equal prompts are sent once. A provider is built once a task; unknown names raise KeyError.
    """
    make = PROVIDERS[provider]
    distinct = prompts.select("system_prompt", "user_prompt").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from time import perf_counter

        call = make()
        for batch in batches:
            rows = []
            for system, user in zip(batch["system_prompt"], batch["user_prompt"], strict=True):
                start = perf_counter()
                try:
                    r, error = call(system, user), None
                except Exception as e:  # isolated: one question's failure is its own row
                    r, error = {}, f"{type(e).__name__}: {e}"
                rows.append((system, user, r.get("text"), r.get("prompt_tokens"), r.get("completion_tokens"), (perf_counter() - start) * 1000, r.get("finish"), error))
            yield pd.DataFrame(rows, columns=["system_prompt", "user_prompt", "raw", "prompt_tokens", "completion_tokens", "latency_ms", "finish", "error"]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    replies = distinct.mapInPandas(run, "system_prompt string, user_prompt string, raw string, prompt_tokens bigint, completion_tokens bigint, latency_ms double, finish string, error string")
    out = prompts.join(replies, ["system_prompt", "user_prompt"]).withColumn("answer", strip_thinking(F.col("raw"))).drop("raw")
    return out.withColumn("finish_reason", finish_reason(F.col("finish"))).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED")).withColumn("provider", F.lit(provider)).withColumn("model", F.lit(model)).drop("finish")


def finish_reason(raw: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in FINISH.items() for v in pair]), F.lower(raw)), F.lit("OTHER"))


def models(spark: SparkSession, implemented: bool = True) -> DataFrame:
    rows = spark.createDataFrame(MODELS, "id string, display_name string, provider string")
    return rows.filter(F.col("provider").isin(IMPLEMENTED)) if implemented else rows


def with_model(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """rows(model_id) with the model's columns; known is false where there is no such model."""
    return rows.join(F.broadcast(models(spark, False)).withColumnRenamed("id", "model_id").withColumn("known", F.lit(True)), "model_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def panel(responses: DataFrame) -> DataFrame:
    """What the metrics panel shows of responses(route, confidence, model, latency_ms, prompt_tokens, completion_tokens, total_tokens, n_chunks, finish_reason)."""
    return responses.select("query_id", "route", F.format_string("%.2f", "confidence").alias("confidence"), "model", F.format_string("%.0f", "latency_ms").alias("latency"), "prompt_tokens", "completion_tokens", "total_tokens", "n_chunks", "finish_reason")
