"""Extension: document files as a stream, upserted into a registry folder batch by batch; and windowed event counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import clean


def documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def cleaned_upserts(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Writes each batch's cleaned rows under target/batch=n; a batch that runs again replaces itself, so every row counts once. Of a key's rows in one batch the largest stays. latest() reads the newest of each key."""

    def put(batch: DataFrame, n: int) -> None:
        row = F.struct(*[c for c in batch.columns if c != key])
        rows = batch.groupBy(key).agg(F.max(row).alias("r")).select(key, "r.*").withColumn("text", clean(F.col("text"))).withColumn("content_hash", F.sha2(F.col("text"), 256))
        rows.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("r")).select(key, "r.*")


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the watermark bounds the state. Works on a stream and on a table alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = events.withWatermark("ts", late)
    return marked.groupBy(w, "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n_events", "total")


_TOLD = "document_id string, modified bigint, content_hash string, status string, attempts int, streak int"
_KEPT = "done string, newest bigint, attempts int, streak int"


def file_states(files: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """One row for each file of a stream files(document_id string, modified bigint, content_hash string, error string), by what its document's state says.

    SKIPPED: these bytes were ingested before. STALE: a newer file of the document came in an earlier batch. Else an attempt, SUCCESS or (error is not null) FAILED; attempts
    counts them, streak the failures in a row. Files of a batch go by modified, hash and error, so their order in it doesn't matter. A document that is failing and gets no file for patience_ms has a row
    GIVEN_UP without a hash, in the first batch after that; a run that is to end by itself (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off, else it waits for time-outs
    for ever. Per document the state is one row of fixed size, which the checkpoint keeps over restarts; files without an id are left to the caller. A task holds one
    document's files of one batch at a time: limit batches by maxFilesPerTrigger where a document may have very many.
    """
    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def judged(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, newest, attempts, streak = state.get if state.exists else (None, None, 0, 0)
        told = []
        if state.hasTimedOut:
            told.append((newest, None, "GIVEN_UP", attempts, streak))
            state.update((done, newest, attempts, streak))
        else:
            rows = pd.concat(list(parts)).sort_values(["modified", "content_hash", "error"], na_position="first")
            before = newest
            for modified, content, error in zip(rows["modified"], rows["content_hash"], rows["error"], strict=True):
                if before is not None and modified < before:
                    status = "STALE"
                elif done is not None and content == done:
                    status = "SKIPPED"
                else:
                    failed = not pd.isna(error)
                    status, attempts, streak = ("FAILED", attempts + 1, streak + 1) if failed else ("SUCCESS", attempts + 1, 0)
                    done = done if failed else content
                newest = int(modified) if newest is None else max(newest, int(modified))
                told.append((int(modified), content, status, attempts, streak))
            state.update((done, newest, attempts, streak))
            if patience_ms is not None and streak > 0:
                state.setTimeoutDuration(patience_ms)
        out = pd.DataFrame(told, columns=["modified", "content_hash", "status", "attempts", "streak"])
        out.insert(0, "document_id", key[0])
        yield out

    named = files.filter("document_id is not null and modified is not null").select("document_id", "modified", "content_hash", "error")
    return named.groupBy("document_id").applyInPandasWithState(judged, _TOLD, _KEPT, "append", timeout)
