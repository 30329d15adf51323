"""Registry of processed documents: Parquet snapshots, written whole and switched by numbered versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

# States of a document.
STATES = ["pending", "in_progress", "completed", "failed", "skipped"]
TEXTS = ["document_id", "content_hash", "title", "category", "source_url", "parser_version", "cleaner_version", "metadata_version", "chunker_version", "embedding_model", "embedding_model_version", "index_version", "processing_timestamp", "processing_status"]


def reason() -> F.Column:
    """First rule that a record breaks, else null."""
    out = None
    for c in TEXTS:
        bad = ~F.coalesce(F.col(c).rlike(r"(?Us)^\S(.*\S)?$"), F.lit(False))
        out = F.when(bad, f"{c} not stripped text") if out is None else out.when(bad, f"{c} not stripped text")
    return out.when(~F.col("processing_status").isin(STATES), "processing_status unknown").when(F.coalesce(F.col("chunk_count") < 0, F.lit(True)), "chunk_count negative")


def _file_fault(body: str) -> str | None:
    """What is wrong with a registry file as a whole: its root, a record's fields, a key that stands twice."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    try:
        root = json.loads(body, object_pairs_hook=once)
    except ValueError as e:
        return str(e)
    if not isinstance(root, dict) or set(root) != {"records"} or not isinstance(root["records"], list):
        return "the root is not an object of records alone"
    return next((f"fields of record {i}" for i, r in enumerate(root["records"]) if not isinstance(r, dict) or set(r) - {"summary"} != {*TEXTS, "chunk_count"}), None)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a ``{"records": [...]}`` file. Another root, other fields, a key or an id that stands twice fail with a ValueError."""
    check = F.udf(_file_fault, "string")  # once a file
    for r in spark.read.text(path, wholetext=True).select(check("value").alias("fault")).filter("fault is not null").limit(1).collect():
        raise ValueError(f"registry file: {r.fault}")
    shape = "records array<struct<" + ", ".join(f"{c}: string" for c in TEXTS) + ", chunk_count: int, summary: string>>"
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(shape).json(path).select(F.inline("records"))
    if not rows.groupBy("document_id").count().filter("count > 1").isEmpty():
        raise ValueError("registry ids repeat")
    return rows


def changed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files(document_id, content_hash) without those completed under the same hash."""
    done = registry.filter("processing_status = 'completed'").select("document_id", "content_hash")
    return files.join(done, ["document_id", "content_hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "document_id", order: str | None = None) -> DataFrame:
    """old with the rows of new put in by key. Of several new rows of a key the last by order stays; without order, or among equals, the largest row."""
    row = F.struct(*[c for c in new.columns if c != key])
    last = F.struct(order, row) if order else row
    new = new.groupBy(key).agg(F.max_by(row, last).alias("r")).select(key, "r.*")
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def lookup(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """ids(document_id) with their record; nulls where there is none."""
    return ids.join(registry, "document_id", "left")


def commit(spark: SparkSession, records: DataFrame, folder: str) -> int:
    """Writes a new snapshot, then publishes it under the next version number, which is returned; readers see the old or the new one, whole.

    Of two commits of one version the second raises versions.Conflict. One that dies half way leaves files that nobody reads, and the next commit goes on.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    records.write.parquet(f"{folder}/{name}")
    found = versions.read(spark, f"{folder}/pointer")
    return versions.publish(spark, f"{folder}/pointer", 1 + (found[0] if found else 0), {"name": name})


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of the largest version."""
    found = versions.read(spark, f"{folder}/pointer")
    if found is None:
        raise ValueError("the registry has no snapshot")
    return spark.read.parquet(f"{folder}/{found[1]['name']}")
