"""The stateful file stream against a plain replay, over restarts, repeats, late files and time-outs."""

import random
import time

from docloom.streaming import ingest

FILES = "document_id string, modified bigint, content_hash string, error string"


def _replay(batches):
    """The same by a plain loop over dictionaries."""
    state, out = {}, []
    for batch in batches:
        seen = {d: s["newest"] for d, s in state.items()}
        for document, modified, content, error in sorted(batch, key=lambda r: (r[1], r[2], r[3] or "")):
            if document is None:
                continue
            s = state.setdefault(document, {"done": None, "newest": modified, "attempts": 0, "streak": 0})
            if modified < seen.get(document, modified):
                status = "STALE"
            elif content == s["done"]:
                status = "SKIPPED"
            else:
                s["attempts"] += 1
                status = "FAILED" if error else "SUCCESS"
                s["streak"] = s["streak"] + 1 if error else 0
                s["done"] = s["done"] if error else content
            s["newest"] = max(s["newest"], modified)
            out.append((document, modified, content, status, s["attempts"], s["streak"]))
    return sorted(out)


def _run(spark, folder, batch, patience=None):
    """Puts a batch of files in and runs the stream, started anew, until nothing is left."""
    spark.createDataFrame(batch, FILES).repartition(3).write.mode("append").parquet(f"{folder}/in")
    told = ingest.file_states(spark.readStream.schema(FILES).parquet(f"{folder}/in"), patience)
    told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_equals_replay_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(f"d{rng.randrange(6)}", rng.randrange(40) + 15 * b, f"h{rng.randrange(3)}", rng.choice([None, "ValueError: damaged"])) for _ in range(30)] for b in range(3)]
    batches[0].append((None, 1, "h", None))
    batches[1] += batches[0][:5]
    for batch in batches:
        got = _run(spark, str(tmp_path), batch)
    want = _replay(batches)
    assert got == sorted(want, key=str)
    assert {r[3] for r in want} == {"STALE", "SKIPPED", "FAILED", "SUCCESS"}


def test_failing_documents_are_given_up_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        _given_up(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _given_up(spark, tmp_path):
    _run(spark, str(tmp_path), [("a", 1, "h1", "no"), ("b", 1, "h1", None)], 1)
    time.sleep(0.1)
    _run(spark, str(tmp_path), [("c", 1, "h1", None)], 1)
    got = _run(spark, str(tmp_path), [("a", 2, "h2", None)], 1)
    assert [r for r in got if r[0] == "a"] == [("a", 1, "h1", "FAILED", 1, 1), ("a", 1, None, "GIVEN_UP", 1, 1), ("a", 2, "h2", "SUCCESS", 2, 0)]
    assert len(got) == 5
