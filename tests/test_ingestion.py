"""Sources, ingestion runs, versions and stores on small files and tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, evaluation, vector_search, windows
from docloom.plans import flows
from docloom.plans import queries as library
from docloom.sources import catalog, files, registry

from .conftest import SF


def test_files(spark, tmp_path):
    for category, name, body in (("tax", "b.PDF", b"2"), ("tax", "a.pdf", b"1"), ("tax", "c.txt", b"3"), ("acts", "a.pdf", b"4")):
        (tmp_path / category).mkdir(exist_ok=True)
        (tmp_path / category / name).write_bytes(body)
    folders = {c: str(tmp_path / c) for c in ("tax", "acts")}
    found = {(r.category, r.filename): r.content_hash for r in files.scan(spark, folders).collect()}
    assert found == {k: hashlib.sha256(v).hexdigest() for k, v in {("tax", "a.pdf"): b"1", ("tax", "b.PDF"): b"2", ("acts", "a.pdf"): b"4"}.items()}
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, folders["tax"], ".pdf").collect()] == ["a.pdf", "b.PDF"]
    with pytest.raises(ValueError):
        files.scan(spark, {})
    raw = spark.read.format("binaryFile").load(folders["tax"]).select("path", "content")

    def pages(content):
        if content == b"2":
            raise ValueError("damaged")
        return ["one", "", "three"] if content == b"1" else []

    got = {(r.path.rsplit("/", 1)[1], r.page): (r.text, r.error) for r in files.decode(raw, pages).collect()}
    assert got == {("a.pdf", 1): ("one", None), ("a.pdf", 2): ("", None), ("a.pdf", 3): ("three", None), ("b.PDF", None): (None, "ValueError: damaged")}


def test_pages_and_intrinsic(spark):
    rows = spark.createDataFrame([("D", 2, "bc"), ("D", 1, "a"), ("D", 3, None), ("E", 1, "é中")], "document_id string, page int, text string")
    got = {r.document_id: (r.raw_text, [tuple(p) for p in r.page_offsets], r.page_count) for r in files.joined_pages(rows).collect()}
    assert got == {"D": ("abc", [(0, 1), (1, 3), (3, 3)], 3), "E": ("é中", [(0, 2)], 1)}
    one = spark.createDataFrame([({"modDate": "2", "title": "T", "author": "", "other": "x"},)], "m map<string,string>")
    assert [tuple(x) for x in one.select(files.intrinsic(F.col("m"))).first()[0]] == [("title", "T"), ("modification_date", "2")]


def test_registry_versions_and_json(spark, tmp_path):
    store = str(tmp_path / "registry")
    shape = "document_id string, content_hash string"
    with pytest.raises(ValueError):
        registry.load(spark, store)
    for n, h in enumerate("abcd", 1):  # within one tick of the clock
        assert registry.commit(spark, spark.createDataFrame([("D1", h)], shape), store) == n
        assert registry.load(spark, store).first().content_hash == h
    (tmp_path / "registry" / "pointer" / "version=5").mkdir()  # what a commit that died may leave
    assert registry.commit(spark, spark.createDataFrame([("D1", "e")], shape), store) == 5
    old = spark.createDataFrame([("a", "1"), ("b", "1")], shape)
    new = spark.createDataFrame([("b", "2"), ("b", "3"), ("c", "1")], shape)
    assert sorted(map(tuple, registry.upsert(old, new).collect())) == [("a", "1"), ("b", "3"), ("c", "1")]
    assert sorted(map(tuple, registry.upsert(old, new.withColumn("t", 0 - F.col("content_hash").cast("int")), order="t").collect()))[1] == ("b", "2")
    record = {c: "x" for c in registry.TEXTS} | {"processing_status": "completed", "chunk_count": 3}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"records": [record | {"document_id": "a"}, record | {"document_id": "b", "title": " x"}, record | {"document_id": "c", "chunk_count": -1}]}))
    assert {r.document_id: r.reason for r in registry.read_json(spark, str(path)).withColumn("reason", registry.reason()).collect()} == {"a": None, "b": "title not stripped text", "c": "chunk_count negative"}
    for bad in (json.dumps({"records": [record, record]}), json.dumps([record]), json.dumps({"records": [], "x": 1}), json.dumps({"records": [record | {"more": 1}]}), '{"records": [], "records": []}', "{"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            registry.read_json(spark, str(path))
    assert [r.content_hash for r in registry.lookup(spark.createDataFrame([("a",), ("z",)], "document_id string"), old).orderBy("document_id").collect()] == ["1", None]


def test_ingestion_run(spark):
    """One file's failure is its own; a second run over the registered results skips what succeeded and takes up what failed."""
    text = "PART I One\nA b c. " * 40
    shape = "category string, filename string, content_hash string, raw_text string, error string"
    rows = spark.createDataFrame([("tax", "a.pdf", "h1", text, None), ("tax", "b.pdf", "h2", None, "ValueError: damaged"), ("tax", "c.pdf", "h3", "  ", None), ("acts", "a.pdf", "h4", text, None)], shape)
    rows = rows.withColumn("page_offsets", F.array(F.struct(F.lit(0).alias("start"), F.length(F.coalesce("raw_text", F.lit(""))).alias("end"))))
    listed = spark.createDataFrame([("tax", f"{x}.pdf", f"D{x}", "T", 1, "u", None) for x in "abc"], "category string, filename string, document_id string, title string, year int, source_url string, summary string")
    known = spark.createDataFrame([], "document_id string, content_hash string, processing_status string")
    chunks, statuses = flows.ingested(rows, listed, known, {"most": 60, "overlap": 10})
    got = {(r.category, r.filename): (r.status, r.reason, r.chunk_count) for r in statuses.collect()}
    n = chunks.count()
    assert n > 2 and {r.document_id for r in chunks.collect()} == {"Da"}
    assert got == {("tax", "a.pdf"): ("SUCCESS", None, n), ("tax", "b.pdf"): ("FAILED", "ValueError: damaged", 0), ("tax", "c.pdf"): ("FAILED", "no text", 0), ("acts", "a.pdf"): ("FAILED", "no catalogue row", 0)}
    known = statuses.filter("status = 'SUCCESS'").select("document_id", "content_hash", F.lit("completed").alias("processing_status"))
    again = rows.withColumn("error", F.lit(None).cast("string")).withColumn("raw_text", F.coalesce("raw_text", F.lit(text)))
    _, statuses = flows.ingested(again, listed, known)
    assert {r.filename: r.status for r in statuses.filter("category = 'tax'").collect()} == {"a.pdf": "SKIPPED", "b.pdf": "SUCCESS", "c.pdf": "FAILED"}
    totals = {r.status: (r.documents, r.chunks) for r in evaluation.run_counters(library._run(spark, SF)[1]).collect()}
    assert sum(d for d, _ in totals.values()) == 200 and totals["SUCCESS"][1] >= totals["SUCCESS"][0]


def test_results_store_resumes(spark, tmp_path):
    folder, shape = str(tmp_path / "answers"), "question_id string, answer string, status string"
    evaluation.store(spark.createDataFrame([("q1", "a", "SUCCESS"), ("q2", None, "FAILED")], shape), folder, 1)
    golden = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "question_id string")
    left = evaluation.remaining(golden, evaluation.stored(spark, folder))
    assert sorted(r.question_id for r in left.collect()) == ["q2", "q3"]
    for _ in range(2):  # a repeated run replaces itself
        evaluation.store(spark.createDataFrame([("q1", None, "FAILED"), ("q2", "b", "SUCCESS")], shape), folder, 2)
    assert sorted((r.question_id, r.answer) for r in evaluation.stored(spark, folder).collect()) == [("q1", "a"), ("q2", "b")]
    scores = spark.createDataFrame([("SUCCESS", 1.0), ("SUCCESS", 3.0), ("FAILED", None)], "status string, m double")
    made = json.loads(evaluation.summary(scores, ["m"]).first().summary)
    assert (made["total"], made["success"], made["failed"], made["statistics"]["m"]["mean"]) == (3, 2, 1, 2.0)


def test_bulk_index_is_whole_or_not_at_all(spark, tmp_path):
    from docloom.operators import keyword

    shape, folder = "chunk_id string, chunk_text string", str(tmp_path / "index")
    for bad in ([("a", "x"), ("a", "y")], [(None, "x")], [("a", "x"), ("b", " ")]):
        with pytest.raises(ValueError):
            keyword.bulk(spark.createDataFrame(bad, shape), ["chunk_text"], folder)
    found = keyword.bulk(spark.createDataFrame([("a", "one two two"), ("b", "two")], shape), ["chunk_text"], folder)
    assert {(r.id, r.term): r.tf for r in found.postings.collect()} == {("a", "one"): 1, ("a", "two"): 2, ("b", "two"): 1}
    assert tuple(found.fields.first()) == ("chunk_text", 2, 2.0)


def test_vector_upsert_checks_dimensions(spark):
    shape = "id string, document_id string, embedding array<double>"
    store = spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "a", [0.0, 1.0]), ("3", "b", [1.0, 1.0])], shape)
    new = spark.createDataFrame([("9", "a", [2.0, 2.0])], shape)
    assert sorted(r.id for r in vector_search.upsert(store, new, 2).collect()) == ["3", "9"]
    with pytest.raises(ValueError):
        vector_search.upsert(store, new, 3)
    assert vector_search.upsert(store, new.filter("false"), 2).count() == 3
    # A new id twice, and an id that was another document's: one point each.
    twice = spark.createDataFrame([("9", "a", [2.0, 2.0]), ("9", "a", [3.0, 0.0]), ("3", "c", [4.0, 4.0])], shape)
    assert sorted((r.id, r.document_id, r.embedding) for r in vector_search.upsert(store, twice, 2).collect()) == [("3", "c", [4.0, 4.0]), ("9", "a", [3.0, 0.0])]


def test_catalogue_rejects(spark, tmp_path):
    path = tmp_path / "catalogue.csv"
    head = ",".join(catalog.COLUMNS)
    path.write_text(f'{head}\nD1,T,2001,tax,u,a.pdf,"s, t"\nD2,T,2001,tax,u\nD3,T,2001,tax,u,a.pdf,s,more\nD4,T,0,tax,u,b.pdf,\n')
    rows, rejects = catalog.parted(spark, str(path))
    assert [(r.document_id, r.year, r.summary) for r in rows.collect()] == [("D1", 2001, "s, t")]
    assert {(r.record[:2], r.reason) for r in rejects.collect()} == {("D2", "wrong number of fields"), ("D3", "wrong number of fields"), ("D4", "year not positive")}


def test_golden_set(spark, tmp_path):
    path = tmp_path / "golden.csv"
    head = ",".join(evaluation.GOLDEN) + ",note\n"
    path.write_text(head + 'q1, What? ,"yes, so",d1_x.pdf,,n\n')
    assert evaluation.read_golden(spark, str(path)).first().question == "What?"
    for body in (head + "q1,,a,d,,\n", "question_id,question\nq1,x\n"):
        path.write_text(body)
        with pytest.raises(ValueError):
            evaluation.read_golden(spark, str(path))


def test_header_split_and_stage_ids(spark):
    from docloom.operators import standardise

    docs = spark.createDataFrame([("D", "some text")], "document_id string, text string")
    made = standardise.standardise(docs, F.lit("Head"))
    assert made.select(standardise.body_fault(F.col("mappings"), F.col("body_start"))).first()[0] is None
    assert made.select(standardise.body_fault(F.slice("mappings", 2, 9), F.col("body_start"))).first()[0] == "no header mapping"
    assert made.select(standardise.body_fault(F.col("mappings"), F.lit(1))).first()[0] == "body start differs"
    rows = spark.createDataFrame([("a", "a", "x"), ("a", "b", "x"), ("a", "a", " "), (None, None, "x")], "e string, f string, t string")
    assert [r[0] for r in rows.select(standardise.stage_fault(F.col("e"), F.col("f"), F.col("t"))).collect()] == [None, "id differs", "no text", None]


def test_catalogue_join(spark):
    listed = spark.createDataFrame([("tax", "a.pdf", "D1", "T", 1, "u", None)], "category string, filename string, document_id string, title string, year int, source_url string, summary string")
    found = spark.createDataFrame([("tax", "a.pdf"), ("acts", "a.pdf")], "category string, filename string")
    assert {r.category: (r.document_id, r.matched) for r in catalog.join_files(found, listed).collect()} == {"tax": ("D1", True), "acts": (None, False)}


def test_routes_and_panel(spark):
    rows = spark.createDataFrame([(1, " Thank\nyou ", None), (2, "tax?", '{"route": "LEGAL_RAG", "confidence": 0.5}'), (3, "x", "no json"), (4, "y", '{"route": "reject"}')], "query_id int, text string, reply string")
    routed = answers.routed(rows, "reply")
    assert {r.query_id: (r.route.route, r.route.confidence) for r in routed.collect()} == {1: ("general_chat", 1.0), 2: ("legal_rag", 0.5), 3: ("general_chat", 0.0), 4: ("reject", 0.0)}
    got = {r.query_id: (r.answer, r.total_tokens, r.system_prompt) for r in answers.dispatched(routed).collect()}
    assert got[2] == (None, None, answers.LEGAL_SYSTEM) and got[1][2] == got[3][2] == answers.CHAT_SYSTEM and got[4] == (answers.CANNED["reject"], 0, None)
    one = spark.createDataFrame([(1, "legal_rag", 0.456, "m", 12.6, 1, 2, 3, 4, "STOP")], "query_id int, route string, confidence double, model string, latency_ms double, prompt_tokens int, completion_tokens int, total_tokens int, n_chunks int, finish_reason string")
    assert tuple(answers.panel(one).first()) == (1, "legal_rag", "0.46", "m", "13", 1, 2, 3, 4, "STOP")
    named = spark.createDataFrame([(answers.MODELS[0][0],), ("none",)], "model_id string")
    assert {r.model_id: r.known for r in answers.with_model(named, spark).collect()} == {answers.MODELS[0][0]: True, "none": False}


def test_chunk_faults(spark):
    rows = spark.createDataFrame([("a", "D1", 0, 5), ("b", "D1", 1, 3), ("c", "D2", 0, 0), ("c", "D2", 1, 9), ("d", "D3", 0, 0)], "chunk_id string, document_id string, ordinal int, source_start int")
    assert sorted(map(tuple, windows.faults(rows).collect())) == [("D1", "source start goes back"), ("D2", "chunk id repeats")]


def test_cosine_cells_equal_broadcast(spark):
    """Beyond the broadcast bound queries and vectors are dealt into cells; lengths differ, ids are null, vectors empty."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 2).round(2).tolist()) for i in range(60)] + [(None, [1.0, 0.0]), (70, None), (71, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id < 20 or vec_id is null").withColumnRenamed("vec_id", "query_id")
    got = [sorted(map(tuple, vector_search.cosine_topk(spark, asked, vectors, 3, block).collect())) for block in (4096, 7)]
    want = []
    for q, v in rows[:20]:
        near = sorted((-round(float(np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c)), 6), i) for i, c in rows[:60] if len(c) == len(v))
        want += [(q, r, i) for r, (_, i) in enumerate(near[:3], 1)]
    assert got[0] == got[1] and [g[:3] for g in got[0]] == want


def test_a_file_is_one_row_whatever_is_listed_twice(spark):
    """Two catalogue rows under a file's name and a registry row that repeats: one status a file; a fault stays with its file though another shares its id."""
    text_ = "PART I x\nbody of it"
    files_ = spark.createDataFrame([("tax", "a.pdf", "h1", text_, None), ("acts", "a.pdf", "h2", text_ + " more", None), ("acts", "b.pdf", "h3", None, "ValueError: x")], "category string, filename string, content_hash string, raw_text string, error string")
    files_ = files_.selectExpr("*", "array(struct(0 as start, 100 as end)) as page_offsets")
    listed = spark.createDataFrame([("tax", "a.pdf", "D1", "t"), ("tax", "a.pdf", "D1", "u"), ("acts", "a.pdf", "D1", "t"), ("acts", "b.pdf", "D2", "t")], "category string, filename string, document_id string, title string")
    listed = listed.selectExpr("*", "2000 as year", "'s' as source_url", "cast(null as string) as summary")
    known = spark.createDataFrame([("D1", "h1", "completed"), ("D1", "h1", "completed"), ("D9", "h9", "completed")], "document_id string, content_hash string, processing_status string")
    chunks, rows = flows.ingested(files_, listed, known)
    assert sorted((r.category, r.filename, r.status) for r in rows.collect()) == [("acts", "a.pdf", "SUCCESS"), ("acts", "b.pdf", "FAILED"), ("tax", "a.pdf", "SKIPPED")]
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0
    assert "content_hash" not in chunks.columns


def test_values_of_texts_under_one_id(spark, tmp_path, duck):
    """Keys of seven digits share ids of six: statutes and entities of an id stand once, as in SQL, and a file has one status."""
    key = F.when(F.col("p_partkey") < 2, F.col("p_partkey") + 100000).otherwise(F.col("p_partkey") + 999998)
    spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey < 24").withColumn("p_partkey", key).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("metadata_values", "relationship_edges", "ingestion_run"):
        df = library.QUERIES[name](spark, str(tmp_path))
        names = sorted(df.columns)
        made = duck.execute(f"WITH part AS (SELECT * FROM '{tmp_path}/part.parquet/*.parquet') SELECT {', '.join(names)} FROM ({library.SQL[name]})").fetchall()
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(made, key=str)
