"""Fusion, answers, evaluation, registry and streaming on small cases."""

from pyspark.sql import functions as F

from docloom.operators import answers, evaluation, fusion, vector_search
from docloom.sources import catalog
from docloom.streaming import ingest


def test_fusion(spark):
    shape = "query_id int, chunk_id string, position int, method string"
    keyword = spark.createDataFrame([(1, "a", 1, "keyword"), (1, "b", 2, "keyword")], shape)
    semantic = spark.createDataFrame([(1, "c", 1, "semantic"), (1, "b", 2, "semantic")], shape)
    rows = fusion.fused(keyword, semantic, 3).orderBy("fused_rank").collect()
    assert [(r.chunk_id, r.method) for r in rows] == [("b", "semantic"), ("a", "keyword"), ("c", "semantic")]
    assert fusion.fused(keyword, semantic, 0).count() == 0


def test_matched(spark):
    chunks = spark.createDataFrame([(1, "x", "T", 2, "h", 1), (1, "y", "T", 3, "g", 2)], "query_id int, chunk_id string, title string, page_start int, heading string, fused_rank int")
    cited = spark.createDataFrame([(1, 1, "T", 3, "h"), (1, 2, "T", 9, "g"), (1, 3, "T", 9, "z"), (1, 4, "U", 1, "h")], "query_id int, citation_rank int, title string, page_start int, heading string")
    got = {r.citation_rank: r.chunk_id for r in answers.matched(cited, chunks).collect()}
    assert got == {1: "y", 2: "y", 3: "x", 4: None}


def test_generated_isolates_failures(spark):
    def fails(system, prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return answers.echo(system, prompt)

    answers.PROVIDERS["fails"] = lambda: fails
    rows = spark.createDataFrame([(1, "s", "good one"), (2, "s", "bad one")], "query_id int, system_prompt string, user_prompt string")
    got = {r.query_id: (r.status, r.error) for r in answers.generated(rows, "fails").collect()}
    assert got == {1: ("SUCCESS", None), 2: ("FAILED", "ValueError: no")}


def test_evaluation(spark):
    row = spark.createDataFrame([(["A", " a", "B "],)], "d array<string>")
    assert row.select(evaluation.reciprocal_rank(F.col("d"), F.lit("b_report.pdf"))).first()[0] == 0.5
    one = spark.createDataFrame([("SUCCESS", 2.0)], "status string, m double")
    assert tuple(evaluation.statistics(one, ["m"]).first()) == ("m", 2.0, 2.0, 2.0, 2.0, 0.0)
    assert tuple(evaluation.statistics(one.filter("false"), ["m"]).first()) == ("m", 0.0, 0.0, 0.0, 0.0, 0.0)
    runs = spark.createDataFrame([(1, i, "SUCCESS" if s == "S" else "FAILED") for i, s in enumerate("FFSFFFS")], "k int, i int, status string")
    assert evaluation.until_breaker(runs, 3, "k", ["i"]).count() == 6


def test_vectors(spark):
    rows = spark.createDataFrame([("a", "d", [3.0, 4.0]), ("b", "d", [0.0, 0.0]), ("c", "d", [float("nan"), 1.0]), ("e", "d", [1.0]), ("f", "d", None)], "chunk_id string, document_id string, embedding array<double>")
    sound, rejects = vector_search.embedded(rows, 2, "m", "1")
    assert sound.first().embedding == [0.6, 0.8]
    assert {r.chunk_id: r.reason for r in rejects.collect()} == {"b": "zero_norm", "c": "not_finite", "e": "dimension", "f": "missing"}


def test_catalog(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text("title,document_id,year,category,source_url,filename,summary\nT,D1,0042,tax,u,a.pdf,\n T,D2,1,tax,u,a.pdf,\nT,D3,x,tax,u,a.pdf,\nT,D4,1,tax,u,.pdf,\n")
    rows = {r.document_id: r.reason for r in catalog.checked(catalog.read(spark, str(path))).collect()}
    assert rows == {"D1": None, "D2": "title not stripped text", "D3": "year not positive", "D4": "filename not a plain name"}


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a\r\nb"), (2, "c")], "doc_id long, text string").write.parquet(source)
    for text in (None, "new"):
        if text:
            spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("append").parquet(source)
        ingest.cleaned_upserts(ingest.documents(spark, source, "doc_id long, text string"), target, str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id: r.text for r in ingest.latest(spark, target).collect()} == {1: "new", 2: "c"}
