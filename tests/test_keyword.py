"""The keyword store against an index made anew, and pruned search against plain BM25."""

import math
import random
import re

import pytest

from docloom.operators import keyword
from docloom.plans import flows
from docloom.sources import versions

FIELDS = {"title": 3.0, "body": 1.0}
SHAPE = "chunk_id long, document_id string, title string, body string"


def cut(x):
    return [t for t in re.split(r"[^\w]+", (x or "").lower()) if t]


def plain(docs, questions, k):
    """Every pair scored: {query: [(id, score), ...]}."""
    texts = {f: {d[0]: cut(d[2 + i]) for i_, d in enumerate(docs) if cut(d[2 + i])} for i, f in enumerate(FIELDS)}
    out = {}
    for q, text in questions:
        best = {}
        for f, boost in FIELDS.items():
            n, mean = len(texts[f]), sum(map(len, texts[f].values())) / max(1, len(texts[f]))
            for i, w in texts[f].items():
                s = None
                for t in dict.fromkeys(cut(text)):
                    df, tf = sum(t in x for x in texts[f].values()), w.count(t)
                    if tf:
                        s = (s or 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * boost * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                if s is not None:
                    best[i] = max(best.get(i, 0), s)
        ranked = sorted(((i, round(s, 6)) for i, s in best.items()), key=lambda r: (-r[1], r[0]))[:k]
        if ranked:
            out[q] = ranked
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return out


def made(seed, n, most=30):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [(i, f"d{i // 3}", " ".join(["the", *r.choices(words, k=r.randrange(0, 4))]), " ".join(["the"] * (i % 2) + r.choices(words, k=r.randrange(1, most)))) for i in range(n)]
    return docs + [(n + i, f"d{n}", "the same", "the same text") for i in range(40)], [(q, " ".join(["the", *r.choices(words, k=r.randrange(0, 12))])) for q in range(25)] + [(90, "nowhere"), (91, ""), (92, None)]


@pytest.mark.parametrize(("look", "rows"), [(keyword.LOOK, keyword.MOST_ROWS), (4, 0)])
def test_pruned_search_equals_plain_scores(spark, monkeypatch, look, rows):
    """With every join broadcast and with every join shuffled; questions of common words, ties over many equal texts, empty questions."""
    monkeypatch.setattr(keyword, "LOOK", look)
    monkeypatch.setattr(keyword, "MOST_ROWS", rows)
    docs, questions = made(1, 100)
    index = keyword.index(spark.createDataFrame(docs, SHAPE), list(FIELDS))
    asked = spark.createDataFrame(questions, "query_id long, text string")
    assert found(keyword.search(asked, index, 3, FIELDS).collect()) == plain(docs, questions, 3)
    assert keyword.search(asked, index, 0, FIELDS).count() == 0
    assert keyword.search(asked.filter("false"), index, 3, FIELDS).count() == 0


def test_common_terms_do_not_score_everything(spark):
    """Questions of one rare and two very common words: few of the pairs that share a word are left for a full score."""
    r = random.Random(2)
    docs = [(i, f"d{i}", "", " ".join(["the", "of"] * 2 + r.choices(["a", "b", "c"], k=r.randrange(1, 30)) + [f"rare{i % 100}"])) for i in range(2000)]
    index = keyword.index(spark.createDataFrame(docs, SHAPE), ["body"])
    asked = spark.createDataFrame([(q, f"the of rare{q}") for q in range(20)], "query_id long, text string")
    run = keyword.Search(asked, index, 5, {"body": 1.0})
    assert run.left(run.cutoffs()).count() < 0.02 * 20 * 2000


def test_store_replaces_documents(spark, tmp_path):
    """Writes, replacements, removals and merges: always the index of what is there, with statistics as if made anew."""
    docs, questions = made(3, 60)
    asked = spark.createDataFrame(questions, "query_id long, text string")
    store = keyword.Store(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame(rows, SHAPE)
    with pytest.raises(ValueError):
        store.read()

    def check(live):
        index = store.read()
        assert found(keyword.search(asked, index, 4, FIELDS).collect()) == plain(live, questions, 4)
        assert {r.id for r in index.postings.select("id").distinct().collect()} == {d[0] for d in live}

    store.write(frame(docs), list(FIELDS), document="document_id")
    check(docs)
    # d0 gets other, fewer chunks; an id moves from d1 to a new document; d2 comes again as it was.
    new = [(1000, "d0", "fresh title", "w1 w2 the"), (3, "dx", "moved", "w3 w3"), *(d for d in docs if d[1] == "d2")]
    live = [d for d in docs if d[1] not in ("d0", "d2") and d[0] != 3] + new
    store.write(frame(new), list(FIELDS), document="document_id")
    check(live)
    store.remove(spark.createDataFrame([("d5",), ("none",)], "document_id string"))
    live = [d for d in live if d[1] != "d5"]
    check(live)
    store.merge()
    store.vacuum()
    check(live)
    assert len(versions.read(spark, f"{store.folder}/manifest")[1]["segments"]) == 1


def test_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    docs, _ = made(4, 20)
    store = keyword.Store(spark, str(tmp_path / "store"))
    store.write(spark.createDataFrame(docs, SHAPE), list(FIELDS))
    before = sorted(map(tuple, store.read().postings.select("id", "field", "term", "tf").collect()))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", dies)
        with pytest.raises(OSError, match="gone"):
            store.write(spark.createDataFrame([(1, "d", "x", "y")], SHAPE), list(FIELDS))
    assert sorted(map(tuple, store.read().postings.select("id", "field", "term", "tf").collect())) == before
    store.vacuum()
    assert sorted(map(tuple, store.read().postings.select("id", "field", "term", "tf").collect())) == before
    # Two writers that both saw the same version: the second is told.
    other = keyword.Store(spark, store.folder)
    version, segments = other._live()
    store.write(spark.createDataFrame([(1, "d", "x", "y")], SHAPE), list(FIELDS))
    with pytest.raises(versions.Conflict):
        other._publish(version, segments)
    assert store.read().postings.filter("id = 1").count() == 2


def test_search_reads_the_folders_of_its_terms(spark, tmp_path):
    store = keyword.Store(spark, str(tmp_path / "store"))
    docs = [(i, f"d{i}", None, f"word{i} common") for i in range(300)]
    store.write(spark.createDataFrame(docs, SHAPE), list(FIELDS))
    index = store.read()
    mine = index.of_terms(spark.createDataFrame([("word7",)], "term string"))
    scanned = mine.select("bucket").distinct().collect()
    assert len(scanned) == 1 and "PartitionFilters: [" in mine._jdf.queryExecution().toString() and mine.count() < index.postings.count() / 4


def test_stored_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("a", "one two"), ("b", None)], "chunk_id string, chunk_text string").write.parquet(path)
    first = flows.stored_index(spark.read.parquet(path), "test", ["chunk_text"])
    again = flows.stored_index(spark.read.parquet(path), "test", ["chunk_text"])
    assert first.postings.inputFiles() and sorted(first.postings.inputFiles()) == sorted(again.postings.inputFiles())
    spark.createDataFrame([("c", "three")], "chunk_id string, chunk_text string").write.mode("append").parquet(path)
    assert {r.id for r in flows.stored_index(spark.read.parquet(path), "test", ["chunk_text"]).postings.select("id").collect()} == {"a", "c"}


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert versions.read(spark, folder) is None and versions.numbers(spark, folder) == []
    versions.publish(spark, folder, 1, {"x": 1})
    (tmp_path / "v" / "_draft-left-by-a-dead-writer").write_text("{")
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, 1, {"x": 2})
    for n in (2, 3):
        versions.publish(spark, folder, n, {"x": n})
    assert versions.read(spark, folder) == (3, {"x": 3}) and versions.read(spark, folder, 1) == (1, {"x": 1}) and versions.read(spark, folder, 9) is None
    versions.forget(spark, folder, keep=1)
    assert versions.numbers(spark, folder) == [3]


def test_cells_equal_plain_scores(spark, monkeypatch):
    """Many small cells, cut into bands of few scores and sums, and beyond BLOCK the bounds: the same rows as plain BM25."""
    docs, questions = made(5, 100)
    questions += [(100 + q, text) for q, text in questions[:5]]
    index = keyword.index(spark.createDataFrame(docs, SHAPE), list(FIELDS))
    asked = spark.createDataFrame(questions, "query_id long, text string")
    monkeypatch.setattr(keyword, "CELL", 64)
    monkeypatch.setattr(keyword, "WIDTH", 40)
    assert found(keyword.search(asked, index, 3, FIELDS).collect()) == plain(docs, questions, 3)
    monkeypatch.setattr(keyword, "BLOCK", 0)
    assert found(keyword.search(asked, index, 3, FIELDS).collect()) == plain(docs, questions, 3)


def test_search_runs_once_and_equal_questions_are_one(spark, monkeypatch):
    """What is asked a thousand times is scored once, and the result is a table of its own: neither postings nor broadcasts are behind it."""
    index = keyword.index(spark.createDataFrame([(i, "d", "", f"w{i % 5} x") for i in range(50)], SHAPE), ["body"])
    asked = spark.range(1000).selectExpr("id AS query_id", "concat('x w', id % 5, ' X') AS text")
    seen = []
    whole = keyword._in_cells
    monkeypatch.setattr(keyword, "_in_cells", lambda a, *rest: seen.append(a.select("query_id").distinct().count()) or whole(a, *rest))
    out = keyword.search(asked, index, 3, {"body": 1.0})
    assert seen == [5] and out.count() == 3000
    assert "Join" not in out._jdf.queryExecution().toString()
