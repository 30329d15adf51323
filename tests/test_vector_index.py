"""The clustered vector index against the plain search, on clustered, hot and odd vectors."""

import numpy as np
import pytest

from docloom.operators import vector_search
from docloom.operators.vector_index import VectorIndex

SHAPE = "vec_id bigint, embedding array<float>"


def _planted(n=3000, width=16, groups=20):
    """Tight groups, one of which holds a third of all rows, with many equal vectors in it."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, width))
    own = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    rows = centres[own] + 0.05 * rng.normal(size=(n, width))
    rows[(own == 0) & (rng.random(n) < 0.3)] = centres[0]
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_plain_search_and_prunes(spark, tmp_path):
    vectors = spark.createDataFrame(_planted(), SHAPE).repartition(4)
    queries = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.write(vectors, rows=64)
    tally = spark.sparkContext.accumulator(0)
    got = _rows(index.topk(queries, 5, tally))
    assert got == _rows(vector_search.cosine_topk(spark, queries, vectors, 5))
    assert 0 < tally.value < 0.4 * 60 * 3000


def test_odd_vectors_and_queries(spark, tmp_path):
    zero, nan = [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0]
    rows = [(1, [1.0, 0.0, 0.0]), (2, zero), (3, nan), (4, None), (5, []), (None, [1.0, 0.0, 0.0]), (6, [-1.0, 0.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, SHAPE)
    queries = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, zero), (3, [0.0, -1.0, 0.0]), (4, [1.0]), (5, None), (6, nan)], "query_id bigint, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.write(vectors)
    for k in (0, 1, 3, 99):
        assert _rows(index.topk(queries, k)) == _rows(vector_search.cosine_topk(spark, queries, vectors, k))
    assert [tuple(r) for r in index.topk(queries.filter("query_id = 1"), 3).orderBy("rank").collect()] == [(1, 1, 1, 1.0), (1, 2, 8, 1.0), (1, 3, 2, 0.0)]


def test_writes_replace_and_empty(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        index.topk(spark.createDataFrame([], "query_id bigint, embedding array<float>"), 3)
    one = spark.createDataFrame([(1, [1.0, 0.0])], SHAPE)
    assert index.write(one.filter("false")) == 1
    asked = one.withColumnRenamed("vec_id", "query_id")
    assert index.topk(asked, 3).count() == 0
    assert index.write(one) == 2
    assert _rows(index.topk(asked, 3)) == [(1, 1, 1, 1.0)]
    with pytest.raises(ValueError):
        index.write(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SHAPE))
    assert _rows(index.topk(asked, 3)) == [(1, 1, 1, 1.0)]


def test_queries_in_turns(spark, tmp_path, monkeypatch):
    from docloom.operators import vector_index

    monkeypatch.setattr(vector_index, "BLOCK", 8)
    vectors = spark.createDataFrame(_planted(300), SHAPE)
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.write(vectors, clusters=6, rows=16)
    assert _rows(index.topk(queries, 4)) == _rows(vector_search.cosine_topk(spark, queries, vectors, 4))
