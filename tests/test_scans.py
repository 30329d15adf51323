"""Quantiles and scans over one long run, against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation, scans


@pytest.fixture()
def ranges(spark):
    """Small tables in several ranges, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("bins", "small"), [(evaluation.BINS, evaluation.SMALL), (4, 3)])
def test_quantiles(spark, bins, small):
    r = random.Random(1)
    inf = float("inf")
    for values in ([r.gauss(0, 1e6) for _ in range(301)], [1.0] * 50 + [2.0] * 50, [5.0], [1.0, 1.0 + 2**-52] * 7, [r.choice([0.1, 0.2, 0.3]) for _ in range(100)], [-inf, -1.7e308, 1.7e308, inf, inf]):
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = evaluation.quantiles(frame, "v", [0.0, 0.5, 0.9, 1.0], bins, small)
        ranked = sorted(values)

        def at(share):
            p = (len(ranked) - 1) * share
            a, b = ranked[int(p)], ranked[min(len(ranked) - 1, int(p) + 1)]
            return a if p == int(p) or a == b else a + (b - a) * (p - int(p))

        assert got == [at(s) for s in (0.0, 0.5, 0.9, 1.0)] and got[1] == statistics.median(values)
    assert evaluation.quantiles(frame.filter("false"), "v", [0.5]) == [None]


def runs_of(spark, seed, n, keys, share):
    r = random.Random(seed)
    rows = [(r.choice(keys), i, r.choice("abcdefgh"), "FAILED" if r.random() < share else "SUCCESS") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i int, item string, status string").repartition(5)


@pytest.mark.parametrize(("keys", "share", "limit"), [(["x"], 0.5, 9), (["x"], 0.9, 30), (["x"], 1.0, 700), (["x"], 0.6, 1), (["x", "y", None], 0.8, 12), (["x"], 0.5, 99)])
def test_breaker_over_ranges(spark, ranges, keys, share, limit):
    rows, frame = runs_of(spark, 2, 800, keys, share)
    want = []
    for key in set(keys):
        seq = streak = 0
        for k, i, item, status in rows:
            if k == key:
                seq, streak = seq + 1, streak + 1 if status == "FAILED" else 0
                want.append((k, i, item, status, seq, streak))
                if streak >= limit:
                    break
    found = evaluation.until_breaker(frame, limit, "k", ["i"])
    assert found.columns == ["k", "i", "item", "status", "seq", "streak"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_marks_over_ranges(spark, ranges):
    rows, frame = runs_of(spark, 3, 500, ["x", "y", None], 0.5)
    want, seen = [], {}
    for k, i, item, status in rows:
        seen.setdefault(k, set()).add(item)
        want.append((k, i, item, status, len(seen[k]), len(seen[k]) % 3 == 0))
    assert sorted(map(tuple, evaluation.checkpoint_marks(frame, 3, "k", ["i"], "item").collect()), key=str) == sorted(want, key=str)


def test_one_run_is_many_tasks(spark, ranges):
    """All rows of one key: no task holds more than a part of them."""
    frame = spark.range(20000).select(F.lit("x").alias("k"), F.col("id").alias("i"), F.lit("FAILED").alias("status"))
    sizes = [r.n for r in scans.in_ranges(frame, "k", ["i"]).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 20000 * 0.7


def test_running_totals_over_ranges(spark, ranges):
    r = random.Random(4)
    rows = [(r.choice(["x", "x", "x", "y", None]), i, r.choice([None, 0, 3, 7])) for i in range(400)]
    want, total = [], {}
    for k, i, v in rows:
        want.append((k, i, v, total.get(k, 0)))
        total[k] = total.get(k, 0) + (v or 0)
    found = scans.before(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), "k", ["i"], F.col("v"), "sum")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("closed", [False, True])
def test_points_in_intervals(spark, closed):
    """Nested, empty, huge and negative intervals, hot keys, null keys; and no interval is copied to more than two bins."""
    r = random.Random(5)
    spans = [(r.choice("aab"), a, a + r.choice([0, 1, 5, 70, 1000, 20000, 1 << 40]), i) for i in range(300) for a in [r.randrange(0, 30000)]] + [(None, 0, 9, 900), ("a", None, 9, 901), ("a", -5, 9, 902), ("a", 9, 3, 903)]
    points = [(r.choice("aabc"), r.choice([r.randrange(0, 50000), 1 << 39])) for _ in range(200)] + [(None, 3), ("a", None)]
    want = [(k, p, a, b, i) for k, p in points for q, a, b, i in spans if k is not None and k == q and None not in (p, a) and 0 <= a <= p and (p <= b if closed else p < b)]
    found = scans.located(spark.createDataFrame(points, "k string, position long"), spark.createDataFrame(spans, "k string, start long, end long, n int"), "k", closed=closed)
    assert sorted(map(tuple, found.select("k", "position", "start", "end", "n").collect())) == sorted(want)
    assert scans.located(spark.createDataFrame(points, "k string, position long"), spark.createDataFrame([], "k string, start long, end long, n int"), "k").count() == 0
