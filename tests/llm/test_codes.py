"""Product codes against a plain search over all entries, and the tree's pruning and ties."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import codes

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """(id, code, error, label_error) of sound rows, and the codebooks, by plain loops over Python's integers."""
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(first[0][1])
    width = size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first if len(v) == size][:entries] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (d(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in whole:
                if len(v) == size:
                    mine.setdefault(near(v, p), []).append(cut(v, p))
            books[p] = [[sum(x) // len(mine[e]) for x in zip(*mine[e], strict=True)] if e in mine else b for e, b in enumerate(books[p])]
    out, total = [], {}
    for i, v, c in whole:
        e = [near(v, p) for p in range(parts)] if len(v) == size else None
        error = sum(d(cut(v, p), books[p][e[p]]) for p in range(parts)) if e else None
        out.append((i, "".join(f"{x:02x}" for x in e) if e else None, error, c))
        total[c] = (total.get(c, 0) + error) if error is not None else total.get(c)
    return [(i, code, error, total[c]) for i, code, error, c in out], ",".join(str(x) for p in books for e in p for x in e)


def both(spark, rows, parts, entries, rounds):
    frame = spark.createDataFrame(rows, SHAPE).withColumn("code", F.lit("x")).withColumn("v", F.lit(1)).withColumn("_l", F.lit(2)).withColumn("c0", F.lit(0))
    found, books = codes.compressed(spark, frame.repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, text = brute(rows, parts, entries, rounds)
    assert found.columns == ["vec_id", "code", "error", "label_error"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert books.text() == text
    return found


def test_codes_equal_a_plain_search(spark):
    r = random.Random(4)
    centre = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + r.uniform(-0.3, 0.3) for x in r.choice(centre)], r.choice([1, 1, 2, None])) for i in range(-20, 180)]
    rows += [(7, rows[3][1], 9)] * 30 + [(None, rows[5][1], 2), (500, None, 1), (501, [float("nan")] + [0.0] * 7, 1), (502, [None] + [0.0] * 7, 1), (503, [float("inf")] * 8, 1), (504, [1.0], 5), (505, [], 5), (506, [1.0], 1)]
    both(spark, rows, 4, 16, 2)
    both(spark, rows, 8, 200, 1)  # more entries than distinct vectors: ties between equal entries
    both(spark, rows[:3], 2, 64, 2)  # fewer rows than entries
    both(spark, [(i, [float(2**40 * (i % 3 - 1)), 3e38 * 0.0, 1.0, float(i)], 1) for i in range(9)], 2, 4, 1)  # beyond 64 bits


def test_empty_table_and_bad_sizes(spark):
    found, books = codes.compressed(spark, spark.createDataFrame([(1, None, 1)], SHAPE))
    assert found.count() == 0 and books is None and found.columns == ["vec_id", "code", "error", "label_error"]
    for rows, entries in (([(1, [1.0, 2.0, 3.0], 1)], 4), ([(1, [1.0, 2.0], 1)], 257)):
        try:
            codes.compressed(spark, spark.createDataFrame(rows, SHAPE), parts=2, entries=entries)
        except ValueError:
            continue
        raise AssertionError("accepted")


def test_common_labels_are_broadcast_and_rare_ones_joined(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(7)).when(F.col("id") < 1600, F.lit(None)).otherwise(F.col("id")).cast("int").alias("label"), F.col("id").alias("error"))
    got = {r.label: (r.n, r.s) for r in codes.summed_by(rows, "label", "error", "total", share=10).groupBy("label").agg(F.count("*").alias("n"), F.max("total").alias("s")).collect()}
    assert got[7] == (1500, sum(range(1500))) and got[None] == (100, sum(range(1500, 1600))) and got[2000] == (1, 2000) and len(got) == 1402


def test_tree_prunes_and_keeps_ties():
    """On clustered entries a part meets far fewer entries than there are; equal entries and equal distances give the lowest number."""
    rng = np.random.default_rng(2)
    entries = np.repeat(rng.integers(-500, 500, (16, 4)), 4, axis=0) + rng.integers(-3, 4, (64, 4))
    entries[40], entries[63] = entries[8], entries[0]
    parts = entries[rng.integers(0, 64, 5000)] + rng.integers(-4, 5, (5000, 4))
    tree = codes.Tree(entries)
    code, error = tree.nearest(parts)
    d = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert tree.compared < 0.6 * d.size
    line = codes.Tree(np.arange(0, 128, 2).reshape(-1, 1))
    assert (line.nearest(np.arange(1, 126, 2).reshape(-1, 1))[0] == np.arange(63)).all()


def test_digest_is_of_the_last_codebooks(spark):
    rows = spark.createDataFrame([(i, [i / 7, -i / 3], 1) for i in range(5)], SHAPE)
    _, books = codes.compressed(spark, rows, parts=2, entries=2, rounds=1)
    assert hashlib.sha256(books.text().encode()).hexdigest() and books.text().count(",") == 3
