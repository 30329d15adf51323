"""Near-duplicates where buckets are hot: many near copies, a passage that many texts share, and what the passes may not lose."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import neardup

from ..conftest import SF
from .test_operators import weighted_jaccard, words


def classes_of(texts, least=0.8):
    """Brute force over all pairs: class of every text by its smallest member."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and weighted_jaccard(texts[i], texts[j]) >= least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def hot_texts():
    """120 copies of one text with one to four words changed, 60 texts that share a long passage with more or less of their own, exact copies, and others."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    base, passage, out = [word() for _ in range(150)], [word() for _ in range(200)], []
    for _ in range(120):
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = word()
        out.append(w)
    for i in range(60):
        out.append([word() for _ in range(15 + i)] + passage + [word() for _ in range(10)])
    out += [base] * 20 + [[word() for _ in range(30)] for _ in range(20)] + [["again"] * n for n in (40, 45, 90)]
    r.shuffle(out)
    return out


def test_hot_groups_equal_brute_force(spark):
    texts = hot_texts()
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(spark, frame.repartition(7)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)
    assert max(Counter(got.values()).values()) > 100


def test_prefixes_lose_no_pair(spark):
    """Every pair of the similarity shares a listed token at places that leave room for its overlap."""
    texts = hot_texts()[:160]
    frame = spark.createDataFrame([(i.to_bytes(2, "big"), " ".join(w)) for i, w in enumerate(texts)], "tid binary, text string")
    listed = defaultdict(dict)
    for r in neardup.prefixes(spark, frame).collect():
        listed[int.from_bytes(r.tid, "big")][r.token] = r.place
    size = [max(1, len(w) - 4) for w in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] != texts[j] and weighted_jaccard(texts[i], texts[j]) >= 0.8]
    assert len(linked) > 500
    for i, j in linked:
        need = 0.8 / 1.8 * (size[i] + size[j]) - 1e-9
        assert any(min(size[i] - listed[i][t], size[j] - listed[j][t]) >= need for t in listed[i].keys() & listed[j].keys())
    assert sum(map(len, listed.values())) < 0.25 * sum(size)


def test_recall_of_planted_near_copies(spark):
    """Copies of real documents with single words changed: all whose similarity is 0.8 or more are found, those below by definition not."""
    r = random.Random(3)
    docs = [(d.doc_id, words(d.text)) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(i, w) for i, w in docs if 60 <= len(w) <= 2000]
    planted = []
    for n, (i, w) in enumerate(docs):
        edited = list(w)
        for _ in range(1 + n % 8 * len(w) // 200):
            edited[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        planted.append((i, 10**6 + i, w, edited))
    rows = [(i, " ".join(w)) for i, _, w, _ in planted] + [(j, " ".join(e)) for _, j, _, e in planted]
    got = {x.doc_id: x.class_id for x in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [(weighted_jaccard(w, e) >= 0.8, got[i] == got[j]) for i, j, w, e in planted]
    near = [f for is_near, f in found if is_near]
    assert len(near) > 60 and np.mean(near) == 1.0


def test_edge_cases(spark):
    shape = "doc_id long, text string, tid string, bands string, size int, root string, bucket string"
    rows = [(1, None), (1, None), (2, ""), (3, "?!"), (4, "a b"), (5, "A, b."), (6, "x " * 50000), (7, "x " * 50001), (None, "a b"), (8, "a b c d e"), (8, "other words of the same id here")]
    frame = spark.createDataFrame([(*r, "t", "b", 1, "r", "k") for r in rows], shape)
    got = sorted(((r.doc_id, r.class_id, r.is_first) for r in neardup.classes(spark, frame).collect()), key=str)
    assert len(got) == len(rows)
    assert {c for d, c, _ in got if d in (6, 7)} == {6} and len({c for d, c, _ in got if d in (4, 5, None)}) == 1
    assert neardup.deduplicate(spark, frame).columns == frame.columns
    assert neardup.deduplicate(spark, frame).filter(F.col("doc_id") == 7).count() == 0
    assert neardup.classes(spark, frame.filter("false")).count() == 0
