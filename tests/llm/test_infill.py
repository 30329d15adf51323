"""Fill-in-the-middle against a plain version, text by text, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import infill

from .test_operators import edge_docs


def plain(doc_id, text, seed, rate, spm, unit):
    text = text or ""
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(parts), "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    r = random.Random(3)
    pool = ["\n", "\n", "a", "é", "中", "🎉", "\r", " ", "<", "P", "S", ">", "x ", "\x00"]
    rows = [(i, "".join(r.choice(pool) for _ in range(r.randrange(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "one line"), (1004, "a<P>b"), (1005, "a<M"), (1006, ">b"), (1007, "<S>"), (None, "x\ny\nz"), (-5, "q\n" * 9)]
    return rows + rows[:20] + [(1100, "long line\n" * 200000), (1101, "ö" * 300000)]


@pytest.mark.parametrize(("seed", "rate", "spm", "unit"), [("7", 100, 50, "line"), ("x", 60, 20, "char")])
def test_against_a_plain_version(spark, seed, rate, spm, unit):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("output", F.lit("y")).repartition(3)
    got = infill.transformed(frame, seed, rate, spm, unit).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain(i, t, seed, rate, spm, unit), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {"plain", "psm", "spm"} <= {r.form for r in got}


def test_edges(spark):
    docs = edge_docs(spark)
    assert infill.transformed(docs).count() == 7
    assert infill.transformed(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        infill.transformed(docs, unit="word")


def test_documents_do_not_run_into_each_other(spark):
    """A sentinel or a line that would only arise between two documents of a batch is none."""
    rows = [(1, "<"), (2, "P>"), (3, "a"), (4, "\nb"), (5, "<S"), (6, ">")]
    got = {r.doc_id: (r.n, r.form) for r in infill.transformed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert {i: n for i, (n, _) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1} and all(f != "plain" for _, f in got.values())
