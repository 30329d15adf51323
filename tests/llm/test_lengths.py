"""Counted tokens against the library, and packing that reads the texts once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import lengths, neardup, packing
from docloom.llm.textscan import pieces

from .test_neardup import hot_texts

POOL = " '  \n\t\r 　strevmldSTxé1２½.!?-…\x00\x1c​中я’\U0001d7d8🎉͸"


@pytest.fixture(scope="module")
def raw():
    with open(lengths.VOCABULARY, "rb") as f:
        return f.read()


def counted(own, texts):
    return np.concatenate([own.counts(body, at) for _, _, body, at in pieces(pa.array(texts, pa.string()))]).tolist()


def test_counts_are_the_library_s(raw, monkeypatch):
    """With few slots too, where parts displace one another."""
    r = random.Random(1)
    texts = ["".join(r.choice(POOL) for _ in range(r.randrange(0, 40))) for _ in range(20000)] + [None, "", "'s", "x'", "a" * 5000, " " * 777, "\n" * 9 + "b", "it's they're 'tis ''s  'll"]
    encode = lengths.encoder(raw).encode_ordinary
    want = [len(encode(t or "")) for t in texts]
    assert counted(lengths.Counter(raw), texts) == want
    monkeypatch.setattr(lengths, "SLOTS", 8)
    own = lengths.Counter(raw)
    assert counted(own, texts[:3000]) == want[:3000] and counted(own, texts[:3000]) == want[:3000]


def test_every_character_is_cut_as_the_library_cuts(raw):
    own, encode = lengths.Counter(raw), lengths.encoder(raw).encode_ordinary
    texts = [f"a{c}1{c} {c}!{c}  {c}a'{c}{c}" for c in map(chr, range(0x3100)) if c.isprintable() or ord(c) < 0x2100]
    assert counted(own, texts) == [len(encode(t)) for t in texts]


def test_what_is_no_text_fails(raw):
    with pytest.raises(UnicodeDecodeError):
        lengths.Counter(raw).counts(np.frombuffer(b"a\xff", dtype=np.uint8), np.array([0, 2]))


def test_packing_by_classes_reads_texts_once(spark):
    rows = [(i, " ".join(w), f"s{i % 7}") for i, w in enumerate(hot_texts())]
    rows += [(900, None, "s1"), (901, "", None), (902, "?!", "s2"), (903, "?!", "s3"), (None, "no id here", "s1"), (None, None, None), (904, "word " * 5000, "s1"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack_classed(spark, docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, packing.pack_encoded(spark, docs, neardup.classes(spark, docs)).collect()), key=str)
    assert packing.pack_classed(spark, docs.filter("false")).count() == 0


def test_only_undecided_texts_reach_the_third_pass(spark, monkeypatch):
    """Of a small bucket both texts of a close pair that was not verified; of a large one all; classes are the same for any bound."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    sketch = ", ".join(f"{c} long" for c in neardup.SKETCH)
    far = [-1] * len(neardup.SKETCH)
    near = [0] * len(neardup.SKETCH)
    rows = [(1, b"a", b"a", 9, *near, 3), (1, b"b", b"b", 9, *near, 3), (1, b"c", b"c", 9, *far, 3), (2, b"a", b"a", 9, *near, 2), (2, b"d", b"d", 9, *near, 2)]
    rows += [(3, x, x, 9, *far, 4) for x in (b"w", b"x", b"y", b"z")]
    placed = spark.createDataFrame(rows, f"bucket long, tid binary, root binary, size long, {sketch}, n long")
    tested = spark.createDataFrame([(b"a", b"d")], "a binary, b binary")
    assert {bytes(r.tid) for r in neardup._undecided(placed, tested).collect()} == {b"a", b"b", b"w", b"x", b"y", b"z"}
    texts = hot_texts()
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    some = {r.doc_id: r.class_id for r in neardup.classes(spark, frame).collect()}
    monkeypatch.setattr(neardup, "SMALL", 1 << 30)
    assert some == {r.doc_id: r.class_id for r in neardup.classes(spark, frame).collect()}


def test_thinned_keeps_every_key(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BITS", 1 << 10)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 7).alias("xh"))
    keys = rows.filter("doc_id % 100 = 0").unionByName(spark.createDataFrame([(None, 3)], "doc_id long, xh long"))
    left = neardup._thinned(spark, rows.unionByName(keys.filter("doc_id is null")), keys, ["doc_id", "xh"])
    assert left.join(keys, "xh").count() == 51 and left.count() < 1000
