"""Own encoding and decoding against the sentencepiece library."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import pieces

from .test_operators import edge_docs

POOL = "  ▁\n\t0123aebcdé́ﬁＡ中文안녕🎉👨‍👩‍👧\u0000�<0xE4><s></s> 　"


@pytest.fixture(scope="module")
def own():
    with open(pieces.default_vocabulary(), "rb") as f:
        return pieces.Vocabulary(f.read())


def strange(r, n):
    return "".join(r.choice(POOL) if r.random() < 0.8 else chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x10000, 0x10FFFF)])) for _ in range(n))


def test_encoding_is_the_library_s(own):
    r = random.Random(1)
    texts = [strange(r, r.randrange(0, 40)) for _ in range(3000)] + ["a" * 5000, " " * 777, "▁" * 50, "ab" * 4000, "thethethe" * 900]
    assert [own.encode(t) for t in texts] == own.library.encode(texts)


def test_decoding_is_the_library_s_for_any_ids(own):
    """Broken bytes, control and unknown pieces included."""
    r = random.Random(2)
    ids = [[r.choice([r.randrange(0, 262), r.randrange(0, 32000)]) for _ in range(r.randrange(0, 9))] for _ in range(5000)]
    assert [own.decode(i) for i in ids] == [own.library.decode(i) for i in ids]


def test_list_and_heap_agendas_agree(own):
    r = random.Random(3)
    for _ in range(2000):
        unit = "".join(r.choice("▁▁abcdetheinonan") for _ in range(r.randrange(1, 40)))
        assert own._listed(unit) == own._heaped(unit)


def test_kept_units_change_nothing(own, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    r = random.Random(4)
    texts = [strange(r, 30) for _ in range(300)]
    assert [own.encode(t) for t in texts] == own.library.encode(texts)
    own.kept.clear()
    assert own.encode(texts[0]) == own.library.encode(texts[0]) and len(own.kept) <= 3


def test_rows(spark, own):
    r = random.Random(5)
    rows = [(i, strange(r, 50)) for i in range(50)] + [(90, None), (91, ""), (None, "x y"), (92, "word " * 100000)]
    frame = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("y")).repartition(3)
    found = pieces.encoded(spark, frame, pieces.default_vocabulary())
    want = [(i, own.library.encode(t or ""), own.library.decode(own.library.encode(t or ""))) for i, t in rows + rows[:5]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.select(pieces.id_text(F.col("ids")).alias("t")).filter("t = ''").count() == 2 + sum(not t for _, t in rows[:50]) + sum(not t for _, t in rows[:5])
    docs = edge_docs(spark)
    assert pieces.encoded(spark, docs, pieces.default_vocabulary()).count() == 7
    assert pieces.encoded(spark, docs.filter("false"), pieces.default_vocabulary()).count() == 0


def test_a_difference_fails_with_the_row_named(own):
    import pyarrow as pa

    with pytest.raises(ValueError, match="ids of 8 differ"):
        pieces.checked(own, pa.array([7, 8]), ["a", "b"], [own.encode("a"), own.encode("c")], ["a", "b"])


def test_other_vocabularies_are_refused(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format_

    with open(pieces.default_vocabulary(), "rb") as f:
        model = format_.ModelProto.FromString(f.read())
    model.pieces[400].type = 4
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Vocabulary(model.SerializeToString())
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(model.SerializeToString())
