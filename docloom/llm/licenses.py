"""License scan by diagonal voting, in DataFrame expressions only.

All rolling three-word grams of every whole text meet the grams of the licence templates in an equi-join on their 64-bit hash,
proved on the words themselves. A match of document word p with template word t votes for the diagonal p - t. Votes are
summed by (document, template, diagonal). For whole licence texts (``license_texts.BODIES``) diagonals at most ``SLACK`` apart are merged into one span, so inserted, lost or
replaced words don't split it, and a span is verified on the template's words that its votes cover, each counted once: they must be ``COVERAGE`` of
them, on not much more of the document than the template is long. Notices and phrases (``license_texts.NOTICES``, ``PHRASES``) count word for word:
every gram of theirs on one diagonal, which is an exact occurrence, since every vote is an exact match of three words.

The template table is fixed here and small (some two thousand grams), so it is broadcast; the documents are read once, and only matches and
one row per document reach the single shuffle, on the document's row id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import BODIES, NOTICES

GRAM = 3
SLACK = 8
COVERAGE = 0.8

# Phrases that count where their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE, NOTICE, BODY = "base", "notice", "body"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_rows() -> list[tuple]:
    """(template, label, kind, size in words, position, w0, w1, w2) of every template gram."""
    rows = []
    templates = [*((label, text, BASE) for text, label in PHRASES.items()), *((label, text, NOTICE) for label, text in NOTICES), *((label, text, BODY) for label, text in BODIES)]
    for number, (label, text, kind) in enumerate(templates):
        w = _WORD.findall(text.translate(str.maketrans(_UPPER, _LOWER)))
        rows += [(number, label, kind, len(w), i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    return rows


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, spans (array of label, base, start, end, coverage) of accepted spans, best (coverage of the best span, accepted or not).

    Null, empty and wordless texts have no words and no spans. Repeated rows repeat; ties of spans stay side by side.
    """
    shape = "template int, label string, kind string, size int, position int, t0 string, t1 string, t2 string"
    grams = F.broadcast(spark.createDataFrame(template_rows(), shape).withColumn("g", F.xxhash64("t0", "t1", "t2")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")
    rolled = rows.select("rid", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(n, F.lit(1))).alias("c"))).alias("p", "x"))
    rolled = rolled.select("rid", "doc_id", "n_words", "p", F.col("x.a").alias("w0"), F.col("x.b").alias("w1"), F.col("x.c").alias("w2"))
    met = rolled.join(grams, (F.xxhash64("w0", "w1", "w2") == F.col("g")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    kept = met.filter(F.col("template").isNotNull() | F.coalesce(F.col("p") == 0, F.lit(True))).select("rid", "doc_id", "n_words", "template", "label", "kind", "size", (F.col("p") - F.col("position")).cast("long").alias("diagonal"), "position").repartition("rid")
    keys = ["rid", "doc_id", "n_words", "template", "label", "kind", "size"]
    # A template's positions on one diagonal are distinct and no more than the template has.
    voted = kept.groupBy(*keys, "diagonal").agg(F.collect_set("position").alias("at"))
    side = Window.partitionBy("rid", "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(side) <= SLACK) & (F.col("kind") == BODY)
    island = F.sum(F.when(near, 0).otherwise(1)).over(side.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = voted.withColumn("island", island).groupBy(*keys, "island").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("start"), (F.max(F.col("diagonal") + F.array_max("at")) + GRAM).alias("end")
    )
    words_met = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + GRAM - 1))))
    share = F.when(F.col("kind") == BODY, F.size(words_met) / F.col("size")).otherwise(F.size("at") / (F.col("size") - GRAM + 1))
    longest = F.col("size") * (2 - COVERAGE) + SLACK
    accepted = F.when(F.col("kind") == BODY, (share >= COVERAGE) & (F.col("end") - F.col("start") <= longest)).otherwise(share == 1.0)
    merged = merged.withColumn("share", F.when(F.col("template").isNotNull(), share))
    span = F.when(F.col("template").isNotNull() & accepted, F.struct("label", (F.col("kind") == BASE).alias("base"), "start", "end", F.col("share").alias("coverage")))
    out = merged.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"), F.coalesce(F.max("share"), F.lit(0.0)).alias("best"))
    return out.drop("rid")


def digest(found: DataFrame) -> DataFrame:
    """scan() as one line per document: counts, places and labels."""
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.col("best").alias("score"))
