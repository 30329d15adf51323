"""Benchmark decontamination by winnowing.

Every text is fingerprinted by winnowing: of each run of ``WINDOW`` consecutive k-gram hashes (k = ``GRAM`` words)
the least is kept, so any shared span of GRAM + WINDOW - 1 = ``SPAN`` words leaves a common fingerprint. Fingerprints of documents and of
benchmark items meet in an equi-join, and every hit is extended over the words around it: all SPAN-word windows that cover the
hit are compared, word by word, with the items' windows (an equi-join on the window's hash and text). An item of fewer than SPAN words is one window;
its own length serves as k for it, and every k-gram of that length is a fingerprint.

The document pass is Arrow-based and carries no text on: it drops fingerprints that miss a bitmap of the items' fingerprints. The bitmap has 16 bits for
each fingerprint, rounded up to a power of two, between 2**LEAST_BITS (512 KiB) and 2**MOST_BITS (16 MiB) bits, so it lets one in 16 to 32 misses through up to eight
million fingerprints and more beyond, never too few; the joins decide. Both joins are ordinary equi-joins, so Spark chooses broadcast or shuffle from
the measured sizes and splits a very common passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise
from .textscan import U64, kgrams, pieces, scan, within

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
LEAST_BITS, MOST_BITS = 22, 27
_MOST = U64(0xFFFFFFFFFFFFFFFF)


def winnow(g: np.ndarray, valid: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mask of the positions that hold the minimum of some run of window hashes (ties all kept)."""
    if not len(g):
        return np.zeros(0, dtype=bool)
    x = np.where(valid, g, _MOST)
    pad = np.full(window - 1, _MOST, dtype=U64)
    n = len(x) + window - 1
    wide = np.concatenate((pad, x, pad))
    least = wide[:n].copy()  # least[i]: of x[i-window+1 .. i]
    for j in range(1, window):
        np.minimum(least, wide[j : j + n], out=least)
    top = least[: len(x)].copy()
    for j in range(1, window):
        np.maximum(top, least[j : j + len(x)], out=top)
    return (top == x) & valid


def fingerprints(h: np.ndarray, first: np.ndarray, short: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words covered, starts, hashes): winnowed GRAM-grams, then every k-gram of each short length."""
    g, valid = kgrams(h, GRAM), within(first, GRAM, len(h))
    at = np.flatnonzero(winnow(g, valid))
    yield GRAM, at, g[at]
    for k in short:
        g = kgrams(h, k)
        at = np.flatnonzero(within(first, k, len(h)))
        yield k, at, g[at]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item: its windows (text, length) and its fingerprints (hash, words covered)."""
    for batch in batches:
        for a, b, body, offsets in pieces(batch.column("text")):
            words = scan(body, offsets)
            h, first = words.hashes(), words.first
            for i in range(b - a):
                p, q = int(first[i]), int(first[i + 1])
                if p == q:
                    continue
                span = min(SPAN, q - p)
                short = () if span == SPAN else (span,)
                prints = [(int(v), k) for k, _, hs in fingerprints(h[p:q], np.array([0, q - p]), short) for v in hs.view(np.int64) if short == () or k == span]
                yield pa.RecordBatch.from_pylist(
                    [{"item_id": batch.column("item_id")[a + i].as_py(), "span": span, "windows": [words.text(j, j + span) for j in range(p, q - span + 1)], "prints": [{"fp": v, "k": k} for v, k in prints]}],
                    schema=pa.schema([("item_id", batch.schema.field("item_id").type), ("span", pa.int32()), ("windows", pa.list_(pa.string())), ("prints", pa.list_(pa.struct([("fp", pa.int64()), ("k", pa.int32())])))]),
                )


def benchmark_index(spark: SparkSession, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints (fp, k), windows (window, span, items)) of bench(item_id, text)."""
    kind = bench.schema["item_id"].dataType.simpleString()
    shape = f"item_id {kind}, span int, windows array<string>, prints array<struct<fp: bigint, k: int>>"
    items = materialise(spark, bench.select("item_id", "text").mapInArrow(_items, shape))
    prints = items.select(F.explode("prints").alias("p")).select("p.fp", "p.k").distinct()
    windows = items.select("item_id", "span", F.explode("windows").alias("window")).groupBy("window", "span").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return prints, windows


def _bitmap(prints: DataFrame) -> np.ndarray:
    """The fingerprints' bits in 64-bit cells; at most 2**MOST_BITS / 64 rows reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * prints.count() - 1).bit_length()))
    bit = prints.select(F.col("fp").bitwiseAND((1 << bits) - 1).alias("b"))
    cells = bit.select(F.shiftright("b", 6).alias("cell"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v")).groupBy("cell").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    return out


def hits(spark: SparkSession, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, xh (xxhash64 of the text), n_words, spans (array of start, length of hit windows), items (ids as text).

    Null and wordless texts have no words and no hits; null or wordless items have no windows; an empty benchmark hits nothing. Repeated
    rows (equal doc_id and text) repeat. Rows of equal doc_id and different text stay apart.
    """
    prints, windows = benchmark_index(spark, bench)
    bits = spark.sparkContext.broadcast(_bitmap(prints))
    short = tuple(sorted(r.k for r in prints.filter(F.col("k") != GRAM).select("k").distinct().collect()))
    five = bool(windows.filter(F.col("span") == GRAM).limit(1).count())
    lengths = tuple(sorted({*short, *([GRAM] if five else [])}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value.view(U64)
        for batch in batches:
            for a, b, body, offsets in pieces(batch.column("text")):
                words = scan(body, offsets)
                h, first = words.hashes(), words.first
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for n, (k, at, g) in enumerate(fingerprints(h, first, lengths)):
                    low = g & U64(64 * len(table) - 1)
                    in_map = (table[(low >> U64(6)).astype(np.int64)] >> (low & U64(63))) & U64(1) == 1
                    at, g = at[in_map], g[in_map].view(np.int64)
                    doc = np.searchsorted(first, at, side="right") - 1
                    for p, v, d in zip(at.tolist(), g.tolist(), doc.tolist(), strict=True):
                        lo, hi = (max(int(first[d]), p - (SPAN - GRAM)), min(int(first[d + 1]), p + SPAN)) if n == 0 else (p, p + k)
                        found[d].append({"fp": v, "k": k, "span": SPAN if n == 0 else k, "at": lo - int(first[d]), "around": words.text(lo, hi)})
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in ("rid", "doc_id", "xh")),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(found, pa.list_(pa.struct([("fp", pa.int64()), ("k", pa.int32()), ("span", pa.int32()), ("at", pa.int32()), ("around", pa.string())]))),
                    ],
                    ["rid", "doc_id", "xh", "n_words", "found"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("xh"), "text")
    scanned = rows.mapInArrow(run, f"rid bigint, doc_id {kind}, xh bigint, n_words bigint, found array<struct<fp: bigint, k: int, span: int, at: int, around: string>>")
    # A row without a candidate keeps a key of its own, which joins nothing and spreads evenly.
    none = F.xxhash64("rid")
    met = (
        scanned.withColumn("f", F.explode_outer("found"))
        .select("rid", "doc_id", "xh", "n_words", F.coalesce("f.fp", none).alias("fp"), F.coalesce("f.k", F.lit(0)).alias("k"), "f.span", "f.at", "f.around")
        .join(prints.withColumn("hit", F.lit(True)), ["fp", "k"], "left")
    )
    word = F.split("around", " ")
    starts = F.when(F.col("hit") & (F.size(word) >= F.col("span")), F.transform(F.sequence(F.lit(0), F.size(word) - F.col("span")), lambda i: F.struct((F.col("at") + i).alias("start"), F.array_join(F.slice(word, i + 1, F.col("span")), " ").alias("window"))))
    tried = met.withColumn("w", F.explode_outer(starts)).select("rid", "doc_id", "xh", "n_words", "w.start", F.coalesce("w.window", F.concat(F.lit("\x00"), none.cast("string"))).alias("window"), F.coalesce("span", F.lit(0)).alias("span")).distinct()
    proved = tried.join(windows, ["window", "span"], "left")
    placed = F.when(F.col("items").isNotNull(), F.struct(F.col("start"), F.col("span").alias("length")))
    return proved.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("xh").alias("xh"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(placed)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).drop("rid")


def covered(spans: F.Column) -> F.Column:
    """Number of words inside sorted (start, length) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: F.Column, s: F.Column) -> F.Column:
        end = (s["start"] + s["length"]).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], s["start"].cast("long")))).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def report(spark: SparkSession, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """hits() with n_hit (words inside hit windows), one row for each row of docs."""
    found = hits(spark, docs, bench).withColumn("n_hit", covered(F.col("spans")))
    return found


def decontaminate(spark: SparkSession, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs without any hit; all columns."""
    bad = report(spark, docs, bench).filter("n_hit > 0").select(F.col("doc_id").alias("d"), F.col("xh").alias("x"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("xh"))
    return named.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")), "left_anti").select("row.*")
