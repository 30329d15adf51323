"""Conflict-constrained best-fit packing of documents into fixed contexts.

A document of more than ``capacity`` tokens is cut into full pieces and a rest, so nothing is lost; every piece is an
item. Items go, longest first, into the open bin with the least residual that holds them and does not conflict. Two
items conflict if they share a source or a duplicate cluster (pieces of one document share both, so they never meet). Bins are kept in one list ordered by (residual, number); each carries a
bitmap of its sources and one of its clusters. The search starts at the first bin whose residual is large enough and
goes on to its successors until a compatible one is found, which is the tightest; if there is none, a bin is opened.

Packing is sequential, so items are dealt by a hash of the document into shards of about ``SHARD_ITEMS`` items; a shard is packed by one task in bounded
memory. The number of shards follows the input; a hot source or cluster is spread over all of them. Bins never cross shards, which costs
one partly filled tail per shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup
from .lengths import encoded_lengths, measure
from .shared import materialise

CAPACITY = 2048
SHARD_ITEMS = 4096


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Places an item; source and cluster are one-bit masks (0: none). Returns (bin, offset in it)."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, name = self.order[at]
            if not (self.sources[name] & source or self.clusters[name] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            residual, name = self.capacity, self.count
            self.count += 1
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[name] |= source
        self.clusters[name] |= cluster
        if residual > length:
            insort(self.order, (residual - length, name))
        return name, self.capacity - residual


def pack_shard(length: list[int], source: list[str | None], cluster: list[str | None], start: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, placed longest first; ties by cluster, start and source."""
    bits: list[dict[str, int]] = [{}, {}]

    def mask(kind: int, value: str | None) -> int:
        return 0 if value is None else 1 << bits[kind].setdefault(value, len(bits[kind]))

    order = sorted(range(len(length)), key=lambda i: (-length[i], cluster[i] or "", start[i], source[i] or "", i))
    bins, out = Bins(capacity), [(0, 0)] * len(length)
    for i in order:
        out[i] = bins.put(length[i], mask(0, source[i]), mask(1, cluster[i]))
    return out


def n_tokens(text: F.Column) -> F.Column:
    """A length without a vocabulary, not that of an encoded text: runs of letters and digits, and every other visible character, count one each."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: F.Column | None = None, source: F.Column | None = None, cluster: F.Column | None = None, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id (shard:number), offset: where each piece of docs(doc_id, text, source) goes.

    A text without tokens (null, empty) is one piece of 0 tokens with bin and offset null. A null source or cluster conflicts with
    nothing. Without a length it is n_tokens(text), which is not what a model reads; pack_encoded packs encoded lengths. By default the cluster is a hash of the text. Repeated rows are separate items. An empty table gives no rows.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (n_tokens(text) if length is None else length).cast("long").alias("n"),
        (F.col("source") if source is None else source).cast("string").alias("source"),
        (F.when(text.isNotNull(), F.xxhash64(text)) if cluster is None else cluster).cast("string").alias("cluster"),
    )
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / capacity).cast("long") - 1)
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("piece") * capacity)
    items = cut.select("doc_id", "piece", "start", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")).alias("n_tokens"), "source", "cluster")
    count = rows.agg(F.sum(F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / capacity).cast("long")))).first()[0] or 0
    shards = max(1, round(count / shard_items))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "source", "cluster")])
        length = group.column("n_tokens").to_pylist()
        full = [i for i, n in enumerate(length) if n > 0]
        item = {c: group.column(c).to_pylist() for c in ("source", "cluster", "start")}
        placed = pack_shard([length[i] for i in full], *([item[c][i] for i in full] for c in ("source", "cluster", "start")), capacity)
        name, offset = [None] * len(length), [None] * len(length)
        for i, (number, at) in zip(full, placed, strict=True):
            name[i], offset[i] = f"{key[0].as_py()}:{number}", at
        return group.select(["doc_id", "piece", "start", "n_tokens"]).append_column("bin_id", pa.array(name, pa.string())).append_column("offset", pa.array(offset, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece bigint, start bigint, n_tokens bigint, bin_id string, offset bigint")


def pack_encoded(spark: SparkSession, docs: DataFrame, clusters: DataFrame | None = None, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """pack() by the encoded length of every whole text; every text is encoded once. start, n_tokens and offset count encoded tokens.

    clusters(doc_id, xh, class_id) are near-duplicate classes as neardup.classes gives them. Without them a cluster is only equal texts, which
    is enough where docs are deduplicated already. Texts without words and rows of a null doc_id keep the text's hash.
    """
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("xh"), F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]").alias("worded"))
    known = materialise(spark, encoded_lengths(spark, rows, keep=("source", "xh", "worded")))
    cluster = F.col("xh").cast("string")
    if clusters is not None:
        named = clusters.filter("doc_id is not null").select(F.col("doc_id").alias("d"), F.col("xh").alias("x"), F.col("class_id").cast("string").alias("class")).distinct()
        known = materialise(spark, known.join(named, (F.col("doc_id") == F.col("d")) & (F.col("xh") == F.col("x")), "left").drop("d", "x"))
        cluster = F.coalesce(F.when(F.col("worded"), F.concat(F.lit("class "), "class")), cluster)
    return pack(known, F.col("n_tokens"), F.col("source"), cluster, capacity, shard_items)


def pack_classed(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """pack_encoded() by the near-duplicate classes of docs, whose texts are read once for signatures and lengths. The rows are the same."""
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    known = materialise(spark, neardup.classes(spark, rows, keep=("source",), measure=measure(spark)))
    # A null text has the hash of no text.
    text = F.when(F.col("worded") | (F.col("xh") != F.xxhash64(F.lit(None).cast("string"))), F.col("xh")).cast("string")
    cluster = F.coalesce(F.when(F.col("worded") & F.col("doc_id").isNotNull(), F.concat(F.lit("class "), F.col("class_id").cast("string"))), text)
    return pack(known, F.col("measure"), F.col("source"), cluster, capacity, shard_items)
