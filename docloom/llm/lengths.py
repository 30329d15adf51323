"""Exact token-length histogram.

Every whole text is encoded once with a public byte-level BPE vocabulary; documents are aggregated by encoded length before the shuffle. The
histogram (one row per distinct length) answers everything else through suffix sums: documents and tokens beyond a limit,
tokens left after truncating every document at it, and quantiles. Suffix sums run in two levels, by blocks of ``BLOCK`` lengths and then within a block, so no task
sees more than BLOCK rows or one row per block.

Texts are cut as PATTERN cuts them in a few numpy passes over their bytes. A worker keeps the number of tokens of each cut part of at most ``PACKED`` bytes in a
table of ``SLOTS`` slots, where a part is compared byte by byte; only parts that it doesn't hold are encoded.

The vocabulary file's path is a parameter; the driver reads it (a fixed, checked size) and sends its bytes to the executors once.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise
from .textscan import U64, mix
from .textscan import pieces as slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 16 << 20
BLOCK = 4096
#: Bytes of a part that fit a slot (15 and their number), and slots of 16 bytes of a worker's table.
PACKED, SLOTS = 15, 1 << 22
# Fixed value: how that vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(raw: bytes):
    """A tiktoken encoding without special tokens: their strings are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Classes of PATTERN; OPEN stands for code points that Python's tables don't assign, whose texts are encoded whole.
SPACE, LETTER, NUMBER, OTHER, OPEN = range(5)
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    named = {"L": LETTER, "N": NUMBER}
    kinds = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
    out = np.fromiter((OPEN if k in ("Cn", "Cs") else named.get(k[0], OTHER) for k in kinds), dtype=np.uint8, count=sys.maxunicode + 1)
    out[list(_SPACES)] = SPACE
    return out


def _classed(body: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of every byte of valid UTF-8: that of its character."""
    out = table[:256][body]
    lead = np.flatnonzero(body >= 0xC0)
    if lead.size:
        first = body[lead].astype(np.int32)
        code = np.where(first >= 0xF0, first & 0x07, np.where(first >= 0xE0, first & 0x0F, first & 0x1F))
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        for i in (1, 2, 3):
            has = more >= i
            code[has] = code[has] << 6 | (body[lead[has] + i] & 0x3F)
        kind = table[code]
        for i in range(4):
            has = more >= i
            out[lead[has] + i] = kind[has]
    return out


def cut(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the parts start that PATTERN cuts texts of valid UTF-8 into; kind is the class of every byte."""
    n = len(body)
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[offsets] = True
    text_end = np.zeros(n + 1, dtype=bool)
    text_end[offsets] = True
    run = np.flatnonzero(start)
    begin, end = run[:-1], run[1:]
    # Before another character, the last blank of a run stands alone, or leads the next part if it is a space.
    blank = (kind[begin] == SPACE) & ~text_end[end]
    last = end[blank] - 1
    while (inside := (body[last] & 0xC0) == 0x80).any():
        last = last - inside
    start[last] = True
    start[end[blank][body[last] == 0x20]] = False
    # A part that starts with an apostrophe before a letter may be a contraction.
    mark = begin[(body[begin] == 0x27) & (end - begin == 1)]
    mark = mark[start[mark] & ~text_end[mark + 1]]
    mark = mark[kind[mark + 1] == LETTER]
    one = mark[np.isin(body[mark + 1], np.frombuffer(b"stmd", dtype=np.uint8))]
    two = mark[~text_end[mark + 2]]
    x, y = body[two + 1], body[two + 2]
    two = two[((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)]
    start[one + 1] = start[two + 1] = False
    start[one + 2] = start[two + 3] = True
    return np.flatnonzero(start[:n])


class Counter:
    """Numbers of tokens of whole texts. A slot holds a part's bytes, its size (4 bits) and its number of tokens (4 bits)."""

    def __init__(self, raw: bytes):
        self.encode = encoder(raw).encode_ordinary
        self.slots = np.zeros((SLOTS, 2), dtype=U64)

    def counts(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text of consecutive ones."""
        body.tobytes().decode()  # fails for what is no UTF-8
        kind = _classed(body, _classes())
        begin = cut(body, offsets, kind) if len(body) else np.zeros(0, dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(self._parts(body, begin))))
        out = np.diff(total[np.searchsorted(begin, offsets)])
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(kind == OPEN), side="right") - 1):
            out[i] = len(self.encode(body[offsets[i] : offsets[i + 1]].tobytes().decode()))
        return out

    def _parts(self, body: np.ndarray, begin: np.ndarray) -> np.ndarray:
        size = np.diff(np.append(begin, len(body)))
        out = np.zeros(len(begin), dtype=np.int64)
        short = np.minimum(size, PACKED)
        padded = np.concatenate((body, np.zeros(16, dtype=np.uint8)))
        word = np.ndarray((len(body) + 8,), dtype="<u8", buffer=padded, strides=(1,))
        low = word[begin] & _KEEP[np.minimum(short, 8)]
        high = word[np.minimum(begin + 8, len(body))] & _KEEP[np.maximum(short - 8, 0)] | size.astype(U64) << U64(56)
        at = (mix(low ^ mix(high)) & U64(SLOTS - 1)).astype(np.int64)
        held = self.slots[at]
        out[:] = held[:, 1] >> U64(60)
        new = np.flatnonzero((held[:, 0] != low) | (held[:, 1] & U64((1 << 60) - 1) != high) | (size > PACKED))
        known: dict[bytes, int] = {}
        raw = body.tobytes()
        for i, a, b in zip(new.tolist(), begin[new].tolist(), (begin + size)[new].tolist(), strict=True):
            part = raw[a:b]
            n = known.get(part)
            if n is None:
                n = known[part] = len(self.encode(part.decode()))
            out[i] = n
        new = new[size[new] <= PACKED]
        # Whole rows are put, one after another, so a slot never mixes two parts.
        self.slots[at[new]] = np.stack((low[new], high[new] | out[new].astype(U64) << U64(60)), axis=1)
        return out


@lru_cache(maxsize=1)
def counter(raw: bytes) -> Counter:
    """The counter of a worker, with the parts it holds."""
    return Counter(raw)


def measure(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Gives the numbers of tokens of consecutive texts from their bytes and offsets, in tasks."""
    if os.path.getsize(vocabulary) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to send to executors")
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    return lambda body, offsets: counter(raw.value).counts(body, offsets)


def encoded_lengths(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens) and the columns keep of every row of docs(doc_id, text); null and empty texts have 0 tokens, repeated rows repeat."""
    count = measure(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(body, offsets) for _, _, body, offsets in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*n, np.zeros(0, dtype=np.int64)])), *batch.columns[2:]], ["doc_id", "n_tokens", *keep])

    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *keep)}
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id {kind['doc_id']}, n_tokens bigint" + "".join(f", {c} {kind[c]}" for c in keep))


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct n_tokens with its number of documents."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def answers(counts: DataFrame) -> DataFrame:
    """For every distinct length taken as context limit: documents and tokens above it, tokens kept and lost by truncation, rank.

    Columns: n_tokens (the limit), n_docs, total_docs, total_tokens, docs_longer, tokens_longer (whole lengths of the longer ones),
    kept_tokens (sum of min(length, limit)), lost_tokens, quantile (share of documents of at most the limit). An empty table gives no rows.
    The histogram is written once, so the texts behind it are encoded once.
    """
    counts = materialise(counts.sparkSession, counts)
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    up = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_above") for c in ("d", "t")], F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    above = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    part = rows.select("block", "n_tokens", "n_docs", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(n) for c, n in (("n_docs", "d_in"), ("tokens", "t_in"))])
    out = part.join(blocks, "block").withColumn("docs_longer", F.col("d_in") + F.col("d_above")).withColumn("tokens_longer", F.col("t_in") + F.col("t_above"))
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "total_docs", "total_tokens", "docs_longer", "tokens_longer", kept.alias("kept_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"), ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"))


def truncated(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, kept_tokens, docs_longer) for any limits, in one aggregation of the histogram; zeros for an empty table."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    sums = [F.struct(F.lit(x).cast("long").alias("limit"), F.coalesce(F.sum(F.least(n, F.lit(x)) * d), F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(F.when(n > x, d)), F.lit(0)).alias("docs_longer")) for x in limits]
    return counts.agg(F.array(*sums).alias("a")).select(F.inline("a"))
