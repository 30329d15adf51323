"""Fill-in-the-middle transformation: texts cut into prefix, middle and suffix and put in prefix-suffix-middle or suffix-prefix-middle order.

The cuts fall between units: lines (with their newline) or code points. One numpy kernel works on the UTF-8 buffer of an Arrow batch, on all rows together:
a byte-class table marks newlines, continuation bytes and the bytes of sentinels; a mask of adjacent bytes marks where a unit ends; a running sum of that mask,
taken anew from each document's start, counts units; and a binary search in the running sum turns the chosen numbers of units into byte positions. Outputs are gathered from
the same buffer by one index array. Batches are worked on in runs of whole documents of about ``textscan.PIECE_BYTES``, which bounds the index arrays.

Whether and how a document is cut follows from the SHA-256 of its seed and id alone, so it doesn't depend on partitions or on other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import pieces

# The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = np.array(["plain", "psm", "spm"], dtype=object)
#: Classes of bytes.
OTHER, NEWLINE, CONTINUATION, OPEN, CLOSE, NAME = range(6)
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[ord("\n")] = NEWLINE
CLASS[0x80:0xC0] = CONTINUATION
CLASS[ord("<")], CLASS[ord(">")] = OPEN, CLOSE
CLASS[[ord(c) for c in "PSM"]] = NAME
_SENTINELS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), dtype=np.uint8)
#: Of each form, its segments in order: sentinels 0 to 2 (P, S, M), parts 3 to 5 (prefix, suffix, middle).
_LAYOUT = {"psm": (0, 3, 1, 4, 2, 5), "spm": (1, 4, 0, 3, 2, 5)}
_PARTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(doc_id: Column, seed: str) -> list[Column]:
    """The first four groups of eight hex digits of the SHA-256 of seed, a colon and the decimal id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _ends(body: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit ends with each byte; the last byte of a document always ends one."""
    kind = CLASS[body]
    if unit == "line":
        end = kind == NEWLINE
    else:
        end = np.ones(len(body), dtype=bool)
        end[:-1] = kind[1:] != CONTINUATION
    end[at[1:][at[1:] > at[:-1]] - 1] = True
    return end


def _marked(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each document holds a sentinel."""
    if len(body) < 3:
        return np.zeros(len(at) - 1, dtype=bool)
    kind = CLASS[body]
    start = np.flatnonzero((kind[:-2] == OPEN) & (kind[1:-1] == NAME) & (kind[2:] == CLOSE))
    doc = np.searchsorted(at, start, side="right") - 1
    out = np.zeros(len(at) - 1, dtype=bool)
    out[doc[start + 3 <= at[doc + 1]]] = True
    return out


def cut(body: np.ndarray, at: np.ndarray, h: list[np.ndarray], unit: str, rate: int, spm: int) -> pa.RecordBatch:
    """n, form, prefix_chars, middle_chars and output of the documents body[at[i]:at[i + 1]] under their draws h."""
    begin, finish = at[:-1], at[1:]
    total = np.concatenate(([0], np.cumsum(_ends(body, at, unit))))
    first = total[begin]
    n = total[finish] - first
    low, high = (f(h[0] % (n + 1), h[1] % (n + 1)) for f in (np.minimum, np.maximum))
    # Position after so many of a document's units: the first at which the running sum has that count.
    edge = [np.where(c > 0, np.searchsorted(total, first + c), begin) for c in (low, high)]
    plain = (finish == begin) | _marked(body, at) | (h[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm, 2, 1))
    chars = np.concatenate(([0], np.cumsum(CLASS[body] != CONTINUATION)))
    prefix, middle = chars[edge[0]] - chars[begin], chars[edge[1]] - chars[edge[0]]

    source = np.concatenate([body, _SENTINELS])
    starts, sizes = np.zeros((len(n), 6), dtype=np.int64), np.zeros((len(n), 6), dtype=np.int64)
    starts[:, 0], sizes[:, 0] = begin, finish - begin
    where = [np.full(len(n), len(body) + 3 * i) for i in range(3)] + [begin, edge[1], edge[0]]
    width = [np.full(len(n), 3)] * 3 + [edge[0] - begin, finish - edge[1], edge[1] - edge[0]]
    for code, name in enumerate(FORMS):
        rows = np.flatnonzero(form == code)
        for slot, segment in enumerate(_LAYOUT.get(name, ())):
            starts[rows, slot], sizes[rows, slot] = where[segment][rows], width[segment][rows]
    starts, sizes = starts.ravel(), sizes.ravel()
    after = np.cumsum(sizes)
    out = source[np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]
    offsets = np.concatenate(([0], after[5::6])).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))).cast(pa.string())
    counts = [pa.array(x, pa.int64(), mask=plain) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), *counts, text], list(_PARTS))


def transformed(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, unit: str = "line", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of docs.

    n counts the text's units ("line", or "char" for code points). rate of a hundred documents are cut, spm of a hundred of these into suffix-prefix-middle order;
    form says which: plain (output is the text; prefix_chars and middle_chars are null), psm or spm. A null text is empty; empty texts and texts that hold a
    sentinel stay plain, which keeps restored() exact. Repeated rows repeat and rows of one id and text are cut alike; a null id draws like an empty one; other
    columns are not read; an empty table stays empty.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`"), *draws(F.col(f"`{key}`"), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(i).to_numpy() for i in range(2, 6)]
            for a, b, body, at in pieces(batch.column(1)):
                found = cut(body, at, [x[a:b] for x in h], unit, rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *found.columns], [key, *_PARTS])

    return rows.mapInArrow(run, f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: a text that was cut holds no sentinel of its own, so the three of the output part it. Null for a null output."""
    part = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
