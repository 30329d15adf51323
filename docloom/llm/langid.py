"""Language identification with a string kernel.

The blended-spectrum kernel of two texts counts the character n-grams (orders 1 to 4, over lower-cased UTF-8
with every run of non-letters as one blank) present in both, scaled by the geometric mean of the two counts. The
Nystroem method maps a text to its kernel values against a fixed set of landmark texts, whitened by the landmarks'
own kernel matrix; one kernel ridge regression per language (one-versus-rest) is fitted on that map in closed form.
Presence vectors are hashed into ``BUCKETS`` columns, so scoring a batch is three matrix products.

Training reads at most ``per_lang`` texts of each of the ``max_langs`` most frequent languages (a bounded sample, chosen by a hash of the document id);
their presence vectors are computed on the executors and packed to ``BUCKETS / 8`` bytes each, which bounds what
reaches the driver: languages x per_lang x 2 KiB, some 210 MB at most and three times that while they are put in order; the fit keeps sums over blocks of them. Languages
beyond the bound are counted in the log. Prediction covers every row and its whole text, in one pass without
a shuffle.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, sampled
from .textscan import LOWER, U64, utf8

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
PER_LANG = 400
MAX_LANGS = 256
LANDMARKS = 160
RIDGE = 0.05
#: Rows that are unpacked at a time when fitting.
BLOCK = 1024
UND = "und"

_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_FOLD = np.where(_LETTER, LOWER, 32).astype(np.uint8)
_ASCII_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))


def presence(body: np.ndarray, row: np.ndarray) -> None:
    """Marks in row (BUCKETS entries) the n-grams of one text."""
    x = _FOLD[body]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = np.concatenate(([32], x[keep], [32])).astype(np.uint32)
    h = np.zeros(len(x), dtype=np.uint32)
    for n in ORDERS:
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        row[(h ^ (h >> np.uint32(15))) >> np.uint32(18) & np.uint32(BUCKETS - 1)] = 1


def has_letter(body: np.ndarray) -> bool:
    if _ASCII_LETTER[body].any():
        return True
    return bool((body >= 128).any()) and any(c.isalpha() for c in body.tobytes().decode("utf-8", "replace"))


def vectors(column: pa.Array, size: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, presence matrix, letter mask) of runs of documents."""
    body, at = utf8(column)
    for a in range(0, len(at) - 1, size):
        b = min(len(at) - 1, a + size)
        x, letters = np.zeros((b - a, BUCKETS), dtype=np.uint8), np.zeros(b - a, dtype=bool)
        for i in range(a, b):
            one = body[at[i] : at[i + 1]]
            letters[i - a] = has_letter(one)
            if letters[i - a]:
                presence(one, x[i - a])
        yield a, b, x, letters


class Model:
    """Landmark presence vectors (landmarks x BUCKETS), whitening times regression weights (landmarks x languages)."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.landmarks, self.weights, self.bias = langs, landmarks, weights, bias
        self.scale = 1 / np.sqrt(np.maximum(landmarks.sum(axis=1, dtype=np.float32), 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float32)
        k = (f @ self.landmarks.T.astype(np.float32)) * self.scale / np.sqrt(np.maximum(f.sum(axis=1), 1))[:, None]
        return k @ self.weights + self.bias


def fit(x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, packed: bool = False) -> Model:
    """Nystroem map and one-versus-rest kernel ridge regression on presence rows x (packed: eight a byte) with languages y.

    Rows are unpacked BLOCK at a time, and only sums over them are kept, so memory is that of x and of landmarks x BUCKETS numbers, however many rows there are.
    """
    langs = sorted(set(y))
    if not langs:
        return Model([], np.zeros((1, BUCKETS), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    label = np.searchsorted(np.array(langs, dtype=object), np.array(y, dtype=object))
    by_lang = [list(np.flatnonzero(label == c)) for c in range(len(langs))]
    turn = [i for group in zip(*(g + [None] * (max(map(len, by_lang)) - len(g)) for g in by_lang), strict=True) for i in group if i is not None]
    rows = lambda at: (np.unpackbits(x[at], axis=1) if packed else x[at]).astype(np.float32)
    norm = lambda a: np.sqrt(np.maximum(a.sum(axis=1), 1))
    chosen = rows(turn[: max(landmarks, len(langs))])
    size = norm(chosen)
    value, vector = np.linalg.eigh(((chosen @ chosen.T) / size[:, None] / size).astype(np.float64))
    sound = value > 1e-6 * value[-1]
    white = vector[:, sound] / np.sqrt(value[sound])
    weight = 1 / np.bincount(label, minlength=len(langs))[label]
    weight *= len(label) / weight.sum()
    n = white.shape[1]
    zz, zt, mean_z, mean_t = np.zeros((n, n)), np.zeros((n, len(langs))), np.zeros(n), np.zeros(len(langs))
    for a in range(0, len(label), BLOCK):
        f, w = rows(slice(a, a + BLOCK)), weight[a : a + BLOCK]
        z = ((f @ chosen.T) / norm(f)[:, None] / size).astype(np.float64) @ white
        t = np.where(label[a : a + BLOCK, None] == np.arange(len(langs)), 1.0, 0.0)
        zz += (z * w[:, None]).T @ z
        zt += (z * w[:, None]).T @ t
        mean_z += w @ z
        mean_t += w @ t
    total = weight.sum()
    mean_z, mean_t = mean_z / total, mean_t / total
    beta = np.linalg.solve(zz - total * np.outer(mean_z, mean_z) + ridge * np.eye(n), zt - total * np.outer(mean_z, mean_t))
    return Model(langs, chosen, (white @ beta).astype(np.float32), (mean_t - mean_z @ beta).astype(np.float32))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x, letters in vectors(batch.column("text")):
            keep = np.flatnonzero(letters)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a).take(pa.array(keep)), pa.array([r.tobytes() for r in np.packbits(x[keep], axis=1)], pa.binary())], ["lang", "bits"])


def train(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """Fits on at most per_lang documents of each language of docs(doc_id, text, lang); null texts, languages and ids are left out.

    Beyond max_langs languages the most frequent ones are learned (ties by name). Of a repeated doc_id the least text counts. A table without
    usable rows gives a model without languages.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("k"), "lang", "text").filter("k is not null and lang is not null and text is not null")
    sizes = materialise(docs.sparkSession, rows.groupBy("lang").count())
    learned = sizes.orderBy(F.desc("count"), "lang").limit(max_langs).select("lang")
    out = sizes.join(F.broadcast(learned), "lang", "left_anti").agg(F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    if out.n:
        logging.getLogger(__name__).warning("%d languages with %d labelled rows are not learned: max_langs is %d", out.n, out.rows, max_langs)
    # At most max_langs languages and max_langs x per_lang documents: both broadcasts are bounded.
    chosen = sampled(rows.select("k", "lang").join(F.broadcast(learned), "lang", "left_semi"), "lang", "k", per_lang).select("k", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["k", "lang"], "left_semi").groupBy("k", "lang").agg(F.min("text").alias("text"))
    packed = sample.select("text", "lang").mapInArrow(_pack, "lang string, bits binary").toArrow()
    if not packed.num_rows:
        return fit(np.zeros((0, BUCKETS), np.uint8), [])
    table = sorted(zip(packed.column("lang").to_pylist(), packed.column("bits").to_pylist(), strict=True))
    del packed
    langs = [v for v, _ in table]
    bits = np.frombuffer(b"".join(b for _, b in table), dtype=np.uint8).reshape(len(table), -1)
    del table
    return fit(bits, langs, packed=True)


def identify(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep (all, if None) of docs with lang_pred and score (0 to 1).

    lang_pred is ``und`` with score 0.0 where the text is null or has no letter, or where nothing was learned. The score
    is the winning regression value clipped to 0..1. Ties go to the language that sorts first. Repeated rows stay. Columns lang_pred and score
    of docs give way to the new ones; all others pass, whatever their names.
    """
    shared = spark.sparkContext.broadcast((model.langs, model.landmarks, model.weights, model.bias))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    # Numbered on the way in, so that no name of the caller's clashes.
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    kept = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(names, frame.schema.fields, strict=False)]
    out = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            at = batch.num_columns - 1  # the text stands last, whatever the others are called
            rest = batch.select(list(range(at)))
            for a, b, x, letters in vectors(batch.column(at)):
                best, top = [UND] * (b - a), np.zeros(b - a)
                if m.langs:
                    s = m.scores(x)
                    win = s.argmax(axis=1)
                    top = np.where(letters, np.clip(s[np.arange(len(win)), win], 0, 1), 0.0)
                    best = [m.langs[w] if ok else UND for w, ok in zip(win, letters, strict=True)]
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(top, pa.float64())], [*names, "lang_pred", "score"])

    return frame.mapInArrow(run, out)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
