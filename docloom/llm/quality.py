"""Ordinal quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector over hashed text features, shared by all grades, and ordered thresholds. The
expected grade and the tail probability P(grade >= k) follow from the same score. Features are presences: hashed words, and binned
text statistics (share of repeated words, of symbols, of digits, of capitals, distinct words, word length) hashed into the same table.

Ratings of the labels table have three grades, one for each merit: 0 low quality and toxic, 1 one of the two faults, 2 good and not toxic. Toxicity
is also fitted apart, by the same regression with two grades, since it is not the low end of quality. Both are held sparse by a lasso:
most words of a text say nothing about it. Training reads at most ``PER_GRADE`` labelled documents of each pair of grade and toxicity (four; a bounded
sample chosen by a hash of the id); their features are computed on the executors as bit vectors of BUCKETS / 8 bytes, which bounds what
reaches the driver to 4 x PER_GRADE x 8 KiB. Scoring covers every row and its whole text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sampled
from .textscan import U64, mix, pieces, scan

BITS = 16
BUCKETS = 1 << BITS
GRADES = 3
PER_GRADE = 1200
#: Least P(grade >= 2) of kept rows; P(not toxic) below which a row counts as toxic.
TAIL, TOXIC_TAIL = 0.5, 0.6
LASSO, TOXIC_LASSO = 0.1, 0.2
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_CAPITAL = np.array([65 <= b < 91 for b in range(256)])


def features(body: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Of each document, its distinct feature buckets in order."""
    words = scan(body, offsets)
    h = words.hashes()
    bucket = (h >> U64(64 - BITS)).astype(np.int64)
    sums = [np.concatenate(([0], np.cumsum(t[body]))) for t in (_SYMBOL, _DIGIT, _CAPITAL)]
    length = np.concatenate(([0], np.cumsum(words.end - words.begin)))
    for i in range(len(offsets) - 1):
        a, b, p, q = offsets[i], offsets[i + 1], words.first[i], words.first[i + 1]
        own = np.unique(bucket[p:q])
        n, size = max(1, q - p), max(1, b - a)
        shares = [(h[p + 1 : q] == h[p : q - 1]).sum() / n, *((s[b] - s[a]) / size for s in sums), len(own) / n, (length[q] - length[p]) / n / 12, np.log2(n) / 20]
        bins = np.array([k * 64 + min(15, int(16 * np.sqrt(max(0.0, x)))) for k, x in enumerate(shares)], dtype=U64)
        yield np.union1d(own, (mix(bins + U64(0xABCDEF12345)) >> U64(64 - BITS)).astype(np.int64))


class Model:
    """One cumulative-link regression; toxicity is another one, with two grades, if both are fitted."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, toxicity: Model | None = None):
        self.weights, self.thresholds, self.toxicity = weights, thresholds, toxicity

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each feature list."""
        score = np.array([self.weights[r].sum() for r in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, steps: int = 300, rate: float = 0.05, ridge: float = 0.02, lasso: float = LASSO, least: int = 5) -> Model:
    """Full-batch Adam on the mean class-balanced log-likelihood with a ridge and a lasso (soft threshold) on the weights. Features of fewer than least rows have no weight. Without rows: no weights, even thresholds."""
    weights = np.zeros(BUCKETS)
    if not rows:
        return Model(weights, np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1))
    column, start = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    count = np.bincount(column, minlength=BUCKETS)
    used, owner = (count >= least)[column], np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column, owner = column[used], owner[used]
    balance = 1 / np.maximum(np.bincount(grade, minlength=grades), 1)[grade]
    balance /= balance.sum()
    base = np.concatenate(([-1.0], np.zeros(grades - 2)))  # first threshold, then logarithms of the gaps
    state = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(grades - 1), np.zeros(grades - 1)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        gaps = np.exp(base[1:])
        cut = np.concatenate(([-np.inf], np.cumsum(np.concatenate((base[:1], gaps))), [np.inf]))
        score = np.bincount(owner, weights=weights[column], minlength=len(rows))
        high, low = sigmoid(cut[grade + 1] - score), sigmoid(cut[grade] - score)
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance * balance, low * (1 - low) / chance * balance
        g_score = d_high - d_low  # of the loss
        g_weights = np.bincount(column, weights=g_score[owner], minlength=BUCKETS) + ridge * weights / np.sqrt(len(rows))
        g_cut = np.array([d_low[grade == k].sum() - d_high[grade == k - 1].sum() for k in range(1, grades)])
        g_base = np.concatenate(([g_cut.sum()], [g_cut[j:].sum() * gaps[j - 1] for j in range(1, grades - 1)]))
        for i, (value, g) in enumerate(((weights, g_weights), (base, g_base))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights[:] = np.sign(weights) * np.maximum(np.abs(weights) - rate * lasso, 0)
    return Model(weights, np.cumsum(np.concatenate((base[:1], np.exp(base[1:])))))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade, toxic) of labels(doc_id, quality, toxic): the worst of repeated labels; rows with a null are left out."""
    sound = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
    return labels.filter(sound).groupBy("doc_id").agg(F.min(F.col("quality") + 1 - F.col("toxic")).alias("grade"), F.max("toxic").alias("toxic"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, body, offsets in pieces(batch.column("text")):
            out = []
            for row in features(body, offsets):
                x = np.zeros(BUCKETS, dtype=np.uint8)
                x[row] = 1
                out.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(a, b - a), batch.column("toxic").slice(a, b - a), pa.array(out, pa.binary())], ["grade", "toxic", "bits"])


def train(docs: DataFrame, graded: DataFrame, per_grade: int = PER_GRADE) -> Model:
    """Fits on at most per_grade documents of each pair of grade and toxicity of graded(doc_id, grade, toxic); of a repeated doc_id the least text counts."""
    rated = graded.select("doc_id", F.col("grade").cast("int").alias("grade"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("grade").between(0, GRADES - 1) & F.col("toxic").isin(0, 1))
    # Two for each grade at most, so the sizes that sampled() broadcasts are bounded.
    chosen = sampled(rated.withColumn("pair", 2 * F.col("grade") + F.col("toxic")), "pair", "doc_id", per_grade).select("doc_id", "grade", "toxic").collect()
    if not chosen:
        model = fit([], np.zeros(0, dtype=np.int64))
        model.toxicity = fit([], np.zeros(0, dtype=np.int64), 2)
        return model
    # At most 2 x GRADES x per_grade rows, so their broadcast is bounded.
    known = F.broadcast(docs.sparkSession.createDataFrame(chosen, rated.schema))
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(known, "doc_id").groupBy("doc_id", "grade", "toxic").agg(F.min("text").alias("text"))
    packed = sample.select("grade", "toxic", "text").mapInArrow(_bits, "grade int, toxic int, bits binary").toArrow()
    table = sorted(zip(*(packed.column(c).to_pylist() for c in ("grade", "toxic", "bits")), strict=True))
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8))) for _, _, b in table]
    grade, toxic = (np.array([r[i] for r in table], dtype=np.int64) for i in (0, 1))
    model = fit(rows, grade)
    model.toxicity = fit(rows, 1 - toxic, 2, lasso=TOXIC_LASSO)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, tail: float = TAIL, toxic_tail: float = TOXIC_TAIL) -> DataFrame:
    """doc_id, expected_grade, p_some (P(grade >= 1)), p_good (P(grade >= 2)), p_not_toxic, toxic, keep of every row of docs(doc_id, text).

    toxic: p_not_toxic is below toxic_tail; keep: p_good reaches tail and the row isn't toxic. A null or empty text is scored on its statistics alone. Repeated
    rows repeat; other columns are not read.
    """
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds, model.toxicity.weights, model.toxicity.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t, toxic_w, toxic_t = shared.value
        for batch in batches:
            for a, b, body, offsets in pieces(batch.column("text")):
                rows = list(features(body, offsets))
                p, clean = Model(w, t).tails(rows), Model(toxic_w, toxic_t).tails(rows)[:, 0]
                columns = [p.sum(axis=1), p[:, 0], p[:, -1], clean, clean < toxic_tail, (p[:, -1] >= tail) & (clean >= toxic_tail)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, columns)], ["doc_id", "expected_grade", "p_some", "p_good", "p_not_toxic", "toxic", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, p_some double, p_good double, p_not_toxic double, toxic boolean, keep boolean")
