"""Near-duplicate classes by BagMinHash signatures, banding and exact weighted-Jaccard verification.

A document is the multiset of its five-word shingles (all its words as one shingle if it has fewer than five). Two
documents are linked if their weighted Jaccard similarity (sum of minima over sum of maxima of the shingle counts)
is ``SIMILARITY`` or more; a class is a connected component of links.

Signatures: the weight axis is discretised at the integers and cut into dyadic strips [0,1), [1,2), [2,4), [4,8) ...; each
(shingle, strip) seeds an independent Poisson process whose rate is the strip's width, and every point carries a position
in the strip, a signature component and an identity. A shingle of weight w owns the points at positions below w, so a heavier
weight only adds points, and a component's earliest point is the same in two documents with probability equal to their
weighted Jaccard similarity. Points are made in order of time only up to a bound that leaves hardly a component empty (documents with an
empty component are done again with twice the bound), so the work per document is about m log m beside one draw per shingle.

Candidates are texts that share a bucket (a band of the signature); no bucket is capped. Documents with equal words are one text from the
start (partial aggregation, so any number of exact copies is cheap). The links of a bucket are found in three passes, each at most
a few verifications a text, and never all pairs of a bucket:

1. Every text meets the leaders of its buckets and is verified against the one whose sketch agrees best.
2. Texts now carry the name of their component. In every bucket with several components each text meets ``LEADERS`` leaders
   chosen by a hash; of all pairs between two components the best by sketch, from either half of the leaders, are verified.
3. What is left is decided exactly. Of buckets that still hold several components, those of at most ``SMALL`` texts tell all their pairs across components
   whose sizes and sketches allow the similarity; the texts of pairs not verified yet, and all texts of larger buckets, list the rarest of their
   shingles (``prefixes``): two texts reach the similarity only if they share one at places that leave room for the overlap. Pairs across components that
   meet in such a shingle, in places, sizes and sketches that allow the similarity, are all verified.

Pairs within a component need no comparison, so no link that could join classes is lost. In the third pass a shingle's
largest component is only met by the others' texts, so its cost is the number of stragglers, not the square of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, materialise
from .textscan import U64, kgrams, mix, pieces, scan, within

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Two bits of each signature component as two planes of 64-bit columns. Pairs whose bits estimate a similarity below SKETCH_LEAST (over five standard deviations below SIMILARITY) are not verified.
PLANE = BANDS * ROWS // 64
SKETCH = [f"s{i}" for i in range(2 * PLANE)]
SKETCH_LEAST = 0.62
#: Documents whose signatures are made together, and points drawn at once: both keep the scratch arrays small.
BLOCK, CHUNK = 64, 1 << 15
#: Leaders of a bucket in the second pass.
LEADERS = 4
#: Buckets of at most so many texts compare sizes and sketches of all their pairs before the third pass; larger ones go to it whole.
SMALL = 32
#: Cells of the counts by which shingles are ordered, from rare to frequent. Any order gives the same links; collisions only cost time.
CELLS = 1 << 20
#: Bits of the table by which rows are left out before a join; with more keys fewer rows are, with the same result.
BITS = 1 << 24
_GOLDEN = U64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of all distinct shingles, in document order."""
    g = kgrams(h, k)[within(first, k, len(h))]
    n_words = np.diff(first)
    n = np.maximum(n_words - k + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n)))
    if (short := np.flatnonzero((n_words > 0) & (n_words < k))).size:
        full = np.zeros(at[-1], dtype=U64)
        mask = np.ones(at[-1], dtype=bool)
        mask[at[short]] = False
        full[mask] = g
        full[at[short]] = [kgrams(h[first[d] : first[d + 1]], n_words[d])[0] for d in short]
        g = full
    for a, b in zip(at[:-1], at[1:], strict=True):
        g[a:b].sort()
    doc = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return doc[start], g[start], np.diff(np.append(start, len(g)))


def _points(seed: np.ndarray, limit: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, time, identity) of the Poisson points of rate width of every seed up to its limit, in order of time within a row.

    Rows that expect about equally many points are drawn together, about CHUNK points at once, and go on where these did not reach the limit. A row
    draws little more than it expects at once, since what lies beyond its limit is thrown away; how many are drawn at once changes no point.
    """
    mean = limit * width
    steps = np.maximum(2, 2.0 ** (np.ceil(2 * np.log2(mean + np.sqrt(mean) / 2 + 1)) / 2)).astype(np.int64)
    for n in np.unique(steps):
        rows = np.flatnonzero(steps == n)
        size = max(1, CHUNK // int(n))
        for a in range(0, len(rows), size):
            row, now, turn = rows[a : a + size], 0.0, np.arange(1, n + 1, dtype=U64)
            while len(row):
                name = mix(seed[row][:, None] + turn * _GOLDEN)
                gap = (name >> U64(11)).astype(np.float64)
                gap += 0.5
                gap *= 2.0**-53
                np.log(gap, out=gap)
                gap /= -width
                gap[:, 0] += now
                time = np.cumsum(gap, axis=1, out=gap)
                live = time <= limit[row][:, None]
                flat = np.flatnonzero(live)
                yield row[flat // n], time.ravel()[flat], name.ravel()[flat]
                on = live[:, -1]
                row, now, turn = row[on], time[on, -1], turn + U64(n)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n_docs x m signature of the weighted sets; all zero for an empty set. doc ascends; weights are integers from 1. Documents are worked on in blocks of BLOCK."""
    edge = np.searchsorted(doc, np.arange(0, n_docs + BLOCK, BLOCK))
    parts = [_signed(doc[p:q] - i * BLOCK, item[p:q], weight[p:q], min(BLOCK, n_docs - i * BLOCK), m) for i, (p, q) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
    return np.concatenate(parts) if parts else np.zeros((0, m), dtype=U64)


def _signed(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    out = np.zeros((n_docs, m), dtype=U64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo, factor = total > 0, np.log(m) + 3.0
    while todo.any():
        mine = todo[doc]
        d, e, w = doc[mine], item[mine], weight[mine]
        bound = np.where(total > 0, m / np.maximum(total, 1) * factor, 0.0)
        when = np.full(n_docs * m, np.inf)
        points = []
        low = 0
        while len(d):
            width = max(1, low)
            for row, time, name in _points(mix(e ^ mix(np.full(1, low + 1, dtype=U64))), bound[d], width):
                more = mix(name ^ U64(0xD1B54A32D192ED03))
                at = d[row] * m + ((more >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
                if low:
                    own = low + ((more & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * width < w[row]
                    at, time, name = at[own], time[own], name[own]
                np.minimum.at(when, at, time)
                points.append((at, time, name))
            low = max(1, 2 * low)
            more = w > low
            d, e, w = d[more], e[more], w[more]
        full = np.isfinite(when).reshape(n_docs, m).all(axis=1) & todo
        flat = np.zeros(n_docs * m, dtype=U64)
        for at, time, name in points:
            best = time == when[at]
            flat[at[best]] = name[best]
        out[full] = flat.reshape(n_docs, m)[full]
        todo &= ~full
        factor *= 2
    return out


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of a signature; the band's number is part of it."""
    out = np.zeros((len(sig), n_bands), dtype=U64)
    for b in range(n_bands):
        x = np.full(len(sig), b + 1, dtype=U64)
        for r in range(rows):
            x = mix(x * _GOLDEN + sig[:, b * rows + r])
        out[:, b] = x
    return out


def _signer(keep: tuple[str, ...], measure: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Signs rows (doc_id, xh, text and the columns keep); measure(bytes, offsets) is one more number of every text, taken while it is here."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, body, offsets in pieces(batch.column("text")):
                words = scan(body, offsets)
                h = words.hashes()
                doc, item, count = shingles(h, words.first)
                n = b - a
                sig = signatures(doc, item, count, n)
                key = bands(sig).view(np.int64)
                sketch = np.hstack([np.packbits(((sig >> U64(p)) & U64(1)).astype(np.uint8), axis=1).view(np.int64) for p in (0, 1)])
                size = np.diff(words.first)
                position = (np.arange(len(h)) - np.repeat(words.first[:-1], size) + 1).astype(U64)
                identity = np.zeros((n, 2), dtype=U64)
                for c, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                    total = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(h + position * U64(salt)))))
                    identity[:, c] = mix(total[words.first[1:]] - total[words.first[:-1]] + size.astype(U64))
                some = size > 0
                flat = pa.array(key[some].ravel())
                ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
                columns = {
                    **{c: batch.column(c).slice(a, n) for c in ("doc_id", "xh", *keep)},
                    **({"measure": pa.array(measure(body, offsets))} if measure else {}),
                    "tid": pa.array([r.tobytes() if s else None for r, s in zip(identity, some, strict=True)], pa.binary()),
                    "size": pa.array(np.bincount(doc, weights=count, minlength=n).astype(np.int64)),
                    **{name: pa.array(np.ascontiguousarray(sketch[:, i])) for i, name in enumerate(SKETCH)},
                    "bands": pa.ListArray.from_arrays(pa.array(ends), flat),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return sign


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose weighted Jaccard similarity of the whole texts reaches SIMILARITY."""
    for batch in batches:
        keep = []
        for a, b, body, offsets in pieces(batch.column("text_a")):
            other = batch.column("text_b").slice(a, b - a)
            sets = []
            for x, at in ((body, offsets), next((p[2], p[3]) for p in pieces(other, 1 << 62))):
                words = scan(x, at)
                doc, item, count = shingles(words.hashes(), words.first)
                sets.append((np.searchsorted(doc, np.arange(b - a + 1)), item, count))
            (at_a, item_a, n_a), (at_b, item_b, n_b) = sets
            for i in range(b - a):
                p, q = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
                _, u, v = np.intersect1d(item_a[p], item_b[q], assume_unique=True, return_indices=True)
                both = int(np.minimum(n_a[p][u], n_b[q][v]).sum())
                if both >= SIMILARITY * (int(n_a[p].sum()) + int(n_b[q].sum()) - both) - 1e-9:
                    keep.append(a + i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _linked(spark: SparkSession, pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their whole texts. A text with very many pairs is a skewed key, which Spark splits."""
    left = content.select(F.col("tid").alias("a"), F.col("text").alias("text_a"))
    right = content.select(F.col("tid").alias("b"), F.col("text").alias("text_b"))
    return materialise(spark, pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary"))


def _differ() -> Column:
    """Signature components whose two bits differ."""
    planes = [[F.col(f"s{i + p * PLANE}").bitwiseXOR(F.col(f"s{i + p * PLANE}2")) for p in (0, 1)] for i in range(PLANE)]
    return sum((F.bit_count(x.bitwiseOR(y)) for x, y in planes), F.lit(0))


def _close() -> Column:
    """Sizes and sketches that allow the similarity."""
    most = int(BANDS * ROWS * (1 - (1 + 3 * SKETCH_LEAST) / 4))
    return (F.least("size", "size2") >= SIMILARITY * F.greatest("size", "size2") - 1e-9) & (_differ() <= most)


def _mixed(entries: DataFrame, found: DataFrame, extra: list[Column]) -> DataFrame:
    """entries with their component's root, of buckets with several components; extra are aggregates of the bucket."""
    placed = entries.join(found, F.col("tid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "tid")).drop("node")
    name = F.xxhash64("root")
    mixed = placed.groupBy("bucket").agg(F.min(name).alias("r0"), F.max(name).alias("r1"), *extra).filter("r0 <> r1").drop("r0", "r1")
    return placed.join(mixed, "bucket")


def _tokens(item: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence's number: the multiset as a set."""
    token = np.repeat(item, count)
    turn = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
    return np.where(turn > 0, mix(token + U64(_GOLDEN) * turn.astype(U64)), token)


def _texts_tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, tokens) of every text."""
    for a, b, body, offsets in pieces(column):
        words = scan(body, offsets)
        doc, item, count = shingles(words.hashes(), words.first)
        at = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, _tokens(item[at[i] : at[i + 1]], count[at[i] : at[i + 1]])


def _cell(token: np.ndarray) -> np.ndarray:
    return (token >> U64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for _, token in _texts_tokens(batch.column("text")):
            np.add.at(total, _cell(token), 1)
    some = np.flatnonzero(total)
    for a in range(0, len(some), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(some[a : a + (1 << 16)].astype(np.int32)), pa.array(total[some[a : a + (1 << 16)]])], ["cell", "n"])


def prefixes(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(tid, token, place) of the rarest tokens of texts(tid, text): so many that two texts of the similarity share one.

    Tokens are ordered by how often their cell occurs in all these texts, then by hash. Of a text of n tokens the first n - ceil(SIMILARITY n) + 1
    are listed, but for those that no other text can hold. The counts are CELLS numbers, whatever the input.
    """
    table = texts.select("text").mapInArrow(_count_cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    # The order needs no more than the logarithm in sixteenths; 0 stands for a single occurrence.
    rank = np.zeros(CELLS, dtype=np.uint16)
    rank[table.column("cell").to_numpy()] = np.round(16 * np.log2(table.column("n").to_numpy())).astype(np.uint16)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            rows, tokens, places = [], [], []
            for i, token in _texts_tokens(batch.column("text")):
                often = order[_cell(token)]
                first = np.lexsort((token, often))[: len(token) - int(np.ceil(SIMILARITY * len(token) - 1e-9)) + 1]
                place = np.flatnonzero(often[first] > 0)
                rows.append(np.full(len(place), i))
                tokens.append(token[first[place]])
                places.append(place)
            if rows:
                row, token, place = (np.concatenate(x) for x in (rows, tokens, places))
                columns = [batch.column("tid").take(pa.array(row)), pa.array(token.view(np.int64)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["tid", "token", "place"])

    return texts.select("tid", "text").mapInArrow(run, "tid binary, token bigint, place int")


def _stragglers(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) across components of keys(token, place, tid, root, size, sketch) that may reach the similarity; none is left out."""
    counted = keys.groupBy("token", "root").agg(F.count("*").alias("n"))
    most = counted.groupBy("token").agg(F.max_by("root", "n").alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("token", "top")
    columns = ["tid", "root", "place", "size", *SKETCH]
    mixed = keys.join(most, "token")
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("size2")) - 1e-9)
    room = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2")) >= need
    other = mixed.select("token", *[F.col(c).alias(f"{c}2") for c in columns])
    met = mixed.filter("root <> top").join(other, "token").filter((F.col("root") != F.col("root2")) & room & _close())
    return met.select(F.least("tid", "tid2").alias("a"), F.greatest("tid", "tid2").alias("b")).distinct()


def _undecided(placed: DataFrame, tested: DataFrame) -> DataFrame:
    """tid of the texts of placed(bucket, tid, root, size, sketch, n) that the third pass needs: those of buckets of more than SMALL texts, and both of every
    pair (a, b) across components in another bucket whose sizes and sketches allow the similarity and which tested doesn't hold."""
    columns = ["tid", "root", "size", *SKETCH]
    few = placed.filter(F.col("n") <= SMALL).select("bucket", *columns)
    met = few.join(few.select("bucket", *[F.col(c).alias(f"{c}2") for c in columns]), "bucket").filter((F.col("tid") < F.col("tid2")) & (F.col("root") != F.col("root2")) & _close())
    pairs = met.select(F.col("tid").alias("a"), F.col("tid2").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    return placed.filter(F.col("n") > SMALL).select("tid").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("tid"))).distinct()


def _thinned(spark: SparkSession, rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those that no row of keys equals in the columns on, so that a join moves few others: a table of BITS bits by hash, whatever the input."""
    cell = F.pmod(F.xxhash64(*on), F.lit(BITS))
    word, bit = F.shiftright(cell, 6), F.pmod(cell, F.lit(64)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    table = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[table.column("word").to_numpy()] = table.column("mask").to_numpy()
    one = spark.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))}))
    return rows.join(F.broadcast(one), F.get("bits", word.cast("int")).bitwiseAND(mask) != 0, "left_semi")


def _at_roots(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of texts as pairs of their components' roots."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return pairs


def classes(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = (), measure: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, xh (xxhash64 of the text), class_id (least doc_id of the class), is_first, for every row of docs(doc_id, text).

    A text without words (null, empty, only punctuation) links to nothing: it is its own class. Equal word sequences are one class
    whatever their case and punctuation. Repeated rows repeat. is_first marks the rows of the one document that
    stands for its class (the least doc_id, then the least xh); rows without words are all first. An empty table gives an empty result.
    The columns keep of docs follow, and with a measure of texts (see _signer) a bigint column measure and a boolean column worded.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("xh"), "text", *keep)
    own = ["size", *SKETCH]
    extra = [*keep, *(["measure"] if measure else [])]
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + ("measure bigint, " if measure else "")
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, xh bigint, {kept}tid binary, {', '.join(f'{c} bigint' for c in own)}, bands array<bigint>"
    signed = materialise(spark, rows.mapInArrow(_signer(keep, measure), shape))
    worded = signed.filter(F.col("tid").isNotNull())
    texts = materialise(spark, worded.groupBy("tid").agg(F.min(F.struct("doc_id", "xh")).alias("rep"), *[F.first(c).alias(c) for c in (*own, "bands")]))
    entries = texts.select("tid", F.explode("bands").alias("bucket"))
    least = F.xxhash64("tid")
    leader = entries.groupBy("bucket").agg(F.min(least).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("bucket", "lead")
    shared = materialise(spark, entries.join(leader, "bucket").join(texts.select("tid", *own), "tid"))
    needed = materialise(spark, shared.select("tid").distinct().join(texts.select("tid", "rep.doc_id", "rep.xh"), "tid"))
    source = _thinned(spark, rows, needed, ["doc_id", "xh"]).select(F.col("doc_id").alias("d"), F.col("xh").alias("x"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x"))
    content = materialise(spark, needed.join(source, same).groupBy("tid").agg(F.first("text").alias("text")))
    # First pass: the best leader of every text.
    leaders = shared.filter(least == F.col("lead")).select("bucket", *[F.col(c).alias(f"{c}2") for c in ("tid", *own)])
    met = shared.filter(least != F.col("lead")).join(leaders, "bucket").filter(_close())
    best = met.groupBy("tid").agg(F.min(F.struct(_differ().alias("d"), "tid2")).alias("m")).select(F.col("tid").alias("b"), F.col("m.tid2").alias("a"))
    tested = materialise(spark, best)
    first = _linked(spark, tested, content)
    # A text has one leader, which may have its own: two steps up name the component well enough for the second pass.
    up = first.select(F.col("b").alias("node"), F.col("a").alias("root"))
    found = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # Second pass: the best pairs between components, by several leaders of each bucket.
    entries = shared.drop("lead")
    turn = [F.xxhash64("tid", "bucket", F.lit(i)) for i in range(LEADERS)]
    placed = _mixed(entries, found, [F.min(x).alias(f"m{i}") for i, x in enumerate(turn)])
    columns = ["tid", "root", *own]
    slot = F.coalesce(*[F.when(x == F.col(f"m{i}"), F.lit(i)) for i, x in enumerate(turn)])
    leaders = placed.withColumn("slot", slot).filter("slot is not null").select("bucket", "slot", *[F.col(c).alias(f"{c}2") for c in columns])
    met = placed.select("bucket", *columns).join(leaders, "bucket").filter((F.col("root") != F.col("root2")) & _close())
    pair = F.struct(_differ().alias("d"), F.least("tid", "tid2").alias("a"), F.greatest("tid", "tid2").alias("b"))
    met = met.select(F.least("root", "root2").alias("r1"), F.greatest("root", "root2").alias("r2"), (F.col("slot") % 2).alias("half"), pair.alias("p"))
    best = met.groupBy("r1", "r2", "half").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()
    best = materialise(spark, best)
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(best)
    second = _linked(spark, best, content)
    found = materialise(spark, components(spark, first.unionByName(second)))
    # Third pass: all that is left, by the rarest shingles.
    placed = materialise(spark, _mixed(entries, found, [F.count("*").alias("n")]).select("bucket", *columns, "n"))
    open_texts = materialise(spark, _undecided(placed, tested).join(placed.select(*columns).distinct(), "tid").select(*columns))
    keys = prefixes(spark, content.join(open_texts.select("tid"), "tid", "left_semi")).join(open_texts, "tid")
    third = _linked(spark, _stragglers(materialise(spark, keys)), content)
    joined = components(spark, _at_roots(third, found)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = texts.select("tid", "rep").join(found, F.col("tid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "tid"))
    rooted = rooted.join(joined, "root", "left").select("tid", "rep", F.coalesce("top", "root").alias("root"))
    lead = rooted.groupBy("root").agg(F.min("rep").alias("lead"))
    named = rooted.join(lead, "root").select("tid", "lead")
    out = signed.select("doc_id", "xh", "tid", *extra).join(named, "tid", "left")
    alone = F.col("lead").isNull()
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("xh") == F.col("lead.xh"))
    name = F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    worded = [F.col("tid").isNotNull().alias("worded")] if measure else []
    return out.select("doc_id", "xh", name.alias("class_id"), (alone | leads).alias("is_first"), *extra, *worded)


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs of which one stands for each class; all columns. Of repeated rows of that document one stays."""
    keep = classes(spark, docs).filter("is_first").select(F.col("doc_id").alias("d"), F.col("xh").alias("x")).distinct()
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("xh"))
    kept = named.join(keep, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")), "left_semi")
    return kept.dropDuplicates(["doc_id", "xh"]).select("row.*")
