"""Inverted index in immutable segments, and BM25 search over several boosted fields (the best field counts).

BM25 with k1 1.2, b 0.75, idf ln(1 + (N - df + 0.5) / (df + 0.5)), OR of the query's distinct terms, exact field lengths. This is our
definition of the keyword score.

Postings of a term lie in blocks of like frequency and like text length, and a small table tells each block's largest frequency, least length and least id. So what a
block can add to a score is known before it is read, whatever the corpus statistics have become.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.tables import written

BOOSTS = {"heading": 3.0, "section_hierarchy": 2.0, "chunk_text": 1.0}
K1, B = 1.2, 0.75
SALTS = 16
#: Scores are told to 6 places; a bound must lie by so much below a score to be out, whatever its own rounding.
STEP = 1e-6
#: Folders of a segment's postings, by the hash of the term.
BUCKETS = 16
#: Postings at which a question's first look ends, and how many times k documents of it are scored in full.
LOOK, SEEDS = 8192, 2
#: Rows up to which the asking side of a join is broadcast; beyond, both sides are shuffled.
MOST_ROWS = 1 << 18
#: Postings of a cell, terms of all questions up to which the weights are broadcast, and scores or sums that a cell holds at a time.
CELL, FEW_TERMS, WIDTH = 1 << 18, 1 << 16, 1 << 21
#: Different questions that cells score; beyond, bounds spare more than cells do.
BLOCK = 4096


def terms(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def document(chunks: DataFrame) -> DataFrame:
    """Chunks as keyword documents: the hierarchy as one text."""
    return chunks.withColumn("section_hierarchy", F.array_join("section_hierarchy", " > "))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _block(tf: Column, length: Column) -> Column:
    """Number of the class of postings: steps of half a power of two in frequency, of a quarter in length."""
    return (F.floor(F.log2(tf) * 2) * 1000 + F.floor(F.log2(length) * 4)).cast("int")


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.min("id").alias("min_id"))


@dataclass
class Index:
    """postings(field, term, block, id, tf, length), blocks(field, term, block, n, max_tf, min_length, min_id),
    document_frequency(field, term, df), fields(field, n, mean_length); buckets: how many folders the postings' column bucket tells apart, 0 without it."""

    postings: DataFrame
    blocks: DataFrame
    document_frequency: DataFrame
    fields: DataFrame
    buckets: int = 0

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """Postings in the folders of asked(term); their number is at most buckets, however many terms there are."""
        if not self.buckets:
            return self.postings
        wanted = [r[0] for r in asked.select(bucket_of(F.col("term"), self.buckets)).distinct().collect()]
        return self.postings.filter(F.col("bucket").isin(wanted))


def index(docs: DataFrame, fields: list[str], key: str = "chunk_id") -> Index:
    """Index of the named text columns. Null and empty fields have no postings and don't count in their field's statistics.

    The texts are cut into terms once: postings are written, and frequencies and statistics come from them. One posting of each text, that of its first
    term, stands for the text in the counts.
    """
    postings, statistics = _made(docs, fields, key)
    frequency = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(postings, _blocks(postings), frequency, _mean(statistics))


def _made(docs: DataFrame, fields: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Postings, written, and (field, n, total): numbers of texts and of their terms."""
    rows = docs.select(F.col(key).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("w")) for f in fields])))
    # Outer, then filtered: else the optimiser puts the split a second time in front of the explode.
    single = rows.select("field", "id", F.size("w").cast("long").alias("length"), F.get("w", F.lit(0)).alias("head"), F.explode_outer("w").alias("term")).filter("term is not null")
    counted = single.groupBy("field", "term", "id", "length", "head").agg(F.count("*").alias("tf"))
    shown = counted.select("field", "term", _block(F.col("tf"), F.col("length")).alias("block"), "id", "tf", "length", (F.col("term") == F.col("head")).alias("head"))
    postings = written(shown)
    statistics = postings.groupBy("field").agg(F.sum(F.col("head").cast("long")).alias("n"), F.sum("tf").alias("total"))
    return postings, statistics


def _mean(statistics: DataFrame) -> DataFrame:
    return statistics.filter("n > 0").select("field", "n", (F.col("total") / F.col("n")).alias("mean_length"))


def checked(docs: DataFrame, fields: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, reason) of documents that a bulk write refuses: id missing, id repeated, no text in any field."""
    blank = F.forall(F.array(*fields), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    counted = docs.groupBy(key).agg(F.count("*").alias("n"), F.max(blank).alias("blank"))
    reason = F.when(F.col(key).isNull(), "id missing").when(F.col("n") > 1, "id repeated").when(F.col("blank"), "no text")
    return counted.select(key, reason.alias("reason")).filter("reason is not null")


@dataclass
class Store:
    """A keyword index in a shared folder: immutable segments, and a manifest whose versions name those that count, in order.

    A segment holds postings by bucket and term, their blocks, its statistics and members(id, document_id); further dead(id), the ids that it takes out of the
    segments before it, and lost and gone, the frequencies and statistics that go with these. Everything is written before the manifest's next
    version names it, so a write that dies leaves readers where they were. Of two writers at a time the second gets a versions.Conflict and writes anew.
    """

    spark: SparkSession
    folder: str

    def _live(self) -> tuple[int, list[str]]:
        found = versions.read(self.spark, f"{self.folder}/manifest")
        return (0, []) if found is None else (found[0], found[1]["segments"])

    def _table(self, segment: str, name: str) -> DataFrame:
        path = f"{self.folder}/segments/{segment}"
        if name != "postings":
            return self.spark.read.parquet(f"{path}/{name}")
        # A segment without postings has no file that tells their columns.
        kind = self.spark.read.parquet(f"{path}/members").schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"field string, term string, block int, id {kind}, tf bigint, length bigint, head boolean, bucket int").parquet(f"{path}/postings")

    def _all(self, segments: list[str], name: str) -> DataFrame:
        """One table of all segments, with its segment's place as column since."""
        return _union([self._table(s, name).withColumn("since", F.lit(i)) for i, s in enumerate(segments)])

    def _alive(self, segments: list[str], name: str) -> DataFrame:
        """Rows of postings or members that no later segment has taken out."""
        dead = self._all(segments, "dead").select(F.col("id").alias("_id"), F.col("since").alias("_since"))
        rows = self._all(segments, name)
        return rows if len(segments) < 2 else rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("since") < F.col("_since")), "left_anti")

    def read(self) -> Index:
        """The index as it stands; raises ValueError before the first write."""
        _, segments = self._live()
        if not segments:
            raise ValueError("the store holds no index")
        minus = lambda df, *c: df.select(*[x for x in df.columns if x not in c], *[(-F.col(x)).alias(x) for x in c])
        blocks = self._all(segments, "blocks")
        df = blocks.select("field", "term", F.col("n").alias("df")).unionByName(minus(self._all(segments, "lost").select("field", "term", "df"), "df"))
        totals = self._all(segments, "statistics").select("field", "n", "total").unionByName(minus(self._all(segments, "gone").select("field", "n", "total"), "n", "total"))
        frequency = df.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        statistics = totals.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        # A block of several segments has the widest of their bounds.
        together = blocks.groupBy("field", "term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"), F.min("min_id").alias("min_id"))
        return Index(self._alive(segments, "postings"), together if len(segments) > 1 else blocks, frequency, _mean(statistics), BUCKETS)

    def write(self, docs: DataFrame, fields: list[str], key: str = "chunk_id", document: str | None = None, strict: bool = True) -> int:
        """Puts docs in, whole or not at all; the manifest's version. What the documents (column document; without it, the ids) held before is taken out, stale ids included.

        One refused row (see checked) fails the batch with a ValueError that names some; not strict: blank texts have no postings, and rows of one id count as one text.
        """
        bad = checked(docs, fields, key).orderBy(key).limit(5).collect() if strict else []
        if bad:
            raise ValueError("refused: " + ", ".join(f"{r[0]} ({r.reason})" for r in bad))
        version, segments = self._live()
        postings, statistics = _made(docs, fields, key)
        members = docs.select(F.col(key).alias("id"), F.col(document or key).alias("document_id"))
        replaced = members.select("document_id").distinct()
        dead = None
        if segments:
            old = self._alive(segments, "members").select("id", "document_id")
            # A row goes with its document, or because its id comes again under another one.
            dead = old.join(replaced, "document_id", "left_semi").select("id").unionByName(old.join(members, "id", "left_semi").select("id")).distinct()
        return self._publish(version, [*segments, self._segment(segments, postings, statistics, members, dead)])

    def remove(self, documents: DataFrame) -> int:
        """Takes the documents(document_id) out, in a segment that adds nothing."""
        version, segments = self._live()
        if not segments:
            raise ValueError("the store holds no index")
        old = self._alive(segments, "members").select("id", "document_id")
        dead = old.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("id").distinct()
        first = segments[0]
        empty = [self._table(first, t).filter("false") for t in ("postings", "statistics", "members")]
        return self._publish(version, [*segments, self._segment(segments, *empty, dead)])

    def merge(self) -> int:
        """All that is alive as a single segment; the others stay on disk for readers that hold them until vacuum()."""
        version, segments = self._live()
        found = self.read()
        postings = found.postings.select("field", "term", "block", "id", "tf", "length", "head")
        statistics = found.fields.select("field", "n", F.round(F.col("n") * F.col("mean_length")).cast("long").alias("total"))
        name = self._segment([], written(postings), statistics, self._alive(segments, "members").select("id", "document_id"), None)
        return self._publish(version, [name])

    def vacuum(self) -> None:
        """Deletes the segments that the last version doesn't name: those merged away, and those of writers that died."""
        _, segments = self._live()
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/segments")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in system.listStatus(where) if system.exists(where) else []:
            if f.getPath().getName() not in segments:
                system.delete(f.getPath(), True)

    def _publish(self, version: int, segments: list[str]) -> int:
        return versions.publish(self.spark, f"{self.folder}/manifest", version + 1, {"segments": segments})

    def _segment(self, before: list[str], postings: DataFrame, statistics: DataFrame, members: DataFrame, dead: DataFrame | None) -> str:
        name = uuid.uuid4().hex
        path = f"{self.folder}/segments/{name}"
        rows = postings.select(bucket_of(F.col("term"), BUCKETS).alias("bucket"), "field", "term", "block", "id", "tf", "length", "head")
        # By range, so that a very common term is spread over several files; a file holds few terms, in order.
        rows.repartitionByRange("bucket", "field", "term", "id").sortWithinPartitions("bucket", "field", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
        members.write.parquet(f"{path}/members")
        kept = self._table(name, "postings")
        _blocks(kept).write.parquet(f"{path}/blocks")
        statistics.select("field", "n", "total").write.parquet(f"{path}/statistics")
        none = members.select("id").filter("false")
        (none if dead is None else dead).write.parquet(f"{path}/dead")
        if before and dead is not None:
            taken = written(self._alive(before, "postings").join(self._table(name, "dead"), "id", "left_semi").select("field", "term", "tf", "head"))
        else:
            taken = kept.select("field", "term", "tf", "head").filter("false")
        taken.groupBy("field", "term").agg(F.count("*").alias("df")).write.parquet(f"{path}/lost")
        taken.groupBy("field").agg(F.sum(F.col("head").cast("long")).alias("n"), F.sum("tf").alias("total")).write.parquet(f"{path}/gone")
        return name


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def bulk(docs: DataFrame, fields: list[str], folder: str, key: str = "chunk_id", document: str | None = None) -> Index:
    """Writes all docs to the store in folder, or none of them, and reads the index that is there then."""
    store = Store(docs.sparkSession, folder)
    store.write(docs, fields, key, document)
    return store.read()


def lookup(ids: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """ids(key) with the stored chunk's columns; nulls where there is none."""
    return ids.join(store, key, "left")


def peek(store: DataFrame, n: int = 10, key: str = "chunk_id") -> DataFrame:
    """The first n documents by id, each with the number of all."""
    total = store.agg(F.count("*").alias("total"))
    return store.orderBy(key).limit(n).crossJoin(F.broadcast(total))  # one row


def _share(weight: Column, tf: Column, length: Column, mean: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _best_field(shares: DataFrame) -> DataFrame:
    """(query_id, id, score) of shares(query_id, field, id, s): the best field's sum."""
    by_field = shares.groupBy("query_id", "id", "field").agg(F.sum("s").alias("s"))
    return by_field.groupBy("query_id", "id").agg(F.round(F.max("s"), 6).alias("score"))


def _weights(found: Index, mine: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(field, term, df, mean_length, weight) of the terms in mine(term), in the boosted fields."""
    boost = F.element_at(F.create_map(*[F.lit(v) for pair in boosts.items() for v in pair]), F.col("field"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequency = found.document_frequency.filter(F.col("field").isin(list(boosts))).join(mine, "term", "left_semi")
    # One row a field.
    return frequency.join(F.broadcast(found.fields), "field").select("field", "term", "df", "mean_length", (idf * boost).alias("weight"))


class Search:
    """BM25 top-k of a batch of questions by upper bounds (after MaxScore: Turtle and Flood, 1995), in tables.

    1. Every asked (field, term) gets its weight, every block of it the most that it can add.
    2. A question's blocks are taken from the strongest on until they hold LOOK postings, and summed by document; the SEEDS x k best of these are scored in full, and the k-th best score is the cutoff.
    3. In each field a question's terms are ordered by the most that they can add. The weakest ones whose sum stays below the cutoff are optional: a document with these alone can't get in.
       Only postings of the others are joined, without the blocks that can't reach the cutoff with the best of all other terms, and summed by document. What reaches the
       cutoff with all that the optional terms could add is left, and scored in full by (term, document).

    A common term is nearly always optional: its postings meet the documents that are left and not every document. A bound below the cutoff by less than a rounding
    step counts as reaching it; at the cutoff itself only ids up to the k-th best's can still get in.
    """

    def __init__(self, queries: DataFrame, found: Index, k: int, boosts: dict[str, float]):
        self.k, self.fields = k, list(boosts)
        asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct())
        self.asked, self.postings = asked, found.of_terms(asked)
        weight = _weights(found, asked.select("term").distinct(), boosts).drop("df")
        bound = _share(F.col("weight"), F.col("max_tf"), F.col("min_length"), F.col("mean_length")) * (1 + 1e-12)
        self.blocks = written(found.blocks.join(weight, ["field", "term"]).select("field", "term", "block", "n", "min_id", "weight", "mean_length", bound.alias("bound")))
        most = self.blocks.groupBy("field", "term").agg(F.max("bound").alias("most"), F.first("weight").alias("weight"), F.first("mean_length").alias("mean_length"))
        self.wanted = written(asked.join(most, "term"))

    def best(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k).select("query_id", "rank", "id", "score")

    def found_at(self, places: DataFrame) -> DataFrame:
        """(query_id, field, id, s): shares of places(query_id, field, term, id, weight, mean_length) where there is a posting."""
        keys = ["field", "term", "id"]
        found = self.postings.select(*keys, "tf", "length").join(self._asking(places, None), keys)
        return found.select("query_id", "field", "id", _share(F.col("weight"), F.col("tf"), F.col("length"), F.col("mean_length")).alias("s"))

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(query_id, id, score) of pairs(query_id, id), over all terms and fields."""
        every = self.wanted.select("query_id", "field", "term", "weight", "mean_length")
        return _best_field(self.found_at(pairs.join(every, "query_id")))

    def completed(self, left: DataFrame) -> DataFrame:
        """(query_id, id, score) of left(query_id, field, id, s, n_optional): what the optional terms of the field add to s.

        A field whose bound stays below the cutoff isn't there, and can't be the best field of a document that gets in.
        """
        terms_ = self.wanted.select("query_id", "field", "term", "weight", "mean_length", "most")
        weakest = Window.partitionBy("query_id", "field").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        places = left.join(terms_.withColumn("place", F.count("*").over(weakest)), ["query_id", "field"]).filter("place <= n_optional")
        more = self.found_at(places.select("query_id", "field", "term", "id", "weight", "mean_length"))
        return _best_field(left.select("query_id", "field", "id", "s").unionByName(more))

    def _asking(self, rows: DataFrame, salt: str | None) -> DataFrame:
        """rows, written; for a broadcast up to MOST_ROWS, which leaves the postings where they are, else copied to every salt."""
        rows = written(rows)
        if rows.count() <= MOST_ROWS:
            return F.broadcast(rows)
        return rows.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) if salt else rows

    def met(self, chosen: DataFrame) -> DataFrame:
        """Postings of chosen(query_id, field, term, block, ...), by (query_id, field, id). A block of a common term meets very many questions: in a shuffle its postings are dealt over SALTS keys."""
        asking = self._asking(chosen, "salt")
        keys = ["field", "term", "block"]
        postings = self.postings.select(*keys, "id", "tf", "length")
        if "salt" in asking.columns:
            keys, postings = [*keys, "salt"], postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        return postings.join(asking, keys).withColumn("share", _share(F.col("weight"), F.col("tf"), F.col("length"), F.col("mean_length")))

    def cutoffs(self) -> DataFrame:
        """(query_id, cutoff, last): score and id of the k-th best of the first look; no row for a question whose first look finds fewer."""
        strongest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "field", "term", "block").rowsBetween(Window.unboundedPreceding, -1)
        each = self.wanted.select("query_id", "field", "term").join(self.blocks, ["field", "term"])
        first = each.withColumn("before", F.coalesce(F.sum("n").over(strongest), F.lit(0))).filter(F.col("before") < LOOK)
        seen = self.met(first.select("query_id", "field", "term", "block", "weight", "mean_length")).groupBy("query_id", "field", "id").agg(F.sum("share").alias("s"))
        order = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
        one = seen.groupBy("query_id", "id").agg(F.max("s").alias("s"))
        seeds = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SEEDS * self.k).select("query_id", "id")
        return written(self.best(self.scored(seeds)).filter(F.col("rank") == self.k).select("query_id", F.col("score").alias("cutoff"), F.col("id").alias("last")))

    def left(self, cutoffs: DataFrame) -> DataFrame:
        """(query_id, field, id, s, n_optional) of the documents whose bound reaches the cutoff in the field; s is without the field's n_optional weakest terms."""
        reaches = lambda bound, ids: F.col("cutoff").isNull() | (bound >= F.col("cutoff") + 0.4 * STEP) | ((bound >= F.col("cutoff") - STEP) & (ids <= F.col("last")))
        weakest = Window.partitionBy("query_id", "field").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("query_id", "field")
        rows = self.wanted.join(cutoffs, "query_id", "left").withColumn("upto", F.sum("most").over(weakest))
        optional = F.coalesce(F.col("upto") < F.col("cutoff") - STEP, F.lit(False))
        rows = rows.withColumn("optional", optional).withColumn("others", F.sum("most").over(whole) - F.col("most"))
        rows = rows.withColumn("spare", F.coalesce(F.sum(F.when(F.col("optional"), F.col("most"))).over(whole), F.lit(0.0))).withColumn("n_optional", F.count_if("optional").over(whole)).filter("not optional")
        chosen = rows.drop("weight", "mean_length").join(self.blocks, ["field", "term"]).filter(reaches(F.col("bound") + F.col("others"), F.col("min_id")))
        chosen = chosen.select("query_id", "field", "term", "block", "weight", "mean_length", "spare", "n_optional", "cutoff", "last")
        summed = self.met(chosen).groupBy("query_id", "field", "id").agg(F.sum("share").alias("s"), F.first("spare").alias("spare"), F.first("n_optional").alias("n_optional"), F.first("cutoff").alias("cutoff"), F.first("last").alias("last"))
        return summed.filter(reaches((F.col("s") + F.col("spare")) * (1 + 1e-12), F.col("id"))).select("query_id", "field", "id", "s", "n_optional")


def _cell(k: int):
    """The k best ids of each question in one cell: asked(query_id, t) and postings(id, field, t, share), t being a term's number."""

    def run(asked: pa.Table, postings: pa.Table) -> pa.Table:
        coded = lambda t, c: t.column(c).combine_chunks().dictionary_encode()
        questions, ids = coded(asked, "query_id"), coded(postings, "id")
        names, n = ids.dictionary, len(questions.dictionary)
        # Ids are numbered in their order.
        ordered = pc.sort_indices(names).to_numpy()
        place = np.empty(len(ordered), np.int64)
        place[ordered] = np.arange(len(ordered))
        at, field, share = place[ids.indices.to_numpy()], postings.column("field").to_numpy(), postings.column("share").to_numpy()
        # For each term its questions, in a row.
        numbers = asked.column("t").to_numpy()
        by_term = np.argsort(numbers, kind="stable")
        asking = questions.indices.to_numpy()[by_term].astype(np.int64)
        known, first, count = np.unique(numbers[by_term], return_index=True, return_counts=True)
        term = np.searchsorted(known, postings.column("t").to_numpy())
        rows = np.argsort(at, kind="stable")
        at, field, share, first, count = at[rows], field[rows], share[rows], first[term[rows]], count[term[rows]]
        begins = np.searchsorted(at, np.arange(len(names) + 1))
        sums = np.concatenate(([0], np.cumsum(count)))[begins]
        found, low = [], 0
        while low < len(names):
            # As many documents as keep both the scores and what is summed to them bounded, one at least.
            high = min(len(names), low + max(1, WIDTH // n), max(low + 1, int(np.searchsorted(sums, sums[low] + WIDTH, side="right")) - 1))
            width, best = high - low, np.zeros(n * (high - low))
            part = slice(begins[low], begins[high])
            for f in np.unique(field[part]):
                mine = np.flatnonzero(field[part] == f) + begins[low]
                c = count[mine]
                spread = np.repeat(np.arange(len(mine)), c)
                question = asking[np.arange(len(spread)) - np.repeat(np.cumsum(c) - c, c) + first[mine][spread]]
                np.maximum(best, np.bincount(question * width + (at[mine] - low)[spread], share[mine][spread], n * width), out=best)
            # One whole number for score, then id: no ties are left.
            key = np.where(best > 0, (np.floor(best * 1e6 + 0.5).astype(np.int64) << 21) + (WIDTH - 1 - np.tile(np.arange(width), n)), -1).reshape(n, width)
            top = np.argpartition(key, width - k, axis=1)[:, width - k :] if width > k else np.tile(np.arange(width), (n, 1))
            key = np.take_along_axis(key, top, axis=1)
            question, _ = np.nonzero(key >= 0)
            found.append((question, (top + low)[key >= 0], key[key >= 0] >> 21))
            low = high
        question, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, -score, question))
        question, doc, score = question[order], doc[order], score[order]
        kept = np.arange(len(order)) - np.searchsorted(question, question) < k
        return pa.table({"query_id": questions.dictionary.take(pa.array(question[kept])), "id": names.take(pa.array(ordered[doc[kept]])), "score": score[kept] / 1e6})

    return run


def _in_cells(asked: DataFrame, found: Index, k: int, boosts: dict[str, float]) -> DataFrame:
    """(query_id, id, score): the k best of each cell for asked(query_id, term), every posting of an asked term scored.

    Documents are dealt into cells of about CELL postings, which meet all questions in one sum by document: no pair of question and document, and no pair of question and posting, is ever a row.
    """
    mine = written(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")))
    weights = written(_weights(found, mine.select("term"), boosts).join(mine, "term"))
    told = weights.agg(F.count("*").alias("n"), F.sum("df").alias("postings")).first()
    cells = max(1, -(-(told.postings or 0) // CELL))
    rows = found.of_terms(mine).select("field", "term", "id", "tf", "length").join(F.broadcast(weights) if told.n <= FEW_TERMS else weights, ["field", "term"])
    place = F.array_position(F.array(*map(F.lit, boosts)), F.col("field")).cast("int").alias("field")
    share = _share(F.col("weight"), F.col("tf"), F.col("length"), F.col("mean_length")).alias("share")
    postings = rows.select(F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"), "id", place, "t", share)
    every = asked.join(mine, "term").select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "query_id", "t")
    run = _cell(k)

    def cell(q: pa.Table, p: pa.Table) -> pa.Table:
        return run(q, p) if q.num_rows and p.num_rows else pa.table({c: pa.array([], t) for c, t in (("query_id", q.schema.field("query_id").type), ("id", p.schema.field("id").type), ("score", pa.float64()))})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return every.groupBy("cell").cogroup(postings.groupBy("cell")).applyInArrow(cell, f"query_id {kind(asked, 'query_id')}, id {kind(postings, 'id')}, score double")


def search(queries: DataFrame, found: Index, k: int, boosts: dict[str, float] | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the k best of each row of queries(query_id, text), written; none for k <= 0. Scores to 6 places; ties to the smaller id.

    Repeated rows of a query_id are one question, and questions of the same terms are answered once. Up to BLOCK different questions are scored in cells of documents; beyond, see Search for the way:
    what is scored then is what can still enter the k best.
    """
    if k <= 0:
        return queries.join(found.postings.select("id"), F.lit(False)).select("query_id", F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    boosts = boosts or BOOSTS
    single = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    sets = written(single.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("words")))
    different = written(sets.groupBy("words").agg(F.min("query_id").alias("asked")))
    if different.count() <= BLOCK:
        asked = different.select(F.col("asked").alias("query_id"), F.explode("words").alias("term"))
        scored = _in_cells(asked, found, k, boosts)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    else:
        run = Search(different.select(F.col("asked").alias("query_id"), F.array_join("words", " ").alias("text")), found, k, boosts)
        best = run.best(run.completed(written(run.left(run.cutoffs()))))
    answered = written(best.select(F.col("query_id").alias("asked"), "rank", "id", "score"))
    same = sets.join(different, "words").select("query_id", "asked")
    return written(same.join(answered, "asked").select("query_id", "rank", "id", "score"))
