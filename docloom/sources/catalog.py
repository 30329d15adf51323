"""Catalogue: seven text columns, checked row by row; bad rows go to a table of rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and categories.
COLUMNS = ["document_id", "title", "year", "category", "source_url", "filename", "summary"]
RECORD = "_record"
CATEGORIES = ["acts", "judgments", "pov", "tax"]


def _names(spark: SparkSession, path: str) -> list[str]:
    header = spark.read.option("header", False).csv(path).limit(1).first()
    names = [] if header is None else [(v or "").lstrip("\ufeff") for v in header]
    if sorted(names) != sorted(COLUMNS):
        raise ValueError(f"catalogue header must be {COLUMNS}, found {names}")
    return names


def read(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue CSV as text columns. Raises ValueError unless the header is exactly the seven columns, each once; a row with too many or too few fields fails."""
    shape = ", ".join(f"{n} string" for n in _names(spark, path))
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).schema(shape).csv(path)
    if rows.isEmpty():
        raise ValueError("the catalogue has no rows")
    return rows.select(*COLUMNS)


def parted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, year as int; rejects(record, reason)) of the catalogue CSV, whose header must be as for read().

    A row with too many or too few fields, or one that breaks a rule, is a reject with its whole record; the others go on.
    """
    shape = ", ".join(f"{n} string" for n in [*_names(spark, path), RECORD])
    rows = spark.read.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", RECORD).schema(shape).csv(path)
    marked = checked(rows).withColumn("reason", F.when(F.col(RECORD).isNotNull(), "wrong number of fields").otherwise(F.col("reason")))
    record = F.coalesce(F.col(RECORD), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS]))
    return marked.filter("reason is null").select(*COLUMNS), marked.filter("reason is not null").select(record.alias("record"), "reason")


def stripped(x: Column) -> Column:
    """Not null, not empty, no Unicode space at either end."""
    return F.coalesce(x.rlike(r"(?Us)^\S(.*\S)?$"), F.lit(False))


def positive(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9]+$") & (x.try_cast("decimal(38,0)") > 0), F.lit(False))


def reason(categories: list[str] | None = None) -> Column:
    """The first rule that a row breaks, else null."""
    name = F.col("filename")
    out = None
    checks = [(f"{c} not stripped text", stripped(F.col(c))) for c in ("document_id", "title")]
    checks += [("year not positive", positive(F.col("year"))), ("category unknown", F.coalesce(F.col("category").isin(categories or CATEGORIES), F.lit(False))), ("source_url not stripped text", stripped(F.col("source_url")))]
    checks += [("filename not a plain name", stripped(name) & ~name.rlike(r"[/\\]") & name.rlike(r"^[^.].*\.[^.]+$|^\..*\.[^.]+$")), ("summary not stripped text", F.coalesce(F.col("summary"), F.lit("")).eqNullSafe("") | stripped(F.col("summary")))]
    for text, holds in checks:
        out = F.when(~holds, text) if out is None else out.when(~holds, text)
    return out


def checked(rows: DataFrame) -> DataFrame:
    """rows with year as int, an empty summary as null, and reason (null for sound rows)."""
    return rows.withColumn("reason", reason()).withColumn("year", F.when(positive(F.col("year")), F.col("year").try_cast("int"))).withColumn("summary", F.nullif("summary", F.lit("")))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that stand in several rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def join_files(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """files(category, filename) with their catalogue row; matched tells whether there is one (a miss is an error for the caller).

    A file stays one row: of several catalogue rows under its name it gets the first by document_id, then by the other columns.
    """
    first = F.min(F.struct("document_id", "title", "year", "source_url", "summary")).alias("r")
    known = catalogue.groupBy("category", "filename").agg(first).select("category", "filename", "r.*", F.lit(True).alias("matched"))
    return files.join(known, ["category", "filename"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
