"""Files in category folders, page tables and intrinsic metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Intrinsic metadata keys, in order, and their names.
INTRINSIC = [("title", "title"), ("author", "author"), ("subject", "subject"), ("keywords", "keywords"), ("creator", "creator"), ("producer", "producer"), ("creationDate", "creation_date"), ("modDate", "modification_date"), ("format", "format")]


def is_pdf(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)) == ".pdf"


def scan(spark: SparkSession, folders: dict[str, str], content: bool = True) -> DataFrame:
    """(category, filename, path, content_hash) of the PDF files that lie directly in each category's folder.

    A missing folder fails the read. Without content only paths are listed and nothing is read.
    """
    out = None
    for category, folder in sorted(folders.items()):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).filter(is_pdf(F.col("path")))
        hashed = F.sha2("content", 256) if content else F.lit(None).cast("string")
        rows = found.select(F.lit(category).alias("category"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", hashed.alias("content_hash"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no category folders")
    return out


def candidates(files: DataFrame, most: int | None = None) -> DataFrame:
    """files(category, filename) in order of category and name; the first most of them, if given."""
    ordered = files.orderBy("category", "filename")
    return ordered if most is None else ordered.limit(most)


def list_files(spark: SparkSession, folder: str, extension: str | None = None) -> DataFrame:
    """Paths directly in a folder, by name; extension without regard to case."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return (found if extension is None else found.filter(F.lower("path").endswith(extension.lower()))).orderBy("path")


class Encrypted(Exception):
    """Raised by a decoder for a file that needs a password."""


def decode(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text, error) of files(path, content): the decoder gives a file's page texts, and its failure one error row, whose reason is 'encrypted' where it raised Encrypted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, i + 1, text, None) for i, text in enumerate(pages_of(content))]
                except Encrypted:
                    rows = [(path, None, None, "encrypted")]
                except Exception as e:  # one bad file must not fail the run
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def page_offsets(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """pages(key, page, text) with start and end of each page in the text of all pages without separator."""
    order = Window.partitionBy(key).orderBy("page")
    size = F.length(F.coalesce("text", F.lit("")))
    return pages.withColumn("end", F.sum(size).over(order).cast("int")).withColumn("start", (F.col("end") - size).cast("int"))


def joined_pages(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, raw_text, page_offsets, page_count), pages in order."""
    one = F.struct("page", "start", "end", F.coalesce("text", F.lit("")).alias("text"))
    whole = page_offsets(pages, key).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("p"))
    return whole.select(key, F.array_join(F.col("p.text"), "").alias("raw_text"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("page_offsets"), F.size("p").alias("page_count"))


def intrinsic(metadata: Column) -> Column:
    """Map of raw metadata to an array of (key, value) under the fixed names and order; null and empty values dropped."""
    pairs = F.array(*[F.struct(F.lit(new).alias("key"), F.element_at(metadata, F.lit(old)).alias("value")) for old, new in INTRINSIC])
    return F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")
