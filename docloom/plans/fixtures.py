"""The derived legal corpus: one SQL text that Spark and other engines read alike (input: a view or table named part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = """SELECT concat('D', lpad(CAST(p_partkey AS STRING), 6, '0')) AS document_id,
 CASE p_partkey % 4 WHEN 0 THEN 'judgments' WHEN 1 THEN 'acts' WHEN 2 THEN 'pov' ELSE 'tax' END AS category,
 concat('Matter of ', p_name) AS title,
 concat('https://docs.example.org/', CAST(p_partkey AS STRING)) AS source_url,
 concat(
  CASE CAST(floor(p_partkey / 4) AS INT) % 6
   WHEN 0 THEN 'UNITED STATES TAX COURT'
   WHEN 1 THEN 'UNITED STATES COURT OF APPEALS FOR THE NINTH CIRCUIT'
   WHEN 2 THEN 'UNITED STATES DISTRICT COURT FOR THE SOUTHERN DISTRICT OF OHIO CIVIL DOCKET'
   WHEN 3 THEN 'In the courts of the STATE OF Texas, sitting'
   WHEN 4 THEN 'SUPREME COURT OF THE UNITED STATES'
   ELSE 'No forum is named here.' END, chr(10),
  'PART ', CASE p_size % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END, ' Background', chr(10),
  'Before Judge ', CASE p_partkey % 3 WHEN 0 THEN 'Amy Poe' WHEN 1 THEN 'Poe' ELSE concat('D', chr(39), 'Arcy Vance') END,
  '. ', CASE WHEN p_partkey % 5 = 0 THEN 'POE, J. ' ELSE '' END,
  'Acme Widget Inc. sued the Commissioner of Internal Revenue.', chr(10),
  'SECTION ', CAST(p_size AS STRING), '.', CAST(p_partkey % 7 AS STRING), ' Facts', chr(10),
  'Under 26 U.S.C. ', chr(167), ' ', CAST(p_partkey % 900 + 1 AS STRING), '(a) and Treas. Reg. ', chr(167), ' 1.',
  CAST(p_size AS STRING), '-1 the taxpayer owed a penalty. ',
  repeat(concat('The ', p_name, ' of ', p_brand, ' was sold. '), p_size), chr(10), chr(10),
  chr(167), ' ', CAST(p_size AS STRING), ' Holding', chr(10),
  CASE WHEN p_partkey % 2 = 0 THEN 'The appeal on the deficiency is dismissed. ' ELSE 'The audit stands. ' END,
  repeat(concat(p_type, ' '), p_size * 3), chr(10),
  '12', chr(10), 'Costs follow the event.') AS raw_text
FROM part"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived corpus with page_offsets every 500 characters."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # Light rows become heavy texts: a file of one partition is dealt out before.
    if len(part.inputFiles()) < spark.sparkContext.defaultParallelism:
        part = part.repartition(spark.sparkContext.defaultParallelism)
    rows = spark.sql(CORPUS.replace("FROM part", "FROM {part}"), part=part)
    size = F.length("raw_text")
    pages = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 500).cast("int")), lambda i: F.struct((i * 500).alias("start"), F.least((i + 1) * 500, size).alias("end")))
    return rows.withColumn("page_offsets", pages)
