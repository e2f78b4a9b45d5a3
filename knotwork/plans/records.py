"""Record views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: language as country, first line as name, all that follows as address; src 0 is the reference."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.coalesce("text", F.lit(""))
    head = F.substring_index(t, "\n", 1)
    return d.select(
        F.col("doc_id").alias("rec_id"), (F.col("doc_id") % 3).cast("int").alias("src"), F.col("lang").alias("country"), head.alias("raw_name"), F.substr(t, F.length(head) + 2).alias("raw_addr")
    )


#: Synthetic businesses from customer keys: the same expression text serves Spark and SQL.
BUSINESS = """
SELECT c_custkey AS k, kind,
  CASE kind WHEN 0 THEN concat(a, ' ', b, ' ', l) WHEN 1 THEN concat(a, ' ', b) WHEN 2 THEN concat(b, ' ', a, ' sarl') ELSE concat(a, ' ', b, ' groupe') END AS name,
  concat(CAST(CASE WHEN kind = 3 THEN h + 7 ELSE h END AS VARCHAR(20)), ' ', street) AS nums_street,
  CAST(CASE WHEN kind = 3 THEN h + 7 ELSE h END AS VARCHAR(20)) AS nums
FROM (SELECT c_custkey, kind, split_part('acme,nova,orion,delta,vega,lumen,terra,atlas', ',', CAST(c_custkey % 8 + 1 AS INT)) AS a,
  split_part('foods,tools,media,textile,motors,books,garden', ',', CAST(c_custkey % 7 + 1 AS INT)) AS b,
  split_part('inc,ltd,sarl', ',', CAST(c_custkey % 3 + 1 AS INT)) AS l, c_custkey * 37 % 900 + 1 AS h,
  split_part('rue haute,oak street,main road,quai nord,hill lane', ',', CAST(c_custkey % 5 + 1 AS INT)) AS street
  FROM customer CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) kinds WHERE kind < 3 OR c_custkey % 4 = 3) x
"""


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, kind, name, nums_street, nums): kind 0 the reference, 1 and 2 variants of it, 3 a decoy with a shifted number."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(BUSINESS)


def business_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant with its reference: (o, s, name_o, name_s, nums_o, nums_s), o = 10 k + kind."""
    b = businesses(spark, sf_dir)
    o = b.where("kind > 0").select((F.col("k") * 10 + F.col("kind")).alias("o"), F.col("k").alias("s"), F.col("name").alias("name_o"), F.col("nums").alias("nums_o"))
    return o.join(b.where("kind = 0").select(F.col("k").alias("s"), F.col("name").alias("name_s"), F.col("nums").alias("nums_s")), "s")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.normalized(documents(spark, sf_dir))
