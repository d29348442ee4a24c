"""Decision tables derived from the given tables, as DataFrames and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The attributes of ``orders`` decisions and their privileged values.
PRIVILEGED = {"r_name": "EUROPE", "seg": "BUILDING", "prio": "5-LOW"}
ORDERS_SQL = """
audit_orders AS (
  SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS actual,
         CASE WHEN o_totalprice + (CASE WHEN o_orderpriority = '1-URGENT' THEN 60000 ELSE 0 END)
                                + (CASE WHEN r_name = 'ASIA' THEN -80000 ELSE 0 END) > 180000 THEN 1 ELSE 0 END AS predicted,
         o_totalprice + (CASE WHEN o_orderpriority = '1-URGENT' THEN 60000 ELSE 0 END)
                      + (CASE WHEN r_name = 'ASIA' THEN -80000 ELSE 0 END) AS score,
         nullif(c_mktsegment, 'FURNITURE') AS seg, r_name, n_name, o_orderpriority AS prio, o_totalprice AS price, c_acctbal AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
DOCUMENTS_SQL = """
audit_documents AS (
  SELECT doc_id AS record_id, quality AS actual, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted, toxic, lang, source, n_chars
  FROM documents JOIN labels USING (doc_id))"""
RECORDS_SQL = """
audit_records AS (
  SELECT conv_id * 1000 + turn AS record_id, turn % 4 + 1 AS cycle, CASE conv_id % 3 WHEN 0 THEN 'mortgage' WHEN 1 THEN 'credit' ELSE 'lending' END AS dataset,
         CASE turn % 3 WHEN 0 THEN 'sex' WHEN 1 THEN 'race' ELSE 'age' END AS attribute,
         CASE (conv_id + turn) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'High risk' WHEN 2 THEN 'MODERATE (borderline)' WHEN 3 THEN 'low' ELSE '' END AS severity,
         text, CAST((length(text) * 7 + turn) % 101 AS DOUBLE) AS total_score, CAST(length(text) % 41 AS DOUBLE) AS completeness, CAST(length(text) % 21 AS DOUBLE) AS agreement,
         length(text) % 7 = 0 AS refused, length(text) AS output_tokens, conv_id % 500 + 100 AS input_tokens, length(text) / 100.0 AS seconds
  FROM conversations WHERE role = 'assistant')"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions, with the customer's region, nation and segment as attributes (dimension joins)."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    score = F.col("o_totalprice") + F.when(F.col("o_orderpriority") == "1-URGENT", 60000).otherwise(0) + F.when(F.col("r_name") == "ASIA", -80000).otherwise(0)
    return rows.select(
        F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") != "F", 1).otherwise(0).alias("actual"), F.when(score > 180000, 1).otherwise(0).alias("predicted"), score.alias("score"),
        F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("seg"), "r_name", "n_name", F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as decisions: quality against length."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return rows.select(F.col("doc_id").alias("record_id"), F.col("quality").alias("actual"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"), "toxic", "lang", "source", "n_chars")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as machine-written audit records."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    c, t, size = F.col("conv_id"), F.col("turn"), F.length("text")
    return rows.select(
        (c * 1000 + t).alias("record_id"), (t % 4 + 1).alias("cycle"), pick(c % 3, "mortgage", "credit", "lending").alias("dataset"), pick(t % 3, "sex", "race", "age").alias("attribute"),
        pick((c + t) % 5, "critical", "High risk", "MODERATE (borderline)", "low", "").alias("severity"), "text", ((size * 7 + t) % 101).cast("double").alias("total_score"),
        (size % 41).cast("double").alias("completeness"), (size % 21).cast("double").alias("agreement"), (size % 7 == 0).alias("refused"), size.alias("output_tokens"), (c % 500 + 100).alias("input_tokens"), (size / 100.0).alias("seconds"),
    )
