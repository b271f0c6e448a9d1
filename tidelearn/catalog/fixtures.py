"""Row streams derived from the given tables, and the same streams in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelearn.catalog.registry import table

# Orders as labelled vectors: finished orders are class 1, open ones class 0,
# and pending ones carry the sentinel of unlabelled rows.
SENTINEL = -9.0

ORD = """
ord AS (
  SELECT o_orderkey AS seq, o_totalprice / 500000e0 AS x1, CAST(month(o_orderdate) AS DOUBLE) / 12e0 AS x2,
         CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 0e0 ELSE -9e0 END AS label,
         CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 0e0 END AS y
  FROM orders)"""


def windowed(size: str, name: str = "win") -> str:
    return f"""
{name} AS (
  SELECT *, CAST((row_number() OVER (ORDER BY seq) - 1) // ({size}) AS BIGINT) AS window_id FROM ord)"""


def labelled_windows(size: int, name: str = "win", source: str = "ord") -> str:
    """Windows of ``size`` labelled rows; a row without a label is in the window that is open when it arrives."""
    return f"""
{name} AS (
  SELECT *, CAST((count(y) OVER (ORDER BY seq) - CASE WHEN y IS NULL THEN 0 ELSE 1 END) // {size} AS BIGINT) AS window_id FROM {source})"""


def ord_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(status == "F", F.lit(1.0)).when(status == "O", F.lit(0.0)).otherwise(F.lit(SENTINEL)).alias("label"),
        F.array(F.col("o_totalprice") / 500000.0, F.month("o_orderdate").cast("double") / 12.0).alias("features"),
    )


# Line items as a regression: price on quantity and discount, per return flag.
LINES = """
li AS (
  SELECT l_returnflag AS model_id, l_quantity / 50e0 AS x1, l_discount * 10e0 AS x2, l_tax * 10e0 AS x3,
         l_extendedprice / 100000e0 AS y
  FROM lineitem)"""


def line_rows(spark: SparkSession, sf_dir: str, width: int = 2) -> DataFrame:
    cols = [F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0][:width]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model_id"),
        (F.col("l_extendedprice") / 100000.0).alias("label"),
        F.array(*cols).alias("features"),
    )


# Event types in alphabetical order; the rank is the position in this list.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_LIST = "['click', 'error', 'purchase', 'signup', 'view']"


def event_rank(column: str = "event_type"):
    return (F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col(column)) - 1).cast("int")


# Two-dimensional embedding rows.
EMB2 = """
emb2 AS (
  SELECT vec_id AS seq, CAST(label AS DOUBLE) AS label, CAST(embedding[1] AS DOUBLE) AS x1,
         CAST(embedding[2] AS DOUBLE) AS x2
  FROM embeddings)"""


def emb2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"),
        F.col("label").cast("double").alias("label"),
        F.array(e[0].cast("double"), e[1].cast("double")).alias("features"),
    )
