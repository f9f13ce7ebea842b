"""A receipt log derived from the ``lineitem`` and ``orders`` tables.

The test tables hold no coupon log, so one is computed from every order line;
its size grows with theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voucherlens.columns import BOUGHT, RECEIVED

# First day of the log, last day of the training part, and the
# days of the scored part.
FIRST_DAY = "2016-01-01"
TRAIN_END = "2016-06-30"
TEST_DAYS = ("2016-07-01", "2016-07-30")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, with coupon number, distance and both days."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("User_id"),
        F.expr("l_suppkey % 20").alias("Merchant_id"),
        F.expr("(l_suppkey % 20) * 2 + l_linenumber % 2").alias("cid"),
        F.expr("CAST((o_custkey * 7 + l_suppkey * 3) % 12 AS INT)").alias("dist"),
        F.expr("l_discount = 0").alias("nocoupon"),
        F.expr("l_returnflag = 'R' AND l_discount <> 0").alias("unused"),
        F.expr(f"date_add(DATE '{FIRST_DAY}', CAST(o_orderkey % 212 AS INT))").alias("rec"),
        F.expr(
            f"date_add(DATE '{FIRST_DAY}', CAST(o_orderkey % 212 + l_partkey % 45 - 5 AS INT))"
        ).alias("use_d"),
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text, with ``null`` for missing values, as a CSV file holds it."""
    return _facts(spark, sf_dir).selectExpr(
        "User_id",
        "Merchant_id",
        "CASE WHEN nocoupon THEN 'null' ELSE CAST(cid AS STRING) END AS Coupon_id",
        "CASE WHEN nocoupon THEN 'null' WHEN cid % 4 = 0 THEN '0.9' WHEN cid % 4 = 1 THEN '200:20'"
        " WHEN cid % 4 = 2 THEN '30:5' ELSE '0.85' END AS Discount_rate",
        "CASE WHEN dist = 11 THEN 'null' ELSE CAST(dist AS STRING) END AS Distance",
        "CASE WHEN nocoupon THEN 'null' ELSE date_format(rec, 'yyyyMMdd') END AS Date_received",
        "CASE WHEN unused THEN 'null' ELSE date_format(use_d, 'yyyyMMdd') END AS Date",
    )


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed log, built without the detour through text."""
    return _facts(spark, sf_dir).selectExpr(
        "User_id",
        "Merchant_id",
        "CASE WHEN NOT nocoupon THEN CAST(cid AS STRING) END AS Coupon_id",
        "CASE WHEN nocoupon THEN NULL WHEN cid % 4 = 0 THEN '0.9' WHEN cid % 4 = 1 THEN '200:20'"
        " WHEN cid % 4 = 2 THEN '30:5' ELSE '0.85' END AS Discount_rate",
        "NULLIF(dist, 11) AS Distance",
        "CASE WHEN NOT nocoupon THEN rec END AS Date_received",
        "CASE WHEN NOT unused THEN use_d END AS Date",
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = F.col(RECEIVED)
    return full_log(spark, sf_dir).where(
        received.isNull() | (received <= F.lit(TRAIN_END).cast("date"))
    )


def test_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = (F.lit(day).cast("date") for day in TEST_DAYS)
    return full_log(spark, sf_dir).where(F.col(RECEIVED).between(first, last)).drop(BOUGHT)
