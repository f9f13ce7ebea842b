"""Stored feature tables, submissions and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voucherlens.columns import COUPON, DATE_TEXT, RECEIVED, USER
from voucherlens.operators.history import HISTORY_DAY

#: Files of one stored day.
DAY_FILES = 8


def write_dataset(df: DataFrame, path: str) -> None:
    """Store a feature table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def store_days(daily: DataFrame, path: str) -> None:
    """Store counts by day, a folder for each day; days that are there already are replaced.

    A new day of the log costs its own folder, and the folders of earlier receipts
    that it turns into purchases.
    """
    # Rows of a day lie in a bounded number of files, however many tasks write.
    dealt = daily.repartition(HISTORY_DAY, F.pmod(F.xxhash64(USER), F.lit(DAY_FILES)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HISTORY_DAY).parquet(path)


def load_days(spark: SparkSession, path: str) -> DataFrame:
    """Counts by day; a window reads the folders of its days only."""
    return spark.read.parquet(path).withColumn(HISTORY_DAY, F.col(HISTORY_DAY).cast("date"))


def store_buckets(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> None:
    """Store a table hashed into buckets by ``keys`` and sorted within them.

    Joins, groups and windows on the keys then take it as it lies, without an exchange.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def load_buckets(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def export_csv(df: DataFrame, path: str) -> None:
    """A feature table as CSV with a header; there is no index column."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("dateFormat", DATE_TEXT)
        .csv(path)
    )


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("dateFormat", DATE_TEXT)
        .csv(path)
    )


def submission(scored: DataFrame, *, score: str = "score") -> DataFrame:
    """Keys and score of every scored receipt, the day as text."""
    return scored.select(
        USER, COUPON, F.date_format(RECEIVED, DATE_TEXT).alias(RECEIVED), F.col(score).alias("score")
    )


def sorted_submission(scored: DataFrame, *, score: str = "score") -> DataFrame:
    """By coupon and rising score. User and day follow as further sort keys, so
    a coupon with very many equal scores still spreads over several ranges.
    """
    return submission(scored, score=score).orderBy(COUPON, "score", USER, RECEIVED)


def write_submission(table: DataFrame, path: str) -> None:
    """CSV without header or index."""
    table.write.mode("overwrite").option("header", False).csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """A submission again; days stay text, a row that does not fit fails the read."""
    schema = f"{USER} bigint, {COUPON} string, {RECEIVED} string, score double"
    return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
