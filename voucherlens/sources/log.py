"""The receipt and purchase log: schemas, CSV source, and typing of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voucherlens.columns import (
    BOUGHT, COUPON, DATE_TEXT, DISCOUNT, DISTANCE, MERCHANT, MISSING_TEXT, RECEIVED, USER,
)
from voucherlens.functions.coupon import is_valid_discount
from voucherlens.session import written

REASON, LINE = "reason", "line"

TEST_SCHEMA = T.StructType([
    T.StructField(USER, T.LongType()),
    T.StructField(MERCHANT, T.LongType()),
    T.StructField(COUPON, T.StringType()),
    T.StructField(DISCOUNT, T.StringType()),
    T.StructField(DISTANCE, T.IntegerType()),
    T.StructField(RECEIVED, T.DateType()),
])
TRAIN_SCHEMA = T.StructType([*TEST_SCHEMA.fields, T.StructField(BOUGHT, T.DateType())])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", MISSING_TEXT)
        .option("dateFormat", DATE_TEXT)
        # Headers must name the columns in order, and a malformed value fails the read.
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """Receipts and purchases, with the purchase date."""
    return _with_strict_discount(_read_csv(spark, path, TRAIN_SCHEMA))


def read_test_log(spark: SparkSession, path: str) -> DataFrame:
    """Receipts to be scored; there is no purchase date."""
    return _with_strict_discount(_read_csv(spark, path, TEST_SCHEMA))


def _with_strict_discount(log: DataFrame) -> DataFrame:
    """The log, or an error at a discount that is neither a number nor spend:cut."""
    discount = F.col(DISCOUNT)
    wrong = F.raise_error(F.concat(F.lit(f"malformed {DISCOUNT}: "), discount)).cast("string")
    return log.withColumn(DISCOUNT, F.when(is_valid_discount(discount), discount).otherwise(wrong))


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV log whose malformed rows are kept apart instead of failing the read.

    Typed columns, and ``reason``: NULL, or the columns whose text does not fit, or
    ``columns`` where their number does not. ``line`` keeps the text of such a row.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(LINE, T.StringType())])
    raw = (
        spark.read.schema(texts)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", LINE)
        .csv(path)
    )
    return check_text(raw, schema)


def check_text(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """A log held as text, typed, with ``reason`` and ``line`` as in :func:`read_checked`."""
    typed, wrong = [], []
    for field in schema:
        value = F.nullif(F.col(field.name).cast("string"), F.lit(MISSING_TEXT))
        cast = _lenient(value, field.dataType)
        fits = is_valid_discount(value) if field.name == DISCOUNT else value.isNull() | cast.isNotNull()
        typed.append(cast.alias(field.name))
        wrong.append(F.when(~fits, F.lit(field.name)))
    broken = F.col(LINE) if LINE in raw.columns else F.lit(None).cast("string")
    names = F.array_join(F.array_compact(F.array(*wrong)), ",")
    reason = F.when(broken.isNotNull(), F.lit("columns")).otherwise(F.nullif(names, F.lit("")))
    text = F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema])
    line = F.when(reason.isNotNull(), F.coalesce(broken, text))
    return raw.select(*typed, reason.alias(REASON), line.alias(LINE))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNull()).drop(REASON, LINE)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNotNull()).select(REASON, LINE)


def store_checked(checked: DataFrame, log_path: str, reject_path: str) -> DataFrame:
    """Store good rows as the log and the others as the reject table; returns counts by reason.

    The text is read and checked once.
    """
    checked = written(checked, "checked-log")
    store_log(accepted(checked), log_path)
    rejected(checked).write.mode("overwrite").parquet(reject_path)
    return checked.sparkSession.read.parquet(reject_path).groupBy(REASON).agg(F.count("*").alias("n"))


def _lenient(text: Column, kind: T.DataType) -> Column:
    """The typed value, NULL where the text does not fit."""
    if isinstance(kind, T.DateType):
        return F.try_to_date(text, DATE_TEXT)
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def _strict(text: Column, typed: Column, name: str) -> Column:
    """The typed value, or an error where there is text that does not fit."""
    wrong = F.raise_error(F.concat(F.lit(f"malformed {name}: "), text)).cast("string")
    return F.when(text.isNotNull() & typed.isNull() & wrong.isNull(), None).otherwise(typed)


def typed_log(raw: DataFrame) -> DataFrame:
    """Type a log held as text, where the word ``null`` marks a missing value.

    Any other value that does not fit its type fails the job.
    """
    text = {c: F.nullif(F.col(c).cast("string"), F.lit(MISSING_TEXT)) for c in raw.columns}
    typed = []
    for field in TRAIN_SCHEMA:
        if field.name not in raw.columns:
            continue
        value = text[field.name]
        if not isinstance(field.dataType, T.StringType):
            value = _strict(value, _lenient(value, field.dataType), field.name)
        typed.append(value.alias(field.name))
    log = raw.select(*typed)
    return _with_strict_discount(log) if DISCOUNT in log.columns else log


def store_log(log: DataFrame, path: str) -> None:
    """Store a typed log as Parquet, so that each window reads columns, not text.

    Rows are sorted within their files, without a shuffle: a day range then
    skips most row groups by their statistics.
    """
    days = [c for c in (RECEIVED, BOUGHT) if c in log.columns]
    log.sortWithinPartitions(*days).write.mode("overwrite").parquet(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored training log, or test log where it has no purchase date."""
    return spark.read.parquet(path)
