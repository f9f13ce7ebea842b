"""Small logs for tests."""

from __future__ import annotations

import contextlib
import io
import random

from pyspark.sql import DataFrame, SparkSession

from voucherlens.sources.log import typed_log

RAW_COLUMNS = [
    "User_id", "Merchant_id", "Coupon_id", "Discount_rate", "Distance", "Date_received", "Date",
]


def log_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A typed log from rows of text in raw column order."""
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    return typed_log(spark.createDataFrame([tuple(map(str, r)) for r in rows], schema))


def random_rows(seed: int, n: int = 400, *, hot_share: float = 0.4) -> list[tuple]:
    """Raw rows in which one user, merchant and coupon hold a large share."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rng.random() < hot_share
        user = 1 if hot else rng.randint(2, 30)
        merchant = 1 if hot and rng.random() < 0.8 else rng.randint(2, 9)
        coupon = merchant * 2 + (0 if hot else rng.randint(0, 1))
        received = rng.choice(["null", *[f"201605{d:02d}" for d in range(15, 32)]])
        if hot and received == "null":
            received = "20160520"
        bought = rng.choice(["null", *[f"201605{d:02d}" for d in range(12, 32)]])
        if received == "null":
            rows.append((user, merchant, "null", "null", rng.choice(["null", 0, 3]), "null",
                         bought if bought != "null" else "20160530"))
            continue
        rows.append((user, merchant, coupon, rng.choice(["0.9", "200:20", "30:5"]),
                     rng.choice(["null", *range(11)]), received, bought))
    # Rows that occur twice and three times.
    return rows + rows[:20] + rows[:10]


def plan_of(df: DataFrame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
