"""Receipt-pattern features of the receipts that are being scored.

They are taken from the scored set itself, not from its history: how many
coupons a user received, on which days, and how often the same one.

Users with ordinary numbers of rows take one exchange on the user, and every
feature is a window over it. Rows of hot users (see ``hot_keys``) are first
reduced to one row per user, coupon and day; the windows left then run over
groups of at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from voucherlens.columns import COUPON, RECEIPT_FEATURES, RECEIVED, USER
from voucherlens.functions.labels import edge_flag, more_than_one
from voucherlens.operators.hot_keys import HotKeys, HotRule, attach, find_hot_keys

COPIES = "copies"
RECEIPT_KEY = [USER, COUPON, RECEIVED]
DAY = "day"


def _by_day(*keys: str) -> WindowSpec:
    """A group in order of days. All windows over the same keys use this order,
    so they share one sort and one pass.
    """
    return Window.partitionBy(*keys).orderBy(DAY)


def _whole(*keys: str) -> WindowSpec:
    return _by_day(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _same_day(*keys: str) -> WindowSpec:
    return _by_day(*keys).rangeBetween(Window.currentRow, Window.currentRow)


def _with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DAY, F.unix_date(RECEIVED))


def _coupon_windows(rows: DataFrame) -> DataFrame:
    """Counts and neighbouring days within (user, coupon).

    The next day is found by a preceding-rows frame in descending order, which
    grows row by row, where a following-rows frame would be rescanned.
    """
    keys = [USER, COUPON]
    earlier = (Window.unboundedPreceding, -1)
    descending = Window.partitionBy(*keys).orderBy(F.col(DAY).desc())
    return rows.select(
        "*",
        F.sum(COPIES).over(_whole(*keys)).alias("same"),
        F.min(DAY).over(_whole(*keys)).alias("first_day"),
        F.max(DAY).over(_whole(*keys)).alias("last_day"),
        F.sum(COPIES).over(_same_day(*keys)).alias("day_same"),
        F.max(DAY).over(_by_day(*keys).rangeBetween(*earlier)).alias("previous_day"),
        F.min(DAY).over(descending.rangeBetween(*earlier)).alias("next_day"),
    )


def _user_windows(rows: DataFrame) -> DataFrame:
    """Counts within the user and within the user's day."""
    return rows.select(
        "*",
        F.sum(COPIES).over(_whole(USER)).alias("total"),
        F.sum(COPIES).over(_same_day(USER)).alias("day_all"),
    )


def _features() -> list[Column]:
    repeated = F.col("same") > 1
    columns = {
        "t_total_coupon_count": F.col("total"),
        "t_same_coupon_count": F.col("same"),
        "t_same_coupon_morethan1": more_than_one(F.col("same")),
        "t_user_receive_same_coupon_lastone": edge_flag(
            F.when(repeated, F.col("last_day") - F.col(DAY))
        ),
        "t_user_receive_same_coupon_firstone": edge_flag(
            F.when(repeated, F.col(DAY) - F.col("first_day"))
        ),
        "t_day_received_all_coupon_num": F.col("day_all"),
        "t_day_received_same_coupon_num": F.col("day_same"),
        "t_day_gap_before": F.coalesce(F.col(DAY) - F.col("previous_day"), F.lit(-1)),
        "t_day_gap_after": F.coalesce(F.col("next_day") - F.col(DAY), F.lit(-1)),
    }
    return [columns[name].alias(name) for name in RECEIPT_FEATURES]


def daily_receipts(rows: DataFrame) -> DataFrame:
    """Number of receipts per user, coupon and day; combines before the shuffle."""
    copies = F.sum(COPIES) if COPIES in rows.columns else F.count("*")
    return rows.groupBy(*RECEIPT_KEY).agg(copies.alias(COPIES))


def ordinary_receipts(rows: DataFrame) -> DataFrame:
    """``rows`` plus the ``t_`` features, for users that fit one task."""
    kept = [c for c in rows.columns if c != COPIES]
    return _coupon_windows(_user_windows(_with_day(rows))).select(*kept, *_features())


def hot_user_receipts(rows: DataFrame) -> DataFrame:
    """One row per receipt key with the ``t_`` features, for hot users.

    The per-day table holds at most one row per hot user and calendar day;
    receipts without a day are a day of their own.
    """
    daily = daily_receipts(rows)
    per_day = daily.groupBy(USER, RECEIVED).agg(F.sum(COPIES).alias("day_all"))
    per_day = per_day.withColumn("total", F.sum("day_all").over(Window.partitionBy(USER)))
    counted = _coupon_windows(_with_day(daily))
    per_day = per_day.withColumnsRenamed({USER: "day_user", RECEIVED: "day_received"})
    same = (F.col(USER) == F.col("day_user")) & F.col(RECEIVED).eqNullSafe(F.col("day_received"))
    joined = counted.join(per_day, same, "left")
    return joined.select(*RECEIPT_KEY, *_features())


def receipt_features(
    receipts: DataFrame, *, rule: HotRule = HotRule(), clustered: bool = False
) -> DataFrame:
    """The ``t_`` features, one row per (user, coupon, day) of ``receipts``.

    Receipts that are stored in buckets of the user (``clustered``) need no exchange.
    """
    keys = receipts.select(*RECEIPT_KEY)
    hot = find_hot_keys(keys, {"user": [USER]}, rule)["user"]
    ordinary = keys.where(~hot.contains()) if hot else keys
    # The exchange on the user serves the daily counts and all windows.
    if not clustered:
        ordinary = ordinary.repartition(USER)
    ordinary = ordinary_receipts(daily_receipts(ordinary))
    if not hot:
        return ordinary
    return ordinary.unionByName(hot_user_receipts(keys.where(hot.contains())))


def attach_to_hot_users(rows: DataFrame, hot_receipts: HotKeys) -> DataFrame:
    """``rows`` of hot users (with their number of copies) plus the ``t_`` features."""
    return attach(rows.drop(COPIES), hot_user_receipts(rows), hot_receipts)


def receipt_days(receipts: DataFrame) -> DataFrame:
    """The days on which a user received a coupon, in order, with their counts.

    Repeated days are run-length coded, which bounds the list by the calendar.
    Coupons received once are left out.
    """
    listed = daily_receipts(receipts).groupBy(USER, COUPON).agg(
        F.sum(COPIES).alias("receive_number"),
        F.sort_array(
            F.collect_list(F.struct(F.date_format(RECEIVED, "yyyyMMdd").alias("day"), COPIES))
        ).alias("days"),
        F.max(RECEIVED).alias("t_max_coupon_time"),
        F.min(RECEIVED).alias("t_min_coupon_time"),
    )
    return listed.where("receive_number > 1").select(
        USER,
        COUPON,
        "receive_number",
        F.array_join("days.day", ":").alias("days"),
        F.array_join(F.col(f"days.{COPIES}").cast("array<string>"), ":").alias("copies"),
        "t_max_coupon_time",
        "t_min_coupon_time",
    )
