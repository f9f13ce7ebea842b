"""Column expressions for one coupon receipt: discount, distance and calendar.

Everything here is a built-in expression, so a projection over the log stays
inside one generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voucherlens.columns import DISCOUNT, DISTANCE, RECEIVED


def _spend_cut_part(discount: Column, part: int) -> Column:
    return F.split_part(discount, F.lit(":"), F.lit(part))


def is_spend_cut(discount: Column) -> Column:
    """1 for a 'spend:cut' discount, 0 for a plain rate or no coupon."""
    return F.coalesce(discount.contains(":").cast("int"), F.lit(0))


def is_valid_discount(discount: Column) -> Column:
    """Whether a discount is missing, a plain number, or whole numbers ``spend:cut`` with a spend."""
    spend_cut = discount.rlike("^0*[1-9][0-9]*:[0-9]+$")
    number = ~discount.contains(":") & discount.try_cast("double").isNotNull()
    return F.coalesce(spend_cut | number, F.lit(True))


def discount_rate(discount: Column) -> Column:
    """Price factor: 1 without coupon, 1 - cut/spend, or the plain rate."""
    spend = _spend_cut_part(discount, 1).try_cast("double")
    cut = _spend_cut_part(discount, 2).try_cast("double")
    return (
        F.when(discount.isNull(), F.lit(1.0))
        .when(discount.contains(":"), F.lit(1.0) - F.try_divide(cut, spend))
        .otherwise(discount.try_cast("double"))
    )


def spend_threshold(discount: Column) -> Column:
    return F.when(discount.contains(":"), _spend_cut_part(discount, 1).try_cast("int"))


def cut_amount(discount: Column) -> Column:
    return F.when(discount.contains(":"), _spend_cut_part(discount, 2).try_cast("int"))


def weekday(day: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(day) + 1


def is_weekend(day: Column) -> Column:
    return weekday(day).isin(6, 7).cast("int")


def filled(value: Column) -> Column:
    """Missing becomes 0, the rule for every predictor."""
    return F.coalesce(value, F.lit(0))


def coupon_columns(*, month_day: bool = True, weekday_number: bool = True) -> list[Column]:
    """The ``c_`` predictors of one receipt, already zero-filled."""
    discount, received = F.col(DISCOUNT), F.col(RECEIVED)
    columns = [
        F.coalesce(discount_rate(discount), F.lit(0.0)).alias("c_discount_rate"),
        is_spend_cut(discount).alias("c_is_manjian"),
        filled(spend_threshold(discount)).alias("c_man"),
        filled(cut_amount(discount)).alias("c_jian"),
        filled(F.col(DISTANCE)).alias("c_distance"),
    ]
    if weekday_number:
        columns.append(filled(weekday(received)).alias("c_weekday"))
    columns.append(filled(is_weekend(received)).alias("c_weektype"))
    if month_day:
        columns.append(filled(F.dayofmonth(received)).alias("c_monthday"))
    return columns


def one_hot(value: Column, names: list[str], categories: list[int]) -> list[Column]:
    """One 0/1 column per category; a missing value gives 0 everywhere."""
    return [
        F.when(value == k, 1).otherwise(0).alias(name) for name, k in zip(names, categories)
    ]


def distance_one_hot(*, text_order: bool = False) -> list[Column]:
    """``c_dis_0..10``. With ``text_order`` names go by position over the
    categories sorted as text (0, 1, 10, 2, ...), so ``c_dis_2`` holds distance 10.
    """
    categories = list(range(11))
    if text_order:
        categories.sort(key=str)
    return one_hot(F.col(DISTANCE), [f"c_dis_{i}" for i in range(11)], categories)


def weekday_one_hot() -> list[Column]:
    days = list(range(1, 8))
    return one_hot(weekday(F.col(RECEIVED)), [f"c_weekday_{d}" for d in days], days)


def month_day_one_hot() -> list[Column]:
    days = list(range(1, 32))
    return one_hot(F.dayofmonth(F.col(RECEIVED)), [f"c_monthday_{d}" for d in days], days)
