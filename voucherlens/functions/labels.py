"""Redemption label and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voucherlens.columns import BOUGHT, COUPON, LABEL, LABEL_DAYS, RECEIVED


def days_to_purchase() -> Column:
    """Days from receipt to purchase; negative when the purchase came first."""
    return F.datediff(F.col(BOUGHT), F.col(RECEIVED))


def redemption_label(*, inclusive: bool = True) -> Column:
    """-1 without a receipt, 1 when bought within 15 days of it, else 0.

    There is no lower bound: a purchase before the receipt counts as 1.
    """
    gap = days_to_purchase()
    in_time = gap <= LABEL_DAYS if inclusive else gap < LABEL_DAYS
    return (
        F.when(F.col(RECEIVED).isNull(), -1).when(in_time, 1).otherwise(0).alias(LABEL)
    )


def binary_label(label: Column) -> Column:
    """-1 (no receipt) counted as not redeemed."""
    return F.when(label == -1, 0).otherwise(label)


def is_bought() -> Column:
    return F.col(BOUGHT).isNotNull()


def is_received() -> Column:
    return F.col(RECEIVED).isNotNull()


def is_redeemed() -> Column:
    return is_bought() & is_received()


def is_plain_purchase() -> Column:
    return is_bought() & F.col(COUPON).isNull()


def is_unused() -> Column:
    return is_received() & F.col(BOUGHT).isNull()


def ratio(part: Column, whole: Column) -> Column:
    """Share as a double; 0 when either side is missing or the divisor is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def more_than_one(count: Column) -> Column:
    return (count > 1).cast("int")


def edge_flag(offset: Column) -> Column:
    """1 at the edge (offset 0), 0 away from it, -1 when there is no offset."""
    return F.when(offset == 0, 1).when(offset > 0, 0).otherwise(-1)
