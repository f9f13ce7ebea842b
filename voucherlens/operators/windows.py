"""Date windows: the receipts to score and the history that precedes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voucherlens.columns import (
    BOUGHT, DATASET_WINDOWS, HISTORY_1_OVERLAP_END, HISTORY_WINDOWS, RECEIVED,
)


def _within(column: str, first: str, last: str) -> Column:
    return F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def in_dataset_window(number: int) -> Column:
    return _within(RECEIVED, *DATASET_WINDOWS[number])


def in_history_window(number: int, *, overlap: bool = False) -> Column:
    first, last = HISTORY_WINDOWS[number]
    return _within(BOUGHT, first, last) | (
        F.col(BOUGHT).isNull() & _within(RECEIVED, first, unused_end(number, overlap=overlap))
    )


def unused_end(number: int, *, overlap: bool = False) -> str:
    """The last day of a history window for receipts never used."""
    return HISTORY_1_OVERLAP_END if overlap and number == 1 else HISTORY_WINDOWS[number][1]


def dataset_window(log: DataFrame, number: int) -> DataFrame:
    """Receipts of a closed range of days."""
    return log.where(in_dataset_window(number))


def history_window(log: DataFrame, number: int, *, overlap: bool = False) -> DataFrame:
    """Purchases of a closed range of days, and receipts of those days never used.

    Written as an OR of plain comparisons, so that the scan can push it down.
    ``overlap`` widens the unused receipts of window 1 into dataset 1.
    """
    return log.where(in_history_window(number, overlap=overlap))
