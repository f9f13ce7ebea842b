"""The whole way from two CSV logs to stored tables, a model and a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voucherlens.columns import COUPON, RECEIVED, USER
from voucherlens.operators.history import daily_history
from voucherlens.operators.scaling import min_max, written_with_range
from voucherlens.plans import models
from voucherlens.plans.datasets import FeatureOptions, build_dataset
from voucherlens.sources import tables
from voucherlens.sources.log import (
    TEST_SCHEMA, TRAIN_SCHEMA, load_log, read_checked, read_test_log, read_train_log, store_checked, store_log,
)


def ingest(spark: SparkSession, train_csv: str, test_csv: str, folder: str, *, keep_rejects: bool = False) -> None:
    """Read both CSV logs once and store them typed.

    A row that does not parse fails the read, or goes to a reject table with its
    reason if ``keep_rejects`` is set.
    """
    if keep_rejects:
        for name, path, schema in (("train", train_csv, TRAIN_SCHEMA), ("test", test_csv, TEST_SCHEMA)):
            store_checked(read_checked(spark, path, schema), f"{folder}/log/{name}", f"{folder}/rejects/{name}")
        return
    store_log(read_train_log(spark, train_csv), f"{folder}/log/train")
    store_log(read_test_log(spark, test_csv), f"{folder}/log/test")


def build_tables(
    spark: SparkSession, folder: str, options: FeatureOptions = FeatureOptions()
) -> None:
    """Feature tables 1, 2 and 3 from the stored logs.

    The history of all three is summed from one table of counts by day, which is
    stored beside them and read again when a day is added.
    """
    train = load_log(spark, f"{folder}/log/train")
    test = load_log(spark, f"{folder}/log/test")
    tables.store_days(daily_history(train, mean_discount=options.mean_discount), f"{folder}/days")
    daily = tables.load_days(spark, f"{folder}/days")
    for number in (1, 2, 3):
        table = build_dataset(train, number, test=test, options=options, daily=daily)
        tables.write_dataset(table, f"{folder}/dataset{number}")


def stored_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(tables.read_dataset(spark, f"{folder}/dataset{n}") for n in (1, 2, 3))


def linear_model(spark: SparkSession, folder: str, **settings) -> DataFrame:
    """Fit the linear grid, save the model, return its quality report."""
    train, valid, _ = stored_tables(spark, folder)
    fitted = models.logistic_grid(train, valid, **settings)
    tables.save_model(fitted.model, f"{folder}/linear_model")
    return models.quality_report(fitted, valid)


def tree_submission(
    spark: SparkSession, folder: str, *, kind: str = "tuned", rounds: int | None = None
) -> DataFrame:
    """Fit trees, save the model, write the submission, return the quality report.

    ``watched`` trees stop early on table 2, and their scores are scaled to
    [0, 1] and sorted by coupon; the others keep plain probabilities.
    """
    train, valid, scored = stored_tables(spark, folder)
    watched = kind == "watched"
    if watched:
        fitted = models.fit_watched_trees(train, valid, rounds=rounds)
    else:
        fitted = models.fit_trees(train, valid, kind=kind, rounds=rounds)
    tables.save_model(fitted.model, f"{folder}/{kind}_model")
    scores = models.score(fitted.model, scored)
    if watched:
        # Scored once: the range is taken from the stored scores.
        scores, bounds = written_with_range(scores.select(USER, COUPON, RECEIVED, "score"), "score", "scores")
        table = tables.sorted_submission(min_max(scores, "score", bounds))
    else:
        table = tables.submission(scores)
    tables.write_submission(table, f"{folder}/{kind}_submission")
    return models.quality_report(fitted, valid)
