"""Queries over the test tables, one per operator or report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from voucherlens.columns import (
    BOUGHT, COUPON, DISCOUNT, DISTANCE, LABEL, MERCHANT, RECEIPT_FEATURES, RECEIVED, USER,
    USER_COUPON_FEATURES, predictors,
)
from voucherlens.functions.coupon import (
    distance_one_hot, month_day_one_hot, weekday_one_hot,
)
from voucherlens.functions.labels import binary_label, redemption_label
from voucherlens.operators import history as hist
from voucherlens.operators import ranking, receipts, scaling, summary
from voucherlens.operators.hot_keys import HotRule
from voucherlens.operators.windows import dataset_window, history_window, in_dataset_window, in_history_window
from voucherlens.plans import datasets as plans
from voucherlens.plans import models
from voucherlens.plans.datasets import FeatureOptions
from voucherlens.session import run_dir, written
from voucherlens.sources import tables
from voucherlens.sources.derived_log import raw_log, test_log, train_log
from voucherlens.sources.log import (
    TRAIN_SCHEMA, load_log, read_checked, read_train_log, store_checked, store_log, typed_log,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Plain types for comparing engines: longs, doubles to 6 places, text days.

    A missing day, coupon, discount or distance is written ``null``, as in the
    raw log.
    """
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            column = F.coalesce(F.date_format(column, "yyyyMMdd"), F.lit("null"))
        elif field.name == DISTANCE:
            column = F.coalesce(column.cast("string"), F.lit("null"))
        elif isinstance(field.dataType, T.StringType):
            column = F.coalesce(column, F.lit("null"))
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- log, parsing and labels -------------------------------------------------


@query("log_typed")
def log_typed(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(typed_log(raw_log(spark, sf)))


def _raw_csv(raw: DataFrame) -> str:
    path = f"{run_dir(raw.sparkSession)}/csv-{uuid.uuid4().hex}"
    raw.select(*TRAIN_SCHEMA.fieldNames()).write.option("header", True).csv(path)
    return path


@query("csv_round_trip")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as CSV, read typed, stored as Parquet and read again."""
    path = f"{run_dir(spark)}/log-{uuid.uuid4().hex}"
    store_log(read_train_log(spark, _raw_csv(raw_log(spark, sf))), path)
    return comparable(load_log(spark, path))


def _damaged(raw: DataFrame) -> DataFrame:
    """The raw log with text that does not fit in some users' rows."""
    user = F.col(USER) % 50
    damage = {DISCOUNT: (7, "20:x"), DISTANCE: (8, "far"), RECEIVED: (9, "20161340"), MERCHANT: (7, "m1")}
    return raw.withColumns({c: F.when(user == k, text).otherwise(F.col(c).cast("string")) for c, (k, text) in damage.items()})


@query("rejects")
def rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a damaged CSV log by the reason they were set apart, and those accepted."""
    base = f"{run_dir(spark)}/checked-{uuid.uuid4().hex}"
    checked = read_checked(spark, _raw_csv(_damaged(raw_log(spark, sf))), TRAIN_SCHEMA)
    counts = store_checked(checked, f"{base}/log", f"{base}/rejects")
    good = load_log(spark, f"{base}/log").agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n")
    return comparable(counts.unionByName(good))


@query("coupon_features")
def coupon_features(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(plans.coupon_table(train_log(spark, sf)).drop(LABEL))


@query("label_15d")
def label_15d(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(train_log(spark, sf).select(USER, RECEIVED, BOUGHT, redemption_label()))


@query("label_lt15")
def label_lt15(spark: SparkSession, sf: str) -> DataFrame:
    label = redemption_label(inclusive=False)
    return comparable(train_log(spark, sf).select(USER, RECEIVED, BOUGHT, label))


@query("label_binary")
def label_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Both treatments of rows without a receipt: counted as 0, or left out."""
    labelled = train_log(spark, sf).select(USER, redemption_label())
    return comparable(
        labelled.select(
            USER,
            binary_label(F.col(LABEL)).alias("label"),
            (F.col(LABEL) != -1).cast("int").alias("has_receipt"),
        )
    )


@query("one_hot")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*distance_one_hot(), *weekday_one_hot()]
    return comparable(train_log(spark, sf).select(USER, DISTANCE, RECEIVED, *columns))


@query("one_hot_text_order")
def one_hot_text_order(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(
        train_log(spark, sf).select(USER, DISTANCE, *distance_one_hot(text_order=True))
    )


@query("one_hot_month_day")
def one_hot_month_day(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(train_log(spark, sf).select(USER, RECEIVED, *month_day_one_hot()))


# --- windows -----------------------------------------------------------------


def _scored(spark: SparkSession, sf: str, number: int) -> DataFrame:
    return test_log(spark, sf) if number == 3 else dataset_window(train_log(spark, sf), number)


def _register_windows() -> None:
    for number in (1, 2, 3):
        QUERIES[f"dataset_window_{number}"] = (
            lambda spark, sf, n=number: comparable(_scored(spark, sf, n))
        )
        QUERIES[f"feature_window_{number}"] = (
            lambda spark, sf, n=number: comparable(history_window(train_log(spark, sf), n))
        )
        QUERIES[f"dataset{number}_features"] = (
            lambda spark, sf, n=number: comparable(_dataset(spark, sf, n))
        )


def _dataset(
    spark: SparkSession, sf: str, number: int, options: FeatureOptions = FeatureOptions(), **more
) -> DataFrame:
    test = test_log(spark, sf) if number == 3 else None
    return plans.build_dataset(train_log(spark, sf), number, test=test, options=options, **more)


_register_windows()


@query("feature_window_1_overlap")
def feature_window_1_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(history_window(train_log(spark, sf), 1, overlap=True))


# --- history -----------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str, **options: bool) -> DataFrame:
    """The pair table of window 2, written once for its two readers."""
    history = history_window(train_log(spark, sf), 2)
    return written(hist.pair_history(history, **options), "pair-history")


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """The stored counts by day of the training log, in folders by day."""
    path = f"{run_dir(spark)}/days-{uuid.uuid4().hex}"
    tables.store_days(hist.daily_history(train_log(spark, sf)), path)
    return tables.load_days(spark, path)


def _register_daily() -> None:
    for number in (1, 2, 3):
        QUERIES[f"dataset{number}_features_daily"] = (
            lambda spark, sf, n=number: comparable(_dataset(spark, sf, n, daily=_days(spark, sf)))
        )


_register_daily()


@query("user_merchant_features_daily")
def user_merchant_features_daily(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.pair_features(hist.pair_history_of_days(_days(spark, sf), 2)))


@query("user_features_daily")
def user_features_daily(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.user_features(written(hist.pair_history_of_days(_days(spark, sf), 2), "pair-history")))


@query("dataset1_features_earlier_daily")
def dataset1_features_earlier_daily(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(_dataset(spark, sf, 1, FeatureOptions.earlier(), daily=_days(spark, sf)))


@query("user_features")
def user_features(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.user_features(_pairs(spark, sf)))


@query("merchant_features")
def merchant_features(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.merchant_features(_pairs(spark, sf)))


@query("user_merchant_features")
def user_merchant_features(spark: SparkSession, sf: str) -> DataFrame:
    history = history_window(train_log(spark, sf), 2)
    return comparable(hist.pair_features(hist.pair_history(history)))


@query("user_coupon_features")
def user_coupon_features(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.user_coupon_features(history_window(train_log(spark, sf), 2)))


@query("user_mean_discount")
def user_mean_discount(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf, mean_discount=True)
    return comparable(hist.user_features(pairs, mean_discount=True).select(USER, "u_mean_discount"))


@query("merchant_mean_discount")
def merchant_mean_discount(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf, mean_discount=True)
    return comparable(
        hist.merchant_features(pairs, mean_discount=True).select(MERCHANT, "m_mean_discount")
    )


@query("merchant_coupon_count")
def merchant_coupon_count(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.merchant_coupon_counts(history_window(train_log(spark, sf), 2)))


@query("pair_overview")
def pair_overview(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(hist.pair_overview(train_log(spark, sf)))


# --- receipts ----------------------------------------------------------------


@query("receipt_features")
def receipt_features(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(receipts.receipt_features(_scored(spark, sf, 2)))


#: Low enough that users, merchants, pairs and receipts of the test tables are split.
SPLIT = HotRule(min_rows=8, share=1 / 1000)


@query("receipt_features_split")
def receipt_features_split(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(receipts.receipt_features(_scored(spark, sf, 2), rule=SPLIT))


@query("dataset2_features_split")
def dataset2_features_split(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(_dataset(spark, sf, 2, rule=SPLIT))


@query("receipt_features_bucketed")
def receipt_features_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """From receipts stored in buckets of the user and read again, without an exchange."""
    name = f"receipts_{uuid.uuid4().hex}"
    tables.store_buckets(_scored(spark, sf, 2), name, f"{run_dir(spark)}/{name}", [USER], 8)
    return comparable(receipts.receipt_features(tables.load_buckets(spark, name), clustered=True))


@query("receipt_gaps")
def receipt_gaps(spark: SparkSession, sf: str) -> DataFrame:
    features = receipts.receipt_features(test_log(spark, sf))
    return comparable(features.select(USER, COUPON, RECEIVED, "t_day_gap_before", "t_day_gap_after"))


@query("receipt_days")
def receipt_days(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(receipts.receipt_days(_scored(spark, sf, 2)))


@query("receipt_features_two_tables")
def receipt_features_two_tables(spark: SparkSession, sf: str) -> DataFrame:
    train = dataset_window(train_log(spark, sf), 2).drop(BOUGHT)
    ours, theirs = plans.attach_receipts(train, test_log(spark, sf))
    return comparable(
        ours.withColumn("part", F.lit("train")).unionByName(theirs.withColumn("part", F.lit("test")))
    )


@query("coupon_count")
def coupon_count(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(plans.coupon_counts(_scored(spark, sf, 2)))


# --- assembled variants ------------------------------------------------------


@query("dataset1_features_earlier")
def dataset1_features_earlier(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(_dataset(spark, sf, 1, FeatureOptions.earlier()))


@query("dataset2_features_optional")
def dataset2_features_optional(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and the optional features only, joined to every scored row."""
    options = FeatureOptions(
        mean_discount=True, merchant_coupon_count=True, coupon_count=True, user_coupon=True
    )
    raw = [USER, MERCHANT, COUPON, RECEIVED, BOUGHT, DISTANCE]
    optional = ["c_coupon_count", "u_mean_discount", "m_mean_discount", "m_merchant_coupon_count"]
    table = _dataset(spark, sf, 2, options)
    return comparable(table.select(*raw, *optional, *USER_COUPON_FEATURES))


@query("predictors_without_day_gaps")
def predictors_without_day_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of every predictor of table 2 that the reduced model uses."""
    table = _dataset(spark, sf, 2)
    names = predictors(table.columns, drop_day_gaps=True)
    means = table.agg(*[F.avg(c).alias(c) for c in names])
    return comparable(means.unpivot([], names, "predictor", "mean"))


@query("datasets_union")
def datasets_union(spark: SparkSession, sf: str) -> DataFrame:
    """Tables 1 and 2 under each other with the fixed split, by label and part."""
    both = models.split_table(_dataset(spark, sf, 1), _dataset(spark, sf, 2))
    return comparable(
        both.groupBy(F.col(models.IS_VALID).cast("int").alias("is_valid"), LABEL).agg(
            F.count("*").alias("n"), F.sum("t_same_coupon_count").alias("same_coupons")
        )
    )


@query("received_only")
def received_only(spark: SparkSession, sf: str) -> DataFrame:
    """The training log and table 2's window without rows that have no receipt, by label and part."""
    tables_ = [log.select(USER, redemption_label()) for log in (train_log(spark, sf), _scored(spark, sf, 2))]
    both = models.split_table(*tables_, drop_unreceived=True)
    return comparable(both.groupBy(F.col(models.IS_VALID).cast("int").alias("is_valid"), LABEL).agg(F.count("*").alias("n")))


@query("table_sizes")
def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    parts = {f"dataset{n}": in_dataset_window(n) for n in (1, 2)}
    parts |= {f"history{n}": in_history_window(n) for n in (1, 2, 3)}
    sizes = summary.part_sizes(train_log(spark, sf), parts)
    return comparable(sizes.unionByName(summary.table_size(test_log(spark, sf), "dataset3")))


# --- labels, scores and metrics ----------------------------------------------


def scored_receipts(spark: SparkSession, sf: str, number: int = 2) -> DataFrame:
    """Receipts of one table with a score that needs no model."""
    table = plans.coupon_table(_scored(spark, sf, number))
    spread = (F.col(USER) * 7919 + F.col(MERCHANT) * 31 + F.col("c_monthday") * 17) % 997
    return table.withColumn("score", F.col("c_discount_rate") * 0.5 + spread / F.lit(1994.0))


@query("label_histogram")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(summary.label_histogram(train_log(spark, sf).select(redemption_label())))


@query("label_values")
def label_values(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(summary.label_values(train_log(spark, sf).select(redemption_label())))


@query("auc_per_coupon")
def auc_per_coupon(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(ranking.coupon_auc(scored_receipts(spark, sf)))


@query("auc_mean")
def auc_mean(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(ranking.mean_coupon_auc(scored_receipts(spark, sf)))


@query("auc_pooled")
def auc_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(ranking.pooled_auc(scored_receipts(spark, sf)))


@query("auc_pooled_margin")
def auc_pooled_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Margins of both signs and of very different sizes instead of probabilities."""
    scored = scored_receipts(spark, sf)
    size = F.pow(F.lit(2.0), F.col(USER) % 40 * 20 - 400)
    return comparable(ranking.pooled_auc(scored.withColumn("score", (F.col("score") - 0.7) * size)))


@query("auc_min_max_scaled")
def auc_min_max_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Scores scaled to [0, 1] before the per-coupon AUC is averaged."""
    scaled = scaling.min_max(scored_receipts(spark, sf), "score")
    return comparable(ranking.mean_coupon_auc(scaled))


@query("accuracy_report")
def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_receipts(spark, sf)
    return comparable(
        summary.accuracy(scored.withColumn("prediction", (F.col("score") > 0.7).cast("int")))
    )


@query("zscore")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    table = plans.coupon_table(_scored(spark, sf, 2)).drop("Discount_rate", LABEL)
    names = ["c_discount_rate", "c_man", "c_jian", "c_distance", "c_weekday", "c_monthday"]
    scaled = scaling.standardise(table, scaling.fit_standard(table, names))
    return comparable(scaled.select(USER, MERCHANT, COUPON, RECEIVED, *names))


@query("minmax")
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_receipts(spark, sf).select(USER, COUPON, RECEIVED, "score")
    constant = scored.withColumn("constant", F.lit(3.0))
    return comparable(scaling.min_max(scaling.min_max(constant, "score"), "constant"))


@query("score_summary")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return comparable(summary.describe(scored_receipts(spark, sf, 3), [USER, "score"]))


@query("predictor_summary")
def predictor_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All predictors of table 2 to six places, described together to four."""
    table = written(comparable(_dataset(spark, sf, 2)), "dataset2")
    found = summary.describe(table, predictors(table.columns))
    return comparable(found.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in found.dtypes]))


@query("column_mean_compare")
def column_mean_compare(spark: SparkSession, sf: str) -> DataFrame:
    ours, theirs = (plans.coupon_table(_scored(spark, sf, n)) for n in (1, 2))
    return comparable(summary.compare_column_means(ours, theirs, "c_discount_rate"))


@query("submission_sorted")
def submission_sorted(spark: SparkSession, sf: str) -> DataFrame:
    scored = scaling.min_max(scored_receipts(spark, sf, 3), "score")
    return comparable(tables.sorted_submission(scored))


@query("submission_head")
def submission_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the sorted submission (a report of five rows)."""
    scored = scored_receipts(spark, sf, 3).withColumn("score", F.round("score", 6))
    return comparable(tables.sorted_submission(scored).limit(5))


# --- models ------------------------------------------------------------------


def _training_table(spark: SparkSession, sf: str, number: int = 1) -> DataFrame:
    """One table, written once, since training reads it many times."""
    return written(_dataset(spark, sf, number), f"dataset{number}")


def _training_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tables 1 and 2, for fits that are judged on the second."""
    return _training_table(spark, sf, 1), _training_table(spark, sf, 2)


@query("logistic_grid")
def logistic_grid(spark: SparkSession, sf: str) -> DataFrame:
    fitted = models.logistic_grid(*_training_tables(spark, sf))
    return spark.createDataFrame(fitted.trials, "alpha double, l1_ratio double, auc double")


#: Rounds that the registered boosting queries run; see the README for the settings' own.
ROUNDS = 20


@query("logistic_grid_settings")
def logistic_grid_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The settings that the grid tried, each with a held-out AUC."""
    trials = models.logistic_grid(*_training_tables(spark, sf), max_iter=10).trials
    rows = [(t["alpha"], t["l1_ratio"], int(0 <= t["auc"] <= 1)) for t in trials]
    return spark.createDataFrame(rows, "alpha double, l1_ratio double, has_auc bigint")


@query("gbt_scores")
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, valid = _training_tables(spark, sf)
    fitted = models.fit_trees(train, valid, kind="deep", rounds=ROUNDS)
    return models.score(fitted.model, valid).select(USER, COUPON, RECEIVED, LABEL, "score")


@query("gbt_scored_rows")
def gbt_scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Which receipts a stored and reloaded model scores, and whether every score is a probability."""
    train, valid = _training_tables(spark, sf)
    path = f"{run_dir(spark)}/model-{uuid.uuid4().hex}"
    tables.save_model(models.fit_trees(train, valid, kind="deep", rounds=2).model, path)
    scored = models.score(tables.load_model(path), valid)
    in_range = F.col("score").between(0, 1).cast("bigint").alias("in_range")
    return comparable(scored.select(USER, COUPON, RECEIVED, LABEL, in_range))


@query("gbt_early_stop")
def gbt_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """All rounds of the setting are allowed; a shorter patience ends it."""
    train, valid = _training_tables(spark, sf)
    fitted = models.fit_watched_trees(train, valid, patience=ROUNDS)
    trial = fitted.trials[0]
    rounds = [("best_round", float(trial["rounds"])), ("rounds_grown", float(trial["grown"]))]
    report = models.quality_report(fitted, valid)
    return report.unionByName(spark.createDataFrame(rounds, "metric string, value double"))


@query("gbt_importances")
def gbt_importances(spark: SparkSession, sf: str) -> DataFrame:
    train, valid = _training_tables(spark, sf)
    return models.feature_importances(models.fit_trees(train, valid, rounds=ROUNDS), spark)


@query("importance_features")
def importance_features(spark: SparkSession, sf: str) -> DataFrame:
    """The predictors that importances are given for; importances are shares."""
    train, valid = _training_tables(spark, sf)
    found = models.feature_importances(models.fit_trees(train, valid, rounds=2), spark)
    total = F.round(F.sum("importance").over(Window.partitionBy(F.lit(0))), 6)
    return found.select("feature", F.col("importance").between(0, 1).cast("bigint").alias("is_share"), total.alias("total"))


@query("kfold_report")
def kfold_report(spark: SparkSession, sf: str) -> DataFrame:
    return models.kfold_report(_training_table(spark, sf), rounds=ROUNDS // 2)[1]


def _kfold(spark: SparkSession, sf: str, rounds: int) -> models.Grown:
    """Folds that SQL can repeat."""
    return models.kfold_rounds(_training_table(spark, sf), rounds=rounds, fold=(F.col(USER) + F.col(MERCHANT)) % 3)


@query("kfold_curve")
def kfold_curve(spark: SparkSession, sf: str) -> DataFrame:
    return models.kfold_curve(_kfold(spark, sf, ROUNDS // 2), spark)


@query("kfold_rounds")
def kfold_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each class that every round's AUC is taken over, by fold and side."""
    rows = [(r["round"], r["model"], int(r["held_out"]), r["n_pos"], r["n_neg"]) for r in _kfold(spark, sf, 4).curve]
    return comparable(spark.createDataFrame(rows, "round int, fold int, held_out int, n_pos bigint, n_neg bigint"))


def _submission(spark: SparkSession, sf: str, rounds: int) -> DataFrame:
    train, valid = _training_tables(spark, sf)
    fitted = models.fit_trees(train, valid, kind="tuned", rounds=rounds)
    scored = models.score(fitted.model, _dataset(spark, sf, 3)).select(USER, COUPON, RECEIVED, "score")
    scored, bounds = scaling.written_with_range(scored, "score", "scores")
    return tables.sorted_submission(scaling.min_max(scored, "score", bounds))


@query("submission")
def submission(spark: SparkSession, sf: str) -> DataFrame:
    """Trees fitted on tables 1 and 2 score table 3, scaled to [0, 1]."""
    return _submission(spark, sf, ROUNDS)


@query("submission_rows")
def submission_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Which receipts the scaled submission holds, written as CSV and read again."""
    path = f"{run_dir(spark)}/submission-{uuid.uuid4().hex}"
    tables.write_submission(_submission(spark, sf, 2), path)
    rows = tables.read_submission(spark, path)
    return rows.select(USER, COUPON, RECEIVED, F.col("score").between(0, 1).cast("bigint").alias("in_range"))


FLAGSHIP = "dataset2_features"
