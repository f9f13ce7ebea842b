"""Assembly of the wide feature tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from voucherlens.columns import (
    BOUGHT, COUPON, MERCHANT, MERCHANT_FEATURES, PAIR_FEATURES, RECEIPT_FEATURES,
    RECEIVED, USER, USER_COUPON_FEATURES, USER_FEATURES,
)
from voucherlens.functions.coupon import (
    coupon_columns, distance_one_hot, month_day_one_hot, weekday, weekday_one_hot,
)
from voucherlens.functions.labels import redemption_label
from voucherlens.operators.history import (
    merchant_coupon_counts, merchant_features, pair_features, pair_history,
    pair_history_of_days, user_coupon_features, user_features,
)
from voucherlens.operators.hot_keys import HotRule, attach, find_hot_keys
from voucherlens.operators.receipts import (
    COPIES, RECEIPT_KEY, attach_to_hot_users, ordinary_receipts, receipt_features,
)
from voucherlens.operators.windows import dataset_window, history_window
from voucherlens.session import written


@dataclass(frozen=True)
class FeatureOptions:
    """Which variant of the table to build.

    The defaults give the main variant. :meth:`earlier` gives the earlier
    one: an exclusive label bound, the overlapping history window 1, one-hot
    weekday and distance, and no day of month. Its weekday number has no
    prefix, so it is no predictor; its copy of the distance under a second
    name is left out, since column names do not differ by case alone.
    """

    label_inclusive: bool = True
    history_overlap: bool = False
    month_day: bool = True
    weekday_number: bool = True
    one_hot_weekday: bool = False
    one_hot_distance: bool = False
    one_hot_distance_text_order: bool = False
    one_hot_month_day: bool = False
    plain_weekday: bool = False
    mean_discount: bool = False
    merchant_coupon_count: bool = False
    coupon_count: bool = False
    user_coupon: bool = False

    @classmethod
    def earlier(cls, **changes: bool) -> FeatureOptions:
        settings = {
            "label_inclusive": False,
            "history_overlap": True,
            "month_day": False,
            "weekday_number": False,
            "one_hot_weekday": True,
            "one_hot_distance": True,
            "plain_weekday": True,
        }
        return cls(**{**settings, **changes})

    def coupon_columns(self) -> list:
        columns = coupon_columns(
            month_day=self.month_day, weekday_number=self.weekday_number
        )
        if self.one_hot_distance:
            columns += distance_one_hot(text_order=self.one_hot_distance_text_order)
        if self.one_hot_weekday:
            columns += weekday_one_hot()
        if self.one_hot_month_day:
            columns += month_day_one_hot()
        if self.plain_weekday:
            columns.append(F.coalesce(weekday(F.col(RECEIVED)), F.lit(0)).alias("weekday"))
        return columns


def coupon_table(log: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """The log with its label (where purchases are known) and ``c_`` features."""
    label = [redemption_label(inclusive=options.label_inclusive)] if BOUGHT in log.columns else []
    return log.select("*", *label, *options.coupon_columns())


def assemble(
    history: DataFrame,
    scored: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    rule: HotRule = HotRule(),
    *,
    pairs: DataFrame | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Scored receipts with all history and receipt features.

    ``pairs`` is the pair history where it is at hand, as from stored days;
    ``history`` then serves optional features only. ``clustered`` says that the
    scored rows are stored in buckets of the user, so that they are not exchanged.

    One row per distinct scored row. Features depend on the row alone, so
    rows are made distinct first, while they are narrow, and each keeps its
    number of copies for the receipt counts. Label and coupon features are
    computed last, so no shuffle carries them.

    Ordinary users are exchanged once, by user: making distinct, all receipt
    windows and the join to the user features share that exchange. Hot users
    are combined before their shuffle and joined to a user table that is
    broadcast, since it holds no more rows than the bounded list of hot users.
    """
    raw = scored.columns
    hot = find_hot_keys(scored, _key_sets(options), rule)
    if pairs is None:
        pairs = pair_history(history, mean_discount=options.mean_discount)
    pairs = written(pairs, "pair-history")
    users = user_features(pairs, mean_discount=options.mean_discount)
    is_hot_user = hot["user"].contains()

    ordinary = scored.where(~is_hot_user) if hot["user"] else scored
    if not clustered:
        ordinary = ordinary.repartition(USER)
    ordinary = ordinary.groupBy(*raw).agg(F.count("*").alias(COPIES))
    rows = ordinary_receipts(ordinary).join(users, USER, "left")
    if hot["user"]:
        dense = scored.where(is_hot_user).groupBy(*raw).agg(F.count("*").alias(COPIES))
        dense = written(dense, "hot-user-rows")
        dense = attach_to_hot_users(dense, hot["receipt"])
        dense = dense.join(F.broadcast(users.where(is_hot_user)), USER, "left")
        rows = rows.unionByName(dense)

    rows = attach(rows, pair_features(pairs), hot["pair"])
    merchants = merchant_features(pairs, mean_discount=options.mean_discount)
    if options.merchant_coupon_count:
        merchants = merchants.join(merchant_coupon_counts(history), MERCHANT, "left")
    rows = attach(rows, merchants, hot["merchant"])
    if options.user_coupon:
        rows = attach(rows, user_coupon_features(history), hot["user_coupon"])
    if options.coupon_count:
        counts = coupon_counts(scored)
        rows = attach(rows, counts, hot["coupon"])
    return _finished(rows, raw, options)


def _key_sets(options: FeatureOptions) -> dict[str, list[str]]:
    sets = {
        "user": [USER],
        "merchant": [MERCHANT],
        "pair": [USER, MERCHANT],
        "receipt": RECEIPT_KEY,
    }
    if options.user_coupon:
        sets["user_coupon"] = [USER, COUPON]
    if options.coupon_count:
        sets["coupon"] = [COUPON]
    return sets


def coupon_counts(rows: DataFrame) -> DataFrame:
    """Rows per coupon, as an optional coupon feature."""
    return rows.groupBy(COUPON).agg(F.count("*").alias("c_coupon_count"))


def _finished(rows: DataFrame, raw: list[str], options: FeatureOptions) -> DataFrame:
    """Label and coupon features added, columns in order, missing features as 0."""
    optional = [
        *(["c_coupon_count"] if options.coupon_count else []),
        *(["u_mean_discount", "m_mean_discount"] if options.mean_discount else []),
        *(["m_merchant_coupon_count"] if options.merchant_coupon_count else []),
        *(USER_COUPON_FEATURES if options.user_coupon else []),
    ]
    features = [
        *USER_FEATURES, *MERCHANT_FEATURES, *PAIR_FEATURES, *RECEIPT_FEATURES, *optional,
    ]
    label = [redemption_label(inclusive=options.label_inclusive)] if BOUGHT in raw else []
    return rows.select(*raw, *label, *options.coupon_columns(), *features).na.fill(
        0, subset=features
    )


def build_dataset(
    train: DataFrame,
    number: int,
    *,
    test: DataFrame | None = None,
    options: FeatureOptions = FeatureOptions(),
    rule: HotRule = HotRule(),
    daily: DataFrame | None = None,
) -> DataFrame:
    """Feature table 1 or 2 from the training log, or 3 for the test log.

    With ``daily``, the stored counts by day of the training log, the history is
    summed from them and the log is read for the scored rows only.
    """
    history = history_window(train, number, overlap=options.history_overlap)
    pairs = None
    if daily is not None:
        pairs = pair_history_of_days(daily, number, overlap=options.history_overlap)
    if number == 3:
        if test is None:
            raise ValueError("table 3 scores the test log")
        return assemble(history, test, options, rule, pairs=pairs)
    return assemble(history, dataset_window(train, number), options, rule, pairs=pairs)


def attach_receipts(
    train: DataFrame, test: DataFrame, *, rule: HotRule = HotRule()
) -> tuple[DataFrame, DataFrame]:
    """Both logs joined to the receipt features of ``test``; missing ones are 0.

    Rows keep their number of copies: they are made distinct for the join and
    copied out again after it.
    """
    features = written(receipt_features(test, rule=rule), "receipt-features")

    def joined(rows: DataFrame) -> DataFrame:
        hot = find_hot_keys(rows, {"receipt": RECEIPT_KEY}, rule)["receipt"]
        distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias(COPIES))
        wide = attach(distinct, features, hot).na.fill(0, subset=RECEIPT_FEATURES)
        return copied_out(wide).select(*rows.columns, *RECEIPT_FEATURES)

    return joined(train), joined(test)


def copied_out(rows: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Each row repeated ``copies`` times, in chunks that spread over the tasks."""
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col(COPIES) - 1) / chunk))).alias("chunk")
    spread = rows.select("*", chunks).repartition(*rows.columns, "chunk")
    left = F.least(F.col(COPIES) - F.col("chunk") * chunk, F.lit(chunk))
    return spread.withColumn("copy", F.explode(F.sequence(F.lit(1), left))).drop("copy", "chunk")
