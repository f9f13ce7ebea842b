"""User, merchant, pair and user-coupon history features.

One grouping-sets pass over the history window yields, per user and merchant,
a row of counts ("pair row") and one row per redeemed distance ("distance
row"). Pair features are a projection of it; user and merchant features are a
small aggregate of each row kind. All counts combine before the shuffle, so a
key that holds a third of the log costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voucherlens.columns import (
    BOUGHT, COUPON, DISCOUNT, DISTANCE, HISTORY_WINDOWS, MERCHANT, MERCHANT_FEATURES, PAIR_FEATURES,
    RECEIVED, USER, USER_COUPON_FEATURES, USER_FEATURES,
)
from voucherlens.functions.coupon import discount_rate
from voucherlens.functions.labels import (
    days_to_purchase, is_bought, is_plain_purchase, is_received, is_redeemed, is_unused, ratio,
)
from voucherlens.operators.windows import unused_end

HISTORY_DAY = "history_day"


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _counted_rows(history: DataFrame, *more: Column, mean_discount: bool) -> DataFrame:
    """What the counts of a history row need, and ``more``."""
    gap = F.when(is_redeemed(), days_to_purchase())
    rate = [F.when(is_redeemed(), discount_rate(F.col(DISCOUNT))).alias("rate")] if mean_discount else []
    return history.select(
        USER,
        MERCHANT,
        F.when(is_redeemed(), F.col(DISTANCE)).alias("distance"),
        is_bought().alias("bought"),
        is_redeemed().alias("redeemed"),
        is_received().alias("received"),
        is_plain_purchase().alias("plain"),
        gap.alias("gap"),
        *rate,
        *more,
    )


def _with_distances(rows: DataFrame, keys: list[str], *, mean_discount: bool) -> DataFrame:
    """Counts per key and per key and redeemed distance, told apart by ``is_pair``."""
    optional_sums = [F.sum("rate").alias("rate_sum")] if mean_discount else []
    is_pair = F.col("grouping_level") == 1
    return (
        rows.groupingSets([keys, [*keys, "distance"]], *keys, "distance")
        .agg(
            F.grouping_id().alias("grouping_level"),
            F.count("*").alias("n_rows"),
            _count_if(F.col("bought")).alias("n_bought"),
            _count_if(F.col("redeemed")).alias("n_redeemed"),
            _count_if(F.col("received")).alias("n_received"),
            _count_if(F.col("plain")).alias("n_plain"),
            F.sum("gap").alias("gap_sum"),
            F.min("gap").alias("gap_min"),
            F.max("gap").alias("gap_max"),
            *optional_sums,
        )
        .where(is_pair | F.col("distance").isNotNull())
        .withColumn("is_pair", is_pair)
        .drop("grouping_level")
    )


def pair_history(history: DataFrame, *, mean_discount: bool = False) -> DataFrame:
    """Counts per (user, merchant) and per (user, merchant, redeemed distance).

    ``is_pair`` tells the two row kinds apart. The second kind exists only
    for redeemed rows with a known distance; the filter below moves under the
    aggregate, so no other rows are grouped twice. Discount sums are kept only
    when ``mean_discount`` features will be asked for.
    """
    rows = _counted_rows(history, mean_discount=mean_discount)
    return _with_distances(rows, [USER, MERCHANT], mean_discount=mean_discount)


def daily_history(log: DataFrame, *, mean_discount: bool = False) -> DataFrame:
    """The counts of :func:`pair_history` for every pair and day, over a whole log.

    The day of a purchase is the day it was made, that of a receipt never used the
    day it was received; these are the days that history windows look at, so any
    window is a sum of this table's rows. A row with neither day is in no window.
    """
    day = F.coalesce(F.col(BOUGHT), F.col(RECEIVED)).alias(HISTORY_DAY)
    rows = _counted_rows(log, day, mean_discount=mean_discount).where(F.col(HISTORY_DAY).isNotNull())
    return _with_distances(rows, [USER, MERCHANT, HISTORY_DAY, "bought"], mean_discount=mean_discount)


def pair_history_of_days(daily: DataFrame, number: int, *, overlap: bool = False) -> DataFrame:
    """What :func:`pair_history` gives for a history window, summed from its days."""
    first, last = HISTORY_WINDOWS[number]
    day = lambda end: F.col(HISTORY_DAY).between(F.lit(first).cast("date"), F.lit(end).cast("date"))
    unused = unused_end(number, overlap=overlap)
    # The wider range alone is what prunes the stored days.
    within = day(max(last, unused)) & (day(last) | (~F.col("bought") & day(unused)))
    merged = {
        name: F.min(name) if name == "gap_min" else F.max(name) if name == "gap_max" else F.sum(name)
        for name in daily.columns
        if name.startswith("n_") or name in ("gap_sum", "gap_min", "gap_max", "rate_sum")
    }
    return daily.where(within).groupBy(USER, MERCHANT, "distance", "is_pair").agg(
        *[value.alias(name) for name, value in merged.items()]
    )


def pair_features(pairs: DataFrame) -> DataFrame:
    """The ``um_`` features: a projection of the pair rows."""
    bought, redeemed = F.col("n_bought"), F.col("n_redeemed")
    return pairs.where("is_pair").select(
        USER,
        MERCHANT,
        bought.alias("um_buy_count"),
        redeemed.alias("um_buy_with_coupon_count"),
        F.col("n_received").alias("um_coupon_count"),
        F.col("n_rows").alias("um_count"),
        F.col("n_plain").alias("um_common_buy_count"),
        ratio(bought, F.col("n_rows")).alias("um_buy_rate"),
        ratio(redeemed, bought).alias("um_buy_with_coupon_rate"),
        ratio(redeemed, F.col("n_received")).alias("um_coupon_transfer_rate"),
        ratio(F.col("n_plain"), bought).alias("um_common_buy_rate"),
    ).select(USER, MERCHANT, *PAIR_FEATURES)


def _side_features(pairs: DataFrame, key: str, prefix: str, *, mean_discount: bool) -> DataFrame:
    """Features of one side of the pair: counts, waiting days and distances.

    Counts and distances come from the two row kinds in two aggregates, which
    are joined on the partitioning they already have. Only the second, over
    the few redeemed rows, carries the buffers of the exact median.
    """
    counts = pairs.where("is_pair").groupBy(key).agg(
        F.sum("n_bought").alias("buys"),
        F.sum("n_redeemed").alias("redeemed"),
        F.sum("n_received").alias("received"),
        _count_if(F.col("n_bought") > 0).alias("bought_pairs"),
        F.sum("gap_sum").alias("gap_sum"),
        F.min("gap_min").alias("gap_min"),
        F.max("gap_max").alias("gap_max"),
        *([F.sum("rate_sum").alias("rate_sum")] if mean_discount else []),
    )
    redeemed = F.col("n_redeemed")
    distances = pairs.where("NOT is_pair").groupBy(key).agg(
        F.sum(redeemed).alias("distances"),
        F.sum(F.col("distance") * redeemed).alias("distance_sum"),
        F.max("distance").alias("distance_max"),
        F.min("distance").alias("distance_min"),
        F.percentile("distance", F.lit(0.5), redeemed).alias("distance_median"),
    )
    sums = counts.join(distances, key, "left")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    features = {
        "buy_count": F.col("buys"),
        "coupon_buy_count": F.col("redeemed"),
        "coupon_count": F.col("received"),
        "coupon_buy_rate": ratio(F.col("redeemed"), F.col("buys")),
        "coupon_use_rate": ratio(F.col("redeemed"), F.col("received")),
        "mean_distance": ratio(F.col("distance_sum"), F.col("distances")),
        "max_distance": number("distance_max"),
        "min_distance": number("distance_min"),
        "median_distance": number("distance_median"),
        "merchant_count": F.col("bought_pairs"),
        "date_gap_mean": ratio(F.col("gap_sum"), F.col("redeemed")),
        "date_gap_min": number("gap_min"),
        "date_gap_max": number("gap_max"),
    }
    wanted = [*(USER_FEATURES if prefix == "u_" else MERCHANT_FEATURES)]
    if mean_discount:
        features["mean_discount"] = ratio(F.col("rate_sum"), F.col("redeemed"))
        wanted.append(f"{prefix}mean_discount")
    return sums.select(key, *[features[f.removeprefix(prefix)].alias(f) for f in wanted])


def user_features(pairs: DataFrame, *, mean_discount: bool = False) -> DataFrame:
    """The ``u_`` features from :func:`pair_history`."""
    return _side_features(pairs, USER, "u_", mean_discount=mean_discount)


def merchant_features(pairs: DataFrame, *, mean_discount: bool = False) -> DataFrame:
    """The ``m_`` features from :func:`pair_history`."""
    return _side_features(pairs, MERCHANT, "m_", mean_discount=mean_discount)


def merchant_coupon_counts(history: DataFrame) -> DataFrame:
    """Distinct coupons per merchant (an optional feature)."""
    return history.groupBy(MERCHANT).agg(
        F.count_distinct(F.col(COUPON)).alias("m_merchant_coupon_count")
    )


def user_coupon_features(history: DataFrame) -> DataFrame:
    """The optional ``uc_`` features.

    ``uc_no_buy_rate`` repeats ``uc_buy_rate``, as its definition has always
    done; ``uc_nosale_rate`` is the share that its name promises.
    """
    counts = (
        history.where(F.col(COUPON).isNotNull())
        .groupBy(USER, COUPON)
        .agg(
            F.count("*").alias("uc_count"),
            _count_if(F.col(BOUGHT).isNotNull()).alias("uc_coupon_buy_count"),
            _count_if(is_unused()).alias("uc_coupon_nosale_count"),
        )
    )
    bought = ratio(F.col("uc_coupon_buy_count"), F.col("uc_count"))
    return counts.select(
        "*",
        bought.alias("uc_buy_rate"),
        bought.alias("uc_no_buy_rate"),
        ratio(F.col("uc_coupon_nosale_count"), F.col("uc_count")).alias("uc_nosale_rate"),
    ).select(USER, COUPON, *USER_COUPON_FEATURES)


def pair_overview(log: DataFrame) -> DataFrame:
    """Redeemed and total rows per (user, merchant) over a whole log."""
    return log.groupBy(USER, MERCHANT).agg(
        _count_if(is_redeemed()).alias("um_redeemed_count"),
        F.count("*").alias("um_total_count"),
    )
