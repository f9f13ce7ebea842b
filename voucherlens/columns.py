"""Column names, date windows and model settings shared by the whole package."""

from __future__ import annotations

# Raw log columns, feature names, window dates and the label
# bound. Results are only comparable when these stay exactly as they are.
USER = "User_id"
MERCHANT = "Merchant_id"
COUPON = "Coupon_id"
DISCOUNT = "Discount_rate"
DISTANCE = "Distance"
RECEIVED = "Date_received"
BOUGHT = "Date"
LABEL = "label"
MISSING_TEXT = "null"
DATE_TEXT = "yyyyMMdd"
LABEL_DAYS = 15

DATASET_WINDOWS = {
    1: ("2016-04-14", "2016-05-14"),
    2: ("2016-05-15", "2016-06-15"),
    3: ("2016-07-01", "2016-07-30"),
}
HISTORY_WINDOWS = {
    1: ("2016-01-01", "2016-04-13"),
    2: ("2016-02-01", "2016-05-14"),
    3: ("2016-03-15", "2016-06-30"),
}
# The overlapping form of history window 1: receipts never used are taken up
# to this later day.
HISTORY_1_OVERLAP_END = "2016-05-14"

PREDICTOR_PREFIXES = ("c_", "u_", "m_", "um_", "t_")

COUPON_FEATURES = [
    "c_discount_rate", "c_is_manjian", "c_man", "c_jian",
    "c_distance", "c_weekday", "c_weektype", "c_monthday",
]
USER_FEATURES = [
    "u_buy_count", "u_coupon_buy_count", "u_coupon_count",
    "u_coupon_buy_rate", "u_coupon_use_rate",
    "u_mean_distance", "u_max_distance", "u_min_distance", "u_median_distance",
    "u_merchant_count",
    "u_date_gap_mean", "u_date_gap_min", "u_date_gap_max",
]
MERCHANT_FEATURES = [
    "m_buy_count", "m_coupon_buy_count", "m_coupon_count",
    "m_coupon_buy_rate", "m_coupon_use_rate",
    "m_mean_distance", "m_max_distance", "m_min_distance", "m_median_distance",
    "m_date_gap_mean", "m_date_gap_min", "m_date_gap_max",
]
PAIR_FEATURES = [
    "um_buy_count", "um_buy_with_coupon_count", "um_coupon_count", "um_count",
    "um_common_buy_count", "um_buy_rate", "um_buy_with_coupon_rate",
    "um_coupon_transfer_rate", "um_common_buy_rate",
]
RECEIPT_FEATURES = [
    "t_total_coupon_count", "t_same_coupon_count", "t_same_coupon_morethan1",
    "t_user_receive_same_coupon_lastone", "t_user_receive_same_coupon_firstone",
    "t_day_received_all_coupon_num", "t_day_received_same_coupon_num",
    "t_day_gap_before", "t_day_gap_after",
]
USER_COUPON_FEATURES = [
    "uc_count", "uc_coupon_buy_count", "uc_coupon_nosale_count",
    "uc_buy_rate", "uc_no_buy_rate", "uc_nosale_rate",
]
# Receipt features that were found to over-fit; dropping them is an option.
DAY_GAP_FEATURES = ["t_day_gap_before", "t_day_gap_after"]

# Model settings.
LINEAR_ALPHAS = [0.001, 0.01, 0.1]
LINEAR_L1_RATIOS = [0.001, 0.01, 0.1]
LINEAR_MAX_ITER = 100
MODEL_SEED = 100


def predictors(columns: list[str], *, drop_day_gaps: bool = False) -> list[str]:
    """Model inputs, recognised by name prefix, in table order."""
    dropped = DAY_GAP_FEATURES if drop_day_gaps else []
    return [c for c in columns if c.startswith(PREDICTOR_PREFIXES) and c not in dropped]
