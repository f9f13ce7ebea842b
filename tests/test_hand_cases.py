"""Expected values worked out by hand."""

import pytest

from tests.helpers import log_of
from voucherlens.functions.labels import redemption_label
from voucherlens.operators import history as hist
from voucherlens.operators.ranking import coupon_auc
from voucherlens.operators.receipts import receipt_features
from voucherlens.plans.datasets import coupon_table


def test_discount_parsing(spark):
    rows = [(1, 1, "c", d, "null", "20160515", "null") for d in ("null", "0.95", "200:20", "30:5")]
    table = coupon_table(log_of(spark, rows)).collect()
    found = {r.Discount_rate: (round(r.c_discount_rate, 6), r.c_is_manjian, r.c_man, r.c_jian)
             for r in table}
    assert found == {
        None: (1.0, 0, 0, 0), "0.95": (0.95, 0, 0, 0),
        "200:20": (0.9, 1, 200, 20), "30:5": (0.833333, 1, 30, 5),
    }
    assert {r.c_distance for r in table} == {0}


def test_calendar(spark):
    rows = [(1, 1, "c", "0.9", 1, d, "null") for d in ("20160515", "20160516")]
    rows.append((1, 1, "null", "null", 1, "null", "20160516"))
    found = sorted((r.c_weekday, r.c_weektype, r.c_monthday)
                   for r in coupon_table(log_of(spark, rows)).collect())
    assert found == [(0, 0, 0), (1, 0, 16), (7, 1, 15)]


@pytest.mark.parametrize("inclusive, on_day_15", [(True, 1), (False, 0)])
def test_label(spark, inclusive, on_day_15):
    days = [("20160515", "20160530"), ("20160515", "20160531"), ("20160515", "20160510"),
            ("20160515", "null"), ("null", "20160530")]
    rows = [(i, 1, "c", "0.9", 1, *d) for i, d in enumerate(days)]
    labelled = log_of(spark, rows).select("User_id", redemption_label(inclusive=inclusive))
    assert [r.label for r in labelled.orderBy("User_id").collect()] == [on_day_15, 0, 1, 0, -1]


def test_receipts(spark):
    rows = [(1, 1, c, "0.9", 1, d, "null")
            for c, d in [("a", "20160515"), ("a", "20160515"), ("a", "20160520"), ("b", "20160515")]]
    found = {(r.Coupon_id, r.Date_received.day): tuple(r)[3:]
             for r in receipt_features(log_of(spark, rows)).collect()}
    assert found == {
        ("a", 15): (4, 3, 1, 0, 1, 3, 2, -1, 5),
        ("a", 20): (4, 3, 1, 1, 0, 1, 1, 5, -1),
        ("b", 15): (4, 1, 0, -1, -1, 3, 1, -1, -1),
    }


def test_receipts_on_one_day(spark):
    rows = [(1, 1, "a", "0.9", 1, "20160515", "null")] * 2
    (row,) = receipt_features(log_of(spark, rows)).collect()
    assert (row.t_user_receive_same_coupon_lastone, row.t_user_receive_same_coupon_firstone,
            row.t_day_gap_before, row.t_day_gap_after) == (1, 1, -1, -1)


HISTORY = [
    (1, 1, "a", "0.9", 3, "20160201", "20160205"),
    (1, 1, "a", "0.9", "null", "20160202", "20160212"),
    (1, 2, "b", "0.9", 5, "20160203", "null"),
    (1, 2, "null", "null", 1, "null", "20160210"),
    (1, 3, "c", "0.9", 2, "20160204", "null"),
]


def test_history(spark):
    log = log_of(spark, HISTORY)
    pairs = hist.pair_history(log)
    (user,) = hist.user_features(pairs).collect()
    assert tuple(round(v, 6) for v in user[1:]) == (
        3, 2, 4, 0.666667, 0.5, 3, 3, 3, 3, 2, 7, 4, 10)
    merchants = {r.Merchant_id: tuple(r)[1:] for r in hist.merchant_features(pairs).collect()}
    assert merchants == {
        1: (2, 2, 2, 1, 1, 3, 3, 3, 3, 7, 4, 10),
        2: (1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        3: (0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    }
    pair = {r.Merchant_id: tuple(r)[2:] for r in hist.pair_features(pairs).collect()}
    assert pair == {
        1: (2, 2, 2, 2, 0, 1, 1, 1, 0), 2: (1, 0, 1, 2, 1, 0.5, 0, 0, 1),
        3: (0, 0, 1, 1, 0, 0, 0, 0, 0),
    }
    coupons = {r.Coupon_id: tuple(r)[2:] for r in hist.user_coupon_features(log).collect()}
    assert coupons["a"] == (2, 2, 0, 1, 1, 0) and coupons["b"] == (1, 0, 1, 0, 0, 1)


def test_auc(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, 0.1), ("b", 1, 0.3)]
    scored = spark.createDataFrame(rows, "Coupon_id string, label int, score double")
    assert [tuple(r) for r in coupon_auc(scored).collect()] == [("a", 0.875, 2, 2)]
