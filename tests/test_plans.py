"""Shape of the physical plans, with broadcasts switched off."""

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import log_of, plan_of, random_rows, rows_of
from voucherlens.operators import history as hist
from voucherlens.operators.hot_keys import HotRule, find_hot_keys, key_hash
from voucherlens.operators.ranking import coupon_auc
from voucherlens.operators.receipts import receipt_features
from voucherlens.operators.scaling import written_with_range
from voucherlens.operators.summary import part_sizes
from voucherlens.operators.windows import dataset_window, history_window
from voucherlens.plans.datasets import assemble, build_dataset
from voucherlens.sources import tables


@pytest.fixture()
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, random_rows(20)).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning)", plan)


def test_windows_are_pushed_to_the_scan(log):
    plan = plan_of(dataset_window(log, 2).select("User_id"))
    assert "GreaterThanOrEqual(Date_received,2016-05-15)" in plan
    assert re.search(r"ReadSchema: struct<User_id:bigint,Date_received:date>", plan)
    assert "Or(And(GreaterThanOrEqual(Date,2016-02-01)" in plan_of(history_window(log, 2))


def test_pair_history_takes_one_exchange(log):
    plan = plan_of(hist.pair_features(hist.pair_history(log)))
    assert len(exchanges(plan)) == 1
    # Rows without a redeemed distance are dropped before they are grouped.
    assert "Filter" in plan[plan.index("partial_count"):plan.index("Expand")]


def test_receipt_windows_share_exchange_and_sorts(log):
    plan = plan_of(assemble(log, dataset_window(log, 2)))
    assert plan.count("Window [") == 3
    users = [e for e in exchanges(plan) if re.fullmatch(r"hashpartitioning\(User_id#\d+L?, \d+\)", e)]
    # One for the scored rows, one each for user counts and user distances; the
    # joins between them add none.
    assert len(users) == 3
    assert len(exchanges(plan)) == 8


def test_no_nested_loops_and_no_python(spark, log):
    for rule in (HotRule(), HotRule(min_rows=15)):
        for df in (build_dataset(log, 2, rule=rule), receipt_features(dataset_window(log, 2), rule=rule)):
            plan = plan_of(df)
            for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
                assert word not in plan


def test_auc_windows_are_bounded_by_siblings(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "Coupon_id string, label int, score double")
    plan = plan_of(coupon_auc(df))
    assert plan.count("Window [") == 3
    # Scores are combined per coupon before anything is sorted.
    assert "partial_count" in plan
    assert not re.search(r"Exchange SinglePartition", plan)


def test_buckets_need_no_exchange(spark, log, tmp_path):
    """Receipts stored in buckets of the user: windows, counts and a join on the user as they lie."""
    scored = dataset_window(log, 2)
    tables.store_buckets(scored, "bucketed_receipts", str(tmp_path / "receipts"), ["User_id"], 4)
    tables.store_buckets(
        hist.user_features(hist.pair_history(history_window(log, 2))), "bucketed_users", str(tmp_path / "users"), ["User_id"], 4
    )
    stored = tables.load_buckets(spark, "bucketed_receipts")
    features = receipt_features(stored, clustered=True).join(tables.load_buckets(spark, "bucketed_users"), "User_id", "left")
    plan = plan_of(features)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Window [") == 3
    plain = receipt_features(scored)
    assert rows_of(features.select(*plain.columns)) == rows_of(plain)
    for name in ("bucketed_receipts", "bucketed_users"):
        spark.sql(f"DROP TABLE {name}")


def test_hot_keys_merge_a_bounded_sample(spark):
    """Counts combine below the exchange, and a large limit looks at a small part of the rows."""
    assert HotRule().sampled() < 1e-4 and HotRule(min_rows=20).sampled() == 1
    with pytest.raises(ValueError):
        HotRule(share=1e-9)
    rule = HotRule(min_rows=6400, share=1 / 100)
    assert rule.sampled() == 0.01 and rule.limit(10**6) == 10_000
    rows = spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 10 + 1).otherwise(F.col("id")).alias("k")
    )
    hot = find_hot_keys(rows, {"k": ["k"]}, rule)["k"]
    wanted = {r[0]: r[1] for r in rows.where("k <= 10").select(key_hash(["k"]), "k").distinct().collect()}
    found = {wanted.get(h): n for n, group in hot.by_slices.items() for h in group}
    # A third of all rows in one key, and ten keys of 10,000 rows against a limit of 6,400.
    assert found.pop(0) in (16, 32) and set(found) == set(range(1, 11)) and set(found.values()) == {2}


def test_scores_are_computed_once(spark):
    slow = spark.range(50).withColumn("score", F.col("id") / 7)
    stored, bounds = written_with_range(slow, "score", "scores")
    assert bounds == (0.0, 7.0) and "Range" not in plan_of(stored) and stored.count() == 50
    nothing, none = written_with_range(slow.where("id < 0"), "score", "scores")
    assert none == (None, None) and nothing.count() == 0


def test_part_sizes_take_one_scan(log):
    plan = plan_of(part_sizes(log, {"a": F.col("User_id") > 1, "b": F.col("Date").isNull()}))
    assert plan.count("Scan parquet") == 1
