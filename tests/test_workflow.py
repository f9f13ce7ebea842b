"""From two CSV files to tables, models and submissions."""

from tests.helpers import RAW_COLUMNS, plan_of
from voucherlens.operators.windows import dataset_window
from voucherlens.plans import workflow
from voucherlens.plans.datasets import FeatureOptions
from voucherlens.sources.derived_log import raw_log
from voucherlens.sources.log import load_log
from voucherlens.sources.tables import load_model


def test_whole_way(spark, small, tmp_path):
    raw = raw_log(spark, small).select(*RAW_COLUMNS)
    train = raw.where("Date_received = 'null' OR Date_received <= '20160630'")
    test = raw.where("Date_received > '20160630'").drop("Date")
    for name, part in (("train", train), ("test", test)):
        part.write.option("header", True).csv(str(tmp_path / name))
    folder = str(tmp_path / "out")

    workflow.ingest(spark, str(tmp_path / "train"), str(tmp_path / "test"), folder)
    log = load_log(spark, f"{folder}/log/train")
    assert log.count() == train.count()
    assert "PushedFilters: [IsNotNull(Date_received)" in plan_of(dataset_window(log, 1))

    workflow.build_tables(spark, folder)
    first, second, third = workflow.stored_tables(spark, folder)
    assert len(first.columns) == len(second.columns) == 59 and len(third.columns) == 57
    assert third.count() == test.distinct().count()

    report = workflow.linear_model(
        spark, folder, alphas=[0.01], l1_ratios=[0.1], max_iter=5
    ).collect()
    assert [r.metric for r in report] == ["held_out_auc", "in_sample_mean_coupon_auc"]
    assert load_model(f"{folder}/linear_model").stages

    for kind in ("tuned", "watched"):
        workflow.tree_submission(spark, folder, kind=kind, rounds=2)
        lines = spark.read.csv(f"{folder}/{kind}_submission")
        assert lines.count() == third.count() and len(lines.columns) == 4
        assert lines.where("CAST(_c3 AS DOUBLE) BETWEEN 0 AND 1").count() == third.count()


def test_earlier_options():
    options = FeatureOptions.earlier()
    assert not options.label_inclusive and options.history_overlap
    assert FeatureOptions.earlier(user_coupon=True).user_coupon
