"""CSV logs, stored tables, submissions and the shared folder."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import RAW_COLUMNS, log_of, plan_of, random_rows, rows_of
from voucherlens.columns import DISCOUNT
from voucherlens.operators import history as hist
from voucherlens.operators.windows import history_window
from voucherlens.plans.datasets import assemble, build_dataset
from voucherlens.session import CHECKPOINT_DIR, shared_dir, written
from voucherlens.sources import tables
from voucherlens.sources.log import (
    TRAIN_SCHEMA, load_log, read_checked, read_test_log, read_train_log, store_checked, typed_log,
)


def log_rows(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))


@pytest.fixture()
def csv_logs(tmp_path):
    rows = random_rows(30)
    for name, width in (("train", 7), ("test", 6)):
        lines = [",".join(RAW_COLUMNS[:width])]
        lines += [",".join(map(str, r[:width])) for r in rows if width == 7 or r[5] != "null"]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), rows


def test_csv_is_typed_and_null_aware(spark, csv_logs):
    train, test, rows = csv_logs
    log = read_train_log(spark, train)
    assert log.schema == TRAIN_SCHEMA
    assert rows_of(log) == rows_of(log_of(spark, rows))
    assert log.where("Date_received IS NULL").count() == sum(r[5] == "null" for r in rows)
    scored = read_test_log(spark, test)
    assert scored.columns == RAW_COLUMNS[:6]
    first = scored.first()
    assert isinstance(first.Date_received, datetime.date)


def test_malformed_values_fail_the_read_or_are_set_apart(spark, tmp_path):
    good = ["1,2,3,30:5,0,20160515,20160520", "1,2,null,null,null,null,20160520", "4,2,5,0.95,10,20160515,null"]
    bad = {
        "1,2,3,30:x,0,20160515,20160520": DISCOUNT, "1,2,3,0:5,0,20160515,null": DISCOUNT, "1,2,3,cheap,0,20160515,null": DISCOUNT,
        "x,2,3,0.9,far,20160515,null": "User_id,Distance", "1,2,3,0.9,0,20161340,null": "Date_received",
        "1,2,3,0.9,0,20160515,soon": "Date", "1,2,3,0.9,0": "columns", "1,2,3,0.9,0,20160515,null,7": "columns",
    }
    header = ",".join(RAW_COLUMNS)
    path = tmp_path / "log.csv"
    path.write_text("\n".join([header, *good, *bad]) + "\n")
    counts = store_checked(read_checked(spark, str(path), TRAIN_SCHEMA), str(tmp_path / "log"), str(tmp_path / "rejects"))
    assert {r["reason"]: r["n"] for r in counts.collect()} == dict(Counter(bad.values()))
    kept = load_log(spark, str(tmp_path / "log"))
    assert kept.schema == TRAIN_SCHEMA
    only = tmp_path / "good.csv"
    only.write_text("\n".join([header, *good]) + "\n")
    assert rows_of(kept) == rows_of(read_train_log(spark, str(only)))
    lines = {r["line"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert lines == bad
    for line in bad:
        one = tmp_path / f"one-{abs(hash(line))}.csv"
        one.write_text(f"{header}\n{line}\n")
        with pytest.raises(Exception):  # noqa: B017
            read_train_log(spark, str(one)).collect()
    raw = log_rows(spark, [("1", "2", "3", "30:x", "0", "20160515", "null")])
    with pytest.raises(Exception, match="malformed Discount_rate"):
        typed_log(raw).collect()


def test_days_are_replaced_and_summed(spark, tmp_path):
    """Stored counts by day give every window; a day that is stored again takes its folder's place."""
    rows = random_rows(33, 300)
    log = log_of(spark, rows).withColumn("Date", F.col("Date") - F.expr("INTERVAL 40 DAYS")).withColumn(
        "Date_received", F.col("Date_received") - F.expr("INTERVAL 40 DAYS")
    )
    log = log.select(*RAW_COLUMNS).withColumns({c: F.col(c).cast("date") for c in ("Date", "Date_received")})
    path = str(tmp_path / "days")
    tables.store_days(hist.daily_history(log, mean_discount=True), path)
    daily = tables.load_days(spark, path)
    for number, overlap in ((1, False), (1, True), (2, False), (3, False)):
        whole = hist.pair_history(history_window(log, number, overlap=overlap), mean_discount=True)
        summed = hist.pair_history_of_days(daily, number, overlap=overlap)
        order = sorted(whole.columns)
        rounded = lambda df: rows_of(df.select(*order).withColumn("rate_sum", F.round("rate_sum", 6)))
        assert rounded(summed) == rounded(whole)
    plan = plan_of(hist.pair_history_of_days(daily, 1))
    assert "PartitionFilters: [isnotnull(history_day" in plan.replace("IsNotNull", "isnotnull")
    # The last days come again with fewer rows; the others stay.
    last = F.col(hist.HISTORY_DAY) >= daily.agg(F.max(hist.HISTORY_DAY)).first()[0]
    before = rows_of(daily.where(~last))
    again = hist.daily_history(log.where("User_id = 1")).withColumn("rate_sum", F.lit(0.0)).where(last)
    again = written(again, "again")
    tables.store_days(again, path)
    daily = tables.load_days(spark, path)
    assert rows_of(daily.where(~last)) == before
    assert {r["User_id"] for r in daily.where(last).collect()} <= {1}


def test_table_3_from_files(spark, csv_logs):
    train, test, _ = csv_logs
    table = build_dataset(read_train_log(spark, train), 3, test=read_test_log(spark, test))
    assert "label" not in table.columns and "Date" not in table.columns
    assert table.count() == read_test_log(spark, test).distinct().count()
    with pytest.raises(ValueError):
        build_dataset(read_train_log(spark, train), 3)


def test_stored_tables(spark, tmp_path):
    rows = random_rows(31, 100)
    log = log_of(spark, rows)
    table = assemble(log, log.where("Date_received IS NOT NULL"))
    tables.write_dataset(table, str(tmp_path / "parquet"))
    back = tables.read_dataset(spark, str(tmp_path / "parquet"), table.schema)
    assert rows_of(back) == rows_of(table)
    tables.export_csv(table, str(tmp_path / "csv"))
    again = tables.import_csv(spark, str(tmp_path / "csv"), table.schema)
    assert again.columns == table.columns and rows_of(again) == rows_of(table)


def test_submission_file(spark, tmp_path):
    rows = [(2, "b", "2016-07-02", 0.25), (1, "a", "2016-07-01", 0.5), (3, "a", "2016-07-03", 0.1)]
    scored = spark.createDataFrame(rows, "User_id bigint, Coupon_id string, day string, score double")
    scored = scored.selectExpr("User_id", "Coupon_id", "CAST(day AS DATE) AS Date_received", "score")
    path = tmp_path / "submission"
    tables.write_submission(tables.sorted_submission(scored), str(path))
    lines = [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == ["3,a,20160703,0.1", "1,a,20160701,0.5", "2,b,20160702,0.25"]


class ClusterSession:
    """The parts of a session that name the shared folder."""

    def __init__(self, folder, master):
        self.conf = self.sparkContext = self
        self.folder, self.master, self.applicationId = folder, master, f"app-{folder}"

    def get(self, key, default):
        assert key == CHECKPOINT_DIR
        return self.folder or default

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(ClusterSession("hdfs://shared/work/", "yarn")) == "hdfs://shared/work"
    with pytest.raises(ValueError):
        shared_dir(ClusterSession(None, "yarn"))
    assert shared_dir(spark) == shared_dir(spark)
    assert written(spark.range(5), "numbers").count() == 5
