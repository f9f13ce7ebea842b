"""Models on a table with planted signal."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from voucherlens import session
from voucherlens.operators.ranking import pooled_auc
from voucherlens.plans import boosting, models
from voucherlens.session import written
from voucherlens.sources import tables

COLUMNS = ["c_x", "u_y", "um_z"]


@pytest.fixture(scope="module")
def planted(spark):
    def table(seed):
        noise = F.rand(seed)
        return spark.range(0, 600, numPartitions=2).select(
            F.col("id").alias("User_id"),
            (F.col("id") % 5).cast("string").alias("Coupon_id"),
            F.to_date(F.lit("2016-05-20")).alias("Date_received"),
            (F.col("id") % 7).cast("double").alias("c_x"),
            (F.col("id") % 11).cast("double").alias("u_y"),
            F.lit(1.0).alias("um_z"),
            F.when((F.col("id") % 7) / 7 + noise > 1.0, 1).when(noise < 0.02, -1).otherwise(0).alias("label"),
        )

    return tuple(written(t, n) for t, n in ((table(1), "a"), (table(2), "b")))


def scores(fitted, table):
    rows = models.score(fitted.model, table).select("User_id", "score").collect()
    return {r.User_id: r.score for r in rows}


def test_logistic_grid(spark, planted, tmp_path):
    train, valid = planted
    fitted = models.logistic_grid(train, valid, alphas=[0.001, 0.1], l1_ratios=[0.01], max_iter=20)
    assert [t["alpha"] for t in fitted.trials] == [0.001, 0.1]
    assert fitted.valid_auc == max(t["auc"] for t in fitted.trials) > 0.6
    found = scores(fitted, valid)
    assert len(found) == 600 and all(0 <= s <= 1 for s in found.values())
    tables.save_model(fitted.model, str(tmp_path / "model"))
    fitted.model = tables.load_model(str(tmp_path / "model"))
    assert scores(fitted, valid) == found


def test_trees_repeat_and_report(spark, planted):
    train, valid = planted
    first = models.fit_trees(train, valid, kind="deep", rounds=3)
    again = models.fit_trees(train, valid, kind="deep", rounds=3)
    assert first.valid_auc == again.valid_auc > 0.6
    assert scores(first, valid) == scores(again, valid)
    report = {r.metric: r.value for r in models.quality_report(first, valid).collect()}
    assert set(report) == {"held_out_auc", "in_sample_mean_coupon_auc"}
    ranked = models.feature_importances(first, spark).collect()
    assert sorted(r.feature for r in ranked) == sorted(COLUMNS) and ranked[0].feature == "c_x"


SMALL = models.TreeSettings(max_depth=3, step=0.3, subsample=0.7, features="all", min_rows=1)


def test_watched_auc_is_the_pooled_auc_of_the_kept_model(spark, planted):
    train, valid = planted
    fitted = models.fit_watched_trees(train, valid, rounds=5, patience=2, settings=SMALL)
    labelled = valid.withColumn("label", models.binary_label(F.col("label")))
    (row,) = pooled_auc(models.score(fitted.model, labelled)).collect()
    assert row.auc == pytest.approx(fitted.valid_auc) and row.auc > 0.6
    found = {r["round"]: r["auc"] for r in fitted.trials[0]["curve"] if r["held_out"]}
    assert fitted.valid_auc == max(found.values()) == found[fitted.trials[0]["rounds"]]


@pytest.mark.parametrize("patience", [1, 3])
def test_growing_stops_when_patience_runs_out(planted, patience):
    train, valid = planted
    trial = models.fit_watched_trees(train, valid, rounds=40, patience=patience, settings=SMALL).trials[0]
    held = [r["auc"] for r in trial["curve"] if r["held_out"]]
    assert len(held) == trial["grown"] <= trial["rounds"] + patience < 40
    assert held.index(max(held)) + 1 == trial["rounds"]
    # Nothing within patience of any earlier best was left out.
    assert all(max(held[:i]) < max(held[: i + patience]) for i in range(1, trial["rounds"]))


def test_blocks_grow_the_same_trees(spark, planted):
    """Going on from stored margins gives what one block gives."""
    train, valid = planted
    stages, ready = models._ready(
        models.split_table(train, valid), COLUMNS, F.when(F.col(models.IS_VALID), 0).otherwise(-1)
    )
    curves = []
    for block in (4, 1, 3):
        grown = boosting.grow_all(ready, 1, replace(SMALL, subsample=1.0), rounds=4, block=block)
        model = boosting.scoring_model(stages, grown, 4)
        curves.append(sorted((r["round"], r["held_out"], round(r["auc"], 9)) for r in grown.curve))
        rows = models.score(model, valid).select("User_id", "score").collect()
        curves[-1].append({r.User_id: round(r.score, 9) for r in rows})
    assert curves[0] == curves[1] == curves[2]


def test_blocks_leave_no_tables_behind(spark, planted, tmp_path):
    train, valid = planted
    before = set(session._written[spark.sparkContext.applicationId])
    models.fit_watched_trees(train, valid, rounds=3, patience=3, settings=SMALL)
    assert set(session._written[spark.sparkContext.applicationId]) == before


def test_grown_model_is_stored_and_read(planted, tmp_path):
    train, valid = planted
    fitted = models.fit_watched_trees(train, valid, rounds=3, patience=3, settings=SMALL)
    found = scores(fitted, valid)
    tables.save_model(fitted.model, str(tmp_path / "grown"))
    fitted.model = tables.load_model(str(tmp_path / "grown"))
    assert scores(fitted, valid) == found


def test_best_of():
    nan = float("nan")
    assert boosting.best_of([0.5, 0.7, 0.7, 0.6]) == 2
    assert boosting.best_of([nan, 0.1]) == 2 and boosting.best_of([nan, nan]) == 1


def test_kfold_curve(spark, planted):
    """Every row is held out once; means and deviations are those of the folds."""
    train, _ = planted
    grown = models.kfold_rounds(train, folds=4, rounds=3)
    rows = models.kfold_curve(grown, spark).collect()
    assert [r["round"] for r in rows] == [1, 2, 3] and all(r["folds"] == 4 for r in rows)
    for r in rows:
        for held, name in ((True, "test"), (False, "train")):
            own = [c["auc"] for c in grown.curve if c["round"] == r["round"] and c["held_out"] == held]
            assert r[f"{name}_auc_mean"] == pytest.approx(np.mean(own)) and r[f"{name}_auc_std"] == pytest.approx(np.std(own))
        sides = [c for c in grown.curve if c["round"] == r["round"]]
        assert sum(c["n_pos"] + c["n_neg"] for c in sides if c["held_out"]) == 600
        assert sum(c["n_pos"] + c["n_neg"] for c in sides if not c["held_out"]) == 1800


def test_unreceived_rows_are_left_out(planted):
    train, valid = planted
    both = models.split_table(train, valid, drop_unreceived=True)
    assert both.count() == train.where("label <> -1").count() + valid.where("label <> -1").count() < 1200
    trial = models.fit_watched_trees(train, valid, rounds=1, patience=1, settings=SMALL, drop_unreceived=True).trials[0]
    assert sum(r["n_pos"] + r["n_neg"] for r in trial["curve"]) == both.count()


def test_default_rounds():
    assert {k: models.boosted_trees(k).getMaxIter() for k in models.ROUNDS} == {"deep": 800, "tuned": 300, "watched": 3000}
    assert models.boosted_trees("deep", rounds=2).getMaxIter() == 2


def test_kfold_report(planted):
    train, _ = planted
    fitted, report = models.kfold_report(train, folds=3, rounds=2)
    found = {r.metric: r.value for r in report.collect()}
    assert set(found) == {"train_accuracy", "train_auc", "fold_auc", "fold_auc_std"}
    assert all(0.5 < v <= 1 for k, v in found.items() if k != "fold_auc_std")


def test_kfold_report_builds_only_the_table_it_folds(spark, planted, monkeypatch):
    built = []
    monkeypatch.setattr(queries, "_dataset", lambda spark, sf, number: built.append(number) or planted[0])
    monkeypatch.setattr(models, "kfold_report", lambda train, rounds: (None, train))
    assert queries.kfold_report(spark, "").count() == 600 and built == [1]


def most_rows(df):
    return max(df.rdd.glom().map(len).collect())


def test_a_task_of_a_fit_takes_a_bounded_part(spark, planted, monkeypatch):
    """However few files hold a table, no task takes more rows of it than ``TASK_ROWS``."""
    train, valid = planted
    packed = train.coalesce(1)
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    assert most_rows(session.dealt(packed, 600)) <= 45
    seen, fit_all, pool = [], models._fit_all, []
    monkeypatch.setattr(models, "_fit_all", lambda e, t, g, rows: seen.append(most_rows(t)) or fit_all(e, t, g, rows))
    threads = models.ThreadPool
    monkeypatch.setattr(models, "ThreadPool", lambda n: pool.append(n) or threads(n))
    models.logistic_grid(packed, valid.coalesce(1), alphas=[0.001, 0.1], l1_ratios=[0.01], max_iter=2)
    # One copy of a table that fills all cores is held at a time.
    assert seen[0] <= 45 and pool == [1]
    grow_one = boosting._grow_one
    monkeypatch.setattr(boosting, "_grow_one", lambda rows, *more: seen.append(most_rows(rows)) or grow_one(rows, *more))
    models.fit_watched_trees(packed, valid.coalesce(1), rounds=1, patience=1, settings=SMALL)
    assert seen[1] <= 45


def test_a_small_table_stays_as_it_lies(spark, planted):
    train, _ = planted
    assert session.dealt(train, 600) is train and session.tasks_for(spark, 10 * session.TASK_ROWS) > 1


def test_margins_are_stored_only_for_a_block_that_follows(planted, monkeypatch):
    train, valid = planted
    names, store = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda df, name: names.append(name) or store(df, name))
    models.fit_watched_trees(train, valid, rounds=2, patience=2, settings=SMALL)
    assert names == ["margins", "staged-margins"]
