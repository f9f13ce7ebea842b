"""Every registered query with a twin equals it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import oracle, queries
from checks.compare import differences, duck

ORACLE = entry.oracle_sql()
# Model queries have no twin; tests/test_models.py covers them.
MODELS = {"logistic_grid", "gbt_scores", "gbt_early_stop", "gbt_importances", "kfold_report",
          "submission", "kfold_curve"}


def test_only_models_lack_a_twin():
    assert set(queries.QUERIES) - set(oracle.oracle_sql()) == MODELS
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, name):
    ours = entry.queries()[name](spark, small).toPandas()
    assert differences(ours, duck(small).execute(ORACLE[name]).df()) == []
