"""The registered walk-forward queries do the whole job: all folds, the adapters' own settings, all orders and lags."""

import pytest

from loomline import catalogue
from loomline.plans import evaluation, models

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, seeds", [("random_forest_wf", 5), ("boosting_wf", 5), ("lstm_wf", 3)])
def test_learned_queries_run_all_folds(spark, monkeypatch, name, seeds):
    asked = {}

    def run(table, columns, windows, adapter, params, seeds):
        asked.update(windows=windows, params=params, seeds=seeds)
        return table

    monkeypatch.setattr(models.forecast, "run", run)
    catalogue.QUERIES[name](spark, SF)
    assert asked["windows"] == evaluation.FOLDS and asked["params"] == {} and len(asked["seeds"]) == seeds


def test_granger_reaches_a_day_back(spark):
    assert {r.lags for r in catalogue.QUERIES["granger"](spark, "/root/testdata/sf0.01").filter("rule = 'fixed'").collect()} == {1, 6, 24}
