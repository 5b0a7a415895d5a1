import json

import pytest

from loomline import __main__ as cli
from loomline import models

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_registry():
    assert len(models.keys()) == 18 and len(set(models.keys())) == 18
    assert models.columns_of("P", []) == models.columns_of("P", ["en_sent_mean"]) and "ret_lag1" in models.columns_of("P", [])
    assert "en_sent_mean" in models.columns_of("P_EN", ["en_sent_mean"]) and "all_sent_mean" in models.columns_of("P_EN_RU", ["all_sent_mean"])


def test_steps_without_a_session(capsys, tmp_path):
    cli.main(["queries"])
    assert "feature_table" in capsys.readouterr().out.split()
    cli.main(["environment", "--out", f"{tmp_path}/e/env.json"])
    assert "packages" in json.loads((tmp_path / "e" / "env.json").read_text())
    with pytest.raises(SystemExit):
        cli.main(["models"])


def test_query_models_and_report(spark, tmp_path):
    cli.main(["query", "candle_ohlcv", "--data", SF, "--out", f"{tmp_path}/q"])
    assert spark.read.parquet(f"{tmp_path}/q").count() > 0
    for _ in range(2):
        cli.main(["models", "--data", LARGER, "--out", f"{tmp_path}/m", "--models", "zero", "forest:P", "arima:P", "--smoke"])
    folders = sorted(x.name for x in (tmp_path / "m").iterdir())
    assert folders == ["arima-P", "forest-P", "zero-P"]
    rows = spark.read.option("basePath", f"{tmp_path}/m/forest-P").parquet(f"{tmp_path}/m/forest-P/fold=*/seed=*")
    assert {"fold", "seed", "y_pred"} <= set(rows.columns) and rows.count() > 0
    cli.main(["models", "--data", LARGER, "--out", f"{tmp_path}/m", "--models", "zero", "--smoke", "--restart"])
    assert len([x for x in (tmp_path / "m").iterdir() if x.name.startswith("zero-P.")]) == 1
    cli.main(["report", "--data", SF, "--out", f"{tmp_path}/r", "--sheets", "coverage", "flags"])
    assert {r.sheet for r in spark.read.csv(f"{tmp_path}/r/contents", header=True).collect()} == {"coverage", "flags"}
    assert len(cli.SHEETS) == 17
