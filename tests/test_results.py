"""Results as files: committed whole, read back, never through the driver."""

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.config import MultiSeriesConfig, RunConfig
from tidemark.operators.series import ITEM, TS, Y
from tidemark.plans import dispatch, forecasting
from tidemark.session import fresh_path
from tidemark.sources import results, sinks
from tidemark.sources.readers import path_exists
from tidemark.sources.registry import DatasetRegistry
from tidemark.sources.results import RunStore, read_document, read_frame


@pytest.fixture(scope="module")
def many(spark):
    rows = [(f"i{k}", dt.datetime(2023, 1, 1) + dt.timedelta(days=t), 10.0 + k + t % 7) for k in range(30) for t in range(100)]
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double").persist()


def run(many):
    cfg = RunConfig(model_name="seasonal_naive", horizon=14, initial_train=60, step=14)
    return forecasting.run_forecasting(many, cfg, Y, TS, freq="D", item_col=ITEM)


def test_documents_are_bounded_and_files_whole(spark, many, monkeypatch):
    root = fresh_path(spark, "root")
    monkeypatch.setattr(results.first_rows, "__kwdefaults__", {"most": 50})
    done = run(many)
    store = RunStore(spark, root, 3)
    made = store.commit(done.result(store))
    assert len(made["final_forecast"]) == len(made["backtest"]["preds"]) == 50
    assert len(made["diagnostics"]["residuals"]["summary"]) == 30 and json.loads(json.dumps(made, default=sinks.plain))
    document = read_document(spark, root, 3)
    assert document["frames"]["forecast"]["rows"] == 30 * 14 == read_frame(spark, root, 3, "forecast").count()
    folds = read_frame(spark, root, 3, "backtest")
    assert folds.count() == done.backtest.count() == document["frames"]["backtest"]["rows"]
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1}
    names = {"forecast", "backtest", "residual_summary", "ljung_box", "item_errors", "candidates", "skipped", "backtest.csv", "per_item_smape.csv"}
    assert set(document["frames"]) == names
    by_hand = {r["item_id"]: r["smape"] for r in read_frame(spark, root, 3, "per_item_smape.csv").collect()}
    assert by_hand == {r[ITEM]: pytest.approx(r["smape"]) for r in read_frame(spark, root, 3, "item_errors").collect()}
    with pytest.raises(KeyError):
        read_frame(spark, root, 3, "nothing")


def test_a_result_is_replaced_whole(spark, many):
    root = fresh_path(spark, "root")
    first, second = RunStore(spark, root, 4), RunStore(spark, root, 4)
    first.write("rows", many)
    first.commit({"n": 1})
    second.write("rows", many.limit(7))
    assert read_document(spark, root, 4)["n"] == 1 and read_frame(spark, root, 4, "rows").count() == 3000  # not committed yet
    second.commit({"n": 2})
    assert read_document(spark, root, 4)["n"] == 2 and read_frame(spark, root, 4, "rows").count() == 7
    assert not path_exists(spark, f"{root}/results/4/{first.run}")
    broken = RunStore(spark, root, 4)
    with pytest.raises(Exception):
        broken.write("rows", many.withColumn("bad", F.raise_error(F.lit("no"))))
    broken.abandon()
    assert read_frame(spark, root, 4, "rows").count() == 7


def test_every_kind_of_run_leaves_its_rows(spark, many):
    root, path = fresh_path(spark, "root"), fresh_path(spark, "table") + ".parquet"
    points = [(float(i % 9), float(i % 5), "yes" if i % 9 > 4 else "no") for i in range(300)]
    spark.createDataFrame(points, "x double, y double, label string").write.parquet(path)
    clusters = dispatch.run_config(spark, path, {"type": "clustering", "k": 3}, root, 1)
    assert clusters["frames"]["rows"]["rows"] == 300 and "cluster" in read_frame(spark, root, 1, "rows").columns
    dispatch.run_config(spark, path, {"type": "anomaly"}, root, 2)
    assert read_frame(spark, root, 2, "rows").count() == 300
    options = {"n_estimators": 3, "max_depth": 2}
    learned = dispatch.run_config(spark, path, {"type": "classification", "target": "label", "options": options}, root, 3)
    assert 0 < learned["frames"]["rows"]["rows"] < 300
    wrong = dispatch.run_config(spark, path, {"type": "forecasting", "model_name": "multi", "target": "nothing"}, root, 1)
    assert "error" in wrong and "frames" not in wrong and read_document(spark, root, 1)["error"]
    table = fresh_path(spark, "series") + ".parquet"
    many.write.parquet(table)
    config = {"type": "forecasting", "model_name": "multi", "models": ["seasonal_naive", "npts"], "target": Y, "ts_col": TS, "item_id_col": ITEM}
    made = dispatch.run_config(spark, table, config, root, 5)
    assert made["frames"]["forecast"]["rows"] == 30 * 14 and made["frames"]["leaderboard"]["rows"] == 2
    assert {"mean", "p10", "p50", "p90"} <= set(read_frame(spark, root, 5, "forecast").columns)


def test_multi_result_without_a_store(spark, many):
    made = forecasting.run_multi_series(many.limit(200), MultiSeriesConfig(horizon=7, models=("seasonal_naive",)), Y, TS, ITEM)
    assert "frames" not in forecasting.multi_result(made)


def test_many_writers_get_an_id_each(spark):
    root = fresh_path(spark, "registry")
    registry = DatasetRegistry(spark, root)
    with ThreadPoolExecutor(10) as pool:
        ids = list(pool.map(lambda k: registry.create(f"p{k}", f"n{k}", must_exist=False), range(20)))
    assert sorted(ids) == sorted(set(ids)) and registry.table().count() == 20
    assert {r["id"] for r in registry.table().collect()} == set(ids)
    assert all(registry.get(i)["path"] == f"p{k}" for k, i in enumerate(ids[:3]))
