import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, MultiSeriesConfig, RunConfig
from tidemark.models.base import HAT, load, make
from tidemark.operators import evaluate, isolation
from tidemark.operators.features import feature_matrix, feature_names
from tidemark.operators.series import ITEM, TS, Y
from tidemark.plans import backtest as bt
from tidemark.plans import forecasting
from tidemark.session import fresh_path

SMALL = FeatureConfig((1, 7), (7,), True)


@pytest.fixture(scope="module")
def weekly(spark):
    """Two series with a weekly pattern and a slope."""
    rows = [(i, dt.datetime(2023, 1, 1) + dt.timedelta(days=t), 10.0 * k + 5.0 * (t % 7) + 0.1 * t)
            for k, i in enumerate(("a", "b"), 1) for t in range(140)]
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double").persist()


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col(Y) - F.col(HAT)) ** 2))).first()[0]


@pytest.mark.parametrize("name", ["ets", "sarimax", "theta"])
def test_models_beat_the_last_value(spark, weekly, name):
    plan = bt.FoldPlan(70, 14, 14)
    ours = rmse(bt.rolling_backtest(weekly, make(name, horizon=14), plan))
    last = rmse(bt.rolling_backtest(weekly, make("seasonal_naive", season=1, horizon=14), plan))
    assert ours < last


def test_fold_tables_agree_with_slicing(spark, weekly):
    plan = bt.FoldPlan(100, 10, 15, None)
    indexed = bt.index_rows(weekly)
    train, test = bt.train_rows(indexed, plan), bt.test_rows(indexed, plan)
    folds = [i for i in range(100, 140 - 15 + 1, 10)]
    for k, i in enumerate(folds):
        assert train.where(f"item_id = 'a' AND fold = {k}").count() == i
        got = [r["rn"] for r in test.where(f"item_id = 'a' AND fold = {k}").orderBy("h").collect()]
        assert got == list(range(i, i + 15))
    assert test.agg(F.max("fold")).first()[0] == len(folds) - 1
    assert bt.test_rows(indexed, bt.FoldPlan(100, 10, 15, 1)).select("fold").distinct().count() == 1


def test_array_models_give_the_same_in_and_out_of_a_backtest(spark, weekly):
    model = make("ets", horizon=7)
    fold = bt.rolling_backtest(weekly, model, bt.FoldPlan(133, 7, 7)).orderBy(ITEM, TS).collect()
    cut = weekly.where(F.col(TS) < dt.datetime(2023, 1, 1) + dt.timedelta(days=133))
    direct = model.forecast(cut, 7).orderBy(ITEM, TS).collect()
    assert [(r[ITEM], r[TS], round(r[HAT], 8)) for r in fold] == [(r[ITEM], r[TS], round(r[HAT], 8)) for r in direct]


def test_first_recursive_step_equals_transform_and_survives_saving(spark, weekly):
    model = make("rf", features=SMALL, params={"n_estimators": 5, "max_depth": 4}, horizon=3).fit(weekly)
    made = model.forecast(weekly, 3)
    first = {r[ITEM]: r[HAT] for r in made.where("h = 1").collect()}
    ahead = made.where("h = 1").select(ITEM, TS, F.lit(None).cast("double").alias(Y))
    rows = feature_matrix(weekly.unionByName(ahead), SMALL).where(F.col(Y).isNull())
    from pyspark.ml.feature import VectorAssembler
    vectors = VectorAssembler(inputCols=feature_names(SMALL), outputCol="features").transform(rows)
    direct = {r[ITEM]: r[HAT] for r in model.model.transform(vectors).collect()}
    assert first == pytest.approx(direct)
    path = fresh_path(spark, "forecaster")
    model.save(spark, path)
    again = load(spark, path).forecast(weekly, 3)
    key = lambda df: [(r[ITEM], r[TS], r[HAT]) for r in df.orderBy(ITEM, TS).collect()]
    assert key(again) == key(made)


@pytest.mark.parametrize("name", ["rf", "recursive_tabular"])
def test_recursive_forecast_equals_a_plain_loop_for_models_of_any_size(spark, weekly, monkeypatch, name):
    from pyspark.ml.linalg import Vectors

    from tidemark.functions.calendar import CALENDAR_NAMES
    from tidemark.models import trees
    cfg = FeatureConfig((1, 2, 9), (3, 8), True)
    start = dt.datetime(2023, 5, 21)
    short = [("c", start - dt.timedelta(days=k), v) for k, v in ((5, 4.0), (4, None), (3, float("nan")), (2, 7.0), (1, 9.0))]
    history = weekly.unionByName(spark.createDataFrame(short, weekly.schema)).persist()
    model = make(name, features=cfg, params={"n_estimators": 6, "max_depth": 5}).fit(weekly)
    steps = {"a": 11, "b": 3, "c": 11}
    future = spark.createDataFrame([(i, start + dt.timedelta(days=h - 1), h) for i, n in steps.items() for h in range(1, n + 1)],
                                   "item_id string, timestamp timestamp_ntz, h int")
    known = {(r[ITEM], r["h"]): [float(r[c]) for c in CALENDAR_NAMES]
             for r in feature_matrix(future.withColumn(Y, F.lit(0.0)), cfg).collect()}
    want = {}
    for item, n in steps.items():
        past = [r[Y] for r in history.where(F.col(ITEM) == item).orderBy(TS).collect()]
        past = [None if v != v else v for v in past]
        for h in range(1, n + 1):
            lags = [past[-k] if len(past) >= k and past[-k] is not None else 0.0 for k in cfg.lags]
            means = [0.0 if len(past) < w or None in past[-w:] else sum(past[-w:]) / w for w in cfg.roll_windows]
            past.append(model.model.predict(Vectors.dense(lags + means + known[item, h])))
            want[item, h] = past[-1]
    for nodes in (trees.BLOCK_NODES, 1, 2 * model.model.totalNumNodes):  # seven, one and two steps a block
        monkeypatch.setattr(trees, "BLOCK_NODES", nodes)
        got = {(r[ITEM], r["h"]): r[HAT] for r in model.forecast(history, 11, future).collect()}
        assert got == pytest.approx(want)
    assert model.forecast(history, 2).where("item_id = 'c'").count() == 2
    assert model.forecast(history, 11, future.limit(0)).count() == 0


def test_search_takes_the_best_and_skips_failures(spark, weekly):
    plan = bt.FoldPlan(100, 20, 7)
    space = [{"order": "broken"}, {"order": (1, 0, 0), "seasonal_order": (0, 1, 0, 7)}]
    found = bt.grid_search(weekly, "sarimax", space, plan)
    assert found.params["order"] == (1, 0, 0) and found.scores[0]["error"]
    assert bt.candidates({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert bt.candidates({"order": [1, 1, 1]}) == [{"order": (1, 1, 1)}]
    assert bt.candidates({"order": {"p": 2, "d": 1, "q": 0}}) == [{"order": (2, 1, 0)}]
    with pytest.raises(RuntimeError):
        bt.grid_search(weekly, "sarimax", [{"order": "broken"}], plan)


def test_forecast_run_returns_the_documented_parts(spark, weekly):
    one = weekly.where("item_id = 'a'").select(F.col(TS).alias("day"), F.col(Y).alias("sales"))
    cfg = RunConfig(horizon=7, initial_train=100, step=14, model_name="sarimax",
                    search_space=[{"order": (1, 0, 0), "seasonal_order": (0, 1, 0, 7)}], max_serialize_points=10)
    out = forecasting.run_forecasting(one, cfg).result()
    assert set(out) == {"model_name", "best_params", "backtest", "diagnostics", "final_forecast"}
    assert len(out["final_forecast"]) == 7 and out["final_forecast"][0]["ts"] == "2023-05-21T00:00:00"
    with pytest.raises(ValueError, match="fewer than"):
        forecasting.run_forecasting(one, RunConfig(horizon=7, initial_train=500, model_name="sarimax"))


def test_multi_series_run(spark, weekly):
    cfg = MultiSeriesConfig(horizon=7, models=("seasonal_naive", "npts"))
    run = forecasting.run_multi_series(weekly, cfg, Y, TS, ITEM)
    assert run.forecast.count() == 14 and {"p10", "p50", "p90"} <= set(run.forecast.columns)
    out = forecasting.multi_result(run)
    assert out["summary"]["multi_series"] and out["best_model"] in cfg.models


def test_roll_forward_covers_any_length(spark, weekly):
    out = forecasting.roll_forward(make("seasonal_naive", horizon=5), weekly, 12, 5)
    assert out.count() == 24
    assert [r["h"] for r in out.where("item_id = 'a'").orderBy(TS).collect()] == list(range(1, 13))


def test_no_overlap_is_an_error(spark, weekly):
    ahead = make("seasonal_naive").forecast(weekly, 3)
    with pytest.raises(ValueError):
        evaluate.require_overlap(evaluate.align(weekly, ahead))


@pytest.fixture(scope="module")
def uneven(spark):
    """Items of different length, and one too short for any fold."""
    rows = [(i, dt.datetime(2023, 1, 1) + dt.timedelta(days=t), 10.0 + t % 7 + 0.1 * t)
            for i, n in (("a", 120), ("b", 100), ("c", 90), ("d", 20)) for t in range(n)]
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double").persist()


@pytest.mark.parametrize("plan", [bt.FoldPlan(60, 14, 14), bt.FoldPlan(60, 14, 14, 1), bt.FoldPlan(1, 1, 14, 2)])
def test_all_models_answer_the_same_folds(uneven, plan):
    def keys(name, **params):
        model = make(name, features=SMALL, params=params, horizon=plan.horizon)
        got = bt.rolling_backtest(uneven, model, plan).select(ITEM, "fold", "h").collect()
        assert len(got) == len(set(got))
        return set(got)

    want = keys("seasonal_naive")
    assert {k[0] for k in want} >= {"a", "b", "c"}
    for name in ("rf", "recursive_tabular", "direct_tabular"):
        assert keys(name, n_estimators=2, max_depth=3) == want


def test_depth_beyond_spark_is_an_error(uneven):
    with pytest.raises(ValueError):
        make("rf", features=SMALL, params={"max_depth": 31}, horizon=3).fit(uneven)


def test_short_items_are_named(spark, uneven):
    cfg = RunConfig(model_name="seasonal_naive", horizon=14, initial_train=60, step=14)
    run = forecasting.run_forecasting(uneven, cfg, Y, TS, freq="D", item_col=ITEM)
    assert [r[ITEM] for r in run.skipped.collect()] == ["d"]
    assert run.result()["backtest"]["skipped_count"] == 1


def test_ljung_box_of_overlapping_folds_is_determined(uneven):
    plan = bt.FoldPlan(60, 3, 14)
    made = bt.rolling_backtest(uneven, make("seasonal_naive", horizon=14), plan).withColumn(HAT, F.col(HAT) + F.rand(1))
    made = made.persist()
    first = {r[ITEM]: r["lb_stat"] for r in evaluate.ljung_box(made).collect()}
    again = {r[ITEM]: r["lb_stat"] for r in evaluate.ljung_box(made.repartition(7, "h")).collect()}
    assert first == pytest.approx(again)


def test_no_model_starts_after_the_time_limit(uneven):
    _, rows = bt.leaderboard(uneven, ["seasonal_naive", "theta"], bt.FoldPlan(1, 1, 14, 1), "smape", threads=1, time_limit=0.0)
    assert [r["error"] is None for r in rows] == [True, False] and "time limit" in rows[1]["error"]


def test_search_space_forms():
    assert bt.candidates({"order": [1, 0, 0], "seasonal_order": (0, 1, 1, 7)}) == [{"order": (1, 0, 0), "seasonal_order": (0, 1, 1, 7)}]
    assert bt.candidates({"order": {"p": 1, "d": 0, "q": 2}}) == [{"order": (1, 0, 2)}]
    assert bt.candidates({"order": [(1, 0, 0), (0, 1, 1)]}) == [{"order": (1, 0, 0)}, {"order": (0, 1, 1)}]
    assert len(bt.candidates({"max_depth": [3, 5], "n_estimators": [10, 20]})) == 4


@pytest.mark.parametrize("plan", [bt.FoldPlan(3, 11, 14), bt.FoldPlan(40, 7, 5), bt.FoldPlan(1, 3, 14, 3)])
@pytest.mark.parametrize("name,params", [("theta", {}), ("theta", {"seasonal": False, "alpha": 0.5}), ("npts", {}), ("npts", {"decay": 0.3}),
                                         ("ets", {}), ("ets", {"rates": (0.2, 0.7)})])
def test_all_folds_at_once_equal_folds_on_their_own(uneven, name, params, plan):
    """Every fold forecast from a copy of its own history gives the same."""
    model = make(name, params=params, horizon=plan.horizon)
    got = {(r[ITEM], r["fold"], r["h"]): r[HAT] for r in bt.rolling_backtest(uneven, model, plan).collect()}
    own = F.concat(F.col(ITEM), F.lit(bt._MARK), F.col("fold").cast("string"))
    history = bt.train_rows(bt.index_rows(uneven), plan).withColumn(ITEM, own)
    alone = {(r[ITEM], r["fold"], r["h"]): r[HAT] for r in bt._split_name(model.forecast(history.select(ITEM, TS, Y), plan.horizon)).collect()}
    assert got and got.keys() <= alone.keys()
    for k, v in got.items():
        assert (v is None and alone[k] is None) or v == pytest.approx(alone[k], rel=1e-9, abs=1e-9)


def test_smoothing_carries_its_state_across_batches(spark, uneven):
    want = {(r[ITEM], r["fold"], r["h"]): r[HAT] for r in bt.rolling_backtest(uneven, make("ets", horizon=7), bt.FoldPlan(20, 9, 7)).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        again = bt.rolling_backtest(uneven, make("ets", horizon=7), bt.FoldPlan(20, 9, 7)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(r[ITEM], r["fold"], r["h"]): r[HAT] for r in again} == want


def test_smoothing_passes_over_missing_values():
    from tidemark.models.ets import Smoother, smoothed
    states = Smoother(1, (0.5,))
    for v in (4.0, float("nan"), 8.0):
        states.push(v)
    assert states.forecast(1)[0] in (6.0, pytest.approx(6.0 + 0.5 * 2.0))
    import numpy as np
    assert np.isfinite(smoothed(np.array([1.0, np.nan] * 20), 7, 5)).all() and smoothed(np.zeros(0), 7, 2).tolist() == [0, 0]


def test_candidates_are_rows_of_one_search(spark, uneven):
    plan = bt.FoldPlan(60, 14, 7)
    space = [{"order": "broken"}, {"order": (0, 1, 0)}, {"order": (0, 1, 0)}, {"order": (1, 0, 0)}]
    found = bt.grid_search(uneven, "arima", space, plan)
    board = {r["candidate"]: r for r in found.board.collect()}
    assert board[0]["error"] and board[0]["rank"] is None
    assert board[1]["rmse"] == board[2]["rmse"] and board[2]["rank"] == board[1]["rank"] + 1  # the first of equals
    best = min((k for k in board if board[k]["rank"] == 1))
    alone = bt.rolling_backtest(uneven, make("arima", params=found.params, horizon=7), plan)
    assert rmse(alone) == pytest.approx(board[best]["rmse"]) and found.backtest.count() == alone.count()
    plain = bt.grid_search(uneven, "seasonal_naive", {"season": [1, 7]}, plan)
    assert plain.params == {"season": 7} and [s["error"] for s in plain.scores] == [None, None]
    trees = bt.grid_search(uneven, "rf", {"n_estimators": [2], "max_depth": [2, 31]}, bt.FoldPlan(60, 14, 7, 1), features=SMALL)
    assert trees.params["max_depth"] == 2 and trees.scores[1]["error"]


def test_a_slow_model_ends_at_the_time_limit(spark, uneven, monkeypatch):
    import time

    from tidemark.models.registry import MODELS
    from tidemark.models.theta import Theta

    class Slow(Theta):
        name = "slow"

        def forecast_folds(self, indexed, plan):
            def wait(batches):
                for batch in batches:
                    time.sleep(60)
                    yield batch
            made = super().forecast_folds(indexed, plan)
            return made.mapInArrow(wait, made.schema)

    monkeypatch.setitem(MODELS, "slow", Slow)
    start = time.monotonic()
    board = bt.leaderboard(uneven, ["seasonal_naive", "slow", "npts"], bt.FoldPlan(1, 1, 14, 1), "smape", time_limit=8.0)
    assert time.monotonic() - start < 30
    errors = {r["model"]: r["error"] for r in board.rows}
    assert "time limit" in errors["slow"] and errors["seasonal_naive"] is None and errors["npts"] is None
    assert set(board.backtests) == {board.rows[0]["model"]} and uneven.count() == 330  # others' jobs go on


def test_forest_draw_is_full_for_a_key_of_few_values(spark):
    df = spark.range(20000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    for seed in (1, 2, 3):
        drawn = isolation.draw_sample(df, ["v"], 20000, 10, 256, seed, ["k"])
        sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
        assert sizes == {t: 256 for t in range(10)}
