"""One entry for all kinds of runs: reads a table, runs what the config asks, writes the result."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidemark.errors import first_line
from tidemark.config import RF_SERVICE_GRID, ClassifyConfig, FeatureConfig, MultiSeriesConfig, RunConfig
from tidemark.operators import profile
from tidemark.plans import classification, forecasting, unsupervised
from tidemark.sources import readers, sinks
from tidemark.sources.results import RunStore

FORECAST_MODELS = {"rf", "sarimax", "multi"}


def option(config: dict, name: str, default):
    """An absent or empty option means its default."""
    value = config.get(name)
    return default if value is None else value


def run_forecast_config(df, config: dict, store: RunStore | None = None) -> dict:
    name = config.get("model_name")
    name = name.lower() if isinstance(name, str) else "rf"
    name = name if name in FORECAST_MODELS else "rf"
    features = FeatureConfig(tuple(option(config, "lags", FeatureConfig.lags)),
                             tuple(option(config, "roll_windows", FeatureConfig.roll_windows)),
                             bool(option(config, "add_calendar", True)))
    horizon, exog = int(option(config, "horizon", 14)), list(option(config, "exog_cols", []))
    keys = dict(target=config.get("target"), ts_col=config.get("ts_col"), exog_cols=exog)
    if name == "multi":
        cfg = MultiSeriesConfig(horizon=horizon, freq=option(config, "freq", "D"),
                                eval_metric=option(config, "eval_metric", "MAPE"),
                                time_limit=int(option(config, "time_limit", 600)),
                                models=tuple(option(config, "models", MultiSeriesConfig.models)))
        run = forecasting.run_multi_series(df, cfg, item_col=config.get("item_id_col"), features=features,
                                           item_fallback=option(config, "item_id_fallback", "series_0"),
                                           options=config.get("model_options"), save_dir=config.get("save_dir"), **keys)
        return forecasting.multi_result(run, store)
    cfg = RunConfig(horizon=horizon, initial_train=int(option(config, "initial_train", 360)),
                    step=int(option(config, "step", 14)), model_name=name,
                    search_space=option(config, "search_space", RF_SERVICE_GRID if name == "rf" else None),
                    feature_config=features, use_exog=bool(exog),
                    max_serialize_points=config.get("max_serialize_points"), mase_m=config.get("mase_m"),
                    max_ffill_steps=config.get("max_ffill_steps"))
    return forecasting.run_forecasting(df, cfg, freq=config.get("freq"), item_col=config.get("item_id_col"),
                                       max_folds=config.get("max_folds"), **keys).result(store)


def run_classification_config(spark: SparkSession, df, config: dict, root: str, dataset_id: int,
                              store: RunStore | None = None) -> dict:
    mode = option(config, "mode", "train").lower()
    key = option(config, "clf_model_key", "").strip()
    if mode == "train":
        key = key or f"models/dataset_{dataset_id}_classification"
        cfg = ClassifyConfig(**option(config, "options", {}))
        run = classification.run_classification(df, config.get("target"), keys=config.get("keys"), cfg=cfg,
                                                export_path=f"{root}/{key}")
        out = run.result()
        if store is not None and run.scored is not None:
            store.write("rows", run.scored.select(classification.LABEL, classification.PROBA))
        if run.export:
            out["export"] = {"clf_model_key": key, "meta_key": f"{key}.meta.json"}
            out["clf_model_key"] = key
        return out
    if mode == "predict":
        if not key:
            raise ValueError("mode='predict' needs clf_model_key")
        meta = config.get("meta_key")
        scored = classification.predict_classification_df(df, f"{root}/{key}", f"{root}/{meta}" if meta else None)
        shown = sinks.scored_output(spark, scored.persist(), root, dataset_id, bool(config.get("return_file")))
        return {"ok": True, "mode": "predict", "clf_model_key": key, **shown}
    raise ValueError(f"unsupported classification mode: {mode}")


def run_config(spark: SparkSession, path: str, config: dict, root: str, dataset_id: int = 0,
               name: str | None = None) -> dict:
    """Result document of a run, also written to ``results/{id}.json``; errors become documents.

    The rows of a run (forecasts, backtests, clusters, scores) are frames beside the document, see
    ``sources.results``.
    """
    kind = (config or {}).get("type")
    store = RunStore(spark, root, dataset_id)
    try:
        df = readers.load_table(spark, path, name)
        if kind == "forecasting":
            out = run_forecast_config(df, config, store)
        elif kind == "classification":
            out = run_classification_config(spark, df, config, root, dataset_id, store)
        elif kind == "clustering":
            out = unsupervised.run_clustering(df, int(option(config, "k", 5))).result(store)
        elif kind == "anomaly":
            out = unsupervised.run_anomaly(df).result(store)
        else:
            out = {"error": f"unknown run type: {kind}"}
    except Exception as e:
        store.abandon()
        out = {"error": first_line(e)}
    return store.commit(out)


def profile_config(spark: SparkSession, path: str, root: str, dataset_id: int = 0, name: str | None = None) -> dict:
    """Profile document, also written to ``profiles/{id}.json``."""
    try:
        df = readers.load_table(spark, path, name)
        columns = [r.asDict() for r in profile.quick_profile(df).collect()]
        rows = columns[0].pop("rows") if columns else 0
        for c in columns:
            c.pop("rows", None)
        payload = {"rows": rows, "cols": len(columns), "schema": columns}
    except Exception as e:
        return {"dataset_id": dataset_id, "error": first_line(e)}
    document = {"dataset_id": dataset_id, **payload}
    sinks.write_text(spark, f"{root}/profiles/{dataset_id}.json",
                     json.dumps(payload, ensure_ascii=False, default=sinks.plain))
    return document
