"""What every forecaster offers.

``history`` is a gridded long series; ``future`` holds covariates for the forecast rows,
``item_id, timestamp, h`` and the covariate columns.  ``forecast`` returns
``item_id, timestamp, h, y_hat`` and, where the model gives them, quantile columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from tidemark.config import SEASON, FeatureConfig
from tidemark.operators.series import ITEM, TS

ID, STEP, HAT = ITEM, "h", "y_hat"


@dataclass
class Forecaster:
    freq: str = "D"
    season: int | None = None
    exog: tuple[str, ...] = ()
    features: FeatureConfig = field(default_factory=FeatureConfig)
    params: dict[str, Any] = field(default_factory=dict)
    horizon: int = 14

    name = "base"
    pooled = False           # one model over all items, fitted per fold
    allowed: ClassVar[tuple[str, ...]] = ()

    def __post_init__(self):
        if self.season is None:
            self.season = SEASON.get(self.freq, 1)
        self.params = {k: v for k, v in self.params.items() if k in self.allowed}
        if "season" in self.params:
            self.season = int(self.params["season"])

    @property
    def reach(self) -> int | None:
        """Rows of history a forecast reads; None for all of it."""
        return None

    @property
    def uses_exog(self) -> bool:
        return False

    def fit(self, train: DataFrame) -> "Forecaster":
        return self

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    # models that can answer all cut-offs of a fold plan in one pass have
    # forecast_folds(indexed, plan) -> item_id, fold, h, y_hat

    def spec(self) -> dict:
        return {"name": self.name, "freq": self.freq, "season": self.season, "exog": list(self.exog),
                "params": self.params, "horizon": self.horizon,
                "features": {"lags": list(self.features.lags), "roll_windows": list(self.features.roll_windows),
                             "add_calendar": self.features.add_calendar}}

    def save(self, spark, path: str) -> None:
        """Model folder: ``spec.json`` and whatever the model itself has to keep."""
        text = json.dumps(self.spec(), ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        self.save_state(path)

    def save_state(self, path: str) -> None:
        pass

    def load_state(self, spark, path: str) -> None:
        pass


def make(name: str, **options) -> Forecaster:
    from tidemark.models.registry import MODELS
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; available: {sorted(MODELS)}")
    return MODELS[name](**options)


def load(spark, path: str) -> Forecaster:
    spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    f = spec.pop("features")
    cfg = FeatureConfig(tuple(f["lags"]), tuple(f["roll_windows"]), f["add_calendar"])
    model = make(spec.pop("name"), features=cfg, **{**spec, "exog": tuple(spec["exog"])})
    model.load_state(spark, path)
    return model


__all__ = ["Forecaster", "make", "load", "ITEM", "TS", "STEP", "HAT"]
