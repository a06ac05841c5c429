"""Options with the documented defaults, and the fixed values behind the heuristics."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column names that usually hold a binary label, in order of preference.
LIKELY_TARGET_NAMES = (
    "target", "label", "churn", "is_churn", "converted", "is_converted", "won", "is_won",
    "default", "is_default", "fraud", "is_fraud", "cancelled", "is_cancelled", "returned",
    "is_returned", "active", "is_active", "spam", "is_spam", "approved", "is_approved",
    "success", "is_success",
)

# Spellings of a positive label.
YES_WORDS = (
    "1", "true", "t", "y", "yes", "on", "positive", "won", "converted", "churn", "fraud",
    "default", "cancelled", "returned", "active", "ja", "sí", "oui", "vero", "sim", "是",
    "はい", "да", "ano",
)

# Spellings of a negative label.
NO_WORDS = (
    "0", "false", "f", "n", "no", "off", "negative", "lost", "not_converted", "no_churn",
    "not_fraud", "no_default", "not_cancelled", "not_returned", "inactive", "nein", "não",
    "non", "нет", "いいえ", "否", "nej",
)

# Slovenian public holidays on fixed dates, as (month, day).
FIXED_HOLIDAYS = (
    (1, 1), (1, 2), (2, 8), (4, 27), (5, 1), (5, 2), (6, 25), (8, 15), (10, 31), (11, 1),
    (12, 25), (12, 26),
)

# Names that mark a time or a target column of an uploaded series.
TIME_NAMES = ("dt", "date", "timestamp", "time", "datetime")
TARGET_NAMES = ("request_cnt", "y", "target", "value")

# Seasonal period of each frequency.
SEASON = {"H": 24, "D": 7, "W": 52, "M": 12, "MS": 12}


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 7, 14, 28)
    roll_windows: tuple[int, ...] = (7, 14, 28)
    add_calendar: bool = True

    @property
    def reach(self) -> int:
        """Rows of history a feature row needs."""
        return max((*self.lags, *self.roll_windows), default=0)


# Default search spaces.
RF_GRID = {"max_depth": [6, 10], "min_samples_leaf": [1, 4], "n_estimators": [300, 600]}
RF_SERVICE_GRID = {"max_depth": [8, 12], "min_samples_leaf": [1, 3], "n_estimators": [300, 600]}
SARIMAX_GRID = [
    {"order": (1, 1, 1), "seasonal_order": (1, 1, 1, 7)},
    {"order": (2, 1, 1), "seasonal_order": (1, 1, 1, 7)},
    {"order": (1, 1, 2), "seasonal_order": (1, 1, 1, 7)},
]


@dataclass
class RunConfig:
    """Forecast run: rolling-origin search, then a fit on all history."""

    horizon: int = 14
    initial_train: int = 360
    step: int = 14
    model_name: str = "rf"
    search_space: dict | list | None = None
    feature_config: FeatureConfig = field(default_factory=FeatureConfig)
    use_exog: bool = False
    max_serialize_points: int | None = None
    mase_m: int | None = None
    max_ffill_steps: int | None = None

    def __post_init__(self):
        if self.search_space is None:
            self.search_space = {"rf": RF_GRID, "sarimax": SARIMAX_GRID}.get(self.model_name, {})


@dataclass
class MultiSeriesConfig:
    """Multi-model run over many series."""

    horizon: int = 14
    freq: str = "D"
    eval_metric: str = "MAPE"
    time_limit: int = 600
    models: tuple[str, ...] = ("seasonal_naive", "ets", "npts")
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    short_series: str = "train"
    cap_quantile: float | None = None


@dataclass(frozen=True)
class ClassifyConfig:
    missing_drop: float = 0.98
    id_ratio: float = 0.95
    datetime_ratio: float = 0.70
    numeric_like_ratio: float = 0.85
    text_min_avg_len: int = 15
    text_min_unique: int = 30
    ohe_max_categories: int = 50
    ohe_min_freq: float = 0.01
    tfidf_max_features: int = 3000
    tfidf_min_df: int = 2
    tfidf_max_df: float = 0.98
    imbalance_ratio: float = 3.0
    cv_max_splits: int = 5
    use_calibration: bool = True
    calibration_method: str = "isotonic"
    calibration_min_valid: int = 100
    # boosted trees
    n_estimators: int = 400
    patience: int = 50  # rounds without a better validation AUROC after which boosting ends
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.9
    colsample: float = 0.9
    seed: int = 42
    # epoch strings: the documented default leaves them numeric
    parse_epochs: bool = False
