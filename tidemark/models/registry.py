"""Forecasters by name; add a class here to make it available to search and leaderboard."""

from __future__ import annotations

from tidemark.models.arrays import Arima, Sarimax
from tidemark.models.base import Forecaster
from tidemark.models.ets import Ets
from tidemark.models.naive import SeasonalNaive
from tidemark.models.npts import Npts
from tidemark.models.theta import Theta
from tidemark.models.trees import DirectBoosted, RecursiveBoosted, RecursiveForest

MODELS: dict[str, type[Forecaster]] = {
    c.name: c for c in (SeasonalNaive, Ets, Npts, Theta, Arima, Sarimax, RecursiveForest, RecursiveBoosted,
                        DirectBoosted)
}
