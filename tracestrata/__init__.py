"""Behavioural analytics and process mining over code-hosting event archives, on Spark."""

from tracestrata.errors import (
    AnalyticsError,
    CalculationError,
    ConcurrentWriteError,
    ContractError,
    DataPreparationError,
    MissingDataError,
)
from tracestrata.session import build_session, ensure_utc, materialize, scratch_dir
from tracestrata.settings import AnalysisSettings, MinerSettings, Store

__all__ = [
    "AnalysisSettings",
    "AnalyticsError",
    "CalculationError",
    "ConcurrentWriteError",
    "ContractError",
    "DataPreparationError",
    "MinerSettings",
    "MissingDataError",
    "Store",
    "build_session",
    "ensure_utc",
    "materialize",
    "scratch_dir",
]
