"""Job parameters as plain frozen dataclasses.

The defaults are the reference detector's documented defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the reference's defaults:
#   window size 1000, min samples 30, z threshold 3.0, IQR multiplier 1.5,
#   retrain interval 5000, 100 trees, contamination 0.05, seed 42,
#   features declared_value, quantity, weight_kg, unit_price,
#   severity thresholds LOW 2.0, MEDIUM 3.0, HIGH 4.0, CRITICAL 5.0,
#   dedup window 300 s, at most 100 alerts per minute.
DEFAULT_FEATURES = ("declared_value", "quantity", "weight_kg", "unit_price")
DEFAULT_SEVERITY = (("LOW", 2.0), ("MEDIUM", 3.0), ("HIGH", 4.0), ("CRITICAL", 5.0))


@dataclass(frozen=True)
class DetectorParams:
    """Window and statistical-test parameters."""

    window_size: int = 1000
    min_samples: int = 30
    zscore_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    features: tuple[str, ...] = DEFAULT_FEATURES


@dataclass(frozen=True)
class ForestParams:
    """Online isolation-forest parameters.

    ``buffer_size`` is the number of most recent vectors a model is trained
    on; the live detector passes its window size (1000) here.
    """

    n_estimators: int = 100
    contamination: float = 0.05
    buffer_size: int = 1000
    retrain_interval: int = 5000
    random_state: int = 42
    min_train: int = 50
    max_samples: int = 256


@dataclass(frozen=True)
class AlertParams:
    """Severity, deduplication and rate-limit parameters."""

    severity_thresholds: tuple[tuple[str, float], ...] = DEFAULT_SEVERITY
    dedup_window_seconds: float = 300.0
    max_alerts_per_minute: int = 100
    rate_window_seconds: float = 60.0
    score_scale_forest: float = 5.0
