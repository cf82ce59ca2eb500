"""The values that operators work with, in one place."""

from __future__ import annotations

from dataclasses import dataclass

HOUR, DAY = 3600, 86400


@dataclass(frozen=True)
class Config:
    # Fixed values of the study: they must stay as they are for equal results.
    study_start: str = "2025-09-01"
    study_end: str = "2026-08-01"
    exchanges: tuple[str, ...] = ("Nasdaq", "NYSE")
    min_price: float = 5.0
    min_adv: float = 5_000_000.0
    history_days: int = 365
    max_tickers: int = 1500
    min_bars: int = 200
    stale_days: int = 10
    prior_filing_days: int = 365
    forms: tuple[str, ...] = ("8-K", "8-K/A")
    excluded_items: tuple[str, ...] = ("9.01", "5.07")
    scheduled_items: tuple[str, ...] = ("2.02",)
    focus_items: tuple[str, ...] = ("1.01", "5.02", "8.01")
    news_tier: int = 2
    t0_lookback_s: int = 3 * HOUR
    census_gaps_h: tuple[int, ...] = (6, 24, 72)
    materiality_h: int = 24
    min_abs_return: float = 0.03
    pad_before_days: int = 30
    pad_after_days: int = 5
    coverage_tolerance_days: int = 7
    min_session_coverage: float = 0.9
    horizons: tuple[int, ...] = (1, 4, 24, 120)
    z_window: int = 480
    z_min: int = 120
    vol_window: int = 120
    news_windows_h: tuple[int, ...] = (24, 168)
    sample_ratio: int = 3
    quiet_gap_h: int = 168
    seed: int = 42
    horizon_bars: int = 48
    reward_correct: float = 1.0
    reward_early: float = 0.5
    reward_false: float = -2.0
    reward_wait: float = -0.005
    reward_missed: float = -0.5
    cusum_k: float = 1.5
    cusum_h: float = 1.5
    z_threshold: float = 2.648
    trees: int = 400
    tree_depth: int = 4
    tree_rate: float = 0.05
    outcome_h: int = 48
    overlap_h: int = 72
    obs_clip: float = 10.0
    budget_per_month: float = 2.0
    calibration_bins: int = 10
    split: tuple[float, float, float] = (0.70, 0.15, 0.15)


#: For data of one month with a bar for some hours only: windows of a day rather than of weeks.
SMALL = Config(
    study_start="2024-01-03", study_end="2024-01-29", min_price=0.5, min_adv=20.0, history_days=10, max_tickers=60, min_bars=5, stale_days=5,
    prior_filing_days=60, coverage_tolerance_days=3, pad_before_days=5, pad_after_days=2, min_session_coverage=0.5, horizons=(1, 4), z_window=24,
    z_min=8, vol_window=8, news_windows_h=(24, 72), quiet_gap_h=12, horizon_bars=8, z_threshold=1.5, cusum_k=0.5, cusum_h=2.0, t0_lookback_s=24 * HOUR,
)
