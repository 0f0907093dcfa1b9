"""Parameters of the analyses, with their defaults. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sampling:
    interval_ms: int = 5_000
    inactive_ms: int = 180_000
    depth_bps: tuple[int, ...] = (5, 10, 25, 50, 100)
    spread_thresholds: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50)
    longest_gap_s: int = 60

    @property
    def move_tolerance_ms(self) -> int:
        return max(self.interval_ms * 3 // 2, 2_500)


@dataclass(frozen=True)
class Markouts:
    horizons_s: tuple[int, ...] = (1, 5, 30, 60)
    reference_age_ms: int = 3_000
    tolerance_ms: int = 2_500


@dataclass(frozen=True)
class FillPolicy:
    bucket_ms: int = 30_000
    sizes_usd: tuple[int, ...] = (25, 50, 100)
    default_usd: int = 50
    horizons_s: tuple[int, ...] = (5, 30)
    meaningful: int = 100
    reliable: int = 500


@dataclass(frozen=True)
class Weights:
    trade_activity: float = 15.0
    estimated_maker_fill: float = 20.0
    spread: float = 20.0
    two_sided_depth: float = 15.0
    maker_markout: float = 20.0
    data_quality_persistence: float = 10.0


@dataclass(frozen=True)
class Candidates:
    coverage_pct: float = 90.0
    trades_per_hour: float = 30.0
    depth_10bps_usd: float = 200.0
    spread_bps: float = 1.0
    markouts_5s: int = 20
    markouts_30s: int = 20
    fill_samples: int = 100
    hours: float = 1.0
    markout_5s_bps: float = -5.0
    markout_30s_bps: float = -15.0
    activity_rank: float = 20.0
    peers: int = 10
    trades_per_minute_median: float | None = None


@dataclass(frozen=True)
class Confidence:
    k_markout: float = 200.0
    k_fill: float = 200.0
    k_trade: float = 300.0
    tau_hours: float = 24.0
    least: float = 0.05
    low: float = 0.30
    high: float = 0.80
    markout: float = 0.35
    fill: float = 0.25
    coverage: float = 0.20
    trade: float = 0.10
    duration: float = 0.10
    share_5s: float = 0.7
    share_30s: float = 0.3


@dataclass(frozen=True)
class Screening:
    coverage: float = 0.90
    trades: int = 20
    spread_bps: float = 0.5
    top: int = 40


#: Order sizes in USD that a market is judged for.
SIZE_LADDER = (25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
#: Coverage in percent and the confidence there; straight lines between.
COVERAGE_ANCHORS = ((0.0, 0.0), (80.0, 0.5), (90.0, 0.8), (95.0, 0.95), (99.0, 1.0))
