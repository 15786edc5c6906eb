"""Fixed values of the bar data model and the feature configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass

# ---- fixed values: bar grid, epsilons, clip ---------------------------------------------------------
BAR_MS = 60_000
EPS_PX = 1e-8
EPS_CNT = 1e-9
EPS_SZ = 1e-9
EPS_OI = 1.0
EPS_VAR = 1e-8
EPS_VOL = 1e-8
CLIP = 5.0
RECON_LIMIT = 0.01

# ---- fixed values: feature order ---------------------------------------------------------------------
FEATURES = (
    "ret_close", "range", "body", "upper_wick_frac", "lower_wick_frac", "log_volume", "log_amount",
    "tfi", "signed_count_imbalance", "trade_count", "mean_trade_size", "trade_size_dispersion",
    "large_trade_share", "funding_rate", "log_oi", "d_oi",
)
N_FEATURES = len(FEATURES)
FAST_DIMS = (0, 1, 9, 10, 11)
SLOW_DIMS = (5, 6, 14, 15)
Z_DIMS = tuple(sorted(FAST_DIMS + SLOW_DIMS))
BOUNDED_DIMS = (2, 3, 4, 7, 8, 12, 13)
OHLCV_DIMS = tuple(range(0, 7))
MICRO_DIMS = tuple(range(7, 13))
PERP_DIMS = (13, 14, 15)

# ---- fixed values: folds, costs, grids ----------------------------------------------------------------
TRAIN_SHARE = 0.7
PURGE_BARS = 60
EMBARGO_BARS = 120
KAPPAS = (1.0, 1.5, 2.0, 3.0)
FEE_SIDE = 4e-4
IMPACT = 0.1
Q_OVER_ADV = 1e-3
MINUTES_PER_YEAR = 525_600
STRESS_COSTS = (0.0010, 0.0020, 0.0030)
SPREADS = {"major": 1e-4, "top20": 3e-4, "tail": 1e-3}
MAJORS = ("BTCUSDT", "ETHUSDT")
TOP_TIER = 20
HEADLINE_COST = 0.0030
EPS_IR = 1e-12


#: Look-aheads that an audit can plant: z-scores of a centred window or of all rows, volatility that reads the next return, wicks
#: clipped only where the price comes back, targets dropped where a second bar follows.
LEAKS = ("centered_zscore", "global_zscore", "sigma_next", "forward_revert", "validity_next")


@dataclass(frozen=True)
class FeatureConfig:
    """Windows in bars; defaults are the one-minute production setting."""

    bar_ms: int = BAR_MS
    half_life_fast: int = 1440
    half_life_slow: int = 5760
    n_warm: int = 64
    w_tau: int = 1440
    q_tau: float = 0.90
    pool_cap: int = 64
    mad_window: int = 1440
    mad_k: float = 12.0
    mad_min: int = 8
    stale_bars: int = 30
    structural: float = 0.50
    lam: float = 0.97
    vol_window: int = 60
    n_warm_vol: int = 30
    z_window: int = 1440
    #: "ewma", or "rolling" for z-scores against the past z_window bars and volatility over vol_window bars.
    estimator: str = "ewma"
    vol_scaled_inputs: bool = False
    chunk: int = 10_080
    #: One of LEAKS: audits plant it to see that they catch it. With ``leak_ms`` it acts at that bar alone.
    leak: str | None = None
    leak_ms: int | None = None

    def warm(self, half_life: int) -> int:
        return max(self.n_warm, half_life // 8)

    @property
    def warm_vol(self) -> int:
        return max(self.n_warm_vol, self.half_life_fast)

    @property
    def halo(self) -> int:
        """Rows of look-back every rolling operator needs, plus one for the lagged return."""
        return max(self.w_tau, self.mad_window, self.vol_window, self.z_window,
                   self.warm(self.half_life_slow), self.warm(self.half_life_fast), self.warm_vol) + 2

    def alpha(self, half_life: int) -> float:
        return 1.0 - 2.0 ** (-1.0 / half_life)


SMALL = FeatureConfig(
    half_life_fast=64, half_life_slow=128, n_warm=16, w_tau=64, mad_window=64, stale_bars=10,
    lam=0.94, vol_window=32, n_warm_vol=16, z_window=64,
)


def safe_chunk(chunk: int, decay: float) -> int:
    """Largest chunk whose in-chunk weights decay**-n stay far inside the double range."""
    return max(1, min(chunk, int(600.0 / -math.log(decay))))
