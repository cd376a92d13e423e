"""Column names and fixed lists of the data model."""

RAW_COLUMNS = ["timestamp_ms", "timestamp_utc", "price", "quantity", "is_buyer_maker", "agggressor_side", "trade_id"]
REQUIRED = ["timestamp_ms", "price", "quantity", "is_buyer_maker", "agggressor_side", "trade_id"]
BAR_COLUMNS = [
    "timestamp_s", "timestamp_utc", "buy_vol", "sell_vol", "net_delta", "cvd_cumulative", "buy_trades", "sell_trades",
    "total_trades", "price_open", "price_high", "price_low", "price_close", "vwap", "total_volume",
]
RETURN_WINDOWS, VOL_WINDOWS, SLOPE_WINDOWS, MOMENTUM_WINDOWS = (5, 15, 30), (30, 60, 300), (10, 30, 60), (10, 30)
FEATURES = (
    ["returns", "abs_returns", "cvd"]
    + [f"{k}_{w}s" for w in RETURN_WINDOWS for k in ("return", "volume", "intensity", "cvd_delta")]
    + [f"realized_vol_{w}s" for w in VOL_WINDOWS]
    + [f"cvd_slope_{w}s" for w in SLOPE_WINDOWS]
    + ["cvd_price_divergence_30s", "trade_intensity_zscore"]
    + [f"net_delta_mom_{w}s" for w in MOMENTUM_WINDOWS]
    + ["vroc_30s", "efficiency_ratio_30s", "vol_imbalance", "price_vwap_dist"]
)
NOT_FEATURES = {"timestamp_s", "timestamp_utc", "timestamp_ms", "is_buyer_maker", "agggressor_side", "trade_id"}
LOWER, UPPER = 0.01, 0.99
TINY = 1e-15
FEE_RATE, SLIPPAGE_RATE = 0.0004, 0.0001
