"""Column names, offsets and other fixed values of the data model."""

from __future__ import annotations

from datetime import datetime, timedelta

# --- Fixed values: archive column orders -------------------------------------------------
SPOT_TRADE_COLUMNS = [
    "trade_id",
    "price",
    "quantity",
    "quote_quantity",
    "trade_time",
    "is_buyer_maker",
    "is_best_match",
]
CANDLE_COLUMNS = [
    "open_time",
    "open_price",
    "high_price",
    "low_price",
    "close_price",
    "volume",
    "close_time",
    "quote_asset_volume",
    "num_trades",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    "unused",
]
DEFAULT_EXCHANGE = "BINANCE_SPOT"
MICROSECONDS_SINCE = datetime(2025, 1, 1)  # archives carry milliseconds before this day

# --- Fixed values: named intervals --------------------------------------------------------
INTERVALS: dict[str, timedelta] = {
    "1MIN": timedelta(minutes=1),
    "2MIN": timedelta(minutes=2),
    "3MIN": timedelta(minutes=3),
    "4MIN": timedelta(minutes=4),
    "5MIN": timedelta(minutes=5),
    "15MIN": timedelta(minutes=15),
    "1H": timedelta(hours=1),
    "2H": timedelta(hours=2),
    "4H": timedelta(hours=4),
    "12H": timedelta(hours=12),
    "1D": timedelta(days=1),
    "2D": timedelta(days=2),
    "7D": timedelta(weeks=1),
    "14D": timedelta(weeks=2),
}
REGRESSOR_SLUGS = ["5MIN", "15MIN", "1H", "2H", "4H", "12H", "1D", "2D", "7D", "14D"]
DECAY_SLUGS = ["1MIN", "2MIN", "3MIN", "4MIN", "5MIN"]

# --- Fixed values: feature families -------------------------------------------------------
FEATURE_FAMILIES = [
    "asset_return",
    "asset_return_zscore",
    "quote_abs_zscore",
    "share_of_long_trades",
    "powerlaw_alpha",
    "slippage_imbalance",
    "flow_imbalance",
    "num_trades",
]
STANDARDISED_FAMILIES = ["asset_return", "asset_return_zscore", "quote_abs_zscore", "powerlaw_alpha"]
NUM_PREV = "num_prev_pump"

# --- Fixed values: panel columns ----------------------------------------------------------
GROUP = "pump_hash"
GROUP_ID = "pump_id"
EVENT_TIME = "pump_time"
TARGET = "pumped_currency_pair"
CANDIDATE = "currency_pair"
LABEL = "is_pumped"
SCORE = "score"

# --- Fixed values: bins of the ranking metrics --------------------------------------------
TOPK_BINS = (1, 2, 3, 5, 10, 20, 30)
TOPK_PERCENT_BINS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)

# --- Fixed values: defaults of a backtest -------------------------------------------------
BUY_BEFORE = timedelta(minutes=15)
SELL_AFTER = timedelta(minutes=1)
ORDER_USDT = 1.0
IMPACT_LOOKBACK_DAYS = 14
PRICE_RADIUS = timedelta(days=1)
EXIT_WINDOW = timedelta(minutes=10)

# --- Fixed values: dataset boundaries and trading cost ------------------------------------
SPLIT_BOUNDARIES = [datetime(2020, 9, 1), datetime(2021, 5, 1)]
SPLIT_NAMES = ["TRAIN", "VALIDATION", "TEST"]
ROUND_TRIP_COST = 0.0025
BPS = 1e4


def feature_column(family: str, slug: str) -> str:
    """``asset_return`` at five minutes is ``asset_return@5MIN``."""
    return f"{family}@{slug}"


def feature_columns(family: str, slugs: list[str]) -> list[str]:
    return [feature_column(family, slug) for slug in slugs]


def regressor_columns(slugs: list[str] | None = None) -> list[str]:
    """Every numeric regressor: each family at each look-back, then the prior-event count."""
    slugs = REGRESSOR_SLUGS if slugs is None else slugs
    return [name for family in FEATURE_FAMILIES for name in feature_columns(family, slugs)] + [NUM_PREV]


def standardised_columns(slugs: list[str] | None = None) -> list[str]:
    slugs = REGRESSOR_SLUGS if slugs is None else slugs
    return [name for family in STANDARDISED_FAMILIES for name in feature_columns(family, slugs)]


def quoted(name: str) -> str:
    """Back-tick a column name so ``@`` and ``.`` are taken literally."""
    return f"`{name}`"
