"""Trade ticks (fills) to market orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.numeric import coerce_numeric, pips, slippage, taker_side
from tickspark.operators.running import bucketed_lag

ORDER_BUCKET = "hour"


def with_notionals(ticks: DataFrame) -> DataFrame:
    """Add side, quote_abs, quote_sign and quantity_sign to every fill."""
    side = taker_side(F.col("is_buyer_maker"))
    quote = F.col("price") * F.col("quantity")
    return ticks.withColumns(
        {
            "side": side,
            "quote_abs": quote,
            "quote_sign": quote * side,
            "quantity_sign": F.col("quantity") * side,
        }
    )


def spread_by_hour(ticks: DataFrame) -> DataFrame:
    """Add the clock hour and place every (symbol, hour) in one partition.

    Orders, their lags and their hourly bars all group by a superset of (symbol, hour), so this one
    exchange serves the three of them, and a dominant symbol still spreads over as many tasks as it
    has hours.
    """
    with_hour = ticks.withColumn(ORDER_BUCKET, F.window("trade_time", "1 hour").getField("start"))
    return with_hour.repartition("symbol", ORDER_BUCKET)


def aggregate_orders(ticks: DataFrame, keys: Sequence[str] = ("symbol",), tie_breaker: str = "trade_id") -> DataFrame:
    """Collapse fills that share a timestamp into one market order.

    First and last price follow ``tie_breaker``, the exchange's own fill number, because file order
    does not survive a distributed read.
    """
    grouped = (
        with_notionals(ticks)
        .groupBy(*keys, "trade_time")
        .agg(
            F.min_by("price", tie_breaker).alias("price_first"),
            F.max_by("price", tie_breaker).alias("price_last"),
            F.sum("quote_abs").alias("quote_abs"),
            F.sum("quote_sign").alias("quote_sign"),
            F.sum("quantity_sign").cast("double").alias("quantity_sign"),
            F.sum("quantity").cast("double").alias("quantity_abs"),
            F.count("price").alias("num_ticks"),
        )
    )
    slip = slippage(F.col("quote_abs"), F.col("price_first"), F.col("quantity_abs"))
    return grouped.withColumns(
        {
            "is_long": F.col("quantity_sign") >= 0,
            "quote_slippage_abs": slip,
            "quote_slippage_sign": slip * F.signum("quantity_sign"),
        }
    )


def hourly_orders(ticks: DataFrame, tie_breaker: str = "trade_id") -> DataFrame:
    """Market orders keyed (symbol, hour, trade_time), laid out by (symbol, hour)."""
    return aggregate_orders(spread_by_hour(ticks), ("symbol", ORDER_BUCKET), tie_breaker)


_LAGS = {"price_last": "price_last_prev", "trade_time": "trade_time_prev"}


def with_previous(orders: DataFrame) -> DataFrame:
    """Add the previous order's last price and time per symbol to orders keyed by hour."""
    return bucketed_lag(orders, ["symbol"], ORDER_BUCKET, "trade_time", _LAGS)


def with_previous_in_hour(orders: DataFrame) -> DataFrame:
    """The same lag stopping at the hour's start: NULL on the first order of every hour."""
    inside = Window.partitionBy("symbol", ORDER_BUCKET).orderBy("trade_time")
    return orders.withColumns({lagged: F.lag(source).over(inside) for source, lagged in _LAGS.items()})


def impact_orders(
    ticks: DataFrame, quote_to_usdt: Column | float = 1.0, keys: Sequence[str] = ("symbol",), tie_breaker: str = "trade_id"
) -> DataFrame:
    """Order-level samples for impact fits: notional, net side and absolute price move in bps."""
    rate = F.lit(float(quote_to_usdt)) if isinstance(quote_to_usdt, (int, float)) else quote_to_usdt
    clean = coerce_numeric(ticks, ["price", "quantity"], ["trade_time", "price", "quantity"])
    orders = aggregate_orders(clean, keys, tie_breaker).where(F.col("quote_abs") > 0)
    return orders.select(
        *keys,
        "trade_time",
        "price_first",
        "price_last",
        F.col("quote_abs").alias("notional_quote"),
        (F.col("quote_abs") * rate).alias("notional_usdt"),
        F.when(F.col("quote_sign") >= 0, 1).otherwise(-1).alias("side"),
        F.abs(pips(F.col("price_last"), F.col("price_first"))).alias("impact_bps"),
    )


def hold_time_seconds(last_time: Column, first_previous_time: Column) -> Column:
    """Seconds from the order before a window to the window's last order."""
    micros = F.expr("1000000")
    span = F.unix_micros(last_time.cast("timestamp")) - F.unix_micros(first_previous_time.cast("timestamp"))
    return span / micros
