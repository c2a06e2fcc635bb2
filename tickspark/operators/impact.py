"""Square-root price impact: samples from candles, closed-form fits, diagnostics and prices.

The model I(Q) = beta * sqrt(Q in USDT), beta >= 0, no intercept, has the least-squares solution
beta = max(0, sum(sqrt(Q) * I) / sum(Q)), so a fit is two sums and any number of models is fitted by
one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.calendar import days_between, floor_time
from tickspark.functions.numeric import coerce_numeric, pips
from tickspark.names import BPS, CANDIDATE, EVENT_TIME, GROUP
from tickspark.operators.bars import trades_to_candles
from tickspark.operators.running import exact_percentiles

_CANDLE_VALUES = ["close_price", "quote_asset_volume", "taker_buy_quote_asset_volume"]


def candle_samples(
    candles: DataFrame,
    quote_to_usdt: Column | float = 1.0,
    keys: Sequence[str] = ("symbol",),
    sell_only: bool = False,
) -> DataFrame:
    """Impact samples from consecutive kept candles of each key.

    Q is the absolute net taker volume and the impact the absolute close-to-close move. The first
    candle, non-positive previous closes and candles without net volume give no sample. The window
    holds one row per candle slot of a key, whose number the fit's time range bounds.
    """
    rate = F.lit(float(quote_to_usdt)) if isinstance(quote_to_usdt, (int, float)) else quote_to_usdt
    clean = coerce_numeric(candles, _CANDLE_VALUES, ["open_time", *_CANDLE_VALUES])
    order = Window.partitionBy(*keys).orderBy("open_time")
    net = 2 * F.col("taker_buy_quote_asset_volume") - F.col("quote_asset_volume")
    lagged = clean.withColumns({"_previous": F.lag("close_price").over(order), "_net": net})
    kept = lagged.where((F.col("_previous") > 0) & (F.col("_net") != 0))
    if sell_only:
        kept = kept.where(F.col("_net") < 0)
    quote = F.abs("_net")
    return kept.select(
        *keys,
        F.col("open_time").alias("trade_time"),
        F.col("_previous").alias("price_first"),
        F.col("close_price").alias("price_last"),
        quote.alias("notional_quote"),
        (quote * rate).alias("notional_usdt"),
        F.when(F.col("_net") > 0, 1).otherwise(-1).alias("side"),
        F.abs(pips(F.col("close_price"), F.col("_previous"))).alias("impact_bps"),
    )


def beta(notional: Column, impact: Column) -> Column:
    """Aggregate: non-negative least squares through the origin on sqrt(notional); 0 without data."""
    positive = notional > 0
    cross = F.sum(F.when(positive, F.sqrt(notional) * impact))
    square = F.sum(F.when(positive, notional))
    return F.coalesce(F.greatest(F.try_divide(cross, square), F.lit(0.0)), F.lit(0.0))


def fit(samples: DataFrame, keys: Sequence[str] = ("symbol",), frequency: str = "unknown") -> DataFrame:
    """One model per key: beta and the number of samples behind it."""
    return samples.groupBy(*keys).agg(
        beta(F.col("notional_usdt"), F.col("impact_bps")).alias("beta"), F.count("*").alias("num_samples")
    ).withColumn("sample_frequency", F.lit(frequency))


def side_diagnostics(samples: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key and side (buy and sell always present): count, median and largest impact, beta."""
    keys = list(keys)
    models = samples.groupBy(*keys).agg(beta(F.col("notional_usdt"), F.col("impact_bps")).alias("beta"))
    spine = models.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    sides = samples.groupBy(*keys, "side").agg(
        F.count("*").alias("num_samples"), F.max("impact_bps").alias("max_impact_bps")
    )
    medians = exact_percentiles(samples, [*keys, "side"], "impact_bps", [0.5], ["median_impact_bps"])
    joined = spine.join(sides, [*keys, "side"], "left").join(medians, [*keys, "side"], "left")
    return joined.select(
        *keys,
        F.when(F.col("side") == 1, "buy").otherwise("sell").alias("side"),
        F.coalesce("num_samples", F.lit(0).cast("bigint")).alias("num_samples"),
        F.coalesce("median_impact_bps", F.lit(0.0)).alias("median_impact_bps"),
        F.coalesce("max_impact_bps", F.lit(0.0)).alias("max_impact_bps"),
        "beta",
    )


def fit_quality(samples: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """R squared of the fitted curve per side: 1 - residual / total sum of squares, 0 for flat data."""
    keys = list(keys)
    models = samples.groupBy(*keys).agg(beta(F.col("notional_usdt"), F.col("impact_bps")).alias("beta"))
    residual = F.col("impact_bps") - F.col("beta") * F.sqrt("notional_usdt")
    total = F.var_pop("impact_bps") * F.count("*")
    fitted = samples.join(models, keys) if keys else samples.withColumn("beta", models.scalar())
    r2 = F.when(total > 0, 1 - F.sum(residual * residual) / total).otherwise(F.lit(0.0))
    return fitted.groupBy(*keys, "side").agg(r2.alias("r_squared"))


# --- Fits tied to events -----------------------------------------------------------------------


@dataclass(frozen=True)
class ImpactRegime:
    """Which fills around an event feed a model: [T + start, T + stop) in candles of ``seconds``."""

    start: timedelta
    stop: timedelta
    seconds: int
    sell_only: bool
    frequency: str


def entry_regime(lookback_days: int = 14) -> ImpactRegime:
    if lookback_days <= 0:
        raise ValueError("lookback_days must be positive")
    return ImpactRegime(timedelta(days=-lookback_days), timedelta(0), 300, False, "5min")


def exit_regime(window: timedelta = timedelta(minutes=10)) -> ImpactRegime:
    return ImpactRegime(timedelta(0), window, 5, True, "5s")


def _fills_near(ticks: DataFrame, legs: DataFrame, regime: ImpactRegime) -> DataFrame:
    """Fills of each leg's symbol in the regime's interval, met on (symbol, date)."""
    t = F.col(EVENT_TIME)
    bounds = legs.select(
        GROUP,
        EVENT_TIME,
        F.col(CANDIDATE).alias("symbol"),
        (t + F.lit(regime.start)).alias("_from"),
        (t + F.lit(regime.stop)).alias("_to"),
    )
    dated = bounds.withColumn("date", F.explode(days_between(F.col("_from"), F.col("_to"))))
    dated_ticks = ticks if "date" in ticks.columns else ticks.withColumn("date", F.to_date("trade_time"))
    near = dated_ticks.join(dated, ["symbol", "date"])
    return near.where((F.col("trade_time") >= F.col("_from")) & (F.col("trade_time") < F.col("_to")))


def event_candles(ticks: DataFrame, legs: DataFrame, regime: ImpactRegime) -> DataFrame:
    """Candles of each leg's interval, equal to resampling only that interval's fills.

    Candles are built once per symbol and shared by all events; only the slots cut by an interval's
    end are rebuilt from fills. Short intervals skip the shared candles and use the fills directly.
    """
    identity = [GROUP, EVENT_TIME, "symbol"]
    duration = f"{regime.seconds} seconds"
    if regime.stop - regime.start <= timedelta(hours=1):
        return trades_to_candles(_fills_near(ticks, legs, regime), duration, identity)

    t = F.col(EVENT_TIME)
    slot = F.lit(timedelta(seconds=regime.seconds))
    start, stop = t + F.lit(regime.start), t + F.lit(regime.stop)
    bounds = legs.select(
        GROUP, EVENT_TIME, F.col(CANDIDATE).alias("symbol"), start.alias("_from"), stop.alias("_to")
    )
    dated = bounds.withColumn("date", F.explode(days_between(F.col("_from"), F.col("_to"))))
    # Only the (symbol, date) pairs of some leg are turned into candles.
    dated_ticks = ticks if "date" in ticks.columns else ticks.withColumn("date", F.to_date("trade_time"))
    needed = dated_ticks.join(dated.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi").drop("date")
    shared = trades_to_candles(needed, duration).withColumn("date", F.to_date("open_time"))
    opened = F.col("open_time")
    whole = (
        shared.join(dated, ["symbol", "date"])
        .where((opened >= F.col("_from")) & (opened + slot <= F.col("_to")))
        .select(*identity, "open_time", *_CANDLE_VALUES)
    )
    cut_slots = F.array_distinct(
        F.array(floor_time(F.col("_from"), regime.seconds), floor_time(F.col("_to"), regime.seconds))
    )
    cut = bounds.withColumn("open_time", F.explode(cut_slots)).where(
        (F.col("open_time") < F.col("_from")) | (F.col("open_time") + slot > F.col("_to"))
    )
    at = F.col("trade_time")
    slotted = needed.withColumn("open_time", F.window("trade_time", duration).getField("start"))
    partial_fills = (
        slotted.join(cut, ["symbol", "open_time"])
        .where((at >= F.col("_from")) & (at < F.col("_to")))
        .select(*identity, "trade_time", "trade_id", "price", "quantity", "is_buyer_maker")
    )
    return whole.unionByName(
        trades_to_candles(partial_fills, duration, identity).select(*identity, "open_time", *_CANDLE_VALUES)
    )


def event_samples(
    ticks: DataFrame, legs: DataFrame, regime: ImpactRegime, rates: DataFrame | None = None
) -> DataFrame:
    """Impact samples per (event, symbol); ``rates`` has (pump_hash, currency_pair, rate)."""
    identity = [GROUP, EVENT_TIME, "symbol"]
    candles = event_candles(ticks, legs, regime)
    if rates is None:
        return candle_samples(candles, 1.0, identity, regime.sell_only)
    samples = candle_samples(candles, 1.0, identity, regime.sell_only)
    rated = samples.join(rates.withColumnRenamed(CANDIDATE, "symbol"), [GROUP, "symbol"], "left")
    rate = F.coalesce("rate", F.lit(1.0))
    return rated.withColumn("notional_usdt", F.col("notional_quote") * rate).drop("rate")


def fit_for_events(
    ticks: DataFrame, legs: DataFrame, regime: ImpactRegime, rates: DataFrame | None = None
) -> DataFrame:
    """One model per leg; legs without samples get beta 0 and zero samples. A missing rate counts as 1."""
    models = fit(event_samples(ticks, legs, regime, rates), [GROUP, "symbol"], regime.frequency)
    identity = legs.select(GROUP, EVENT_TIME, CANDIDATE)
    base = identity if rates is None else identity.join(rates, [GROUP, CANDIDATE], "left")
    rate = F.lit(1.0) if rates is None else F.coalesce("rate", F.lit(1.0))
    fitted = base.join(models.withColumnRenamed("symbol", CANDIDATE), [GROUP, CANDIDATE], "left")
    return fitted.select(
        GROUP,
        EVENT_TIME,
        CANDIDATE,
        F.coalesce("beta", F.lit(0.0)).alias("beta"),
        rate.alias("quote_to_usdt"),
        F.coalesce("num_samples", F.lit(0).cast("bigint")).alias("num_samples"),
        F.lit(regime.frequency).alias("sample_frequency"),
    )


def best_entry_example(
    ticks: DataFrame,
    legs: DataFrame,
    rates: DataFrame | None = None,
    regime: ImpactRegime | None = None,
    min_candles: int = 500,
    min_side_samples: int = 25,
    min_positive_impacts: int = 50,
) -> DataFrame:
    """The event whose fit rests on the most samples: (smaller side, positive impacts), earliest on ties.

    A top-1 report: ``limit`` is its meaning. An event needs ``min_candles`` fills and candles.
    """
    regime = regime or entry_regime()
    counted = _activity(ticks, legs, regime)
    samples = event_samples(ticks, legs, regime, rates)
    stats = samples.groupBy(GROUP, EVENT_TIME, "symbol").agg(
        F.count_if(F.col("side") == 1).alias("buys"),
        F.count_if(F.col("side") == -1).alias("sells"),
        F.count_if(F.col("impact_bps") > 0).alias("positive_impacts"),
        beta(F.col("notional_usdt"), F.col("impact_bps")).alias("beta"),
    )
    smaller = F.least("buys", "sells")
    usable = stats.join(counted, [GROUP, "symbol"]).where(
        (F.col("num_fills") >= min_candles)
        & (F.col("num_candles") >= min_candles)
        & (smaller >= min_side_samples)
        & (F.col("positive_impacts") >= min_positive_impacts)
    )
    ranked = usable.withColumn("smaller_side", smaller).orderBy(
        F.desc("smaller_side"), F.desc("positive_impacts"), EVENT_TIME, GROUP
    )
    return ranked.select(GROUP, "symbol", "smaller_side", "positive_impacts", "beta").limit(1)


def best_exit_example(
    ticks: DataFrame,
    legs: DataFrame,
    rates: DataFrame | None = None,
    regime: ImpactRegime | None = None,
    min_fills: int = 50,
    min_candles: int = 10,
    min_samples: int = 20,
) -> DataFrame:
    """The event with the most sell samples inside its own window, earliest on ties (a top-1 report)."""
    regime = regime or exit_regime()
    counted = _activity(ticks, legs, regime)
    stats = event_samples(ticks, legs, regime, rates).groupBy(GROUP, EVENT_TIME, "symbol").agg(
        F.count("*").alias("num_samples"), beta(F.col("notional_usdt"), F.col("impact_bps")).alias("beta")
    )
    usable = stats.join(counted, [GROUP, "symbol"]).where(
        (F.col("num_fills") >= min_fills)
        & (F.col("num_candles") >= min_candles)
        & (F.col("num_samples") >= min_samples)
    )
    ranked = usable.orderBy(F.desc("num_samples"), EVENT_TIME, GROUP)
    return ranked.select(GROUP, "symbol", "num_samples", "beta").limit(1)


def _activity(ticks: DataFrame, legs: DataFrame, regime: ImpactRegime) -> DataFrame:
    slot = F.window("trade_time", f"{regime.seconds} seconds").getField("start")
    per_slot = (
        _fills_near(ticks, legs, regime)
        .groupBy(GROUP, "symbol", slot.alias("_slot"))
        .agg(F.count("*").alias("_fills"), F.sum(F.col("price") * F.col("quantity")).alias("_quote"))
    )
    return per_slot.groupBy(GROUP, "symbol").agg(
        F.sum("_fills").alias("num_fills"), F.count_if(F.col("_quote") > 0).alias("num_candles")
    )


# --- Predicted impact ------------------------------------------------------------------------------


def terminal_impact_bps(beta_: Column, notional_quote: Column, rate: Column) -> Column:
    return F.when(notional_quote > 0, beta_ * F.sqrt(notional_quote * rate)).otherwise(F.lit(0.0))


def vwap_impact_bps(beta_: Column, notional_quote: Column, rate: Column) -> Column:
    """Average impact while the order fills: two thirds of the terminal impact."""
    return F.lit(2.0 / 3.0) * terminal_impact_bps(beta_, notional_quote, rate)


def impacted_price(price: Column, side: int, impact: Column) -> Column:
    """Price moved against the taker: up for a buy (side 1), down for a sell (side -1), never below 1e-12."""
    return F.greatest(F.lit(1e-12), price * (1 + side * impact / BPS))
