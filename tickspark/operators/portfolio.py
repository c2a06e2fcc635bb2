"""Top-k portfolios: selection, round-trip legs, PnL, size sweeps and equity statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.calendar import days_between
from tickspark.functions.identifiers import term_asset
from tickspark.names import (
    BUY_BEFORE,
    CANDIDATE,
    EVENT_TIME,
    EXIT_WINDOW,
    GROUP,
    IMPACT_LOOKBACK_DAYS,
    ORDER_USDT,
    PRICE_RADIUS,
    ROUND_TRIP_COST,
    SELL_AFTER,
    TARGET,
)
from tickspark.operators.asof import leg_prices, quote_to_usdt
from tickspark.operators.impact import entry_regime, exit_regime, fit_for_events, impacted_price, vwap_impact_bps
from tickspark.operators.ranking import sort_score
from tickspark.operators.running import bucketed_running_sum, exact_percentiles
from tickspark.session import materialise


def _at_least_one(name: str, value: int) -> None:
    if value < 1:
        raise ValueError(f"{name} is {value}, but at least 1 is needed")


@dataclass(frozen=True)
class ExecutionConfig:
    """How a backtest trades: how many legs, when, how much of each, and with which price impact."""

    portfolio_size: int
    # when: entry before the event, exit of the event's own target after it, and how far prices are looked for
    buy_before: timedelta = BUY_BEFORE
    sell_after: timedelta = SELL_AFTER
    price_radius: timedelta = PRICE_RADIUS
    # how much: a size in quote units wins over one in USDT
    order_notional_quote: float = 0.0
    order_notional_usdt: float = ORDER_USDT
    # impact: days that a model learns from, and the minutes after the event that the exit model learns from
    use_price_impact: bool = False
    impact_lookback_days: int = IMPACT_LOOKBACK_DAYS
    exit_window: timedelta = EXIT_WINDOW

    def __post_init__(self) -> None:
        for name in ("portfolio_size", "impact_lookback_days"):
            _at_least_one(name, getattr(self, name))


# --- Selection ---------------------------------------------------------------------------------


def select_top_k(scored: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k best rows of each group with equal weights.

    ``row_number() <= k`` lets Spark keep only k rows per group in every task before the shuffle. NULL and NaN
    scores come last.
    """
    _at_least_one("k", k)
    group = [*keys, GROUP]
    best_first = Window.partitionBy(*group).orderBy(sort_score().desc(), CANDIDATE)
    top = scored.withColumn("_rank", F.row_number().over(best_first)).where(F.col("_rank") <= k)
    size = F.count("*").over(Window.partitionBy(*group))  # at most k rows
    return top.withColumn("weight", F.lit(1.0) / size).withColumnRenamed("_rank", "rank")


def shared_candidates(events: DataFrame, scored: DataFrame, on: Sequence[str], k: int) -> DataFrame:
    """Candidates of events that share cross-sections, as far as portfolios of up to ``k`` can choose them.

    Events with equal ``on`` see the same scored symbols in the same order, so each cross-section is ranked once and
    its best ``k`` meet the events: the candidates grow with the events, and not with events times symbols.
    """
    _at_least_one("k", k)
    best_first = Window.partitionBy(*on).orderBy(sort_score().desc(), CANDIDATE)
    best = scored.withColumn("_rank", F.row_number().over(best_first)).where(F.col("_rank") <= k).drop("_rank")
    return events.join(best, list(on))


def has_target(portfolio: DataFrame) -> DataFrame:
    return portfolio.groupBy(GROUP).agg(F.bool_or(F.col(CANDIDATE) == F.col(TARGET)).alias("has_pump"))


# --- Round-trip legs -----------------------------------------------------------------------------


def intended_quote(config_quote: Column, config_usdt: Column, rate: Column) -> Column:
    """Order size in quote units: the explicit quote size, else USDT over the entry rate, else 0."""
    return (
        F.when(config_quote > 0, config_quote)
        .when(config_usdt > 0, F.try_divide(config_usdt, rate))
        .otherwise(F.lit(0.0))
    )


def transaction_return(exit_price: Column, entry_price: Column, cost: float = ROUND_TRIP_COST) -> Column:
    return F.try_divide(exit_price, entry_price) - 1 - F.lit(cost)


def leg_pnl() -> Column:
    """PnL of a leg in USDT; without a filled size its plain fractional return."""
    value = transaction_return(F.col("exit_price"), F.col("entry_price"))
    filled, intended, usdt = (F.col(c) for c in ("filled_quote", "intended_quote", "exit_usdt"))
    return (
        F.when((filled > 0) & usdt.isNotNull(), value * filled * (usdt / filled))
        .when((intended > 0) & usdt.isNotNull(), value * intended * (usdt / intended))
        .otherwise(value)
    )


def quoted_legs(
    portfolio: DataFrame, orders: DataFrame, rates: DataFrame, config: ExecutionConfig, keys: Sequence[str] = ()
) -> DataFrame:
    """Entry and exit prices with the quote asset's USDT rate at both times. A leg that has prices but no rate stops
    the query: its return could not be added to the others' USDT.

    Prices come from the whole market and are a handful of rows, so they are stored before the two
    rate lookups read them.
    """
    priced = leg_prices(portfolio, orders, config.buy_before, config.sell_after, config.price_radius, keys)
    legs = materialise(priced, "legs")
    term = term_asset(F.col(CANDIDATE))
    entry = quote_to_usdt(legs, rates, term, "entry_ts", "entry_rate", strict=True)
    return quote_to_usdt(entry, rates, term, "exit_ts", "exit_rate", strict=True)


def impact_models(portfolio: DataFrame, ticks: DataFrame, rates: DataFrame, config: ExecutionConfig) -> DataFrame:
    """Entry and exit models of every leg.

    Both come from the look-back before the event; the event's own target exits with the model of
    its own window when that has samples.
    """
    legs = portfolio.select(GROUP, EVENT_TIME, TARGET, CANDIDATE).distinct()
    rated = quote_to_usdt(legs, rates, term_asset(F.col(CANDIDATE)), EVENT_TIME, "rate")
    at_event = materialise(rated.select(GROUP, CANDIDATE, "rate"), "event-rates")
    columns = ["beta", "quote_to_usdt", "num_samples"]
    before = fit_for_events(ticks, legs, entry_regime(config.impact_lookback_days), at_event).select(
        GROUP, CANDIDATE, *[F.col(c).alias(f"entry_{c}") for c in columns]
    )
    own = legs.where(F.col(CANDIDATE) == F.col(TARGET))
    during = fit_for_events(ticks, own, exit_regime(config.exit_window), at_event).select(
        GROUP, CANDIDATE, *[F.col(c).alias(f"own_{c}") for c in columns]
    )
    use_own = F.coalesce(F.col("own_num_samples") > 0, F.lit(False))
    joined = before.join(during, [GROUP, CANDIDATE], "left")
    exits = [F.when(use_own, F.col(f"own_{c}")).otherwise(F.col(f"entry_{c}")).alias(f"exit_{c}") for c in columns]
    return joined.select(GROUP, CANDIDATE, *[f"entry_{c}" for c in columns], *exits)


def execute(legs: DataFrame, config: ExecutionConfig, models: DataFrame | None = None) -> DataFrame:
    """Size, fill and price every leg; ``order_usdt`` in ``legs`` overrides the configured size.

    Without a positive size or without impact, legs keep their raw prices.
    """
    usdt = F.col("order_usdt") if "order_usdt" in legs.columns else F.lit(float(config.order_notional_usdt))
    intended = intended_quote(F.lit(float(config.order_notional_quote)), usdt, F.col("entry_rate"))
    complete = F.col("entry_ts").isNotNull()
    sized = legs.withColumn("intended_quote", F.when(complete, intended))
    filled = F.when(F.col("intended_quote") > 0, F.col("intended_quote"))
    sized = sized.withColumns(
        {
            "filled_quote": filled,
            "entry_usdt": filled * F.col("entry_rate"),
            "exit_usdt": filled * F.col("exit_rate"),
        }
    )
    if not config.use_price_impact:
        return sized.withColumns(
            {
                "entry_impact_bps": F.lit(0.0),
                "exit_impact_bps": F.lit(0.0),
                "entry_impact_num_bars": F.lit(0).cast("bigint"),
                "exit_impact_num_bars": F.lit(0).cast("bigint"),
            }
        )
    if models is None:
        raise ValueError("models are required when use_price_impact is set")
    size = F.coalesce("filled_quote", F.lit(0.0))
    moved = sized.join(models, [GROUP, CANDIDATE], "left").withColumns(
        {
            f"{leg}_impact_bps": F.when(
                size > 0, vwap_impact_bps(F.col(f"{leg}_beta"), size, F.col(f"{leg}_quote_to_usdt"))
            ).otherwise(F.lit(0.0))
            for leg in ("entry", "exit")
        }
    )
    priced = moved.withColumns(
        {
            "entry_price": F.when(complete, impacted_price(F.col("entry_price"), 1, F.col("entry_impact_bps"))),
            "exit_price": F.when(complete, impacted_price(F.col("exit_price"), -1, F.col("exit_impact_bps"))),
            **{
                f"{leg}_impact_num_bars": F.when(size > 0, F.col(f"{leg}_num_samples")).otherwise(F.lit(0))
                for leg in ("entry", "exit")
            },
        }
    )
    return priced.drop(*[c for c in models.columns if c not in (GROUP, CANDIDATE)])


# --- Per-event results -----------------------------------------------------------------------------


def portfolio_stats(executed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted PnL and leg metrics per event; empty legs add nothing and carry no weight."""
    live = F.col("entry_ts").isNotNull()
    weight = F.when(live, F.col("weight"))

    def weighted(value: str) -> Column:
        known = F.when(F.col(value).isNotNull(), weight)
        total = F.coalesce(F.sum(known), F.lit(0.0))
        # Same closeness test as an absolute tolerance of 1e-8 around zero.
        return F.when(F.abs(total) <= 1e-8, F.lit(0.0)).otherwise(F.sum(known * F.col(value)) / total)

    return executed.groupBy(*keys, GROUP, EVENT_TIME).agg(
        F.coalesce(F.sum(weight * leg_pnl()), F.lit(0.0)).alias("pnl"),
        weighted("entry_impact_bps").alias("mean_entry_impact_bps"),
        weighted("exit_impact_bps").alias("mean_exit_impact_bps"),
        weighted("entry_impact_num_bars").alias("mean_entry_impact_num_bars"),
        weighted("exit_impact_num_bars").alias("mean_exit_impact_num_bars"),
        F.coalesce(F.sum(weight * F.col("entry_usdt")), F.lit(0.0)).alias("executed_notional_usdt"),
        F.bool_or(F.col(CANDIDATE) == F.col(TARGET)).alias("has_pump"),
    )


def backtest(
    scored: DataFrame, ticks: DataFrame, orders: DataFrame, rates: DataFrame, config: ExecutionConfig
) -> DataFrame:
    """Top-k portfolio of every event, traded and valued: one row per event."""
    portfolio = materialise(select_top_k(scored, config.portfolio_size), "portfolio")
    legs = quoted_legs(portfolio, orders, rates, config)
    models = impact_models(portfolio, ticks, rates, config) if config.use_price_impact else None
    return portfolio_stats(execute(legs, config, models))


def overall_pnl(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return stats.groupBy(*keys).agg(F.sum("pnl").alias("overall_pnl"))


_MEANS = [
    "mean_entry_impact_bps",
    "mean_exit_impact_bps",
    "mean_entry_impact_num_bars",
    "mean_exit_impact_num_bars",
]


def sweep_sizes(
    scored: DataFrame,
    ticks: DataFrame,
    orders: DataFrame,
    rates: DataFrame,
    config: ExecutionConfig,
    quantities_usdt: Sequence[float],
) -> DataFrame:
    """Backtest summary per order size. Prices and models do not depend on size and are found once."""
    config = replace(config, use_price_impact=True, order_notional_quote=0.0)
    portfolio = materialise(select_top_k(scored, config.portfolio_size), "portfolio")
    legs = quoted_legs(portfolio, orders, rates, config)
    sizes = F.array(*[F.lit(float(q)) for q in quantities_usdt])
    sized = legs.withColumn("order_usdt", F.explode(sizes))
    executed = execute(sized, config, impact_models(portfolio, ticks, rates, config))
    # One row per event and size, read by the means and by both medians.
    return summarise_sizes(materialise(portfolio_stats(executed, ["order_usdt"]), "size-stats"))


def summarise_sizes(stats: DataFrame) -> DataFrame:
    """Collapse per-event results to one row per order size."""
    size = F.col("order_usdt")
    with_roe = stats.withColumn("roe", F.when(size > 0, F.col("pnl") / size))
    zero = F.lit(0.0)
    summary = with_roe.groupBy("order_usdt").agg(
        F.count("*").alias("num_pumps"),
        F.sum("pnl").alias("overall_pnl"),
        F.avg("pnl").alias("mean_pnl"),
        F.coalesce(F.avg("roe"), zero).alias("mean_roe"),
        *[F.avg(c).alias(c) for c in _MEANS],
        F.avg("executed_notional_usdt").alias("mean_executed_notional_usdt"),
    )
    medians = exact_percentiles(with_roe, ["order_usdt"], "pnl", [0.5], ["median_pnl"])
    roe_medians = exact_percentiles(with_roe, ["order_usdt"], "roe", [0.5], ["median_roe"])
    joined = summary.join(medians, "order_usdt").join(roe_medians, "order_usdt", "left")
    return joined.select(
        F.col("order_usdt").alias("quantity_usdt"),
        "num_pumps",
        "overall_pnl",
        F.when(size > 0, F.col("overall_pnl") / size).otherwise(zero).alias("cumulative_roe"),
        "mean_pnl",
        "median_pnl",
        "mean_roe",
        F.coalesce("median_roe", zero).alias("median_roe"),
        *_MEANS,
        "mean_executed_notional_usdt",
    )


def sweep_parameters(
    scored: DataFrame,
    orders: DataFrame,
    rates: DataFrame,
    sizes: Sequence[int],
    buy_before: Sequence[timedelta],
    sell_after: Sequence[timedelta],
    config: ExecutionConfig | None = None,
) -> DataFrame:
    """Total PnL for every (portfolio size, buy_before, sell_after).

    Timing variants are exploded on the largest portfolio's legs and priced in one pass; smaller
    portfolios reuse those legs, since the best k rows are a prefix of the best K.
    """
    config = config or ExecutionConfig(portfolio_size=max(sizes))
    largest = select_top_k(scored, max(sizes)).drop("weight")

    def choices(values: Sequence[timedelta]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(v.total_seconds()).alias("s")) for v in values]))

    timing = largest.withColumn("_buy", choices(buy_before)).withColumn("_sell", choices(sell_after))
    timing = timing.withColumns({"buy_before_s": F.col("_buy.s"), "sell_after_s": F.col("_sell.s")})
    keys = ["buy_before_s", "sell_after_s"]
    legs = leg_prices(timing, orders, F.col("_buy.v"), F.col("_sell.v"), config.price_radius, keys)
    term = term_asset(F.col(CANDIDATE))
    legs = materialise(legs, "legs")
    entered = quote_to_usdt(legs, rates, term, "entry_ts", "entry_rate", strict=True)
    rated = quote_to_usdt(entered, rates, term, "exit_ts", "exit_rate", strict=True)
    executed = execute(rated, config)
    chosen = executed.withColumn("portfolio_size", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(
        F.col("rank") <= F.col("portfolio_size")
    )
    keys = ["portfolio_size", *keys]
    # Equal weights over the rows a portfolio actually has: PnL is their mean with empty legs at 0.
    pnl = F.sum(F.when(F.col("entry_ts").isNotNull(), leg_pnl()).otherwise(F.lit(0.0))) / F.count("*")
    return chosen.groupBy(*keys, GROUP).agg(pnl.alias("pnl")).groupBy(*keys).agg(F.sum("pnl").alias("overall_pnl"))


# --- Equity ------------------------------------------------------------------------------------------


def equity_curve(stats: DataFrame) -> DataFrame:
    return stats.select(GROUP, F.col(EVENT_TIME).alias("time"), F.col("pnl").alias("portfolio_return"))


def cumulative_returns(curves: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Running sum of event returns in time order, accumulated inside days and across day totals."""
    dated = curves.withColumn("_day", F.to_date("time"))
    running = bucketed_running_sum(dated, keys, "_day", ["time", GROUP], {"portfolio_return": "cumulative_return"})
    return running.drop("_day")


def align_curves(curves: dict[str, DataFrame]) -> DataFrame:
    """Event returns of several models side by side on event time; absent values stay NULL."""
    named = [c.select("time", F.lit(name).alias("model"), "portfolio_return") for name, c in curves.items()]
    stacked = reduce(DataFrame.unionByName, named)
    return stacked.groupBy("time").pivot("model", list(curves)).agg(F.sum("portfolio_return"))


def portfolio_statistics(curves: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Annualised return, volatility and Sharpe ratio from daily sums, with idle days at zero.

    Days span the first to the last event day over all models, one row per calendar day and model.
    """
    keys = list(keys)
    daily = curves.groupBy(*keys, F.to_date("time").alias("day")).agg(F.sum("portfolio_return").alias("r"))
    span = curves.agg(days_between(F.min("time"), F.max("time"))).scalar()
    spine = daily.select(*keys).distinct().withColumn("day", F.explode(span))
    # Models miss days other models traded; those count as traded days with return 0.
    traded = daily.select("day").distinct().withColumn("_traded", F.lit(True))
    full = spine.join(daily, [*keys, "day"], "left").join(traded, "day", "left").fillna(0.0, ["r"])
    yearly, volatility = F.avg("r") * 365, F.stddev_samp("r") * math.sqrt(365)
    return full.groupBy(*keys).agg(
        F.avg(F.when(F.col("_traded"), F.col("r"))).alias("trading_avg_return"),
        yearly.alias("annualized_return"),
        volatility.alias("annualized_volatility"),
        F.try_divide(yearly, volatility).alias("sharpe_ratio"),
    )
