"""As-of lookups: prices around an event, reference rates by minute, currency conversion."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.calendar import days_between, floor_time
from tickspark.functions.identifiers import base_asset, term_asset
from tickspark.names import CANDIDATE, EVENT_TIME, GROUP, TARGET
from tickspark.operators.running import bucketed_lag


def asof_join(
    points: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    direction: str = "backward",
) -> DataFrame:
    """For each point, the last value at or before its time (or the first at or after it).

    ``points`` and ``series`` share ``keys`` and ``time``; the found value and its time arrive as
    ``value`` and ``{value}_time``. Points and series are merged into one time line per (key, date)
    and values are carried across dates from one row per (key, date), so a key with most of the
    ticks is still split by date. Times within a key of ``series`` are expected to be unique.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    keys = list(keys)
    backward = direction == "backward"
    found = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    marked = series.where(F.col(value).isNotNull()).select(*keys, time, found.alias("_f"))
    line = points.withColumn("_is_point", F.lit(True)).unionByName(marked, allowMissingColumns=True)
    line = line.withColumn("_day", F.to_date(time))
    # Among equal times the series row must come first for a backward search and last for a forward one.
    tie = F.col("_is_point").asc_nulls_first() if backward else F.col("_is_point").asc_nulls_last()
    within = Window.partitionBy(*keys, "_day").orderBy(time, tie)
    across = Window.partitionBy(*keys).orderBy("_day")
    if backward:
        near = F.last("_f", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
        edge = F.max_by("_f", F.when(F.col("_f").isNotNull(), F.col(time)))
        far = F.last("_e", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    else:
        near = F.first("_f", ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing))
        edge = F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col(time)))
        far = F.first("_e", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    days = line.groupBy(*keys, "_day").agg(edge.alias("_e")).withColumn("_far", far).drop("_e")
    joined = line.withColumn("_near", near).where("_is_point").join(days, [*keys, "_day"], "left")
    hit = F.coalesce("_near", "_far")
    return joined.withColumns({value: hit.getField("v"), f"{value}_time": hit.getField("t")}).select(
        *points.columns, value, f"{value}_time"
    )


def leg_prices(
    legs: DataFrame,
    orders: DataFrame,
    buy_before: timedelta | Column = timedelta(minutes=15),
    sell_after: timedelta | Column = timedelta(minutes=1),
    radius: timedelta = timedelta(days=1),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Entry and exit of each (event, symbol) leg from orders in [T - radius, T + radius).

    Entry is the last price at or before T - buy_before. Exit is the first price at or after T, or
    at or after T + sell_after for the event's own target. A leg without both is empty: all four
    columns NULL. Legs are spread over the dates they touch and meet orders on (symbol, date), so
    only those orders are read into the aggregate. ``buy_before`` and ``sell_after`` may be columns
    of ``legs`` (then name the columns that tell legs apart in ``keys``).
    """
    before = F.lit(buy_before) if isinstance(buy_before, timedelta) else buy_before
    after = F.lit(sell_after) if isinstance(sell_after, timedelta) else sell_after
    t = F.col(EVENT_TIME)
    is_target = F.col(CANDIDATE) == F.col(TARGET)
    identity = [GROUP, EVENT_TIME, CANDIDATE, *keys]
    bounds = legs.select(
        *identity,
        (t - before).alias("_buy"),
        F.when(is_target, t + after).otherwise(t).alias("_sell"),
        (t - F.lit(radius)).alias("_from"),
        (t + F.lit(radius)).alias("_to"),
    )
    dated = bounds.withColumn("date", F.explode(days_between(F.col("_from"), F.col("_to"))))
    prices = orders.select(
        F.col("symbol").alias(CANDIDATE), F.to_date("trade_time").alias("date"), "trade_time", "price_first", "price_last"
    )
    at = F.col("trade_time")
    # Where orders are still to be built from fills, this reaches below that aggregate.
    prices = prices.join(dated.select(CANDIDATE, "date").distinct(), [CANDIDATE, "date"], "left_semi")
    near = prices.join(dated, [CANDIDATE, "date"]).where((at >= F.col("_from")) & (at < F.col("_to")))
    entry_at, exit_at = F.when(at <= F.col("_buy"), at), F.when(at >= F.col("_sell"), at)
    found = near.groupBy(*identity).agg(
        F.max_by("price_last", entry_at).alias("entry_price"),
        F.max(entry_at).alias("entry_ts"),
        F.min_by("price_first", exit_at).alias("exit_price"),
        F.min(exit_at).alias("exit_ts"),
    )
    complete = F.col("entry_ts").isNotNull() & F.col("exit_ts").isNotNull()
    names = ["entry_price", "entry_ts", "exit_price", "exit_ts"]
    blanked = found.withColumns({n: F.when(complete, F.col(n)) for n in names})
    return legs.join(blanked.select(GROUP, CANDIDATE, *keys, *names), [GROUP, CANDIDATE, *keys], "left")


# --- Reference rates ------------------------------------------------------------------------------


def _same_day_rates(asked: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rate per asked (keys, minute): the day's last one at or before it, else its first one after.

    Asked minutes and quoted minutes are merged to one row per minute and filled inside the day, so
    a day of one asset is 1440 rows at most, however many points asked for it.
    """
    merged = (
        asked.select(*keys, "minute", F.lit(True).alias("_asked"))
        .unionByName(quotes.select(*keys, "minute", "rate"), allowMissingColumns=True)
        .groupBy(*keys, "minute")
        .agg(F.max("rate").alias("_quoted"), F.max("_asked").alias("_asked"))
    )
    day = Window.partitionBy(*keys, F.to_date("minute")).orderBy("minute")
    upto = F.last("_quoted", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_quoted", ignorenulls=True).over(day.rowsBetween(0, Window.unboundedFollowing))
    return merged.withColumn("_rate", F.coalesce(upto, after)).where("_asked").select(*keys, "minute", "_rate")


def nearest_minute_rate(points: DataFrame, rates: DataFrame, time: str, name: str = "rate") -> DataFrame:
    """Rate of the same day at the last minute <= the point's minute, else at the first one after.

    ``points`` carry ``symbol`` and ``time``; ``rates`` carry (symbol, minute, rate), one row per minute.
    """
    placed = points.withColumn("minute", floor_time(F.col(time), 60))
    answered = _same_day_rates(placed.select("symbol", "minute").distinct(), rates, ["symbol"])
    return placed.join(answered.withColumnRenamed("_rate", name), ["symbol", "minute"], "left").drop("minute")


def quote_to_usdt(
    points: DataFrame,
    rates: DataFrame,
    quote: Column,
    time: str,
    name: str = "quote_to_usdt",
    strict: bool = False,
    stable: str = "USDT",
) -> DataFrame:
    """USDT per unit of the asset ``quote`` at ``time``.

    USDT itself is 1; otherwise the direct pair's rate, or one over the inverse pair's, whichever
    exists first and is finite and positive. Without either the result is NULL, or, with
    ``strict``, the query fails and names the asset.
    """
    placed = points.withColumns({"_asset": F.upper(quote), "minute": floor_time(F.col(time), 60)})
    sides = F.explode(F.array(F.lit(True), F.lit(False)))
    asked = placed.select("_asset", "minute").distinct().withColumn("_direct", sides)
    base, term = base_asset(F.col("symbol")), term_asset(F.col("symbol"))
    direct = term == stable
    quotes = rates.where(direct | (base == stable)).select(
        F.when(direct, base).otherwise(term).alias("_asset"), direct.alias("_direct"), "minute", "rate"
    )
    sided = _same_day_rates(asked, quotes, ["_asset", "_direct"])
    usable = F.when((F.col("_rate") > 0) & (F.col("_rate") < float("inf")), F.col("_rate"))
    answered = sided.groupBy("_asset", "minute").agg(
        F.coalesce(
            F.max(F.when(F.col("_direct"), usable)), F.max(F.when(~F.col("_direct"), F.try_divide(F.lit(1.0), usable)))
        ).alias(name)
    )
    joined = placed.join(answered, ["_asset", "minute"], "left")
    value = F.when(F.col("_asset") == stable, F.lit(1.0)).otherwise(F.col(name))
    if strict:
        failure = F.raise_error(F.concat(F.lit("no indicative price for "), F.col("_asset"))).cast("double")
        value = F.when(F.col(time).isNull(), value).otherwise(F.coalesce(value, failure))
    return joined.withColumn(name, value).drop("_asset", "minute")


def buy_and_hold(events: DataFrame, rates: DataFrame, symbol: str = "BTC-USDT") -> DataFrame:
    """Increments of holding ``symbol`` between consecutive event times (first 0); empty below two prices."""
    points = events.select(F.lit(symbol).alias("symbol"), GROUP, EVENT_TIME)
    priced = nearest_minute_rate(points, rates, EVENT_TIME, "price").where(F.col("price") > 0)
    ordered = priced.withColumns({"_order": F.struct(EVENT_TIME, GROUP), "_day": F.to_date(EVENT_TIME)})
    lagged = bucketed_lag(ordered, ["symbol"], "_day", "_order", {"price": "_previous"})
    held = F.coalesce(F.try_divide(F.col("price"), F.col("_previous")) - 1, F.lit(0.0))
    enough = priced.agg(F.count("*") >= 2).scalar()
    return lagged.where(enough).select(GROUP, EVENT_TIME, held.alias("portfolio_return"))
