"""Event x symbol microstructure features over many look-back windows.

The windows are not evaluated by joining every order to every event. Orders are first reduced to
mergeable partials per (symbol, hour), a step that does not depend on the events. An event then
meets the hourly partials of its slice, and raw orders only in the few *edge hours* that hold one
of its window bounds. All look-backs end at the same instant, so each partial or order falls into
exactly one segment between two neighbouring bounds, and a window sums the segments up to its own.

Partials are laid out by (period of event times, share of symbols) before they meet the events, and
every row of one (event, symbol) comes to lie in one partition: the pieces of the join, which are
by far the most rows, are summed where they are made and never shuffled.

    ticks -> orders -> hourly partials --(period, share)--+
                  \\--> edge-hour orders --(hour)--> sums -+-> per (event time, symbol) -> per (event, symbol)

All of this is done once for each distinct event time; its events get the rows in a last join with the event list.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.calendar import days_between, floor_time, start_of_day
from tickspark.functions.numeric import powerlaw_alpha, price_return, ratio
from tickspark.names import (
    CANDIDATE,
    DECAY_SLUGS,
    EVENT_TIME,
    GROUP,
    INTERVALS,
    NUM_PREV,
    REGRESSOR_SLUGS,
    TARGET,
    feature_column,
)
from tickspark.operators.orders import hourly_orders, with_previous_in_hour


@dataclass(frozen=True)
class FeatureWindows:
    """Which windows to compute, all relative to the event time T.

    Look-backs are closed intervals [T - gap - offset, T - gap]; decay returns use [T, T + offset].
    Orders from [T - lookback, T + horizon] are visible, both ends included. ``baseline`` chooses
    the bars behind the z-score baseline: ``all`` of the slice, or only those starting before T.
    """

    offsets: dict[str, timedelta] = field(default_factory=lambda: {s: INTERVALS[s] for s in REGRESSOR_SLUGS})
    decays: dict[str, timedelta] = field(default_factory=lambda: {s: INTERVALS[s] for s in DECAY_SLUGS})
    lookback: timedelta = timedelta(days=30)
    horizon: timedelta = timedelta(hours=1)
    gap: timedelta = timedelta(hours=1)
    baseline: str = "all"

    def __post_init__(self) -> None:
        if self.baseline not in ("all", "pre"):
            raise ValueError(f"baseline must be 'all' or 'pre', got {self.baseline!r}")
        if any(self.gap + offset > self.lookback for offset in self.offsets.values()):
            raise ValueError("a look-back offset reaches beyond the slice")

    @property
    def sorted_offsets(self) -> list[tuple[str, timedelta]]:
        return sorted(self.offsets.items(), key=lambda item: item[1])

    @property
    def sorted_decays(self) -> list[tuple[str, timedelta]]:
        return sorted(self.decays.items(), key=lambda item: item[1])


#: Ways that one date or hour is dealt out by symbol where it meets the events: a date holds every symbol.
SALTS = 16


def by_salt(df: DataFrame) -> DataFrame:
    """Rows with a symbol, marked with the share of their date or hour that they belong to."""
    return df.withColumn("_salt", F.pmod(F.xxhash64("symbol"), F.lit(SALTS)))


def to_all_salts(events: DataFrame) -> DataFrame:
    """Event rows, which know no symbol yet, once for each share."""
    return events.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])))


#: Days of event times that share a partition, and shares of the symbols that each such period is dealt out to.
#: An order lies in the periods of all events that may see it: a slice's days over the period's, and one or two more.
PERIOD_DAYS = 8
SHARES = 64


def period_of(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD_DAYS).cast("int")


def share_of(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(SHARES)).cast("int")


# Segment numbers: look-backs count up from 0 and decays from _DECAY; what no window holds is
# _BEFORE or _AFTER the event and serves the bar baseline only.
_NO_WINDOW = -1
_DECAY = 1000
_BEFORE = 10_000
_AFTER = 20_000


def slices(events: DataFrame, windows: FeatureWindows) -> DataFrame:
    """One row per event with the bounds of its slice and windows, and the hours that hold a bound."""
    t = F.col(EVENT_TIME)
    end = t - F.lit(windows.gap)
    start, stop = t - F.lit(windows.lookback), t + F.lit(windows.horizon)
    starts = [end - F.lit(offset) for _, offset in windows.sorted_offsets]
    stops = [t + F.lit(offset) for _, offset in windows.sorted_decays]

    def hours_of(times: Column) -> Column:
        return F.array_distinct(F.transform(times, lambda x: floor_time(x, 3600)))

    # One array, because the planner tries every mix of the names and the expressions of columns made from each other.
    bounds = F.array(end, t, start, stop, *starts, *stops)
    return events.select(
        GROUP,
        EVENT_TIME,
        start.alias("slice_start"),
        stop.alias("slice_stop"),
        hours_of(F.array(start, stop)).alias("slice_hours"),
        bounds.alias("bounds"),
        hours_of(bounds).alias("edge_hours"),
    )


def _segment(at: Column, windows: FeatureWindows) -> Column:
    """One flat chain of cases: the planner's work on nested ones doubles with each bound."""
    bound = lambda i: F.get("bounds", F.lit(i))
    n_start, n_stop = len(windows.offsets), len(windows.decays)
    early, late = at <= bound(0), at >= F.col(EVENT_TIME)
    cases = [(early & (at >= bound(4 + i)), i) for i in range(n_start)]
    cases.append((early, _BEFORE))
    cases += [(late & (at <= bound(4 + n_start + i)), _DECAY + i) for i in range(n_stop)]
    segment = F
    for condition, number in [*cases, (late, _AFTER)]:
        segment = segment.when(condition, number)
    return segment.otherwise(_BEFORE)


_ORDER_SUMS = ["n", "n_long", "slippage_abs", "slippage_sign", "flow_abs", "flow_sign", "log_quote"]


def hourly_partials(orders: DataFrame) -> DataFrame:
    """Mergeable sums, extremes and end points of every (symbol, hour)."""
    return orders.groupBy("symbol", "hour").agg(
        F.count("*").alias("n"),
        F.sum(F.col("is_long").cast("bigint")).alias("n_long"),
        F.sum("quote_slippage_abs").alias("slippage_abs"),
        F.sum("quote_slippage_sign").alias("slippage_sign"),
        F.sum("quote_abs").alias("flow_abs"),
        F.sum("quote_sign").alias("flow_sign"),
        F.sum(F.ln("quote_abs")).alias("log_quote"),
        F.min("quote_abs").alias("quote_min"),
        F.max("quote_abs").alias("quote_max"),
        F.min("trade_time").alias("first_time"),
        F.max("trade_time").alias("last_time"),
        F.min_by("price_first", "trade_time").alias("open_price"),
        F.max_by("price_last", "trade_time").alias("close_price"),
    ).withColumn("bar_return", price_return(F.col("close_price"), F.col("open_price")))


def with_previous_hour(hourly: DataFrame) -> DataFrame:
    """Hours laid out by (period, share) with what the symbol's hour before ended with.

    A period holds all dates that its events' slices touch, so an hour that is missing there ends before every slice.
    The rows of a symbol also come to lie next to each other, and with them the groups that its pieces are summed to.
    """
    across = Window.partitionBy("period", "share", "symbol").orderBy("hour")  # one row per traded hour of the period
    return hourly.withColumns(
        {"previous_price": F.lag("close_price").over(across), "previous_time": F.lag("last_time").over(across)}
    )


def _null(type_: str) -> Column:
    return F.lit(None).cast(type_)


#: An (event, symbol) and the partition that holds all of it.
_EVENT_SYMBOL = ["period", "share", GROUP, EVENT_TIME, "symbol"]
_EXTREMES = ["quote_min", "quote_max", "previous_price", "close_price"]


def _piece(segment: Column, order: dict[str, Column], bar: tuple[Column, Column] | None = None) -> list[Column]:
    """The common row of all pieces: order measures, bar measures, any of which may be absent."""
    columns = [*map(F.col, _EVENT_SYMBOL), segment.alias("segment")]
    for name in ("n", "n_long"):
        columns.append(order.get(name, _null("bigint")).alias(name))
    for name in [*_ORDER_SUMS[2:], *_EXTREMES]:
        columns.append(order.get(name, _null("double")).alias(name))
    for name in ("first_time", "last_time"):
        columns.append(order.get(name, _null("timestamp_ntz")).alias(name))
    bar_return, bar_quote = bar or (_null("double"), _null("double"))
    return [*columns, bar_return.alias("bar_return"), bar_quote.alias("bar_quote")]


def _merged_orders() -> list[Column]:
    """Order measures of several pieces as those of one."""
    return [
        *[F.sum(name).alias(name) for name in _ORDER_SUMS],
        F.min("quote_min").alias("quote_min"),
        F.max("quote_max").alias("quote_max"),
        F.min_by("previous_price", "first_time").alias("previous_price"),
        F.max_by("close_price", "last_time").alias("close_price"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    ]


def slice_pieces(orders: DataFrame, events: DataFrame, windows: FeatureWindows) -> DataFrame:
    """Every (event, symbol)'s orders and bars as few rows as the window bounds allow.

    A symbol that traded on any date the slice touches gets at least one row, even when all its
    orders lie outside the slice: it belongs to the event's cross-section with empty windows.
    """
    cut = slices(events, windows).withColumns(
        {
            "period": period_of(F.to_date(EVENT_TIME)),
            "dates_start": start_of_day(F.col("slice_start")),
            "dates_stop": start_of_day(F.col("slice_stop")) + F.lit(timedelta(days=1)),
        }
    )
    previous = F.when(F.col("previous_time") >= F.col("slice_start"), F.col("previous_price"))

    # All hours of the dates the slice touches, in the periods of the events that may see them. An edge hour appears
    # twice: once for its bar, and once for the lag of its first order, which the raw orders below cannot see.
    back, ahead = (-(-span // timedelta(days=1)) for span in (windows.lookback, windows.horizon))
    day = F.to_date("hour")
    periods = F.sequence(period_of(F.date_sub(day, ahead)), period_of(F.date_add(day, back)))
    hourly = hourly_partials(orders).withColumns({"share": share_of(F.col("symbol")), "period": F.explode(periods)})
    shares = F.explode(F.array(*[F.lit(i) for i in range(SHARES)]))
    touches = (F.col("hour") >= F.col("dates_start")) & (F.col("hour") < F.col("dates_stop"))
    hourly = with_previous_hour(hourly.repartition("period", "share"))
    # Sorted already: the merge costs one shuffle of the event times. Sizes of exploded rows are not known to the planner,
    # which would gather all of these in the driver for a broadcast.
    met = hourly.join(cut.withColumn("share", shares).hint("merge"), ["period", "share"]).where(touches)
    is_edge = F.array_contains("edge_hours", F.col("hour"))
    roles = F.when(is_edge, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    hours = met.withColumn("_role", F.explode(roles))
    inside = (F.col("hour") > F.col("slice_hours")[0]) & (F.col("hour") < F.element_at("slice_hours", -1))
    whole = inside & (F.col("_role") == 0)
    head = (F.col("_role") == 2) & F.col("first_time").between(F.col("slice_start"), F.col("slice_stop"))
    barred = inside & (F.col("_role") != 2)
    measures = {name: F.when(whole, F.col(name)) for name in [*_ORDER_SUMS, "quote_min", "quote_max", "close_price", "last_time"]}
    measures["first_time"] = F.when(whole | head, F.col("first_time"))
    measures["previous_price"] = F.when(whole | head, previous)
    bar = (F.when(barred, F.col("bar_return")), F.when(barred, F.col("flow_abs")))
    placed = F.when(head, F.col("first_time")).when(inside, F.col("hour"))
    from_hours = hours.select(*_piece(F.coalesce(_segment(placed, windows), F.lit(_BEFORE)), measures, bar))

    # Edge hours: raw orders. The semi-join reaches the scan, so only those hours are shuffled. An edge hour's row is an
    # event's id and no more; the bounds are looked up by it, so that no bounds are held once for each hour.
    edges = cut.select(GROUP, F.explode("edge_hours").alias("hour"))
    in_edges = orders.join(edges.select("hour").distinct(), "hour", "left_semi")
    raw = (
        with_previous_in_hour(in_edges)
        .join(edges, "hour")
        .join(cut, GROUP)
        .where(F.col("trade_time").between(F.col("slice_start"), F.col("slice_stop")))
        .withColumns(
            {"previous_price": F.col("price_last_prev"), "previous_time": F.col("trade_time_prev"), "share": share_of(F.col("symbol"))}
        )
    )
    follows = F.col("previous_time").isNotNull()
    single = {
        "n": F.lit(1).cast("bigint"),
        "n_long": F.col("is_long").cast("bigint"),
        "slippage_abs": F.col("quote_slippage_abs"),
        "slippage_sign": F.col("quote_slippage_sign"),
        "flow_abs": F.col("quote_abs"),
        "flow_sign": F.col("quote_sign"),
        "log_quote": F.ln("quote_abs"),
        "quote_min": F.col("quote_abs"),
        "quote_max": F.col("quote_abs"),
        "previous_price": previous,
        "close_price": F.col("price_last"),
        "first_time": F.when(follows, F.col("trade_time")),
        "last_time": F.col("trade_time"),
    }
    # By hour too: the orders of an hour lie together, so their sums are made in place and shuffled once.
    summed = raw.select("hour", *_piece(_segment(F.col("trade_time"), windows), single))
    summed = summed.groupBy(*_EVENT_SYMBOL, "segment", "hour").agg(*_merged_orders())
    from_orders = summed.select(*_piece(F.col("segment"), {name: F.col(name) for name in single}))

    # The slice may cut its first and last bar short: rebuild those two from raw orders.
    ends = (
        raw.where(F.array_contains("slice_hours", F.col("hour")))
        .withColumn("segment", _segment(F.col("hour"), windows))
        .groupBy(*_EVENT_SYMBOL, "segment", "hour")
        .agg(
            F.min_by("price_first", "trade_time").alias("open_price"),
            F.max_by("price_last", "trade_time").alias("close_price"),
            F.sum("quote_abs").alias("flow_abs"),
        )
    )
    end_bar = (price_return(F.col("close_price"), F.col("open_price")), F.col("flow_abs"))
    from_ends = ends.select(*_piece(F.col("segment"), {}, end_bar))
    few = [df.repartition("period", "share") for df in (from_orders, from_ends)]
    return reduce(DataFrame.unionByName, [from_hours, *few])


def slice_totals(ticks: DataFrame, cut: DataFrame) -> DataFrame:
    """Fills and quote volume of the whole market in every slice of ``cut`` (see :func:`slices`).

    Hourly totals serve the whole hours; fills meet the slices only in the hours that a slice cuts, dealt out by
    symbol so that one busy hour is no single task.
    """
    quote = F.col("price") * F.col("quantity")
    placed = ticks.withColumn("hour", floor_time(F.col("trade_time"), 3600))
    hours = placed.groupBy("hour").agg(F.count("*").alias("fills"), F.sum(quote).alias("quote"))
    dated = cut.withColumn("date", F.explode(days_between(F.col("slice_start"), F.col("slice_stop"))))
    whole = (
        hours.withColumn("date", F.to_date("hour"))  # 24 rows a date
        .join(dated, "date")
        .where((F.col("hour") > F.col("slice_hours")[0]) & (F.col("hour") < F.element_at("slice_hours", -1)))
        .select(GROUP, "fills", "quote")
    )
    edges = cut.withColumn("hour", F.explode("slice_hours"))
    parts = (
        by_salt(placed)
        .join(to_all_salts(edges), ["hour", "_salt"])
        .where(F.col("trade_time").between(F.col("slice_start"), F.col("slice_stop")))
        .select(GROUP, F.lit(1).cast("bigint").alias("fills"), quote.alias("quote"))
    )
    both = whole.unionByName(parts)
    return both.groupBy(GROUP).agg(F.sum("fills").alias("fills"), F.sum("quote").alias("quote"))


def segment_partials(pieces: DataFrame, windows: FeatureWindows) -> DataFrame:
    """Sum the pieces of each (event, symbol, segment), in the partition that holds them."""
    baseline = F.col("bar_return"), F.col("bar_quote")
    if windows.baseline == "pre":
        early = (F.col("segment") < _DECAY) | (F.col("segment") == _BEFORE)
        baseline = tuple(F.when(early, value) for value in baseline)
    return pieces.groupBy(*_EVENT_SYMBOL, "segment").agg(
        *_merged_orders(),
        F.count("bar_return").alias("bars"),
        F.sum("bar_return").alias("bar_return"),
        F.sum("bar_quote").alias("bar_quote"),
        *[
            expression.alias(f"{stem}_{name}")
            for stem, value in zip(("base_return", "base_quote"), baseline)
            for name, expression in (
                ("n", F.count(value)),
                ("mean", F.avg(value)),
                ("m2", F.var_pop(value) * F.count(value)),
                ("min", F.min(value)),
                ("max", F.max(value)),
            )
        ],
    )


def with_baseline(partials: DataFrame) -> DataFrame:
    """Add mean and sample deviation of an (event, symbol)'s bars to its segments, a score of rows.

    Each segment's mean is set against the overall one before squaring, so large levels do not cancel.
    """
    over = Window.partitionBy(*_EVENT_SYMBOL)
    means, spreads = {}, {}  # of both baselines at once: each is one pass over the rows
    for stem in ("return", "quote"):
        n, mean, m2, least, most = (F.col(f"base_{stem}_{c}") for c in ("n", "mean", "m2", "min", "max"))
        means[f"{stem}_mean"] = F.try_divide(F.sum(n * mean).over(over), F.sum(n).over(over))
        off = mean - F.col(f"{stem}_mean")
        squares, total = F.sum(m2 + n * off * off).over(over), F.sum(n).over(over)
        # all values one and finite: exactly zero
        flat = (F.min(least).over(over) == F.max(most).over(over)) & (F.abs(F.max(most).over(over)) < F.lit(float("inf")))
        spreads[f"{stem}_std"] = F.when(total > 1, F.when(flat, F.lit(0.0)).otherwise(F.sqrt(squares / (total - 1))))
    return partials.withColumns(means).withColumns(spreads)


def _windows_of(segment: Column, windows: FeatureWindows) -> Column:
    """The nested windows that hold a segment; one that no window holds keeps its (event, symbol) in being."""
    last = len(windows.offsets) - 1
    last_decay = _DECAY + len(windows.decays) - 1
    nested = F.when(segment <= last, F.sequence(segment, F.lit(last))).when(
        segment.between(_DECAY, last_decay), F.sequence(segment, F.lit(last_decay))
    )
    return nested.otherwise(F.array(F.lit(_NO_WINDOW)))


def window_features(partials: DataFrame, windows: FeatureWindows) -> DataFrame:
    """One narrow row per (event, symbol, window): sums over the window's segments, then ratios."""
    spread = with_baseline(partials).withColumn("window", F.explode(_windows_of(F.col("segment"), windows)))
    total = {name: F.sum(name) for name in [*_ORDER_SUMS, "bars", "bar_return", "bar_quote"]}
    n = F.coalesce(total["n"], F.lit(0).cast("bigint"))
    bar_return, bar_quote = (F.try_divide(total[c], total["bars"]) for c in ("bar_return", "bar_quote"))
    return spread.groupBy(*_EVENT_SYMBOL, "window").agg(
        price_return(F.max_by("close_price", "last_time"), F.min_by("previous_price", "first_time")).alias("asset_return"),
        F.try_divide(total["n_long"].cast("double"), n).alias("share_of_long_trades"),
        powerlaw_alpha(n, total["log_quote"], F.min("quote_min"), F.max("quote_max")).alias("powerlaw_alpha"),
        ratio(total["slippage_sign"], total["slippage_abs"]).alias("slippage_imbalance"),
        ratio(total["flow_sign"], total["flow_abs"]).alias("flow_imbalance"),
        n.alias("num_trades"),
        ratio(bar_return, F.max("return_std")).alias("asset_return_zscore"),
        ratio(bar_quote - F.max("quote_mean"), F.max("quote_std")).alias("quote_abs_zscore"),
    )


_FEATURES = [
    "asset_return", "asset_return_zscore", "quote_abs_zscore", "share_of_long_trades", "powerlaw_alpha", "slippage_imbalance",
    "flow_imbalance", "num_trades",
]


def roll_up(partials: DataFrame, windows: FeatureWindows) -> DataFrame:
    """Nested windows and decay returns of every (event, symbol), one wide row each."""

    def at(window: int, value: str) -> Column:
        found = F.max(F.when(F.col("window") == window, F.col(value)))
        return F.coalesce(found, F.lit(0).cast("bigint")) if value == "num_trades" else found

    columns = [
        at(i, name).alias(feature_column(name, slug)) for i, (slug, _) in enumerate(windows.sorted_offsets) for name in _FEATURES
    ]
    for i, (slug, _) in enumerate(windows.sorted_decays):
        columns.append(at(_DECAY + i, "asset_return").alias(feature_column("target_return", slug)))
    rows = window_features(partials, windows).groupBy(*_EVENT_SYMBOL)
    # Every (event, symbol) has a row; the count keeps the aggregate valid without windows.
    wide = rows.agg(*columns) if columns else rows.agg(F.count("*").alias("_rows")).drop("_rows")
    return wide.drop("period", "share").withColumnRenamed("symbol", CANDIDATE)


def prior_event_count(candidates: DataFrame, labels: DataFrame, name: str = NUM_PREV) -> DataFrame:
    """Add how many labelled events each candidate symbol had strictly before the group's event.

    A symbol's distinct event times cut the time line into intervals of one count each, so a candidate meets at most
    one interval of its symbol, and the candidates are read once and in place where the intervals are few.
    """
    times = labels.groupBy(F.col(TARGET).alias("_symbol"), F.col(EVENT_TIME).alias("_from")).agg(F.count("*").alias("_n"))
    line = Window.partitionBy("_symbol").orderBy("_from")  # one row per event time of the symbol
    intervals = times.select("_symbol", "_from", F.lead("_from").over(line).alias("_to"), F.sum("_n").over(line).alias("_count"))
    after = (F.col(CANDIDATE) == F.col("_symbol")) & (F.col(EVENT_TIME) > F.col("_from"))
    upto = F.col("_to").isNull() | (F.col(EVENT_TIME) <= F.col("_to"))
    joined = candidates.join(intervals, after & upto, "left")
    return joined.select(*candidates.columns, F.coalesce("_count", F.lit(0).cast("bigint")).alias(name))


def moments(events: DataFrame) -> DataFrame:
    """The distinct event times as events of their own: all that a feature knows of an event is its time."""
    times = events.where(F.col(EVENT_TIME).isNotNull()).select(EVENT_TIME).distinct()
    return times.select(F.unix_micros(F.col(EVENT_TIME).cast("timestamp")).alias(GROUP), EVENT_TIME)


def per_event(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of event times as rows of the events at these times. Works on the stored events, whose size the planner sees."""
    return events.select(GROUP, EVENT_TIME).distinct().join(rows, EVENT_TIME).select(GROUP, EVENT_TIME, *rows.drop(EVENT_TIME).columns)


def moment_features_from_orders(
    orders: DataFrame, times: DataFrame, windows: FeatureWindows, labels: DataFrame
) -> DataFrame:
    """Feature rows for every (event time, active symbol); ``times`` are :func:`moments`."""
    rolled = roll_up(segment_partials(slice_pieces(orders, times, windows), windows), windows)
    return prior_event_count(rolled.drop(GROUP), labels)


def features_from_orders(
    orders: DataFrame, events: DataFrame, windows: FeatureWindows | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Feature rows for every (event, active symbol).

    ``orders`` come from :func:`hourly_orders`; store them once and reuse them for any event list.
    ``labels`` (default: the events themselves) are counted for ``num_prev_pump``. Events of one time share all
    their windows, which are computed once.
    """
    windows = windows or FeatureWindows()
    rows = moment_features_from_orders(orders, moments(events), windows, events if labels is None else labels)
    return per_event(rows, events)


def moment_features(
    ticks: DataFrame,
    events: DataFrame,
    windows: FeatureWindows | None = None,
    labels: DataFrame | None = None,
    quote_asset: str | None = "BTC",
) -> DataFrame:
    """:func:`event_features` with one row for each time of events; :func:`per_event` gives them to the events.

    Where events share times, these rows are fewer: store and reduce them rather than the events' own.
    """
    windows = windows or FeatureWindows()
    times = moments(events)
    universe = ticks if quote_asset is None else ticks.where(F.col("symbol").endswith(f"-{quote_asset}"))
    orders = hourly_orders(on_slice_dates(universe, times, windows))
    return moment_features_from_orders(orders, times, windows, events if labels is None else labels)


def event_features(
    ticks: DataFrame,
    events: DataFrame,
    windows: FeatureWindows | None = None,
    labels: DataFrame | None = None,
    quote_asset: str | None = "BTC",
) -> DataFrame:
    """Feature rows straight from fills; ``quote_asset`` limits the universe to pairs quoted in it."""
    return per_event(moment_features(ticks, events, windows, labels, quote_asset), events)


def on_slice_dates(ticks: DataFrame, events: DataFrame, windows: FeatureWindows) -> DataFrame:
    """Fills of the dates that some event's slice touches; prunes partitions of a dated store.

    The broadcast side has one row per calendar date, a few thousand at most.
    """
    t = F.col(EVENT_TIME)
    touched = days_between(t - F.lit(windows.lookback), t + F.lit(windows.horizon))
    dates = events.select(F.explode(touched).alias("date")).distinct()
    dated = ticks if "date" in ticks.columns else ticks.withColumn("date", F.to_date("trade_time"))
    return dated.join(F.broadcast(dates), "date", "left_semi").drop("date")
